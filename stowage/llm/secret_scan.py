"""Secret scans by one combined automaton.

All rules are compiled into one minimal automaton that is run over the bytes of whole texts in a single pass.
It says where some rule's match first ends; a reversed automaton of that rule then finds where the match
begins, and a forward one where its longest form ends. The next match of the rule begins at that end or later.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type

from .automaton import Automaton, compiled, longest, parse, reverse, scan
from .common import per_text


@dataclass(frozen=True)
class Rule:
    """A kind of secret: what it looks like, and how long a match, or what follows `after`, has to be.

    Matches are taken leftmost and without overlap first; those too short are dropped then.
    """

    kind: str
    pattern: str
    least: int = 0
    either_case: bool = False
    after: str = ""


ASSIGN_HEAD = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""
#: The base rules. `hex` has its least length in the pattern, which changes nothing as its runs are maximal.
BASE = (
    Rule("assign", ASSIGN_HEAD + r"[A-Za-z0-9+/_.=-]+", 8, True, ASSIGN_HEAD),
    Rule("access", r"AKIA[A-Z0-9]+", 16),
    Rule("hex", r"[0-9a-f]{32,}"),
)
#: What this scan adds.
ADDED = (
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("forge", r"gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("cloud", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 20),
)
RULES = BASE + ADDED


@lru_cache
def _machines(rules: tuple[Rule, ...]) -> tuple[Automaton, list[tuple[Automaton, Automaton, Automaton | None]]]:
    trees = [parse(r.pattern, r.either_case) for r in rules]
    heads = [compiled([parse(r.after, r.either_case)], False) if r.after else None for r in rules]
    return compiled(trees, True), [(compiled([t], False), compiled([reverse(t)], False), h) for t, h in zip(trees, heads, strict=True)]


def spans_of(texts: list[bytes | None], rules: tuple[Rule, ...] = RULES) -> list[list[tuple[int, int, int]]]:
    """For each text its (start, end, rule number), sorted, in code points; a null text has none."""
    union, single = _machines(rules)
    plain = [t or b"" for t in texts]
    result = []
    for text, ends in zip(plain, scan(union, plain), strict=True):
        found = []
        done = [0] * len(rules)
        for end, bits in ends:
            for k, rule in enumerate(rules):
                if not bits >> k & 1 or end <= done[k]:
                    continue
                forward, backward, head = single[k]
                start = longest(backward, text, end, done[k], -1)
                if start < 0:
                    continue
                stop = longest(forward, text, start, len(text))
                done[k] = stop
                shown = start if head is None else longest(head, text, start, stop)
                if stop - shown >= rule.least:
                    found.append((start, stop, k))
        if found and not text.isascii():
            points = {}
            last = count = 0
            for b in sorted({b for start, stop, _ in found for b in (start, stop)}):
                count += len(text[last:b].decode())
                points[b] = count
                last = b
            found = [(points[a], points[b], k) for a, b, k in found]
        result.append(sorted(found, key=lambda x: (x[0], x[2])))
    return result


def secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """id_col and spans, an array of structs (kind, start, end) in code points, end exclusive, by start, then rule.

    One row for each row of df, in whole texts of any length; a null or empty text has no spans. Ids of any type and
    null ones are passed on, repeated ids are repeated rows. Other columns are not looked at; no rows give no rows.
    """
    only = df.select(id_col, text_col)
    names = [r.kind for r in rules]
    kind = only.schema[id_col].dataType
    out = pa.schema([pa.field("id", to_arrow_type(kind)), pa.field("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))])

    def work(texts: list[bytes | None]) -> dict[str, list]:
        return {"spans": [[{"kind": names[k], "start": a, "end": b} for a, b, k in found] for found in spans_of(texts, rules)]}

    made = only.selectExpr(f"`{id_col}` as id", f"cast(`{text_col}` as binary) as text").mapInArrow(per_text(work, out, ["id"], "text", 4096), f"id {kind.simpleString()}, spans array<struct<kind:string,start:long,end:long>>")
    return made.withColumnRenamed("id", id_col)


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").selectExpr("cast(doc_id as long) as id", "cast(text as binary) as text")
    base = {r.kind for r in BASE}
    out = pa.schema([(n, pa.int64()) for n in ("doc_id", "n_assign", "n_access", "n_hex")] + [("base_sha256", pa.string()), ("spans", pa.string())])

    def work(texts: list[bytes | None]) -> dict[str, list]:
        made: dict[str, list] = {f.name: [] for f in list(out)[1:]}
        for found in spans_of(texts):
            named = [(RULES[k].kind, f"{RULES[k].kind}:{a}:{b}") for a, b, k in found]
            for r in BASE:
                made[f"n_{r.kind}"].append(sum(kind == r.kind for kind, _ in named))
            made["base_sha256"].append(hashlib.sha256(",".join(s for kind, s in named if kind in base).encode()).hexdigest())
            made["spans"].append(",".join(s for _, s in named))
        return made

    return docs.mapInArrow(per_text(work, out, ["id"], "text", 4096), "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")


def _expression(rule: Rule, pattern: str) -> str:
    """A pattern for SQL: letters in either case written out, quotes doubled, inner groups not counted."""
    if rule.either_case and pattern == rule.after:
        pattern = re.sub(r"\\x[0-9A-F]{2}|[A-Za-z]", lambda m: m[0] if m[0][0] == "\\" else f"[{m[0].lower()}{m[0].upper()}]", pattern)
    return pattern.replace("(", "(?:").replace("'", "''")


def spans_sql(table: str) -> str:
    """SQL for (doc_id, k, first, last) of all secrets: every match with all that stands before it since the last one."""
    parts = []
    for k, rule in enumerate(RULES):
        head = _expression(rule, rule.after)
        body = _expression(rule, rule.pattern.removeprefix(rule.after))
        every = f"'(?s)(.*?)({head})({body})'"
        parts.append(f"""
  SELECT doc_id, {k} AS k, ends[p] - len(heads[p]) - len(bodies[p]) AS first, ends[p] AS last FROM (
    SELECT *, unnest(generate_series(1, len(bodies))) AS p FROM (
      SELECT *, list_transform(generate_series(1, len(gaps)), lambda q: list_sum(list_transform(generate_series(1, q), lambda z: len(gaps[z]) + len(heads[z]) + len(bodies[z])))::BIGINT) AS ends FROM (
        SELECT doc_id, regexp_extract_all(text, {every}, 1) AS gaps, regexp_extract_all(text, {every}, 2) AS heads, regexp_extract_all(text, {every}, 3) AS bodies FROM {table})))
  WHERE len(bodies[p]) >= {rule.least}""")
    return " UNION ALL ".join(parts)


_KINDS = "[" + ", ".join(f"'{r.kind}'" for r in RULES) + "]"
OP9_SQL = f"""
WITH spans AS ({spans_sql("documents")}),
named AS (SELECT *, {_KINDS}[k + 1] || ':' || first || ':' || last AS s FROM spans),
found AS (
  SELECT doc_id, {", ".join(f"count(*) FILTER (k = {k}) AS n_{r.kind}" for k, r in enumerate(BASE))},
    coalesce(string_agg(s, ',' ORDER BY first, k) FILTER (k < {len(BASE)}), '') AS base, string_agg(s, ',' ORDER BY first, k) AS spans FROM named GROUP BY doc_id)
SELECT d.doc_id, {", ".join(f"coalesce(n_{r.kind}, 0)::BIGINT AS n_{r.kind}" for r in BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN found f ON d.doc_id = f.doc_id
"""


def registered() -> Iterator[tuple]:
    yield "op9_secret_scan", op9_secret_scan, OP9_SQL
