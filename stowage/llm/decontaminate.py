"""Benchmark decontamination by a prefix-filtered set join.

An item's windows (8 words in a row, or the whole item if it is shorter) are sets of word shingles. A document
contains a window only if it contains all its shingles, so of each window only its first shingle in order of
rarity is looked up, the rarity being counted over all documents. Where a document has that shingle, the
shingle's place in the window fixes where the window would begin; beginnings outside the document are
dropped by their bounds, and the others are verified word by word.

The benchmark is cut into blocks of windows of a bounded size. Each block is sent to the executors and all
documents are matched against it where they are, so no frequent word gathers rows. With one block no document is
shuffled. With more, each is let go before the next is made, and what was found is joined by row.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import text_within, written

WINDOW, SHINGLE = 8, 3
#: A document is contaminated if it has windows of so many items.
LEAST_ITEMS = 2
#: Windows of a block, each of some hundred bytes; more windows make more blocks.
BLOCK_WINDOWS = 200_000

_WORD = {*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)}
_TABLE = bytes(b | 0x20 if 0x41 <= b <= 0x5A else b if b in _WORD else 0x20 for b in range(256))

Window = tuple[bytes, ...]


def words_of(text: bytes | None) -> list[bytes]:
    """Words of a text: A-Z lower-cased, then runs of a-z, 0-9 and characters outside ASCII."""
    return (text or b"").translate(_TABLE).split()


def windows_of(words: list[bytes], size: int = WINDOW) -> set[Window]:
    """The item-sized windows: each run of `size` words, or all words if there are fewer; none if there are none."""
    if not words:
        return set()
    return {tuple(words[k : k + size]) for k in range(max(1, len(words) - size + 1))}


def shingles(window: Window) -> list[Window]:
    size = min(SHINGLE, len(window))
    return [window[k : k + size] for k in range(len(window) - size + 1)]


def grams(words: list[bytes], size: int) -> Iterable[Window]:
    return zip(*(words[k:] for k in range(size)))


class Prefixes:
    """Windows by their rarest shingle: shingle -> (its place in the window, the window's length) -> window -> items."""

    def __init__(self, windows: dict[Window, list[str]], counts: dict[Window, int]):
        self.by: dict[Window, dict[tuple[int, int], dict[Window, list[str]]]] = {}
        for window, items in windows.items():
            first, place = min((counts.get(s, 0), s, k) for k, s in enumerate(shingles(window)))[1:]
            self.by.setdefault(first, {}).setdefault((place, len(window)), {})[window] = items
        self.sizes = sorted({len(s) for s in self.by})

    def find(self, words: list[bytes]) -> tuple[set[tuple[int, int]], set[str]]:
        """Word ranges of all windows that occur in words, and the items that have them."""
        ranges: set[tuple[int, int]] = set()
        items: set[str] = set()
        by, n = self.by, len(words)
        for size in self.sizes:
            for at, gram in [(k, g) for k, g in enumerate(grams(words, size)) if g in by]:
                for (place, length), windows in by[gram].items():
                    begin = at - place
                    if begin < 0 or begin + length > n:
                        continue
                    owners = windows.get(tuple(words[begin : begin + length]))
                    if owners is not None:
                        ranges.add((begin, begin + length))
                        items.update(owners)
        return ranges, items


def _blocks(benchmark: DataFrame, item: str, text: str, window: int) -> tuple[int, Iterator[dict[Window, list[str]]]]:
    """How many blocks there are, and the windows of all items with the items that have them, a block at a time.

    Items of null id are left out, those of equal id are one item.
    """
    source = benchmark.where(F.col(item).isNotNull()).select(F.col(item).cast("string").alias("item"), F.col(text).cast("binary").alias("text"))
    out = pa.schema([("item", pa.string()), ("window", pa.binary())])

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, words in zip(batch.column(0).to_pylist(), map(words_of, batch.column(1).to_pylist()), strict=True):
                made = [b" ".join(w) for w in windows_of(words, window)]
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(made), pa.string()), pa.array(made, pa.binary())], schema=out)

    made = written(source.mapInArrow(cut, "item string, window binary").groupBy("window").agg(F.collect_set("item").alias("items")))
    n = made.count()
    blocks = max(1, -(-n // BLOCK_WINDOWS))
    parts = [made if blocks == 1 else made.where(F.pmod(F.xxhash64("window"), F.lit(blocks)) == k) for k in range(blocks)]
    return blocks, ({tuple(bytes(r.window).split()): list(r["items"]) for r in part.toLocalIterator()} for part in parts)


def _counted(docs: DataFrame, windows: dict[Window, list[str]]) -> dict[Window, int]:
    """In how many documents each shingle of the windows is."""
    names = sorted({s for w in windows for s in shingles(w)})
    sent = docs.sparkSession.sparkContext.broadcast({s: k for k, s in enumerate(names)})
    sizes = sorted({len(s) for s in names})

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        total = np.zeros(len(of), np.int64)
        for batch in batches:
            for text in batch.column(0).to_pylist():
                words = words_of(text)
                for size in sizes:
                    seen = {of[g] for g in grams(words, size) if g in of}
                    if seen:
                        total[list(seen)] += 1
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["k", "n"])

    found = docs.select("__bytes").mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    sent.destroy()
    return {names[r.k]: r.n for r in found}


def matches(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """id_col, n_words, hits (array of word ranges, end exclusive) and items (array<string>), one row for each row of df.

    hits are the ranges of all windows that occur, merged where they overlap or touch; items are the sorted ids,
    as strings, of the items they belong to. Null and empty texts have no words. Items of null id or without
    words match nothing; items of equal id are one item. An empty benchmark leaves all documents without hits.
    Other columns are not looked at.
    """
    found = _matched(df, benchmark, id_col, text_col, item_col, item_text, window, ())
    return found.select(F.col("__id").alias(id_col), F.col("__n_words").alias("n_words"), F.col("__hits").alias("hits"), F.col("__items").alias("items"))


def _matched(df: DataFrame, benchmark: DataFrame, id_col: str, text_col: str, item_col: str, item_text: str, window: int, keep: tuple[str, ...]) -> DataFrame:
    """__id, the columns in keep, __n_words, __hits and __items."""
    source = text_within(df, text_col, keep)
    docs = df.select(F.col(id_col).alias("__id"), *keep, *([] if source == text_col else [F.col(text_col).cast("binary").alias(source)]))
    texts = F.col(source).cast("binary").alias("__bytes")
    spark = df.sparkSession
    n_blocks, blocks = _blocks(benchmark, item_col, item_text, window)
    types = "__n_words long, __hits array<struct<start:int,end:int>>, __items array<string>"
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "__bytes")
    if n_blocks == 1:
        windows = next(blocks)
        return docs.mapInArrow(_finder(spark.sparkContext.broadcast(Prefixes(windows, _counted(docs.select(texts), windows))), source), f"{head}, {types}")
    rows = written(docs.withColumn("__row", F.monotonically_increasing_id()))
    parts = []
    for windows in blocks:
        sent = spark.sparkContext.broadcast(Prefixes(windows, _counted(rows.select(texts), windows)))
        found = rows.select("__row", texts).mapInArrow(_finder(sent), f"__row long, {types}")
        parts.append(written(found.where(F.size("__items") > 0).drop("__n_words")))
        sent.destroy()
    every = reduce(DataFrame.unionByName, parts).groupBy("__row").agg(F.flatten(F.collect_list("__hits")).alias("__found"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("__items")))).alias("__items"))
    return rows.join(every, "__row", "left").drop("__row").mapInArrow(_joiner(source), f"{head}, {types}")


_HITS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def _merged(ranges: Iterable[tuple[int, int]]) -> list[dict[str, int]]:
    out: list[list[int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1][1] = max(b, out[-1][1])
        else:
            out.append([a, b])
    return [{"start": a, "end": b} for a, b in out]


def _finder(sent: Broadcast, source: str = "__bytes") -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: a block's hits and items in the texts of a column, beside all columns but __bytes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                cut = [words_of(t) for t in part.column(source).cast(pa.binary()).to_pylist()]
                found = [index.find(words) for words in cut]
                made = [pa.array([len(w) for w in cut], pa.int64()), pa.array([_merged(r) for r, _ in found], _HITS), pa.array([sorted(x) for _, x in found], pa.list_(pa.string()))]
                kept = [c for c in part.schema.names if c != "__bytes"]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + made, [*kept, "__n_words", "__hits", "__items"])

    return run


def _joiner(source: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: hits of all blocks, merged, for rows that have a text, __found and __items (null if no block has any)."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                n_words = [len(words_of(t)) for t in part.column(source).cast(pa.binary()).to_pylist()]
                hits = [_merged((r["start"], r["end"]) for r in rows or ()) for rows in part.column("__found").to_pylist()]
                items = [x or [] for x in part.column("__items").to_pylist()]
                kept = [c for c in part.schema.names if c not in ("__bytes", "__found", "__items")]
                made = [pa.array(n_words, pa.int64()), pa.array(hits, _HITS), pa.array(items, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([part.column(c) for c in kept] + made, [*kept, "__n_words", "__hits", "__items"])

    return run


def uncontaminated(docs: DataFrame, benchmark: DataFrame, least_items: int = 1) -> DataFrame:
    """Documents with windows of fewer than least_items items, with the columns they came with.

    Items of fewer words than WINDOW count only in documents with at least LEAST_ITEMS items, as for op1.
    """
    n_words = F.size(F.regexp_extract_all(F.col("text").cast("string"), F.lit(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0)))
    marked = F.concat(F.when(n_words < WINDOW, "short ").otherwise("whole "), F.col("item_id").cast("string"))
    found = _matched(docs, benchmark.select(marked.alias("item_id"), "text"), "doc_id", "text", "item_id", "text", WINDOW, tuple(docs.columns))
    whole = F.size(F.filter("__items", lambda x: x.startswith("whole ")))
    every = F.size(F.array_distinct(F.transform("__items", lambda x: F.substring(x, 7, 1 << 30))))
    return found.where((whole < least_items) & (every < max(least_items, LEAST_ITEMS))).select(*docs.columns)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against all benchmark items."""
    found = matches(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    n_items = F.size("items").cast("long")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), n_items.alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_items >= LEAST_ITEMS).alias("contaminated"))


_WORDS_SQL = r"""regexp_extract_all(translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"""


def contamination_sql(table: str) -> str:
    """SQL for the columns of op1 over a table with doc_id and text."""
    return f"""
  WITH docs AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS_SQL.format('text')} AS w FROM {table}),
  items AS (SELECT item_id, {_WORDS_SQL.format('text')} AS w FROM benchmark WHERE item_id IS NOT NULL),
  windows AS (
    SELECT DISTINCT item_id, least({WINDOW}, len(w)) AS n, array_to_string(w[p : p + least({WINDOW}, len(w)) - 1], ' ') AS s
    FROM (SELECT item_id, w, unnest(generate_series(1, greatest(1, len(w) - {WINDOW - 1}))) AS p FROM items WHERE len(w) > 0)),
  sizes AS (SELECT DISTINCT n FROM windows),
  places AS (SELECT r, n, p, array_to_string(w[p : p + n - 1], ' ') AS s FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS p FROM docs, sizes WHERE len(w) >= n)),
  found AS (SELECT r, p, n, item_id FROM places JOIN windows USING (n, s)),
  hit AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(generate_series(p, p + n - 1)) AS q FROM found) GROUP BY r),
  owned AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item_id::VARCHAR AS item FROM found) GROUP BY r)
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= {LEAST_ITEMS} AS contaminated
  FROM docs LEFT JOIN hit USING (r) LEFT JOIN owned USING (r)"""


def registered() -> Iterator[tuple]:
    yield "op1_decontamination", op1_decontamination, contamination_sql("documents")
