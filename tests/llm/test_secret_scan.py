import random
import re

from stowage.llm.secret_scan import BASE, _machines, op9_secret_scan, secrets, spans_of

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)


def brute(text: str) -> list[tuple[int, int, int]]:
    found = [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    found += [(m.start(), m.end(), 1) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), m.end(), 2) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return sorted(found, key=lambda x: (x[0], x[2]))


def test_spans_agree_with_regular_expressions():
    pieces = ["password", "PassWd", "secret", "token", "apikey", "API_KEY", "=", ":", " ", "  ", '"', "'", "abcdefgh", "x", "é", "字", "AKIA", "ABCDEFGHIJKL", "0123456789abcdef", "0123456789abcdef" * 2, "\n", "=secret=", "-", "AKIAAKIA"]
    rng = random.Random(4)
    texts = ["".join(rng.choices(pieces, k=rng.randrange(1, 40))) for _ in range(3000)]
    texts += ["", "token=secret= abcdefgh1", "token=token=abcdefgh", 'secret="x" token: abcdefghij', "é" * 5000 + "token=abcdefgh"]
    assert spans_of([t.encode() for t in texts], BASE) == [brute(t) for t in texts]
    assert spans_of([None], BASE) == [[]]


def test_added_rules_leave_base_spans_alone():
    text = b"-----BEGIN RSA PRIVATE KEY----- token=ghp_" + b"a1" * 20
    spans = spans_of([text])[0]
    assert [s for s in spans if s[2] < len(BASE)] == brute(text.decode())
    assert [(text[a:b].decode()[:10], k) for a, b, k in spans if k >= len(BASE)] == [("-----BEGIN", 3), ("ghp_a1a1a1", 4)]


def test_tables(spark, tmp_path):
    """Nulls, repeated rows, ids of other types, columns with the operator's names, empty tables."""
    found = "token=abcdefgh é " + "0" * 40
    rows = [("a", found, 1), ("a", found, 1), (None, found, 2), ("b", None, 3), ("c", "", 4)]
    df = spark.createDataFrame(rows, "doc_id string, text string, spans int").selectExpr("*", "1 as id", "'x' as kind")
    made = secrets(df)
    got = sorted(((r.doc_id or "", [tuple(s) for s in r.spans]) for r in made.collect()))
    spans = [("assign", 0, 14), ("hex", 17, 57)]
    assert made.columns == ["doc_id", "spans"] and got == [("", spans), ("a", spans), ("a", spans), ("b", []), ("c", [])]
    assert secrets(df.limit(0)).count() == 0
    for kind in ("int", "long"):
        folder = f"{tmp_path}/{kind}"
        spark.createDataFrame([(1, found), (1, found), (2, None)], f"doc_id {kind}, text string").write.parquet(f"{folder}/documents.parquet")
        assert sorted((r.doc_id, r.n_assign, r.n_access, r.n_hex) for r in op9_secret_scan(spark, folder).collect()) == [(1, 1, 0, 1), (1, 1, 0, 1), (2, 0, 0, 0)]


def test_automaton_is_small():
    assert len(_machines(BASE)[0].accepts) < 3000
