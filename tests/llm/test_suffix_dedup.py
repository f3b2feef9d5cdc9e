import hashlib
import random

import duckdb
import pytest

from stowage.llm import suffix_dedup as S


def brute(rows, length):
    """Removed spans of each (id, text), by a set of all strings seen."""
    seen, out = {}, []
    for doc, text in sorted(rows):
        data = text.encode()
        mask = bytearray(len(data))
        for i in range(len(data) - length + 1):
            piece = data[i : i + length]
            first = seen.setdefault(piece, (doc, i))
            if first < (doc, i):
                mask[i : i + length] = b"\1" * length
        kept = bytes(b for b, m in zip(data, mask, strict=True) if not m)
        n_spans = sum(m and (k == 0 or not mask[k - 1]) for k, m in enumerate(mask))
        out.append((doc, len(data), sum(mask), n_spans, hashlib.sha256(kept).hexdigest()))
    return out


def run(spark, rows):
    made = S.deduplicated(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted((r.doc_id, r.n_bytes, r.n_bytes - len(r.kept), len(r.removed), hashlib.sha256(r.kept).hexdigest()) for r in made.collect())


def mixture(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choices("abcdeé", k=rng.randrange(1, 8)))
    passages = [" ".join(word() for _ in range(rng.randrange(15, 80))) for _ in range(12)]
    rows = []
    for k in range(n):
        parts = [rng.choice(passages)[rng.randrange(0, 30) :] if rng.random() < 0.5 else " ".join(word() for _ in range(rng.randrange(1, 60))) for _ in range(rng.randrange(0, 6))]
        rows.append((rng.randrange(10**6) * 1000 + k, " ".join(parts)))
    rows += [(-7, "ab" * 400), (-6, "x" * 1000), (-5, ""), (10**12, "x" * 99), (10**12 + 1, "x" * 101), (10**12 + 2, rows[3][1]), (10**12 + 3, "\x00" * 300)]
    return rows


@pytest.mark.parametrize("most", [200_000, 2048, 40, 3, 1])
def test_agrees_with_brute_force(spark, monkeypatch, most):
    monkeypatch.setattr(S, "CONTEXTS", most)
    monkeypatch.setattr(S, "CHUNK", 700)
    if most < 100:
        monkeypatch.setattr(S, "HOT_ANCHORS", 10**9)
    rows = mixture(most, 250)
    assert run(spark, rows) == brute(rows, 100)


def test_documents(spark):
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet'").fetchall()
    assert run(spark, rows) == brute(rows, 100)


def test_edges(spark):
    long = "some words that repeat " * 20
    made = S.deduplicated(spark.createDataFrame([(None, long), (1, None), (2, long), (2, long), (3, long)], "doc_id long, text string")).collect()
    got = sorted((r.doc_id or 0, r.n_bytes, len(r.kept)) for r in made)
    first = 122  # the first string of the second round ends where the first one did
    assert got[0] == (0, 460, 460) and got[1] == (1, 0, 0) and got[4] == (3, 460, 0)
    assert got[2] == got[3] and got[2][2] < first
    assert S.deduplicated(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    # rows that share an id are one document: what repeats in one text goes from all
    df = spark.createDataFrame([(1, long), (5, "x"), (5, long), (5, "y" + long), (6, "y" + long)], "doc_id long, text string")
    got = sorted((r.doc_id, r.n_bytes, len(r.kept), len(r.removed)) for r in S.deduplicated(df).collect())
    assert got[1] == (5, 1, 0, 1) and got[2][:3] == (5, 460, 0) and got[4][:3] == (6, 461, 0)
    clash = df.where("doc_id = 1").selectExpr("*", "1 as doc", "'x' as start", "2 as key", "3 as place", "4 as found", "'a' as removed")
    assert S.deduplicated(clash).columns == ["doc_id", "n_bytes", "removed", "kept"] and S.deduplicated(clash).count() == 1


def test_equal_hashes_are_compared(monkeypatch):
    """Contexts with colliding hashes are told apart by their bytes."""
    rng = random.Random(4)
    tail = "".join(rng.choices("abcdefgh", k=150))
    texts = [("".join(rng.choices("xyz", k=60)) + tail).encode() for _ in range(20)] + [tail.encode()] * 2
    real = S.anchors

    def colliding(texts, length):
        *rest, context = real(texts, length)
        return *rest, context * 0

    monkeypatch.setattr(S, "anchors", colliding)
    batch = S.pa.RecordBatch.from_arrays([S.pa.array(range(22)), S.pa.array(texts, S.pa.binary())], ["doc", "text"])
    rows = [r for made in S._anchored([batch], 100) for r in made.to_pylist()]
    kept = set()
    for r in rows:
        if r["key"] is not None:
            anchor, far, near = S._unpacked(r["place"])
            kept.update(texts[r["doc"]][k : k + 100] for k in range(anchor - far, anchor - near + 1))
    spans = [r for r in rows if r["key"] is None]
    assert spans and kept == {t[k : k + 100] for t in texts for k in range(len(t) - 99)}
    assert all(texts[r["doc"]][r["start"] : r["end"]] in tail.encode() for r in spans)


def test_united_spans():
    docs, starts, ends = (S.np.array(x) for x in ([2, 1, 1, 2, 1, 1], [5, 0, 50, 105, 120, 10], [105, 100, 60, 205, 220, 20]))
    assert [x.tolist() for x in S._united(docs, starts, ends)] == [[1, 1, 2], [0, 120, 5], [100, 220, 205]]


def test_hot_passage(spark, monkeypatch):
    """A passage in most documents, with other text around it in each: its anchor is split until what is left is equal."""
    monkeypatch.setattr(S, "CONTEXTS", 16)
    monkeypatch.setattr(S, "SAMPLED", 1.0)
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefg", k=rng.randrange(2, 8)))
    passage = " ".join(word() for _ in range(40))
    rows = [(k, " ".join(word() for _ in range(rng.randrange(30))) + (passage if k % 3 else " ") + " ".join(word() for _ in range(20))) for k in range(400)]
    assert run(spark, rows) == brute(rows, 100)
