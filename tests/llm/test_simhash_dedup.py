import random
import re

import duckdb
import numpy as np
import pytest
import xxhash

from stowage.llm import simhash_dedup as S
from stowage.llm.gray_index import close_pairs, gray_rank


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    grams = [" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << k for k in range(64) if 2 * sum(h >> k & 1 for h in hashes) > len(hashes))


def brute_components(ids, codes):
    label = list(ids)
    changed = True
    while changed:
        changed = False
        for i in range(len(ids)):
            for j in range(len(ids)):
                if label[j] < label[i] and (codes[i] ^ codes[j]).bit_count() <= 3:
                    label[i], changed = label[j], True
    return label


def test_fingerprints():
    rng = random.Random(2)
    texts = ["".join(rng.choices("aBcÉ \t\x0b\x1c\x85 \n", k=rng.randrange(0, 50))) for _ in range(500)] + ["", None, "x " * 40000]
    for t in texts:
        assert S.fingerprint(None if t is None else t.encode()) == [brute_fingerprint(t)]


def test_index_finds_all_close_pairs():
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    codes = np.unique(np.concatenate([base] + [base ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 40, dtype=np.uint64)) for _ in range(20)]))
    codes = rng.permutation(codes)
    sizes = np.array([1, 7, 8, 9, 100, len(codes) - 125])
    group = np.repeat(np.arange(len(sizes)), sizes)
    codes = codes[np.lexsort((gray_rank(codes), group))]
    a, b = close_pairs(codes, sizes, 3)
    want = {(i, j) for i in range(len(codes)) for j in range(i + 1, len(codes)) if group[i] == group[j] and int(codes[i] ^ codes[j]).bit_count() <= 3}
    assert set(zip(a.tolist(), b.tolist())) == want and len(a) == len(want)


@pytest.mark.parametrize("segments", [None, 5, 6])
def test_components(spark, monkeypatch, segments):
    """In small blocks, and by segments as for very many fingerprints."""
    monkeypatch.setattr(S, "BLOCK", 50)
    rng = random.Random(5)
    centre = [rng.getrandbits(64) for _ in range(30)] + [0]
    rows = []
    for k in range(700):
        code = rng.choice(centre[:3] if k % 3 == 0 else centre)
        for _ in range(rng.randrange(0, 4)):
            code ^= 1 << rng.randrange(64)
        rows.append((1000 - k, code))
    rows.append((-5, 0))
    signed = [(i, c - (1 << 64) if c >> 63 else c) for i, c in rows]
    found = {r.code[0]: r.component for r in S.components(spark.createDataFrame([(i, [c]) for i, c in signed], "id long, code array<long>"), segments=segments).collect()}
    want = brute_components([i for i, _ in rows], [c for _, c in rows])
    assert [found[c] for _, c in signed] == want


def test_segments():
    """Any three bits leave some bucket's bits alone, whatever the number of segments."""
    rng = random.Random(6)
    assert [S._segments(n) for n in (1, 10**8, 10**9, 10**10, 10**12)] == [4, 4, 5, 5, 6]
    for segments in (4, 5, 6):
        cuts = [{b for first, size in runs for b in range(first, first + size)} for _, runs in S._leads(1, segments)]
        assert all(any(not cut & three for cut in cuts) for three in (set(rng.sample(range(64), 3)) for _ in range(2000)))


def test_query_agrees_with_brute_force(spark):
    """The whole query over whole documents, copies and documents without words among them."""
    rows = duckdb.sql("select doc_id, text from '/root/testdata/sf0.001/documents.parquet' order by doc_id").fetchall()
    codes = [brute_fingerprint(t) for _, t in rows]
    want = list(zip([i for i, _ in rows], [f"{c:016x}" for c in codes], brute_components([i for i, _ in rows], codes), strict=True))
    made = S.op10_simhash_dedup(spark, "/root/testdata/sf0.001")
    assert made.columns == ["doc_id", "fingerprint", "component_id"] and sorted(tuple(r) for r in made.collect()) == want


def test_repeated_and_other_ids(spark):
    rows = [(5, "one two three four"), (5, "quite another text is here"), (9, "one two three four"), (2, "quite another text is here")]
    for kind in ("int", "long"):
        got = S.near_duplicates(spark.createDataFrame(rows, f"doc_id {kind}, text string"))
        assert sorted((r.doc_id, r.component_id) for r in got.collect()) == [(2, 2), (5, 2), (5, 5), (9, 5)] and got.schema["component_id"].dataType.simpleString() in ("int", "bigint")
    with pytest.raises(ValueError, match="integers"):
        S.near_duplicates(spark.createDataFrame([("a", "b")], "doc_id string, text string"))


def test_edge_cases(spark):
    rows = [(1, None, "a"), (2, "", "b"), (3, "One two three four", "c"), (3, "one TWO three\tfour", "d"), (None, "other words in here", "e")]
    got = S.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, code string")).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == [(0, 0), (1, 1), (2, 1), (3, 3), (3, 3)]
    assert S.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_similar_sets(spark):
    rng = random.Random(8)
    words = [f"w{k}" for k in range(3000)]
    rows = []
    for k in range(60):
        text = rng.choices(words, k=400)
        rows.append((k, " ".join(text)))
        near = list(text)
        for at in rng.sample(range(400), 3):  # at most 15 of 396 shingles, a similarity over 0.9
            near[at] = "other"
        rows.append((1000 + k, " ".join(near)))
        far = [w if rng.random() < 0.8 else "x" for w in text]  # about a third of the shingles stay
        rows.append((2000 + k, " ".join(far)))
    df = spark.createDataFrame([(i, t, "keep") for i, t in rows], "doc_id long, text string, code string")
    left = S.one_of_each(df)
    assert left.columns == df.columns
    ids = {r.doc_id for r in left.collect()}
    assert ids == {k for k in range(60)} | {2000 + k for k in range(60)}


def grams(text):
    words = text.lower().split()
    return {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))}


def test_sets_decide(spark):
    """Planted pairs, long and short ones: all at 0.8 or more are found, none below."""
    rng = random.Random(11)
    words = [f"w{k}" for k in range(5000)]
    rows, want = [], set()
    for k in range(1200):
        n = rng.randrange(9, 16) if k % 2 else rng.randrange(60, 400)
        text = rng.choices(words, k=n)
        near = list(text)
        while len(a := grams(" ".join(text))) and len(a & (b := grams(" ".join(near)))) / len(a | b) > 0.86:
            at = rng.choice([0, n - 1]) if k % 2 else rng.randrange(n)
            near[at] = f"{near[at]}x"
        rows += [(2 * k, " ".join(text)), (2 * k + 1, " ".join(near))]
        similarity = len(a & b) / len(a | b)
        want |= {2 * k} | ({2 * k + 1} if similarity < 0.8 else set())
    rows += [(9001, "One two three"), (9002, "one TWO\tthree"), (9003, ""), (9004, None), (9004, None)]
    left = {r.doc_id for r in S.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert left == want | {9001, 9003}
    assert 300 < len(want) - 1200 < 900


def test_large_groups_meet_in_blocks(spark, monkeypatch):
    """A chain of near copies, each similar to its neighbours only, longer than a block."""
    monkeypatch.setattr(S, "SET_BLOCK", 8)
    rng = random.Random(12)
    chain = [f"w{k}" for k in rng.sample(range(9000), 600)]
    rows = [(k, " ".join(chain[8 * k : 8 * k + 100])) for k in range(60)]
    ids = {r.doc_id for r in S.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert ids == {0}
