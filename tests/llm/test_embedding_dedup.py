import math

import numpy as np
import pytest

from stowage.llm import embedding_dedup as E


def brute(rows):
    fine = {}
    for i, v in rows:
        if i is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v):
            fine[i] = np.array(v, np.float64) / np.linalg.norm(np.array(v, np.float64))
    ids = sorted(fine)
    near = {i: [j for j in ids if j != i and len(fine[i]) == len(fine[j]) and fine[i] @ fine[j] >= 0.95] for i in ids}
    label = {i: i for i, _ in rows if i is not None}
    changed = True
    while changed:
        changed = False
        for i in ids:
            low = min([label[i], *(label[j] for j in near[i])])
            if low < label[i]:
                label[i], changed = low, True
    return sorted((i, len(near.get(i, [])), label[i], label[i] == i) for i, _ in rows if i is not None)


@pytest.mark.parametrize("block", [2048, 40, 1])
def test_agrees_with_brute_force(spark, monkeypatch, block):
    """With small blocks, and with codes of more hashes."""
    monkeypatch.setattr(E, "BLOCK", max(block, 40))
    rng = np.random.default_rng(block)
    centres = rng.normal(size=(12, 24))
    rows = []
    for k in range(700):
        v = centres[k % 12 if k % 2 else 0] + rng.normal(size=24) * (0.2 if k % 5 else 0.05)
        rows.append((900 - k, (v if k % 9 else centres[0]).astype(np.float32).tolist()))
    rows += [(1000, None), (1001, [0.0] * 24), (1002, [math.nan] + [1.0] * 23), (1003, [None] + [1.0] * 23), (1004, []), (1005, [1.0, 1.0]), (-3, [2.0, 2.0]), (1006, [1.0]), (1007, [3.0]), (1008, [math.inf, 1.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, node int")
    got = sorted(tuple(r) for r in E.near_duplicates(df, expected=10**10 if block == 1 else None).collect())
    assert got == brute(rows)


def test_edges(spark):
    kind = "vec_id long, embedding array<float>"
    assert E.near_duplicates(spark.createDataFrame([], kind)).count() == 0
    got = [tuple(r) for r in E.near_duplicates(spark.createDataFrame([(4, [1.0, 0.0]), (4, [1.0, 0.0]), (None, [1.0, 0.0])], kind)).collect()]
    assert sorted(got, key=str) == [(4, 1, 4, True), (4, 1, 4, True), (None, 0, None, None)]


def test_repeated_and_other_ids(spark):
    """Different vectors under one id are different vectors; ids are integers of any width."""
    rows = [(7, [1.0, 0.0, 0.0]), (7, [0.0, 1.0, 0.0]), (9, [0.0, 1.0, 0.01]), (3, [1.0, 0.01, 0.0]), (8, [0.0, 0.0, 1e200])]
    want = [(3, 1, 3, True), (7, 1, 3, False), (7, 1, 7, True), (8, 0, 8, True), (9, 1, 7, False)]
    for kind in ("long", "int", "smallint"):
        df = spark.createDataFrame(rows, f"vec_id {kind}, embedding array<double>")
        made = E.near_duplicates(df)
        assert sorted(tuple(r) for r in made.collect()) == want and made.schema["component_id"].dataType == df.schema["vec_id"].dataType
    with pytest.raises(ValueError, match="integers"):
        E.near_duplicates(df.withColumn("vec_id", df.vec_id.cast("string")))


def test_layouts():
    assert E.layout(1000, 64) == (8, 2, 4) and E.layout(10**8, 64)[1] == 3 and E.layout(10**11, 64)[1] == 4 and E.layout(10**8, 1024)[1] == 2
    for rows in (10, 10**6, 10**9, 10**12):
        for n in (1, 2, 3, 64, 100, 1000, 4096):
            tables, hashes, _ = E.layout(rows, n)
            assert tables <= 64 and (2 * max(2, n)) ** hashes <= 1 << (E.CODE_BITS + 1)


@pytest.mark.parametrize("n", [8, 32, 64, 100, 256, 768])
def test_recall_at_the_threshold(n):
    """Pairs of cosine 0.95 exactly meet in some table, in every layout."""
    rng = np.random.default_rng(5)
    u = rng.normal(size=(1500, n))
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    w = rng.normal(size=(1500, n))
    w -= (w * u).sum(1, keepdims=True) * u
    v = 0.95 * u + math.sqrt(1 - 0.95**2) * w / np.linalg.norm(w, axis=1, keepdims=True)
    for rows in (10**4, 10**9) + ((10**12,) if n <= 100 else ()):
        tables, hashes, probes = E.layout(rows, n)
        a, b = (E.codes_of(x, tables, hashes, probes) for x in (u, v))
        met = ((a[:, :, :1] == b).any(2) | (b[:, :, :1] == a).any(2)).any(1)
        assert met.mean() > 0.999, (n, tables, hashes, probes)
