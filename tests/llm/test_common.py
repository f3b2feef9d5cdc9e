import random

import pytest
from pyspark.sql import functions as F

from stowage.llm import common as C


def brute(links):
    label = {x: x for link in links for x in link}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            changed = changed or (label[a], label[b]) != (low, low)
            label[a] = label[b] = low
    return label


@pytest.mark.parametrize("local", [0, 1 << 20])
def test_connected_components(spark, monkeypatch, local):
    """Chains, stars, cliques and single links, in rounds and in one task."""
    monkeypatch.setattr(C, "LOCAL_LINKS", local)
    monkeypatch.setattr(C, "HOT", 20)
    rng = random.Random(3)
    links = [(k, k + 1) for k in range(100, 160)] + [(500, k) for k in range(501, 700)] + [(a, b) for a in range(800, 815) for b in range(800, a)]
    links += [(rng.randrange(2000, 2400), rng.randrange(2000, 2400)) for _ in range(150)] + [(-(2**62), 2**62)]
    rng.shuffle(links)
    rows = [(a, b) if rng.random() < 0.5 else (b, a) for a, b in links * 2] + [(5, 5), (None, 1), (2, None)]
    got = {r.node: r.component for r in C.connected_components(spark.createDataFrame(rows, "u long, v long")).collect()}
    want = brute([x for x in links if x[0] != x[1]])
    assert got == want
    assert C.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_smallest_ids(spark, monkeypatch):
    monkeypatch.setattr(C, "HOT", 4)
    nodes = [(k, 1000 - k) for k in range(40)] + [(99, None)]
    links = [(k, k + 1) for k in range(20)] + [(30, 31)]
    got = {r.node: r.component for r in C.smallest_ids(spark.createDataFrame(nodes, "node long, least long"), spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {k: 980 if k <= 20 else 969 if k in (30, 31) else 1000 - k for k in range(40)} | {99: None}


@pytest.mark.parametrize("hot", [10, 1])
def test_dealt_join(spark, monkeypatch, hot):
    monkeypatch.setattr(C, "HOT", hot)
    rows = [(k, "big" if k % 3 else f"k{k % 50}", "x") for k in range(600)] + [(1000, None, "x")]
    df = spark.createDataFrame(rows, "id long, key string, n string")
    small = df.where("key is not null").groupBy("key").agg(F.count("*").alias("rows"), F.max("id").alias("top"))
    got = {r.id: r.top for r in C.dealt_join(df, small, ["key"], "rows").collect()}
    top = {}
    for k, key, _ in rows:
        top[key] = max(k, top.get(key, -1))
    assert got == {k: top[key] if key is not None else None for k, key, _ in rows}


def test_blocks_meet(spark):
    """Any two rows of a bucket meet in some unit, whatever its size, and no unit is larger than two blocks."""
    for size in (10**6, 20):
        df = spark.createDataFrame([(k % 2 if k < 150 else 7, k) for k in range(160)], "bucket long, node long")
        units = {}
        for r in C.in_blocks(df, "bucket", "node", size).collect():
            units.setdefault((r.bucket, r.block_i, r.block_j), set()).add(r.node)
        met = {(a, b) for x in units.values() for a in x for b in x}
        assert met == {(a, b) for a in range(160) for b in range(160) if (a % 2 if a < 150 else 7) == (b % 2 if b < 150 else 7)}
        assert size > 1000 or max(map(len, units.values())) < 80
