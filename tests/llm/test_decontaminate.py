import hashlib
import random
import re

import pytest

from stowage.llm import decontaminate as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def brute(docs, items):
    out = []
    for doc, text in docs:
        w, hit, owners = words(text), set(), set()
        for item, body in items:
            b = words(body)
            size = min(8, len(b))
            for k in range(len(b) - size + 1 if b else 0):
                for at in range(len(w) - size + 1):
                    if w[at : at + size] == b[k : k + size]:
                        hit |= set(range(at, at + size))
                        owners.add(str(item))
        out.append((doc, len(w), len(hit), len(owners), hashlib.sha256(",".join(sorted(owners)).encode()).hexdigest(), len(owners) >= 2))
    return sorted(out)


@pytest.mark.parametrize("block", [200_000, 7])
def test_agrees_with_brute_force(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(D, "BLOCK_WINDOWS", block)
    rng = random.Random(block)
    vocabulary = ["the", "The", "of", "é", "字", "a1", "x", "longer", "rare", "10"]
    say = lambda n: rng.choice([" ", ", ", "\n", "-"]).join(rng.choices(vocabulary, k=n))
    items = [(k, say(rng.randrange(9, 25))) for k in range(12)] + [(12, "rare x rare x 10"), (13, ""), (14, None), (15, "x x x x x x x x x x x"), (9, "same id")]
    docs = []
    for k in range(150):
        parts = [say(rng.randrange(0, 40)) for _ in range(3)]
        if k % 3 == 0:
            parts.insert(1, rng.choice(items[:12])[1].upper())
        docs.append((k, " ".join(parts)))
    docs += [(200, None), (201, ""), (202, "!!"), (203, "X " * 3000), (204, "same ID"), (204, "same ID")]
    spark.createDataFrame([(*d, "e") for d in docs], "doc_id long, text string, items string").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = sorted(tuple(r) for r in D.op1_decontamination(spark, str(tmp_path)).collect())
    assert got == brute(docs, items)


def test_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g h i", 5), (None, "b c d e f g h i", 6), (3, None, None)], "doc_id long, text string, hits int")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["items"] for r in D.matches(docs, none).collect()] == [[], [], []]
    bench = spark.createDataFrame([(7, "b c d e f g h i"), (None, "a b")], "item_id long, text string")
    left = D.uncontaminated(docs, bench)
    assert left.columns == docs.columns and [tuple(r) for r in left.collect()] == [(3, None, None)]
    assert D.matches(docs.limit(0), bench).count() == 0


def test_only_the_rarest_shingle_is_looked_up():
    a, b = tuple(b"a b c d e f g h".split()), tuple(b"q b c d e f g h".split())
    index = D.Prefixes({a: ["1"], b: ["2"]}, {s: 5 for w in (a, b) for s in D.shingles(w)} | {tuple(b"c d e".split()): 1})
    assert set(index.by) == {tuple(b"c d e".split())}
    assert index.find(b"c d e f g h".split()) == (set(), set())
    assert index.find(b"x a b c d e f g h".split()) == ({(1, 9)}, {"1"})


def test_one_short_item_drops_no_document(spark):
    docs = spark.createDataFrame([(1, "this is the text"), (2, "the other é one"), (3, "x a b c d e f g h y"), (4, "nothing"), (5, "an é")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "The"), (2, "other, é"), (3, "A b c d e f g h"), (4, None), (1, "a b c d e f g h i")], "item_id long, text string")
    assert sorted(r.doc_id for r in D.uncontaminated(docs, bench).collect()) == [1, 4, 5]
    twice = spark.createDataFrame([(1, "The"), (1, "text")], "item_id long, text string")
    assert D.uncontaminated(docs, twice).count() == 5
