import math
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stowage.llm import quality_classifier as Q

DOCS = "doc_id long, text string, source string, lang string, host string"


def corpus(seed, n):
    rng = random.Random(seed)
    words = [f"{a}{b}" for a in ("ba", "re", "ti", "mo", "lu") for b in ("n", "s", "ter", "ving", "d")]
    docs, labels = [], []
    for k in range(n):
        text = rng.choices(words, k=rng.randrange(20, 200))
        quality, toxic = 1, 0
        if k % 7 == 0:
            quality, text = 0, [w.upper() + "!!" for w in text]
        elif k % 5 == 0:
            toxic = 1
            for _ in range(4):
                text[rng.randrange(len(text))] = rng.choice(["vileword", "badname"])
        docs.append((k, " ".join(text), f"site{k % 3}" if k % 10 else f"rare{k}", "en", "x"))
        labels.append((k, quality, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(1, 900)
    fitted = [x for x in labels if x[0] % 2]
    made = Q.classified(spark.createDataFrame(docs, DOCS), spark.createDataFrame(fitted, "doc_id long, quality int, toxic int"))
    assert made.columns == ["doc_id", "text", "source", "lang", "host", "p_quality", "p_toxic", "kept"]
    kept = {r.doc_id: r.kept for r in made.collect()}
    assert len(kept) == 900
    held = [x for x in labels if x[0] % 2 == 0]
    clean = [k for k, q, t in held if q == 1 and t == 0]
    assert sum(kept[k] for k in clean) >= 0.99 * len(clean)
    bad = [k for k, q, t in held if q == 0 or t == 1]
    assert sum(not kept[k] for k in bad) >= 0.95 * len(bad)


def brute_posteriors(rows):
    """(p_good, p_bad) of (host, path, good, bad) rows, in plain loops."""
    p = lambda z: 1 / (1 + math.exp(-z))

    def strength(groups, towards):
        """groups: (n, total); towards: the rate each is pulled to."""
        weight = sum(n for n, _ in groups)
        spread = sum(n * ((t / n - r) ** 2 - r * (1 - r) / n) for (n, t), r in zip(groups, towards, strict=True)) / weight
        noise = sum(n * r * (1 - r) for (n, _), r in zip(groups, towards, strict=True)) / weight
        return min(1e6, max(1.0, noise / spread - 1)) if spread > 0 else 1e6

    out = []
    for z in (2, 3):
        hosts, paths = {}, {}
        for r in rows:
            for group, key in ((hosts, r[0]), (paths, r[:2])):
                n, t = group.get(key, (0, 0.0))
                group[key] = (n + 1, t + p(r[z]))
        rate = sum(t for _, t in hosts.values()) / len(rows)
        kh = strength(list(hosts.values()), [rate] * len(hosts))
        kp = strength(list(paths.values()), [(hosts[h][1] + kh * rate) / (hosts[h][0] + kh) for h, _ in paths])
        made = []
        for r in rows:
            own, (hn, ht), (pn, pt) = p(r[z]), hosts[r[0]], paths[r[:2]]
            host = (ht - own + kh * rate) / (hn - 1 + kh)
            site = min(1 - 1e-6, max(1e-6, (pt - own + kp * host) / (pn - 1 + kp)))
            made.append(p(r[z] + math.log(site / (1 - site)) - math.log(rate / (1 - rate))))
        out.append(made)
    return list(zip(*out, strict=True))


@pytest.mark.parametrize("joined", [False, True])
def test_posteriors_agree_with_brute_force(spark, monkeypatch, joined):
    """Of all rows, on hosts and paths of very different sizes, nulls and single rows among them."""
    if joined:
        monkeypatch.setattr(Q, "BROADCAST_SITES", 0)
    rng = random.Random(2)
    rows = []
    for k in range(1500):
        host = rng.choice(["big"] * 6 + ["mixed", "bad", None, f"rare{k}"])
        path = rng.choice(["a", "b", None])
        bad = rng.random() < (0.9 if host == "bad" else 0.5 if (host, path) == ("mixed", "a") else 0.05)
        rows.append((host, path, rng.gauss(3, 2), rng.gauss(3 if bad else -4, 1.5)))
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "k int, source string, lang string, __good double, __bad double")
    made = {r.k: r for r in Q.judged(df, "source", "lang").collect()}
    for k, (good, bad) in enumerate(brute_posteriors(rows)):
        assert abs(made[k]["__p_quality"] - good) < 1e-9 and abs(made[k]["__p_toxic"] - bad) < 1e-9
        assert made[k]["__kept"] == (good >= 0.5 and bad <= 0.5)


def test_sparse_sites_are_shrunk(spark):
    """The same evidence is worth more on a site with much like it, and a row does not speak for itself."""
    rows = [("a", "p", 4.0)] * 400 + [("b", "p", -4.0)] * 400 + [("c", "p", -4.0)] * 2 + [("d", "p", 0.5)] + [("a", "p", 0.5), ("b", "p", 0.5), ("c", "p", 0.5)]
    df = spark.createDataFrame([(k, h, p, z, z) for k, (h, p, z) in enumerate(rows)], "k int, source string, lang string, __good double, __bad double")
    got = {r.k: r["__p_quality"] for r in Q.judged(df, "source", "lang").collect()}
    alone, a, b, c = got[802], got[803], got[804], got[805]
    assert b < c < alone < a and abs(alone - 1 / (1 + math.exp(-0.5))) < 1e-9


def test_edges(spark):
    docs = spark.createDataFrame([(1, None, None, None, None), (None, "", "s", "en", ""), (2, "words " * 30000, "s", None, ""), (2, "words " * 30000, "s", None, "")], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert Q.classified(docs, none).where("kept").count() == 4
    some = spark.createDataFrame([(1, None, 0), (2, 1, None), (None, 0, 1)], "doc_id long, quality int, toxic int")
    assert Q.accepted(docs, some).columns == docs.columns
    clash = docs.withColumns({"kept": F.lit("no"), "good_shift": F.lit(1)})
    assert Q.accepted(clash, some).columns == clash.columns and Q.classified(clash, some).columns.count("kept") == 1
    assert Q.classified(docs.where(F.lit(False)), some).count() == 0


def test_remembered_words_are_bounded(monkeypatch):
    """Neither many words of one text nor long words stay in a task, and the scores are those of a new model."""
    monkeypatch.setattr(Q, "KNOWN_WORDS", 500, raising=False)
    rng = random.Random(4)
    words = [b"%x" % rng.getrandbits(64) for _ in range(3000)] + [b"w%d" % k * 2000 for k in range(50)]
    weights = {p: complex(rng.randrange(-8, 8), rng.randrange(-8, 8)) for w in words for p in Q._parts(w)}
    model = Q.Model(1 + 2j, weights)
    texts = [b" ".join(rng.sample(words, n)) for n in (3050, 400, 400, 3, 1200)] + [None]
    for text in texts:
        assert abs(model.score(text) - Q.Model(1 + 2j, weights).score(text)) < 1e-9
        assert len(model.words) <= 500 and max(map(len, model.words), default=0) <= 64


def test_counted_features_are_sent_in_parts(monkeypatch):
    """Features of a batch of ever new words are not gathered as one, and add up to those of each text."""
    rng = random.Random(5)
    texts = [b" ".join(b"%x" % rng.getrandbits(16) for _ in range(100)) for _ in range(600)] + [None]
    labels = [rng.choice([0, 1]) for _ in texts]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(labels, pa.int32())], ["text", "toxic"])
    monkeypatch.setattr(Q, "COUNTED", 1000)
    made = list(Q._counter("toxic")([batch]))
    assert len(made) > 10 and max(map(len, made)) < 1500
    want, got = {}, {}
    for text, label in zip(texts, labels, strict=True):
        for f in Q.features_of(text):
            n, k = want.get(f, (0, 0))
            want[f] = (n + 1, k + label)
    for r in (r for part in made for r in part.to_pylist()):
        n, k = got.get(r["f"], (0, 0))
        got[r["f"]] = (n + r["n"], k + r["k"])
    assert got == want
