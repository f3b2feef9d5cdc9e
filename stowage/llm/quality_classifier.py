"""Quality classifier with hierarchical empirical Bayes.

A logistic model over words, word beginnings and the shape of a text gives each document's own evidence of good
quality and of toxicity. Over all documents, that evidence is summed for each host and each path of a host; a
host's posterior rate is shrunk towards the global rate and a path's towards its host's, the less rows it has
the more, by strengths estimated from how much the rates differ. A document's posterior adds how far its
path's rate is from the global one to its own evidence, its own row being left out of the path's and host's sums.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, text_within, written
from .decontaminate import words_of

#: The model is fitted on at most so many labelled documents, those with the smallest hashes of their ids.
LABELLED_ROWS = 8000
#: How many standard deviations a feature has to go with a label.
LEAST_Z = 5.0
#: Features of a model at most, by how strongly they go with a label; and in how many documents one has to be.
FEATURES, LEAST_DOCUMENTS = 20_000, 3
#: Sites up to so many are broadcast to the documents; more are joined.
BROADCAST_SITES = 100_000
#: Words whose weights a task remembers at most, and how many bytes such a word has; and features that it counts before it sends them.
KNOWN_WORDS, KNOWN_BYTES, COUNTED = 200_000, 64, 100_000
HEADS = ("quality", "toxic")

_UPPER = bytes(range(0x41, 0x5B))
_SYMBOL = b"!#$%&*+<=>@[\\]^_`{|}~"


def shape_of(text: bytes, words: list[bytes], distinct: set[bytes]) -> list[bytes]:
    """Features of a text as a whole: in which step its measures are. Their names begin with two blanks."""
    size, n = max(1, len(text)), max(1, len(words))
    step = lambda share: min(26, int(4 * math.log2(1 + 100 * share)))
    repeated = sum(map(eq, words, words[1:])) / n
    return [
        b"  upper%d" % step((len(text) - len(text.translate(None, _UPPER))) / size),
        b"  symbol%d" % step((len(text) - len(text.translate(None, _SYMBOL))) / size),
        b"  repeated%d" % step(repeated),
        b"  distinct%d of %d" % (int(5 * len(distinct) / n), min(8, int(math.log2(n)) // 2)),
        b"  mean%d" % min(12, len(text) // n),
    ]


def _share(distinct: int) -> float:
    """What a word weighs for the quality of a text: in long texts less, or the noise of many words outweighs its shape."""
    return 1 / math.sqrt(max(1.0, distinct / 100))


def _parts(word: bytes) -> tuple[bytes, ...]:
    """A word's features: itself and how it begins."""
    return (word, b" 4" + word[:4], b" 5" + word[:5]) if len(word) > 5 else (word, b" 4" + word[:4]) if len(word) > 4 else (word,)


def features_of(text: bytes | None) -> Counter:
    text = text or b""
    words = words_of(text)
    distinct = set(words)
    found = Counter(p for w in distinct for p in _parts(w))
    found.update(shape_of(text, words, distinct))
    return found


@dataclass
class Model:
    """Log odds of both heads: weights of features as complex numbers, quality in the real and toxicity in the imaginary part."""

    bias: complex
    weights: dict[bytes, complex]

    def __post_init__(self):
        self.words: dict[bytes, complex] = {}

    def __getstate__(self):
        return {"bias": self.bias, "weights": self.weights, "words": {}}

    def score(self, text: bytes | None) -> complex:
        text = text or b""
        words = words_of(text)
        distinct = set(words)
        known, weights = self.words, self.weights
        if len(known) >= KNOWN_WORDS:  # a cache only
            known.clear()
        total = 0j
        for word in distinct:
            value = known.get(word)
            if value is None:
                value = sum((weights.get(p, 0) for p in _parts(word)), 0j)
                if len(word) <= KNOWN_BYTES and len(known) < KNOWN_WORDS:
                    known[word] = value
            if value:
                total += value
        shape = sum((weights.get(s, 0) for s in shape_of(text, words, distinct)), self.bias)
        return shape + complex(total.real * _share(len(distinct)), total.imag)


def _fitted(row: np.ndarray, column: np.ndarray, value: np.ndarray, positive: np.ndarray, features: int) -> tuple[float, np.ndarray]:
    """Bias and weights of a logistic model of labels, with small weights; features are given by place and value."""
    weights = np.zeros(features)
    if not len(positive) or positive.all() or not positive.any():
        return (0.0 if not len(positive) else 4.0 if positive.all() else -4.0), weights
    rate = positive.mean()
    bias = math.log(rate / (1 - rate))
    m, v = np.zeros(features + 1), np.zeros(features + 1)
    for step in range(1, 151):
        z = np.bincount(row, value * weights[column], len(positive)) + bias
        error = 1 / (1 + np.exp(-np.clip(z, -30, 30))) - positive
        slope = np.append(np.bincount(column, value * error[row], features) / len(positive) + 1e-4 * weights, error.mean())
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        weights, bias = weights - move[:-1], bias - move[-1]
    return float(bias), weights


def _counter(head: str) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """For mapInArrow: (f, n, k), in how many texts a feature is and in how many labelled 1; it may have several rows, to be summed."""

    def sums(total: Counter, inside: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(total), pa.binary()), pa.array(list(total.values()), pa.int64()), pa.array([inside[f] for f in total], pa.int64())], ["f", "n", "k"])

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total: Counter = Counter()
            inside: Counter = Counter()
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                for text, label in zip(part.column("text").to_pylist(), part.column(head).to_pylist(), strict=True):
                    found = features_of(text).keys()
                    total.update(found)
                    if label == 1:
                        inside.update(found)
                    if len(total) >= COUNTED:
                        yield sums(total, inside)
                        total, inside = Counter(), Counter()
            yield sums(total, inside)

    return count


def _chosen(sample: DataFrame, head: str) -> list[bytes]:
    """The features that go with a head's label most strongly, counted over the sample by the executors."""
    own = sample.where(F.col(head).isNotNull())
    whole = own.agg(F.count("*").alias("n"), F.avg(F.col(head).cast("double")).alias("rate")).first()
    if not whole.n or whole.rate in (0.0, 1.0):
        return []

    counts = own.select("text", head).mapInArrow(_counter(head), "f binary, n long, k long").groupBy("f").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
    rate = F.lit(whole.rate)
    z = F.abs((F.col("k") - F.col("n") * rate) / F.sqrt(F.col("n") * rate * (1 - rate)))
    best = counts.where(F.col("n") >= LEAST_DOCUMENTS).select("f", z.alias("z")).where(F.col("z") >= LEAST_Z)
    return [bytes(r.f) for r in best.orderBy(F.desc("z"), "f").limit(FEATURES).collect()]


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", rows: int = LABELLED_ROWS) -> Model:
    """The model, from at most `rows` labelled documents. Labels of one id are taken together: the worst of each counts.

    Null labels are left out of their head. A head without labels of both values is the same for all documents,
    and without any labels both heads are undecided, which keeps documents.
    """
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.min("quality").cast("int").alias("quality"), F.max("toxic").cast("int").alias("toxic"))
    known = known.orderBy(F.xxhash64("id"), "id").limit(rows)
    sample = written(docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("binary").alias("text")).join(F.broadcast(known), "id").select("text", "quality", "toxic"))
    names = {head: _chosen(sample, head) for head in HEADS}
    every = sorted({f for found in names.values() for f in found})
    sent = docs.sparkSession.sparkContext.broadcast({f: k for k, f in enumerate(every)})
    out = pa.schema([("places", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32())), ("share", pa.float64()), ("quality", pa.int32()), ("toxic", pa.int32())])

    def place(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = sent.value
        for batch in batches:
            places, counts, shares = [], [], []
            for text in batch.column("text").to_pylist():
                found = features_of(text)
                some = [(of[f], n) for f, n in found.items() if f in of]
                places.append([p for p, _ in some])
                counts.append([n for _, n in some])
                shares.append(_share(sum(f[:1] != b" " for f in found)))
            yield pa.RecordBatch.from_arrays([pa.array(places, out[0].type), pa.array(counts, out[1].type), pa.array(shares), batch.column("quality"), batch.column("toxic")], schema=out)

    got = sample.mapInArrow(place, "places array<int>, counts array<int>, share double, quality int, toxic int").toArrow().combine_chunks()
    sizes = np.diff(got.column("places").combine_chunks().offsets.to_numpy()) if len(got) else np.zeros(0, np.int64)
    row = np.repeat(np.arange(len(got)), sizes)
    column, counts = (np.asarray(got.column(c).combine_chunks().flatten(), np.int64) if len(got) else np.zeros(0, np.int64) for c in ("places", "counts"))
    is_shape = np.array([f[:2] == b"  " for f in every], bool)
    biases, weights = [], []
    for head in HEADS:
        labelled = np.array([x is not None for x in got.column(head).to_pylist()], bool)
        positive = np.array([x == 1 for x in got.column(head).to_pylist()], bool)[labelled]
        allowed = np.zeros(len(every), bool)
        own_names = set(names[head])
        allowed[[k for k, f in enumerate(every) if f in own_names]] = True
        keep = labelled[row] & allowed[column] if len(row) else np.zeros(0, bool)
        value = counts.astype(float)
        if head == "quality" and len(row):
            value = np.where(is_shape[column], value, value * got.column("share").to_numpy()[row])
        bias, own = _fitted((np.cumsum(labelled) - 1)[row][keep] if len(row) else row, column[keep], value[keep], positive, len(every))
        biases.append(bias)
        weights.append(own)
    return Model(complex(*biases), {f: complex(weights[0][k], weights[1][k]) for k, f in enumerate(every) if weights[0][k] or weights[1][k]})


def _scored(docs: DataFrame, model: Model, text_col: str, columns: list[str]) -> DataFrame:
    """The given columns of docs with __good and __bad, the log odds of each document's own evidence."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 256):
                part = batch.slice(at, 256)
                odds = np.array([sent.value.score(t) for t in part.column(source).cast(pa.binary()).to_pylist()], complex)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), pa.array(odds.real), pa.array(odds.imag)], [*columns, "__good", "__bad"])

    source = text_within(docs, text_col, columns)
    own = docs.select(*columns) if source == text_col else docs.select(*columns, F.col(text_col).cast("binary").alias(source))
    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema if f.name != "__bytes")
    return own.mapInArrow(run, f"{head}, __good double, __bad double")


def _odds(p: Column) -> Column:
    return F.log(p / (1 - p))


def _strength(sites: DataFrame, rows: str, total: str, towards: Column) -> float:
    """How many rows a parent's rate is worth: by the method of moments, between 1 and a million."""
    rate, n = F.col(total) / F.col(rows), F.col(rows)
    between = n * ((rate - towards) ** 2 - towards * (1 - towards) / n)
    got = sites.agg(F.sum(between) / F.sum(n), F.sum(n * towards * (1 - towards)) / F.sum(n)).first()
    if got[0] is None:
        return 1.0
    return float(min(1e6, max(1.0, (got[1] or 0) / got[0] - 1))) if got[0] > 0 else 1e6


@dataclass
class Prior:
    """A head's global rate, and how many rows the rate of a host and of a path's host are worth."""

    rate: float
    host: float
    path: float


def _host_rate(prior: Prior, n: Column, total: Column) -> Column:
    return (total + prior.host * prior.rate) / (n + prior.host)


def _path_rate(prior: Prior, n: Column, total: Column, host_rate: Column) -> Column:
    return (total + prior.path * host_rate) / (n + prior.path)


def sites(scored: DataFrame, host: str, path: str) -> tuple[DataFrame, dict[str, Prior]]:
    """The sums of each path, (host, path, n, good, bad, host_n, host_good, host_bad), and the priors of both heads.

    Both are sums of the documents' own probabilities over all rows; each has one row for a host and path, nulls too.
    """
    p = lambda c: 1 / (1 + F.exp(-F.col(c)))
    paths = written(scored.groupBy(_name(host).alias("host"), _name(path).alias("path")).agg(F.count("*").alias("n"), F.sum(p("__good")).alias("good"), F.sum(p("__bad")).alias("bad")))
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"), F.sum("good").alias("host_good"), F.sum("bad").alias("host_bad"))
    both = written(paths.join(hosts, "host"))
    whole = paths.agg(F.sum("n"), F.sum("good"), F.sum("bad")).first()
    priors = {}
    for head, total in (("good", whole[1]), ("bad", whole[2])):
        rate = min(1 - 1e-6, max(1e-6, total / whole[0])) if whole[0] else 0.5
        first = Prior(rate, _strength(hosts, "host_n", f"host_{head}", F.lit(rate)), 1.0)
        towards = _host_rate(first, F.col("host_n"), F.col(f"host_{head}"))
        priors[head] = Prior(rate, first.host, _strength(both, "n", head, towards))
    return both, priors


def _name(column: str) -> Column:
    """A host or path as text that is never null."""
    return F.coalesce(F.concat(F.lit("="), F.col(column).cast("string")), F.lit(""))


def _posterior(prior: Prior, head: str) -> Column:
    """A document's probability, from its own log odds and what its path and host are without it."""
    odds = F.col(f"__{head}")
    own = 1 / (1 + F.exp(-odds))
    host_rate = _host_rate(prior, F.col("__host_n") - 1, F.col(f"__host_{head}") - own)
    rate = F.least(F.lit(1 - 1e-6), F.greatest(F.lit(1e-6), _path_rate(prior, F.col("__n") - 1, F.col(f"__path_{head}") - own, host_rate)))
    return 1 / (1 + F.exp(-(odds + _odds(rate) - math.log(prior.rate / (1 - prior.rate)))))


def judged(scored: DataFrame, host: str, path: str) -> DataFrame:
    """scored, with __good and __bad, and its __p_quality, __p_toxic and __kept beside them."""
    found, priors = sites(scored, host, path)
    names = {"host": "__host", "path": "__path", "n": "__n", "good": "__path_good", "bad": "__path_bad", "host_n": "__host_n", "host_good": "__host_good", "host_bad": "__host_bad"}
    found = found.select(*(F.col(a).alias(b) for a, b in names.items()), F.col("n").alias("__rows"))
    keyed = scored.withColumns({"__host": _name(host), "__path": _name(path)})
    if found.count() <= BROADCAST_SITES:
        joined = keyed.join(F.broadcast(found.drop("__rows")), ["__host", "__path"], "left")
    else:
        joined = dealt_join(keyed, found, ["__host", "__path"], "__rows")
    made = joined.select(*scored.columns, _posterior(priors["good"], "good").alias("__p_quality"), _posterior(priors["bad"], "bad").alias("__p_toxic"))
    return made.withColumn("__kept", (F.col("__p_quality") >= 0.5) & (F.col("__p_toxic") <= 0.5))


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", host: str = "source", path: str = "lang", columns: list[str] | None = None) -> DataFrame:
    """docs, or the given ones of its columns, with p_quality, p_toxic (posteriors) and kept, which is false for poor or toxic documents.

    One row for each row of docs. A null host or path is a value like any other; a null text is an empty one and has
    the evidence of its shape. Columns that docs has of these three names are replaced. No rows give no rows.
    """
    names = {"__p_quality": "p_quality", "__p_toxic": "p_toxic", "__kept": "kept"}
    own = [c for c in columns or docs.columns if c not in names.values()]
    made = _judged(docs, labels, id_col, text_col, host, path, own)
    return made.select(*own, *[F.col(a).alias(b) for a, b in names.items()])


def _judged(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, host: str, path: str, columns: list[str]) -> DataFrame:
    """The given columns of docs with __p_quality, __p_toxic and __kept. Texts are scored once, and what that gives is written."""
    model = fit(docs, labels, id_col, text_col)
    needed = [c for c in docs.columns if c in {*columns, host, path}]
    return judged(written(_scored(docs, model, text_col, needed)), host, path)


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Documents that are kept, with the columns they came with."""
    return _judged(docs, labels, "doc_id", "text", "source", "lang", docs.columns).where("__kept").select(*docs.columns)


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents classified."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "lang", "text")
    return classified(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), columns=["doc_id", "source", "lang"])


def registered() -> Iterator[tuple]:
    yield "op5_quality_classifier", op5_quality_classifier, None
