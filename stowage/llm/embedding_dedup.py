"""Embedding near-dedup by cross-polytope hashing.

Vectors are turned by fast Hadamard transforms with random signs; a hash is the axis, with its sign, that the
turned vector is nearest to, and a code joins the hashes of a table. A vector goes to the bucket of its code
and, by multiprobe, to those of the codes that were nearly as near. Pairs that meet are verified in double
precision. Equal vectors are one node with a weight, buckets above a bound are dealt into blocks, and a pair
that meets several times is counted where it meets first, so no list of pairs is ever made.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, in_blocks, forest, smallest_ids, whole_ids, whole_runs, written

COSINE = 0.95
#: For each number of hashes of a code: tables in 64 dimensions, tables more for each doubling of these, and codes
#: probed in each table. At cosine 0.95 a pair then fails to meet in all tables for about one to four pairs in a million.
LAYOUTS = {2: (8, 1, 4), 3: (11, 2, 8), 4: (18, 4, 8)}
SEED = 11
#: Rows of a bucket that are compared as one unit; two blocks of a larger bucket are twice as many. With more rows
#: than fill the buckets of two hashes so far, codes have three or four hashes.
BLOCK = 2048
#: Bits of a bucket's number that are its code.
CODE_BITS = 40


def layout(rows: int, dimensions: int) -> tuple[int, int, int]:
    """(tables, hashes, probes) for so many rows."""
    size = max(2, 1 << (dimensions - 1).bit_length())
    doublings = max(0, size.bit_length() - 7)
    for hashes, (tables, more, probes) in LAYOUTS.items():
        if rows * probes <= BLOCK * (2 * size) ** hashes or hashes + 1 not in LAYOUTS or (2 * size) ** (hashes + 1) > 1 << CODE_BITS:
            return tables + more * doublings, hashes, probes
    raise AssertionError


def hadamard(x: np.ndarray) -> np.ndarray:
    """The Hadamard transform of each row, not scaled; their length is a power of two."""
    n, half = x.shape[1], 1
    while half < n:
        y = x.reshape(len(x), -1, 2, half)
        z = np.empty_like(y)
        np.add(y[:, :, 0], y[:, :, 1], out=z[:, :, 0])
        np.subtract(y[:, :, 0], y[:, :, 1], out=z[:, :, 1])
        x = z.reshape(len(x), n)
        half *= 2
    return x


def codes_of(x: np.ndarray, tables: int, hashes: int, probes: int, seed: int = SEED) -> np.ndarray:
    """Codes of each row: (rows, tables, probes), the nearest first. Single precision is enough to find candidates."""
    rows, n = x.shape
    size = max(2, 1 << (n - 1).bit_length())
    padded = np.zeros((rows, size), np.float32)
    padded[:, :n] = x / np.abs(x).max(axis=1, keepdims=True)
    rng = np.random.default_rng([seed, size])
    each, every = min(probes, size), np.arange(rows)
    made = np.zeros((rows, tables, probes), np.int64)
    for t in range(tables):
        codes = np.zeros((rows, 1), np.int64)
        cost = np.zeros((rows, 1), np.float32)
        for _ in range(hashes):
            turned = padded
            for sign in rng.choice(np.array([-1, 1], np.float32), size=(3, size)):
                turned = hadamard(turned * sign)
            turned = turned / np.float32(size**1.5)
            left = np.abs(turned)
            best, value = np.empty((rows, each), np.int64), np.empty((rows, each), np.float32)
            for k in range(each):
                best[:, k] = left.argmax(axis=1)
                value[:, k] = left[every, best[:, k]]
                left[every, best[:, k]] = -1
            axis = best * 2 + (np.take_along_axis(turned, best, 1) < 0)
            behind = (value[:, :1] - value) ** 2
            codes = (codes[:, :, None] * (2 * size) + axis[:, None, :]).reshape(rows, -1)
            cost = (cost[:, :, None] + behind[:, None, :]).reshape(rows, -1)
            order = np.argsort(cost, axis=1, kind="stable")[:, :probes]
            codes, cost = np.take_along_axis(codes, order, 1), np.take_along_axis(cost, order, 1)
        made[:, t, : codes.shape[1]] = codes
        made[:, t, codes.shape[1] :] = codes[:, :1]
    return made


def _blobs(x: np.ndarray) -> pa.Array:
    """The bytes of each row."""
    edges = np.arange(len(x) + 1, dtype=np.int32) * (x.shape[1] * x.itemsize)
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(edges), pa.py_buffer(np.ascontiguousarray(x))])


def _bytes(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column as one array, and where in it each row begins."""
    whole = column.combine_chunks()
    whole = whole.chunk(0) if isinstance(whole, pa.ChunkedArray) else whole
    edges = np.frombuffer(whole.buffers()[1], np.int32)[whole.offset : whole.offset + len(whole) + 1].astype(np.int64)
    return np.frombuffer(whole.buffers()[2], np.uint8), edges


def _code_kind(hashes: int, dimensions: int) -> str:
    codes = (2 * max(2, 1 << (dimensions - 1).bit_length())) ** hashes
    return "<u2" if codes <= 1 << 16 else "<u4" if codes <= 1 << 32 else "<i8"


def _coded(batches: Iterable[pa.RecordBatch], rows: int) -> Iterator[pa.RecordBatch]:
    """The vectors' bytes, their codes' bytes, and the bucket of each code, null for one that repeats the first."""
    for batch in batches:
        vectors = batch.column("vector")
        edges, values = vectors.offsets.to_numpy(), vectors.values.to_numpy()
        sizes = np.diff(edges)
        for n in np.unique(sizes).tolist():
            own = np.flatnonzero(sizes == n)
            x = values[edges[own][:, None] + np.arange(n)]
            tables, hashes, probes = layout(rows, n)
            codes = codes_of(x, tables, hashes, probes)
            buckets = codes + (np.int64(n * 64) + np.arange(tables)[None, :, None] << CODE_BITS)
            again = codes == codes[:, :, :1]
            again[:, :, 0] = False
            flat = pa.array(buckets.ravel(), mask=again.ravel())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1, dtype=np.int32) * (tables * probes)), flat)
            part = batch.take(pa.array(own))
            yield pa.RecordBatch.from_arrays([part.column("node"), part.column("n"), _blobs(x), _blobs(codes.reshape(len(own), -1).astype(_code_kind(hashes, n))), lists], ["node", "n", "vector", "codes", "buckets"])


def _met(probes: np.ndarray, a: np.ndarray, b: np.ndarray, table: int, code: int) -> np.ndarray:
    """Which of the linked pairs (a, b) that meet in this bucket don't meet in an earlier one."""
    first = probes[:, :, 0]
    new = np.ones(len(a), bool)
    for t in range(table + 1):
        at_a = (probes[b, t] == first[a, t, None]).any(1)
        at_b = (probes[a, t] == first[b, t, None]).any(1)
        if t < table:
            new &= ~(at_a | at_b)
        else:
            new &= ~((at_a & (first[a, t] < code)) | (at_b & (first[b, t] < code)))
    return new


def _unit(x: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision."""
    x = x.astype(np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither vanish nor overflow
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    return x


def _links(batches: Iterable[pa.RecordBatch], cosine: float, rows: int, kind: str) -> Iterator[pa.RecordBatch]:
    """(u, v, n): for u a number n of linked vectors, v being null, or a link of a spanning forest, n being null."""
    for table, starts in whole_runs(batches, ("bucket", "block_i", "block_j"), 8192):
        node, weight, place, block, bi, bj, bucket = (table.column(c).to_numpy() for c in ("node", "n", "place", "block", "block_i", "block_j", "bucket"))
        (vectors, edges), (codes, code_edges) = _bytes(table.column("vector")), _bytes(table.column("codes"))
        linked, totals, us, vs = [], [], [], []
        ends = np.append(starts[1:], len(node))
        kinds = bucket[starts] >> CODE_BITS + 6
        layouts = {int(n): (layout(rows, int(n)), _code_kind(layout(rows, int(n))[1], int(n))) for n in np.unique(kinds)}
        probed = np.repeat([layouts[int(n)][0][2] for n in kinds], ends - starts)
        head = place % probed == 0
        useful = (ends - starts > 1) & (np.add.reduceat(head.astype(np.int64), starts) > 0)
        alike = len(layouts) == 1
        whole = _unit(vectors[edges[0] : edges[-1]].view(kind).reshape(len(node), -1)) if alike else None
        for begin, end in zip(starts[useful].tolist(), ends[useful].tolist(), strict=True):
            which, code = int(bucket[begin]) >> CODE_BITS, int(bucket[begin]) & (1 << CODE_BITS) - 1
            (tables, _, probes), code_kind = layouts[which // 64]
            heads, found = head[begin:end], []
            x = whole[begin:end] if alike else _unit(vectors[edges[begin] : edges[end]].view(kind).reshape(end - begin, -1))
            unit = codes[code_edges[begin] : code_edges[end]].view(code_kind).reshape(end - begin, tables, probes)
            own, many = block[begin:end], bi[begin] != bj[begin]
            for at in range(0, end - begin, 1024):
                close = x[at : at + 1024] @ x.T >= cosine
                p, q = np.divmod(np.flatnonzero(close), end - begin)
                p += at
                new = (p < q) & (heads[p] | heads[q])
                found.append(np.column_stack([p[new], q[new]]))
            pairs = np.concatenate(found)
            if many:  # pairs within a block are looked at where it meets its first other block
                own_unit = (own[pairs[:, 0]] != own[pairs[:, 1]]) | (np.where(own[pairs[:, 0]] == 0, 1, 0) == np.where(own[pairs[:, 0]] == bi[begin], bj[begin], bi[begin]))
                pairs = pairs[own_unit]
            if not len(pairs):
                continue
            label = forest(end - begin, pairs[:, 0], pairs[:, 1])
            far = np.flatnonzero(label != np.arange(end - begin))
            us.append(node[begin:end][far])
            vs.append(node[begin:end][label[far]])
            total = np.zeros(end - begin, np.int64)
            for at in range(0, len(pairs), 1 << 18):
                a, b = pairs[at : at + (1 << 18)].T
                new = _met(unit, a, b, which % 64, code)
                total += np.bincount(a[new], weight[begin:end][b[new]], end - begin).astype(np.int64)
                total += np.bincount(b[new], weight[begin:end][a[new]], end - begin).astype(np.int64)
            some = np.flatnonzero(total)
            linked.append(node[begin:end][some])
            totals.append(total[some])
        counted, at = np.unique(np.concatenate(linked) if linked else np.zeros(0, np.int64), return_inverse=True)
        sums = np.zeros(len(counted), np.int64)
        if linked:
            np.add.at(sums, at, np.concatenate(totals))
        u, v = (np.concatenate(z) if z else np.zeros(0, np.int64) for z in (us, vs))
        none = pa.nulls
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64()), none(len(u), pa.int64())], ["u", "v", "n"])
        yield pa.RecordBatch.from_arrays([pa.array(counted), none(len(counted), pa.int64()), pa.array(sums)], ["u", "v", "n"])


def near_duplicates(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = COSINE, expected: int | None = None) -> DataFrame:
    """id_col, n_links (other vectors linked directly), component_id (smallest id reachable) and kept, one row for each row of df.

    Vectors are linked if their cosine, in double precision, is at least `cosine`; only vectors of one length are
    compared. Null, empty and zero vectors, and those with null or non-finite components, are linked with nothing: no
    links, their own id as component. Rows of equal vectors are linked with each other, rows of equal ids too, and
    rows of one id with different vectors are different vectors. Rows of null id are linked with nothing. Ids are
    integers. Labels and other columns are not looked at; no rows give no rows. The tables are laid out for as many
    different vectors as there are, or as are expected.
    """
    id_kind = whole_ids(df, id_col)
    rows = df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    fine = F.col("id").isNotNull() & F.coalesce(~F.exists("vector", bad) & F.exists("vector", lambda x: x != 0), F.lit(False))
    rows = rows.withColumn("vector", F.when(fine, F.col("vector")))
    kind = "<f4" if rows.schema["vector"].dataType.elementType.simpleString() == "float" else "<f8"
    if kind == "<f8":
        rows = rows.withColumn("vector", F.col("vector").cast("array<double>"))
    # goes before the vector where rows are sorted, as whole numbers compare faster, and spreads rows without a vector
    rows = rows.withColumn("hash", F.xxhash64(F.when(F.col("vector").isNull(), F.col("id")), "vector"))
    distinct = written(rows.where("vector is not null").groupBy("hash", "vector").agg(F.min("id").alias("least"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()))
    total = distinct.count() if expected is None else expected
    nodes = written(distinct.select("node", "n", "vector").mapInArrow(lambda b: _coded(b, total), "node long, n long, vector binary, codes binary, buckets array<long>"))
    spread = nodes.select("node", "n", "vector", "codes", F.posexplode("buckets").alias("place", "bucket")).where("bucket is not null")
    units = in_blocks(spread, "bucket", "node", BLOCK)
    keys = ["bucket", "block_i", "block_j"]
    dealt = units.repartition(*keys).sortWithinPartitions(*keys)
    found = written(dealt.mapInArrow(lambda batches: _links(batches, cosine, total, kind), "u long, v long, n long"))
    counts = found.where("n is not null").groupBy(F.col("u").alias("node")).agg(F.sum("n").alias("links"))
    groups = smallest_ids(distinct.select("node", "least"), found.where("n is null").select("u", "v"))
    known = distinct.select("node", "n", "hash", "vector").join(groups, "node").join(counts, "node", "left")
    known = known.select("hash", "vector", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.col("component").alias("component_id"), F.col("n").alias("rows"))
    made = dealt_join(rows, known, ["hash", "vector"], "rows")
    component = F.coalesce("component_id", "id").cast(id_kind)
    return made.select(F.col("id").cast(id_kind).alias(id_col), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), (F.col("id") == component).alias("kept"))


def op2_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and components of all embeddings."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


#: Brute force over all pairs, for the small tables the SQL is run on.
OP2_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT vec_id, embedding::DOUBLE[] AS e,
    embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS fine FROM embeddings),
unit AS (SELECT vec_id, list_transform(e, lambda x: x / sqrt(list_dot_product(e, e))) AS e FROM rows WHERE fine),
links AS (SELECT a.vec_id AS u, b.vec_id AS v FROM unit a, unit b WHERE a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_dot_product(a.e, b.e) >= {COSINE}),
reach AS (SELECT vec_id AS u, vec_id AS v FROM rows UNION SELECT r.u, l.v FROM reach r JOIN links l ON r.v = l.u),
least AS (SELECT u, min(v) AS c FROM reach GROUP BY u),
counted AS (SELECT u, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM rows JOIN least ON vec_id = least.u LEFT JOIN counted ON vec_id = counted.u
"""


def registered() -> Iterator[tuple]:
    yield "op2_embedding_dedup", op2_embedding_dedup, OP2_SQL
