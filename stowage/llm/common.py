"""Pieces that several operators share: scratch tables, connected components, blocks of hot buckets."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


#: A list of hot buckets of up to so many rows, 16 bytes each, is broadcast; a longer one is joined.
BROADCAST_ROWS = 200_000
#: Links up to so many, 16 bytes each, are followed in one task; more of them in rounds.
LOCAL_LINKS = 1 << 20
#: A key with more than one in so many of all rows is dealt to several tasks.
HOT = 1000


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: spark.checkpoint.dir, or the checkpoint folder already set.

    Only where neither is set and the session is a single local JVM, a temporary folder is made and set.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    context = spark.sparkContext
    chosen = context._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    if not context.master.startswith("local[") and context.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="stowage-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table in the scratch folder: its lineage ends there and a lost executor loses nothing.

    The table is deleted when the application ends, as results may read it until then.
    """
    path = f"{scratch_dir(df.sparkSession).rstrip('/')}/stowage-{uuid.uuid4().hex}"
    place = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Delete the scratch table that written() returned, once nothing reads it any more."""
    jvm = df.sparkSession.sparkContext._jvm
    conf = df.sparkSession.sparkContext._jsc.hadoopConfiguration()
    for folder in {name.rpartition("/")[0] for name in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(folder)
        if path.getName().startswith("stowage-"):
            path.getFileSystem(conf).delete(path, True)


def bytes_of(df: DataFrame, *columns: str) -> int:
    """Bytes in the given string or binary columns, counted over all rows; what a broadcast is checked by."""
    size = sum((F.coalesce(F.octet_length(F.col(c)), F.lit(0)).cast("long") for c in columns), F.lit(16).cast("long"))
    return df.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of edges (u long, v long); component is the smallest node reachable.

    Alternating large-star and small-star rounds; each is a grouped minimum and a join on the node, a node of very
    many links being dealt to several tasks, so no component is ever gathered in one. Every round is a table in the
    scratch folder. A number of links that is small whatever they link is followed in one task instead. Loops,
    repeated and reversed edges are allowed; nulls are dropped; no edges give no rows.
    """
    pairs = edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
    now = written(pairs)
    if now.count() <= LOCAL_LINKS:
        return now.coalesce(1).mapInArrow(_followed, "node long, component long")
    least_of = lambda df, m: df.groupBy("u").agg(m.alias("m"), F.count("*").alias("n"))
    sign = lambda df: tuple(df.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())
    before = sign(now)
    while True:
        both = now.select("u", "v").unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = written(dealt_join(both, written(least_of(both, F.least(F.min("v"), F.first("u")))), ["u"], "n").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        small = dealt_join(large, written(least_of(large, F.min("v"))), ["u"], "n").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        after = written(small.distinct())
        dropped(now)
        dropped(large)
        now, sign_now = after, sign(after)
        if sign_now == before:
            break
        before = sign_now
    roots = now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)


def _followed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    links = [np.concatenate([b.column(k).to_numpy() for b in batch]) for batch in [list(batches)] for k in (0, 1) if batch]
    if links and len(links[0]):
        nodes, places = np.unique(np.concatenate(links), return_inverse=True)
        label = forest(len(nodes), *np.split(places, 2))
        for at in range(0, len(nodes), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(nodes[at : at + (1 << 16)]), pa.array(nodes[label[at : at + (1 << 16)]])], ["node", "component"])


def smallest_ids(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(node, component) for each of nodes (node long, least long): the smallest `least` of all nodes that links (u, v) lead to."""
    groups = connected_components(links)
    least = groups.join(nodes, "node").groupBy("component").agg(F.min("least").alias("__of"), F.count("*").alias("__size"))
    found = dealt_join(groups, written(least), ["component"], "__size").select("node", "__of")
    return nodes.join(found, "node", "left").select("node", F.coalesce("__of", "least").alias("component"))


def whole_ids(df: DataFrame, id_col: str) -> str:
    """The type of an id column; others than integers are refused, as the smallest of a group is looked for."""
    kind = df.schema[id_col].dataType.simpleString()
    if kind not in ("tinyint", "smallint", "int", "bigint"):
        raise ValueError(f"{id_col} has to be of integers, not {kind}")
    return kind


def in_blocks(df: DataFrame, bucket: str, key: str, rows: int) -> DataFrame:
    """df with columns block, block_i and block_j, each row once for every pair of blocks that its block is in.

    A bucket of at most `rows` rows is one block, (0, 0). A larger one is dealt by a hash of `key` into
    blocks of about `rows` rows and every pair of blocks is a unit of its own, so that any two rows of the
    bucket meet in some unit and no unit grows with the bucket.
    """
    hot = written(df.groupBy(bucket).agg(F.count("*").alias("__n")).where(F.col("__n") > rows))
    many = hot.count()
    if not many:
        return df.withColumns({name: F.lit(0) for name in ("block", "block_i", "block_j")})
    hot = F.broadcast(hot) if many <= BROADCAST_ROWS else hot
    blocks = F.ceil(F.coalesce("__n", F.lit(1)) / F.lit(rows)).cast("int")
    dealt = df.join(hot, bucket, "left").withColumn("__blocks", blocks).withColumn("__own", F.pmod(F.xxhash64(F.col(key), F.lit("block")), F.col("__blocks")).cast("int"))
    others = F.when(F.col("__blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("__blocks") - 1), lambda x: x != F.col("__own")))
    spread = dealt.withColumn("__other", F.explode(others))
    return spread.withColumns({"block_i": F.least("__own", "__other"), "block_j": F.greatest("__own", "__other")}).withColumnRenamed("__own", "block").drop("__n", "__blocks", "__other")


def dealt_join(df: DataFrame, small: DataFrame, keys: list[str], rows: str) -> DataFrame:
    """df with the other columns of small, which has one row for each value of keys (no nulls) and in `rows` how many df has.

    Rows of a key with over a HOT-th of all are dealt by a random number and its row of small is repeated, so no
    key is one task's. There are fewer than HOT such keys, so their list is broadcast.
    """
    total = small.agg(F.coalesce(F.sum(rows), F.lit(0))).first()[0]
    hot = written(small.where(F.col(rows) * HOT > total).select(*keys, F.ceil(F.col(rows) * HOT / F.lit(max(1, total))).cast("int").alias("__hot_turns")))
    if not hot.head(1):
        return df.join(small.drop(rows), keys, "left")
    own = df.join(F.broadcast(hot), keys, "left").withColumn("__hot_turn", F.coalesce(F.floor(F.rand(7) * F.col("__hot_turns")).cast("int"), F.lit(0))).drop("__hot_turns")
    turns = F.explode(F.sequence(F.lit(0), F.coalesce("__hot_turns", F.lit(1)) - 1))
    other = small.drop(rows).join(F.broadcast(hot), keys, "left").withColumn("__hot_turn", turns).drop("__hot_turns")
    return own.join(other, [*keys, "__hot_turn"], "left").drop("__hot_turn")


def whole_runs(batches: Iterable[pa.RecordBatch], keys: tuple[str, ...], most: int = 65536) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """From sorted batches: tables of whole runs of equal (never null, integer) keys, and where each run starts.

    A table has about `most` rows, more only if a single run has.
    """
    kept: list[pa.Table] = []
    rows = 0

    def cut(table: pa.Table) -> np.ndarray:
        new = np.zeros(len(table), bool)
        new[:1] = True
        for k in keys:
            column = table.column(k).to_numpy()
            new[1:] |= column[1:] != column[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not len(batch):
            continue
        kept.append(pa.Table.from_batches([batch]))
        rows += len(batch)
        if rows < most:
            continue
        table = pa.concat_tables(kept)
        starts = cut(table)
        if len(starts) > 1:
            end = int(starts[-1])
            yield table.slice(0, end), starts[:-1]
            table = table.slice(end)
        kept, rows = [table], len(table)
        most = max(most, 2 * rows)
    if rows:
        table = pa.concat_tables(kept)
        yield table, cut(table)


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the smallest node that the links (a[k], b[k]) lead to."""
    label = np.arange(n)
    while len(a):
        x, y = label[a], label[b]
        apart = x != y
        a, b, x, y = a[apart], b[apart], x[apart], y[apart]
        np.minimum.at(label, np.maximum(x, y), np.minimum(x, y))
        while (label[label] != label).any():
            label = label[label]
    return label


def text_within(df: DataFrame, text: str, keep: Iterable[str]) -> str:
    """The column that Python reads texts from: the kept one itself, so that it is sent once, or __bytes, to be made of it."""
    return text if text in keep and df.schema[text].dataType.simpleString() in ("string", "binary") else "__bytes"


def per_text(work: Callable[[list[bytes | None]], dict[str, list]], schema: pa.Schema, ids: list[str], text: str, rows: int = 512):
    """A function for mapInArrow: work() on the UTF-8 bytes of some texts at a time, beside the id columns."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), rows):
                part = batch.slice(at, rows)
                made = work(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([part.column(c) for c in ids] + [pa.array(made[f.name], f.type) for f in list(schema)[len(ids):]], schema=schema)

    return run
