"""Intermediate tables in the session's checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir; a temporary folder only for a session in one JVM that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named
    chosen = spark.sparkContext._jsc.sc().getCheckpointDir()
    if chosen.isDefined():
        return chosen.get()
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="stowage-"))
    return spark.sparkContext._jsc.sc().getCheckpointDir().get()


def local_folder(spark: SparkSession) -> str:
    """The same as a path."""
    return folder(spark).removeprefix("file://").removeprefix("file:").rstrip("/")


#: Bytes of the tables read for each range of rows.
RANGE = 64 << 20


def in_ranges(df: DataFrame, order_by: str) -> DataFrame:
    """df dealt into ranges of an order: as many as the session shuffles into, or more if the tables it reads are large."""
    asked = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size())]
    wanted = min(sum(n for n in sizes if n < 1 << 62) // RANGE, 10_000)  # a leaf of unknown size says the largest number
    return df.repartitionByRange(wanted, order_by) if wanted > asked else df.repartitionByRange(order_by)


def written(df: DataFrame) -> DataFrame:
    """df as a Parquet table there, read again."""
    path = f"{folder(df.sparkSession).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
