"""Batches of items for training: numbered, padded with zeros to the longest, or as lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def numbered(df: DataFrame, order_by: str | list[Column], to: str = "row", start: int = 0) -> DataFrame:
    """df with consecutive numbers in an order, by one column or several, without one task for all rows.

    Rows are dealt into ranges of the order. Their places within a range and the ranges' sizes, one row for each range,
    give the numbers. The order of ties is any. The ranges are a written table, so a
    task that runs again cannot deal them otherwise.
    """
    from ..sources.tables import written

    order = [F.col(order_by)] if isinstance(order_by, str) else order_by
    placed = written(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__place", F.monotonically_increasing_id()))
    part = F.shiftright("__place", 33)
    sizes = placed.groupBy(part.alias("__part")).agg(F.count("*").alias("n"))
    ahead = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__ahead"))
    return placed.join(F.broadcast(ahead), part == F.col("__part")).withColumn(to, F.lit(start) + F.col("__ahead") + F.col("__place").bitwiseAND((1 << 33) - 1)).drop("__place", "__part", "__ahead")


def in_batches(df: DataFrame, batch_size: int, order_by: str) -> DataFrame:
    """df with batch and place, both from 0."""
    return numbered(df, order_by).withColumns({"batch": F.floor(F.col("row") / batch_size).cast("long"), "place": F.pmod("row", F.lit(batch_size)).cast("int")}).drop("row")


def padded(df: DataFrame, column: str, batch: str = "batch", zero: object = 0.0) -> DataFrame:
    """df with arrays as long as the longest of their batch, and {column}_length, what they were; null arrays are empty."""
    kind = df.schema[column].dataType.simpleString()
    longest = F.max(F.coalesce(F.size(column), F.lit(0))).over(Window.partitionBy(batch))
    own = F.coalesce(F.col(column), F.array().cast(kind))
    sized = df.withColumns({f"{column}_length": F.size(own), "__most": longest})
    fill = F.array_repeat(F.lit(zero), F.col("__most") - F.size(own)).cast(kind)
    return sized.withColumn(column, F.concat(own, fill)).drop("__most")


def pad_collate(df: DataFrame, column: str, batch_size: int, order_by: str, label: str | None = None) -> DataFrame:
    """One row for each batch: batch, items (arrays padded with zeros, in order), lengths, and labels if there is a label column."""
    rows = padded(in_batches(df, batch_size, order_by), column)
    parts = ["place", column, f"{column}_length", *([label] if label else [])]
    made = rows.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("rows"))
    out = [F.col(f"rows.{column}").alias("items"), F.col(f"rows.{column}_length").alias("lengths")]
    return made.select("batch", *out, *([F.col(f"rows.{label}").alias("labels")] if label else []))


def video_collate(df: DataFrame, batch_size: int, order_by: str, data: str = "data", samples: str | None = None) -> DataFrame:
    """One row for each batch: batch, height, width, n_frames of each video, and their frames, in order.

    Frames are RGB bytes behind one another; shorter videos get black ones up to the longest of the batch, and their
    samples, if that names a column of arrays, zeros. Null frames are none. A batch of videos of several sizes fails.
    """
    rows = in_batches(df, batch_size, order_by)
    rows = padded(rows, samples) if samples else rows
    of_batch, frame = Window.partitionBy("batch"), (F.col("height") * F.col("width") * 3).cast("long")
    alike = (F.min("height").over(of_batch) == F.max("height").over(of_batch)) & (F.min("width").over(of_batch) == F.max("width").over(of_batch))
    own = F.coalesce(F.col(data), F.lit(b""))
    sized = rows.withColumns({"__n": F.floor(F.octet_length(own) / frame).cast("int"), "__ok": F.coalesce(alike, F.lit(True))})
    most = (F.max("__n").over(of_batch) * F.max(frame).over(of_batch)).cast("int")
    filled = sized.withColumn(data, F.when(F.col("__ok"), F.rpad(own, most, F.lit(b"\0"))).otherwise(F.raise_error(F.lit("videos of a batch differ in size")).cast("binary")))
    parts = ["place", data, "__n", "height", "width", *([samples, f"{samples}_length"] if samples else [])]
    made = filled.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct(*parts))).alias("rows"))
    more = [F.col(f"rows.{samples}").alias("samples"), F.col(f"rows.{samples}_length").alias("lengths")] if samples else []
    return made.select("batch", F.col("rows.height")[0].alias("height"), F.col("rows.width")[0].alias("width"), F.col("rows.__n").alias("n_frames"), F.col(f"rows.{data}").alias("frames"), *more)


def text_collate(df: DataFrame, column: str, batch_size: int, order_by: str) -> DataFrame:
    """One row for each batch: batch and texts, in order."""
    rows = in_batches(df, batch_size, order_by)
    return rows.groupBy("batch").agg(F.sort_array(F.collect_list(F.struct("place", column))).alias("rows")).select("batch", F.col(f"rows.{column}").alias("texts"))
