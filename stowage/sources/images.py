"""Image files decoded by the JVM, which reads PNG, JPEG and GIF."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_images(spark: SparkSession, path: str) -> DataFrame:
    """(path, height, width, channels, data) of the image files in a folder; data is RGB, row by row. Broken files are left out."""
    raw = spark.read.format("image").option("dropInvalid", "true").load(path)
    flat = raw.select(F.col("image.origin").alias("path"), F.col("image.height").alias("height"), F.col("image.width").alias("width"), F.col("image.nChannels").alias("channels"), F.col("image.data").alias("data"))

    def turned(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = []
            for raw_bytes, n in zip(batch.column("data").to_pylist(), batch.column("channels").to_pylist(), strict=True):
                pixels = np.frombuffer(raw_bytes, np.uint8).reshape(-1, n)
                data.append((pixels[:, [2, 1, 0, *range(3, n)]] if n >= 3 else pixels).tobytes())
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(data, pa.binary())], batch.schema.names)

    return flat.mapInArrow(turned, flat.schema)
