"""Appending a stream of items to an archive.

Each micro-batch is one append with its own commit. A batch that is run again after a failure finds its ids in the
archive and leaves them out, so every item is stored once.
"""

from __future__ import annotations

import warnings

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import SkippedItemsWarning
from ..sources.archive import Archive


def append_stream(stream: DataFrame, archive: Archive, checkpoint: str, item: str = "item", id_col: str = "id", available_now: bool = False, **options) -> StreamingQuery:
    """Start a query that appends the stream's items; options are those of Archive.append()."""

    def store(batch: DataFrame, _: int) -> None:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore", SkippedItemsWarning)
            archive.append(batch.dropDuplicates([id_col]), item, id_col, **options)

    writer = stream.writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of events in tumbling windows; on a stream, events later than `late` are dropped and old windows forgotten."""
    timed = events.withWatermark(time, late) if events.isStreaming else events
    made = timed.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n_events"))
    return made.select(F.col("w.start").alias("window_start"), key, "n_events")
