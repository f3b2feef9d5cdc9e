"""Greedy packing of items into bins of a bounded size, and the offsets that follow from it."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType, VariantType

from .batching import numbered

MAX_BIN_SIZE = 335_544_320


def fold(sizes: Iterable[int], most: int, state: tuple[int, int] = (0, 0)) -> Iterator[tuple[int, int, int]]:
    """(bin, start, end) of each item: a new bin where an item would make a bin that has something exceed `most`."""
    place, filled = state
    for n in sizes:
        if filled and filled + n > most:
            place, filled = place + 1, 0
        yield place, filled, filled + n
        filled += n


def packed(df: DataFrame, size: str, order_by: str, most: int = MAX_BIN_SIZE) -> DataFrame:
    """df with bin_index, start_byte and end_byte, packed in one order from the first item to the last.

    Items of equal order are packed by size and then by their other columns; those of null order come first, and a
    null size is 0. The fold is sequential, so it is one task over the rows; the archive's own writer packs each
    partition by itself instead. To keep that task small only the sizes go through it: each partition of the sorted
    rows is one run of them, and is joined with its places by the number of its rows.
    """
    others = [c for c in df.columns if c not in (order_by, size) and not isinstance(df.schema[c].dataType, (MapType, VariantType))]
    ordered = numbered(df, [F.col(order_by), F.col(size), *map(F.col, others)], "__row")
    plan = ordered.select("__row", F.coalesce(F.col(size), F.lit(0)).cast("long").alias("__size"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = (0, 0)
        for batch in batches:
            rows = list(fold(batch.column(1).to_pylist(), most, state))
            if rows:
                state = (rows[-1][0], rows[-1][2])
            made = np.array(rows, np.int64).reshape(-1, 3)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(made[:, k]) for k in range(3))], ["__row", "bin_index", "start_byte", "end_byte"])

    placed = plan.coalesce(1).sortWithinPartitions("__row").mapInArrow(run, "__row long, bin_index long, start_byte long, end_byte long")
    return ordered.join(placed, "__row").drop("__row")


def compaction(bins: list[tuple[int, int]], most: int) -> list[tuple[int, int, int]]:
    """(old bin, new bin, offset in it) for bins (number, size): whole bins behind one another while they fit."""
    return [(number, new, start) for (number, _), (new, start, _) in zip(bins, fold((n for _, n in bins), most), strict=True)]


def running_base(size: Column, *order: str, partition: tuple[str, ...] = ()) -> Column:
    """Where each of several pieces begins if they stand behind one another."""
    return F.coalesce(F.sum(size).over(Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
