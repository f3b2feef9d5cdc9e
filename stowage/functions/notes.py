"""Notes as a relation: one row for each note, with DataFrame expressions only.

A notes DataFrame has onset, offset, pitch, velocity, program, is_drum and instrument, and further key columns,
such as the item's id. Windows may be numbers or columns, so each row can have its own.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import NOTE
from ..sources.ranges import parts
from .codecs import smf

ORDER = ("onset", "is_drum", "program", "pitch", "offset")
DEFAULTS = {"velocity": ("smallint", 100), "program": ("smallint", 0), "is_drum": ("boolean", False), "instrument": ("smallint", 0)}


def coerced(df: DataFrame) -> DataFrame:
    """df with all note columns of their types; onset, offset and pitch have to be there, others have defaults."""
    missing = [c for c in ("onset", "offset", "pitch") if c not in df.columns]
    if missing:
        raise ValueError(f"notes need {', '.join(missing)}")
    made = {"onset": F.col("onset").cast("double"), "offset": F.col("offset").cast("double"), "pitch": F.col("pitch").cast("smallint")}
    for name, (kind, value) in DEFAULTS.items():
        made[name] = F.coalesce(F.col(name).cast(kind), F.lit(value).cast(kind)) if name in df.columns else F.lit(value).cast(kind)
    return df.withColumns(made)


def from_items(df: DataFrame, notes: str = "notes") -> DataFrame:
    """One row for each note of items with an array of notes, beside the items' other columns."""
    return df.select(*[c for c in df.columns if c != notes], F.explode(notes).alias("__note")).select("*", "__note.*").drop("__note")


def canonical_sort(df: DataFrame, *keys: str) -> DataFrame:
    return df.orderBy(*keys, *ORDER)


def canonical_rank(df: DataFrame, *keys: str) -> DataFrame:
    """df with rank, the place of a note in its item in canonical order, from 1."""
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*ORDER)))


def _window(start: float | Column, end: float | Column) -> tuple[Column, Column]:
    if not isinstance(start, Column) and not isinstance(end, Column) and (start < 0 or end < start):
        raise ValueError(f"no such window: [{start}, {end})")
    lit = lambda x: x if isinstance(x, Column) else F.lit(float(x))
    return lit(start), lit(end)


def slice_notes(df: DataFrame, start: float | Column, end: float | Column, include_partial: bool = True) -> DataFrame:
    """Notes that sound in [start, end), cut to it, from time 0; without partial ones only those that begin in it."""
    a, b = _window(start, end)
    inside = (F.col("offset") > a) & (F.col("onset") < b)
    if not include_partial:
        inside &= F.col("onset") >= a
    cut = {"onset": F.greatest("onset", a) - a, "offset": F.least("offset", b) - a}
    return df.where(inside).withColumns(cut)


def in_windows(notes: DataFrame, windows: DataFrame, key: str, include_partial: bool = True) -> DataFrame:
    """slice_notes() for many windows (key, start, end, further columns): a join on key with overlap as a condition."""
    joined = notes.join(windows, key)
    return slice_notes(joined, F.col("start"), F.col("end"), include_partial).drop("start", "end")


def controls_in_effect(events: DataFrame, start: float | Column, end: float | Column, *keys: str, drop_zero: bool = False) -> DataFrame:
    """keys, time and value of events (keys, time, seq, value) in [start, end), from time 0, after the last one before it of each key.

    With several events at one time the one of the greatest seq holds. drop_zero leaves out carried values of 0, as
    for pitch bends, whose rest position is 0.
    """
    a, b = _window(start, end)
    before = events.where(F.col("time") < a).groupBy(*keys).agg(F.max_by("value", F.struct("time", "seq")).alias("value"))
    if drop_zero:
        before = before.where(F.col("value") != 0)
    carried = before.select(*keys, F.lit(0.0).alias("time"), F.lit(-1).cast("long").alias("seq"), "value")
    within = events.where((F.col("time") >= a) & (F.col("time") < b)).select(*keys, (F.col("time") - a).alias("time"), F.col("seq").cast("long"), "value")
    return carried.unionByName(within)


def tempo_at(tempos: DataFrame, time: float | Column, *keys: str, default: float = 120.0) -> DataFrame:
    """keys and tempo: the last of tempos (keys, time, bpm) at or before a time, or the default."""
    at = time if isinstance(time, Column) else F.lit(float(time))
    held = F.max_by(F.when(F.col("time") <= at, F.col("bpm")), F.when(F.col("time") <= at, F.col("time")))
    return tempos.groupBy(*keys).agg(F.coalesce(held, F.lit(default)).alias("tempo"))


def metadata(df: DataFrame, *keys: str) -> DataFrame:
    """Of each item: n_notes, programs of melodic notes, has_drums, min_pitch, max_pitch and duration."""
    melodic = F.when(~F.col("is_drum"), F.col("program").cast("long"))
    return df.groupBy(*keys).agg(
        F.count("*").alias("n_notes"), F.array_sort(F.collect_set(melodic)).alias("programs"), F.bool_or("is_drum").alias("has_drums"),
        F.min("pitch").cast("long").alias("min_pitch"), F.max("pitch").cast("long").alias("max_pitch"), F.max("offset").alias("duration"),
    )


def _rows(notes: pa.StructArray) -> np.ndarray:
    """Notes of a column as a structured array."""
    rows = np.zeros(len(notes), smf.NOTE_DTYPE)
    for name in smf.NOTE_DTYPE.names:
        rows[name] = notes.field(name).to_numpy(zero_copy_only=False)
    return rows


def to_midi(df: DataFrame, key: str, resolution: int = 480, tempo: float = 120.0) -> DataFrame:
    """key and midi, a standard MIDI file of each item's notes."""
    packed = df.groupBy(key).agg(F.collect_list(F.struct(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in NOTE])).alias("notes"))
    kind = packed.schema[key].dataType.simpleString()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                column = part.column("notes")
                files = [smf.write(smf.song_of(smf.canonical(_rows(column[k].values)), resolution, tempo)) for k in range(len(part))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(files, pa.binary())], [key, "midi"])

    return packed.mapInArrow(write, f"`{key}` {kind}, midi binary")
