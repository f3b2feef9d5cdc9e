"""Windows of sounds in samples, for codecs and as expressions: times become samples by cutting."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pcm_window(start: float | None, end: float | None, rate: int, frames: int) -> tuple[int, int]:
    """[first, last) samples; a start before the beginning is the beginning, and an end before the start gives nothing."""
    first = min(max(0, int((start or 0.0) * rate)), frames)
    last = frames if end is None else min(max(first, int(end * rate)), frames)
    return first, last


def sliced_samples(samples: Column, channels: Column, rate: Column, start: Column, end: Column) -> Column:
    """pcm_window() on interleaved samples, as an expression; a null end is the sound's own."""
    frames = F.size(samples) / channels
    first = F.least(F.greatest(F.lit(0), (F.coalesce(start, F.lit(0.0)) * rate).cast("int")), frames.cast("int"))
    last = F.when(end.isNull(), frames.cast("int")).otherwise(F.least(F.greatest(first, (end * rate).cast("int")), frames.cast("int")))
    return F.slice(samples, first * channels + 1, (last - first) * channels)
