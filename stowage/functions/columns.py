"""Column expressions: formats by their first bytes, paths of bins, text transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _starts(payload: Column, hexes: str, at: int = 1) -> Column:
    return F.hex(F.substring(payload, at, len(hexes) // 2)) == hexes


def sniff_audio(payload: Column) -> Column:
    """flac, wav, webm, ogg or null."""
    return F.when(_starts(payload, "664C6143"), "flac").when(_starts(payload, "52494646"), "wav").when(_starts(payload, "1A45DFA3"), "webm").when(_starts(payload, "4F676753"), "ogg")


def sniff_image(payload: Column) -> Column:
    """png, jpeg, webp, gif or null."""
    return F.when(_starts(payload, "89504E47"), "png").when(_starts(payload, "FFD8FF"), "jpeg").when(_starts(payload, "52494646") & _starts(payload, "57454250", 9), "webp").when(_starts(payload, "47494638"), "gif")


def sniff_midi(payload: Column) -> Column:
    """mid, mid.zst or null."""
    return F.when(_starts(payload, "4D546864"), "mid").when(_starts(payload, "28B52FFD"), "mid.zst")


def sniff_video(payload: Column) -> Column:
    """mp4, webm or null."""
    return F.when(_starts(payload, "66747970", 5) | _starts(payload, "6D6F6F76", 5) | _starts(payload, "6D646174", 5), "mp4").when(_starts(payload, "1A45DFA3"), "webm")


def bin_path(base: str, bin_index: Column) -> Column:
    """Where a bin is under a folder or URL."""
    return F.concat(F.lit(base.rstrip("/") + "/blob_"), bin_index.cast("string"), F.lit(".bin"))


def hub_base(repository: str) -> str:
    """The URL that files of a Hugging Face data set repository have."""
    return f"https://huggingface.co/datasets/{repository}/resolve/main"


def length(start: str = "start_byte", end: str = "end_byte") -> Column:
    return F.col(end) - F.col(start)


def lowercase(text: Column) -> Column:
    return F.lower(text)


def single_spaces(text: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def truncated(text: Column, characters: int) -> Column:
    return F.left(text, F.lit(characters))


def to_mono(samples: Column, channels: Column) -> Column:
    """Interleaved samples as the mean of their channels."""
    frames = F.sequence(F.lit(0), (F.size(samples) / channels).cast("int") - 1)
    mean = lambda k: F.aggregate(F.slice(samples, k * channels + 1, channels), F.lit(0.0), lambda a, x: a + x) / channels
    return F.when(F.size(samples) == 0, samples).otherwise(F.transform(frames, lambda k: mean(k).cast("float")))


def peak_normalised(samples: Column) -> Column:
    """Samples with the largest at 1 in amount; silence stays."""
    peak = F.array_max(F.transform(samples, lambda x: F.abs(x)))
    return F.when(peak > 0, F.transform(samples, lambda x: (x / peak).cast("float"))).otherwise(samples)
