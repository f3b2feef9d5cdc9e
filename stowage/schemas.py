"""Declared schemas of archive indexes and decoded items."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, BooleanType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructField, StructType

MODALITIES = ("audio", "text", "video", "image", "midi")


def _struct(spec: str) -> StructType:
    kinds = {"s": StringType(), "l": LongType(), "d": DoubleType(), "b": BooleanType(), "L": ArrayType(LongType())}
    return StructType([StructField(name, kinds[kind]) for name, kind in (x.split(":") for x in spec.split())])


#: Where an item is: bytes [start_byte, end_byte) of a bin.
CORE = _struct("id:s start_byte:l end_byte:l bin_index:l path:s")

#: What the index has of each modality beside that. Frames per second are always doubles, counts always longs.
META = {
    "audio": _struct("sample_rate:l channels:l samples:l format:s bit_depth:l duration:d"),
    "text": _struct("original_path:s original_size:l compressed_size:l"),
    "image": _struct("format:s height:l width:l channels:l"),
    "video": _struct("fps:d height:l width:l sample_rate:l format:s video_codec:s audio_codec:s gop_size:l"),
    "midi": _struct("duration:d n_notes:l n_instruments:l programs:L has_drums:b resolution:l min_pitch:l max_pitch:l original_size:l stored_size:l format:s"),
}

NOTE = StructType([StructField("onset", DoubleType()), StructField("offset", DoubleType()), StructField("pitch", ShortType()), StructField("velocity", ShortType()), StructField("program", ShortType()), StructField("is_drum", BooleanType()), StructField("instrument", ShortType())])

#: Decoded items. Audio samples are interleaved; images are RGB, row by row.
DECODED = {
    "text": StructType([StructField("text", StringType())]),
    "audio": StructType([StructField("file_type", StringType()), StructField("sample_rate", IntegerType()), StructField("frames", LongType()), StructField("channels", IntegerType()), StructField("samples", ArrayType(FloatType()))]),
    "image": StructType([StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("channels", IntegerType()), StructField("data", BinaryType())]),
    "midi": StructType([StructField("duration", DoubleType()), StructField("resolution", IntegerType()), StructField("notes", ArrayType(NOTE)), StructField("smf", BinaryType()), StructField("sample_rate", IntegerType()), StructField("channels", IntegerType()), StructField("samples", ArrayType(FloatType()))]),
    "video": StructType([StructField("file_type", StringType()), StructField("fps", DoubleType()), StructField("n_frames", IntegerType()), StructField("height", IntegerType()), StructField("width", IntegerType()), StructField("data", BinaryType())]),
}

#: Any Kaldi object: kind is matrix, vector, ints or sound, and one of the arms has its values, row by row.
KALDI = StructType(
    [StructField("kind", StringType()), StructField("rows", IntegerType()), StructField("cols", IntegerType()), StructField("f32", ArrayType(FloatType())), StructField("f64", ArrayType(DoubleType())), StructField("i32", ArrayType(IntegerType())), StructField("rate", IntegerType())]
)


def check_modality(modality: str) -> str:
    if modality not in MODALITIES:
        raise ValueError(f"modality must be one of {', '.join(MODALITIES)}, not {modality!r}")
    return modality


def index_schema(modality: str) -> StructType:
    return StructType(CORE.fields + META[check_modality(modality)].fields)


def normalised(df: DataFrame, modality: str) -> DataFrame:
    """df with the columns of the modality's index, missing ones null and all of their declared types, then its own further ones."""
    schema = index_schema(modality)
    named = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*named, *[c for c in df.columns if c not in schema.names])
