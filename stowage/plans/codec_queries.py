"""Named queries that send sounds, images, songs and bad items through archives and arks, and the SQL they have to agree with.

Items are made of the driver's vectors and events, so that SQL can say what has to come back.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import SkippedItemsWarning
from ..functions import columns, windows
from ..functions.codecs import kaldi_obj, png, smf, wav
from ..sources import archive, kaldi
from ..sources.archive import Archive
from ..sources.ranges import parts
from .queries import _new_folder, _table, query

#: Samples a second of the sounds made of vectors.
RATE = 16


def _made(df: DataFrame, kind: str, work: Callable[[dict], bytes]) -> DataFrame:
    """df's first column beside the bytes that work makes of each row."""
    first = df.columns[0]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in parts(whole)):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([work(row) for row in batch.to_pylist()], pa.binary())], [first, "item"])

    return df.mapInArrow(run, f"{first} {kind}, item binary")


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, x): vectors as whole numbers of 16 bits; a null one is empty."""
    whole = F.transform(F.coalesce("embedding", F.array().cast("array<float>")), lambda x: F.floor(x.cast("double") * 8192).cast("int"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", whole.alias("x"))


def _pcm(row: dict) -> np.ndarray:
    return np.array(row["x"], np.int16).reshape(-1, 1)


def _sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _made(_vectors(spark, sf_dir), "long", lambda row: wav.write(_pcm(row), RATE))


_WHOLE = "list_transform(coalesce(embedding, []), lambda x: floor(x::DOUBLE * 8192)::INTEGER)"
_X = f"x AS (SELECT vec_id, {_WHOLE} AS x FROM embeddings)"
_SAMPLES = "SELECT vec_id, (unnest(x) / 32768.0)::FLOAT AS value, generate_subscripts(x, 1)::INTEGER - 1 AS pos FROM"


def _samples(found: DataFrame) -> DataFrame:
    return found.select(F.col("id").cast("long").alias("vec_id"), F.posexplode("samples").alias("pos", "value"))


@query(f"WITH {_X}, w AS (SELECT vec_id, x[(vec_id % 3) * 8 + 1 : (vec_id % 3) * 8 + 20] AS x FROM x) {_SAMPLES} w")
def wav_archive_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounds in a WAV archive, each read in a window of its own."""
    start = (F.col("vec_id") % 3).cast("double") / 2
    made = Archive(spark, _new_folder(spark), "audio", max_bin_size=20_000)
    items = _sounds(spark, sf_dir).withColumns({"start_time": start, "end_time": start + 1.25})
    made.append(items, "item", "vec_id", keep=("start_time", "end_time"), order_by="vec_id")
    return _samples(made.read(window=("start_time", "end_time")))


@query(f"WITH {_X} {_SAMPLES} x")
def flac_archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounds encoded anew as FLAC, without loss."""
    made = Archive(spark, _new_folder(spark), "audio")
    made.append(_sounds(spark, sf_dir), "item", "vec_id", target_format="flac")
    read = made.read("format = 'flac' and bit_depth = 16")
    return _samples(read)


@query(f"WITH {_X} SELECT vec_id, {RATE}::BIGINT AS sample_rate, 1::BIGINT AS channels, len(x)::BIGINT AS samples, 'wav' AS format, len(x)::DOUBLE / {RATE} AS duration FROM x")
def audio_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index says of sounds, from the items' own headers."""
    made = Archive(spark, _new_folder(spark), "audio")
    made.append(_sounds(spark, sf_dir), "item", "vec_id")
    return made.index().select(F.col("id").cast("long").alias("vec_id"), "sample_rate", "channels", "samples", "format", "duration")


@query("SELECT vec_id, vec_id % 5 = 0 AS failed, CASE WHEN vec_id % 5 > 0 THEN 'wav' END AS format FROM embeddings")
def append_skipping_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items that are no sounds, mixed with sounds: left out, named, and the others stored."""
    bad = F.when(F.col("vec_id") % 5 == 0, F.lit(b"no sound at all")).otherwise(F.col("item"))
    made = Archive(spark, _new_folder(spark), "audio")
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", SkippedItemsWarning)
        left = made.append(_sounds(spark, sf_dir).withColumn("item", bad), "item", "vec_id", skip_errors=True)
    failed = left.select(F.col("id").cast("long").alias("vec_id"), F.col("error").isNotNull().alias("failed"), F.lit(None).cast("string").alias("format"))
    return made.index().select(F.col("id").cast("long").alias("vec_id"), F.lit(False).alias("failed"), "format").unionByName(failed)


@query("SELECT doc_id, text, true AS alone, true AS joined FROM documents WHERE text IS NOT NULL")
def compacted_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item in a bin of its own, then bins joined; bytes and texts stay, and no bin is too large."""
    docs = _table(spark, sf_dir, "documents").where("text is not null")
    made = Archive(spark, _new_folder(spark), "text", max_bin_size=1)
    made.append(docs, "text", "doc_id", order_by="doc_id")
    before = made.index().groupBy("bin_index").agg(F.count("*").alias("n"), F.max("end_byte").alias("most"))
    alone, largest = before.agg(F.max("n") == 1, F.max("most")).first()
    most = max(100_000, largest)
    made.compact(most)
    after = made.index().groupBy("bin_index").agg(F.max("end_byte").alias("size"))
    bins, size = after.agg(F.count("*"), F.max("size")).first()
    joined = size <= most and bins < max(2, made.index().count())
    return made.read().select(F.col("id").cast("long").alias("doc_id"), "text", F.lit(alone).alias("alone"), F.lit(joined).alias("joined"))


_PIXELS = "list_transform(coalesce(embedding, list_resize([]::FLOAT[], 64, 0::FLOAT)), lambda x: floor(abs(x::DOUBLE) * 1000)::INTEGER % 256)"


@query(f"SELECT vec_id, 8 AS height, 8 AS width, 3 AS channels, sha256(unhex(array_to_string(list_transform({_PIXELS}, lambda b: printf('%02X%02X%02X', b, 255 - b, b // 2)), ''))) AS pixels FROM embeddings")
def png_archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Colour images in a PNG archive, pixel by pixel."""
    pixels = F.transform(F.coalesce("embedding", F.array_repeat(F.lit(0.0).cast("float"), 64)), lambda x: F.pmod(F.floor(F.abs(x.cast("double")) * 1000), F.lit(256)).cast("int"))

    def image(row: dict) -> bytes:
        grey = np.array(row["x"], np.uint8)
        return png.write(np.stack([grey, 255 - grey, grey // 2], axis=1).reshape(8, 8, 3))

    items = _made(_table(spark, sf_dir, "embeddings").select("vec_id", pixels.alias("x")), "long", image)
    made = Archive(spark, _new_folder(spark), "image")
    made.append(items, "item", "vec_id")
    return made.read("height = 8").select(F.col("id").cast("long").alias("vec_id"), "height", "width", "channels", F.sha2("data", 256).alias("pixels"))


@query(f"SELECT vec_id, 'jpeg' AS format, 9 AS height, 17 AS width, 3 AS channels, true AS near FROM embeddings")
def jpeg_archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of one colour and a slope in a JPEG archive: after decoding within a few steps of what they were."""

    def image(row: dict) -> bytes:
        return png.write(_slope(row["vec_id"]))

    def near(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [len(data) == 9 * 17 * 3 and int(np.abs(np.frombuffer(data, np.uint8).reshape(9, 17, 3).astype(int) - _slope(int(key))).max()) <= 12 for key, data in zip(batch.column("id").to_pylist(), batch.column("data").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("id", "format", "height", "width", "channels")), pa.array(ok)], ["id", "format", "height", "width", "channels", "near"])

    items = _made(_table(spark, sf_dir, "embeddings").select("vec_id"), "long", image)
    made = Archive(spark, _new_folder(spark), "image")
    made.append(items, "item", "vec_id", target_format="jpeg", quality=95)
    found = made.read(columns_=["id", "format"]).select("id", "format", "height", "width", "channels", "data")
    return found.mapInArrow(near, "id string, format string, height int, width int, channels int, near boolean").withColumn("vec_id", F.col("id").cast("long")).drop("id")


def _slope(number: int) -> np.ndarray:
    x = np.arange(17)[None, :, None] * np.array([3, -2, 1]) + np.array([number % 100 + 60, 200 - number % 90, number % 70 + 80])
    return np.broadcast_to(x, (9, 17, 3)).astype(np.uint8)


@query("""WITH s AS (SELECT vec_id, coalesce(embedding, []) AS e, (vec_id % 4) / 2.0 AS a FROM embeddings),
w AS (SELECT vec_id, e, least(floor(a * 8), len(e) // 2)::INTEGER AS first, least(floor((a + 1.75) * 8), len(e) // 2)::INTEGER AS last FROM s)
SELECT vec_id, e[2 * first + 1 : 2 * last] AS samples FROM w""")
def sound_windows_by_expression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of decoded stereo sounds, each of its own, by expressions alone."""
    start = (F.col("vec_id") % 4).cast("double") / 2
    samples = F.coalesce("embedding", F.array().cast("array<float>"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", windows.sliced_samples(samples, F.lit(2), F.lit(8), start, start + 1.75).alias("samples"))


_SONGS = "n AS (SELECT user_id, (row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1) * 0.5::DOUBLE AS a, (event_id % 128)::SMALLINT AS pitch, (1 + event_id % 127)::SMALLINT AS velocity FROM events)"


def _songs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(user_id, item): a user's events as a song, two notes a second, each of a quarter."""
    notes = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("event_id"))).alias("events"))

    def song(row: dict) -> bytes:
        own = np.zeros(len(row["events"]), smf.NOTE_DTYPE)
        ids = np.array([e["event_id"] for e in row["events"]])
        own["onset"] = np.arange(len(own)) * 0.5
        own["offset"], own["pitch"], own["velocity"] = own["onset"] + 0.25, ids % 128, 1 + ids % 127
        return smf.write(smf.song_of(own))

    return _made(notes, "long", song)


@query(f'WITH {_SONGS} SELECT user_id, round(greatest(a, 2.0) - 2.0, 6) AS onset, round(least(a + 0.25, 9.125) - 2.0, 6) AS "offset", pitch, velocity FROM n WHERE a + 0.25 > 2.0 AND a < 9.125')
def midi_archive_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs in an archive, and the notes of one window of each."""
    made = Archive(spark, _new_folder(spark), "midi")
    made.append(_songs(spark, sf_dir), "item", "user_id", compress=True)
    found = made.read(start_time=2.0, end_time=9.125).select(F.col("id").cast("long").alias("user_id"), F.explode("notes").alias("n"))
    return found.select("user_id", F.round("n.onset", 6).alias("onset"), F.round("n.offset", 6).alias("offset"), "n.pitch", "n.velocity")


@query(f"WITH {_SONGS} SELECT user_id, count(*) AS n_notes, [0]::BIGINT[] AS programs, false AS has_drums, min(pitch)::BIGINT AS min_pitch, max(pitch)::BIGINT AS max_pitch, round(max(a) + 0.25, 6) AS duration, 'mid.zst' AS format FROM n GROUP BY user_id")
def midi_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the index says of songs."""
    made = Archive(spark, _new_folder(spark), "midi")
    made.append(_songs(spark, sf_dir), "item", "user_id", compress=True)
    return made.index().select(F.col("id").cast("long").alias("user_id"), "n_notes", "programs", "has_drums", "min_pitch", "max_pitch", F.round("duration", 6).alias("duration"), "format")


@query(f"WITH {_X} SELECT vec_id, {RATE} AS rate, x AS samples FROM x WHERE len(x) > 0")
def ark_sound_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounds of 16 bits as RIFF records of arks."""
    none = F.lit(None)
    objects = _vectors(spark, sf_dir).where(F.size("x") > 0).select(F.col("vec_id").cast("string").alias("key"), F.lit("sound").alias("kind"), F.size("x").alias("rows"), F.lit(1).alias("cols"), none.cast("array<float>").alias("f32"), none.cast("array<double>").alias("f64"), F.col("x").alias("i32"), F.lit(RATE).alias("rate"), none.cast("long").alias("offset"), none.cast("string").alias("ark"))
    kaldi.register(spark)
    folder = _new_folder(spark)
    objects.write.format("kaldi_ark").mode("append").save(folder)
    return spark.read.format("kaldi_ark").load(folder).select(F.col("key").cast("long").alias("vec_id"), "rate", F.col("i32").alias("samples"))


@query(f"WITH {_X} SELECT vec_id, vec_id % 2 = 0 AS framed_flac, list_transform(x, lambda s: s / 32768.0::DOUBLE) AS samples FROM x WHERE len(x) > 0")
def ark_framed_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sounds in AUDIO frames, as WAV and as FLAC within, read as doubles."""
    framed = _made(_vectors(spark, sf_dir).where(F.size("x") > 0), "long", lambda row: kaldi_obj.write_object((RATE, _pcm(row)[:, 0]), sound="flac" if row["vec_id"] % 2 == 0 else "framed"))
    ark = framed.withColumn("key", F.col("vec_id").cast("string"))
    found = kaldi.decoded(ark.select("key", "item"), "item")
    return found.select(F.col("key").cast("long").alias("vec_id"), (F.col("key").cast("long") % 2 == 0).alias("framed_flac"), F.col("f64").alias("samples"))


_KINDS = ("664C6143", "524946460000000057415645", "1A45DFA3", "4F676753", "89504E470D0A1A0A", "FFD8FFE0", "524946460000000057454250", "474946383961", "4D546864", "28B52FFD", "00000018667479706D703432", "000000086D6F6F76", "0000")


@query(
    f"SELECT doc_id, {len(_KINDS)} AS n, CASE doc_id % 13 WHEN 0 THEN 'flac' WHEN 1 THEN 'wav' WHEN 2 THEN 'webm' WHEN 3 THEN 'ogg' WHEN 6 THEN 'wav' END AS audio, "
    "CASE doc_id % 13 WHEN 4 THEN 'png' WHEN 5 THEN 'jpeg' WHEN 6 THEN 'webp' WHEN 7 THEN 'gif' END AS image, CASE doc_id % 13 WHEN 8 THEN 'mid' WHEN 9 THEN 'mid.zst' END AS midi, "
    "CASE doc_id % 13 WHEN 2 THEN 'webm' WHEN 10 THEN 'mp4' WHEN 11 THEN 'mp4' END AS video FROM documents"
)
def magic_sniff_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The heads of all formats, by all four functions."""
    head = F.element_at(F.array(*[F.unhex(F.lit(h)) for h in _KINDS]), F.pmod("doc_id", F.lit(len(_KINDS))).cast("int") + 1)
    return _table(spark, sf_dir, "documents").select("doc_id", F.lit(len(_KINDS)).alias("n"), columns.sniff_audio(head).alias("audio"), columns.sniff_image(head).alias("image"), columns.sniff_midi(head).alias("midi"), columns.sniff_video(head).alias("video"))


@query(
    """WITH e AS (SELECT vec_id, coalesce(embedding, []) AS e FROM embeddings),
m AS (SELECT vec_id, list_transform(generate_series(1, len(e) // 2), lambda k: ((e[2 * k - 1]::DOUBLE + e[2 * k]::DOUBLE) / 2)::FLOAT) AS mono, list_max(list_transform(e, lambda x: abs(x))) AS peak, e FROM e)
SELECT vec_id, mono, CASE WHEN peak > 0 THEN list_transform(e, lambda x: (x / peak)::FLOAT) ELSE e END AS loud FROM m"""
)
def sound_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stereo as mono, and samples with the largest at 1."""
    samples = F.coalesce("embedding", F.array().cast("array<float>"))
    return _table(spark, sf_dir, "embeddings").select("vec_id", columns.to_mono(samples, F.lit(2)).alias("mono"), columns.peak_normalised(samples).alias("loud"))


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 1 OFFSET 41")
def row_by_ordinal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row at a place of an index."""
    return archive.row_at(_table(spark, sf_dir, "documents").select("doc_id", "lang"), 41, "doc_id")
