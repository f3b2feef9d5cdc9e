"""Named queries that go through files: HTTP ranges, Kaldi files by names and specifiers, broken objects, indexes; and their SQL."""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import closing

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ReadError
from ..functions import notes, specifier
from ..functions.codecs import kaldi_obj
from ..operators.batching import video_collate
from ..sources import archive, kaldi, kaldi_files, tables
from ..sources.archive import Archive
from ..sources.ranges import Connections, decode, fetch
from ..sources.server import served
from .codec_queries import _SONGS, _WHOLE, RATE, _made, _sounds, _vectors, _X
from .queries import _documents_archive, _new_folder, _table, query


def _by_rows(df: DataFrame, schema: str, work: Callable[[list[dict]], list[tuple]]) -> DataFrame:
    """What work makes of the rows of each batch, as rows of the schema's columns."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = work(batch.to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*made, strict=True), arrow, strict=True)], schema=arrow) if made else pa.RecordBatch.from_pylist([], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    arrow = to_arrow_schema(StructType.fromDDL(schema))
    return df.mapInArrow(run, schema)


def _objects(df: DataFrame, kind: str, rate: int | None = None) -> DataFrame:
    """Kaldi objects of whole numbers: df has vec_id and x."""
    none = F.lit(None)
    cols = F.lit(1 if kind == "sound" else None).cast("int")
    return df.select(F.col("vec_id").cast("string").alias("key"), F.lit(kind).alias("kind"), F.size("x").alias("rows"), cols.alias("cols"), none.cast("array<float>").alias("f32"), none.cast("array<double>").alias("f64"), F.col("x").alias("i32"), F.lit(rate).cast("int").alias("rate"), none.cast("long").alias("offset"), none.cast("string").alias("ark"))


# -- HTTP


def _host(spark: SparkSession) -> str:
    """The driver's host, at which executors find a server of its own."""
    return spark.sparkContext.getConf().get("spark.driver.host", "127.0.0.1")


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL AND lang = 'en'")
def http_archive_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An archive behind a server: its index by URL, filtered, and the ranges of what is left."""
    made = _documents_archive(spark, sf_dir)
    made.export_index(f"{made.path}/served.parquet")
    with served(made.path, _host(spark)) as url:
        index = archive.remote_index(spark, f"{url}/served.parquet", url).where("lang = 'en'")
        return tables.written(decode(fetch(index), "text").select(F.col("id").cast("long").alias("doc_id"), "text"))


@query(
    """SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 206 WHEN 1 THEN 206 WHEN 2 THEN 416 WHEN 3 THEN 200 WHEN 4 THEN 400 ELSE 404 END AS status,
CASE doc_id % 6 WHEN 0 THEN least(10, 1000 - doc_id % 1000) WHEN 1 THEN doc_id % 50 + 1 WHEN 3 THEN 1000 ELSE 0 END::BIGINT AS n_bytes FROM documents"""
)
def range_server_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a server of ranges answers to good and bad requests; each task asks one of its own, as one for all would be asked by all tasks at once."""
    folder = _new_folder(spark)
    os.makedirs(folder)
    with open(f"{folder}/file.bin", "wb") as file:
        file.write(bytes(range(250)) * 4)

    def ask(web: Connections, url: str, n: int) -> tuple[int, int, int]:
        first = n % 1000
        asked = [f"bytes={first}-{first + 9}", f"bytes=-{n % 50 + 1}", "bytes=2000-2010", None, "bytes=x", "bytes=0-5"][n % 6]
        reply = web.ask(f"{url}/{'none' if n % 6 == 5 else 'file'}.bin", {"Range": asked} if asked else {})
        return n, reply.status, len(reply.read())

    def answers(rows: list[dict]) -> list[tuple]:
        with served(folder) as url, closing(Connections()) as web:
            return [ask(web, url, r["doc_id"]) for r in rows]

    return tables.written(_by_rows(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id long, status int, n_bytes long", answers))


# -- Kaldi files


@query(
    f"""WITH {_X}, s AS (SELECT vec_id, x, (vec_id % 3) / 2.0 AS a, CASE WHEN vec_id % 5 = 0 THEN -1 ELSE (vec_id % 3) / 2.0 + 1.25 END AS b FROM x WHERE len(x) > 0)
SELECT 'u' || vec_id AS utt, {RATE} AS rate, CASE WHEN b < 0 THEN x[floor(a * {RATE})::INTEGER + 1 :] ELSE x[floor(a * {RATE})::INTEGER + 1 : floor(b * {RATE})::INTEGER] END AS samples FROM s"""
)
def segments_by_specifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recordings by one scp and a segments file, written and read as specifiers say."""
    vectors = _vectors(spark, sf_dir).where(F.size("x") > 0)
    folder = _new_folder(spark)
    kaldi.write(_objects(vectors, "sound", RATE), f"ark,scp:{folder}/wav.ark,{folder}/wav.scp")
    start = (F.col("vec_id") % 3).cast("double") / 2
    end = F.when(F.col("vec_id") % 5 == 0, F.lit(-1.0)).otherwise(start + 1.25)
    vectors.select(F.concat_ws(" ", F.concat(F.lit("u"), "vec_id"), F.col("vec_id").cast("string"), start.cast("string"), end.cast("string"))).write.text(f"{folder}/segments")
    return kaldi.read(spark, f"scp:{folder}/wav.scp", segments=f"{folder}/segments").select("utt", "rate", F.col("i32").alias("samples"))


@query(
    f"""WITH {_X}, n AS (SELECT count(*) AS n FROM x)
SELECT doc_id, n, vec_id IS NOT NULL AS known, list_sum(x)::BIGINT AS total FROM documents, n LEFT JOIN x ON doc_id % 700 = vec_id"""
)
def scp_lookups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An scp as a mapping in each task: its length, which keys it has, and their objects."""
    folder = _new_folder(spark)
    kaldi.write(_objects(_vectors(spark, sf_dir), "ints"), f"ark,scp:{folder}/a.ark,{folder}/a.scp")

    def look(rows: list[dict]) -> list[tuple]:
        scp = kaldi_files.Scp(f"{folder}/a.scp", open_files=2)
        keys = [str(r["doc_id"] % 700) for r in rows]
        return [(r["doc_id"], len(scp), key in scp, (int(scp[key].sum()) if len(scp[key]) else None) if key in scp else None) for r, key in zip(rows, keys, strict=True)]

    return _by_rows(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id long, n long, known boolean, total long", look)


@query(f"WITH {_X} SELECT vec_id, x AS ints, true AS in_order FROM x")
def scp_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scps read from beginning to end, each in a task, in the order of their lines."""
    folder = _new_folder(spark)
    kaldi.register(spark)
    _objects(_vectors(spark, sf_dir), "ints").repartition(3).write.format("kaldi_ark").mode("append").save(folder)
    names = [(f"{folder}/{name}",) for name in sorted(os.listdir(folder)) if name.endswith(".scp")]

    def read(rows: list[dict]) -> list[tuple]:
        found = []
        for row in rows:
            lines = [key for key, _ in kaldi_files.scp_lines(row["name"])]
            with kaldi_files.Reader(f"scp:{row['name']}") as reader:
                found += [(int(key), value.tolist(), key == line) for (key, value), line in zip(reader, lines, strict=True)]
        return found

    return _by_rows(spark.createDataFrame(names, "name string").repartition(len(names)), "vec_id long, ints array<int>, in_order boolean", read)


@query(f"WITH {_X} SELECT vec_id, x AS ints FROM x")
def written_by_specifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each batch to an ark of its own by a local writer, as text with an scp or compressed, and back by a local reader."""
    folder = _new_folder(spark)

    def there_and_back(rows: list[dict]) -> list[tuple]:
        found = []
        for part, name in ((rows[::2], "text"), (rows[1::2], "gz")):
            path = f"{folder}/{uuid.uuid4().hex}"
            with kaldi_files.Writer(f"ark,scp,t,f:{path}.ark,{path}.scp" if name == "text" else f"ark:{path}.ark.gz") as writer:
                for row in part:
                    writer[str(row["vec_id"])] = np.array(row["x"], np.int32)
            with kaldi_files.Reader(f"scp:{path}.scp" if name == "text" else f"ark:{path}.ark.gz") as reader:
                found += [(int(key), value.astype(np.int32).tolist()) for key, value in reader]
        return found

    return _by_rows(_vectors(spark, sf_dir), "vec_id long, ints array<int>", there_and_back)


@query("SELECT vec_id, 8 AS rows, 8 AS cols, list_transform(embedding, lambda x: x::DOUBLE) AS whole, embedding AS at_offset FROM embeddings WHERE embedding IS NOT NULL")
def objects_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects of their own: a file of matrices one after another read as file:offset, and each batch's last one as a file."""
    folder = _new_folder(spark)

    def there_and_back(rows: list[dict]) -> list[tuple]:
        found, path = [], f"{folder}/{uuid.uuid4().hex}"
        places = []
        with kaldi.opened_to_write(path) as file:
            for row in rows:
                places.append(file.tell())
                file.write(kaldi_obj.write_object(np.array(row["embedding"], np.float32)))
        for row, place in zip(rows, places, strict=True):
            matrix = np.array(row["embedding"], np.float64).reshape(8, 8)
            if found:  # a file cut to nothing and written again is put on disk at once, a new one is not
                os.remove(f"{path}.mat")
            kaldi.save_object(f"{path}.mat", matrix)
            again = kaldi.load_object(f"{path}.mat")
            found.append((row["vec_id"], *again.shape, again.reshape(-1).tolist(), kaldi.load_object(f"{path}:{place}").tolist()))
        return found

    return _by_rows(_table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "embedding"), "vec_id long, rows int, cols int, whole array<double>, at_offset array<float>", there_and_back)


@query(
    """SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'ark a' || doc_id || '.ark' WHEN 1 THEN 'scp b' || doc_id || '.scp' WHEN 3 THEN 'a' || doc_id || '.ark a' || doc_id || '.scp false true'
WHEN 5 THEN 'c' || doc_id || ' none true false' WHEN 6 THEN 'd' || doc_id || '.ark at ' || doc_id WHEN 7 THEN 'gzip -c d' || doc_id || ' | at none' ELSE 'error' END AS said FROM documents"""
)
def specifiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Specifiers of all kinds and extended file names, right and wrong."""

    def said(n: int) -> str:
        plain = lambda x: "none" if x is None else str(x).lower() if isinstance(x, bool) else str(x)
        try:
            match n % 9:
                case 0 | 1 | 2:
                    return " ".join(specifier.parse_rspecifier((f"ark:a{n}.ark", f"scp,s,cs: b{n}.scp", "ark,scp:x")[n % 9]))
                case 3 | 4:
                    found = specifier.parse_wspecifier((f"ark,scp,f:a{n}.ark,a{n}.scp", f"scp:a{n}")[n % 9 - 3])
                    return " ".join(plain(found[c]) for c in ("ark", "scp", "text", "flush"))
                case 5 | 8:
                    found = specifier.parse_specifier(f"ark,t:c{n}" if n % 9 == 5 else f"ark,bogus:c{n}")
                    return " ".join(plain(found[c]) for c in ("ark", "scp", "t", "f"))
                case _:
                    return " at ".join(map(plain, specifier.parse_extended_filename(f"d{n}.ark:{n}" if n % 9 == 6 else f"gzip -c d{n} |")))
        except ValueError:
            return "error"

    return _by_rows(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id long, said string", lambda rows: [(r["doc_id"], said(r["doc_id"])) for r in rows])


#: After the binary mark: two good vectors, one with a count of two bytes, then broken ones.
_WIRE = (
    b"FV \4" + struct.pack("<if", 1, 2.5), b"FV \2" + struct.pack("<hf", 1, 2.5), b"FV \4" + struct.pack("<i", -1), b"FV \4" + struct.pack("<if", 2, 2.5),
    b"MUCHTOOLONG ", b"XY \4" + struct.pack("<i", 1), b"FV \4" + struct.pack("<i", 2**31 - 1), b"FV \11" + bytes(9), b"CM2 " + struct.pack("<ffii", 0, 1, -1, 1), b"CM " + struct.pack("<ffii", 0, 1, 9, 9),
)


@query(f"SELECT doc_id, CASE WHEN doc_id % {len(_WIRE)} < 2 THEN 2.5 END::DOUBLE AS value, doc_id % {len(_WIRE)} >= 2 AS refused FROM documents")
def broken_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Objects with counts, sizes and names that cannot be, each refused as such."""

    def read(n: int) -> tuple:
        try:
            return n, float(kaldi_obj.read_object(kaldi_obj.stream(b"\0B" + _WIRE[n % len(_WIRE)]))[0]), False
        except ReadError:
            return n, None, True

    return _by_rows(_table(spark, sf_dir, "documents").select("doc_id"), "doc_id long, value double, refused boolean", lambda rows: [read(r["doc_id"]) for r in rows])


_QUANT_BY_COLUMN = """
WITH v AS (SELECT vec_id, embedding AS v, list_min(embedding) AS low, (list_max(embedding) - list_min(embedding))::FLOAT AS wide FROM embeddings WHERE embedding IS NOT NULL),
e AS (SELECT vec_id, low, wide, unnest(v) AS x, generate_subscripts(v, 1)::INTEGER - 1 AS pos FROM v),
s AS (SELECT *, pos % 4 AS col, row_number() OVER (PARTITION BY vec_id, pos % 4 ORDER BY x) - 1 AS k FROM e),
c AS (SELECT *, floor(greatest(0::FLOAT, least(1::FLOAT, (x - low) / wide)) * 65535::FLOAT + 0.499::FLOAT)::BIGINT AS code FROM s),
r AS (SELECT vec_id, col, any_value(low) AS low, any_value(wide) AS wide, max(code) FILTER (k = 0) AS c0, max(code) FILTER (k = 4) AS c1, max(code) FILTER (k = 12) AS c2, max(code) FILTER (k = 15) AS c3 FROM c GROUP BY vec_id, col),
r0 AS (SELECT *, least(c0, 65532) AS m0 FROM r), r1 AS (SELECT *, least(greatest(c1, m0 + 1), 65533) AS m1 FROM r0),
r2 AS (SELECT *, least(greatest(c2, m1 + 1), 65534) AS m2 FROM r1), r3 AS (SELECT *, greatest(c3, m2 + 1) AS m3 FROM r2),
f AS (SELECT vec_id, col, (low + (wide * m0::FLOAT) / 65535::FLOAT)::FLOAT AS f0, (low + (wide * m1::FLOAT) / 65535::FLOAT)::FLOAT AS f1, (low + (wide * m2::FLOAT) / 65535::FLOAT)::FLOAT AS f2, (low + (wide * m3::FLOAT) / 65535::FLOAT)::FLOAT AS f3 FROM r3),
b AS (SELECT vec_id, pos, f0, f1, f2, f3, (CASE
    WHEN x < f1 THEN least(64, greatest(0, floor((x - f0) / (f1 - f0) * 64::FLOAT + 0.5::FLOAT)))
    WHEN x < f2 THEN least(192, greatest(64, 64 + floor((x - f1) / (f2 - f1) * 128::FLOAT + 0.5::FLOAT)))
    ELSE least(255, greatest(192, 192 + floor((x - f2) / (f3 - f2) * 63::FLOAT + 0.5::FLOAT))) END)::FLOAT AS code FROM s JOIN f USING (vec_id, col))
SELECT vec_id, pos, (CASE WHEN code <= 64 THEN f0 + ((f1 - f0) * code) * (1.0 / 64)::FLOAT WHEN code <= 192 THEN f1 + ((f2 - f1) * (code - 64::FLOAT)) * (1.0 / 128)::FLOAT
  ELSE f2 + ((f3 - f2) * (code - 192::FLOAT)) * (1.0::DOUBLE / 63)::FLOAT END)::FLOAT AS value FROM b"""


def _by_column(method: int) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = _table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", "embedding", F.lit(16).alias("r"), F.lit(4).alias("c"))
        return kaldi.quantised(made, "embedding", "r", "c", method).select("vec_id", F.posexplode("quantised").alias("pos", "value"))

    run.__name__ = f"quantise_by_column_{method}"
    run.__doc__ = "Matrices of 16 rows as bytes between the quartiles of their columns."
    return run


for _method in (1, 2):
    query(_QUANT_BY_COLUMN)(_by_column(_method))


# -- archives and indexes


@query(
    f"""WITH RECURSIVE s AS (SELECT vec_id, 44 + 2 * len({_WHOLE})::BIGINT AS n, row_number() OVER (ORDER BY vec_id) AS r FROM embeddings),
p AS (
  SELECT r, vec_id, n, 0::BIGINT AS bin_index, 0::BIGINT AS start_byte FROM s WHERE r = 1
  UNION ALL
  SELECT s.r, s.vec_id, s.n, CASE WHEN p.start_byte + p.n + s.n > 1000 THEN p.bin_index + 1 ELSE p.bin_index END, CASE WHEN p.start_byte + p.n + s.n > 1000 THEN 0 ELSE p.start_byte + p.n END
  FROM p JOIN s ON s.r = p.r + 1),
t AS (SELECT max(bin_index) + 1 AS n_bins, sum(n)::BIGINT AS total, count(*) AS n_ids FROM p)
SELECT vec_id, bin_index, start_byte, start_byte + n AS end_byte, n_bins, n_bins AS next_bin, total, n_ids FROM p, t"""
)
def archive_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where one task puts sounds of known sizes, how many bins, bytes and ids there are, and the next bin's number."""
    made = Archive(spark, _new_folder(spark), "audio", max_bin_size=1000)
    made.append(_sounds(spark, sf_dir), "item", "vec_id", order_by="vec_id", partitions=1)
    found, ids = made.summary().first(), made.index().select("id").distinct().count()
    counted = {"n_bins": found.n_bins, "next_bin": made.next_bin(), "total": found.total_bytes, "n_ids": ids}
    return made.index().select(F.col("id").cast("long").alias("vec_id"), "bin_index", "start_byte", "end_byte", *[F.lit(int(n)).cast("long").alias(name) for name, n in counted.items()])


@query("SELECT true AS refused, 0 AS n_refused, count(*) AS n_kept, true AS asked, 0 AS n_cleared FROM documents WHERE text IS NOT NULL")
def archive_refused_and_cleared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An id twice stops an append before anything is written; clearing has to be confirmed and leaves nothing."""
    docs = _table(spark, sf_dir, "documents").where("text is not null").select("doc_id", "text")
    made = Archive(spark, _new_folder(spark), "text")

    def refused(work: Callable[[], object]) -> bool:
        try:
            work()
        except ValueError:
            return True
        return False

    twice = refused(lambda: made.append(docs.unionByName(docs), "text", "doc_id"))
    n_refused = len(made)
    made.append(docs, "text", "doc_id")
    n_kept, asked = len(made), refused(made.clear)
    made.clear(confirm=True)
    return spark.createDataFrame([(twice, n_refused, n_kept, asked, len(made))], "refused boolean, n_refused int, n_kept long, asked boolean, n_cleared int")


@query("SELECT doc_id, lang, NULL::BIGINT AS original_size, 'unknown' AS original_path, n_chars FROM documents WHERE lang <> 'en'")
def index_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An index that lacks columns, of other types, read as a text archive's, with a filter and a default."""
    folder = _new_folder(spark)
    plain = _table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.lit(0).alias("start_byte"), F.lit(0).alias("end_byte"), F.lit(0).alias("bin_index"), F.lit("").alias("path"), "lang", "n_chars")
    plain.write.parquet(f"{folder}/metadata.parquet")
    index = archive.read_index(spark, folder, "text").where("lang <> 'en'")
    return index.select(F.col("id").cast("long").alias("doc_id"), "lang", "original_size", F.coalesce("original_path", F.lit("unknown")).alias("original_path"), "n_chars")


# -- songs and videos


def _song_notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    onset = (F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1) * 0.5
    made = _table(spark, sf_dir, "events").select("user_id", onset.alias("onset"), (onset + 0.25).alias("offset"), (F.col("event_id") % 128).alias("pitch"), (1 + F.col("event_id") % 127).alias("velocity"))
    return notes.coerced(made)


@query(f'WITH {_SONGS} SELECT user_id, round(a, 6) AS onset, round(a + 0.25, 6) AS "offset", pitch, velocity, 480 AS resolution FROM n')
def notes_as_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Notes of each user as a standard MIDI file, and read from it."""
    files = notes.to_midi(_song_notes(spark, sf_dir), "user_id")
    found = decode(files, "midi", "midi").select("user_id", "resolution", F.explode("notes").alias("n"))
    return found.select("user_id", F.round("n.onset", 6).alias("onset"), F.round("n.offset", 6).alias("offset"), "n.pitch", "n.velocity", "resolution")


@query(f"WITH {_SONGS} SELECT user_id, round(max(a) * 200 + 50)::INTEGER * 2 AS n, true AS sounds, true AS rests, true AS both FROM n GROUP BY user_id")
def songs_as_sounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Songs rendered by sines: as long as the song, on both channels alike, with sound in notes and none between them."""
    files = notes.to_midi(_song_notes(spark, sf_dir), "user_id")
    found = decode(files, "midi", "midi", synthesize=True, sample_rate=200, channels=2, backend="sine")
    first = F.slice("samples", 1, 100)
    sounds = (F.array_max(first) > 0) & (F.array_max("samples") <= 1) & (F.array_min("samples") >= -1)
    rests = F.forall(F.slice("samples", 101, 100), lambda x: x == 0)
    left = F.filter("samples", lambda _, k: k % 2 == 0)
    right = F.filter("samples", lambda _, k: k % 2 == 1)
    return found.select("user_id", F.size("samples").alias("n"), sounds.alias("sounds"), rests.alias("rests"), (left == right).alias("both"))


@query(
    """WITH d AS (SELECT doc_id, doc_id % 4 AS n, (row_number() OVER (ORDER BY doc_id) - 1) // 5 AS batch FROM documents),
m AS (SELECT *, max(n) OVER (PARTITION BY batch) AS most FROM d)
SELECT batch, 1 AS height, 2 AS width, list(n::INTEGER ORDER BY doc_id) AS n_frames, list(repeat(printf('%02X', (doc_id % 256)::INTEGER), (6 * n)::INTEGER) || repeat('00', (6 * (most - n))::INTEGER) ORDER BY doc_id) AS frames,
  list(list_resize([1::FLOAT], greatest(1, most)::INTEGER, 0::FLOAT) ORDER BY doc_id) AS samples FROM m GROUP BY batch"""
)
def video_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decoded videos of several lengths, and their sounds, in batches."""
    n = (F.col("doc_id") % 4).cast("int")
    data = F.unhex(F.expr("repeat(lpad(hex(doc_id % 256), 2, '0'), cast(6 * (doc_id % 4) as int))"))
    samples = F.concat(F.array(F.lit(1.0)), F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), n - 1))).cast("array<float>")
    made = _table(spark, sf_dir, "documents").select("doc_id", F.lit(1).alias("height"), F.lit(2).alias("width"), data.alias("data"), samples.alias("samples"))
    found = video_collate(made, 5, "doc_id", samples="samples")
    return found.select("batch", "height", "width", "n_frames", F.transform("frames", lambda x: F.hex(x)).alias("frames"), "samples")
