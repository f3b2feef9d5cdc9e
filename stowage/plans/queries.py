"""Named queries over the driver tables, and the SQL that each has to agree with."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import columns, notes
from ..operators.batching import pad_collate, text_collate
from ..operators.packing import packed, running_base
from ..sources import archive, kaldi, tables
from ..sources.archive import Archive

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: Bytes of a bin in the packing queries, which are small so that there are some.
BIN = 50_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _new_folder(spark: SparkSession) -> str:
    """A folder for an archive, in the folder that the cluster shares."""
    return f"{tables.local_folder(spark)}/archive-{uuid.uuid4().hex}"


def _documents_archive(spark: SparkSession, sf_dir: str) -> Archive:
    docs = _table(spark, sf_dir, "documents").where("text is not null")
    made = Archive(spark, _new_folder(spark), "text", name="docs", max_bin_size=1 << 20)
    made.append(docs, "text", "doc_id", order_by="doc_id", keep=("lang", "n_chars", "source"))
    return made


@query("SELECT doc_id, text FROM documents WHERE text IS NOT NULL")
def text_archive_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_archive(spark, sf_dir).read().select(F.col("id").cast("long").alias("doc_id"), "text")


@query("SELECT doc_id, text FROM documents WHERE lang = 'en' AND n_chars > 500")
def text_archive_filtered_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_archive(spark, sf_dir).read("lang = 'en' and n_chars > 500").select(F.col("id").cast("long").alias("doc_id"), "text")


@query("SELECT doc_id, octet_length(encode(text))::BIGINT AS original_size, true AS right_length FROM documents WHERE text IS NOT NULL")
def index_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _documents_archive(spark, sf_dir).index()
    return index.select(F.col("id").cast("long").alias("doc_id"), "original_size", (columns.length() == F.col("compressed_size")).alias("right_length"))


@query("SELECT doc_id, text FROM documents WHERE doc_id IN (3, 14, 159)")
def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_archive(spark, sf_dir).read(ids=["3", "14", "159"], columns_=["id"]).select(F.col("id").cast("long").alias("doc_id"), "text")


@query("SELECT source AS data_type, count(*) AS n_items FROM documents WHERE text IS NOT NULL GROUP BY source")
def data_type_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _documents_archive(spark, sf_dir).counts("source").withColumnRenamed("source", "data_type")


@query("SELECT count(*) AS n_items, true AS sizes_agree FROM documents WHERE text IS NOT NULL")
def archive_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = _documents_archive(spark, sf_dir).index()
    whole = index.agg(F.sum("compressed_size").alias("stored"))
    return archive.summary(index).crossJoin(F.broadcast(whole)).select("n_items", (F.col("total_bytes") == F.col("stored")).alias("sizes_agree"))


_PACK = f"""
WITH RECURSIVE s AS (SELECT doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n, row_number() OVER (ORDER BY doc_id) AS r FROM documents),
p AS (
  SELECT r, doc_id, n, 0::BIGINT AS bin_index, 0::BIGINT AS start_byte FROM s WHERE r = 1
  UNION ALL
  SELECT s.r, s.doc_id, s.n,
    CASE WHEN p.start_byte + p.n > 0 AND p.start_byte + p.n + s.n > {BIN} THEN p.bin_index + 1 ELSE p.bin_index END,
    CASE WHEN p.start_byte + p.n > 0 AND p.start_byte + p.n + s.n > {BIN} THEN 0 ELSE p.start_byte + p.n END
  FROM p JOIN s ON s.r = p.r + 1)
"""


@query(_PACK + "SELECT doc_id, bin_index, start_byte, start_byte + n AS end_byte FROM p")
def greedy_pack_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _table(spark, sf_dir, "documents").select("doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("size"))
    return packed(sized, "size", "doc_id", BIN).select("doc_id", "bin_index", "start_byte", "end_byte")


@query(
    """
WITH sized AS (SELECT source AS shard, doc_id, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
own AS (SELECT shard, doc_id, n, (sum(n) OVER (PARTITION BY shard ORDER BY doc_id))::BIGINT - n AS start_byte FROM sized),
shards AS (SELECT shard, sum(n)::BIGINT AS n FROM sized GROUP BY shard),
base AS (SELECT shard, (sum(n) OVER (ORDER BY shard))::BIGINT - n AS base FROM shards)
SELECT doc_id, base + start_byte AS start_byte, base + start_byte + n AS end_byte FROM own JOIN base USING (shard)"""
)
def reshard_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = _table(spark, sf_dir, "documents").select(F.col("source").alias("shard"), "doc_id", F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n"))
    own = sized.withColumn("own", running_base(F.col("n"), "doc_id", partition=("shard",)))
    shards = sized.groupBy("shard").agg(F.sum("n").alias("size")).withColumn("base", running_base(F.col("size"), "shard"))
    start = F.col("base") + F.col("own")
    return own.join(F.broadcast(shards.select("shard", "base")), "shard").select("doc_id", start.alias("start_byte"), (start + F.col("n")).alias("end_byte"))


@query("SELECT d.doc_id, d.n_chars FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.item_id = d.doc_id)")
def append_dedup_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = _table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("doc_id"))
    return archive.without_known(_table(spark, sf_dir, "documents").select("doc_id", "n_chars"), known, "doc_id")


@query("SELECT doc_id, 'docs_' || (row_number() OVER (ORDER BY doc_id) - 1)::VARCHAR AS id FROM documents")
def append_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.ordinal_ids(_table(spark, sf_dir, "documents").select("doc_id"), "docs", "doc_id")


@query("SELECT doc_id, 'http://localhost:8000/blob_' || (doc_id % 7)::VARCHAR || '.bin' AS path FROM documents")
def remote_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.pmod("doc_id", F.lit(7)).alias("bin_index"))
    return archive.with_base(docs, "http://localhost:8000/").select("doc_id", "path")


@query("SELECT doc_id AS id, lang, n_chars, NULL::VARCHAR AS url FROM documents UNION ALL BY NAME SELECT page_id AS id, url FROM pages")
def index_union_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "lang", "n_chars")
    return archive.union_by_name(docs, _table(spark, sf_dir, "pages").select(F.col("page_id").alias("id"), "url"))


@query("SELECT page_id, try_cast(regexp_extract(url, '/([0-9]+)', 1) AS INTEGER) IS NULL AS failed FROM pages")
def skip_errors_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items whose number cannot be read are marked instead of ending the query."""
    made = _table(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "/([0-9]+)", 1).try_cast("int").alias("n"))
    return made.select("page_id", F.col("n").isNull().alias("failed"))


_HEADS = {"664C6143": "flac", "52494646": "wav", "1A45DFA3": "webm", "4F676753": "ogg", "00000000": None}


@query(
    "SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN 'flac' WHEN 1 THEN 'wav' WHEN 2 THEN 'webm' WHEN 3 THEN 'ogg' END AS audio, "
    "CASE WHEN doc_id % 5 = 2 THEN 'webm' END AS video FROM documents"
)
def magic_sniff(spark: SparkSession, sf_dir: str) -> DataFrame:
    heads = F.array(*[F.unhex(F.lit(h)) for h in _HEADS])
    head = F.element_at(heads, F.pmod("doc_id", F.lit(5)).cast("int") + 1)
    return _table(spark, sf_dir, "documents").select("doc_id", columns.sniff_audio(head).alias("audio"), columns.sniff_video(head).alias("video"))


# -- Kaldi


def _vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings").where("embedding is not null")
    empty = F.lit(None)
    return vectors.select(F.col("vec_id").cast("string").alias("key"), F.lit("vector").alias("kind"), F.size("embedding").alias("rows"), empty.cast("int").alias("cols"), F.col("embedding").alias("f32"), empty.cast("array<double>").alias("f64"), empty.cast("array<int>").alias("i32"), empty.cast("int").alias("rate"), empty.cast("long").alias("offset"), empty.cast("string").alias("ark"))


def _as_ark(spark: SparkSession, objects: DataFrame, **options: str) -> str:
    kaldi.register(spark)
    folder = _new_folder(spark)
    objects.write.format("kaldi_ark").options(**options).mode("append").save(folder)
    return folder


_EXPLODED = "SELECT vec_id, unnest(embedding) AS value, generate_subscripts(embedding, 1)::INTEGER - 1 AS pos FROM embeddings"


@query(_EXPLODED)
def ark_vector_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _as_ark(spark, _vectors(spark, sf_dir))
    read = spark.read.format("kaldi_ark").load(folder)
    return read.select(F.col("key").cast("long").alias("vec_id"), F.posexplode("f32").alias("pos", "value"))


@query(_EXPLODED)
def ark_text_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _as_ark(spark, _vectors(spark, sf_dir), text="true")
    read = spark.read.format("kaldi_ark").load(folder)
    return read.select(F.col("key").cast("long").alias("vec_id"), F.posexplode("f32").alias("pos", "value"))


@query(_EXPLODED + " WHERE vec_id % 3 = 0")
def scp_filtered_fetch(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _as_ark(spark, _vectors(spark, sf_dir))
    scp = kaldi.read_scp(spark, f"{folder}/*.scp").where(F.col("key").cast("long") % 3 == 0)
    return kaldi.fetch(scp).select(F.col("key").cast("long").alias("vec_id"), F.posexplode("f32").alias("pos", "value"))


@query("SELECT l_orderkey, list(l_linenumber::INTEGER ORDER BY l_linenumber) AS ints FROM lineitem GROUP BY l_orderkey")
def ark_int_vector_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.col("l_linenumber").cast("int"))).alias("i32"))
    empty = F.lit(None)
    objects = lists.select(F.col("l_orderkey").cast("string").alias("key"), F.lit("ints").alias("kind"), F.size("i32").alias("rows"), empty.cast("int").alias("cols"), empty.cast("array<float>").alias("f32"), empty.cast("array<double>").alias("f64"), "i32", empty.cast("int").alias("rate"), empty.cast("long").alias("offset"), empty.cast("string").alias("ark"))
    read = spark.read.format("kaldi_ark").load(_as_ark(spark, objects))
    return read.select(F.col("key").cast("long").alias("l_orderkey"), F.col("i32").alias("ints"))


@query(
    """WITH v AS (SELECT vec_id, length(vec_id::VARCHAR) + 1 AS head, 2 + 3 + 5 + 4 * len(embedding) AS body FROM embeddings)
SELECT vec_id, ((sum(head + body) OVER (ORDER BY vec_id)) - body)::BIGINT AS byte_offset FROM v"""
)
def scp_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offsets in an scp of one ark in order of number, and the same from sizes alone."""
    vectors = _vectors(spark, sf_dir).withColumn("n", F.col("key").cast("long"))
    folder = _new_folder(spark)
    kaldi.write(vectors, f"ark,scp:{folder}/all.ark,{folder}/all.scp", order_by="n")
    return kaldi.read_scp(spark, f"{folder}/all.scp").select(F.col("key").cast("long").alias("vec_id"), F.col("offset").alias("byte_offset"))


@query("SELECT user_id::VARCHAR AS key, arg_max(event_type || ':' || event_id::VARCHAR, event_id) AS rxfile FROM events GROUP BY user_id")
def scp_last_duplicate_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("key"), F.concat("event_type", F.lit(":"), F.col("event_id").cast("string")).alias("rxfile"), F.col("event_id").alias("line"))
    return kaldi.last_of_each(lines).select("key", "rxfile")


_SEGMENTS = "SELECT doc_id::VARCHAR AS utt, doc_id % 50 AS rec, doc_id % 20 AS start, CASE WHEN doc_id % 11 = 0 THEN -1 WHEN doc_id % 7 = 0 THEN 0 ELSE doc_id % 20 + doc_id % 13 END AS stop FROM documents"


@query(
    f"""WITH s AS ({_SEGMENTS}), c AS (SELECT utt, CASE WHEN stop < 0 THEN embedding[start + 1 :] ELSE embedding[start + 1 : stop] END AS x FROM s JOIN embeddings ON rec = vec_id)
SELECT utt, unnest(x) AS value, generate_subscripts(x, 1)::INTEGER - 1 AS pos FROM c"""
)
def segments_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("doc_id")
    stop = F.when(n % 11 == 0, -1.0).when(n % 7 == 0, 0.0).otherwise((n % 20 + n % 13).cast("double"))
    segments = _table(spark, sf_dir, "documents").select(n.cast("string").alias("utt"), (n % 50).alias("rec"), (n % 20).cast("double").alias("start"), stop.alias("end"))
    recordings = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec"), F.col("embedding").alias("samples"), F.lit(1).alias("rate"))
    return kaldi.segment_arrays(segments, recordings).select("utt", F.posexplode("samples").alias("pos", "value"))


@query("SELECT DISTINCT d.doc_id % 700 AS rec FROM documents d LEFT JOIN embeddings e ON d.doc_id % 700 = e.vec_id WHERE e.vec_id IS NULL")
def segments_missing_recording(spark: SparkSession, sf_dir: str) -> DataFrame:
    segments = _table(spark, sf_dir, "documents").select((F.col("doc_id") % 700).alias("rec")).distinct()
    return segments.join(_table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("rec")), "rec", "left_anti")


def _quantised(method: int, scale: float):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        made = _table(spark, sf_dir, "embeddings").where("embedding is not null").select("vec_id", F.transform("embedding", lambda x: (x * scale).cast("float")).alias("v"), F.lit(1).alias("r"), F.size("embedding").alias("c"))
        return kaldi.quantised(made, "v", "r", "c", method).select("vec_id", F.posexplode("quantised").alias("pos", "value"))

    return run


def _quantised_sql(low: str, wide: str, top: int, scale: float) -> str:
    return f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: (x::DOUBLE * {scale})::FLOAT) AS v FROM embeddings),
h AS (SELECT vec_id, v, ({low})::FLOAT AS low, ({wide})::FLOAT AS wide FROM v),
e AS (SELECT vec_id, low, wide, unnest(v) AS x, generate_subscripts(v, 1)::INTEGER - 1 AS pos FROM h),
q AS (SELECT vec_id, pos, low, wide, floor(greatest(0::FLOAT, least(1::FLOAT, (x - low) / wide)) * {top}::FLOAT + 0.499::FLOAT)::FLOAT AS code FROM e)
SELECT vec_id, pos, (low + (wide * code) / {top}::FLOAT)::FLOAT AS value FROM q"""


for _name, _method, _low, _wide, _top, _scale in (
    ("quantise_two_byte_auto", 3, "list_min(v)", "list_max(v) - list_min(v)", 65535, 1.0),
    ("quantise_two_byte_signed", 4, "-32768", "65535", 65535, 4096.0),
    ("quantise_one_byte_auto", 5, "list_min(v)", "list_max(v) - list_min(v)", 255, 1.0),
    ("quantise_one_byte_unsigned", 6, "0", "255", 255, 256.0),
    ("quantise_one_byte_zero_one", 7, "0", "1", 255, 1.0),
):
    QUERIES[_name] = _quantised(_method, _scale)
    ORACLES[_name] = _quantised_sql(_low, _wide, _top, _scale)


# -- notes: events stand for notes that begin at their time and last as long as their value says

_START, _END = 1000.0, 5000.0
_NOTES_SQL = """
base AS (SELECT min(epoch_us(ts)) AS zero FROM events),
notes AS (
  SELECT event_id, user_id, ((epoch_us(ts) - zero)::DOUBLE / 1000000) AS onset, ((epoch_us(ts) - zero)::DOUBLE / 1000000) + abs(value) AS "offset",
    (event_id % 128)::SMALLINT AS pitch, (user_id % 5)::SMALLINT AS program, event_id % 10 = 0 AS is_drum, value FROM events, base)"""


def _notes(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _table(spark, sf_dir, "events")
    zero = events.agg(F.min(F.unix_micros(F.col("ts").cast("timestamp"))).alias("zero"))
    timed = events.crossJoin(F.broadcast(zero)).withColumn("onset", (F.unix_micros(F.col("ts").cast("timestamp")) - F.col("zero")).cast("double") / 1000000)
    return notes.coerced(timed.select("event_id", "user_id", "value", "onset", (F.col("onset") + F.abs("value")).alias("offset"), (F.col("event_id") % 128).alias("pitch"), (F.col("user_id") % 5).alias("program"), (F.col("event_id") % 10 == 0).alias("is_drum")))


def _clip_sql(partial: bool) -> str:
    return f"""WITH {_NOTES_SQL} SELECT event_id, greatest(onset, {_START}) - {_START} AS onset, least("offset", {_END}) - {_START} AS "offset"
FROM notes WHERE "offset" > {_START} AND onset < {_END}{"" if partial else f" AND onset >= {_START}"}"""


@query(_clip_sql(True))
def notes_clip_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.slice_notes(_notes(spark, sf_dir), _START, _END).select("event_id", "onset", "offset")


@query(_clip_sql(False))
def notes_include_partial_false(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.slice_notes(_notes(spark, sf_dir), _START, _END, include_partial=False).select("event_id", "onset", "offset")


@query(
    f"""WITH {_NOTES_SQL}, windows AS (SELECT c_custkey AS user_id, (c_custkey % 100) * 1000.0::DOUBLE AS a, (c_custkey % 100) * 1000.0::DOUBLE + 50000 AS b FROM customer)
SELECT event_id, greatest(onset, a) - a AS onset, least("offset", b) - a AS "offset" FROM notes JOIN windows USING (user_id) WHERE "offset" > a AND onset < b"""
)
def notes_many_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = (F.col("c_custkey") % 100).cast("double") * 1000
    windows = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"), start.alias("start"), (start + 50000).alias("end"))
    return notes.in_windows(_notes(spark, sf_dir), windows, "user_id").select("event_id", "onset", "offset")


@query(
    f"""WITH {_NOTES_SQL}, c AS (SELECT user_id, onset AS t, event_id, value FROM notes)
SELECT user_id, 0.0::DOUBLE AS time, arg_max(value, (t, event_id)) AS value FROM c WHERE t < {_START * 50} GROUP BY user_id
UNION ALL SELECT user_id, t - {_START * 50}, value FROM c WHERE t >= {_START * 50} AND t < {_START * 60}"""
)
def controller_carry_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _notes(spark, sf_dir).select("user_id", F.col("onset").alias("time"), F.col("event_id").alias("seq"), "value")
    return notes.controls_in_effect(events, _START * 50, _START * 60, "user_id").select("user_id", "time", "value")


@query(
    f"""WITH {_NOTES_SQL}, c AS (SELECT user_id, max(onset) AS t FROM notes WHERE onset <= {_START * 20} GROUP BY user_id)
SELECT u.user_id, coalesce(max(n.value), 120.0) AS tempo FROM (SELECT DISTINCT user_id FROM notes) u LEFT JOIN c USING (user_id) LEFT JOIN notes n ON n.user_id = u.user_id AND n.onset = c.t GROUP BY u.user_id"""
)
def tempo_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    tempos = _notes(spark, sf_dir).groupBy("user_id", F.col("onset").alias("time")).agg(F.max("value").alias("bpm"))
    return notes.tempo_at(tempos, _START * 20, "user_id")


@query(f'WITH {_NOTES_SQL} SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY onset, is_drum, program, pitch, "offset", event_id)::INTEGER AS rank FROM notes')
def notes_canonical_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    ordered = Window.partitionBy("user_id").orderBy(*notes.ORDER, "event_id")
    return _notes(spark, sf_dir).select("event_id", F.row_number().over(ordered).alias("rank"))


@query(
    f"""WITH {_NOTES_SQL} SELECT user_id, count(*) AS n_notes, coalesce(list(DISTINCT program::BIGINT ORDER BY program::BIGINT) FILTER (NOT is_drum), []) AS programs, bool_or(is_drum) AS has_drums,
  min(pitch)::BIGINT AS min_pitch, max(pitch)::BIGINT AS max_pitch, max("offset") AS duration FROM notes GROUP BY user_id"""
)
def note_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    return notes.metadata(_notes(spark, sf_dir), "user_id")


# -- batches and texts


@query(
    """WITH r AS (SELECT vec_id, embedding[: 1 + vec_id % 60] AS e, (row_number() OVER (ORDER BY vec_id)) - 1 AS row FROM embeddings),
m AS (SELECT vec_id, e, row // 16 AS batch, row % 16 AS place, max(len(e)) OVER (PARTITION BY row // 16) AS n FROM r),
p AS (SELECT batch, place, list_resize(e, n, 0::FLOAT) AS e FROM m)
SELECT batch::BIGINT AS batch, place::INTEGER AS place, unnest(e) AS value, generate_subscripts(e, 1)::INTEGER - 1 AS pos FROM p"""
)
def pad_collate_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = _table(spark, sf_dir, "embeddings").select("vec_id", F.slice("embedding", F.lit(1), (1 + F.col("vec_id") % 60).cast("int")).alias("e"))
    batches = pad_collate(cut, "e", 16, "vec_id")
    return batches.select("batch", F.posexplode("items").alias("place", "item")).select("batch", "place", F.posexplode("item").alias("pos", "value"))


@query("SELECT (r // 32)::BIGINT AS batch, list(text ORDER BY r) AS texts FROM (SELECT text, (row_number() OVER (ORDER BY doc_id)) - 1 AS r FROM documents) GROUP BY 1")
def text_collate_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_collate(_table(spark, sf_dir, "documents").select("doc_id", "text"), "text", 32, "doc_id")


@query(r"SELECT doc_id, lower(text) AS lowered, trim(regexp_replace(text, '\s+', ' ', 'g')) AS spaced, left(text, 100) AS short FROM documents")
def text_transforms(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.col("text")
    return _table(spark, sf_dir, "documents").select("doc_id", columns.lowercase(text).alias("lowered"), columns.single_spaces(text).alias("spaced"), columns.truncated(text, 100).alias("short"))

