"""Line dedup by site-relative frequency.

A line is boilerplate on a host if the pages of the host that contain it are more than a ratio of all pages of
the host; pages of equal text count as one, or copied pages would lose all they say. Lines are counted as 128-bit
hashes with map-side partial sums, so neither a hot host nor a hot line meets in one task before it is summed; the
boilerplate lines of a host, at most (mean lines of a page / ratio) of them, go back to the pages as one array per
host. Texts themselves are never shuffled while the arrays fit the checked broadcast bound.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt_join, written

#: A line on more than this part of its host's pages, and on at least so many pages of it, is boilerplate.
RATIO, LEAST_PAGES = 0.05, 3
#: White space that does not make a line.
BLANKS = " \t\n\x0b\f\r"
#: Arrays of boilerplate lines up to this size in all are broadcast; larger ones are joined by host.
BROADCAST_BYTES = 16 << 20


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _key(line: Column) -> Column:
    """128 bits of a line: its hashes with two seeds, the second one being the hash of a word."""
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("line"), line).alias("b"))


def _host_key(host: Column) -> Column:
    """A host's name that is never null, nor that of another host."""
    return F.coalesce(F.concat(F.lit("="), host.cast("string")), F.lit(""))


def boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """(h, lines, rows): for each host with any, the keys of its boilerplate lines, sorted, and its rows; h is _host_key of the host.

    Each different text of a host is a page; a line counts once for a page however often it stands there. Empty
    lines and lines of white space only (ASCII) are never boilerplate. A null host is a host of its own; null texts
    have no lines and are a page like any other text.
    """
    pages = df.select(_host_key(F.col(host)).alias("h"), F.col(text).alias("t")).withColumn("page", _key(F.coalesce(F.concat(F.lit("="), "t"), F.lit(""))))
    totals = pages.groupBy("h").agg(F.count("*").alias("rows"), F.count_distinct("page").alias("pages"))
    keys = F.array_distinct(F.transform(F.filter(_lines(F.col("t")), lambda x: F.trim(x, F.lit(BLANKS)) != ""), _key))
    counts = pages.select("h", "page", F.explode(keys).alias("k")).distinct().groupBy("h", "k").agg(F.count("*").alias("n")).where(F.col("n") >= least_pages)
    kept = counts.join(totals, "h").where(F.col("n") > F.lit(ratio) * F.col("pages"))
    return kept.groupBy("h").agg(F.sort_array(F.collect_list("k")).alias("lines"), F.first("rows").alias("rows"))


def drop_boilerplate(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """df with its text column without the boilerplate lines of its host, and n_lines_dropped (long).

    The other lines stay in order, joined by line ends. A null text stays null with none dropped; an empty table
    stays empty; other columns are left alone, whatever their names.
    """
    found = written(boilerplate(df, host, text, ratio, least_pages))
    size = found.agg(F.coalesce(F.sum(F.size("lines").cast("long") * 32 + 64), F.lit(0))).first()[0]
    found = found.select(F.col("h").alias("__host"), F.col("lines").alias("__lines"), F.col("rows").alias("__rows"))
    joined = df.withColumn("__host", _host_key(F.col(host)))
    joined = joined.join(F.broadcast(found), "__host", "left") if size <= BROADCAST_BYTES else dealt_join(joined, found, ["__host"], "__rows")
    # array_intersect builds one hash set; the few lines that it leaves are then looked up one by one
    own = F.array_intersect(F.transform(_lines(F.col(text)), _key), "__lines")
    joined = joined.withColumn("__own", F.when(F.col("__lines").isNotNull(), own))
    kept = F.filter(_lines(F.col(text)), lambda x: ~F.array_contains("__own", _key(x)))
    some = F.coalesce(F.size("__own"), F.lit(0)) > 0
    made = F.when(some, F.array_join(kept, "\n")).otherwise(F.col(text))
    dropped = F.when(some, F.size(_lines(F.col(text))) - F.size(kept)).otherwise(0).cast("long")
    return joined.select(*[c for c in df.columns if c not in (text, "n_lines_dropped")], made.alias("__made"), dropped.alias("n_lines_dropped")).withColumnRenamed("__made", text)


def cleaned(docs: DataFrame) -> DataFrame:
    """Documents with the columns they came with, without boilerplate lines; n_chars, if there is one, is counted anew."""
    made = drop_boilerplate(docs)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.char_length("text").cast("long"))
    return made.select(*docs.columns)


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the boilerplate lines of their sources."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = drop_boilerplate(docs.select("doc_id", "source", "text"))
    return made.select("doc_id", "source", "n_lines_dropped", F.char_length("text").cast("long").alias("n_chars_kept"), "text")


def line_sql(table: str) -> str:
    """SQL for doc_id, text and n_lines_dropped of a table with doc_id, source and text."""
    return f"""
  WITH pages AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM {table}),
  lines AS (SELECT r, source, text, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS p FROM pages),
  totals AS (SELECT source, count(*) AS pages FROM (SELECT DISTINCT source, text FROM pages) GROUP BY source),
  often AS (
    SELECT l.source, line FROM lines l JOIN totals t ON l.source IS NOT DISTINCT FROM t.source
    WHERE trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '' GROUP BY l.source, line, pages
    HAVING count(DISTINCT text) >= {LEAST_PAGES} AND count(DISTINCT text) > {RATIO} * pages),
  marked AS (SELECT l.*, o.line IS NOT NULL AS often FROM lines l LEFT JOIN often o ON l.source IS NOT DISTINCT FROM o.source AND l.line = o.line),
  made AS (SELECT r, coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT often), '') AS text, count(*) FILTER (often) AS n FROM marked GROUP BY r)
  SELECT pages.doc_id, pages.source, coalesce(n, 0)::BIGINT AS n_lines_dropped, CASE WHEN pages.text IS NULL THEN NULL ELSE coalesce(made.text, '') END AS text
  FROM pages LEFT JOIN made USING (r)"""


OP8_SQL = f"SELECT doc_id, source, n_lines_dropped, length(text)::BIGINT AS n_chars_kept, text FROM ({line_sql('documents')})"


def registered() -> Iterator[tuple]:
    yield "op8_line_dedup", op8_line_dedup, OP8_SQL
