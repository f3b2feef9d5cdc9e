"""Kaldi archives as DataFrames: ark and scp files, segments, specifiers, and the data source kaldi_ark.

A Python data source reads whole arks, one task for each, as their records have no index; with an scp each record is
found by its offset and any number of tasks can share an ark. Commands in file names are only run if allowed.
"""

from __future__ import annotations

import glob
import gzip
import os
import shutil
import subprocess
import sys
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from ..errors import ReadError
from ..functions.codecs import kaldi_obj as K
from ..functions.specifier import parse_extended_filename, parse_rspecifier, parse_wspecifier
from ..schemas import KALDI
from .ranges import parts

ARK_SCHEMA = StructType([StructField("key", StringType()), *KALDI.fields, StructField("offset", LongType()), StructField("ark", StringType())])
VALUES = [f.name for f in KALDI.fields]


#: Seconds of a recording whose segments go to one task.
SPAN = 3600.0


@contextmanager
def opened(name: str, allow_pipes: bool = False) -> Iterator[BinaryIO]:
    """An extended file name to read: a file, a .gz file, `-` or, if allowed, `command |`; a command that fails is an error."""
    name = name.strip()
    if name.endswith("|"):
        if not allow_pipes:
            raise PermissionError(f"{name!r} would run a command; allow_pipes is off")
        running = subprocess.Popen(name[:-1], shell=True, stdout=subprocess.PIPE)  # noqa: S602
        try:
            yield running.stdout
        finally:
            running.stdout.close()
            code = running.wait()
        if code:
            raise OSError(f"{name!r} ended with {code}")
    elif name == "-":
        yield sys.stdin.buffer
    else:
        with gzip.open(name, "rb") if name.endswith(".gz") else open(name, "rb") as file:
            yield file


@contextmanager
def opened_to_write(name: str, append: bool = False, allow_pipes: bool = False) -> Iterator[BinaryIO]:
    """An extended file name to write: a file, whose folder is made, a .gz file, `-` or, if allowed, `| command`."""
    name = name.strip()
    if name.startswith("|"):
        if not allow_pipes:
            raise PermissionError(f"{name!r} would run a command; allow_pipes is off")
        running = subprocess.Popen(name[1:], shell=True, stdin=subprocess.PIPE)  # noqa: S602
        try:
            yield running.stdin
        finally:
            running.stdin.close()
            code = running.wait()
        if code:
            raise OSError(f"{name!r} ended with {code}")
    elif name == "-":
        yield sys.stdout.buffer
    else:
        mode, put = "ab" if append else "wb", gzip.open if name.endswith(".gz") else open
        try:
            file = put(name, mode)
        except FileNotFoundError:
            os.makedirs(os.path.dirname(os.path.abspath(name)), exist_ok=True)
            file = put(name, mode)
        with file:
            yield file


# -- objects by themselves


def load_object(name: str, endian: str = "<", allow_pipes: bool = False):
    """The object that an extended file name, with an offset or not, leads to."""
    file, offset = parse_extended_filename(name)
    with opened(file, allow_pipes) as stream:
        if offset:
            stream.seek(offset)
        return K.read_object(K.Stream(stream), endian)


def save_object(name: str, value, endian: str = "<", compression_method: int | None = None) -> None:
    with opened_to_write(name) as file:
        file.write(K.write_object(value, endian, compression_method))


def load_ark(name: str, endian: str = "<", allow_pipes: bool = False) -> Iterator[tuple[str, object, int]]:
    """(key, object, offset) of an ark, in order; works on pipes."""
    with opened(name, allow_pipes) as file:
        yield from K.read_ark(file, endian)


def save_ark(ark: str, items: Iterable[tuple[str, object]], scp: str | None = None, append: bool = False, text: bool = False, endian: str = "<", compression_method: int | None = None, sound=None, flush: bool = False, allow_pipes: bool = False) -> int:
    """Write (key, object) pairs, and an scp of their offsets; how many there were."""
    if scp is not None and (ark.strip() == "-" or ark.strip().startswith("|") or ark.endswith(".gz")):
        raise ValueError(f"{ark!r} has no offsets for an scp")
    at = os.path.getsize(ark) if append and os.path.exists(ark) else 0
    lines, n = [], 0
    with opened_to_write(ark, append, allow_pipes) as file:
        for key, value in items:
            how = {} if text else {"endian": endian, "compression_method": compression_method, "sound": sound}
            raw, start = K.record(key, value, text, **how)
            file.write(raw)
            if flush:
                file.flush()
            lines.append(f"{key} {ark}:{at + start}\n")
            at, n = at + len(raw), n + 1
    if scp is not None:
        with opened_to_write(scp, append) as file:
            file.write("".join(lines).encode())
    return n


# -- index files as DataFrames


def read_scp(spark: SparkSession, path: str, separator: str | None = None) -> DataFrame:
    """(line, key, rxfile, ark, offset) of an scp; blank lines are left out, a line without a value fails the query."""
    lines = spark.read.text(path).withColumn("line", F.monotonically_increasing_id()).where(F.trim("value") != "")
    clean = F.trim(F.regexp_replace("value", "[\\r\\n]+$", ""))
    parts = F.split(clean, r"\s+" if separator is None else r"\Q" + separator + r"\E", 2)
    value = F.when(F.size(parts) == 2, F.trim(F.element_at(parts, 2))).otherwise(F.raise_error(F.concat(F.lit(f"{path}: not a key and a value: "), clean)).cast("string"))
    found = lines.select("line", F.element_at(parts, 1).alias("key"), value.alias("rxfile"))
    has = F.col("rxfile").rlike(r"^[^|].*:\d+$") & ~F.col("rxfile").endswith("|")
    offset = F.when(has, F.regexp_extract("rxfile", r":(\d+)$", 1).cast("long"))
    return found.select("line", "key", "rxfile", F.when(has, F.regexp_replace("rxfile", r":\d+$", "")).otherwise(F.col("rxfile")).alias("ark"), offset.alias("offset"))


def last_of_each(scp: DataFrame) -> DataFrame:
    """An scp as a mapping: of several lines with one key the last."""
    rest = [c for c in scp.columns if c != "key"]
    return scp.groupBy("key").agg(F.max_by(F.struct(*rest), "line").alias("r")).select("key", "r.*").select(scp.columns)


def read_segments(spark: SparkSession, path: str) -> DataFrame:
    """(utt, rec, start, end) of a segments file; a line of other than four fields fails the query."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parts = F.split(F.trim("value"), r"\s+")
    checked = F.when(F.size(parts) == 4, parts).otherwise(F.raise_error(F.concat(F.lit(f"{path}: not four fields: "), F.col("value"))).cast("array<string>"))
    return lines.select(checked.alias("p")).select(F.col("p")[0].alias("utt"), F.col("p")[1].alias("rec"), F.col("p")[2].cast("double").alias("start"), F.col("p")[3].cast("double").alias("end"))


# -- objects by index


def _objects(df: DataFrame, work) -> DataFrame:
    """df with the columns of an object made by work(loader, row)."""
    schema = StructType(df.schema.fields + KALDI.fields)
    arrow = to_arrow_schema(schema)
    names = df.columns

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        loader = _Loader()
        with loader:
            for batch in batches:
                for at in range(0, len(batch), 64):
                    part = batch.slice(at, 64)
                    made = [K.to_row(work(loader, row)) for row in part.to_pylist()]
                    new = [pa.array([m[c] for m in made], arrow.field(c).type) for c in VALUES]
                    yield pa.RecordBatch.from_arrays([part.column(c) for c in names] + new, schema=arrow)

    return df.mapInArrow(run, schema)


class _Loader:
    """Objects by place; keeps files open, and the object read last."""

    def __init__(self, most: int = 32):
        self.files: dict[str, BinaryIO] = {}
        self.most, self.last = most, (None, None)

    def __enter__(self):
        return self

    def __exit__(self, *_) -> None:
        for file in self.files.values():
            file.close()

    def load(self, ark: str, offset: int | None, endian: str, allow_pipes: bool):
        place = (ark, offset)
        if self.last[0] != place:
            if offset is None or ark.endswith((".gz", "|")):
                value = load_object(ark if offset is None else f"{ark}:{offset}", endian, allow_pipes)
            else:
                file = self.files.pop(ark, None) or open(ark, "rb")
                self.files[ark] = file
                if len(self.files) > self.most:
                    self.files.pop(next(iter(self.files))).close()
                file.seek(offset)
                value = K.read_object(K.Stream(file), endian)
            self.last = (place, value)
        return self.last[1]


def fetch(scp: DataFrame, endian: str = "<", allow_pipes: bool = False) -> DataFrame:
    """Rows of an scp (ark, offset) with their objects. Filter the scp first: what is read is what is left."""
    return _objects(scp, lambda loader, row: loader.load(row["ark"], row["offset"], endian, allow_pipes))


def decoded(df: DataFrame, payload: str, endian: str = "<") -> DataFrame:
    """Rows with an object's bytes, text or binary, in a column: the object beside them."""
    return _objects(df, lambda _, row: K.read_object(K.stream(bytes(row[payload])), endian))


def slice_segments(scp: DataFrame, segments: DataFrame, endian: str = "<", allow_pipes: bool = False) -> DataFrame:
    """(utt, rec, start, end, ark, offset) and the sound of each segment; a recording that the scp lacks fails the query.

    Segments of a recording come one after another in a task, so it is read once, or once for every SPAN seconds of
    a long one, which are dealt to several tasks.
    """
    index = last_of_each(scp).select(F.col("key").alias("rec"), "ark", "offset")
    joined = segments.join(index, "rec", "left")
    joined = joined.withColumn("ark", F.coalesce("ark", F.raise_error(F.concat(F.lit("no such recording: "), F.col("rec"))).cast("string")))
    joined = joined.select("utt", "rec", "start", "end", "ark", "offset").repartition("rec", F.floor(F.col("start") / SPAN)).sortWithinPartitions("rec", "start")
    return _objects(joined, lambda loader, row: K.slice_segment(loader.load(row["ark"], row["offset"], endian, allow_pipes), row["start"], row["end"]))


def segment_arrays(segments: DataFrame, recordings: DataFrame, samples: str = "samples", rate: str = "rate") -> DataFrame:
    """(utt, rec, samples): the same on sounds in a DataFrame (rec, rate, samples), by expressions alone; rate samples a second."""
    joined = segments.join(recordings, "rec", "left")
    have = F.coalesce(F.col(samples), F.raise_error(F.concat(F.lit("no such recording: "), F.col("rec"))).cast(recordings.schema[samples].dataType))
    first = F.greatest(F.lit(0), (F.col("start") * F.col(rate)).cast("int"))
    last = F.when(F.col("end") < 0, F.size(samples)).otherwise((F.col("end") * F.col(rate)).cast("int"))
    return joined.select("utt", "rec", F.slice(have, first + 1, F.greatest(F.lit(0), last - first)).alias(samples))


# -- the data source


@dataclass
class _Ark(InputPartition):
    path: str


@dataclass
class _Written(WriterCommitMessage):
    ark: str | None
    scp: str | None
    rows: int


class KaldiArk(DataSource):
    """spark.read.format("kaldi_ark").load(path or pattern); df.write.format("kaldi_ark").save(folder).

    Options: endian (< or >), allowPipes; to write text, compressionMethod and sound. Written are part files with an
    scp each, by tasks; they are put in place when all tasks have succeeded.
    """

    @classmethod
    def name(cls) -> str:
        return "kaldi_ark"

    def schema(self) -> StructType:
        return ARK_SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(dict(self.options), overwrite)


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.endian = options["path"], options.get("endian", "<")
        self.pipes = str(options.get("allowpipes", options.get("allowPipes", "false"))).lower() == "true"

    def partitions(self) -> list[_Ark]:
        if self.path.strip().endswith("|") or self.path.strip() == "-":
            return [_Ark(self.path)]
        found = sorted(glob.glob(os.path.join(self.path, "*.ark")) if os.path.isdir(self.path) else glob.glob(self.path))
        if not found:
            raise FileNotFoundError(self.path)
        return [_Ark(p) for p in found]

    def read(self, partition: _Ark) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(ARK_SCHEMA)
        rows: list[dict] = []
        held = 0
        with opened(partition.path, self.pipes) as file:
            for found in K.read_runs(file, self.endian):
                if isinstance(found, K.Run):
                    if rows:
                        yield _batch(rows, arrow)
                        rows, held = [], 0
                    yield _run_batch(found, partition.path, arrow)
                    continue
                key, value, offset = found
                row = {"key": key, "offset": offset, "ark": partition.path} | K.to_row(value)
                rows.append(row)
                held += row["rows"] * (row["cols"] or 1)
                if len(rows) >= 1024 or held >= 1 << 22:
                    yield _batch(rows, arrow)
                    rows, held = [], 0
            if rows:
                yield _batch(rows, arrow)


def _batch(rows: list[dict], arrow: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[f.name] for r in rows], f.type) for f in arrow], schema=arrow)


def _run_batch(run: K.Run, ark: str, arrow: pa.Schema) -> pa.RecordBatch:
    n = len(run.keys)
    ends = np.zeros(n + 1, np.int32)
    np.cumsum(run.lengths, out=ends[1:])
    have = {
        "key": pa.array(run.keys, pa.string()), "kind": pa.array(["ints" if run.arm == "i32" else "vector"] * n), "rows": pa.array(run.lengths, pa.int32()),
        "offset": pa.array(run.offsets, pa.int64()), "ark": pa.array([ark] * n), run.arm: pa.ListArray.from_arrays(pa.array(ends), pa.array(run.values), type=arrow.field(run.arm).type),
    }
    return pa.RecordBatch.from_arrays([have.get(f.name, pa.nulls(n, f.type)) for f in arrow], schema=arrow)


def _plain(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray] | None:
    """(lengths, values) of a batch of vectors of one kind without nulls, else None."""
    arms = [a for a in ("i32", "f64", "f32") if batch.column(a).null_count < len(batch)]
    if len(arms) != 1 or batch.column(arms[0]).null_count or pc.any(pc.is_in(pc.fill_null(batch.column("kind"), ""), pa.array(["matrix", "sound"]))).as_py():
        return None
    lists = batch.column(arms[0])
    values = lists.flatten()
    return None if values.null_count else (pc.list_value_length(lists).to_numpy(), values.to_numpy())


class _Writer(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        lower = {k.lower(): v for k, v in options.items()}
        self.path, self.overwrite = os.path.abspath(lower["path"]), overwrite
        self.scratch = os.path.join(self.path, f"_temporary-{uuid.uuid4().hex}")
        self.text = str(lower.get("text", "false")).lower() == "true"
        self.how = {} if self.text else {"endian": lower.get("endian", "<"), "compression_method": int(lower["compressionmethod"]) if "compressionmethod" in lower else None, "sound": lower.get("sound")}

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        context = TaskContext.get()
        name = f"part-{context.partitionId():05d}-{context.taskAttemptId()}"
        os.makedirs(self.scratch, exist_ok=True)
        at = n = 0
        with open(f"{self.scratch}/{name}.ark", "wb") as ark, open(f"{self.scratch}/{name}.scp", "w") as scp:
            for batch in (part for whole in iterator for part in parts(whole, 10_000)):
                for key, raw, start in self._records(batch):
                    ark.write(raw)
                    scp.write(f"{key} {self.path}/{name}.ark:{at + start}\n")
                    at, n = at + len(raw), n + 1
        return _Written(name, None, n)

    def _records(self, batch: pa.RecordBatch) -> Iterator[tuple[str, bytes, int]]:
        """(key, bytes of the record, where its object starts) of each row."""
        keys = batch.column("key").to_pylist()
        if not self.text and None not in keys and (plain := _plain(batch)) is not None:
            yield from zip(keys, *K.plain_records(keys, *plain, self.how["endian"]), strict=True)
            return
        for row in batch.to_pylist():
            yield row["key"], *K.record(row["key"], K.from_row(row), self.text, **self.how)

    def commit(self, messages: list[_Written | None]) -> None:
        if self.overwrite and os.path.isdir(self.path):
            for old in glob.glob(os.path.join(self.path, "part-*")):
                os.remove(old)
        for message in messages:
            if message and message.rows:
                for kind in ("ark", "scp"):
                    os.rename(f"{self.scratch}/{message.ark}.{kind}", f"{self.path}/{message.ark}.{kind}")
        shutil.rmtree(self.scratch, ignore_errors=True)

    def abort(self, messages: list[_Written | None]) -> None:
        shutil.rmtree(self.scratch, ignore_errors=True)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(KaldiArk)


# -- specifiers


def read(spark: SparkSession, rspecifier: str, segments: str | None = None, endian: str = "<", separator: str | None = None, allow_pipes: bool = False) -> DataFrame:
    """The objects of `ark:...` or `scp:...`; with a segments file, of an scp's recordings cut into segments."""
    kind, name = parse_rspecifier(rspecifier)
    if segments is not None and kind != "scp":
        raise ValueError("segments need an scp")
    if kind == "ark":
        register(spark)
        return spark.read.format("kaldi_ark").options(endian=endian, allowPipes=str(allow_pipes)).load(name)
    scp = read_scp(spark, name, separator)
    if segments is not None:
        return slice_segments(scp, read_segments(spark, segments), endian, allow_pipes)
    return fetch(scp, endian, allow_pipes)


def write(df: DataFrame, wspecifier: str, compression_method: int | None = None, endian: str = "<", order_by: str = "key") -> None:
    """One ark, and scp, of all rows in order, as the specifier says; its part files are written by tasks and joined.

    The joined file is one file, so joining is sequential copying; save with the format kaldi_ark to keep the parts.
    """
    spec = parse_wspecifier(wspecifier)
    if spec["scp"] is not None and (spec["ark"].startswith("|") or spec["ark"] == "-"):
        raise ValueError(f"{spec['ark']!r} has no offsets for an scp")
    register(df.sparkSession)
    parts = os.path.join(os.path.dirname(os.path.abspath(spec["ark"])), f"_parts-{uuid.uuid4().hex}")
    options = {"endian": endian, "text": str(spec["text"])} | ({"compressionMethod": str(compression_method)} if compression_method else {})
    try:
        df.orderBy(order_by).select("key", *VALUES, F.lit(None).cast("long").alias("offset"), F.lit(None).cast("string").alias("ark")).write.format("kaldi_ark").options(**options).mode("append").save(parts)
        at = 0
        with opened_to_write(spec["ark"]) as out, open(spec["scp"], "w") if spec["scp"] else open(os.devnull, "w") as scp:
            for part in sorted(glob.glob(f"{parts}/*.ark")):
                with open(part, "rb") as file:
                    shutil.copyfileobj(file, out, 8 << 20)
                with open(part.removesuffix("ark") + "scp") as lines:
                    for line in lines:
                        key, _, place = line.rstrip("\n").partition(" ")
                        scp.write(f"{key} {spec['ark']}:{at + int(place.rpartition(':')[2])}\n")
                at += os.path.getsize(part)
    finally:
        shutil.rmtree(parts, ignore_errors=True)


def quantised(df: DataFrame, values: str, rows: str, cols: str, method: int, to: str = "quantised") -> DataFrame:
    """df with what a compressed matrix of each row's values (array<float>) gives back."""
    from pyspark.sql.types import ArrayType, FloatType

    from ..functions.codecs.kaldi_quant import lossy

    schema = StructType([*df.schema.fields, StructField(to, ArrayType(FloatType()))])
    arrow = to_arrow_schema(schema)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [lossy(np.array(v, np.float32).reshape(r, c), method).reshape(-1) for v, r, c in zip(batch.column(values).to_pylist(), batch.column(rows).to_pylist(), batch.column(cols).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(made, arrow.field(to).type)], schema=arrow)

    return df.mapInArrow(run, schema)


__all__ = ["KaldiArk", "ReadError", "fetch", "last_of_each", "load_ark", "load_object", "opened", "opened_to_write", "quantised", "read", "read_scp", "read_segments", "register", "save_ark", "save_object", "segment_arrays", "slice_segments", "write"]
