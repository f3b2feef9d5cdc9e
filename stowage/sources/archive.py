"""Archives: a folder of bins with an index of byte ranges.

The index, metadata.parquet, is a folder with one folder of Parquet files for each append, so an append adds to it
by a single rename and never writes old rows again. A single Parquet file of that name is read too and taken
into the folder form by the first append. Bins and index rows are written by executors to a folder of the append's own;
the bins are renamed, by tasks if they are many, and then the index, and a failed append leaves the archive as it was. Paths have to be
on a file system that the driver and the executors share.
"""

from __future__ import annotations

import os
import shutil
import uuid
import warnings
from collections.abc import Callable, Iterable, Iterator
from contextlib import suppress

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import SkippedItemsWarning
from ..functions import columns
from ..functions.codecs import registry
from ..operators.batching import numbered
from ..operators.packing import MAX_BIN_SIZE, fold
from ..schemas import check_modality, index_schema, normalised
from .ranges import decode, fetch, parts
from .tables import in_ranges, local_folder, written

INDEX = "metadata.parquet"


def index_path(path: str) -> str:
    """The index of an archive's folder, or the index itself."""
    return path if path.endswith(".parquet") else f"{path.rstrip('/')}/{INDEX}"


def read_index(spark: SparkSession, path: str, modality: str | None = None) -> DataFrame:
    """An archive's index; with a modality, columns it lacks are null and all are of their declared types."""
    if "://" not in path and not os.path.exists(index_path(path)):
        raise FileNotFoundError(index_path(path))
    df = spark.read.option("mergeSchema", "true").parquet(index_path(path))
    df = df.drop("append")
    return normalised(df, modality) if modality else df


def with_base(index: DataFrame, base_url: str) -> DataFrame:
    """An index whose paths are under another folder or URL."""
    return index.withColumn("path", columns.bin_path(base_url, F.col("bin_index")))


def remote_index(spark: SparkSession, path: str, base_url: str | None = None) -> DataFrame:
    """The index of an archive served at a URL, paths rewritten to it (or to base_url); a Hugging Face repository as hub:name. The index is copied to the shared folder."""
    if path.startswith("hub:"):
        base = columns.hub_base(path[4:])
        return with_base(remote_index(spark, base), base_url or base)
    if not path.startswith(("http://", "https://")):
        return with_base(read_index(spark, path), base_url) if base_url else read_index(spark, path)
    import urllib.request

    copy = f"{local_folder(spark)}/index-{uuid.uuid4().hex}.parquet"
    os.makedirs(os.path.dirname(copy), exist_ok=True)
    with urllib.request.urlopen(index_path(path)) as reply, open(copy, "wb") as file:
        shutil.copyfileobj(reply, file, 8 << 20)
    base = base_url or path.removesuffix(INDEX).rstrip("/")
    index = with_base(spark.read.parquet(f"file://{copy}"), base)
    # the file has few splits for what its rows lead to, so they are dealt out, neighbours together
    return index.repartition(4 * spark.sparkContext.defaultParallelism, "bin_index", F.shiftright("start_byte", 20))


class Archive:
    """An archive of one modality; its folder is made by the first append."""

    def __init__(self, spark: SparkSession, path: str, modality: str, name: str | None = None, max_bin_size: int = MAX_BIN_SIZE):
        self.spark, self.path, self.modality = spark, os.path.abspath(path), check_modality(modality)
        self.name = name or os.path.basename(self.path)
        self.max_bin_size = max_bin_size

    # -- reading

    def exists(self) -> bool:
        return os.path.exists(index_path(self.path))

    def index(self) -> DataFrame:
        return read_index(self.spark, self.path, self.modality)

    def __len__(self) -> int:
        return self.index().count() if self.exists() else 0

    def read(self, where: Column | str | None = None, ids: Iterable[str] | None = None, columns_: Iterable[str] | None = None, skip_errors: bool = False, window: tuple[str, ...] = (), **options) -> DataFrame:
        """Decoded items beside their index columns. Only bytes of items that pass where and ids are read."""
        chosen = self.index()
        if where is not None:
            chosen = chosen.where(where)
        if ids is not None:
            chosen = chosen.where(F.col("id").isin(list(ids)))
        if columns_ is not None:
            chosen = chosen.select(*{"path": 0, "start_byte": 0, "end_byte": 0, **dict.fromkeys([*columns_, *window])})
        return decode(fetch(chosen, "__payload"), self.modality, "__payload", skip_errors, window, **options)

    def summary(self) -> DataFrame:
        """n_items, n_bins and total_bytes, in one row."""
        return summary(self.index())

    def export_index(self, path: str) -> None:
        """The index as a single Parquet file, for servers and for readers of remote_index; one task writes it."""
        made = f"{path}-{uuid.uuid4().hex}"
        try:
            self.index().coalesce(1).write.option("parquet.block.size", 4 << 20).parquet(made)
            os.replace(next(f"{made}/{name}" for name in os.listdir(made) if name.endswith(".parquet") and not name.startswith(".")), path)
        finally:
            shutil.rmtree(made, ignore_errors=True)

    def counts(self, column: str) -> DataFrame:
        return self.index().groupBy(column).agg(F.count("*").alias("n_items"))

    # -- writing

    def next_bin(self) -> int:
        """One more than the largest number of a bin."""
        return self.index().agg(F.coalesce(F.max("bin_index") + 1, F.lit(0))).first()[0] if self.exists() else 0

    def append(self, df: DataFrame, item: str = "item", id_col: str | None = "id", order_by: str | None = None, keep: Iterable[str] = (), allow_duplicate_ids: bool = False, skip_errors: bool = False, reshard: bool = False, partitions: int | None = None, progress: Observation | None = None, **options) -> DataFrame:
        """Encode and store the items of df; the rows (id, error) that were left out.

        progress is told how many items were read (items), whether they fail or not.

        Ids twice in df are an error before anything is written. Ids that the archive has are left out with a warning,
        unless allowed. Without id_col ids are name_0, name_1, ... from the archive's length on, in order of order_by,
        which has to be given then. Items are encoded and packed by partition: those that df has, or ranges of order_by
        if there is one, as many as the size of df asks for, or so many partitions as are said. Each partition has its
        own bins, and reshard joins small ones. keep names columns that go to the index. An
        item that cannot be encoded fails the append and nothing is kept, or is left out if skip_errors.
        """
        if id_col is None:
            if order_by is None:
                raise ValueError("ids in order need order_by")
            df = numbered(df, order_by, "__row", len(self)).withColumn("id", F.concat(F.lit(f"{self.name}_"), F.col("__row").cast("string")))
        else:
            df = df.withColumn("id", F.col(id_col).cast("string"))
        twice = df.groupBy("id").count().where("count > 1").limit(1).collect()
        if twice:
            raise ValueError(f"the id {twice[0].id!r} is there more than once")
        if self.exists() and not allow_duplicate_ids:
            known = self.index().select("id")
            held = df.join(known, "id", "left_semi").count()
            if held:
                warnings.warn(f"{held} ids are in the archive already and are left out", SkippedItemsWarning, stacklevel=2)
                df = df.join(known, "id", "left_anti")
        if partitions:
            df = df.repartition(partitions, "id") if order_by is None else df.repartitionByRange(partitions, order_by)
        elif order_by:
            df = in_ranges(df, order_by)
        if order_by:
            df = df.sortWithinPartitions(order_by)
        if progress is not None:
            df = df.observe(progress, F.count(F.lit(1)).alias("items"))
        scratch = os.path.join(self.path, f"_temporary-{uuid.uuid4().hex}")
        os.makedirs(scratch)
        try:
            return self._commit(self._stored(df, item, tuple(keep), scratch, skip_errors, options), scratch, reshard)
        finally:
            shutil.rmtree(scratch, ignore_errors=True)

    def _stored(self, df: DataFrame, item: str, keep: tuple[str, ...], scratch: str, skip_errors: bool, options: dict) -> list[dict]:
        """Write task files; what each task has written: (task, number of bins, whether it has a failures file)."""
        source = df.select("id", F.col(item).alias("__item"), *keep)
        fields = index_schema(self.modality)
        fields = type(fields)(fields.fields + [df.schema[c] for c in keep if c not in fields.names])
        arrow, most, modality = to_arrow_schema(fields), self.max_bin_size, self.modality

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            context = TaskContext.get()
            task = f"{context.partitionId()}-{context.taskAttemptId()}"
            rows, failed, bins, held, out = [], [], 0, 0, None
            os.makedirs(f"{scratch}/{task}")  # a folder of its own, as tasks that make files in one wait for one another
            writer = pq.ParquetWriter(f"{scratch}/index-{task}.parquet", arrow)

            def flush() -> None:
                if rows:
                    writer.write_table(pa.Table.from_pylist(rows, arrow))
                    rows.clear()

            try:
                for row in (row for batch in batches for part in parts(batch) for row in part.to_pylist()):
                    try:
                        payload, meta = registry.encode(modality, row.pop("__item"), **options)
                    except Exception as error:
                        if not skip_errors:
                            raise
                        failed.append({"id": row["id"], "error": f"{type(error).__name__}: {error}"})
                        continue
                    if out is None or (held and held + len(payload) > most):
                        if out is not None:
                            out.close()
                        out = open(f"{scratch}/{task}/{bins}.bin", "wb")
                        bins, held = bins + 1, 0
                    out.write(payload)
                    rows.append(meta | row | {"start_byte": held, "end_byte": held + len(payload), "bin_index": bins - 1, "path": ""})
                    held += len(payload)
                    if len(rows) >= 10_000:
                        flush()
                flush()
            finally:
                writer.close()
                if out is not None:
                    out.close()
            if failed:
                pq.write_table(pa.Table.from_pylist(failed, pa.schema([("id", pa.string()), ("error", pa.string())])), f"{scratch}/failed-{task}.parquet")
            yield pa.RecordBatch.from_arrays([pa.array([task]), pa.array([bins]), pa.array([bool(failed)])], ["task", "bins", "failed"])

        # one small row for each task: its name and how many bins it has written
        found = source.mapInArrow(run, "task string, bins long, failed boolean").collect()
        return sorted((r.asDict() for r in found), key=lambda r: int(r["task"].partition("-")[0]))

    def _commit(self, tasks: list[dict], scratch: str, reshard: bool) -> DataFrame:
        """Number and rename the bins, then put the index rows of all tasks in place by one rename."""
        placed, number = [], self.next_bin()
        for task in tasks:
            if task["bins"]:
                placed.append((task["task"], number, task["bins"]))
                number += task["bins"]
        failed = [f"{scratch}/failed-{t['task']}.parquet" for t in tasks if t["failed"]]
        left = self.spark.createDataFrame([], "id string, error string")
        if failed:  # any number of rows, so a table that outlives the append's own folder; some are shown
            left = written(self.spark.read.schema(left.schema).parquet(*failed))
            shown = ", ".join(f"{r.id} ({r.error})" for r in left.orderBy("id").limit(5).collect())
            warnings.warn(f"{left.count()} items could not be encoded and are left out: {shown}", SkippedItemsWarning, stacklevel=4)
        if not placed:
            return left
        numbers = self.spark.createDataFrame([(task, n) for task, n, _ in placed], "__task string, __first long")
        own = self.spark.read.parquet(*[f"{scratch}/index-{task}.parquet" for task, *_ in placed])
        own = own.withColumn("__task", F.regexp_extract(F.input_file_name(), r"index-([0-9]+-[0-9]+)\.parquet", 1))
        made = own.join(F.broadcast(numbers), "__task").withColumn("bin_index", F.col("__first") + F.col("bin_index"))
        made.withColumn("path", columns.bin_path(self.path, F.col("bin_index"))).drop("__task", "__first").write.parquet(f"{scratch}/index")
        moves = [(f"{scratch}/{task}/", 0, f"{self.path}/blob_", n, bins) for task, n, bins in placed]
        try:
            _renamed(self.spark, moves)
            self._add_index(f"{scratch}/index")
        except BaseException:
            _renamed(self.spark, _undone(moves))
            raise
        if reshard:
            self.compact()
        return left

    def _add_index(self, folder: str) -> None:
        target = index_path(self.path)
        if os.path.isfile(target):  # an index of one file becomes the first append
            os.makedirs(f"{target}-new/append=0")
            shutil.copy(target, f"{target}-new/append=0/part-0.parquet")
            os.rename(target, f"{target}-old")
            os.rename(f"{target}-new", target)
            os.remove(f"{target}-old")
        os.makedirs(target, exist_ok=True)
        number = 1 + max([int(d.partition("=")[2]) for d in os.listdir(target) if d.startswith("append=")], default=-1)
        os.rename(folder, f"{target}/append={number}")

    def compact(self, max_bin_size: int | None = None) -> None:
        """Join bins, in their order, while they fit; items' bytes stay as they are and their offsets follow.

        New bins are written by one task each, the index anew beside the old one; then both are put in place.
        """
        sizes = self.index().groupBy("bin_index").agg(F.max("end_byte").alias("n")).orderBy("bin_index").toArrow()
        olds, lengths = (sizes.column(c).to_numpy() for c in ("bin_index", "n"))
        folded = (x for new, base, _ in fold(lengths.tolist(), max_bin_size or self.max_bin_size) for x in (new, base))
        news, bases = np.fromiter(folded, np.int64, 2 * len(olds)).reshape(-1, 2).T
        if (olds == news).all():
            return
        path, scratch, n_new = self.path, os.path.join(self.path, f"_temporary-{uuid.uuid4().hex}"), int(news[-1]) + 1
        os.makedirs(scratch)
        plan = self.spark.createDataFrame(pa.table({"old": olds, "new": np.ascontiguousarray(news), "base": np.ascontiguousarray(bases)}))

        def join(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for new, olds in zip(batch.column("new").to_pylist(), batch.column("olds").to_pylist(), strict=True):
                    name = f"{scratch}/{new}-{TaskContext.get().taskAttemptId()}"
                    with open(name, "wb") as out:
                        for old in olds:
                            with open(f"{path}/blob_{old}.bin", "rb", buffering=0) as file:
                                while data := file.read(min(8 << 20, os.fstat(file.fileno()).st_size + 1)):
                                    out.write(data)
                    os.replace(name, f"{scratch}/blob_{new}.bin")
                yield pa.RecordBatch.from_arrays([batch.column("new")], ["new"])

        # old bins whose names new ones take are moved away; the others stay in place until none of their rows is left
        away = [(f"{path}/blob_", first, f"{scratch}/old_", first, n) for first, n in _runs(olds[olds < n_new])]
        into = [(f"{scratch}/blob_", 0, f"{path}/blob_", 0, n_new)]
        try:
            joined = plan.groupBy("new").agg(F.sort_array(F.collect_list("old")).alias("olds"))
            tasks = max(4 * self.spark.sparkContext.defaultParallelism, int(lengths.sum()) >> 26)
            joined.repartition(min(n_new, tasks)).mapInArrow(join, "new long").write.format("noop").mode("overwrite").save()
            index = self.index().join(plan, F.col("bin_index") == F.col("old"))
            index = index.withColumns({"start_byte": F.col("start_byte") + F.col("base"), "end_byte": F.col("end_byte") + F.col("base"), "bin_index": F.col("new"), "path": columns.bin_path(path, F.col("new"))})
            index.drop("old", "new", "base").write.parquet(f"{scratch}/index/append=0")
            begun = []
            try:
                for moves in (away, into):
                    begun.append(moves)
                    _renamed(self.spark, moves)
                os.rename(index_path(path), f"{scratch}/old_index")
                os.rename(f"{scratch}/index", index_path(path))
            except BaseException:
                if not self.exists():
                    os.rename(f"{scratch}/old_index", index_path(path))
                for moves in reversed(begun):
                    _renamed(self.spark, _undone(moves))
                raise
            _removed(self.spark, [(f"{scratch}/old_", first, n) for *_, first, n in away] + [(f"{path}/blob_", first, n) for first, n in _runs(olds[olds >= n_new])])
        finally:
            shutil.rmtree(scratch, ignore_errors=True)

    def clear(self, confirm: bool = False) -> None:
        """Delete the index and all bins it names."""
        if not confirm:
            raise ValueError("clear(confirm=True) deletes the archive's items")
        if self.exists():
            bins = self.index().select("bin_index").distinct().orderBy("bin_index").toArrow().column(0).to_numpy()
            target = index_path(self.path)
            shutil.rmtree(target) if os.path.isdir(target) else os.remove(target)
            _removed(self.spark, [(f"{self.path}/blob_", first, n) for first, n in _runs(bins)])


#: Files that the driver renames or removes by itself, and that one task does when there are more.
FEW, MANY = 1000, 5000


def _runs(numbers: np.ndarray) -> list[tuple[int, int]]:
    """(first, how many) of each run of consecutive numbers, which are in order."""
    breaks = np.flatnonzero(np.diff(numbers) != 1) + 1
    return [(int(run[0]), len(run)) for run in np.split(numbers, breaks) if len(run)]


def _by_tasks(spark: SparkSession, moves: list[tuple], work: Callable[[tuple], None]) -> None:
    """work on each of moves, whose last value says how many files it is of: here if they are few, else by tasks."""
    if sum(m[-1] for m in moves) <= FEW:
        for move in moves:
            work(move)
        return
    made = [(*[x + at if isinstance(x, int) else x for x in m[:-1]], min(MANY, m[-1] - at)) for m in moves for at in range(0, m[-1], MANY)]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                work(tuple(row.values()))
            yield batch

    names = [f"c{k}" for k in range(len(made[0]))]
    columns_ = {name: pa.array(column) for name, column in zip(names, zip(*made, strict=True), strict=True)}
    tasks = spark.createDataFrame(pa.table(columns_)).repartition(min(len(made), 10_000))
    tasks.mapInArrow(run, tasks.schema).write.format("noop").mode("overwrite").save()


def _renamed(spark: SparkSession, moves: list[tuple[str, int, str, int, int]]) -> None:
    """Rename files, each move being (old name, first number, new name, first number, how many); those renamed already stay."""

    def rename(move: tuple) -> None:
        old, a, new, b, n = move
        for k in range(n):
            try:
                os.rename(f"{old}{a + k}.bin", f"{new}{b + k}.bin")
            except FileNotFoundError:
                if not os.path.exists(f"{new}{b + k}.bin"):
                    raise

    _by_tasks(spark, moves, rename)


def _undone(moves: list[tuple[str, int, str, int, int]]) -> list[tuple[str, int, str, int, int]]:
    return [(new, b, old, a, n) for old, a, new, b, n in moves]


def _removed(spark: SparkSession, runs: list[tuple[str, int, int]]) -> None:
    """Remove files (name, first number, how many), if they are there."""

    def remove(run: tuple) -> None:
        name, first, n = run
        for k in range(first, first + n):
            with suppress(FileNotFoundError):
                os.remove(f"{name}{k}.bin")

    _by_tasks(spark, runs, remove)


def summary(index: DataFrame) -> DataFrame:
    return index.agg(F.count("*").alias("n_items"), F.countDistinct("bin_index").alias("n_bins"), F.coalesce(F.sum(F.col("end_byte") - F.col("start_byte")), F.lit(0)).alias("total_bytes"))


def union_by_name(first: DataFrame, *others: DataFrame) -> DataFrame:
    """Indexes behind one another; columns that one lacks are null in its rows."""
    for other in others:
        first = first.unionByName(other, allowMissingColumns=True)
    return first


def without_known(df: DataFrame, known: DataFrame, key: str = "id") -> DataFrame:
    """Rows of df whose key is not in known."""
    return df.join(known.select(key), key, "left_anti")


def ordinal_ids(df: DataFrame, name: str, order_by: str, start: int = 0) -> DataFrame:
    """df with ids name_0, name_1, ... in an order."""
    return numbered(df, order_by, "__row", start).withColumn("id", F.concat(F.lit(f"{name}_"), F.col("__row").cast("string"))).drop("__row")


def row_at(index: DataFrame, ordinal: int, order_by: str) -> DataFrame:
    """The row at a place, from 0, in an order; no row beyond the last."""
    return numbered(index, order_by, "__row").where(F.col("__row") == ordinal).drop("__row")
