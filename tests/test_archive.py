import os
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.errors import ReadError, SkippedItemsWarning
from stowage.functions.codecs import wav
from stowage.operators.batching import numbered, pad_collate, text_collate
from stowage.operators.packing import compaction, fold, packed
from stowage.sources import archive as A
from stowage.sources.archive import Archive
from stowage.sources.ranges import Ranges, decode, fetch
from stowage.sources.server import server
from stowage.streaming.append import append_stream, windowed_counts


def texts(spark, n, start=0):
    return spark.createDataFrame([(f"t{k}", f"text {k} " * (k % 7 + 1)) for k in range(start, start + n)], "id string, item string")


def contents(archive):
    return {r.id: r.text for r in archive.read().collect()}


def check_bins(archive, most):
    """Ranges of a bin are disjoint, start at 0, and only a single item may be larger than a bin."""
    by_bin = {}
    for r in archive.index().collect():
        assert os.path.basename(r.path) == f"blob_{r.bin_index}.bin"
        by_bin.setdefault(r.bin_index, []).append((r.start_byte, r.end_byte))
    for number, ranges in by_bin.items():
        ranges.sort()
        assert ranges[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ranges, ranges[1:], strict=False))
        size = os.path.getsize(f"{archive.path}/blob_{number}.bin")
        assert ranges[-1][1] == size and (size <= most or len(ranges) == 1)
    assert sorted(by_bin) == list(range(len(by_bin)))


def test_append_twice_and_compact(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "a"), "text", max_bin_size=200)
    assert len(archive) == 0
    archive.append(texts(spark, 30), order_by="id", partitions=3)
    first = contents(archive)
    with pytest.warns(SkippedItemsWarning, match="10 ids"):
        archive.append(texts(spark, 30, 20))
    got = contents(archive)
    assert len(archive) == 50 and {k: got[k] for k in first} == first and got["t49"] == "text 49 " * (49 % 7 + 1)
    check_bins(archive, 200)
    bins = archive.summary().first()
    assert bins.n_items == 50 and bins.total_bytes == sum(os.path.getsize(p) for p in (tmp_path / "a").glob("*.bin"))
    archive.compact(1 << 20)
    assert contents(archive) == got and archive.summary().first().n_bins == 1
    check_bins(archive, 1 << 20)
    assert not [p for p in os.listdir(tmp_path / "a") if p.startswith("_")]
    with pytest.raises(ValueError):
        archive.clear()
    archive.clear(confirm=True)
    assert os.listdir(tmp_path / "a") == []


def test_one_bin_for_each_item(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "a"), "text", max_bin_size=1)
    archive.append(texts(spark, 5), partitions=2)
    rows = archive.index().collect()
    assert {r.start_byte for r in rows} == {0} and len({r.bin_index for r in rows}) == 5


def test_reshard_gives_the_same_items(spark, tmp_path):
    plain, dense = Archive(spark, str(tmp_path / "a"), "text", max_bin_size=400), Archive(spark, str(tmp_path / "b"), "text", max_bin_size=400)
    plain.append(texts(spark, 40), order_by="id", partitions=4)
    dense.append(texts(spark, 40), order_by="id", partitions=4, reshard=True)
    assert contents(plain) == contents(dense)
    check_bins(dense, 400)
    assert dense.summary().first().n_bins <= plain.summary().first().n_bins


def test_ids(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "docs"), "text")
    archive.append(texts(spark, 12), id_col=None, order_by="id")
    archive.append(texts(spark, 3), id_col=None, order_by="id")
    assert {r.id for r in archive.index().collect()} == {f"docs_{k}" for k in range(15)}
    with pytest.raises(ValueError, match="more than once"):
        archive.append(texts(spark, 2).union(texts(spark, 1)))
    archive.append(texts(spark, 1).withColumn("id", F.lit("docs_0")), allow_duplicate_ids=True)
    assert archive.index().where("id = 'docs_0'").count() == 2


def test_error_policies(spark, tmp_path):
    sound = wav.write(np.zeros(100), 8000, 16)
    items = [(k, bytearray(b"this is not audio" if k in "bd" else sound)) for k in "abcde"]
    df = spark.createDataFrame(items, "id string, item binary")
    archive = Archive(spark, str(tmp_path / "a"), "audio")
    with pytest.raises(Exception, match="no audio item"):
        archive.append(df)
    assert not archive.exists() and os.listdir(tmp_path / "a") == []
    with pytest.warns(SkippedItemsWarning, match="2 items"):
        failed = archive.append(df, skip_errors=True).collect()
    assert [r.id for r in failed] == ["b", "d"] and all(r.error.startswith("ReadError: ") for r in failed)
    assert {r.id for r in archive.index().collect()} == {"a", "c", "e"}
    before = {p: (tmp_path / "a" / p).stat().st_mtime_ns for p in os.listdir(tmp_path / "a")}
    with pytest.raises(Exception, match="no audio item"):
        archive.append(df.withColumn("id", F.concat("id", F.lit("2"))))
    assert before == {p: (tmp_path / "a" / p).stat().st_mtime_ns for p in os.listdir(tmp_path / "a")}


def test_audio_windows_by_row(spark, tmp_path):
    tone = (np.arange(8000) % 1000 - 500).astype(np.int16)
    df = spark.createDataFrame([("x", bytearray(wav.write(tone, 8000)))], "id string, item binary")
    archive = Archive(spark, str(tmp_path / "a"), "audio")
    archive.append(df, target_format="flac")
    windows = spark.createDataFrame([("x", 0.0, 0.5), ("x", 0.25, 0.3), ("x", 0.9, 2.0)], "id string, start_time double, end_time double")
    got = decode(fetch(archive.index().join(windows, "id")), "audio", window=("start_time", "end_time"))
    assert {(r.start_time, r.frames) for r in got.select("start_time", "frames").collect()} == {(0.0, 4000), (0.25, 400), (0.9, 800)}
    with pytest.raises(Exception, match="ReadError"):
        fetch(archive.index().withColumn("end_byte", F.col("end_byte") + 1)).collect()


def test_filters_reach_the_index(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "a"), "text")
    archive.append(texts(spark, 20))
    plan = archive.read("original_size > 20", columns_=["id"])._jdf.queryExecution().toString()
    assert "GreaterThan(original_size,20)" in plan
    assert archive.read(ids=["t3"], columns_=["id"]).first().text == "text 3 " * 4


def test_schemas_merge(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "a"), "text")
    archive.append(texts(spark, 2))
    archive.append(texts(spark, 2, 2).withColumn("label", F.lit(7)), keep=("label",))
    assert {r.id: r.label for r in archive.index().collect()} == {"t0": None, "t1": None, "t2": 7, "t3": 7}
    with pytest.raises(FileNotFoundError):
        A.read_index(spark, str(tmp_path / "none"))


def test_ranges_over_http(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "a"), "text")
    archive.append(texts(spark, 10))
    running = server(str(tmp_path / "a"))
    threading.Thread(target=running.serve_forever, daemon=True).start()
    url = f"http://127.0.0.1:{running.server_address[1]}"
    try:
        remote = A.with_base(archive.index(), url)
        got = {r.id: r.text for r in decode(fetch(remote), "text").collect()}
        assert got == contents(archive)
        ranges = Ranges()
        path = archive.index().first().path
        assert ranges.read(f"{url}/{os.path.basename(path)}", 3, 9) == ranges.read(path, 3, 9)
        for bad in (f"{url}/none.bin", f"{url}/../secret"):
            with pytest.raises(ReadError):
                ranges.read(bad, 0, 4)
        with pytest.raises(ReadError, match="416"):
            ranges.read(f"{url}/blob_0.bin", 10**9, 10**9 + 5)
    finally:
        running.shutdown()
        running.server_close()


def test_hub_paths(spark):
    df = spark.createDataFrame([(0,), (1,)], "bin_index long")
    assert [r.path for r in A.with_base(df, "http://localhost:8000/").orderBy("bin_index").collect()] == ["http://localhost:8000/blob_0.bin", "http://localhost:8000/blob_1.bin"]


def test_packing():
    sizes = [5, 5, 1, 20, 0, 3, 9]
    assert list(fold(sizes, 10)) == [(0, 0, 5), (0, 5, 10), (1, 0, 1), (2, 0, 20), (3, 0, 0), (3, 0, 3), (4, 0, 9)]
    assert compaction([(0, 4), (1, 4), (2, 4)], 8) == [(0, 0, 0), (1, 0, 4), (2, 1, 0)]


def test_packed_frame(spark):
    df = spark.createDataFrame([(k, 10) for k in range(100)], "k long, size long")
    rows = packed(df, "size", "k", 95).orderBy("k").collect()
    assert [(r.bin_index, r.start_byte) for r in rows] == [(k // 9, k % 9 * 10) for k in range(100)]


def test_packed_frame_with_ties_and_nulls(spark):
    """Every row comes out once; equal orders by size, then by the other columns, nulls first, a null size is 0."""
    rows = [(1, 30, "b"), (1, 30, "a"), (1, 10, "c"), (None, 5, "d"), (None, None, "e"), (2, 60, "f"), (2, 60, "f")]
    made = packed(spark.createDataFrame(rows, "k long, size long, name string"), "size", "k", 70).collect()
    got = sorted((r.bin_index, r.start_byte, r.end_byte, r.name) for r in made)
    assert got == [(0, 0, 0, "e"), (0, 0, 5, "d"), (0, 5, 15, "c"), (0, 15, 45, "a"), (1, 0, 30, "b"), (2, 0, 60, "f"), (3, 0, 60, "f")]
    assert packed(spark.createDataFrame([], "k long, size long"), "size", "k", 70).count() == 0


def test_batches(spark):
    df = spark.createDataFrame([(k, [float(k)] * (k % 4), f"x{k}") for k in range(11)], "k long, v array<float>, t string")
    assert sorted((r.k, r.row) for r in numbered(df, "k", start=5).collect()) == [(k, k + 5) for k in range(11)]
    made = {r.batch: r for r in pad_collate(df, "v", 4, "k", label="t").collect()}
    assert [len(x) for x in made[0]["items"]] == [3] * 4 and made[0].lengths == [0, 1, 2, 3] and made[2].labels == ["x8", "x9", "x10"]
    assert [len(x) for x in made[2]["items"]] == [2] * 3
    assert {r.batch: r.texts for r in text_collate(df, "t", 6, "k").collect()}[1] == ["x6", "x7", "x8", "x9", "x10"]


def test_streaming_append(spark, tmp_path):
    source = str(tmp_path / "in")
    texts(spark, 10).write.parquet(source)
    archive = Archive(spark, str(tmp_path / "a"), "text")
    for _ in range(2):
        stream = spark.readStream.schema("id string, item string").parquet(source)
        append_stream(stream, archive, str(tmp_path / "check"), available_now=True).awaitTermination()
        texts(spark, 5, 8).write.mode("append").parquet(source)
    assert len(contents(archive)) == 13


def test_windowed_counts(spark):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    made = windowed_counts(events)
    assert made.agg(F.sum("n_events")).first()[0] == events.count()


def test_blob_source(spark, tmp_path):
    from stowage.sources.datasource import register

    archive = Archive(spark, str(tmp_path / "a"), "text", max_bin_size=100)
    archive.append(texts(spark, 20))
    register(spark)
    raw = spark.read.format("blob").load(str(tmp_path / "a"))
    assert raw.rdd.getNumPartitions() == archive.summary().first().n_bins
    assert {r.id: r.text for r in decode(raw, "text").collect()} == contents(archive)
