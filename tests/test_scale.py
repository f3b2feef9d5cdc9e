"""What has to grow no faster than its input: tasks, files, connections, and rows held together."""

import io
import os

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stowage.functions.codecs import jpeg, kaldi_obj, smf
from stowage.plans import file_queries
from stowage.plans.queries import QUERIES
from stowage.sources import archive as A
from stowage.sources import kaldi, ranges, server, tables
from stowage.sources.archive import Archive

SF = "/root/testdata/sf0.001"


def texts(spark, n):
    return spark.createDataFrame([(f"t{k}", f"text {k} " * (k % 7 + 1)) for k in range(n)], "id string, item string")


@pytest.fixture
def asked(monkeypatch):
    """[connections, requests] that servers here have had."""
    counts = [0, 0]
    accept, get = server._Server.get_request, server.RangeHandler.do_GET

    def accepted(self):
        counts[0] += 1
        return accept(self)

    def got(self, *args, **more):
        counts[1] += 1
        return get(self, *args, **more)

    monkeypatch.setattr(server._Server, "get_request", accepted)
    monkeypatch.setattr(server.RangeHandler, "do_GET", got)
    return counts


def test_a_task_asks_a_server_of_its_own_by_one_connection(spark, monkeypatch, asked):
    """F1."""
    monkeypatch.setattr(file_queries, "_by_rows", lambda df, schema, work: work([{"doc_id": k} for k in range(600)]))
    monkeypatch.setattr(tables, "written", lambda found: found)
    found = QUERIES["range_server_answers"](spark, SF)
    assert [x[1:] for x in found[:6]] == [(206, 10), (206, 2), (416, 0), (200, 1000), (400, 0), (404, 0)]
    assert len(found) == 600 and asked == [1, 600] and server._Server.request_queue_size >= 1024


def test_neighbours_are_fetched_by_one_request(spark, tmp_path, asked):
    """also with a small gap between them, in which nothing is returned."""
    archive = Archive(spark, str(tmp_path / "a"), "text")
    archive.append(texts(spark, 90), order_by="id", partitions=1)
    archive.export_index(f"{archive.path}/served.parquet")
    with server.served(archive.path) as url:
        index = A.remote_index(spark, f"{url}/served.parquet", url)
        assert index.rdd.getNumPartitions() > 1
        before = asked[1]
        got = {r.id: r.text for r in ranges.decode(ranges.fetch(index.where("id not like '%7'").coalesce(1)), "text").collect()}
        assert asked[1] == before + 1
    assert got == {k: v for k, v in ((r.id, r.text) for r in archive.read().collect()) if not k.endswith("7")}


def test_a_connection_that_the_server_ended_is_made_anew(tmp_path):
    (tmp_path / "x.bin").write_bytes(bytes(range(200)))
    web = ranges.Connections()
    with server.served(str(tmp_path)) as url:
        for _ in range(3):
            reply = web.ask(f"{url}/x.bin", {"Range": "bytes=5-9"})
            assert (reply.status, reply.read()) == (206, bytes(range(5, 10)))
            next(iter(web.kept.values())).sock.shutdown(2)
    web.close()


@pytest.mark.parametrize("name", ["jpeg_archive_roundtrip", "midi_archive_window", "archive_refused_and_cleared", "compacted_archive", "text_archive_roundtrip"])
def test_archives_have_as_many_tasks_as_the_data_ask_for(spark, monkeypatch, name):
    """No fixed number."""
    how = []
    append = Archive.append
    monkeypatch.setattr(Archive, "append", lambda self, *args, **more: (how.append(more), append(self, *args, **more))[1])
    QUERIES[name](spark, SF)
    assert how and not any("partitions" in more for more in how)


def test_large_tables_are_dealt_into_more_ranges(spark, monkeypatch, tmp_path):
    """More than the session's 8, and in order."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(tables, "RANGE", 12_000)
    archive = Archive(spark, str(tmp_path / "a"), "text")
    archive.append(docs.where("text is not null"), "text", "doc_id", order_by="doc_id")
    bins = sorted((r.a, r.b) for r in archive.index().groupBy("bin_index").agg(F.min(F.col("id").cast("int")).alias("a"), F.max(F.col("id").cast("int")).alias("b")).collect())
    assert len(bins) > 16 and all(x[1] < y[0] for x, y in zip(bins, bins[1:], strict=False))


def test_jpeg_codes_take_no_table_of_all_bits():
    """F3."""
    starts, codes = jpeg._lookup(jpeg.DC_COUNTS, bytes(jpeg.DC_SYMBOLS))
    assert len(starts) == len(codes) == len(jpeg.DC_SYMBOLS) + 1
    for seed in range(4):
        image = np.random.default_rng(seed).integers(0, 256, (9, 17, 3)).astype(np.uint8)
        assert np.abs(jpeg.read(jpeg.write(image, 100)).astype(int) - image).max() <= 4


def test_rows_are_held_together_by_their_bytes():
    """few rows with much in them, before and after the work."""
    batch = pa.RecordBatch.from_pydict({"k": list(range(64)), "x": [bytes(1000)] * 64})
    assert max(p.nbytes for p in ranges.parts(batch, size=10_000)) <= 10_000
    got = list(ranges.pieces(batch, lambda rows: ({"samples": np.zeros(250_000, np.float32)} for _ in rows)))
    assert max(len(made) for _, made in got) <= 5 and [k for part, _ in got for k in part.column("k").to_pylist()] == list(range(64))


def test_notes_go_to_columns_as_arrays(spark):
    """the same as row by row, with nulls."""
    from pyspark.sql.pandas.types import to_arrow_schema

    from stowage.schemas import DECODED

    kind = to_arrow_schema(DECODED["midi"]).field("notes").type
    notes = np.zeros(5, smf.NOTE_DTYPE)
    notes["pitch"], notes["onset"], notes["is_drum"] = np.arange(5), np.arange(5) / 4, True
    dicts = [dict(zip(smf.NOTE_DTYPE.names, n, strict=True)) for n in notes.tolist()]
    assert ranges._column([notes, None, notes[:0], notes[:2]], kind).to_pylist() == [dicts, None, [], dicts[:2]]


def test_plain_tracks_are_read_alike(monkeypatch):
    """whole tracks at once, or event by event."""
    chance = np.random.default_rng(3)
    notes = np.zeros(500, smf.NOTE_DTYPE)
    notes["onset"] = np.sort(chance.random(500) * 600)
    notes["offset"], notes["pitch"], notes["velocity"] = notes["onset"] + 0.01 + chance.random(500) * 9, chance.integers(0, 128, 500), chance.integers(1, 128, 500)
    notes["program"], notes["is_drum"], notes["instrument"] = chance.integers(0, 3, 500), chance.random(500) < 0.2, chance.integers(0, 3, 500)
    song = smf.song_of(smf.canonical(notes), names={0: "a", 1: "b", 2: "c"})
    song.instruments[0].controls, song.instruments[0].bends = [(0.5, 64, 127), (400.0, 64, 0)], [(1.0, -8192), (2.0, 8191)]
    raw = smf.write(song)
    found = smf.parse(raw)
    monkeypatch.setattr(smf, "_plain", lambda *_: None)
    assert smf.parse(raw) == found and sum(len(i.notes) for i in found.instruments) > 400


def test_no_object_file_is_cut_and_written_again(spark, monkeypatch):
    """each is a new file, the last one stays."""
    rows = [{"vec_id": k, "embedding": [float(k + j) for j in range(64)]} for k in range(20)]
    saved, save = [], kaldi.save_object

    def checked(name, value):
        assert not os.path.exists(name)
        saved.append(name)
        save(name, value)

    monkeypatch.setattr(kaldi, "save_object", checked)
    monkeypatch.setattr(file_queries, "_by_rows", lambda df, schema, work: work(rows))
    found = QUERIES["objects_by_name"](spark, SF)
    assert [(x[0], x[3]) for x in found] == [(r["vec_id"], r["embedding"]) for r in rows] and len(saved) == 20 and os.path.exists(saved[-1])


@pytest.mark.parametrize("endian", ["<", ">"])
def test_plain_vectors_of_an_ark_in_runs(endian):
    """the same records and objects as one by one, other kinds between them."""
    lengths = np.arange(200) % 5
    records = []
    for kind in (np.int32, np.float32, np.float64):
        values = np.arange(lengths.sum()).astype(kind)
        made, starts = kaldi_obj.plain_records([f"k{k}" for k in range(200)], lengths, values, endian)
        ends = np.cumsum(lengths)
        assert list(zip(made, starts, strict=True)) == [kaldi_obj.record(f"k{k}", values[e - n : e], endian=endian) for k, (n, e) in enumerate(zip(lengths, ends, strict=True))]
        records += [*made, kaldi_obj.record("m", np.eye(3), endian=endian)[0], b"t [ 1 2 ]\n"]
    raw, got = b"".join(records), []
    runs = [x for x in kaldi_obj.read_runs(io.BytesIO(raw), endian)]
    for found in runs:
        if isinstance(found, kaldi_obj.Run):
            parts = np.split(found.values, np.cumsum(found.lengths)[:-1])
            got += zip(found.keys, parts, found.offsets, strict=True)
        else:
            got.append(found)
    want = list(kaldi_obj.read_ark(io.BytesIO(raw), endian))
    assert [(k, v.tolist(), v.dtype, at) for k, v, at in got] == [(k, v.tolist(), v.dtype, at) for k, v, at in want] and len(runs) == 9
    with pytest.raises(Exception, match="another size"):
        list(kaldi_obj.read_runs(io.BytesIO(b"a \0B\4\1\0\0\0\3\1\0\0\0")))


def test_many_bins_are_moved_by_tasks(spark, tmp_path, monkeypatch):
    """F16: none by the driver, and a failed move leaves all as it was."""
    monkeypatch.setattr(A, "FEW", 0)
    monkeypatch.setattr(A, "MANY", 7)
    archive = Archive(spark, str(tmp_path / "a"), "text", max_bin_size=1)
    here, rename = [], os.rename
    monkeypatch.setattr(os, "rename", lambda a, b: (here.append(a), rename(a, b))[1])
    archive.append(texts(spark, 40), order_by="id", partitions=3)
    want = {r.id: r.text for r in archive.read().collect()}
    index, bins = {tuple(r) for r in archive.index().collect()}, sorted(p for p in os.listdir(archive.path))
    monkeypatch.setattr(A, "_removed", lambda *_: None)

    def refused(a, b):
        if a.endswith("metadata.parquet"):
            raise OSError("no")
        rename(a, b)

    monkeypatch.setattr(os, "rename", refused)
    with pytest.raises(OSError):
        archive.compact(300)
    assert {tuple(r) for r in archive.index().collect()} == index and sorted(os.listdir(archive.path)) == bins
    monkeypatch.setattr(os, "rename", lambda a, b: (here.append(a), rename(a, b))[1])
    archive.compact(300)
    assert {r.id: r.text for r in archive.read().collect()} == want and not [p for p in here if p.endswith(".bin")]
    assert 1 < archive.summary().first().n_bins < 20 and A._runs(np.array([0, 1, 2, 5, 6, 9])) == [(0, 3), (5, 2), (9, 1)]
