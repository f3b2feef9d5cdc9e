"""What runs on one machine: windows, Kaldi readers and writers, data sets, and images by the JVM."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from stowage.errors import ReadError
from stowage.functions import windows as W
from stowage.functions.codecs import png, registry, wav
from stowage.operators.datasets import Dataset
from stowage.sources.archive import Archive
from stowage.sources.images import read_images
from stowage.sources.kaldi_files import Reader, Scp, Writer

FEATS = np.random.default_rng(0).normal(size=(5, 3)).astype(np.float32)


def test_windows():
    assert W.pcm_window(0.137, 8.913, 16000, 160000) == (2192, 142608) and W.pcm_window(-1, None, 8000, 10) == (0, 10) and W.pcm_window(2, 1, 8, 100) == (16, 16)


def test_windows_as_expressions(spark):
    data = np.arange(40, dtype=np.float32)
    df = spark.createDataFrame([(data.tolist(), 2, 10, s, e) for s, e in ((0.0, None), (0.55, 1.2), (-3.0, 0.5), (1.0, 0.5), (9.0, 12.0))], "x array<float>, c int, r int, s double, e double")
    for row in df.withColumn("cut", W.sliced_samples(*(F.col(c) for c in "xcrse"))).collect():
        first, last = W.pcm_window(row.s, row.e, 10, 20)
        assert row.cut == data.reshape(-1, 2)[first:last].reshape(-1).tolist()


def test_reader_and_writer(tmp_path):
    ark, scp = f"{tmp_path}/a.ark", f"{tmp_path}/a.scp"
    with Writer(f"ark,scp,f:{ark},{scp}") as writer:
        for k in range(4):
            writer[f"u{k}"] = FEATS + k
        with pytest.raises(TypeError):
            writer[3] = FEATS
    with pytest.raises(ValueError):
        writer["late"] = FEATS
    for spec in (f"ark:{ark}", f"scp:{scp}"):
        with Reader(spec) as reader:
            got = dict(reader)
        assert list(got) == ["u0", "u1", "u2", "u3"] and (got["u2"] == FEATS + 2).all()
    index = Scp(scp)
    assert len(index) == 4 and "u3" in index and "x" not in index and (index["u1"] == FEATS + 1).all()
    with Writer(f"ark,t:{tmp_path}/t.ark") as writer:
        writer["a"] = FEATS
    assert np.allclose(dict(Reader(f"ark:{tmp_path}/t.ark"))["a"], FEATS)
    with pytest.raises(ValueError):
        Writer("ark,scp:-,x")
    (tmp_path / "bad.scp").write_text("only_a_key\n")
    with pytest.raises(ReadError, match="bad.scp:1"):
        Scp(f"{tmp_path}/bad.scp")


def test_segments(tmp_path):
    (tmp_path / "r.wav").write_bytes(wav.write(np.arange(8000, dtype=np.int16), 16000))
    (tmp_path / "wav.scp").write_text(f"rec {tmp_path}/r.wav\n")
    (tmp_path / "segments").write_text("a rec 0.1 0.2\nb rec 0.2 -1\nc none 0 1\n")
    found = iter(Reader(f"scp:{tmp_path}/wav.scp", segments=f"{tmp_path}/segments"))
    assert (next(found)[1][1] == np.arange(1600, 3200)).all() and (next(found)[1][1] == np.arange(3200, 8000)).all()
    with pytest.raises(ReadError, match="no such recording"):
        next(found)


def test_data_set(spark, tmp_path):
    items = [(f"s{k}", bytearray(wav.write(np.full(100 * (k + 1), k, np.int16), 8000)), k % 2) for k in range(5)]
    archive = Archive(spark, str(tmp_path / "a"), "audio")
    archive.append(spark.createDataFrame(items, "id string, item binary, label int"), keep=("label",))
    data = Dataset(archive, "samples > 100", start_time=0.0, end_time=0.05)
    assert len(data) == 4 and data[0]["id"] == "s1" and data[0]["label"] == 1 and data[3]["samples"].shape == (400, 1)
    shapes = [(b["samples"].shape, b["lengths"]) for b in data.batches(3)]
    assert shapes == [((3, 400, 1), [200, 300, 400]), ((1, 400, 1), [400])]
    assert [x["id"] for x in (Dataset(archive, shuffle_seed=1)[k] for k in range(5))] != [f"s{k}" for k in range(5)]


def test_images_by_the_jvm(spark, tmp_path):
    image = np.random.default_rng(1).integers(0, 256, (4, 6, 3)).astype(np.uint8)
    (tmp_path / "x.png").write_bytes(png.write(image))
    (tmp_path / "broken.png").write_bytes(b"no image")
    row = read_images(spark, str(tmp_path)).collect()
    assert len(row) == 1 and (np.frombuffer(row[0].data, np.uint8).reshape(4, 6, 3) == image).all()
    assert registry.decode("image", png.write(image))["data"] == row[0].data
