import io

import numpy as np
import pytest

from stowage.errors import ReadError
from stowage.functions.codecs import kaldi_obj as K
from stowage.functions.codecs import kaldi_quant as Q
from stowage.functions.codecs import wav
from stowage.functions.specifier import parse_extended_filename, parse_rspecifier, parse_specifier, parse_wspecifier
from stowage.sources import kaldi

RNG = np.random.default_rng(3)
#: Columns of different ranges, skewed, with a few far values.
FEATS = (RNG.gamma(2.0, 1.0, (41, 9)) * np.linspace(0.5, 6.0, 9) - 3).astype(np.float32)


def test_golden_bytes():
    assert K.record("a", np.array([0, 1, 2], np.int32))[0] == b"a \0B\4\3\0\0\0\4\0\0\0\0\4\1\0\0\0\4\2\0\0\0"
    assert K.record("k", np.zeros(1, np.float32))[0] == b"k \0BFV \4\1\0\0\0\0\0\0\0"
    assert K.record("k", np.ones((1, 1)), endian=">")[0] == b"k \0BDM \4\0\0\0\1\4\0\0\0\1\x3f\xf0\0\0\0\0\0\0"


def test_offsets(tmp_path):
    ark, scp = str(tmp_path / "x.ark"), str(tmp_path / "x.scp")
    kaldi.save_ark(ark, [("a", np.zeros((2, 2), np.float32)), ("bb", np.zeros(2, np.float32))], scp)
    assert (tmp_path / "x.scp").read_text() == f"a {ark}:2\nbb {ark}:36\n"
    kaldi.save_ark(ark, [("c", np.arange(3))], scp, append=True)
    assert (kaldi.load_object((tmp_path / "x.scp").read_text().split()[-1]) == [0, 1, 2]).all()


@pytest.mark.parametrize("endian", ["<", ">"])
@pytest.mark.parametrize("value", [FEATS, FEATS[0], FEATS.astype(float), FEATS[0].astype(float), np.arange(-3, 4, dtype=np.int32), np.zeros((0, 0), np.float32), np.zeros(0, np.int32)])
def test_round_trip(value, endian):
    back = K.read_object(K.stream(K.write_object(value, endian)), endian)
    assert back.dtype == value.dtype and (back == value).all() and back.shape == value.shape
    assert (K.from_row(K.to_row(back)) == value).all()


@pytest.mark.parametrize("value", [FEATS, FEATS[0], np.arange(-3, 4, dtype=np.int32)])
def test_text_round_trip(value):
    raw = K.record("x", value, text=True)[0] * 2
    got = list(K.read_ark(io.BytesIO(raw)))
    assert [k for k, *_ in got] == ["x", "x"] and all((v == value).all() and v.dtype == value.dtype for _, v, _ in got)


def step_of(method):
    """The widest step of a method's codes over FEATS, from its definition: what an error can be at most, but for rounding."""
    low, high = FEATS.min(0), FEATS.max(0)
    span = float(FEATS.max() - FEATS.min())
    if method in (1, 2):
        # between a column's minimum, quarters and maximum there are 64, 128 and 63 steps; quarters are kept in 16 bits
        quarters = np.sort(FEATS, axis=0)[[0, len(FEATS) // 4, 3 * (len(FEATS) // 4), -1]]
        return float(max((np.diff(quarters, axis=0) / np.array([[64], [128], [63]])).max(), 0)) * 1.5 + 2 * span / 65535
    return {3: span / 65535, 4: 1.0, 5: span / 255}[method]


@pytest.mark.parametrize("method", [1, 2, 3, 4, 5])
def test_quantiser_bounds(method):
    assert np.abs(Q.lossy(FEATS, method) - FEATS).max() <= step_of(method) * (1 if method in (1, 2) else 0.502) + 1e-5
    for endian in "<>":
        raw = K.write_object(FEATS, endian, method)
        assert (K.read_object(K.stream(raw), endian) == Q.lossy(FEATS, method)).all()


def test_quantiser_edges():
    assert Q.header(FEATS[:8], 1)[0] == 2 and Q.header(FEATS[:9], 1)[0] == 1
    for method in range(1, 6):
        for rows in (1, 2, 3, 4, 5, 9):
            small = FEATS[:rows]
            assert np.abs(Q.lossy(small, method) - small).max() < max(0.6, 0.02 * (small.max() - small.min()))
        constant = np.full((10, 2), 3.5, np.float32)
        assert np.abs(Q.lossy(constant, method) - constant).max() < (0.51 if method == 4 else 0.02)
    assert Q.lossy(np.array([[-5.0, 300.0]], np.float32), 6).tolist() == [[0.0, 255.0]]
    assert Q.lossy(np.array([[-5.0, 0.5, 2.0]], np.float32), 7)[0, 2] == 1.0
    for bad in (np.zeros(3), np.zeros((0, 3)), np.array([[np.nan]]), np.array([[np.inf]])):
        with pytest.raises(ValueError):
            Q.compress(bad, 1)
    with pytest.raises(ValueError):
        Q.compress(FEATS, 9)


def test_damaged_objects():
    for raw in (b"\0B\4" + b"\xfd\xff\xff\xff", b"\0BFV \4\xff\xff\xff\xff", b"\0BFM \4\xff\xff\xff\x7f\4\xff\xff\xff\x7f", b"\0BXX ", b"\0BVERYLONGTOKEN ", b"\0BFV \4\3\0\0\0\0\0", b"[ 1 2", b"[ 1 x ]", b" [\n 1 2\n 3 ]"):
        with pytest.raises(ReadError):
            K.read_object(K.stream(raw))
    with pytest.raises(ReadError):
        K.read_object(K.stream(b"[ 99999999999 ]"))
    for bad in ("", "a b", "a\n"):
        with pytest.raises(ValueError):
            K.record(bad, FEATS)
    for bad in (np.zeros((2, 2), int), np.zeros((1, 1, 1)), np.array([1 << 40])):
        with pytest.raises(ValueError):
            K.write_object(bad)


def test_sounds():
    sound = (np.sin(np.arange(8000) / 9) * 20000).astype(np.int16)
    for value in ((16000, sound), (sound, 16000)):
        rate, back = K.read_object(K.stream(K.write_object(value)))
        assert rate == 16000 and back.dtype == np.int16 and (back == sound).all()
    rate, back = K.read_object(K.stream(K.write_object((16000, sound), sound="framed")))
    assert back.dtype == np.float64 and np.allclose(back * 32768, sound)
    for data in (sound, np.stack([sound, -sound], axis=1)):
        rate, back = K.read_object(K.stream(K.write_object((16000, data), sound="flac")))
        assert rate == 16000 and back.dtype == np.float64 and (back * 32768 == data).all()
    lying = bytearray(wav.write(sound, 16000))
    lying[4:8] = (0x7FFFF624).to_bytes(4, "little")
    assert (K.read_object(K.stream(bytes(lying)))[1] == sound).all()
    with pytest.raises(ReadError):
        K.read_object(K.stream(bytes(lying) + b"\nnext " + wav.write(sound, 16000)))


def test_segments_slices():
    value = (16000, np.arange(8000))
    assert (K.slice_segment(value, 0.1, 0.2)[1] == np.arange(1600, 3200)).all()
    assert (K.slice_segment(value, 0.2, -1)[1] == np.arange(3200, 8000)).all()
    assert len(K.slice_segment(value, 0.1, 0)[1]) == 0
    with pytest.raises(ReadError):
        K.slice_segment(FEATS, 0, 1)


def test_specifiers():
    assert parse_rspecifier("scp,p:a.scp") == ("scp", "a.scp") and parse_rspecifier("ark:-") == ("ark", "-")
    assert parse_wspecifier("ark,scp,t:a.ark,b.scp") == {"ark": "a.ark", "scp": "b.scp", "text": True, "flush": False}
    assert parse_wspecifier("scp,ark:b,a")["ark"] == "a" and parse_wspecifier("ark:a,b.ark")["ark"] == "a,b.ark"
    for bad in ("a.ark", "ark,scp:a", "ark,x:a", "ark:"):
        with pytest.raises(ValueError):
            parse_rspecifier(bad)
    for bad in ("scp:a", "ark,ark:a,b", "ark,scp:a", "ark,zz:a", "a"):
        with pytest.raises(ValueError):
            parse_wspecifier(bad)
    for bad in ("ark,scp:a", "ark,zz:a", "ark:", "t:a", "ark,ark:a,b", "ark,scp:a,"):
        with pytest.raises(ValueError):
            parse_specifier(bad)
    assert parse_specifier("ark,t,cs:x")["cs"] and parse_specifier("scp:x")["scp"] == "x"
    assert parse_extended_filename("a/b:12") == ("a/b", 12) and parse_extended_filename("cat x:1 |") == ("cat x:1 |", None) and parse_extended_filename("x") == ("x", None)


def test_pipes_have_to_be_allowed(tmp_path):
    ark = tmp_path / "a.ark"
    ark.write_bytes(K.record("a", FEATS)[0])
    with pytest.raises(PermissionError):
        next(kaldi.load_ark(f"cat {ark} |"))
    assert [k for k, *_ in kaldi.load_ark(f"cat {ark} |", allow_pipes=True)] == ["a"]
    with pytest.raises(OSError):
        list(kaldi.load_ark("false |", allow_pipes=True))


def test_data_source(spark, tmp_path):
    folder = str(tmp_path / "arks")
    kaldi.register(spark)
    rows = [{"key": f"u{k}", "offset": None, "ark": None} | K.to_row(v) for k, v in enumerate([FEATS, FEATS[0], np.arange(4, dtype=np.int32), (16000, np.arange(50, dtype=np.int16))])]
    rows = [{k: v.tolist() if isinstance(v, np.ndarray) else v for k, v in r.items()} for r in rows]
    df = spark.createDataFrame(rows, kaldi.ARK_SCHEMA)
    df.repartition(3, "key").write.format("kaldi_ark").mode("append").save(folder)
    back = {r.key: K.from_row(r.asDict()) for r in spark.read.format("kaldi_ark").load(folder).collect()}
    assert np.allclose(back["u0"], FEATS) and (back["u2"] == np.arange(4)).all() and (back["u3"][1] == np.arange(50)).all()
    scp = kaldi.read_scp(spark, f"{folder}/*.scp")
    assert {r.key for r in kaldi.fetch(scp.where("key <> 'u1'")).collect()} == {"u0", "u2", "u3"}
    assert not [p for p in (tmp_path / "arks").iterdir() if p.name.startswith("_")]


def test_segments_join(spark, tmp_path):
    scp, segments = tmp_path / "wav.scp", tmp_path / "segments"
    for name in ("rec1", "rec2"):
        kaldi.save_object(str(tmp_path / f"{name}.wav"), (16000, np.arange(8000, dtype=np.int16)))
    scp.write_text(f"rec1 {tmp_path}/gone.wav\n\nrec2 {tmp_path}/rec2.wav\nrec1 {tmp_path}/rec1.wav\n")
    segments.write_text("utt_a rec1 0.1 0.2\nutt_b rec2 0.2 -1\nutt_c rec1 0.1 0\n")
    got = {r.utt: (r.rate, r.i32) for r in kaldi.read(spark, f"scp:{scp}", segments=str(segments)).collect()}
    assert got == {"utt_a": (16000, list(range(1600, 3200))), "utt_b": (16000, list(range(3200, 8000))), "utt_c": (16000, [])}
    segments.write_text("utt_a rec9 0.1 0.2\n")
    with pytest.raises(Exception, match="no such recording"):
        kaldi.read(spark, f"scp:{scp}", segments=str(segments)).collect()
    segments.write_text("utt_a rec1 0.1\n")
    with pytest.raises(Exception, match="not four fields"):
        kaldi.read(spark, f"scp:{scp}", segments=str(segments)).collect()
    with pytest.raises(ValueError):
        kaldi.read(spark, "ark:x", segments=str(segments))
