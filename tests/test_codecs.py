import io
import struct
import warnings

import numpy as np
import pytest

from stowage.errors import CodecUnavailable, ReadError
from stowage.functions.codecs import containers as C
from stowage.functions.codecs import flac, jpeg, png, registry, smf, text, wav
from stowage.schemas import check_modality
from stowage.sources.archive import Archive

TONE = np.sin(2 * np.pi * 440 * np.arange(8000) / 16000)
SOUND = np.column_stack([TONE, 0.3 * np.random.default_rng(0).standard_normal(8000)]).clip(-1, 1)

# a falling line in quarters, one note through all of it, two drums: onset, offset, pitch, velocity, program, drum, instrument
LINE = [(0.25 * k, 0.25 * k + 0.25, 90 - 3 * k, 40 + k, 11, False, 0) for k in range(12)]
NOTES = np.array([*LINE, (0.125, 3.5, 28, 99, 48, False, 1), (0.5, 0.625, 38, 101, 0, True, 2), (1.75, 2.0, 42, 102, 0, True, 2)], smf.NOTE_DTYPE)


def song():
    made = smf.song_of(NOTES)
    made.instruments[0].controls = [(0.25, 10, 30), (0.75, 10, 90), (2.0, 7, 55)]
    made.instruments[0].bends = [(0.5, -700)]
    return smf.parse(smf.write(made))


def shown(notes):
    return sorted((round(n["onset"], 3), round(n["offset"], 3), int(n["pitch"]), int(n["velocity"])) for n in notes)


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_flac_is_lossless(bits):
    data = wav.quantised(SOUND, bits)
    raw = flac.write(data, 16000, bits)
    rate, width, back = flac.read(raw)
    assert (rate, width) == (16000, bits) and (back == data).all()
    broken = bytearray(raw)
    broken[len(raw) // 2] ^= 1
    with pytest.raises(ReadError):
        flac.read(bytes(broken))


def test_flac_edges():
    assert flac.read(flac.write(np.zeros((0, 1), np.int64), 8000))[2].shape == (0, 1)
    one = np.array([[5], [-7], [32767]])
    assert (flac.read(flac.write(one, 8000))[2] == one).all()


@pytest.mark.parametrize("bits", [8, 16, 24, 32])
def test_wav_round_trip(bits):
    found = wav.read(wav.write(SOUND, 16000, bits))
    assert found.rate == 16000 and found.bits == bits and np.abs(found.floats() - SOUND).max() <= 1.01 / (1 << (bits - 1)) + 1e-7


def test_wav_to_flac_is_exact():
    raw = wav.write(SOUND, 44100, 16)
    made, meta = registry.encode("audio", raw, target_format="flac")
    assert meta == {"sample_rate": 44100, "channels": 2, "samples": 8000, "format": "flac", "bit_depth": 16, "duration": 8000 / 44100}
    assert (flac.read(made)[2] == wav.read(raw).data).all()


def test_audio_fast_path_and_errors():
    raw = wav.write(SOUND, 16000, 16)
    assert registry.encode("audio", raw)[0] == raw
    assert registry.encode("audio", raw, target_bit_depth=24)[0] == raw
    assert wav.read(registry.encode("audio", raw, target_bit_depth=8)[0]).bits == 8
    with pytest.raises(ValueError):
        registry.encode("audio", raw, target_bit_depth=12)
    with pytest.raises(CodecUnavailable):
        registry.encode("audio", raw, target_format="webm")
    with pytest.raises(ReadError):
        registry.decode("audio", b"this is not audio")
    with pytest.raises(CodecUnavailable):
        registry.decode("audio", b"\x1aE\xdf\xa3....")


@pytest.mark.parametrize("window", [(0.0, None), (0.1, 0.2), (0.137, 0.4), (0.3, 9.0), (0.4, 0.1), (-1.0, 0.25)])
@pytest.mark.parametrize("form", ["wav", "flac"])
def test_window_is_a_slice(form, window):
    raw, _ = registry.encode("audio", (SOUND, 16000), target_format=form)
    whole = registry.decode("audio", raw)
    part = registry.decode("audio", raw, start_time=window[0], end_time=window[1])
    data = whole["samples"].reshape(-1, 2)
    first = max(0, int(window[0] * 16000))
    last = len(data) if window[1] is None else max(first, int(window[1] * 16000))
    assert (part["samples"].reshape(-1, 2) == data[first:last]).all() and part["frames"] == len(data[first:last])


@pytest.mark.parametrize("shape", [(3, 5), (7, 4, 1), (20, 30, 3), (9, 8, 4), (2, 2, 2)])
def test_png_round_trip(shape):
    image = np.random.default_rng(1).integers(0, 256, shape).astype(np.uint8)
    back = png.read(png.write(image))
    assert (back == image.reshape(*shape[:2], -1)).all()


def test_png_filters():
    """Rows of all kinds of filters are read alike."""
    import struct
    import zlib

    image = np.random.default_rng(2).integers(0, 256, (5, 6, 3)).astype(np.uint8)
    rows = []
    for y, kind in enumerate(range(5)):
        line = []
        for x in range(18):
            left = int(image[y].reshape(-1)[x - 3]) if x >= 3 else 0
            up = int(image[y - 1].reshape(-1)[x]) if y else 0
            corner = int(image[y - 1].reshape(-1)[x - 3]) if y and x >= 3 else 0
            guess = left + up - corner
            paeth = min((left, up, corner), key=lambda v: abs(guess - v))
            line.append((int(image[y].reshape(-1)[x]) - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
        rows.append(bytes([kind, *line]))
    head = struct.pack(">IIBBBBB", 6, 5, 8, 2, 0, 0, 0)
    raw = png.SIGNATURE + png._chunk(b"IHDR", head) + png._chunk(b"IDAT", zlib.compress(b"".join(rows))) + png._chunk(b"IEND", b"")
    assert (png.read(raw) == image).all()


def test_text():
    raw, meta = registry.encode("text", "añb" * 10)
    assert text.decode(raw) == {"text": "añb" * 10} and meta == {"original_path": "", "original_size": 40, "compressed_size": len(raw)}
    import zstandard

    out = io.BytesIO()
    with zstandard.ZstdCompressor().stream_writer(out, closefd=False) as writer:
        writer.write(b"no size in this frame")
    assert text.decode(out.getvalue())["text"] == "no size in this frame"
    with pytest.raises(ValueError):
        check_modality("smell")


def cut(start, end, partial=True):
    return sorted((max(n["onset"], start) - start, min(n["offset"], end) - start, int(n["pitch"]), int(n["velocity"])) for n in NOTES if n["offset"] > start and n["onset"] < end and (partial or n["onset"] >= start))


def test_midi_round_trip_and_metadata():
    assert shown(smf.notes_of(song())) == shown(NOTES)
    assert smf.summary(song()) == {"duration": 3.5, "n_notes": 15, "n_instruments": 3, "programs": [11, 48], "has_drums": True, "resolution": 480, "min_pitch": 28, "max_pitch": 90}


def test_midi_slices():
    for start, end in ((0.375, 1.0), (1.5, 3.0), (0.0, 4.0), (3.5, 9.0)):
        for partial in (True, False):
            assert shown(smf.notes_of(smf.sliced(song(), start, end, partial))) == cut(start, end, partial)
    assert len(cut(0.375, 1.0)) == 5 and len(cut(0.375, 1.0, False)) == 3
    part = smf.sliced(song(), 1.25, 2.5)
    assert [(round(t, 3), n, v) for t, n, v in part.instruments[0].controls] == [(0, 10, 90), (0.75, 7, 55)] and part.instruments[0].bends == [(0.0, -700)]
    for window in ((-2, 1), (3, 2)):
        with pytest.raises(ValueError):
            smf.sliced(song(), *window)
    assert smf.tempo_at(song(), 3) == 120


def test_midi_items():
    raw = smf.write(song())
    kept, meta = registry.encode("midi", raw)
    assert kept == raw and meta["format"] == "mid" and meta["original_size"] == meta["stored_size"]
    small, meta = registry.encode("midi", raw, compress=True)
    assert meta["stored_size"] == len(small) and registry.decode("midi", small)["smf"] == raw
    registry._say_backend.cache_clear()
    with pytest.warns(RuntimeWarning, match="sines"):
        found = registry.decode("midi", raw, start_time=0.5, end_time=1.75, synthesize=True, sample_rate=4000)
    assert len(found["samples"]) == 5000 and np.abs(found["samples"]).max() > 0
    with warnings.catch_warnings():
        warnings.simplefilter("error")  # it is said once
        registry.decode("midi", raw, synthesize=True, sample_rate=1000)
    with pytest.raises(ValueError):
        registry.encode("midi", b"no midi")
    with pytest.raises(CodecUnavailable):
        registry.decode("midi", raw, backend="fluidsynth")


def test_jpeg_agrees_with_the_jvm(spark, tmp_path):
    """Files written here as the JVM reads them, and as they are read here."""
    rng = np.random.default_rng(4)
    y, x = np.mgrid[:50, :71]
    smooth = np.stack([x * 3, y * 4, x + y], axis=2).clip(0, 255).astype(np.uint8)
    images = {"smooth": smooth, "noise": rng.integers(0, 256, (40, 33, 3), np.uint8), "grey": smooth[:, :, 0], "dot": smooth[:1, :1]}
    for name, image in images.items():
        (tmp_path / f"{name}.jpg").write_bytes(jpeg.write(image, 90))
    for row in spark.read.format("image").load(str(tmp_path)).select("image.*").collect():
        image = images[row.origin.rpartition("/")[2][:-4]]
        other = np.frombuffer(bytes(row.data), np.uint8).reshape(row.height, row.width, row.nChannels)[:, :, ::-1].astype(int)
        own = jpeg.read(jpeg.write(image, 90)).astype(int)
        assert own.shape == other.shape and np.abs(own - other).max() <= 3
    assert np.abs(jpeg.read(jpeg.write(smooth, 100)).astype(int) - smooth).max() <= 3
    assert np.sqrt(((jpeg.read(jpeg.write(images["noise"], 100)).astype(float) - images["noise"]) ** 2).mean()) < 2


def test_jpeg_of_other_writers():
    """Sampled colours and restart markers: a file put together from its parts."""
    rng = np.random.default_rng(5)
    image = np.repeat(np.repeat(rng.integers(60, 200, (4, 4, 1), np.uint8), 8, 0), 8, 1)
    raw = jpeg.write(image, 95)
    # four blocks a row as two units of 2 x 1 blocks are read in the same order: declared sampling of a single colour is ignored
    at = raw.index(b"\xff\xc0")
    again = raw[: at + 11] + b"\x21" + raw[at + 12 :]
    assert (jpeg.read(again) == jpeg.read(raw)).all()
    for part in (raw[:100], raw[: len(raw) // 2], b"\xff\xd8\xff\xd9", raw.replace(b"\xff\xc4", b"\xff\xfe")):
        with pytest.raises(ReadError):
            jpeg.read(part)
    with pytest.raises(CodecUnavailable):
        jpeg.read(raw.replace(b"\xff\xc0", b"\xff\xc2"))
    for bad in (np.zeros((2, 2, 4), np.uint8), np.zeros((0, 3, 3), np.uint8)):
        with pytest.raises(ValueError):
            jpeg.write(bad)
    with pytest.raises(ValueError):
        jpeg.write(image, 0)


def test_images_change_format():
    image = np.arange(16 * 16 * 3, dtype=np.uint8).reshape(16, 16, 3)
    payload, meta = registry.encode("image", image, target_format="jpeg", quality=100)
    assert registry.sniff("image", payload) == "jpeg" and meta == {"format": "jpeg", "height": 16, "width": 16, "channels": 3}
    back, meta = registry.encode("image", payload)
    assert meta["format"] == "png" and registry.decode("image", back)["data"] == registry.decode("image", payload)["data"]


def box(name, *parts):
    body = b"".join(parts)
    return struct.pack(">I4s", 8 + len(body), name) + body


def mp4():
    """25 frames a second, 320 x 240, key frames 1, 11 and 31 of 40; stereo at 22,050."""

    def track(handler, scale, entry, steps, keys=None):
        mdhd = box(b"mdhd", bytes(12), struct.pack(">II", scale, 0), bytes(4))
        hdlr = box(b"hdlr", bytes(8), handler, bytes(13))
        stsd = box(b"stsd", struct.pack(">II", 0, 1), entry)
        stts = box(b"stts", struct.pack(">II", 0, len(steps)), *(struct.pack(">II", *s) for s in steps))
        stss = box(b"stss", struct.pack(f">II{len(keys)}I", 0, len(keys), *keys)) if keys else b""
        return box(b"trak", box(b"mdia", mdhd, hdlr, box(b"minf", box(b"stbl", stsd, stts, stss))))

    picture = box(b"avc1", bytes(24), struct.pack(">HH", 320, 240), bytes(50))
    sound = box(b"mp4a", bytes(16), struct.pack(">HHI", 2, 16, 0), struct.pack(">I", 22_050 << 16))
    moov = box(b"moov", track(b"vide", 12_800, picture, [(30, 512), (10, 512)], [1, 11, 31]), track(b"soun", 22_050, sound, [(35, 1024)]))
    return box(b"ftyp", b"isom", bytes(4)) + moov + box(b"mdat", bytes(99))


def element(name, *parts, unknown=False):
    body = b"".join(parts)
    head = name.to_bytes((name.bit_length() + 7) // 8, "big")
    return head + (b"\x01" + b"\xff" * 7 if unknown else struct.pack(">Q", 1 << 56 | len(body))) + body


def webm(video=True, unknown=False):
    """10 frames of 40 ms, key frames 0 and 6, and Opus at 48,000."""
    number = lambda name, value: element(name, value.to_bytes(4, "big"))
    pictures = element(C.ENTRY, number(C.NUMBER, 1), number(C.TYPE, 1), element(C.CODEC, b"V_VP9"), element(C.VIDEO, number(C.WIDTH, 64), number(C.HEIGHT, 48)))
    sound = element(C.ENTRY, number(C.NUMBER, 2), number(C.TYPE, 2), element(C.CODEC, b"A_OPUS"), element(C.AUDIO, element(C.RATE, struct.pack(">d", 48000.0)), number(C.CHANNELS, 2)))
    info = element(C.INFO, number(C.SCALE, 1_000_000), element(C.DURATION, struct.pack(">d", 400.0)))
    clusters = []
    for first in (0, 5):
        blocks = [element(C.SIMPLE_BLOCK, b"\x81", struct.pack(">hB", 40 * k, 128 if first + k in (0, 6) else 0), b"data") if k else element(C.GROUP, element(C.BLOCK, b"\x81", struct.pack(">hB", 0, 0), b"data"), *([element(C.REFERENCE, b"\x01")] if first else [])) for k in range(5)]
        clusters.append(element(C.CLUSTER, number(C.CLUSTER_TIME, 40 * first), *(blocks if video else []), unknown=unknown))
    return element(0x1A45DFA3, element(0x4282, b"webm")) + element(C.SEGMENT, info, element(C.TRACKS, *([pictures] if video else []), sound), *clusters, unknown=unknown)


def test_containers_say_what_they_hold():
    assert C.tracks(mp4()) == [C.Track("video", "avc1", 320, 240, 25.0, 40, 20, duration=1.6), C.Track("audio", "mp4a", rate=22_050, channels=2, duration=35 * 1024 / 22_050)]
    for unknown in (False, True):
        assert C.tracks(webm(unknown=unknown)) == [C.Track("video", "vp9", 64, 48, 25.0, 10, 6, duration=0.4), C.Track("audio", "opus", rate=48_000, channels=2, duration=0.4)]
    for bad in (mp4()[:200], box(b"ftyp", b"isom"), webm()[:30], b"\x1aE\xdf\xa3"):
        with pytest.raises(ReadError):
            C.tracks(bad)


def test_videos_are_stored_as_they_are():
    payload, meta = registry.encode("video", mp4())
    assert payload == mp4() and meta == {"fps": 25.0, "height": 240, "width": 320, "sample_rate": 22_050, "format": "mp4", "video_codec": "avc1", "audio_codec": "mp4a", "gop_size": 20}
    assert registry.encode("video", webm())[1]["format"] == "webm"
    payload, meta = registry.encode("audio", webm(video=False))
    assert payload == webm(video=False) and (meta["format"], meta["sample_rate"], meta["samples"], meta["duration"]) == ("webm", 48_000, 19_200, 0.4)
    for call in (lambda: registry.encode("video", mp4(), target_format="webm"), lambda: registry.decode("video", mp4()), lambda: registry.encode("audio", (np.zeros(9), 9), target_format="webm"), lambda: registry.decode("audio", webm(video=False))):
        with pytest.raises(CodecUnavailable):
            call()
    with pytest.raises(ReadError):
        registry.encode("video", webm(video=False))


def test_video_archive(spark, tmp_path):
    archive = Archive(spark, str(tmp_path / "v"), "video")
    archive.append(spark.createDataFrame([("a", mp4()), ("b", webm())], "id string, item binary"))
    rows = {r.id: r for r in archive.index().collect()}
    assert (rows["a"].fps, rows["a"].gop_size, rows["b"].video_codec, rows["b"].height) == (25.0, 20, "vp9", 48)
