"""Which formats can be encoded and decoded here, and which would need another library."""

from __future__ import annotations

import os
import warnings
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import zstandard

from ...errors import CodecUnavailable, ReadError
from ...schemas import check_modality
from ..windows import pcm_window
from . import containers, flac, jpeg, png, smf, text, wav

# Formats by their first bytes.
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
BITS = (8, 16, 24, 32)


def sniff(modality: str, payload: bytes) -> str:
    """The format that an item's first bytes say."""
    head = bytes(payload[:12])
    if modality == "audio":
        known = {b"fLaC": "flac", b"RIFF": "wav", b"\x1aE\xdf\xa3": "webm", b"OggS": "ogg"}.get(head[:4])
    elif modality == "image":
        known = "png" if head[:4] == b"\x89PNG" else "jpeg" if head[:3] == b"\xff\xd8\xff" else "webp" if head[:4] == b"RIFF" and head[8:] == b"WEBP" else "gif" if head[:4] == b"GIF8" else None
    elif modality == "midi":
        known = "mid" if head[:4] == b"MThd" else "mid.zst" if head[:4] == ZSTD_MAGIC else None
    elif modality == "video":
        known = "mp4" if head[4:8] in (b"ftyp", b"moov", b"mdat") else "webm" if head[:4] == b"\x1aE\xdf\xa3" else None
    else:
        known = "zstd" if head[:4] == ZSTD_MAGIC else None
    if known is None:
        raise ReadError(f"these bytes are no {modality} item of a known format: {head!r}")
    return known


def unavailable(name: str) -> Callable:
    def fail(*_, **__):
        raise CodecUnavailable(f"{name} needs a library that is not installed here")

    return fail


def _audio(payload: bytes, file_type: str, rate: int, data: np.ndarray, start: float | None, end: float | None) -> dict:
    first, last = pcm_window(start, end, rate, len(data))
    data = data[first:last]
    return {"file_type": file_type, "sample_rate": rate, "frames": len(data), "channels": data.shape[1], "samples": data.reshape(-1)}


def _decode_wav(payload: bytes, start_time: float | None = None, end_time: float | None = None) -> dict:
    found = wav.read(payload)
    return _audio(payload, "wav", found.rate, found.floats(), start_time, end_time)


def _decode_flac(payload: bytes, start_time: float | None = None, end_time: float | None = None) -> dict:
    rate, bits, data = flac.read(payload)
    return _audio(payload, "flac", rate, (data / float(1 << (bits - 1))).astype(np.float32), start_time, end_time)


def _decode_image(payload: bytes) -> dict:
    image = png.read(payload) if payload[:4] == b"\x89PNG" else jpeg.read(payload)
    return {"height": image.shape[0], "width": image.shape[1], "channels": image.shape[2], "data": image.tobytes()}


@lru_cache(maxsize=1)
def _say_backend() -> None:
    """Say once in a process that songs are rendered by sines."""
    warnings.warn("no FluidSynth is installed here, so songs are rendered by sines", RuntimeWarning, stacklevel=3)


def _decode_midi(payload: bytes, start_time: float | None = None, end_time: float | None = None, include_partial: bool = True, synthesize: bool = False, sample_rate: int = 44100, channels: int = 1, backend: str = "auto", soundfont: str | None = None, as_array: bool = False) -> dict:
    """as_array: the notes as one array instead of a dict each."""
    if backend not in ("auto", "sine", "fluidsynth"):
        raise ValueError(f"no such synthesis: {backend!r}")
    if backend == "fluidsynth":
        raise CodecUnavailable("fluidsynth needs a library that is not installed here")
    if synthesize and backend == "auto":
        _say_backend()
    raw = zstandard.ZstdDecompressor().decompressobj().decompress(payload) if payload[:4] == ZSTD_MAGIC else payload
    song = smf.parse(raw)
    duration = song.end
    if start_time is not None or end_time is not None:
        start, end = start_time or 0.0, duration if end_time is None else end_time
        song = smf.sliced(song, start, end, include_partial)
        duration = max(end - start, 0.0)
        raw = smf.write(song)
    notes = smf.notes_of(song)
    out = {"duration": duration, "resolution": song.resolution, "notes": notes if as_array else [dict(zip(smf.NOTE_DTYPE.names, n, strict=True)) for n in notes.tolist()], "smf": raw}
    if synthesize:
        out |= {"sample_rate": sample_rate, "channels": channels, "samples": smf.synthesised(song, sample_rate, channels, duration).reshape(-1)}
    return out


DECODERS: dict[tuple[str, str], Callable[..., dict]] = {
    ("text", "zstd"): text.decode, ("audio", "wav"): _decode_wav, ("audio", "flac"): _decode_flac, ("audio", "webm"): unavailable("WebM audio"), ("audio", "ogg"): unavailable("Ogg audio"),
    ("image", "png"): _decode_image, ("image", "jpeg"): _decode_image, ("image", "webp"): unavailable("WebP"), ("image", "gif"): unavailable("GIF"),
    ("video", "mp4"): unavailable("MP4 video"), ("video", "webm"): unavailable("WebM video"), ("midi", "mid"): _decode_midi, ("midi", "mid.zst"): _decode_midi,
}


def decoder(modality: str, form: str) -> Callable[..., dict]:
    return DECODERS[modality, form]


def decode(modality: str, payload: bytes, **options) -> dict:
    """Decode an item of any known format; options are those of its modality (times, frames, synthesis)."""
    return DECODERS[check_modality(modality), sniff(modality, payload)](payload, **options)


def _item_bytes(item) -> bytes:
    if isinstance(item, (bytes, bytearray, memoryview)):
        return bytes(item)
    with open(item, "rb") as file:
        return file.read()


def encode_audio(item, *, target_format: str | None = None, target_bit_depth: int | None = None) -> tuple[bytes, dict]:
    """A file (path or bytes) or (samples, rate). Samples alone become 16-bit FLAC; files keep their format and bits.

    A file that is already what is asked for is copied byte by byte.
    """
    if target_format not in (None, "wav", "flac", "webm"):
        unavailable(f"{target_format} audio")()
    if target_bit_depth is not None and target_bit_depth not in BITS:
        raise ValueError(f"a sample has one of {BITS} bits, not {target_bit_depth}")
    if isinstance(item, tuple):
        if target_format == "webm":
            unavailable("WebM audio")()
        data, rate = np.asarray(item[0]), int(item[1])
        data = data[:, None] if data.ndim == 1 else data
        form, bits, raw, have = target_format or "flac", target_bit_depth or 16, None, None
    else:
        raw = _item_bytes(item)
        have = sniff("audio", raw)
        if have == "webm" and target_format in (None, "webm") and target_bit_depth is None:
            return _stored_webm(raw)
        if target_format == "webm":
            unavailable("WebM audio")()
        if have == "wav":
            found = wav.read(raw)
            rate, data, own = found.rate, found.data, None if found.is_float else found.bits
        elif have == "flac":
            rate, own, data = flac.read(raw)
            data = (data << (16 - own)).astype(np.int16) if own <= 16 else (data << (32 - own)).astype(np.int32)
        else:
            unavailable(f"{have} audio")()
        form, bits = target_format or have, target_bit_depth or own or 16
        if form == have and own is not None and bits >= own:
            return raw, {"sample_rate": rate, "channels": data.shape[1], "samples": len(data), "format": form, "bit_depth": own, "duration": len(data) / rate}
    out = wav.write(data, rate, bits) if form == "wav" else flac.write(wav.quantised(data, bits), rate, bits)
    return out, {"sample_rate": rate, "channels": data.shape[1], "samples": len(data), "format": form, "bit_depth": bits, "duration": len(data) / rate}


def encode_video(item, *, target_format: str | None = None) -> tuple[bytes, dict]:
    """An MP4 or WebM file (path or bytes), stored byte by byte with what its tracks say; nothing is encoded anew."""
    raw = _item_bytes(item)
    form = sniff("video", raw)
    if target_format not in (None, form):
        unavailable(f"{target_format} video")()
    found = containers.tracks(raw)
    video = next((t for t in found if t.kind == "video"), None)
    if video is None:
        raise ReadError("a video file without a track of pictures")
    sound = next((t for t in found if t.kind == "audio"), None)
    return raw, {"fps": video.fps, "height": video.height, "width": video.width, "sample_rate": sound and sound.rate, "format": form, "video_codec": video.codec, "audio_codec": sound and sound.codec, "gop_size": video.gop}


def _stored_webm(raw: bytes) -> tuple[bytes, dict]:
    """A WebM sound byte by byte, with what its track says."""
    sound = next((t for t in containers.webm_tracks(raw) if t.kind == "audio"), None)
    if sound is None:
        raise ReadError("a WebM file without a track of sound")
    samples = None if sound.duration is None else round(sound.duration * sound.rate)
    return raw, {"sample_rate": sound.rate, "channels": sound.channels, "samples": samples, "format": "webm", "bit_depth": None, "duration": sound.duration}


def encode_image(item, *, target_format: str = "png", quality: int = 95) -> tuple[bytes, dict]:
    """A file (path or bytes) or a uint8 array as PNG or JPEG; always encoded anew. JPEG drops what an image says of transparency."""
    if target_format not in ("png", "jpeg"):
        raise ValueError(f"images are written as png or jpeg, not {target_format!r}")
    if isinstance(item, np.ndarray):
        image = item[:, :, None] if item.ndim == 2 else item
    else:
        raw = _item_bytes(item)
        form = sniff("image", raw)
        if form not in ("png", "jpeg"):
            unavailable(form)()
        image = png.read(raw) if form == "png" else jpeg.read(raw)
    if target_format == "jpeg" and image.shape[2] in (2, 4):
        image = image[:, :, :-1]
    out = png.write(image) if target_format == "png" else jpeg.write(image, quality)
    return out, {"format": target_format, "height": image.shape[0], "width": image.shape[1], "channels": image.shape[2]}


def encode_midi(item, *, compress: bool = False, compression_level: int = 3) -> tuple[bytes, dict]:
    """A file (path or bytes), a Song or a note array; a file's bytes are kept as they are."""
    raw = smf.write(item) if isinstance(item, smf.Song) else smf.write(smf.song_of(item)) if isinstance(item, np.ndarray) else _item_bytes(item)
    if raw[:4] != b"MThd":
        raise ValueError("no standard MIDI file")
    out = zstandard.ZstdCompressor(level=compression_level).compress(raw) if compress else raw
    return out, smf.summary(smf.parse(raw)) | {"original_size": len(raw), "stored_size": len(out), "format": "mid.zst" if compress else "mid"}


ENCODERS: dict[str, Callable[..., tuple[bytes, dict]]] = {"text": text.encode, "audio": encode_audio, "image": encode_image, "midi": encode_midi, "video": encode_video}


def encode(modality: str, item, **options) -> tuple[bytes, dict]:
    """(payload, metadata) of an item."""
    return ENCODERS[check_modality(modality)](os.fspath(item) if isinstance(item, os.PathLike) else item, **options)
