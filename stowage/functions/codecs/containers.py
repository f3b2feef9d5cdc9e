"""What MP4 and WebM files say of their tracks, read from their boxes and elements alone; nothing is decoded."""

from __future__ import annotations

import struct
from collections.abc import Iterator
from typing import NamedTuple

from ...errors import ReadError


class Track(NamedTuple):
    """kind is video or audio; frames, fps and gop (most frames from one key frame to the next) are of videos."""

    kind: str
    codec: str
    width: int | None = None
    height: int | None = None
    fps: float | None = None
    frames: int | None = None
    gop: int | None = None
    rate: int | None = None
    channels: int | None = None
    duration: float | None = None


def _gop(keys: list[int], frames: int) -> int | None:
    """The longest way from one key frame, counted from 0, to the next or the end."""
    edges = [*sorted(keys), frames]
    return max((b - a for a, b in zip(edges, edges[1:])), default=None) if keys else None


# -- MP4: boxes of a size, a name and a body


def _boxes(raw: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    while at + 8 <= end:
        size, name = struct.unpack_from(">I4s", raw, at)
        body = at + 8
        if size == 1 and at + 16 <= end:
            size, body = struct.unpack_from(">Q", raw, body)[0], body + 8
        stop = end if size == 0 else at + size
        if stop < body or stop > end:
            raise ReadError("an MP4 box is damaged or cut short")
        yield name, body, stop
        at = stop


def _inside(raw: bytes, at: int, end: int, *path: bytes) -> tuple[int, int] | None:
    """Where the body of the first box at a path is."""
    for name in path:
        found = next(((a, b) for kind, a, b in _boxes(raw, at, end) if kind == name), None)
        if found is None:
            return None
        at, end = found
    return at, end


def mp4_tracks(raw: bytes) -> list[Track]:
    whole = _inside(raw, 0, len(raw), b"moov")
    if whole is None:
        raise ReadError("an MP4 file without a moov box")
    made = []
    for name, at, end in _boxes(raw, *whole):
        if name != b"trak":
            continue
        where = {key: _inside(raw, at, end, b"mdia", *path) for key, path in {"hdlr": [b"hdlr"], "mdhd": [b"mdhd"], "stsd": [b"minf", b"stbl", b"stsd"], "stts": [b"minf", b"stbl", b"stts"], "stss": [b"minf", b"stbl", b"stss"]}.items()}
        if not all(where[k] for k in ("hdlr", "mdhd", "stsd", "stts")):
            continue
        try:
            made += _mp4_track(raw, where)
        except struct.error as error:
            raise ReadError("an MP4 track is cut short") from error
    return made


def _mp4_track(raw: bytes, where: dict) -> list[Track]:
    kind = {b"vide": "video", b"soun": "audio"}.get(raw[where["hdlr"][0] + 8 : where["hdlr"][0] + 12])
    if kind is None:
        return []
    at = where["mdhd"][0]
    scale = struct.unpack_from(">I", raw, at + (20 if raw[at] else 12))[0]
    entry = where["stsd"][0] + 8
    codec = raw[entry + 4 : entry + 8].decode("latin-1").strip()
    at = where["stts"][0]
    steps = [struct.unpack_from(">II", raw, at + 8 + 8 * k) for k in range(struct.unpack_from(">I", raw, at + 4)[0])]
    frames, ticks = sum(n for n, _ in steps), sum(n * d for n, d in steps)
    duration = ticks / scale if scale else None
    if kind == "audio":
        channels, rate = struct.unpack_from(">H", raw, entry + 24)[0], struct.unpack_from(">I", raw, entry + 32)[0] >> 16
        return [Track(kind, codec, rate=rate or scale, channels=channels, duration=duration)]
    width, height = struct.unpack_from(">HH", raw, entry + 32)
    keys = range(frames)
    if where["stss"]:
        at = where["stss"][0]
        keys = [struct.unpack_from(">I", raw, at + 8 + 4 * k)[0] - 1 for k in range(struct.unpack_from(">I", raw, at + 4)[0])]
    return [Track(kind, codec, width, height, frames * scale / ticks if ticks else None, frames, _gop(list(keys), frames), duration=duration)]


# -- WebM: elements of a name, a size and a body. The names.
SEGMENT, INFO, SCALE, DURATION, TRACKS, ENTRY = 0x18538067, 0x1549A966, 0x2AD7B1, 0x4489, 0x1654AE6B, 0xAE
NUMBER, TYPE, CODEC, FRAME_TIME, VIDEO, AUDIO = 0xD7, 0x83, 0x86, 0x23E383, 0xE0, 0xE1
WIDTH, HEIGHT, RATE, CHANNELS = 0xB0, 0xBA, 0xB5, 0x9F
CLUSTER, CLUSTER_TIME, SIMPLE_BLOCK, GROUP, BLOCK, REFERENCE = 0x1F43B675, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB


def _number(raw: bytes, at: int, keep: bool) -> tuple[int, int]:
    """A number whose first byte says its length, with that mark or without it, and where it ends."""
    if at >= len(raw) or not raw[at]:
        raise ReadError("a WebM element is damaged or cut short")
    size = 9 - raw[at].bit_length()
    value = int.from_bytes(raw[at : at + size], "big")
    return (value if keep else value & (1 << 7 * size) - 1), at + size


def _elements(raw: bytes, at: int, end: int) -> Iterator[tuple[int, int, int]]:
    while at < end:
        name, body = _number(raw, at, True)
        size, start = _number(raw, body, False)
        unknown = size == (1 << 7 * (start - body)) - 1
        # a segment or cluster of unknown size goes on to the end; what a cluster cannot hold ends it
        stop = end if unknown else min(start + size, end)
        yield name, start, stop
        at = start if unknown and name == CLUSTER else stop


def _uint(raw: bytes, at: int, end: int) -> int:
    return int.from_bytes(raw[at:end], "big")


def _float(raw: bytes, at: int, end: int) -> float:
    return struct.unpack(">f" if end - at == 4 else ">d", raw[at:end])[0] if end - at in (4, 8) else 0.0


def webm_tracks(raw: bytes) -> list[Track]:
    segment = next(((a, b) for name, a, b in _elements(raw, 0, len(raw)) if name == SEGMENT), None)
    if segment is None:
        raise ReadError("a WebM file without a segment")
    scale, duration, entries = 1_000_000, None, []
    blocks: dict[int, list[tuple[int, bool]]] = {}  # of each track: time and whether it is a key frame
    now = 0

    def block(at: int, key: bool | None) -> None:
        number, at = _number(raw, at, False)
        own = key if key is not None else bool(raw[at + 2] & 128)
        blocks.setdefault(number, []).append((now + struct.unpack_from(">h", raw, at)[0], own))

    def walk(at: int, end: int) -> None:
        nonlocal scale, duration, now
        for name, a, b in _elements(raw, at, end):
            if name == INFO:
                for kind, x, y in _elements(raw, a, b):
                    scale = _uint(raw, x, y) if kind == SCALE else scale
                    duration = _float(raw, x, y) if kind == DURATION else duration
            elif name == TRACKS:
                entries.extend(dict(_entry(raw, x, y)) for kind, x, y in _elements(raw, a, b) if kind == ENTRY)
            elif name == CLUSTER and b < end:
                walk(a, b)
            elif name == CLUSTER:  # the last one, or one of unknown size, whose elements follow in this list
                if b == end and a < end and not _unknown(raw, a):
                    walk(a, b)
            elif name == CLUSTER_TIME:
                now = _uint(raw, a, b)
            elif name == SIMPLE_BLOCK:
                block(a, None)
            elif name == GROUP:
                inner = list(_elements(raw, a, b))
                for kind, x, _ in inner:
                    if kind == BLOCK:
                        block(x, all(k != REFERENCE for k, *_ in inner))

    walk(*segment)
    seconds = None if duration is None else duration * scale / 1e9
    made = []
    for entry in entries:
        own = sorted(blocks.get(entry.get(NUMBER, 0), []))
        codec = entry.get(CODEC, "").removeprefix("V_").removeprefix("A_").lower()
        if entry.get(TYPE) == 1:
            step = entry.get(FRAME_TIME, 0) / 1e9
            spread = (own[-1][0] - own[0][0]) * scale / 1e9 if len(own) > 1 else 0
            fps = 1 / step if step else (len(own) - 1) / spread if spread else None
            made.append(Track("video", codec, entry.get(WIDTH), entry.get(HEIGHT), fps, len(own), _gop([k for k, (_, key) in enumerate(own) if key], len(own)), duration=seconds))
        elif entry.get(TYPE) == 2:
            made.append(Track("audio", codec, rate=int(entry.get(RATE, 8000)), channels=entry.get(CHANNELS, 1), duration=seconds))
    return made


def _unknown(raw: bytes, body: int) -> bool:
    """Whether the element whose body begins here has a size of all ones."""
    return any(raw[body - n : body] == bytes([(0xFF >> n - 1)]) + b"\xff" * (n - 1) for n in range(1, 9))


def _entry(raw: bytes, at: int, end: int) -> Iterator[tuple[int, object]]:
    for name, a, b in _elements(raw, at, end):
        if name in (VIDEO, AUDIO):
            yield from _entry(raw, a, b)
        elif name == CODEC:
            yield name, raw[a:b].decode("latin-1").rstrip("\0")
        elif name == RATE:
            yield name, _float(raw, a, b)
        elif name in (NUMBER, TYPE, FRAME_TIME, WIDTH, HEIGHT, CHANNELS):
            yield name, _uint(raw, a, b)


def tracks(raw: bytes) -> list[Track]:
    """The tracks of an MP4 or WebM file."""
    return webm_tracks(raw) if raw[:4] == b"\x1aE\xdf\xa3" else mp4_tracks(raw)
