"""Kaldi objects, binary and text, to and from bytes.

Readers take a file-like object that need not seek. Sizes in a file are believed only as far as there are bytes.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import BinaryIO

import numpy as np

from ...errors import ReadError
from . import flac, kaldi_quant, wav

CHUNK = 8 << 20
#: Fixed values of the format: tokens of matrices and vectors.
DTYPES = {b"FM": "f4", b"DM": "f8", b"FV": "f4", b"DV": "f8"}


class Stream:
    """A reader that can look ahead without seeking, and knows how far it is."""

    def __init__(self, file: BinaryIO):
        self.file, self.ahead, self.begin, self.at = file, b"", 0, 0  # what is ahead begins at begin

    def peek(self, n: int) -> bytes:
        if len(self.ahead) - self.begin < n:
            self.fill(n)
        return self.ahead[self.begin : self.begin + n]

    def fill(self, n: int) -> None:
        """Have n bytes ahead, or as many as there are."""
        parts = [self.ahead[self.begin :]]
        left = n - len(parts[0])
        while left > 0 and (more := self.file.read(left)):
            parts.append(more)
            left -= len(more)
        self.ahead, self.begin = b"".join(parts), 0

    def some(self, n: int) -> bytes:
        """n bytes, or as many as there are, read in bounded pieces."""
        parts = [self.ahead[self.begin : self.begin + n]]
        self.begin += len(parts[0])
        left = n - len(parts[0])
        while left and (more := self.file.read(min(left, CHUNK))):
            parts.append(more)
            left -= len(more)
        out = parts[0] if len(parts) == 1 else b"".join(parts)
        self.at += len(out)
        return out

    def exact(self, n: int) -> bytes:
        if n < 0:
            raise ReadError(f"a negative size: {n}")
        out = self.some(n)
        if len(out) < n:
            raise ReadError(f"{n} bytes are announced, {len(out)} are there")
        return out

    def rest(self) -> bytes:
        parts = []
        while more := self.some(CHUNK):
            parts.append(more)
        return b"".join(parts)


def _sized_int(s: Stream, endian: str) -> int:
    width = s.exact(1)[0]
    if not 1 <= width <= 8:
        raise ReadError(f"an integer of {width} bytes")
    return int.from_bytes(s.exact(width), "little" if endian == "<" else "big", signed=True)


def _count(s: Stream, endian: str) -> int:
    n = _sized_int(s, endian)
    if n < 0:
        raise ReadError(f"a negative count: {n}")
    return n


def _token(s: Stream) -> bytes:
    out = b""
    while (c := s.exact(1)) != b" ":
        out += c
        if len(out) > 8:
            raise ReadError(f"no such token: {out!r}")
    return out


def read_binary(s: Stream, endian: str = "<") -> np.ndarray:
    """An object after its binary mark."""
    if s.peek(1) == b"\4":
        n = _count(s, endian)
        raw = np.frombuffer(s.exact(5 * n), np.uint8).reshape(n, 5)
        if n and (raw[:, 0] != 4).any():
            raise ReadError("an integer of another size than four bytes")
        return np.ascontiguousarray(raw[:, 1:]).view(endian + "i4").reshape(-1).astype(np.int32)
    token = _token(s)
    if token in kaldi_quant.TOKENS:
        low, wide, rows, cols = struct.unpack(endian + "ffii", s.exact(16))
        if rows < 0 or cols < 0:
            raise ReadError("a negative count")
        form = kaldi_quant.TOKENS[token]
        return kaldi_quant.decompress(form, low, wide, rows, cols, s.exact(kaldi_quant.data_size(form, rows, cols)), endian)
    if token not in DTYPES:
        raise ReadError(f"no such token: {token!r}")
    dtype = np.dtype(endian + DTYPES[token])
    shape = (_count(s, endian), _count(s, endian)) if token[1:] == b"M" else (_count(s, endian),)
    n = int(np.prod(shape, dtype=object))
    return np.frombuffer(s.exact(n * dtype.itemsize), dtype).reshape(shape).astype(dtype.newbyteorder("="))


def read_text(s: Stream) -> np.ndarray:
    """`[ ... ]`: a matrix if a line ends right after the bracket, else a vector; one of whole numbers only is of int32."""
    raw = b""
    while not raw.endswith(b"]"):
        c = s.some(1)
        if not c:
            raise ReadError("a text object has no end")
        raw += c
        if len(raw.lstrip()) == 1 and raw.lstrip() != b"[":
            raise ReadError("no Kaldi object")
    while s.peek(1) in (b" ", b"\r"):
        s.some(1)
    if s.peek(1) == b"\n":
        s.some(1)
    body = raw.strip()[1:-1].replace(b"\r\n", b"\n").decode("ascii", "replace")
    try:
        if body.lstrip(" ").startswith("\n"):
            rows = [line.split() for line in body.split("\n") if line.split()]
            if len({len(r) for r in rows}) > 1:
                raise ReadError("rows of different lengths")
            return np.array(rows, np.float32).reshape(len(rows), -1) if rows else np.zeros((0, 0), np.float32)
        values = body.split()
        if values and all(v.lstrip("+-").isdigit() for v in values):
            ints = [int(v) for v in values]
            if min(ints) < -(1 << 31) or max(ints) >= 1 << 31:
                raise ReadError("an integer beyond 32 bits")
            return np.array(ints, np.int32)
        return np.array(values, np.float32)
    except ValueError as error:
        raise ReadError(str(error)) from error


def read_riff(s: Stream) -> tuple[int, np.ndarray]:
    """A WAVE file as (rate, samples); a size that swallows the next record is an error, one past the end is not."""
    head = s.exact(8)
    size = struct.unpack("<I", head[4:])[0]
    body = s.some(size)
    if len(body) < size and (at := body.find(b"RIFF", 4)) >= 0 and body[at + 8 : at + 12] == b"WAVE":
        raise ReadError("a sound's size reaches into the next record")
    found = wav.read(head + body)
    return found.rate, found.data if found.data.shape[1] > 1 else found.data[:, 0]


def read_framed(s: Stream) -> tuple[int, np.ndarray]:
    """A sound in an AUDIO frame, as float64."""
    s.exact(5)
    size = int.from_bytes(s.exact(s.exact(1)[0]), "little")
    body = s.exact(size)
    if body[:4] == b"fLaC":
        rate, bits, data = flac.read(body)
        return rate, (data if data.shape[1] > 1 else data[:, 0]) / float(1 << (bits - 1))
    rate, data = read_riff(Stream(_Bytes(body)))
    return rate, data.astype(np.float64) / (1.0 if data.dtype.kind == "f" else float(1 << (8 * data.dtype.itemsize - 1)))


class _Bytes:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0

    def read(self, n: int) -> bytes:
        out = self.raw[self.at : self.at + n]
        self.at += len(out)
        return out


def stream(raw: bytes) -> Stream:
    return Stream(_Bytes(raw))


def read_object(s: Stream, endian: str = "<"):
    """An array, or (rate, samples) of a sound."""
    head = s.peek(5)
    if head[:2] == b"\0B":
        s.exact(2)
        return read_binary(s, endian)
    if head == b"AUDIO":
        return read_framed(s)
    if head[:4] == b"RIFF":
        return read_riff(s)
    if head[:4] in (b"fLaC", b"OggS", b"\x1aE\xdf\xa3"):
        from .registry import decoder

        found = decoder("audio", {b"fLaC": "flac", b"OggS": "ogg"}.get(head[:4], "webm"))(s.rest())
        return found["sample_rate"], np.array(found["samples"], np.float32).reshape(-1, found["channels"])
    return read_text(s)


def read_ark(file: BinaryIO, endian: str = "<") -> Iterator[tuple[str, object, int]]:
    """(key, object, offset) of each record; the offset is that of the first byte after the key's blank."""
    s = Stream(file)
    while found := _next(s, endian):
        yield found


def _next(s: Stream, endian: str) -> tuple[str, object, int] | None:
    key = b""
    while (c := s.some(1)) and (c not in b" \t\n" or not key):
        if c not in b" \t\n\r":
            key += c
        if len(key) > 1 << 16:
            raise ReadError("a key without an end")
    if not c:
        if key:
            raise ReadError(f"nothing follows the key {key!r}")
        return None
    at = s.at
    return key.decode(), read_object(s, endian), at


@dataclass
class Run:
    """Vectors of one kind that follow one another: their keys, offsets and lengths, and the values of all."""

    arm: str
    keys: list[str]
    offsets: list[int]
    lengths: list[int]
    values: np.ndarray


#: Plain vectors: what stands before their count, bytes of a value, and their arm in the union schema.
PLAIN = ((b"\0B\4", 5, "i32"), (b"\0BFV \4", 4, "f32"), (b"\0BDV \4", 8, "f64"))
#: Bytes of an ark whose vectors are read together.
RUN = 2 << 20


def read_runs(file: BinaryIO, endian: str = "<") -> Iterator[Run | tuple[str, object, int]]:
    """The records of read_ark(), in order, plain vectors in runs; any other record, and any broken one, is read by itself."""
    s = Stream(file)
    while True:
        if run := _run(s, endian):
            yield run
        elif found := _next(s, endian):
            yield found
        else:
            return


def _run(s: Stream, endian: str) -> Run | None:
    """The plain vectors that come next and are ahead as a whole."""
    if len(s.ahead) - s.begin < RUN >> 4:
        s.fill(RUN)
    data, at, count = s.ahead, s.begin, struct.Struct(endian + "i").unpack_from
    blank = data.find(b" ", at, at + 256)
    kind = next((p for p in PLAIN if blank > at and data.startswith(p[0], blank + 1)), None)
    if kind is None:
        return None
    mark, width, arm = kind
    head, size, find, starts = len(mark) + 1, len(data), data.find, data.startswith
    keys, offsets, lengths, bodies = [], [], [], []
    moved = s.at - s.begin
    while blank > at and starts(mark, blank + 1) and blank + head + 4 <= size:
        n = count(data, blank + head)[0]
        begin = blank + head + 4
        end = begin + width * n
        key = data[at:blank]
        if n < 0 or end > size or key.split() != [key]:
            break
        keys.append(key)
        offsets.append(moved + blank + 1)
        lengths.append(n)
        bodies.append(data[begin:end])
        at = end
        blank = find(b" ", at, at + 256)
    if not keys:
        return None
    whole = b"".join(bodies)
    if arm == "i32":
        raw = np.frombuffer(whole, np.uint8).reshape(-1, 5)
        if (raw[:, 0] != 4).any():
            return None
        values = np.ascontiguousarray(raw[:, 1:]).view(endian + "i4").reshape(-1).astype(np.int32)
    else:
        values = np.frombuffer(whole, f"{endian}f{width}").astype(f"f{width}")
    s.begin, s.at = at, moved + at
    return Run(arm, [k.decode() for k in keys], offsets, lengths, values)


def plain_records(keys: list[str], lengths: np.ndarray, values: np.ndarray, endian: str = "<") -> tuple[list[bytes], list[int]]:
    """Records of vectors, as record() makes them one by one, and where the object starts in each; values has those of all."""
    mark, width, _ = next(p for p in PLAIN if p[2] == f"{values.dtype.kind}{8 * values.dtype.itemsize}")
    if values.dtype.kind == "i":
        raw = np.zeros((len(values), 5), np.uint8)
        raw[:, 0] = 4
        raw[:, 1:] = values.astype(endian + "i4").view(np.uint8).reshape(-1, 4)
        whole = raw.tobytes()
    else:
        whole = values.astype(f"{endian}f{width}").tobytes()
    counts = lengths.astype(endian + "i4").tobytes()
    records, starts, at = [], [], 0
    for k, (key, n) in enumerate(zip(keys, lengths.tolist(), strict=True)):
        head = check_key(key).encode() + b" "
        records.append(head + mark + counts[4 * k : 4 * k + 4] + whole[at : at + width * n])
        starts.append(len(head))
        at += width * n
    return records, starts


def write_object(value, endian: str = "<", compression_method: int | None = None, sound: str | Callable | None = None) -> bytes:
    """The binary form of an array, or of a sound given as (rate, samples) or (samples, rate).

    float64 stays double, other floats are single; vectors of whole numbers become int32 vectors. sound="framed" puts
    a sound into an AUDIO frame as WAV, sound="flac" as FLAC of 16 bits, a function from (samples, rate) to bytes encodes it itself, and is framed too.
    """
    if isinstance(value, tuple):
        rate, data = value if np.ndim(value[0]) == 0 else value[::-1]
        data = np.asarray(data)
        if sound == "flac":
            body = flac.write(wav.quantised(data[:, None] if data.ndim == 1 else data, 16), int(rate))
        else:
            body = sound(data, int(rate)) if callable(sound) else wav.write(data, int(rate))
        if sound is None:
            return body
        width = max(1, (len(body).bit_length() + 7) // 8)
        return b"AUDIO" + bytes([width]) + len(body).to_bytes(width, "little") + body
    data = np.asarray(value)
    if data.ndim not in (1, 2):
        raise ValueError(f"an object has one or two dimensions, not {data.ndim}")
    if data.dtype.kind in "iub":
        if data.ndim == 2:
            raise ValueError("there are no matrices of whole numbers")
        checked = _int32(data)
        raw = np.zeros((len(checked), 5), np.uint8)
        raw[:, 0] = 4
        raw[:, 1:] = checked.astype(endian + "i4").view(np.uint8).reshape(-1, 4)
        return b"\0B\4" + struct.pack(endian + "i", len(checked)) + raw.tobytes()
    if compression_method and data.ndim == 2:
        return b"\0B" + kaldi_quant.compress(data, compression_method, endian)
    double = data.dtype == np.float64
    token = (b"D" if double else b"F") + (b"M" if data.ndim == 2 else b"V")
    counts = b"".join(b"\4" + struct.pack(endian + "i", n) for n in data.shape)
    return b"\0B" + token + b" " + counts + data.astype(endian + ("f8" if double else "f4")).tobytes()


def _int32(data: np.ndarray) -> np.ndarray:
    if data.size and (int(data.min()) < -(1 << 31) or int(data.max()) >= 1 << 31):
        raise ValueError("a whole number beyond 32 bits")
    return data.astype(np.int32)


def write_text(value) -> bytes:
    """The text form of a vector or matrix."""
    data = np.asarray(value)
    if data.ndim not in (1, 2):
        raise ValueError("only vectors and matrices have a text form")
    if data.dtype.kind in "iub":
        _int32(data)
    shown = (lambda x: str(int(x))) if data.dtype.kind in "iub" else (lambda x: repr(float(x)) if data.dtype == np.float64 else str(np.float32(x)))
    if data.ndim == 1:
        return (" [ " + "".join(f"{shown(x)} " for x in data) + "]\n").encode()
    return (" [" + "".join("\n  " + "".join(f"{shown(x)} " for x in row) for row in data) + "]\n").encode()


def check_key(key: str) -> str:
    if key.split() != [key]:
        raise ValueError(f"a key has at least one character and no white space: {key!r}")
    return key


def record(key: str, value, text: bool = False, **how) -> tuple[bytes, int]:
    """(bytes, where the object starts in them) of a record."""
    head = check_key(key).encode() + (b"" if text else b" ")
    return head + (write_text(value) if text else write_object(value, **how)), len(key.encode()) + 1


def to_row(value) -> dict:
    """An object as a row of the union schema."""
    row = dict.fromkeys(("kind", "rows", "cols", "f32", "f64", "i32", "rate"))
    if isinstance(value, tuple):
        row["kind"], row["rate"], value = "sound", int(value[0]), np.asarray(value[1])
    elif value.dtype.kind == "i":
        row["kind"] = "ints"
    else:
        row["kind"] = "matrix" if value.ndim == 2 else "vector"
    row["rows"], row["cols"] = len(value), value.shape[1] if value.ndim == 2 else None
    if row["kind"] == "sound" and value.ndim == 1:
        row["cols"] = 1
    arm = "i32" if value.dtype.kind == "i" else "f64" if value.dtype == np.float64 else "f32"
    row[arm] = value.reshape(-1).astype({"i32": np.int32, "f64": np.float64, "f32": np.float32}[arm])
    return row


def from_row(row: dict):
    """The object of such a row."""
    arm = next((a for a in ("i32", "f64", "f32") if row.get(a) is not None), None)
    if arm is None:
        raise ValueError("a row without values")
    data = np.asarray(row[arm], {"i32": np.int32, "f64": np.float64, "f32": np.float32}[arm])
    if row["kind"] == "matrix":
        data = data.reshape(row["rows"], row["cols"])
    if row["kind"] == "sound":
        if arm == "i32" and (not data.size or (data.min() >= -32768 and data.max() <= 32767)):
            data = data.astype(np.int16)
        return row["rate"], data.reshape(-1, row["cols"]) if (row["cols"] or 1) > 1 else data
    return data


def slice_segment(value, start: float, end: float):
    """[start, end) seconds of a sound; a negative end is the sound's own, an end of 0 gives nothing."""
    if not isinstance(value, tuple):
        raise ReadError("only sounds have segments")
    rate, data = value
    return rate, data[max(0, int(start * rate)) : len(data) if end < 0 else max(0, int(end * rate))]
