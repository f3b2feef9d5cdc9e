"""RIFF WAVE files of integer and float samples."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

from ...errors import ReadError


@dataclass
class Wav:
    """Samples as they are stored, (frames, channels): int16 for up to 16 bits, int32 for 24 and 32, float32 or float64."""

    rate: int
    bits: int
    data: np.ndarray
    is_float: bool
    end: int

    def floats(self) -> np.ndarray:
        """Samples as float32 between -1 and 1."""
        if self.is_float:
            return self.data.astype(np.float32)
        return (self.data / float(1 << (15 if self.data.dtype == np.int16 else 31))).astype(np.float32)


def read(raw: bytes) -> Wav:
    """The file at the front of raw. A data chunk that is cut short gives the whole frames that are there."""
    if raw[:4] != b"RIFF" or raw[8:12] != b"WAVE":
        raise ReadError("no RIFF WAVE file")
    at, form = 12, None
    while at + 8 <= len(raw):
        name, size = raw[at : at + 4], struct.unpack_from("<I", raw, at + 4)[0]
        body = at + 8
        if name == b"fmt ":
            if size < 16 or body + size > len(raw):
                raise ReadError("the format chunk is cut short")
            tag, channels, rate, _, align, bits = struct.unpack_from("<HHIIHH", raw, body)
            if tag == 0xFFFE and size >= 40:
                tag = struct.unpack_from("<H", raw, body + 24)[0]
            form = (tag, channels, rate, align, bits)
        elif name == b"data":
            if form is None:
                raise ReadError("data comes before its format")
            tag, channels, rate, align, bits = form
            if tag not in (1, 3) or not channels or bits not in ((8, 16, 24, 32) if tag == 1 else (32, 64)):
                raise ReadError(f"format {tag} with {bits} bits and {channels} channels is not read here")
            width = bits // 8 * channels
            stop = min(body + size, len(raw))
            stop -= (stop - body) % width
            return Wav(rate, bits, _samples(raw[body:stop], tag, bits).reshape(-1, channels), tag == 3, min(body + size + (size & 1), len(raw)))
        at = body + size + (size & 1)
    raise ReadError("no data chunk")


def _samples(raw: bytes, tag: int, bits: int) -> np.ndarray:
    if tag == 3:
        return np.frombuffer(raw, "<f4" if bits == 32 else "<f8").astype(np.float32 if bits == 32 else np.float64)
    if bits == 8:  # unsigned, the middle at 128
        return (np.frombuffer(raw, np.uint8).astype(np.int16) - 128) * np.int16(256)
    if bits == 16:
        return np.frombuffer(raw, "<i2").astype(np.int16)
    if bits == 32:
        return np.frombuffer(raw, "<i4").astype(np.int32)
    three = np.frombuffer(raw, np.uint8).reshape(-1, 3)
    four = np.zeros((len(three), 4), np.uint8)
    four[:, 1:] = three
    return four.reshape(-1).view("<i4").astype(np.int32)


def quantised(data: np.ndarray, bits: int) -> np.ndarray:
    """Samples of any kind as integers of so many bits, floats clipped."""
    if data.dtype.kind == "f":
        high = (1 << (bits - 1)) - 1
        return np.clip(np.rint(data.astype(np.float64) * (high + 1)), -high - 1, high).astype(np.int64)
    have = data.dtype.itemsize * 8
    wide = data.astype(np.int64)
    return wide >> (have - bits) if have >= bits else wide << (bits - have)


def write(data: np.ndarray, rate: int, bits: int | None = None) -> bytes:
    """A file of (frames, channels) or (frames,) samples; without bits in the samples' own kind."""
    data = data[:, None] if data.ndim == 1 else data
    if bits is None and data.dtype.kind == "f":
        tag, bits, raw = 3, data.dtype.itemsize * 8, np.ascontiguousarray(data, data.dtype.newbyteorder("<")).tobytes()
    else:
        bits = bits or data.dtype.itemsize * 8
        values = quantised(data, bits)
        tag = 1
        if bits == 8:
            raw = (values + 128).astype(np.uint8).tobytes()
        elif bits == 24:
            raw = np.ascontiguousarray(values.astype("<i4")).view(np.uint8).reshape(-1, 4)[:, :3].tobytes()
        else:
            raw = values.astype(f"<i{bits // 8}").tobytes()
    width = bits // 8 * data.shape[1]
    head = b"fmt " + struct.pack("<IHHIIHH", 16, tag, data.shape[1], rate, rate * width, width, bits)
    body = head + b"data" + struct.pack("<I", len(raw)) + raw + b"\0" * (len(raw) & 1)
    return b"RIFF" + struct.pack("<I", 4 + len(body)) + b"WAVE" + body
