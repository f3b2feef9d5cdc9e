"""FLAC streams in plain Python and numpy: all subframes are read, fixed predictors and verbatim ones written."""

from __future__ import annotations

import hashlib

import numpy as np

from ...errors import ReadError

BLOCK = 4096
#: Fixed values of the format.
SIZES = {1: 192, **{k: 576 << (k - 2) for k in range(2, 6)}, **{k: 256 << (k - 8) for k in range(8, 16)}}
RATES = {1: 88200, 2: 176400, 3: 192000, 4: 8000, 5: 16000, 6: 22050, 7: 24000, 8: 32000, 9: 44100, 10: 48000, 11: 96000}
WIDTHS = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}


def _crc_table(width: int, polynomial: int) -> list[int]:
    top, mask, table = 1 << (width - 1), (1 << width) - 1, []
    for byte in range(256):
        value = byte << (width - 8)
        for _ in range(8):
            value = (value << 1 ^ polynomial if value & top else value << 1) & mask
        table.append(value)
    return table


_CRC8, _CRC16 = _crc_table(8, 0x07), _crc_table(16, 0x8005)


def _crc8(data: bytes) -> int:
    value = 0
    for b in data:
        value = _CRC8[value ^ b]
    return value


def _crc16(data: bytes) -> int:
    value = 0
    for b in data:
        value = (value << 8 & 0xFFFF) ^ _CRC16[value >> 8 ^ b]
    return value


class _Bits:
    """Bits of a byte string, as an integer of some thousand bytes at a time."""

    def __init__(self, raw: bytes, at: int):
        self.raw, self.at = raw, at * 8

    def take(self, n: int) -> int:
        first, last = self.at >> 3, (self.at + n + 7) >> 3
        if last > len(self.raw):
            raise ReadError("a FLAC frame is cut short")
        value = int.from_bytes(self.raw[first:last], "big") >> ((last << 3) - self.at - n) & ((1 << n) - 1)
        self.at += n
        return value

    def signed(self, n: int) -> int:
        value = self.take(n) if n else 0
        return value - (1 << n) if n and value >> (n - 1) else value

    def unary(self) -> int:
        zeros = 0
        while not self.take(1):
            zeros += 1
        return zeros


def _rice(bits: _Bits, n: int, rice: int) -> np.ndarray:
    """n Rice codes: where each ends is found along a table of the next one bit, the values all at once."""
    room = n * (rice + 4) + 64
    while True:
        first = bits.at >> 3
        raw = bits.raw[first : first + (room >> 3) + 16]
        plain = np.unpackbits(np.frombuffer(raw, np.uint8))
        places = np.where(plain == 1, np.arange(len(plain)), len(plain))
        following = np.minimum.accumulate(places[::-1])[::-1].tolist()
        begin = at = bits.at & 7
        ends = []
        while len(ends) < n and at < len(following) and following[at] + rice < len(plain):
            ends.append(following[at])
            at = ends[-1] + 1 + rice
        if len(ends) == n:
            break
        if first + len(raw) >= len(bits.raw):
            raise ReadError("a FLAC frame is cut short")
        room *= 2
    bits.at += at - begin
    end = np.array(ends, np.int64)
    high = end - np.concatenate([[begin], end[:-1] + 1 + rice])
    low = plain[end[:, None] + 1 + np.arange(rice)].astype(np.int64) @ (1 << np.arange(rice, dtype=np.int64)[::-1]) if rice else 0
    value = high << rice | low
    return value >> 1 ^ -(value & 1)


def _residual(bits: _Bits, size: int, order: int) -> np.ndarray:
    method, parts = bits.take(2), 1 << bits.take(4)
    if method > 1 or size % parts:
        raise ReadError("a FLAC residual is damaged")
    width, out = 4 + method, [np.zeros(0, np.int64)]
    for k in range(parts):
        n = size // parts - (order if k == 0 else 0)
        rice = bits.take(width)
        if rice == (1 << width) - 1:
            raw = bits.take(5)
            out.append(np.array([bits.signed(raw) for _ in range(n)], np.int64))
        elif n > 0:
            out.append(_rice(bits, n, rice))
    return np.concatenate(out)


def _summed(first: list[int], residual: np.ndarray) -> np.ndarray:
    """Samples whose differences, taken as often as there are first ones, are the residual: sums of sums."""
    made = residual
    for k in range(len(first) - 1, -1, -1):
        start = int(np.diff(np.array(first, np.int64), k)[0])
        made = np.concatenate([[start], start + np.cumsum(made)])
    return made


def _subframe(bits: _Bits, size: int, width: int) -> list[int] | np.ndarray:
    if bits.take(1):
        raise ReadError("a FLAC subframe is damaged")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.unary() + 1
    width -= wasted
    if kind == 0:
        out = [bits.signed(width)] * size
    elif kind == 1:
        out = [bits.signed(width) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        out = [bits.signed(width) for _ in range(order)]
        if kind < 32:
            return _summed(out, _residual(bits, size, order)) << wasted
        precision = bits.take(4) + 1
        shift = bits.signed(5)
        back = [bits.signed(precision) for _ in range(order)][::-1]
        for r in _residual(bits, size, order).tolist():
            guess = sum(w * x for w, x in zip(back, out[len(out) - order :], strict=True)) if order else 0
            out.append(r + (guess >> shift))
    else:
        raise ReadError("a FLAC subframe is of no known kind")
    return [x << wasted for x in out] if wasted else out


def read(raw: bytes) -> tuple[int, int, np.ndarray]:
    """(rate, bits, samples as integers, (frames, channels))."""
    if raw[:4] != b"fLaC":
        raise ReadError("no FLAC file")
    at, info = 4, None
    while True:
        if at + 4 > len(raw):
            raise ReadError("a FLAC file without frames")
        last, kind, size = raw[at] >> 7, raw[at] & 127, int.from_bytes(raw[at + 1 : at + 4], "big")
        if kind == 0:
            info = raw[at + 4 : at + 4 + size]
        at += 4 + size
        if last:
            break
    if info is None or len(info) < 34:
        raise ReadError("a FLAC file without stream information")
    packed = int.from_bytes(info[10:18], "big")
    rate, channels, width, total = packed >> 44, (packed >> 41 & 7) + 1, (packed >> 36 & 31) + 1, packed & (1 << 36) - 1
    blocks, done = [], 0
    while at < len(raw) and (not total or done < total):
        bits = _Bits(raw, at)
        if bits.take(14) != 0x3FFE:
            raise ReadError("a FLAC frame is missing")
        bits.take(2)
        size_code, rate_code, layout, width_code = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        bits.take(1)
        lead = bits.take(8)
        more = 8 - (~lead & 0xFF).bit_length() if lead & 128 else 0
        for _ in range(max(0, more - 1)):
            bits.take(8)
        size = bits.take(8) + 1 if size_code == 6 else bits.take(16) + 1 if size_code == 7 else SIZES.get(size_code, 0)
        bits.take({12: 8, 13: 16, 14: 16}.get(rate_code, 0)) if rate_code in (12, 13, 14) else None
        if bits.take(8) != _crc8(raw[at : (bits.at >> 3) - 1]) or not size:
            raise ReadError("a FLAC frame's head is damaged")
        depth = WIDTHS.get(width_code, width)
        n = layout + 1 if layout < 8 else 2
        side = {8: 1, 9: 0, 10: 1}.get(layout)
        parts = [np.array(_subframe(bits, size, depth + (k == side)), np.int64) for k in range(n)]
        if layout == 8:
            parts[1] = parts[0] - parts[1]
        elif layout == 9:
            parts[0] = parts[0] + parts[1]
        elif layout == 10:
            middle = (parts[0] << 1) | (parts[1] & 1)
            parts = [(middle + parts[1]) >> 1, (middle - parts[1]) >> 1]
        end = (bits.at + 7) >> 3
        if int.from_bytes(raw[end : end + 2], "big") != _crc16(raw[at:end]):
            raise ReadError("a FLAC frame is damaged")
        at = end + 2
        blocks.append(np.column_stack(parts))
        done += size
    return rate, width, np.concatenate(blocks) if blocks else np.zeros((0, channels), np.int64)


def _coded(data: np.ndarray, width: int) -> tuple[int, int]:
    """A subframe as (value, bits): the fixed predictor with the least residual, or the samples as they are."""
    n = len(data)
    best, order = None, 0
    for k in range(min(5, n)):
        residual = np.diff(data, k) if k else data
        cost = int(np.abs(residual).sum())
        if best is None or cost < best[0]:
            best, order = (cost, residual), k
    residual = best[1]
    mapped = np.where(residual >= 0, 2 * residual, -2 * residual - 1)
    mean = max(1.0, float(mapped.mean())) if len(mapped) else 1.0
    rice = min(30, max(0, int(np.log2(mean))))
    length = 8 + width * order + 2 + 4 + 5 + int((mapped >> rice).sum()) + len(mapped) * (1 + rice)
    if length >= 8 + width * n:
        text = "".join(format(int(x) & ((1 << width) - 1), f"0{width}b") for x in data)
        return int("1" + "00000010" + text, 2) ^ (1 << (8 + len(text))), 8 + width * n
    head = "0" + format(8 + order, "06b") + "0" + "".join(format(int(x) & ((1 << width) - 1), f"0{width}b") for x in data[:order])
    tail = "".join("0" * (int(m) >> rice) + "1" + (format(int(m) & ((1 << rice) - 1), f"0{rice}b") if rice else "") for m in mapped)
    text = head + "01" + "0000" + format(rice, "05b") + tail
    return int(text, 2), len(text)


def write(data: np.ndarray, rate: int, bits: int = 16) -> bytes:
    """A file of integer samples, (frames, channels), of 8, 16, 24 or 32 bits."""
    channels = data.shape[1]
    if not 1 <= channels <= 8:
        raise ValueError(f"FLAC has 1 to 8 channels, not {channels}")
    codes = {8: 1, 16: 4, 24: 6, 32: 7}
    frames = []
    for number, at in enumerate(range(0, len(data), BLOCK)):
        block = data[at : at + BLOCK].astype(np.int64)
        head = bytes([0xFF, 0xF8, 0x70, (channels - 1) << 4 | codes[bits] << 1]) + chr(number).encode("utf-8", "surrogatepass") + (len(block) - 1).to_bytes(2, "big")
        head += bytes([_crc8(head)])
        value = length = 0
        for k in range(channels):
            own, n = _coded(block[:, k], bits)
            value, length = value << n | own, length + n
        pad = -length % 8
        body = head + (value << pad).to_bytes((length + pad) // 8, "big")
        frames.append(body + _crc16(body).to_bytes(2, "big"))
    packed = rate << 44 | (channels - 1) << 41 | (bits - 1) << 36 | len(data)
    digest = hashlib.md5(np.ascontiguousarray(data.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, : bits // 8].tobytes()).digest()
    info = BLOCK.to_bytes(2, "big") * 2 + bytes(6) + packed.to_bytes(8, "big") + digest
    return b"fLaC" + bytes([0x80]) + len(info).to_bytes(3, "big") + info + b"".join(frames)
