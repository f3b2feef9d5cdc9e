"""Baseline JPEG in numpy: sequential files of 8 bits are read, in grey or colour, with any sampling; colour is written unsampled."""

from __future__ import annotations

import struct
from bisect import bisect_right

import numpy as np

from ...errors import CodecUnavailable, ReadError

# The quantisation tables and Huffman codes that the standard gives as typical, row by row.
LUMINANCE = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
CHROMINANCE = [17, 18, 24, 47, 99, 99, 99, 99, 18, 21, 26, 66, 99, 99, 99, 99, 24, 26, 56, 99, 99, 99, 99, 99, 47, 66, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99, 99]
#: How many codes there are of each length from 1 to 16, and what they stand for.
DC_COUNTS, DC_SYMBOLS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], list(range(12))
#: RGB to luminance and two colour differences.
TO_YCC = np.array([[0.299, 0.587, 0.114], [-0.168736, -0.331264, 0.5], [0.5, -0.418688, -0.081312]])

#: Where each of the 64 values of a block stands in zigzag order, as (row, column) numbers 8 * row + column.
ZIGZAG = np.array([8 * r + c for r, c in sorted(((r, c) for r in range(8) for c in range(8)), key=lambda at: (sum(at), at[0] if sum(at) % 2 else at[1]))])
_K = np.arange(8)
COSINES = np.cos((2 * _K[None] + 1) * _K[:, None] * np.pi / 16) * np.where(_K[:, None] == 0, np.sqrt(1 / 8), 0.5)


def _codes(counts: list[int]) -> list[tuple[int, int]]:
    """(code, bits) of each symbol in turn: codes of a length follow one another."""
    made, code = [], 0
    for bits, n in enumerate(counts, 1):
        made += [(code + k, bits) for k in range(n)]
        code = (code + n) << 1
    return made


def _lengths(frequency: dict[int, int]) -> tuple[list[int], list[int]]:
    """Counts of code lengths up to 16, and the symbols, for symbols of these frequencies; no code is all ones."""
    groups = [(n, [s]) for s, n in frequency.items()] + [(0, [-1])]  # the symbol -1 takes the code that must not be
    depth = dict.fromkeys([*frequency, -1], 0)
    while len(groups) > 1:
        groups.sort(key=lambda g: (g[0], len(g[1])))
        (n, a), (m, b) = groups[:2]
        for s in a + b:
            depth[s] += 1
        groups[:2] = [(n + m, a + b)]
    counts = np.bincount(list(depth.values()), minlength=64)
    for bits in range(len(counts) - 1, 16, -1):  # two codes too long: one stays in place of their parent, the other splits a shorter one
        while counts[bits]:
            short = max(k for k in range(1, bits - 1) if counts[k])
            counts[bits] -= 2
            counts[bits - 1] += 1
            counts[short] -= 1
            counts[short + 1] += 2
    longest = int(np.flatnonzero(counts)[-1])
    counts[longest] -= 1
    return counts[1:17].tolist(), sorted(frequency, key=lambda s: (-frequency[s], s))


def _quantisers(quality: int) -> list[np.ndarray]:
    if not 1 <= quality <= 100:
        raise ValueError(f"a quality is between 1 and 100, not {quality}")
    scale = 5000 // quality if quality < 50 else 200 - 2 * quality
    return [np.clip((np.array(t) * scale + 50) // 100, 1, 255) for t in (LUMINANCE, CHROMINANCE)]


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def write(image: np.ndarray, quality: int = 90) -> bytes:
    """A uint8 image of shape (height, width), or with 1 or 3 channels."""
    image = np.asarray(image, np.uint8)
    image = image[:, :, None] if image.ndim == 2 else image
    height, width, channels = image.shape
    if channels not in (1, 3) or not height or not width or max(height, width) > 65535:
        raise ValueError(f"no JPEG has the shape {image.shape}")
    planes = image.astype(float) @ TO_YCC.T - [128, 0, 0] if channels == 3 else image.astype(float) - 128
    planes = np.pad(planes, ((0, -height % 8), (0, -width % 8), (0, 0)), mode="edge")
    tables = _quantisers(quality)
    blocks = planes.reshape(planes.shape[0] // 8, 8, planes.shape[1] // 8, 8, channels).transpose(0, 2, 4, 1, 3)
    values = np.einsum("ki,abcij,lj->abckl", COSINES, blocks, COSINES).reshape(-1, channels, 64)
    values = np.rint(values / np.stack([tables[min(c, 1)] for c in range(channels)])).astype(int)[:, :, ZIGZAG]
    steps = np.diff(values[:, :, 0], axis=0, prepend=0)
    tokens: list[tuple[int, int, int, int]] = []  # table (0 of first values, 1 of others), symbol, further bits, how many
    for block, own in zip(values.reshape(-1, 64), steps.reshape(-1), strict=True):
        own = int(own)
        size = abs(own).bit_length()
        tokens.append((0, size, own if own >= 0 else own + (1 << size) - 1, size))
        last = 0
        for k in np.flatnonzero(block[1:]).tolist():
            value, zeros = int(block[k + 1]), k - last
            last = k + 1
            tokens += [(1, 0xF0, 0, 0)] * (zeros >> 4)
            size = abs(value).bit_length()
            tokens.append((1, (zeros & 15) << 4 | size, value if value >= 0 else value + (1 << size) - 1, size))
        if last < 63:
            tokens.append((1, 0, 0, 0))
    frequency: dict[int, int] = {}
    for table, symbol, *_ in tokens:
        if table:
            frequency[symbol] = frequency.get(symbol, 0) + 1
    huffman = [(DC_COUNTS, DC_SYMBOLS), _lengths(frequency)]
    code_of = [dict(zip(symbols, _codes(counts), strict=True)) for counts, symbols in huffman]
    bits = "".join(format(code_of[t][s][0], f"0{code_of[t][s][1]}b") + (format(extra, f"0{n}b") if n else "") for t, s, extra, n in tokens)
    bits += "1" * (-len(bits) % 8)
    out = [b"\xff\xd8", _segment(0xE0, b"JFIF\0\1\1\0\0\1\0\1\0\0")]
    out += [_segment(0xDB, bytes([k]) + bytes(tables[k][ZIGZAG].tolist())) for k in range(min(channels, 2))]
    out.append(_segment(0xC0, struct.pack(">BHHB", 8, height, width, channels) + b"".join(bytes([c + 1, 0x11, min(c, 1)]) for c in range(channels))))
    out += [_segment(0xC4, bytes([k << 4]) + bytes(counts) + bytes(symbols)) for k, (counts, symbols) in enumerate(huffman)]
    out.append(_segment(0xDA, bytes([channels]) + b"".join(bytes([c + 1, 0]) for c in range(channels)) + b"\0\x3f\0"))
    return b"".join(out) + int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\0") + b"\xff\xd9"


def _lookup(counts: list[int], symbols: bytes) -> tuple[list[int], list[int]]:
    """Codes as the 16 bits that they begin at, in order, and for each its length times 256 and its symbol; 0 after the last."""
    starts, found, end = [], [], 0
    for (code, bits), symbol in zip(_codes(counts), symbols, strict=False):
        if code >> bits:
            raise ReadError("a Huffman table is damaged")
        starts.append(code << (16 - bits))
        found.append(bits << 8 | symbol)
        end = (code + 1) << (16 - bits)
    return [*starts, end], [*found, 0]


class _Bits:
    def __init__(self, raw: bytes):
        self.raw, self.at, self.end = raw + bytes(4), 0, 8 * len(raw)

    def peek(self) -> int:
        k = self.at >> 3
        return (self.raw[k] << 16 | self.raw[k + 1] << 8 | self.raw[k + 2]) >> (8 - (self.at & 7)) & 0xFFFF

    def symbol(self, table: tuple[list[int], list[int]]) -> int:
        starts, codes = table
        found = codes[bisect_right(starts, self.peek()) - 1]
        self.at += found >> 8
        if not found or self.at > self.end:
            raise ReadError("a JPEG scan is damaged or cut short")
        return found & 255

    def value(self, size: int) -> int:
        if not size:
            return 0
        found = self.peek() >> (16 - size)
        self.at += size
        return found if found >> (size - 1) else found - (1 << size) + 1


def read(raw: bytes) -> np.ndarray:
    """The image as uint8 (height, width, 1 or 3)."""
    if raw[:2] != b"\xff\xd8":
        raise ReadError("no JPEG file")
    at, quantisers, lookups, frame, restart = 2, {}, {}, None, 0
    adobe = None
    while True:
        while at < len(raw) and raw[at] == 0xFF and raw[at + 1 : at + 2] == b"\xff":
            at += 1
        if at + 4 > len(raw) or raw[at] != 0xFF:
            raise ReadError("a JPEG file without a scan")
        marker, size = raw[at + 1], struct.unpack_from(">H", raw, at + 2)[0]
        body, at = raw[at + 4 : at + 2 + size], at + 2 + size
        if len(body) < size - 2:
            raise ReadError("a JPEG segment is cut short")
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                values = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1)
                quantisers[body[k] & 15] = values.astype(float)
                k += 65 + 64 * wide
        elif marker == 0xC4:
            k = 0
            while k + 17 <= len(body):
                counts = list(body[k + 1 : k + 17])
                lookups[body[k]] = _lookup(counts, body[k + 17 : k + 17 + sum(counts)])
                k += 17 + sum(counts)
        elif marker in (0xC0, 0xC1):
            depth, height, width, n = struct.unpack_from(">BHHB", body)
            frame = [(body[6 + 3 * c], body[7 + 3 * c] >> 4, body[7 + 3 * c] & 15, body[8 + 3 * c]) for c in range(n)]
            if depth != 8 or n not in (1, 3) or not height or not width or not all(h and v for _, h, v, _ in frame):
                raise CodecUnavailable("JPEG of this depth, size or number of colours needs a library that is not installed here")
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise CodecUnavailable("progressive and arithmetic JPEG need a library that is not installed here")
        elif marker == 0xDD:
            restart = struct.unpack_from(">H", body)[0]
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            adobe = body[11]
        elif marker == 0xDA:
            break
    if frame is None or body[0] != len(frame):
        raise ReadError("a JPEG scan without all of its colours")
    try:
        own = {body[1 + 2 * k]: (lookups[body[2 + 2 * k] >> 4], lookups[0x10 | body[2 + 2 * k] & 15]) for k in range(len(frame))}
        parts = [(h, v, quantisers[q], *own[name]) for name, h, v, q in frame]
    except KeyError as error:
        raise ReadError("a JPEG table is missing") from error
    planes = _scan(raw, at, parts, height, width, restart)
    if len(planes) == 1:
        return np.clip(np.rint(planes[0] + 128), 0, 255).astype(np.uint8)[:, :, None]
    image = np.stack(planes, axis=2)
    if adobe == 0:  # already red, green and blue
        image = image + 128
    else:
        image = (image + [128, 0, 0]) @ np.linalg.inv(TO_YCC).T
    return np.clip(np.rint(image), 0, 255).astype(np.uint8)


def _scan(raw: bytes, at: int, parts: list[tuple], height: int, width: int, restart: int) -> list[np.ndarray]:
    """The planes of a scan, without their offset of 128, all of the image's size."""
    if len(parts) == 1:  # a scan of one colour goes block by block, whatever its sampling
        parts = [(1, 1, *parts[0][2:])]
    most_h, most_v = max(p[0] for p in parts), max(p[1] for p in parts)
    across, down = -(-width // (8 * most_h)), -(-height // (8 * most_v))
    pieces, begin = [], at
    while True:  # pieces between restart markers; 0xFF00 stands for 0xFF
        at = raw.find(b"\xff", at)
        if at < 0 or at + 1 >= len(raw):
            pieces.append(raw[begin:])
            break
        follows = raw[at + 1]
        if follows and follows != 0xFF:
            pieces.append(raw[begin:at])
            if not 0xD0 <= follows <= 0xD7:
                break
            begin = at + 2
        at += 1 if follows == 0xFF else 2
    bits = iter([_Bits(p.replace(b"\xff\0", b"\xff")) for p in pieces])
    values = [np.zeros((down * v, across * h, 64), np.int64) for h, v, *_ in parts]
    now, last = None, [0] * len(parts)
    for unit in range(across * down):
        if now is None or (restart and unit % restart == 0):
            now, last = next(bits, None), [0] * len(parts)
            if now is None:
                raise ReadError("a JPEG scan is cut short")
        row, column = divmod(unit, across)
        for c, (h, v, _, first, others) in enumerate(parts):
            for y in range(v):
                for x in range(h):
                    last[c] += now.value(now.symbol(first))
                    block = [0] * 64
                    block[0], k = last[c], 1
                    while k < 64:
                        code = now.symbol(others)
                        if not code & 15:
                            if code != 0xF0:
                                break
                            k += 16
                            continue
                        k += code >> 4
                        if k > 63:
                            raise ReadError("a JPEG block is damaged")
                        block[k] = now.value(code & 15)
                        k += 1
                    values[c][row * v + y, column * h + x] = block
    planes = []
    for (h, v, quantiser, *_), own in zip(parts, values, strict=True):
        plain = np.zeros(own.shape)
        plain[:, :, ZIGZAG] = own * quantiser
        made = np.einsum("ki,abkl,lj->aibj", COSINES, plain.reshape(*own.shape[:2], 8, 8), COSINES)
        made = made.reshape(own.shape[0] * 8, own.shape[1] * 8)
        planes.append(np.repeat(np.repeat(made, most_v // v, 0), most_h // h, 1)[:height, :width])
    return planes
