"""PNG images, with zlib and numpy."""

from __future__ import annotations

import struct
import zlib

import numpy as np

from ...errors import ReadError

SIGNATURE = b"\x89PNG\r\n\x1a\n"
#: Values of a pixel for each colour type: grey, RGB, palette index, grey with alpha, RGB with alpha.
VALUES = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def write(image: np.ndarray) -> bytes:
    """A uint8 image of shape (height, width) or (height, width, 1 to 4)."""
    image = np.ascontiguousarray(image[:, :, None] if image.ndim == 2 else image, np.uint8)
    height, width, channels = image.shape
    colour = {1: 0, 3: 2, 2: 4, 4: 6}.get(channels)
    if colour is None or not height or not width:
        raise ValueError(f"no PNG has the shape {image.shape}")
    rows = np.zeros((height, 1 + width * channels), np.uint8)
    rows[:, 1:] = image.reshape(height, -1)
    rows[1:, 0] = 2  # each row but the first as its difference to the one above
    rows[1:, 1:] -= image.reshape(height, -1)[:-1]
    head = struct.pack(">IIBBBBB", width, height, 8, colour, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(rows.tobytes(), 6)) + _chunk(b"IEND", b"")


def read(raw: bytes) -> np.ndarray:
    """The image as uint8 (height, width, channels); palette images as their indices. Only 8 bits, not interlaced."""
    if raw[:8] != SIGNATURE:
        raise ReadError("no PNG file")
    at, data, head = 8, [], None
    while at + 8 <= len(raw):
        size, kind = struct.unpack_from(">I4s", raw, at)
        body = raw[at + 8 : at + 8 + size]
        if len(body) < size or raw[at + 8 + size : at + 12 + size] != struct.pack(">I", zlib.crc32(kind + body)):
            raise ReadError("a chunk is damaged")
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        elif kind == b"IEND":
            break
        at += 12 + size
    if head is None or head[2] != 8 or head[6] or head[3] not in VALUES:
        raise ReadError("this kind of PNG is not read here")
    width, height, _, colour = head[:4]
    n = VALUES[colour]
    rows = np.frombuffer(zlib.decompress(b"".join(data)), np.uint8)
    if len(rows) < height * (1 + width * n):
        raise ReadError("rows are missing")
    rows = rows[: height * (1 + width * n)].reshape(height, -1)
    out = np.zeros((height + 1, width * n), np.uint8)
    for y in range(height):
        out[y + 1] = _unfiltered(int(rows[y, 0]), rows[y, 1:], out[y], n)
    return out[1:].reshape(height, width, n)


def _unfiltered(kind: int, row: np.ndarray, above: np.ndarray, n: int) -> np.ndarray:
    if kind == 0:
        return row
    if kind == 1:
        return np.cumsum(row.reshape(-1, n), 0, dtype=np.uint8).reshape(-1)
    if kind == 2:
        return row + above
    if kind not in (3, 4):
        raise ReadError(f"no such filter: {kind}")
    x, up, out = row.tolist(), above.tolist(), []
    for k, value in enumerate(x):
        left = out[k - n] if k >= n else 0
        if kind == 3:
            guess = (left + up[k]) // 2
        else:
            corner = up[k - n] if k >= n else 0
            p = left + up[k] - corner
            far = (abs(p - left), abs(p - up[k]), abs(p - corner))
            guess = (left, up[k], corner)[far.index(min(far))]
        out.append((value + guess) & 255)
    return np.array(out, np.uint8)
