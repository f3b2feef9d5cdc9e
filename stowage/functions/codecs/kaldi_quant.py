"""Kaldi's compressed matrices: seven ways to quantise float32 values to 8 or 16 bits."""

from __future__ import annotations

import struct

import numpy as np

from ...errors import ReadError

F = np.float32
#: Formats on disk: one byte with percentiles of each column, two bytes, one byte.
TOKENS = {b"CM": 1, b"CM2": 2, b"CM3": 3}
#: Fixed values of Kaldi: method -> (format, minimum, range) where these do not depend on the data.
FIXED = {4: (2, -32768.0, 65535.0), 6: (3, 0.0, 255.0), 7: (3, 0.0, 1.0)}
#: Fixed values of Kaldi: steps of a byte below the first quartile, between the quartiles and above the third.
STEPS = (64, 128, 63)


def header(matrix: np.ndarray, method: int) -> tuple[int, np.float32, np.float32]:
    """(format, minimum, range) for a method: 1 chooses, 2 speech features, 3 and 5 the data's own range, 4, 6 and 7 fixed ones."""
    if method in FIXED:
        form, low, wide = FIXED[method]
        return form, F(low), F(wide)
    form = {1: 1 if len(matrix) > 8 else 2, 2: 1, 3: 2, 5: 3}.get(method)
    if form is None:
        raise ValueError(f"no such compression method: {method}")
    low, high = F(matrix.min()), F(matrix.max())
    if high == low:
        high = F(low + (F(1) + abs(low)))
    return form, low, F(high - low)


def quantise(values: np.ndarray, low: np.float32, wide: np.float32, top: int) -> np.ndarray:
    """Integers from 0 to top; values outside the range are clipped."""
    share = np.clip((values.astype(F) - low) / wide, F(0), F(1))
    return np.floor(share * F(top) + F(0.499)).astype(np.uint16 if top > 255 else np.uint8)


def dequantise(codes: np.ndarray, low: np.float32, wide: np.float32, top: int) -> np.ndarray:
    return (low + (wide * codes.astype(F)) / F(top)).astype(F)


def percentiles(matrix: np.ndarray, low: np.float32, wide: np.float32) -> np.ndarray:
    """Of each column the codes of its least value, quartiles and greatest value, ascending strictly: (columns, 4)."""
    n = len(matrix)
    codes = quantise(np.sort(matrix, axis=0), low, wide, 65535).astype(np.int64)
    at = (0, n // 4, 3 * (n // 4), n - 1) if n >= 5 else (0, 1, 2, 3)
    out = np.zeros((matrix.shape[1], 4), np.int64)
    out[:, 0] = np.minimum(codes[at[0]], 65532)
    for k in (1, 2, 3):
        above = out[:, k - 1] + 1
        own = np.maximum(codes[at[k]], above) if at[k] < n else above
        out[:, k] = np.minimum(own, 65532 + k) if k < 3 else own
    return out.astype(np.uint16)


def to_bytes_by_column(matrix: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """Each value as a byte, by which two marks of its column (floats, (columns, 4)) it is between."""
    p = marks.T[:, None, :]
    out = np.zeros(matrix.shape, np.uint8)
    base = 0
    for k, steps in enumerate(STEPS):
        here = (matrix >= p[k] if k else np.ones(matrix.shape, bool)) & (matrix < p[k + 1] if k < 2 else True)
        code = base + np.floor((matrix - p[k]) / (p[k + 1] - p[k]) * F(steps) + F(0.5)).astype(np.int64)
        out[here] = np.clip(code, base, base + steps)[here]
        base += steps
    return out


def from_bytes_by_column(codes: np.ndarray, marks: np.ndarray) -> np.ndarray:
    p, c = marks.T[:, None, :], codes.astype(F)
    low = p[0] + (p[1] - p[0]) * c * F(1 / 64)
    middle = p[1] + (p[2] - p[1]) * (c - F(64)) * F(1 / 128)
    high = p[2] + (p[3] - p[2]) * (c - F(192)) * F(1 / 63)
    return np.where(codes <= 64, low, np.where(codes <= 192, middle, high)).astype(F)


def compress(matrix: np.ndarray, method: int, endian: str = "<") -> bytes:
    """The object's bytes after its key and binary mark."""
    if matrix.ndim != 2 or not matrix.size:
        raise ValueError("only a matrix with values can be compressed")
    matrix = matrix.astype(F)
    if not np.isfinite(matrix).all():
        raise ValueError("a matrix with NaN or infinite values cannot be compressed")
    form, low, wide = header(matrix, method)
    token = next(t for t, f in TOKENS.items() if f == form)
    head = token + b" " + struct.pack(endian + "ffii", low, wide, *matrix.shape)
    if form == 2:
        return head + quantise(matrix, low, wide, 65535).astype(endian + "u2").tobytes()
    if form == 3:
        return head + quantise(matrix, low, wide, 255).tobytes()
    marks = percentiles(matrix, low, wide)
    codes = to_bytes_by_column(matrix, dequantise(marks, low, wide, 65535))
    return head + marks.astype(endian + "u2").tobytes() + np.ascontiguousarray(codes.T).tobytes()


def data_size(form: int, rows: int, cols: int) -> int:
    return {1: cols * (8 + rows), 2: 2 * rows * cols, 3: rows * cols}[form]


def decompress(form: int, low: float, wide: float, rows: int, cols: int, data: bytes, endian: str = "<") -> np.ndarray:
    low, wide = F(low), F(wide)
    if len(data) != data_size(form, rows, cols):
        raise ReadError("a compressed matrix is cut short")
    if form == 2:
        return dequantise(np.frombuffer(data, endian + "u2").reshape(rows, cols), low, wide, 65535)
    if form == 3:
        return dequantise(np.frombuffer(data, np.uint8).reshape(rows, cols), low, wide, 255)
    marks = dequantise(np.frombuffer(data[: 8 * cols], endian + "u2").reshape(cols, 4), low, wide, 65535)
    return from_bytes_by_column(np.frombuffer(data[8 * cols :], np.uint8).reshape(cols, rows).T, marks)


def lossy(matrix: np.ndarray, method: int) -> np.ndarray:
    """What compressing and reading again makes of a matrix."""
    body = compress(matrix, method)
    token, _, rest = body.partition(b" ")
    low, wide, rows, cols = struct.unpack("<ffii", rest[:16])
    return decompress(TOKENS[token], low, wide, rows, cols, rest[16:])
