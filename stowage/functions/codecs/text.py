"""Texts as zstd frames."""

from __future__ import annotations

import os

import zstandard


def encode(item: str, *, is_path: bool = False, compression_level: int = 3) -> tuple[bytes, dict]:
    """(payload, metadata) of a text, or of a file's contents if is_path."""
    if is_path:
        with open(item, "rb") as file:
            raw = file.read()
        raw.decode("utf-8")
    else:
        raw = item.encode("utf-8")
    packed = zstandard.ZstdCompressor(level=compression_level).compress(raw)
    return packed, {"original_path": os.fspath(item) if is_path else "", "original_size": len(raw), "compressed_size": len(packed)}


def decode(payload: bytes) -> dict:
    """Frames without a content size are read too."""
    return {"text": zstandard.ZstdDecompressor().decompressobj().decompress(payload).decode("utf-8")}
