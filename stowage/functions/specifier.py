"""Kaldi's specifiers and extended file names."""

from __future__ import annotations

import re

# Kaldi's options.
#: Options that readers know; none changes what is read here.
READ_OPTIONS = frozenset(["o", "no", "s", "ns", "cs", "ncs", "p", "np", "bg", "t", "b"])
WRITE_OPTIONS = frozenset(["t", "f"])
FLAGS = ("t", "o", "p", "f", "s", "cs")


def parse_rspecifier(text: str) -> tuple[str, str]:
    """(ark or scp, file name)."""
    head, colon, name = text.partition(":")
    kinds = [x for x in head.split(",") if x in ("ark", "scp")]
    unknown = [x for x in head.split(",") if x not in READ_OPTIONS and x not in ("ark", "scp")]
    if not colon or len(kinds) != 1 or unknown or not name.strip():
        raise ValueError(f"a specifier to read from is like ark:file or scp:file, not {text!r}")
    return kinds[0], name.strip()


def parse_wspecifier(text: str) -> dict:
    """ark and scp, the file names (scp may be None), and text and flush."""
    head, colon, names = text.partition(":")
    words = head.split(",")
    files = [x for x in words if x in ("ark", "scp")]
    unknown = [x for x in words if x not in WRITE_OPTIONS and x not in ("ark", "scp")]
    if not colon or "ark" not in files or len(files) != len(set(files)) or unknown:
        raise ValueError(f"a specifier to write to is like ark:file or ark,scp:file,file, not {text!r}")
    parts = [x.strip() for x in names.split(",", len(files) - 1)]
    if len(parts) != len(files) or not all(parts):
        raise ValueError(f"{text!r} has to name {len(files)} files")
    found = dict(zip(files, parts, strict=True))
    return {"ark": found["ark"], "scp": found.get("scp"), "text": "t" in words, "flush": "f" in words}


def parse_specifier(text: str) -> dict:
    """What a specifier of either kind says: ark, scp and the flags t, o, p, f, s and cs. Other options, and fewer files than named, are errors."""
    head, colon, names = text.partition(":")
    words = head.split(",")
    files = [x for x in words if x in ("ark", "scp")]
    if not colon or not files or len(files) != len(set(files)) or set(words) - {"ark", "scp", *FLAGS}:
        raise ValueError(f"no specifier: {text!r}")
    parts = [x.strip() for x in names.split(",", len(files) - 1)]
    if len(parts) != len(files) or not all(parts):
        raise ValueError(f"{text!r} has to name {len(files)} files")
    found = dict(zip(files, parts, strict=True))
    return {"ark": found.get("ark"), "scp": found.get("scp")} | {flag: flag in words for flag in FLAGS}


def parse_extended_filename(name: str) -> tuple[str, int | None]:
    """(file, offset): the offset of `file:123`; pipes and drive letters have none."""
    name = name.strip()
    if name.startswith("|") or name.endswith("|"):
        return name, None
    found = re.fullmatch(r"(.+):(\d+)", name)
    return (found[1], int(found[2])) if found else (name, None)
