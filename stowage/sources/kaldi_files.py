"""Kaldi files on one machine: mappings, readers and writers that go by specifiers. DataFrames are in stowage.sources.kaldi."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

from ..errors import ReadError
from ..functions.codecs import kaldi_obj as K
from ..functions.specifier import parse_extended_filename, parse_rspecifier, parse_wspecifier
from .kaldi import _Loader, load_ark, opened, opened_to_write


def scp_lines(path: str, separator: str | None = None) -> list[tuple[str, str]]:
    """(key, file name) of each line."""
    found = []
    with opened(path) as file:
        for number, line in enumerate(file.read().decode().splitlines(), 1):
            if not line.strip():
                continue
            parts = line.strip().split(separator, 1)
            if len(parts) != 2 or not parts[1].strip():
                raise ReadError(f"{path}:{number}: not a key and a value")
            found.append((parts[0], parts[1].strip()))
    return found


def segment_lines(path: str) -> list[tuple[str, str, float, float]]:
    found = []
    with opened(path) as file:
        for number, line in enumerate(file.read().decode().splitlines(), 1):
            if line.strip():
                parts = line.split()
                if len(parts) != 4:
                    raise ReadError(f"{path}:{number}: not four fields")
                found.append((parts[0], parts[1], float(parts[2]), float(parts[3])))
    return found


class Scp(Mapping):
    """The objects of an scp by key, read when they are asked for; of equal keys the last holds."""

    def __init__(self, path: str, endian: str = "<", separator: str | None = None, open_files: int = 32, allow_pipes: bool = False):
        self.names = dict(scp_lines(path, separator))
        self.endian, self.allow_pipes, self.loader = endian, allow_pipes, _Loader(open_files)

    def __getitem__(self, key: str):
        return self.loader.load(*parse_extended_filename(self.names[key]), self.endian, self.allow_pipes)

    def __iter__(self) -> Iterator[str]:
        return iter(self.names)

    def __len__(self) -> int:
        return len(self.names)


class Segments(Mapping):
    """Pieces of an scp's recordings by utterance; the recording read last is kept."""

    def __init__(self, recordings: Scp, path: str):
        self.recordings = recordings
        self.pieces = {utt: rest for utt, *rest in segment_lines(path)}

    def __getitem__(self, utt: str):
        rec, start, end = self.pieces[utt]
        if rec not in self.recordings:
            raise ReadError(f"no such recording: {rec}")
        return K.slice_segment(self.recordings[rec], start, end)

    def __iter__(self) -> Iterator[str]:
        return iter(self.pieces)

    def __len__(self) -> int:
        return len(self.pieces)


class Reader:
    """(key, object) pairs of `ark:...` or `scp:...` in file order, with segments or not."""

    def __init__(self, rspecifier: str, segments: str | None = None, endian: str = "<", separator: str | None = None, allow_pipes: bool = False):
        self.kind, self.name = parse_rspecifier(rspecifier)
        if segments is not None and self.kind != "scp":
            raise ValueError("segments need an scp")
        self.segments, self.endian, self.separator, self.allow_pipes = segments, endian, separator, allow_pipes

    def __iter__(self) -> Iterator[tuple[str, object]]:
        if self.kind == "ark":
            for key, value, _ in load_ark(self.name, self.endian, self.allow_pipes):
                yield key, value
        elif self.segments is not None:
            yield from Segments(Scp(self.name, self.endian, self.separator, allow_pipes=self.allow_pipes), self.segments).items()
        else:
            with _Loader() as loader:
                for key, name in scp_lines(self.name, self.separator):
                    yield key, loader.load(*parse_extended_filename(name), self.endian, self.allow_pipes)

    def __enter__(self) -> Reader:
        return self

    def __exit__(self, *_) -> None:
        pass


class Writer:
    """writer[key] = object, for `ark:...` or `ark,scp:...`."""

    def __init__(self, wspecifier: str, compression_method: int | None = None, endian: str = "<", sound=None, allow_pipes: bool = False):
        spec = parse_wspecifier(wspecifier)
        self.ark, self.text, self.flush = spec["ark"], spec["text"], spec["flush"]
        if spec["scp"] is not None and (self.ark == "-" or self.ark.startswith("|") or self.ark.endswith(".gz")):
            raise ValueError(f"{self.ark!r} has no offsets for an scp")
        self.how = {} if self.text else {"endian": endian, "compression_method": compression_method, "sound": sound}
        self.opened = [opened_to_write(self.ark, allow_pipes=allow_pipes)] + ([opened_to_write(spec["scp"])] if spec["scp"] else [])
        self.files = [x.__enter__() for x in self.opened]
        self.at = 0

    def __setitem__(self, key: str, value) -> None:
        if not self.files:
            raise ValueError("the writer is closed")
        if not isinstance(key, str):
            raise TypeError("a key is a string")
        raw, start = K.record(key, value, self.text, **self.how)
        self.files[0].write(raw)
        if len(self.files) > 1:
            self.files[1].write(f"{key} {self.ark}:{self.at + start}\n".encode())
        self.at += len(raw)
        if self.flush:
            for file in self.files:
                file.flush()

    def close(self) -> None:
        for x in self.opened if self.files else ():
            x.__exit__(None, None, None)
        self.files = []

    def __enter__(self) -> Writer:
        return self

    def __exit__(self, *_) -> None:
        self.close()
