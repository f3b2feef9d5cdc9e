"""Byte ranges of files and URLs, and decoding them, by partitions."""

from __future__ import annotations

import http.client
import urllib.error
import urllib.request
from collections import OrderedDict
from collections.abc import Callable, Iterable, Iterator
from urllib.parse import urljoin, urlsplit

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import BinaryType, StringType, StructField, StructType

from ..errors import ReadError
from ..functions.codecs import registry, smf
from ..schemas import DECODED

#: Files that a task has open at once, and the most rows and bytes that it holds together (a single row may have more).
OPEN_FILES, ROWS, BYTES = 32, 1024, 4 << 20
#: Bytes between two ranges of a URL that are read with them, as a request of its own costs more than these.
GAP = 32 << 10


def is_remote(path: str) -> bool:
    return path.startswith(("http://", "https://"))


class Connections:
    """Asks HTTP servers and keeps the connections used last, one to each server, as a new one for each request costs more than the answer."""

    def __init__(self, most: int = OPEN_FILES, timeout: float = 60):
        self.kept: OrderedDict[tuple[str, str], http.client.HTTPConnection] = OrderedDict()
        self.most, self.timeout = most, timeout
        self.proxies = urllib.request.getproxies()

    def ask(self, url: str, headers: dict[str, str]) -> http.client.HTTPResponse:
        """The answer to a GET, whatever its status; redirections are followed. Read it to its end or close it before the next one."""
        for _ in range(10):
            reply = self._once(url, headers)
            if reply.status not in (301, 302, 303, 307, 308) or not (place := reply.getheader("Location")):
                return reply
            self.done(url, reply)
            url = urljoin(url, place)
        raise ReadError(f"{url}: too many redirections")

    def _once(self, url: str, headers: dict[str, str]) -> http.client.HTTPResponse:
        at = urlsplit(url)
        if at.scheme in self.proxies and not urllib.request.proxy_bypass(at.hostname or ""):
            try:
                return urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=self.timeout)
            except urllib.error.HTTPError as error:
                return error
        name, what = (at.scheme, at.netloc), (at.path or "/") + (f"?{at.query}" if at.query else "")
        while True:
            kept = self.kept.pop(name, None)
            kind = http.client.HTTPSConnection if at.scheme == "https" else http.client.HTTPConnection
            connection = kept or kind(at.netloc, timeout=self.timeout)
            try:
                connection.request("GET", what, headers=headers)
                reply = connection.getresponse()
            except (ConnectionError, http.client.BadStatusLine):
                connection.close()
                if kept is None:
                    raise
                continue  # the server has ended a connection that was idle
            except BaseException:
                connection.close()
                raise
            self.kept[name] = connection
            while len(self.kept) > self.most:
                self.kept.popitem(last=False)[1].close()
            return reply

    def done(self, url: str, reply: http.client.HTTPResponse) -> None:
        """Let go of an answer; a connection with much unread is closed."""
        if not reply.isclosed() and (reply.length is None or reply.length > 1 << 16 or reply.read() is None):
            at = urlsplit(url)
            if (connection := self.kept.pop((at.scheme, at.netloc), None)) is not None:
                connection.close()
        reply.close()

    def close(self) -> None:
        for connection in self.kept.values():
            connection.close()
        self.kept.clear()


class Ranges:
    """Reads ranges; keeps the files and connections used last open."""

    def __init__(self, most: int = OPEN_FILES, timeout: float = 60):
        self.files: OrderedDict[str, object] = OrderedDict()
        self.most, self.web = most, Connections(most, timeout)

    def read(self, path: str, start: int, end: int) -> bytes:
        """Bytes [start, end); fewer than that are an error."""
        if start < 0 or end < start:
            raise ReadError(f"no such range: [{start}, {end})")
        if end == start:
            return b""
        data = self._remote(path, start, end) if is_remote(path) else self._local(path, start, end)
        if len(data) != end - start:
            raise ReadError(f"{path}: {end - start} bytes from {start} are wanted, {len(data)} are there")
        return data

    def _local(self, path: str, start: int, end: int) -> bytes:
        file = self.files.pop(path, None) or open(path, "rb")
        self.files[path] = file
        while len(self.files) > self.most:
            self.files.popitem(last=False)[1].close()
        file.seek(start)
        return file.read(end - start)

    def _remote(self, path: str, start: int, end: int) -> bytes:
        reply = self.web.ask(path, {"Range": f"bytes={start}-{end - 1}"})
        try:
            if reply.status >= 400:
                raise ReadError(f"{path}: the server says {reply.status}")
            # a server that ignores ranges sends the whole file
            left = 0 if reply.status == 206 else start
            while left and (skipped := reply.read(min(left, 1 << 20))):
                left -= len(skipped)
            return reply.read(end - start)
        finally:
            self.web.done(path, reply)

    def close(self) -> None:
        for file in self.files.values():
            file.close()
        self.files.clear()
        self.web.close()


def weight(values: Iterable) -> int:
    """About how many bytes values take."""
    return sum(v.nbytes if isinstance(v, np.ndarray) else len(v) if isinstance(v, (bytes, str)) else 8 * len(v) if isinstance(v, list) else 8 for v in values)


def parts(batch: pa.RecordBatch, rows: int = ROWS, size: int = BYTES) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of so many rows and, by the mean of its rows, so many bytes at most."""
    step = max(1, min(rows, size * len(batch) // max(1, batch.nbytes)))
    for at in range(0, len(batch), step):
        yield batch.slice(at, step)


def _column(values: list, kind: pa.DataType) -> pa.Array:
    """Values as a column; notes may be structured arrays."""
    if pa.types.is_list(kind) and any(isinstance(v, np.ndarray) and v.dtype.names for v in values):
        none = np.zeros(0, smf.NOTE_DTYPE)
        ends = np.cumsum([0, *(0 if v is None else len(v) for v in values)])
        whole = np.concatenate([none if v is None else v for v in values])
        offsets = pa.array(ends, pa.int32(), mask=np.array([*(v is None for v in values), False]))
        fields = [kind.value_type.field(k) for k in range(kind.value_type.num_fields)]
        made = pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(whole[f.name]), f.type) for f in fields], fields=fields)
        return pa.ListArray.from_arrays(offsets, made, type=kind)
    return pa.array(values, kind)


def pieces(batch: pa.RecordBatch, work: Callable[[list[dict]], Iterable[dict]], size: int = BYTES) -> Iterator[tuple[pa.RecordBatch, list[dict]]]:
    """Rows of a batch beside what the work makes of each; as soon as that takes so many bytes, a piece ends."""
    for part in parts(batch, size=size):
        made, held, at = [], 0, 0
        for row in work(part.to_pylist()):
            made.append(row)
            held += weight(row.values())
            if held >= size:
                yield part.slice(at, len(made)), made
                made, held, at = [], 0, at + len(made)
        if made:
            yield part.slice(at, len(made)), made


def _mapped(df: DataFrame, extra: list[StructField], work: Callable[[Ranges, list[dict]], Iterator[dict]]) -> DataFrame:
    """df with further columns made in pieces of bounded rows and bytes; values that the work gives, row by row, are put behind."""
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = StructType([f for f in df.schema if f.name not in {x.name for x in extra}] + extra)
    arrow = to_arrow_schema(schema)
    kept = [f.name for f in df.schema if f.name in schema.names and f.name not in {x.name for x in extra}]

    def piece(part: pa.RecordBatch, made: list[dict]) -> pa.RecordBatch:
        new = [_column([m.get(f.name) for m in made], arrow.field(f.name).type) for f in extra]
        return pa.RecordBatch.from_arrays([part.column(c).cast(arrow.field(c).type) for c in kept] + new, schema=arrow)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranges = Ranges()
        try:
            for batch in batches:
                for part, made in pieces(batch, lambda rows: work(ranges, rows)):
                    yield piece(part, made)
        finally:
            ranges.close()

    return df.mapInArrow(run, schema)


def fetch(df: DataFrame, to: str = "payload", clustered: bool = True) -> DataFrame:
    """df, which has path, start_byte and end_byte, with each row's bytes.

    Filter first: what is read is what is left. Rows of a partition are sorted by place unless clustered is false;
    ranges that follow one another are read at once, those of a URL also with up to GAP bytes between them.
    """
    df = df.sortWithinPartitions("path", "start_byte") if clustered else df

    def read(ranges: Ranges, rows: list[dict]) -> Iterator[dict]:
        at = 0
        while at < len(rows):
            path, start, end = (rows[at][c] for c in ("path", "start_byte", "end_byte"))
            last, gap = at + 1, GAP if is_remote(path) else 0
            while last < len(rows) and rows[last]["path"] == path and end <= rows[last]["start_byte"] <= min(end + gap, rows[last]["end_byte"]) and rows[last]["end_byte"] <= start + BYTES:
                end, last = rows[last]["end_byte"], last + 1
            data = ranges.read(path, start, end)
            for row in rows[at:last]:
                yield {to: data[row["start_byte"] - start : row["end_byte"] - start]}
            at = last

    return _mapped(df, [StructField(to, BinaryType())], read)


def decode(df: DataFrame, modality: str, payload: str = "payload", skip_errors: bool = False, window: tuple[str, ...] = (), **options) -> DataFrame:
    """df with its payload column decoded: the columns of DECODED[modality] beside the others.

    options go to the codec; columns named in window (start_time, end_time) give each row its own. With skip_errors
    a row that cannot be decoded has an error column instead of values.
    """
    extra = list(DECODED[modality]) + ([StructField("error", StringType())] if skip_errors else [])
    source = df.withColumnRenamed(payload, "__payload") if payload in {f.name for f in extra} else df
    name = "__payload" if source is not df else payload

    how = options | ({"as_array": True} if modality == "midi" else {})

    def one(row: dict) -> dict:
        own = {k: row[k] for k in window if row.get(k) is not None}
        try:
            return registry.decode(modality, row[name], **how, **own)
        except Exception as error:
            if not skip_errors:
                raise
            return {"error": f"{type(error).__name__}: {error}"}

    return _mapped(source, extra, lambda _, rows: map(one, rows)).drop(name)
