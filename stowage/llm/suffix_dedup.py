"""Removal of repeated byte strings, by sorting suffixes of many documents column by column.

Every string of `length` bytes has an anchor, the first of its k-byte pieces with the least hash; equal strings
have equal anchors at equal places. So occurrences of a string can only be among the contexts of one anchor,
and contexts are aligned at it. The contexts of each anchor that has several are put in order column by column
from the right: each round inserts one symbol in front of every context's suffix, updates their order (the
collection's Burrows-Wheeler transform is the symbols inserted, in this order) and the common prefixes of
neighbours, and reads its column from an external file written once, front to back. In a column, contexts whose
neighbours share `length` bytes hold the same string, and all but the first repeat it.

Inserting the symbols of whole documents instead would take as many rounds as the longest document has bytes,
each over everything inserted so far; with contexts there are never more than 2 * length - k rounds.

Only where some texts are read together, their equal contexts, compared byte by byte, are sent as one: all but the
first one's strings are repeated. Hashes choose what is compared, and never decide that bytes are equal. An anchor
with very many contexts is split by content: strings that start up to half as far before it as others share more
bytes with each other than the anchor, and these are their anchor from then on.
"""

from __future__ import annotations

import hashlib
import tempfile
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, whole_runs, written

LENGTH, PIECE = 100, 20
#: Bytes that are looked at together; a longer text is cut into parts that overlap by length - 1 bytes.
CHUNK = 1 << 20
#: Texts whose anchors are compared before they are sent.
TEXTS = 2048
#: Contexts of one anchor that stay together; those of an anchor with more are split by content.
CONTEXTS = 8192
#: An anchor with more than one in so many of all is dealt to several tasks when anchors are counted; a sample tells which.
HOT_ANCHORS, SAMPLED = 2000, 0.02

_U = np.uint64
_ODD = _U(0x9E3779B97F4A7C15)
_BASE = _U(0xD6E8FEB86659FD93)
_BASE_INVERSE = _U(pow(int(_BASE), -1, 1 << 64))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(32))) * _ODD
    return x ^ (x >> _U(29))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, _U)
    out[0] = 1
    return np.multiply.accumulate(out)


def _piece_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of the size bytes from each place on, for the places that have so many."""
    known = {1: _mix(data.astype(_U) + _U(0x51ED270B))}
    step = 1
    while step * 2 <= size:
        x = known[step]
        known[step * 2] = _mix(x[:-step] * _U(3) + x[step:])
        step *= 2
    at, total = step, known[step]
    for part in sorted(known, reverse=True):
        while at + part <= size:
            n = len(data) - at - part + 1
            total = _mix(total[:n] * _U(5) + known[part][at : at + n])
            at += part
    return total


def anchors(texts: list[bytes], length: int = LENGTH, piece: int = PIECE) -> tuple[np.ndarray, ...]:
    """(text, anchor, first, last, anchor's hash, context's hash): for each anchor the strings from first to last start have it.

    Places are bytes within the text. The context is all bytes of those strings; its hash only helps to find equal ones.
    """
    parts, which, base = [], [], []
    for k, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), CHUNK):
            parts.append(text[at : at + CHUNK + length - 1])
            which.append(k)
            base.append(at)
    made: list[tuple[np.ndarray, ...]] = []
    begin = 0
    while begin < len(parts):
        end, total = begin, 0
        while end < len(parts) and (end == begin or total + len(parts[end]) <= CHUNK):
            total += len(parts[end])
            end += 1
        data = np.frombuffer(b"".join(parts[begin:end]), np.uint8)
        sizes = np.array([len(p) for p in parts[begin:end]])
        offset = np.cumsum(sizes) - sizes
        hashes = _piece_hashes(data, piece)
        wide = length - piece + 1
        bits = int(len(data)).bit_length()
        key = (hashes >> _U(bits) << _U(bits)) | np.arange(len(hashes), dtype=_U)
        padded = np.full(-(-len(key) // wide) * wide, ~_U(0))
        padded[: len(key)] = key
        square = padded.reshape(-1, wide)
        before = np.minimum.accumulate(square, 1).ravel()
        after = np.minimum.accumulate(square[:, ::-1], 1)[:, ::-1].ravel()
        n = len(key) - wide + 1
        least = (np.minimum(after[:n], before[wide - 1 : wide - 1 + n]) & _U((1 << bits) - 1)).astype(np.int64)
        starts = sizes - length + 1
        places = np.repeat(offset - (np.cumsum(starts) - starts), starts) + np.arange(starts.sum())
        part = np.repeat(np.arange(len(sizes)), starts)
        at = least[places]
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (part[1:] != part[:-1])
        head = np.flatnonzero(new)
        tail = np.append(head[1:], len(at)) - 1
        first, last, anchor, part = places[head], places[tail], at[head], part[head]
        # the context's hash: mixed 4-byte pieces, each times a power of the base by its place in the context
        four = _piece_hashes(data, 4)
        sums = np.concatenate([[_U(0)], np.cumsum(four * _powers(_BASE, len(four)), dtype=_U)])
        inverse = _powers(_BASE_INVERSE, len(four) + 1)
        span = (sums[last + length - 3] - sums[first]) * inverse[first]
        context = _mix(span + (last - first).astype(_U) * _ODD + (anchor - first).astype(_U))
        shift = np.array(base[begin:end])[part] - offset[part]
        made.append((np.array(which[begin:end])[part], anchor + shift, first + shift, last + shift, hashes[anchor], context))
        begin = end
    if not made:
        none = np.zeros(0, np.int64)
        return none, none, none, none, none.astype(_U), none.astype(_U)
    return tuple(np.concatenate(x) for x in zip(*made, strict=True))


# An anchor's place and its strings' reach in one long: place, bytes to it from the first start and from the last start.
def _packed(anchor: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    return (anchor << 16) | ((anchor - first) << 8) | (anchor - last)


def _unpacked(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return x >> 16, (x >> 8) & 255, x & 255


#: key and place are null for a span that is settled, start and end for an anchor.
_SEEN = pa.schema([("key", pa.int64()), ("doc", pa.int64()), ("place", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def _anchored(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """The anchors of all texts; a context that these texts have earlier, byte for byte, is settled here and not sent to be compared."""
    for batch in (b.slice(at, TEXTS) for b in batches for at in range(0, len(b), TEXTS)):
        docs, texts = batch.column("doc").to_numpy(), batch.column("text").to_pylist()
        which, anchor, first, last, hashes, context = anchors(texts, length)
        doc, place = docs[which], _packed(anchor, first, last)
        key = hashes.view(np.int64)
        order = np.lexsort((place, doc, context, key))
        # a repeated row of a document is the document itself and not an earlier one
        single = np.ones(len(key), bool)
        a, b = order[1:], order[:-1]
        single[1:] = (key[a] != key[b]) | (doc[a] != doc[b]) | (place[a] != place[b])
        order = order[single]
        settled = np.zeros(len(order), bool)
        a, b = order[1:], order[:-1]
        maybe = np.flatnonzero((key[a] == key[b]) & (context[a] == context[b]))
        ends = last + length
        spans = zip(*(x[y[maybe]].tolist() for y in (a, b) for x in (which, first, ends)), strict=True)
        settled[maybe + 1] = [texts[t][i:j] == texts[u][k:n] for t, i, j, u, k, n in spans]
        done, left = order[settled], order[~settled]
        spans = _united(doc[done], first[done], ends[done])
        none = pa.nulls
        for at in range(0, len(left), 65536):
            part = left[at : at + 65536]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[part]) for x in (key, doc, place)), none(len(part), pa.int64()), none(len(part), pa.int64())], schema=_SEEN)
        n = len(spans[0])
        yield pa.RecordBatch.from_arrays([none(n, pa.int64()), pa.array(spans[0]), none(n, pa.int64()), *map(pa.array, spans[1:])], schema=_SEEN)


def _united(docs: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Spans of equal width or of one text in a row, each document's united where they overlap or touch."""
    order = np.lexsort((ends, starts, docs))
    docs, starts, ends = docs[order], starts[order], ends[order]
    if not len(docs):
        return docs, starts, ends
    # the furthest end so far of each document: ends are raised by document, so that a running maximum starts anew with each
    number = np.cumsum(np.append(0, docs[1:] != docs[:-1])) * (int(ends.max()) + 1)
    furthest = np.maximum.accumulate(ends + number) - number
    head = np.ones(len(docs), bool)
    head[1:] = (docs[1:] != docs[:-1]) | (starts[1:] > furthest[:-1])
    at = np.flatnonzero(head)
    return docs[at], starts[at], furthest[np.append(at[1:], len(docs)) - 1]


def _shared(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of anchors sorted by key: those whose key others have too, or that are known to be hot. In constant memory."""
    names = ["key", "doc", "place"]
    last: tuple | None = None  # the last anchor, and whether its key was there before
    for batch in batches:
        key = batch.column("key").to_numpy()
        if not len(key):
            continue
        equal = np.zeros(len(key) + 1, bool)  # whether each has the key of the one before
        equal[1:-1] = key[1:] == key[:-1]
        equal[0] = last is not None and key[0] == last[0]
        several = equal[:-1] | equal[1:] | (batch.column("turn").to_numpy() >= 0)
        out = [batch.column(c).to_numpy()[:-1][several[:-1]] for c in names]
        if last is not None and (last[3] or equal[0]):
            out = [np.append([x], y) for x, y in zip(last[:3], out, strict=True)]
        last = (*(batch.column(c).to_numpy()[-1] for c in names), bool(several[-1]))
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names)
    if last is not None and last[3]:
        yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in last[:3]], names)


_SPAN = pa.schema([("doc", pa.int64()), ("start", pa.int64()), ("end", pa.int64())])


def by_columns(group: np.ndarray, columns: Iterable[np.ndarray]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """After each column, from the right: the order of the rows' suffixes, and what each shares with the one before, in symbols.

    group numbers the rows' groups, ascending; rows of different groups share nothing and stay apart.
    """
    n = len(group)
    rows, common = np.arange(n), np.zeros(n, np.int64)
    for symbols in columns:
        own, of = symbols[rows], group[rows]
        # the new suffixes are in order of group, symbol and, for equal ones, the order they had
        moved = np.argsort(own, kind="stable")
        moved = moved[np.argsort(of[moved].astype(np.uint16) if n == 0 or group[-1] < 65536 else of[moved], kind="stable")]
        own, of = own[moved], of[moved]
        joined = np.zeros(n, bool)
        joined[1:] = (own[1:] == own[:-1]) & (of[1:] == of[:-1])
        # two that become neighbours had others in between; they share the least that neighbours on the way shared
        padded, fresh = np.append(common, 0), np.zeros(n, np.int64)
        at = np.flatnonzero(joined)
        if len(at):
            ways = np.empty(2 * len(at), np.int64)
            ways[0::2], ways[1::2] = moved[at - 1] + 1, moved[at] + 1
            fresh[at] = np.minimum.reduceat(padded, ways)[0::2] + 1
        rows, common = rows[moved], fresh
        yield rows, common


def _sorted(batches: Iterable[pa.RecordBatch], length: int, piece: int) -> Iterator[pa.RecordBatch]:
    """Of contexts sorted by key: the spans of strings that an earlier context has."""
    reach = length - piece
    for table, starts in whole_runs(batches, ("key",), 16384):
        doc, place = table.column("doc").to_numpy(), table.column("place").to_numpy()
        n = len(doc)
        anchor, far, near = _unpacked(place)
        group = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, n)))
        # repeated rows of a document are one occurrence
        order = np.lexsort((anchor, doc))
        new = np.ones(n, np.int64)
        new[1:] = (doc[order[1:]] != doc[order[:-1]]) | (anchor[order[1:]] != anchor[order[:-1]])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new) - 1
        bytes_ = table.column("bytes").combine_chunks()
        bytes_ = bytes_.chunk(0) if isinstance(bytes_, pa.ChunkedArray) else bytes_
        edges = np.frombuffer(bytes_.buffers()[1], np.int32)[bytes_.offset : bytes_.offset + n + 1].astype(np.int64)
        data = np.frombuffer(bytes_.buffers()[2], np.uint8)[edges[0] : edges[-1]]
        sizes = np.diff(edges)
        row = np.repeat(np.arange(n), sizes)
        column = np.repeat(length - 1 + far, sizes) - (np.arange(len(data)) - np.repeat(edges[:-1] - edges[0], sizes))
        with tempfile.TemporaryFile() as file:
            square = np.zeros((length + reach, n), np.uint8)
            inside = (column >= 0) & (column < length + reach)
            square[column[inside], row[inside]] = data[inside]
            square.tofile(file)
            del square
            file.seek(0)
            rounds = by_columns(group, (np.fromfile(file, np.uint8, n) for _ in range(length + reach)))
            out = []
            for at, (rows, common) in enumerate(rounds):
                before = at - length + 1  # how many bytes before the anchor this column's strings start
                if before < 0:
                    continue
                has = (near[rows] <= before) & (before <= far[rows])
                heads = np.flatnonzero(common < length)
                ranks = np.where(has, rank[rows], n)
                first = np.minimum.reduceat(ranks, heads)
                again = rows[has & (ranks > np.repeat(first, np.diff(np.append(heads, n))))]
                out.append((doc[again], anchor[again] - before))
        docs, begins = (np.concatenate(x) for x in zip(*out, strict=True))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in _united(docs, begins, begins + length)], schema=_SPAN)


def _pressed(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed, as they are going to be shuffled."""
    press = zstandard.ZstdCompressor(level=1)
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("doc"), pa.array([press.compress(t or b"") for t in batch.column("text").to_pylist()], pa.binary())], ["doc", "text"])


def _plain(text: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(text)


_CONTEXT = pa.schema([("key", pa.int64()), ("low", pa.int32()), ("high", pa.int32()), ("doc", pa.int64()), ("place", pa.int64()), ("bytes", pa.binary())])


def _contexts(batches: Iterable[pa.RecordBatch], length: int, piece: int) -> Iterator[pa.RecordBatch]:
    for batch in (b.slice(at, 256) for b in batches for at in range(0, len(b), 256)):
        keys, docs, places, pieces = [], [], [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found"), strict=True):
            plain, found = _plain(text), found.values
            place = found.field("place").to_numpy()
            anchor, far, near = _unpacked(place)
            fits = anchor - near + length <= len(plain)
            pieces += [plain[a - f : a - b + length] for a, f, b in zip(anchor[fits].tolist(), far[fits].tolist(), near[fits].tolist(), strict=True)]
            keys.append(found.field("key").to_numpy()[fits])
            docs.append(found.field("doc").to_numpy()[fits])
            places.append(place[fits])
        n = len(pieces)
        longs = [pa.array(np.concatenate(x) if x else [], pa.int64()) for x in (keys, docs, places)]
        yield pa.RecordBatch.from_arrays([longs[0], pa.array(np.zeros(n, np.int32)), pa.array(np.full(n, length - piece, np.int32)), *longs[1:], pa.array(pieces, pa.binary())], schema=_CONTEXT)


def _halved(batches: Iterable[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Contexts split into those of the strings that start nearer to the anchor and further from it.

    Strings that start `low` to `high` bytes before an anchor all have the bytes from `low` before it to length - high
    after it; these make the new key. Equal contexts read together are settled but for the first.
    """
    schema = _CONTEXT.append(pa.field("settled", pa.bool_()))
    for batch in batches:
        first: dict[tuple[int, int, int, bytes], tuple[int, int]] = {}
        rows = []
        for key, low, high, doc, place, data in zip(*(batch.column(c).to_pylist() for c in _CONTEXT.names), strict=True):
            anchor, far, near = place >> 16, place >> 8 & 255, place & 255
            middle = (low + high) // 2
            for a, b in ((low, middle), (middle + 1, high)):
                f, n = min(far, b), max(near, a)
                if a > b or f < n:
                    continue
                own = data[far - f : far - n + length]
                common = own[f - a : f - b + length]
                name = int.from_bytes(hashlib.blake2b(b"%d %d %d " % (key, a, b) + common, digest_size=8).digest(), "little", signed=True)
                where = (name, f, n, own)
                at = (doc, (anchor << 16) | (f << 8) | n)
                rows.append((name, a, b, *at, own, where))
                first[where] = min(first.get(where, at), at)
        out = list({(*r[:6], first[r[6]] != (r[3], r[4])) for r in rows})
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)


def repeated_spans(docs: DataFrame, length: int = LENGTH, piece: int = PIECE) -> DataFrame:
    """(doc, start, end): spans of bytes, overlapping ones among them, that cover what repeats; docs is (doc long, text binary)."""
    spark = docs.sparkSession
    spark_type = "doc long, place long"
    anchor, far, near = F.shiftright("place", 16), F.shiftright("place", 8).bitwiseAND(255), F.col("place").bitwiseAND(255)
    whole = lambda df: df.select("doc", (anchor - far).alias("start"), (anchor - near + length).alias("end"))

    own = docs.where("doc is not null")
    seen = written(own.mapInArrow(lambda b: _anchored(b, length), f"key long, {spark_type}, start long, end long"))
    spans = seen.where("key is null").select("doc", "start", "end")
    open_ = seen.where("key is not null").select("key", "doc", "place")
    # an anchor that very many contexts have is shared for certain, so these need not meet to be found
    often = open_.sample(SAMPLED, seed=1).groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    total = open_.count()
    hot = [r.key for r in often.where(F.col("n") * HOT_ANCHORS > total * SAMPLED).where("n > 100").select("key").collect()]
    hot = F.broadcast(spark.createDataFrame([(k, True) for k in hot], "key long, hot boolean"))
    turn = F.when(F.col("hot"), F.pmod(F.xxhash64("doc", "place"), F.lit(HOT_ANCHORS))).otherwise(-1)
    dealt = open_.join(hot, "key", "left").withColumn("turn", turn.cast("long")).select("key", "turn", "doc", "place")
    found = dealt.repartition("key", "turn").sortWithinPartitions("key").mapInArrow(_shared, f"key long, {spark_type}")
    found = found.groupBy("doc").agg(F.collect_list(F.struct("key", "doc", "place")).alias("found"))
    pressed = own.mapInArrow(_pressed, "doc long, text binary")
    kind = "key long, low int, high int, doc long, place long, bytes binary"
    contexts = written(pressed.join(found, "doc").mapInArrow(lambda b: _contexts(b, length, piece), kind))
    for halvings in count():
        counts = written(contexts.groupBy("key").agg(F.count("*").alias("n")).where(F.col("n") > CONTEXTS).select("key"))
        many = counts.count()
        small = F.broadcast(counts) if many <= BROADCAST_ROWS else counts
        cool = contexts.join(small, "key", "left_anti") if many else contexts
        spans = spans.unionByName(cool.select("key", "doc", "place", "bytes").repartition("key").sortWithinPartitions("key").mapInArrow(lambda b: _sorted(b, length, piece), "doc long, start long, end long"))
        if not many:
            return spans
        hot = contexts.join(small, "key", "left_semi")
        if halvings >= int(np.log2(length - piece + 1)):
            # where the anchor is the whole string there is nothing to sort; the first of each is found with partial minima
            single = hot.where("low = high")
            least = written(single.groupBy("bytes").agg(F.min(F.struct("doc", "place")).alias("at")))
            least = F.broadcast(least) if least.count() <= BROADCAST_ROWS // 10 else least
            spans = spans.unionByName(whole(single.join(least, "bytes").where(F.struct("doc", "place") > F.col("at"))))
        halves = written(hot.where("low < high").mapInArrow(lambda b: _halved(b, length), f"{kind}, settled boolean"))
        spans = spans.unionByName(whole(halves.where("settled")))
        left = halves.where("not settled").drop("settled")
        several = left.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
        contexts = written(left.join(several, "key"))


def deduplicated(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH) -> DataFrame:
    """id_col, n_bytes, removed (array of spans of bytes, end exclusive, as long as they can be) and kept (binary), one row for each row of df.

    Removed is each byte covered by a string of `length` bytes that also starts earlier: in a text of a smaller id, or
    in the same text further to the front. Texts are their UTF-8 bytes; a null text is an empty one. Rows of null id
    are neither cut nor count as earlier. Rows that share an id are one document: what repeats in one of their texts is
    cut from all of them as far as they go, so with equal texts they are cut alike. kept may end within a character. Other columns are not looked at; no rows give no rows.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("text"))
    spans = repeated_spans(docs, length).groupBy("doc").agg(F.collect_list(F.struct("start", "end")).alias("spans"))

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                sizes, removed, kept = [], [], []
                for text, found in zip(part.column("text").to_pylist(), part.column("spans").to_pylist(), strict=True):
                    text = _plain(text)
                    runs: list[list[int]] = []
                    for a, b in sorted((x["start"], min(x["end"], len(text))) for x in found or () if x["start"] < len(text)):
                        if runs and a <= runs[-1][1]:
                            runs[-1][1] = max(b, runs[-1][1])
                        else:
                            runs.append([a, b])
                    edges = [0, *(x for run in runs for x in run), len(text)]
                    sizes.append(len(text))
                    removed.append([{"start": a, "end": b} for a, b in runs])
                    kept.append(b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)))
                kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
                yield pa.RecordBatch.from_arrays([part.column("doc"), pa.array(sizes, pa.int64()), pa.array(removed, kind), pa.array(kept, pa.binary())], ["doc", "n_bytes", "removed", "kept"])

    pressed = docs.mapInArrow(_pressed, "doc long, text binary").join(spans, "doc", "left").select("doc", "text", "spans")
    made = pressed.mapInArrow(cut, "doc long, n_bytes long, removed array<struct<start:long,end:long>>, kept binary")
    return made.withColumnRenamed("doc", id_col)


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without repeated strings of 100 bytes."""
    made = deduplicated(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return made.select("doc_id", "n_bytes", (F.col("n_bytes") - F.length("kept")).cast("long").alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


#: All strings of all documents, for the small tables the SQL is run on.
OP6_SQL = f"""
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
places AS (SELECT doc_id, h, unnest(generate_series(0, n - {LENGTH})) AS i FROM docs WHERE n >= {LENGTH}),
strings AS (SELECT doc_id, i, substring(h, 2 * i + 1, {2 * LENGTH}) AS s FROM places),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY s ORDER BY doc_id, i) AS r FROM strings) WHERE r > 1),
heads AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + {LENGTH} THEN 0 ELSE 1 END AS new FROM again),
runs AS (SELECT doc_id, min(i) AS a, max(i) + {LENGTH} AS b FROM (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM heads) GROUP BY doc_id, k),
cuts AS (SELECT doc_id, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, sum(b - a) AS removed FROM runs GROUP BY doc_id),
whole AS (SELECT d.doc_id, h, n, coalesce(starts, []) AS starts, coalesce(ends, []) AS ends, coalesce(removed, 0) AS removed FROM docs d LEFT JOIN cuts c ON d.doc_id = c.doc_id),
edges AS (SELECT *, list_concat([0], ends) AS begins, list_concat(starts, [n]) AS stops FROM whole),
kept AS (SELECT *, array_to_string(list_transform(generate_series(1, len(begins)), lambda k: substring(h, 2 * begins[k] + 1, 2 * (stops[k] - begins[k]))), '') AS rest FROM edges)
SELECT doc_id, n AS n_bytes, removed::BIGINT AS n_removed, len(starts)::BIGINT AS n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept
"""


def registered() -> Iterator[tuple]:
    yield "op6_suffix_dedup", op6_suffix_dedup, OP6_SQL
