"""SimHash near-dedup through a Gray-order hierarchical index.

Fingerprints that differ in at most 3 bits agree in one of 4 equal segments, so each distinct fingerprint goes
to one bucket for each segment, the segment leading; within a bucket the index finds the close pairs. Where there
are so many that these buckets would be large, they go by two of 5 segments or three of 6, of which as surely some
agree. Equal fingerprints are one node. Buckets above a bound are dealt into blocks, every two of which meet. From
a bucket only a spanning forest of its links comes out, which keeps components as they are.

64 bits at 3 differences tell near copies of long texts only. For a similarity of shingle sets, a fingerprint
can have several words of 64 bits: two texts meet where a segment of any word agrees, the index prunes by
that word, and the differences over all words decide.

Fingerprints only estimate a similarity, so for near copies they are candidates: texts also meet by bands of least
hashes of their shingles, and in each group of candidates the sets themselves decide, all against all.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, dealt_join, forest, in_blocks, per_text, smallest_ids, whole_ids, whole_runs, written
from .gray_index import close_pairs, gray_rank

SHINGLE, SEED, BITS = 3, 42, 3
#: Segments of a word of 64 bits, one of which has to agree.
SEGMENTS = 4
#: Segments a word is cut into, of which all but SEGMENTS - 1 agree, as long as buckets would be larger than BLOCK.
MOST_SEGMENTS = 6
#: Rows of a bucket that are compared as one unit; two blocks of a larger bucket are twice as many.
BLOCK = 2048
#: For near copies by sets of shingles of 5 words: words of a fingerprint, bits of all and of one word that may differ.
#: Sets of equal size with Jaccard similarity 0.8 have cosine 8/9 and differ in 77.6 of 512 bits on average, with a
#: standard deviation of 8.1; 84 lets most of them in. At that similarity one of 32 segments agrees for nine pairs in
#: ten, at 0.85 for 97 in a hundred.
SIMILAR = {"shingle": 5, "words": 8, "bits": 84, "word_bits": 24, "distinct": True}
#: Near copies share so much of their shingles, as a fraction.
SIMILARITY = (4, 5)
#: Bands of least hashes, and hashes in one: at similarity 0.8 no band agrees for four pairs in 10^9.
BANDS, BAND = 64, 6
_FACTORS, _ADDED = np.random.default_rng(SEED).integers(0, 1 << 32, (2, BANDS * BAND), dtype=np.uint32)
_FACTORS |= np.uint32(1)
#: Sets of a group of candidates that are compared as one unit; two blocks of a larger group are twice as many.
SET_BLOCK = 512


def _more(hashed: np.ndarray, word: int) -> np.ndarray:
    """The shingles' hashes for a further word of the fingerprint."""
    x = (hashed + np.uint64(word * 0x9E3779B97F4A7C15 % (1 << 64))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


def _hashed(text: bytes | None, shingle: int, seed: int, distinct: bool) -> np.ndarray:
    """The hashes of a text's shingles; all words are one shingle if they are too few."""
    found = (text or b"").lower().split()
    if len(found) < shingle:
        grams = [b" ".join(found)] if found else []
    else:
        grams = map(b" ".join, zip(*(found[k:] for k in range(shingle))))
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, set(grams) if distinct else grams, repeat(seed))), ">u8")


def fingerprint(text: bytes | None, shingle: int = SHINGLE, seed: int = SEED, words: int = 1, distinct: bool = False) -> list[int]:
    """The SimHash of a text, in words of 64 bits: a bit is 1 if it is in over half the shingles' hashes. No words give 0.

    Shingles count as often as they occur, or once if distinct.
    """
    return _simhash(_hashed(text, shingle, seed, distinct), words)


def _simhash(hashed: np.ndarray, words: int) -> list[int]:
    if not len(hashed):
        return [0] * words
    made = []
    for word in range(words):
        own = hashed if word == 0 else _more(hashed.astype(np.uint64), word).astype(">u8")
        bits = own.view(np.uint8).reshape(-1, 8)
        ones = sum((np.unpackbits(bits[k : k + 16384], axis=1).sum(axis=0, dtype=np.int64) for k in range(0, len(bits), 16384)), np.zeros(64, np.int64))
        made.append(int.from_bytes(np.packbits(2 * ones > len(bits)).tobytes(), "big"))
    return made


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, words: int = 1, distinct: bool = False) -> DataFrame:
    """(id, code): the fingerprint of each row's whole text, as signed longs. A null text is an empty one."""
    out = pa.schema([("id", pa.int64()), ("code", pa.list_(pa.int64()))])

    def work(texts: list[bytes | None]) -> dict[str, list]:
        return {"code": list(np.array([fingerprint(t, shingle, seed, words, distinct) for t in texts], np.uint64).reshape(-1, words).view(np.int64))}

    return df.selectExpr(f"cast(`{id_col}` as long) as id", f"cast(`{text_col}` as binary) as text").mapInArrow(per_text(work, out, ["id"], "text"), "id long, code array<long>")


def _links(batches: Iterable[pa.RecordBatch], words: int, bits: int, word_bits: int) -> Iterator[pa.RecordBatch]:
    """The links of a spanning forest of each unit, as pairs of nodes."""
    for table, starts in whole_runs(batches, ("bucket", "block_i", "block_j")):
        lead = table.column("lead").to_numpy().view(np.uint64)
        codes = table.column("code").combine_chunks().flatten().to_numpy().view(np.uint64).reshape(-1, words) if words > 1 else lead
        nodes = table.column("node").to_numpy()
        sizes = np.diff(np.append(starts, len(lead)))
        begin = 0
        while begin < len(sizes):  # as many units at a time as have some millions of pairs at worst
            end = begin + max(1, int(np.searchsorted(np.cumsum(sizes[begin:].astype(np.int64) ** 2), 1 << 23)))
            rows = slice(int(starts[begin]), int(starts[end]) if end < len(starts) else len(lead))
            own, sized = lead[rows], sizes[begin:end]
            order = np.lexsort((gray_rank(own), np.repeat(np.arange(len(sized)), sized)))
            a, b = close_pairs(own[order], sized, word_bits)
            order = order + rows.start
            if words > 1:
                near = np.concatenate([np.bitwise_count(codes[order[a[k : k + 65536]]] ^ codes[order[b[k : k + 65536]]]).sum(1) <= bits for k in range(0, len(a), 65536)] or [np.zeros(0, bool)])
                a, b = a[near], b[near]
            by_node = np.argsort(nodes[order], kind="stable")
            place = np.empty_like(by_node)
            place[by_node] = np.arange(len(by_node))
            label = forest(len(by_node), place[a], place[b])
            far = np.flatnonzero(label != np.arange(len(label)))
            sorted_nodes = nodes[order][by_node]
            yield pa.RecordBatch.from_arrays([pa.array(sorted_nodes[far]), pa.array(sorted_nodes[label[far]])], ["u", "v"])
            begin = end


def _leads(words: int, segments: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """For each bucket of a fingerprint: the word and the runs of bits (first, how many) that its number is made of."""
    edges = [64 * k // segments for k in range(segments + 1)]
    return [(w, [(edges[k], edges[k + 1] - edges[k]) for k in some]) for w in range(words) for some in combinations(range(segments), segments - SEGMENTS + 1)]


def _segments(nodes: int) -> int:
    """Into how many segments a word is cut for so many fingerprints."""
    for segments in range(SEGMENTS, MOST_SEGMENTS):
        if nodes <= BLOCK << 64 * (segments - SEGMENTS + 1) // segments:
            return segments
    return MOST_SEGMENTS


def components(codes: DataFrame, words: int = 1, bits: int = BITS, word_bits: int | None = None, segments: int | None = None) -> DataFrame:
    """(code, component, rows): for each distinct code of (id, code) the smallest id reachable through links of at most `bits` bits.

    With one word and at most 3 bits no link is missed. With more words, pairs are compared where, of a word cut into
    segments, all but three agree and that word differs in at most word_bits bits; so the closer a pair the surer it
    is found. Without a number of segments it follows from how many codes there are. A code whose ids are all null
    has a null component; rows is how many have the code.
    """
    nodes = written(codes.groupBy("code").agg(F.min("id").alias("least"), F.count("*").alias("rows")).withColumn("node", F.monotonically_increasing_id()))
    cut = _leads(words, segments or (_segments(nodes.count()) if words == 1 else SEGMENTS))
    part = lambda word, first, size: F.shiftrightunsigned(F.shiftleft(F.element_at("code", word + 1), first), 64 - size)
    buckets = []
    for turn, (word, runs) in enumerate(cut):
        number = F.lit(0).cast("long")
        for first, size in runs:
            number = F.shiftleft(number, size).bitwiseOR(part(word, first, size))
        buckets.append((number * len(cut) + turn, F.element_at("code", word + 1)))
    spread = nodes.where("least is not null").select("node", "code", F.explode(F.array(*(F.struct(b.alias("bucket"), w.alias("lead")) for b, w in buckets))).alias("at")).select("node", "code", "at.*")
    units = in_blocks(spread, "bucket", "node", BLOCK).select("node", *(["code"] if words > 1 else []), "lead", "bucket", "block_i", "block_j")
    keys = ["bucket", "block_i", "block_j"]
    own = bits if word_bits is None else word_bits
    links = units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(lambda batches: _links(batches, words, bits, own), "u long, v long")
    found = smallest_ids(nodes.select("node", "least"), links)
    return nodes.join(found, "node").select("code", "component", "rows")


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE, seed: int = SEED, words: int = 1, bits: int = BITS, word_bits: int | None = None, distinct: bool = False) -> DataFrame:
    """id_col, code (the fingerprint as signed longs) and component_id, one row for each row of df.

    component_id is the smallest id reachable. Texts without words, null ones too, have fingerprint 0 and are linked
    like any other. Ids are integers; rows of one id with different texts are different texts, and rows of null id
    are in the group that their text is in, or of a null one. Other columns are not looked at; no rows give no rows.
    """
    kind = whole_ids(df, id_col)
    codes = written(fingerprints(df, id_col, text_col, shingle, seed, words, distinct))
    found = components(codes, words, bits, word_bits)
    made = dealt_join(codes, found, ["code"], "rows")
    return made.select(F.col("id").cast(kind).alias(id_col), "code", F.col("component").cast(kind).alias("component_id"))


def bands(hashed: np.ndarray) -> np.ndarray:
    """BANDS hashes, each of BAND least hashes of a set; sets of similarity s agree in one with probability s ** BAND."""
    least = np.full(BANDS * BAND, ~np.uint32(0))
    short = (hashed.astype(np.uint64) >> np.uint64(32)).astype(np.uint32)
    for k in range(0, len(short), 512):
        np.minimum(least, (short[k : k + 512, None] * _FACTORS + _ADDED).min(0), out=least)
    return np.array([xxhash.xxh64_intdigest(band.tobytes(), k) for k, band in enumerate(least.reshape(BANDS, BAND))], np.uint64).view(np.int64)


def _met(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (band, id) sorted: each id linked to the least one of its band."""
    for table, starts in whole_runs(batches, ("band",)):
        ids = table.column("id").to_numpy()
        least = np.repeat(ids[starts], np.diff(np.append(starts, len(ids))))
        apart = ids != least
        yield pa.RecordBatch.from_arrays([pa.array(ids[apart]), pa.array(least[apart])], ["u", "v"])


def alike(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Links (a, b) of places in sets, none of them empty, whose components are those of all pairs at SIMILARITY or more.

    Sets already reached are not compared again.
    """
    part, whole = SIMILARITY
    sizes = np.array([len(x) for x in sets])
    starts = np.cumsum(sizes) - sizes
    tokens = np.unique(np.concatenate(sets), return_inverse=True)[1]
    own = np.zeros(tokens.max() + 1, np.int32)
    new = np.ones(len(sets), bool)
    links: list[tuple[int, np.ndarray]] = []
    for first in range(len(sets)):
        reached = [first] if new[first] else []
        new[first] = False
        while reached:
            x = reached.pop()
            if not (new & (sizes * whole >= sizes[x] * part) & (sizes[x] * whole >= sizes * part)).any():
                continue
            span = tokens[starts[x] : starts[x] + sizes[x]]
            own[span] = 1
            common = np.add.reduceat(own[tokens], starts)
            own[span] = 0
            near = np.flatnonzero(new & (common * (part + whole) >= part * (sizes + sizes[x])))
            new[near] = False
            reached += near.tolist()
            links.append((x, near))
    return np.repeat([x for x, _ in links], [len(y) for _, y in links]).astype(np.int64), np.concatenate([y for _, y in links] or [np.zeros(0, np.int64)])


def _verified(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between the nodes of each unit whose sets are similar."""
    for table, starts in whole_runs(batches, ("component", "block_i", "block_j"), SET_BLOCK):
        nodes = table.column("node").to_numpy()
        grams = table.column("grams").to_pylist()
        for begin, end in zip(starts, np.append(starts[1:], len(nodes)), strict=True):
            rows = np.array([k for k in range(begin, end) if grams[k]], np.int64)
            if len(rows) > 1:
                a, b = alike([np.frombuffer(grams[k], np.uint64) for k in rows])
                yield pa.RecordBatch.from_arrays([pa.array(nodes[rows[a]]), pa.array(nodes[rows[b]])], ["u", "v"])


def near_copies(docs: DataFrame) -> DataFrame:
    """(id, component): for documents that have near copies, by distinct 5-word shingles at SIMILARITY, the smallest id reachable.

    Candidates meet by fingerprints as in SIMILAR or by a band of least hashes. Groups of candidates are compared pair by
    pair, by whole sets; equal sets are one. Texts without words have equal sets. Rows of null id have no copies.
    """
    shingle, words = SIMILAR["shingle"], SIMILAR["words"]
    out = pa.schema([("id", pa.int64()), ("code", pa.list_(pa.int64())), ("digest", pa.binary()), ("bands", pa.list_(pa.int64()))])

    def sketched(texts: list[bytes | None]) -> dict[str, list]:
        sets = [np.sort(_hashed(t, shingle, SEED, True)) for t in texts]
        codes = np.array([_simhash(x, words) for x in sets], np.uint64).reshape(-1, words).view(np.int64)
        return {"code": list(codes), "digest": [xxhash.xxh3_128_digest(x.tobytes()) for x in sets], "bands": [bands(x) for x in sets]}

    def gathered(texts: list[bytes | None]) -> dict[str, list]:
        return {"grams": [np.sort(_hashed(t, shingle, SEED, True).astype(np.uint64)).tobytes() for t in texts]}

    rows = docs.where("doc_id is not null").selectExpr("cast(doc_id as long) as id", "cast(text as binary) as text")
    sketches = written(rows.mapInArrow(per_text(sketched, out, ["id"], "text"), "id long, code array<long>, digest binary, bands array<long>"))
    codes = sketches.select("id", "code")
    alike = components(codes, words, SIMILAR["bits"], SIMILAR["word_bits"])
    linked = dealt_join(codes, alike, ["code"], "rows").select(F.col("id").alias("u"), F.col("component").alias("v"))
    spread = sketches.select("id", F.explode("bands").alias("band"))
    met = spread.repartition("band").sortWithinPartitions("band", "id").mapInArrow(_met, "u long, v long")
    groups = connected_components(linked.unionByName(met))
    members = written(sketches.select("id", "digest").join(groups.withColumnRenamed("node", "id"), "id"))
    distinct = written(members.groupBy("component", "digest").agg(F.min("id").alias("node"), F.count("*").alias("rows")))
    several = distinct.groupBy("component").agg(F.count("*").alias("n")).where("n > 1").select("component")
    nodes = distinct.join(several, "component").select("component", "node").distinct()
    kept = pa.schema([("component", pa.int64()), ("node", pa.int64()), ("grams", pa.binary())])
    texts = rows.join(nodes, F.col("id") == F.col("node")).select("component", "node", "text")
    sets = written(texts.mapInArrow(per_text(gathered, kept, ["component", "node"], "text"), "component long, node long, grams binary"))
    keys = ["component", "block_i", "block_j"]
    units = in_blocks(sets, "component", "node", SET_BLOCK).select(*keys, "node", "grams")
    found = connected_components(units.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(_verified, "u long, v long"))
    own = dealt_join(members, distinct, ["component", "digest"], "rows").select("id", "node")
    return own.join(found, "node", "left").select("id", F.coalesce("component", "node").alias("component"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """Documents without those that a document of smaller id is a near copy of, by sets of 5-word shingles at similarity 0.8.

    Rows that share an id stay or go together; rows of null id stay.
    """
    gone = near_copies(docs).where(F.col("component") < F.col("id")).select(F.col("id").alias("doc_id")).distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op10_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex(F.element_at("code", 1)), 16, "0")).alias("fingerprint"), "component_id")


def registered() -> Iterator[tuple]:
    yield "op10_simhash_dedup", op10_simhash_dedup, None
