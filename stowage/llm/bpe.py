"""BPE encoding and decoding by a prefix-sharing trie.

The words of the texts are inserted into a trie and walked depth first. The state of a node is the last token
of the encoding of its prefix. It follows from the states above: of the tokens that end there, it is the one
that may stand behind the last token of what comes before it. So a prefix that many words share is encoded
once, and a word's encoding is read off by going up from its node, token by token.

The trie is kept as its sorted words: the walk holds the states of the current word's prefixes, and the next
word keeps those of the prefix that it shares with it.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE cuts text into words.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words whose encodings a worker keeps; beyond that it forgets them and goes on. Results don't depend on it.
KEPT_WORDS = 200_000


def _byte_of() -> dict[str, int]:
    """The byte that each character in a byte-level vocabulary stands for: printable ones themselves, others from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Bpe:
    """A byte-level BPE vocabulary, from the JSON form of the tokenizers library."""

    def __init__(self, vocabulary: dict):
        of = _byte_of()
        model = vocabulary["model"]
        self.bytes_of = {k: bytes(of[c] for c in token) for token, k in model["vocab"].items()}
        self.id_of = {b: k for k, b in self.bytes_of.items()}
        self.special = {t["content"]: t["id"] for t in vocabulary.get("added_tokens", [])}
        self.bytes_of.update({k: t.encode() for t, k in self.special.items()})
        vocab = model["vocab"]
        #: Of each merge its rank and the token made, and of each token the two that it is made from.
        self.merge: dict[tuple[int, int], int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if not isinstance(pair, str) else pair.split(" ")
            made = vocab[a + b]
            self.merge[vocab[a], vocab[b]] = rank
            if made not in self.halves:
                self.halves[made], self.rank[made] = (vocab[a], vocab[b]), rank
        self.longest = max(map(len, self.id_of))
        self.splits = regex.compile(PATTERN)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.follows: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}

    def may_follow(self, left: int, right: int) -> bool:
        """Whether the merges, applied to both tokens' bytes, leave just these two tokens.

        The merges of both are taken back, the latest first; none across the border may have come before.
        """
        found = self.follows.get((left, right))
        if found is not None:
            return found
        a, b, limit, merge, halves, rank = left, right, 1 << 60, self.merge, self.halves, self.rank
        while True:
            if merge.get((a, b), 1 << 60) < limit:
                found = False
                break
            x, y = rank.get(a, -1), rank.get(b, -1)
            if x < 0 and y < 0:
                found = True
                break
            # merges of equal rank go from left to right: one inside the left part comes before one across the border
            if x > y:
                limit, a = x, halves[a][1]
            else:
                limit, b = y + 1, halves[b][0]
        self.follows[left, right] = found
        return found

    def learn(self, words: Iterable[str]) -> None:
        """Put the encodings of words, as little-endian 32-bit ids, into `known`."""
        if len(self.known) > KEPT_WORDS:
            self.known.clear()
        if len(self.follows) > KEPT_WORDS:
            self.follows.clear()
        coded = sorted((w.encode(), w) for w in words if w not in self.known)
        id_of, size, may_follow = self.id_of, self.bytes_of, self.may_follow
        last: list[int] = []  # of each prefix of the current word, but the empty one, the last token
        before = b""
        for word, text in coded:
            n = len(word)
            shared = 0
            for x, y in zip(before, word):
                if x != y:
                    break
                shared += 1
            del last[shared:]
            for end in range(shared + 1, n + 1):
                for start in range(max(0, end - self.longest), end):
                    token = id_of.get(word[start:end])
                    if token is not None and (start == 0 or may_follow(last[start - 1], token)):
                        last.append(token)
                        break
            before = word
            ids = []
            at = n
            while at:
                ids.append(token := last[at - 1])
                at -= len(size[token])
            self.known[text] = np.array(ids[::-1], "<u4").tobytes()

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian 32-bit integers."""
        cut = []
        for text in texts:
            parts = [text] if self.specials is None else self.specials.split(text)
            cut.append([(x, None) if k % 2 else (None, self.splits.findall(x)) for k, x in enumerate(parts)])
        self.learn({w for parts in cut for _, words in parts if words for w in words})
        known = self.known.__getitem__
        return [b"".join(self.special[x].to_bytes(4, "little") if x is not None else b"".join(map(known, words)) for x, words in parts) for parts in cut]

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def loaded(text: str) -> Bpe:
    return Bpe(json.loads(text))


@lru_cache(maxsize=2)
def from_file(path: str) -> Bpe:
    with open(path, encoding="utf-8") as file:
        return loaded(file.read())


def shipped(spark: SparkSession, path: str) -> str:
    """Send the vocabulary file, a few MB whatever the corpus is, to all executors; the name to find it by."""
    spark.sparkContext.addFile(path)
    return path.rpartition("/")[2]


def encoded(df: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), ids: bool = True) -> DataFrame:
    """id_col, the columns in keep, n_tokens, ids (array<int>, if wanted), ids_sha256 and decoded_sha256, one row for each row of df.

    ids_sha256 is of the ids as little-endian 32-bit integers, decoded_sha256 of the UTF-8 of the decoded text. A null
    text is an empty one and has no ids. Special tokens' strings in a text become these tokens, as the tokenizers
    library has it, and are decoded like others. Repeated ids stay; no rows give no rows. A column in keep that has
    the name of one that is made, or of id_col, is left out.
    """
    keep = tuple(c for c in keep if c not in ("n_tokens", "ids", "ids_sha256", "decoded_sha256", id_col))
    name = shipped(df.sparkSession, vocabulary)
    source = df.select(F.col(id_col).alias("__id"), *keep, F.col(text_col).cast("binary").alias("__bytes"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = from_file(SparkFiles.get(name))
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                coded = bpe.encode_all([(t or b"").decode() for t in part.column("__bytes").to_pylist()])
                kept = [c for c in part.schema.names if c != "__bytes"]
                made = {"n_tokens": pa.array([len(c) // 4 for c in coded], pa.int64())}
                if ids:
                    edges = np.concatenate([[0], np.cumsum([len(c) // 4 for c in coded])]).astype(np.int32)
                    made["ids"] = pa.ListArray.from_arrays(pa.array(edges), pa.array(np.frombuffer(b"".join(coded), "<i4")))
                made["ids_sha256"] = pa.array([hashlib.sha256(c).hexdigest() for c in coded], pa.string())
                made["decoded_sha256"] = pa.array([hashlib.sha256(bpe.decode(c).encode()).hexdigest() for c in coded], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), *made.values()], [*kept, *made])

    head = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != "__bytes")
    made = source.mapInArrow(run, f"{head}, n_tokens long{', ids array<int>' if ids else ''}, ids_sha256 string, decoded_sha256 string")
    return made.withColumnRenamed("__id", id_col)


def vocabulary_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded again."""
    return encoded(spark.read.parquet(f"{sf_dir}/documents.parquet"), vocabulary_path(), ids=False)


def registered() -> Iterator[tuple]:
    yield "op3_bpe", op3_bpe, None
