import hashlib
import random

import duckdb
import numpy as np
import pytest
from tokenizers import Tokenizer

from stowage.llm.bpe import encoded, from_file, op3_bpe, vocabulary_path


@pytest.fixture(scope="module")
def both():
    return from_file(vocabulary_path()), Tokenizer.from_file(vocabulary_path())


def agree(both, texts):
    bpe, other = both
    coded = bpe.encode_all(texts)
    for text, code, want in zip(texts, coded, other.encode_batch(texts, add_special_tokens=False), strict=True):
        ids = np.frombuffer(code, "<u4").tolist()
        assert ids == want.ids, text
        assert bpe.decode(code) == other.decode(ids, skip_special_tokens=False)


def test_random_texts(both):
    rng = random.Random(1)
    letters = "aaaabbcdeeeéèñßü' \n\t  .,!!??0123_<|>字ж‍\xa0́🙂"
    agree(both, ["".join(rng.choices(letters, k=rng.randrange(0, 60))) for _ in range(4000)])
    syllables = ["the", "er", "tion", "re", "ss", "aa", "a", "ing", " ", " the", "he", "in", "\n\n", "----", "===", "  "]
    agree(both, ["".join(rng.choices(syllables, k=rng.randrange(1, 30))) for _ in range(4000)])


def test_edges(both):
    agree(both, ["", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "x" * 5000, "ab" * 3000, "-" * 700, "\n" * 300, "don't we'll I'VE 's", "\x00\x01\x7f"])


def test_documents(both):
    agree(both, [t or "" for (t,) in duckdb.sql("select text from '/root/testdata/sf0.001/documents.parquet'").fetchall()])


def test_query(spark, both, tmp_path):
    """The whole query against the library: null and long texts, repeated rows, an empty table."""
    texts = [None, "", "x" * 300_000, "some words <|endoftext|> é🙂\n", "some words <|endoftext|> é🙂\n", " word" * 60_000]
    rows = [(k if k != 4 else 3, t, "en") for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, ids string").write.parquet(f"{tmp_path}/documents.parquet")
    made = op3_bpe(spark, str(tmp_path))
    assert made.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = []
    for k, t, _ in rows:
        ids = both[1].encode(t or "", add_special_tokens=False).ids
        want.append((k, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(both[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert sorted(tuple(r) for r in made.collect()) == sorted(want)
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert op3_bpe(spark, f"{tmp_path}/none").count() == 0


def test_clashing_columns(spark):
    df = spark.createDataFrame([("a", "some words", 7, "k", 1.5)], "doc_id string, text string, n_tokens int, ids string, id double")
    made = encoded(df, vocabulary_path(), keep=("n_tokens", "ids", "id", "doc_id"))
    assert made.columns == ["doc_id", "id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]
    r = made.first()
    assert (r.doc_id, r.id, r.n_tokens, len(r.ids)) == ("a", 1.5, 2, 2)
