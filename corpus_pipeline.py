"""Cleaning a corpus: quality classifier, line dedup, SimHash near-dedup, benchmark decontamination, BPE encoding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from stowage.llm import bpe, decontaminate, line_dedup, quality_classifier, simhash_dedup
from stowage.llm.common import written


def good_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs that the classifier, fitted on the labelled ones among them, finds neither poor nor toxic."""
    return quality_classifier.accepted(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def dropped_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without the boilerplate lines of their sources; n_chars follows the text."""
    return line_dedup.cleaned(docs)


def without_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies."""
    return simhash_dedup.one_of_each(docs)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs in which no window of a benchmark item occurs."""
    return decontaminate.uncontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, lang and n_tokens of docs, their token ids, and digests of the ids and of what they decode to."""
    return bpe.encoded(docs, bpe.vocabulary_path(), keep=("source", "lang"))


STAGES = [
    ("quality_classifier", good_documents),
    ("line_dedup", dropped_lines),
    ("simhash_dedup", without_copies),
    ("decontamination", without_leaks),
    ("bpe", encoded),
]
#: The classifier is fitted and the fingerprints are no SQL; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir; each but the last writes its result and the next reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs)
    return docs
