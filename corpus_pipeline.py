"""The corpus pipeline: five stages over the documents, each of them one training-data operator.

A stage gets what the one before it kept, written as Parquet and read again, and returns the columns
of the documents (the last one: token ids).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from specloom.llm import mixing, quality_classifier, sentencepiece_scan, simhash, suffix_dedup
from specloom.llm.common import materialise, table


def classify_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores under 0.5 go."""
    return quality_classifier.accepted(docs, quality_classifier.learn(docs, table(spark, sf_dir, "labels")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group stays: the one with the least doc_id."""
    return simhash.deduplicated(docs)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of over 50 words that occur elsewhere too are cut out of the texts."""
    return suffix_dedup.deduplicated(docs, suffix_dedup.PASSAGE, words=True)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of sources with large targets may come twice, others not at all."""
    return mixing.mixed_documents(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids, and a digest of what they decode to."""
    return sentencepiece_scan.encode_and_check(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", classify_quality),
    ("SimHash near-dedup", drop_near_copies),
    ("suffix-array dedup", cut_repeats),
    ("mixing sources", mix_sources),
    ("SentencePiece encoding", encode),
]
#: Boosted trees, byte spans and merges by score are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = materialise(docs, f"stage-{i + 1}")
    return docs
