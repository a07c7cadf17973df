"""The corpus pipeline: stages that each take (spark, docs, sf_dir) and return
the documents that go on.  Every stage's result is written as Parquet and read
again as the next one's input, so each stage starts from files."""

from __future__ import annotations

import os
import sys

from pyspark.sql import DataFrame, SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from dunning.llm.common import read_table, stage  # noqa: E402
from dunning.llm.decontaminate import drop_contaminated  # noqa: E402
from dunning.llm.exact_dedup import drop_exact_copies  # noqa: E402
from dunning.llm.quality import keep_quality  # noqa: E402
from dunning.llm.sentencepieces import public_model, sentencepiece_ids  # noqa: E402
from dunning.llm.simhash import drop_near_copies  # noqa: E402


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    return keep_quality(docs, read_table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the smallest id."""
    return drop_exact_copies(docs)


def simhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: shingles of 3 words, 3 bits."""
    return drop_near_copies(docs, k=3, most_bits=3)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def sentencepiece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of what is left, each text decoded again and compared."""
    return sentencepiece_ids(docs, public_model())


STAGES = [
    ("quality classifier", quality_classifier),
    ("exact dedup", exact_dedup),
    ("SimHash near-dedup", simhash_near_dedup),
    ("benchmark decontamination", benchmark_decontamination),
    ("SentencePiece encoding and decoding", sentencepiece_encoding),
]

#: SQL cannot express a trained classifier; tests/llm holds brute-force versions of the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, step in STAGES[:-1]:
        docs = stage(step(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
