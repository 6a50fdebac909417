"""From raw documents to packed training sequences: each stage is written as Parquet and reread as the next one's input.

Stages before the last keep the columns of ``documents`` and drop rows; the last returns one row per packed piece.
Each stage handles null ids and texts, empty texts and empty tables as its operator's docstring says; columns beyond
those of ``documents`` pass through the filtering stages unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from skymill.llm import block_naming, rule_ensemble, simhash_vp, spaced_seeds, tier_packing
from skymill.llm.tables import table
from skymill.runtime import cut


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep what the rule ensemble, fitted on the labelled documents, predicts as good."""
    return rule_ensemble.keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of equal texts."""
    return block_naming.without_duplicates(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies: five-word shingles, a similarity of 0.8."""
    return simhash_vp.one_per_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that overlap a benchmark item."""
    return spaced_seeds.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Tokenize and pack into sequences of at most 1,024 tokens."""
    return tier_packing.pack_documents(docs)


STAGES = [("quality_classifier", quality), ("exact_dedup", exact), ("simhash_near_dedup", near), ("benchmark_decontamination", decontaminate), ("packing", pack)]

#: The classifier, the fingerprints and the tokenizer are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
