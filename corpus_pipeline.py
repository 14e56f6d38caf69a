"""Corpus pipeline: its stages are applied in turn to documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from linkloom.llm import mixing, near_copies, packing, passages, weak_labels
from linkloom.llm.common import table
from linkloom.scratch import scope, scratch_path, stored

#: Five-word shingles; texts that share 0.8 of them are near copies.
NEAR_COPIES = near_copies.NearCopies(width=5, least_jaccard=0.8)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the quality classifier keeps."""
    return weak_labels.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    return near_copies.keep_one(docs, NEAR_COPIES)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without the passages that an earlier one has."""
    return passages.without_repeats(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as often as the mix of their sources takes them."""
    return mixing.mixed(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents as pieces of packed sequences."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("substring dedup", substring_dedup),
    ("source mixing", source_mix),
    ("packing", packed),
]
#: The stages hash, tokenize and learn; SQL cannot express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn; each stage's result is written and read again, and what it wrote beside that is removed."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        with scope(spark):
            stored(stage(spark, docs, sf_dir), path, "snappy")
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
