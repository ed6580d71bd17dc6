"""From raw documents to shards: quality, near duplicates, benchmark leaks, source weights, shards.

Every stage takes all rows that the one before it kept and writes what it keeps to the shared folder.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tabloom.llm import decontaminate, mixing, quality_pu, simhash_vptree, slots
from tabloom.llm.common import Scratch, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality_pu.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates, by op4's contract: fingerprints at most 4 of 64 bits apart.

    Most near copies whose shingle Jaccard is below about 0.95 differ in more bits and stay.
    """
    return simhash_vptree.keep_one(docs)


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark passage."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them."""
    return mixing.mix(docs)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shard and place of every row."""
    return slots.shard_rows(docs)


STAGES = [
    ("quality classifier", quality),
    ("near-duplicate removal", near_duplicates),
    ("benchmark decontamination", benchmark_leaks),
    ("source mixing", source_weights),
    ("sharding", shards),
]
# Trained weights, fingerprints by bit votes and iterated tilts are beyond SQL; the stages called by hand test run().
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    scratch = Scratch(spark, "pipeline")
    for _, stage in STAGES:
        docs = scratch.write(stage(spark, docs, sf_dir), keep=True)
    return docs
