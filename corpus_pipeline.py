"""A corpus pipeline: quality rules, near-duplicate removal, decontamination, mixing, sharding.

Each stage works on all that the one before it kept. ORACLE_SQL is None: connected components of near copies and string
tilings have no SQL; tests/llm holds the pipeline against a brute-force version.

Defined results, for every stage: the columns of documents pass through whatever their names, extra ones too; an empty table
gives an empty one; rows that repeat are rows each until near_duplicates leaves one of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from slipcoach.llm import jaccard, mixing, quality, sharding, tiling
from slipcoach.plans import shared as scratch


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go.

    A null or blank text fails the base rules and goes; a null language is a language of its own.
    """
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays: five-word shingles, 0.8 (op10's four words and 0.85 are that query's own).

    The smallest id of the group stays; of several rows with that id, or of a group without any id, one by the hash of its
    text. Documents without words stay.
    """
    return jaccard.keep_one(docs, shingle=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that leak a benchmark item go.

    A null or empty text leaks nothing and stays; repeated documents are judged alike.
    """
    return tiling.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document comes as often as the mix takes it.

    A null source is the last source; equal ids draw alike; a source without words gives nothing.
    """
    return mixing.emit(docs)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document with its shard, by its id alone; null ids share a shard. A column `shard` that was there becomes `shard_`."""
    return sharding.assign(docs)


STAGES = [("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mix), ("sharding", shard)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = scratch.save(stage(spark, docs, sf_dir), name)
    return docs
