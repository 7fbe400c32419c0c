"""The corpus pipeline: each stage reads the documents that its predecessor kept, as a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from sketchloom.llm import decontam, mixing, neardup, quality, sharding
from sketchloom.session import materialize


def filter_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rule and are no outlier of their language and source."""
    return quality.accepted(docs)


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the least id of every group of near duplicates."""
    return neardup.deduplicated(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark; those that are mostly such passages go."""
    return decontam.cleaned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources mixed to their target weights: documents repeated or left out."""
    return mixing.repeated(docs, mixing.by_code_point((5, 2, 1)), share=1.5, max_epochs=2.0)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed documents with the shard and slot they are written to."""
    return sharding.sharded(docs, shards=16, written=True)


STAGES = [("quality", filter_quality), ("near_dedup", dedup), ("decontamination", decontaminate), ("mixing", mix), ("sharding", shard)]

# The quality stage's covariance estimates have no SQL form; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
