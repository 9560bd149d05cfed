"""The stages of the corpus pipeline: each takes what its predecessor kept and decides by one operator.

What they do with odd rows stands in ``corpus_pipeline.py``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from rowtide.llm import decontaminate, mixing, quality_model, sharding, simhash
from rowtide.llm.common import DOCUMENT_COLUMNS

SHARDS = 16


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts."""
    model = quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality_model.score(docs, model).where("predicted = 1").select(*DOCUMENT_COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (shingles of five words, similarity 0.8)."""
    return simhash.near_copies(docs).select(*DOCUMENT_COLUMNS)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of ten words of any benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.flag(docs, benchmark).where("not contaminated").select(*DOCUMENT_COLUMNS)


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; the next stage shuffles them."""
    return mixing.mix(docs, shards=SHARDS, in_order=False).select(*DOCUMENT_COLUMNS)


def shuffled_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every row with its shard and slot."""
    return sharding.shard_rows(docs, SHARDS)
