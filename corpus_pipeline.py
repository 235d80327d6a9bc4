"""The corpus pipeline: five stages over documents, each written as Parquet and read again as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from seqloom.llm import minhash, mixing, packing, quality_rules, run_index
from seqloom.llm.common import scratch_path

SMALL_BATCH = "1000"


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that fail the base rules or whose posterior of being good is below one half."""
    return quality_rules.keep_good(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the smallest doc_id of each near-duplicate group."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", SMALL_BATCH)
    return minhash.keep_first(docs)


def long_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 200 bytes or more that occur twice out of the texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", SMALL_BATCH)
    return run_index.strip(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes each document as often as its source's share of the mix asks for; documents without words are not taken."""
    return mixing.take(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of at most 1024 tokens."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", SMALL_BATCH)
    return packing.pack(docs)


STAGES = [("quality_rules", quality), ("minhash", near_dedup), ("run_index", long_repeats), ("mixing", mix), ("packing", pack)]

#: Votes weighed by EM, MinHash buckets and a tokenizer are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
