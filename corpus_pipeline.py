"""A corpus pipeline over ``documents``; each stage is written as Parquet and read again.

Stages see whatever their predecessor kept. All but the last return the columns of documents.
Documents with null ids can't be told apart by the filters and stay; null texts stay too.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm import decontaminate, mixing, neardup, quality, secrets
from tilewright.llm.store import materialise, small_batches


def stage(fn):
    """Stages share a session for long; what they hand to Python workers is kept small."""

    @wraps(fn)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        small_batches(spark)
        return fn(spark, docs, sf_dir)

    return run_stage


@stage
def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Quality classifier: documents that it rejects go. Host: the source; path there: the language."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), F.col("source"), F.col("lang"))


@stage
def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """MinHash near-dedup: the document with the smallest id of each group stays."""
    return neardup.one_of_each(docs)


@stage
def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Benchmark decontamination: documents that hold a benchmark item go."""
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@stage
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secret scans: every secret is replaced by a mark; no document goes."""
    return secrets.redact(docs).withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("bigint")))


@stage
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Mixing sources to target weights: the mixed blocks with their texts."""
    return mixing.mix(docs)


STAGES = [
    ("quality", drop_low_quality),
    ("near-dedup", drop_near_copies),
    ("decontaminate", drop_leaks),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
]

ORACLE_SQL = None  # classifier, automata and draws have no SQL form; tests/llm hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, apply in STAGES[:-1]:
        docs = materialise(apply(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
