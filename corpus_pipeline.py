"""From raw documents to packed sequences of tokens.

Five stages, each a function of (spark, docs, sf_dir): documents that the quality classifier rejects
go, of equal texts one stays, of near-duplicates one stays, documents that hold a benchmark item
go, and the rest is packed. Every stage works on all that the one before kept. run() writes each
stage's rows as Parquet to the shared folder and reads them back, so that a lost executor never
costs more than a stage, and deletes what a later stage has replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from heddle.llm.common import remove, shared_dir, table
from heddle.llm.decontaminate import without_leaks
from heddle.llm.exact_dedup import keep_first
from heddle.llm.near_dedup import keep_one
from heddle.llm.packing import pack
from heddle.llm.quality import keep_good


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_first(docs)


def minhash_near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one(docs)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES = [(f.__name__, f) for f in (quality_classifier, exact_dedup, minhash_near_dedup, benchmark_decontamination, best_fit_packing)]

#: SQL can't express the classifier or the tokenizer; tests/llm compares with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage."""
    docs, before = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = shared_dir(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
