"""Ad-hoc questions to a history table (sha, author, epoch, subject, file), and the flat snapshot of a run."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.columns import is_revert, ratio
from heddle.operators.cooccur import concentration, containment, cooccurrence, group_layers
from heddle.operators.graph import cycles
from heddle.operators.timelines import DAY, rework


def revisions(history: DataFrame, *paths: str) -> DataFrame:
    """Per path: revisions, authors, first and last time."""
    return history.where(F.col("file").isin(*paths)).groupBy("file").agg(F.countDistinct("sha").alias("revisions"), F.countDistinct("author").alias("authors"), F.min("epoch").alias("first"), F.max("epoch").alias("last"))


def authors(history: DataFrame, below: str = "") -> DataFrame:
    return history.where(F.col("file").startswith(below)).groupBy("author").agg(F.countDistinct("sha").alias("commits"))


def reverts(history: DataFrame) -> DataFrame:
    """Per file: commits that revert."""
    return history.where(is_revert("subject")).groupBy("file").agg(F.countDistinct("sha").alias("reverts"))


def together(history: DataFrame, one: str, other: str) -> DataFrame:
    """One row: commits that touch both directories."""
    by = history.groupBy("sha").agg(F.max(F.col("file").startswith(one)).alias("a"), F.max(F.col("file").startswith(other)).alias("b"))
    return by.agg(F.count(F.when(F.col("a") & F.col("b"), 1)).alias("both"), F.count(F.when(F.col("a"), 1)).alias("one"), F.count(F.when(F.col("b"), 1)).alias("other"))


def snapshot(run: str, history: DataFrame, edges: DataFrame, layer: str = "layer", window: int = 14 * DAY) -> DataFrame:
    """One row of trend fields of a run, over whole relations: history has layer and fix columns."""
    layers = containment(group_layers(history, "sha", "file", layer))
    total = rework(history.select(F.lit("all").alias("k"), "file", "epoch", "fix"), "file", "epoch", F.col("fix"), window).agg(ratio(F.sum("reworked"), F.sum("changes")).alias("rework"))
    one = lambda df: df.withColumn("one", F.lit(1))
    parts = [
        layers.select(F.col("ratio").alias("containment")), total, history.agg(F.countDistinct("file").alias("files"), F.countDistinct("sha").alias("commits")), edges.agg(F.count("*").alias("edges")),
        cycles(edges).agg(F.countDistinct("cycle").alias("cycles"), F.count("*").alias("cycle_members")), cooccurrence(history, "sha", "file").agg(F.count("*").alias("coupling_pairs")), concentration(history, "file", "author").agg(F.count("*").alias("knowledge_risks")),
    ]
    out = one(history.sparkSession.range(1).select(F.lit(run).alias("run")))
    for p in parts:
        out = out.join(one(p), "one")
    return out.drop("one")
