"""Where a tree's own code begins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

USUAL = ("src", "lib", "app", "pkg", "internal")


def root_shares(paths: DataFrame, path: str) -> DataFrame:
    """(first, n, share): first directories among paths that have one."""
    firsts = paths.where(F.col(path).contains("/")).groupBy(F.substring_index(path, "/", 1).alias("first")).agg(F.count("*").alias("n"))
    return firsts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def package_roots(paths: DataFrame, path: str) -> list[str]:
    """Of the three commonest first directories those with over 0.75 of all paths, or over 0.55 and a usual name."""
    top = root_shares(paths, path).orderBy(F.desc("n"), "first").limit(3)
    return [r["first"] for r in top.collect() if r["share"] > 0.75 or r["share"] > 0.55 and r["first"] in USUAL]
