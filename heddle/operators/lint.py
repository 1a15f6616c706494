"""Linter findings to grouped counts per file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.operators.ranks import with_percentile

#: Prefixes of codes by group; the first group with a fitting prefix counts.
GROUPS = {"simplicity": ("C90", "SIM", "PLR09", "PLR17", "RET"), "width": ("E501", "W505"), "perf": ("PERF", "FURB", "C4")}


def group_of(code: Column | str, groups: dict[str, tuple[str, ...]] = GROUPS) -> Column:
    c = F.col(code) if isinstance(code, str) else code
    out = F.lit(None).cast("string")
    for name, prefixes in reversed(groups.items()):
        fits = F.lit(False)
        for p in prefixes:
            fits = fits | c.startswith(p)
        out = F.when(fits, name).otherwise(out)
    return out


def read_findings(spark, path: str) -> DataFrame:
    """(file, code) of a JSON report: a list of objects with filename and code."""
    return spark.read.schema("filename string, code string").json(path, multiLine=True).select(F.col("filename").alias("file"), "code").where("file is not null")


def read_performance(spark, path: str) -> DataFrame:
    """(file, code) of results whose metadata category is performance."""
    schema = "results array<struct<path:string,check_id:string,extra:struct<metadata:struct<category:string>>>>"
    each = spark.read.schema(schema).json(path, multiLine=True).select(F.explode("results").alias("r"))
    return each.where("r.extra.metadata.category = 'performance'").select(F.col("r.path").alias("file"), F.col("r.check_id").alias("code"))


def counts(findings: DataFrame, files: DataFrame, groups: dict[str, tuple[str, ...]] = GROUPS) -> DataFrame:
    """file and a count for each group, 0 for files without findings."""
    each = findings.withColumn("g", group_of("code", groups)).where("g is not null").groupBy("file").agg(*[F.count(F.when(F.col("g") == g, 1)).alias(g) for g in groups])
    return files.select("file").distinct().join(each, "file", "left").na.fill(0, list(groups))


def with_ranks(each: DataFrame, hot: DataFrame, groups: dict[str, tuple[str, ...]] = GROUPS) -> DataFrame:
    """counts() with a percentile for each group and whether the file is one of hot (file)."""
    for g in groups:
        each = with_percentile(each, g, f"{g}_pct")
    return each.join(hot.select("file", F.lit(True).alias("hot")).distinct(), "file", "left").na.fill(False, ["hot"])
