"""Ranks and quantiles of a whole population, without gathering or sorting it in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.operators.saving import saved

SLICES = 64


def cumulative(counts: DataFrame, value: str) -> DataFrame:
    """(value, __upto, __all): of counts (value, __n; a row a value), how many rows are not above each value, and all.

    Values are cut into slices at approximate quantiles; running counts are taken within each slice and shifted by
    those before, so only the SLICES sums meet in one task. A value that very many rows share is one row.
    """
    cuts = sorted(set(counts.select(F.col(value).cast("double").alias("v")).approxQuantile("v", [i / SLICES for i in range(1, SLICES)], 0.005)))
    place = F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]), lambda c: c < F.col(value).cast("double"))) if cuts else F.lit(0)
    sliced = counts.withColumn("__s", place)
    sums = sliced.groupBy("__s").agg(F.sum("__n").alias("__t"))
    before = sums.select("__s", F.coalesce(F.sum("__t").over(Window.orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"), F.sum("__t").over(Window.partitionBy()).alias("__all"))
    own = sliced.withColumn("__own", F.sum("__n").over(Window.partitionBy("__s").orderBy(value))).join(F.broadcast(before), "__s")  # at most SLICES rows
    return own.select(value, (F.col("__own") + F.col("__before")).alias("__upto"), "__all")


def value_counts(df: DataFrame, value: str) -> DataFrame:
    return saved(df.where(F.col(value).isNotNull()).groupBy(value).agg(F.count("*").alias("__n")))


def with_percentile(df: DataFrame, value: str, name: str) -> DataFrame:
    """df with the share of rows not above `value`, in whole per cent (half to even); null for null."""
    df = saved(df)
    rank = F.bround(100 * (F.col("__upto") / F.col("__all"))).cast("long")
    return df.join(cumulative(value_counts(df, value), value).select(value, rank.alias(name)), value, "left")


def exact_median(df: DataFrame, value: str, name: str) -> DataFrame:
    """One row: the median of a column's values; null if there is none."""
    first = lambda place: F.min(F.when(F.col("__upto") > place, F.col(value)))
    return cumulative(value_counts(df, value), value).agg(((first(F.floor((F.col("__all") - 1) / 2)) + first(F.floor(F.col("__all") / 2))) / 2).alias(name))


def beside(*rows: DataFrame) -> DataFrame:
    """One row of tables of one row each; nulls for those after the first that have none."""
    out = rows[0].withColumn("__one", F.lit(1))
    for other in rows[1:]:
        out = out.join(other.withColumn("__one", F.lit(1)), "__one", "left")
    return out.drop("__one")


def with_place(df: DataFrame, name: str, *order) -> DataFrame:
    """df with each row's place, from 1, in a total order: ranges of the order are numbered each by itself and shifted by those before."""
    ranged = saved(df.repartitionByRange(*order).withColumn("__part", F.spark_partition_id()))
    sums = ranged.groupBy("__part").agg(F.count("*").alias("__n"))  # a row a task
    before = sums.select("__part", F.coalesce(F.sum("__n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    own = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.withColumn("__own", own).join(F.broadcast(before), "__part").withColumn(name, F.col("__own") + F.col("__before")).drop("__part", "__own", "__before")
