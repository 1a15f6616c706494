"""Where change, size and repair meet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.columns import pain, ratio, spread
from heddle.functions.params import DEFAULTS
from heddle.operators.cooccur import bounded_groups
from heddle.operators.ranks import with_percentile


def hotspots(rows: DataFrame, group: str, item: str, fixes: DataFrame, sizes: DataFrame, most: int = DEFAULTS.mega_commit_files) -> DataFrame:
    """item, size, edits, fixes, fix_share, score = edits * size, score_pct of every item in sizes (item, size).

    Edits count groups of at most `most` items, fixes all fixing groups (fixes: (group)), so the
    share may exceed 1. Items without a size are left out (they are gone).
    """
    edits = bounded_groups(rows, group, item, most).groupBy("item").agg(F.count("*").alias("edits"))
    touched = rows.select(F.col(group).alias("group"), F.col(item).alias("item")).where("group is not null and item is not null").distinct()
    repaired = touched.join(fixes.select("group").distinct(), "group", "left_semi").groupBy("item").agg(F.count("*").alias("fixes"))
    each = sizes.join(edits, "item").join(repaired, "item", "left").withColumn("fixes", F.coalesce("fixes", F.lit(0)))
    each = each.withColumn("fix_share", ratio("fixes", "edits")).withColumn("score", F.col("edits") * F.col("size"))
    return with_percentile(each, "score", "score_pct").select("item", "size", "edits", "fixes", "fix_share", "score", "score_pct")


def painful(spots: DataFrame, share: float = 0.25, edits: int = 10) -> DataFrame:
    return spots.where((F.col("fix_share") >= share) & (F.col("edits") >= edits))


def extension_points(spots: DataFrame, percentile: int = 80, share: float = 0.15) -> DataFrame:
    """Often changed and large, but seldom repaired: meant to be extended."""
    return spots.where((F.col("score_pct") >= percentile) & (F.col("fix_share") < share))


def when_touched(sizes: DataFrame, edits: DataFrame, size: int, fewer: int) -> DataFrame:
    """Large items that are seldom changed: item, size, edits."""
    each = sizes.where(F.col("size") >= size).join(edits, "item", "left").withColumn("edits", F.coalesce("edits", F.lit(0)))
    return each.where(F.col("edits") < fewer)


def priorities(spots: DataFrame, reach: DataFrame) -> DataFrame:
    """item, pain, spread, priority = pain * spread; reach: (item, fan_in, coupled), missing ones 0."""
    each = spots.join(reach, "item", "left")
    return each.select("item", pain("fix_share", "edits").alias("pain"), spread("fan_in", "coupled").alias("spread")).withColumn("priority", F.col("pain") * F.col("spread"))


def top(df: DataFrame, k: int, *order) -> DataFrame:
    """The first k rows; order must be total. Spark keeps k rows a task, not a sorted whole."""
    return df.orderBy(*order).limit(k)
