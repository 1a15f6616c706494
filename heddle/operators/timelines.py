"""Operators over each item's time line: episodes, rework within a window, buckets of age, payback."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.columns import quarter_bucket, ratio, wilson_lower
from heddle.functions.params import DAY, DEFAULTS
from heddle.operators.ranks import beside, exact_median, with_percentile
from heddle.operators.saving import saved

MICROS = 1_000_000


def episodes(rows: DataFrame, key: str | None, at: str, tie: str, gap: int) -> DataFrame:
    """(key, episode, first, last, events): runs of events not more than `gap` apart, of each key or (None) of all rows."""
    rows, keys = rows.where(F.col(at).isNotNull()), [key] if key else []
    if key:
        order = Window.partitionBy(key).orderBy(at, tie)
        cut = F.when(F.col(at) - F.lag(at).over(order) <= gap, 0).otherwise(1)
        rows = rows.withColumn("cut", cut).withColumn("episode", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    else:
        rows = _across(rows, at, gap)
    return rows.groupBy(*keys, "episode").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("events"))


def episode_totals(each: DataFrame) -> DataFrame:
    """One row: episodes, events, mean and median events, share and median span of those with several events."""
    multi = F.col("events") > 1
    each = saved(each.select("events", F.when(multi, F.col("last") - F.col("first")).alias("span")))
    counts = each.agg(F.count("*").alias("episodes"), F.sum("events").alias("events"), F.avg("events").alias("mean_events"), ratio(F.count(F.when(multi, 1)), F.count("*")).alias("multi_share"))
    return beside(counts, exact_median(each, "events", "median_events"), exact_median(each, "span", "median_multi_span"))


def slowest(each: DataFrame, key: str, least: int = DEFAULTS.velocity_min_episodes) -> DataFrame:
    """Keys with at least that many episodes: key, episodes, median span, median events."""
    return each.groupBy(key).agg(F.count("*").alias("episodes"), F.median(F.col("last") - F.col("first")).alias("median_span"), F.median("events").alias("median_events")).where(F.col("episodes") >= least)


def next_within(rows: DataFrame, key: str, at: str, hit: Column, window: int, name: str = "next_at") -> DataFrame:
    """rows with the time of the key's earliest hit in (at, at + window], or null.

    A range frame over the key's own time line: no join, and ties of `at` never see each other.
    """
    frame = Window.partitionBy(key).orderBy(at).rangeBetween(1, window)
    return rows.withColumn(name, F.min(F.when(hit, F.col(at))).over(frame))


def rework(rows: DataFrame, key: str, at: str, fix: Column, window: int) -> DataFrame:
    """Per key: changes, those that a fix followed within the window, their rate, its lower bound and the median delay."""
    seen = next_within(rows.where(F.col(at).isNotNull() & F.col(key).isNotNull()), key, at, fix, window).where(~fix)
    return _rework(seen.groupBy(key), at)


def _rework(grouped, at: str) -> DataFrame:
    return _rates(grouped.agg(F.count("*").alias("changes"), F.count("next_at").alias("reworked"), F.median(F.col("next_at") - F.col(at)).alias("median_delay")))


def _rates(counts: DataFrame) -> DataFrame:
    return counts.withColumn("rate", ratio("reworked", "changes")).withColumn("rate_low", wilson_lower("reworked", "changes"))


def rework_with_total(rows: DataFrame, key: str, at: str, fix: Column, window: int) -> DataFrame:
    """rework() of every key and, with a null key, of all rows, whose median is that of counted values."""
    seen = saved(next_within(rows.where(F.col(at).isNotNull() & F.col(key).isNotNull()), key, at, fix, window).where(~fix).select(key, at, "next_at"))
    whole = beside(seen.agg(F.count("*").alias("changes"), F.count("next_at").alias("reworked")), exact_median(seen.select((F.col("next_at") - F.col(at)).alias("delay")), "delay", "median_delay"))
    own = _rework(seen.groupBy(key), at)
    return own.unionByName(_rates(whole.select(F.lit(None).cast(seen.schema[key].dataType).alias(key), "changes", "reworked", "median_delay")))


def unstable(each: DataFrame, key: str, least: int = DEFAULTS.rework_min_changes) -> DataFrame:
    """Keys with enough changes, and the percentile of their lower bound among them."""
    return with_percentile(each.where(F.col("changes") >= least), "rate_low", "rate_low_pct").select(key, "changes", "reworked", "rate", "rate_low", "rate_low_pct")


def edits_by_quarter(rows: DataFrame, at: str, now: int, span: float) -> DataFrame:
    """(bucket, edits) for the four age buckets, 0 the oldest; buckets without edits have 0."""
    found = rows.where(F.col(at).isNotNull()).groupBy(quarter_bucket(F.lit(now) - F.col(at), span).alias("bucket")).agg(F.count("*").alias("edits"))
    every = rows.sparkSession.range(4).select(F.col("id").cast("int").alias("bucket"))
    return every.join(found, "bucket", "left").select("bucket", F.coalesce("edits", F.lit(0)).alias("edits"))


def _across(rows: DataFrame, at: str, gap: int) -> DataFrame:
    """rows with the episode that they are in, over all rows.

    Rows of one slice of time as long as the gap are one episode, so only the slices are put in order: a row for each
    gap of the time span, whatever the number of rows.
    """
    part, order = F.col(at) - F.pmod(F.col(at), F.lit(max(gap, 1))), Window.orderBy("part")
    rows = rows.withColumn("part", part)
    parts = rows.groupBy("part").agg(F.min(at).alias("first"), F.max(at).alias("last"))
    cut = F.when(F.col("first") - F.lag("last").over(order) <= gap, 0).otherwise(1)
    runs = parts.withColumn("cut", cut).select("part", F.sum("cut").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("episode"))
    return rows.join(F.broadcast(runs), "part").drop("part")


def pain_per_quarter(touches: DataFrame, item: str, fix: Column, now: int, since_days: int = 365, gap: int = DEFAULTS.episode_gap_days * DAY) -> DataFrame:
    """From all touching events (at, item; a row an item): fix episodes, episodes a quarter, median width, and their product.

    Episodes are formed over all events and kept if one of them is a fix; an episode's width is the number of its distinct items.
    """
    seen = touches.where((F.col("at") > now - since_days * DAY) & (F.col("at") <= now)).withColumn("fix", fix)
    each = _across(seen, "at", gap).groupBy("episode").agg(F.max("fix").alias("fixed"), F.countDistinct(item).alias("width"))
    fixed = saved(each.where("fixed"))
    one = beside(fixed.agg(F.count("*").alias("fix_episodes")), exact_median(fixed, "width", "median_width"))
    per = F.col("fix_episodes") / F.lit(since_days / 91.25)
    return one.select("fix_episodes", per.alias("episodes_per_quarter"), "median_width", (per * F.coalesce("median_width", F.lit(0.0))).alias("pain"))


def covered(ranges: DataFrame, key: str, first: str, last: str) -> DataFrame:
    """(key, islands, covered): how many whole numbers the union of [first, last] ranges covers."""
    order = Window.partitionBy(key).orderBy(first, last)
    before = F.max(last).over(order.rowsBetween(Window.unboundedPreceding, -1))
    island = F.sum(F.when(F.col(first) <= before + 1, 0).otherwise(1)).over(order.rowsBetween(Window.unboundedPreceding, 0))
    runs = ranges.where(F.col(first) <= F.col(last)).withColumn("island", island).groupBy(key, "island").agg((F.max(last) - F.min(first) + 1).alias("size"))
    return runs.groupBy(key).agg(F.count("*").alias("islands"), F.sum("size").alias("covered"))
