"""Items that change together, and who owns what: co-occurrence, containment, concentration, width."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.columns import floor_quantile, ratio
from heddle.functions.params import DEFAULTS
from heddle.operators.saving import maybe_broadcast, pieces, saved


def bounded_groups(rows: DataFrame, group: str, item: str, most: int = DEFAULTS.mega_commit_files, *more: str) -> DataFrame:
    """Distinct (group, item, *more) of groups with 1..most items.

    Items are counted first, which combines before the shuffle, and groups over the limit, which are few, leave before rows
    meet by group, so a group that is too large never meets in one task.
    """
    distinct = rows.select(F.col(group).alias("group"), F.col(item).alias("item"), *more).where("group is not null and item is not null").repartition(pieces(rows), "group", "item").distinct()
    large = saved(distinct.groupBy("group").agg(F.count("*").alias("n")).where(F.col("n") > most).select("group"))
    return distinct.join(maybe_broadcast(large, large.count()), "group", "left_anti")


def cooccurrence(rows: DataFrame, group: str, item: str, most: int = DEFAULTS.mega_commit_files, min_shared: int = DEFAULTS.coupling_min_shared, min_degree: float = DEFAULTS.coupling_min_degree) -> DataFrame:
    """Pairs a < b with shared groups, solo counts and degree = shared / the smaller solo count.

    Pairs come from each group's own array (at most most * (most - 1) / 2 of them): one shuffle
    instead of a self-join. Support is applied before the two joins with the solo counts.
    """
    own = bounded_groups(rows, group, item, most)
    items = own.groupBy("group").agg(F.array_sort(F.collect_list("item")).alias("items"))
    heads = items.select("items", F.posexplode("items").alias("at", "a"))
    pairs = heads.select("a", F.explode(F.slice("items", F.col("at") + 2, F.greatest(F.size("items") - F.col("at") - 1, F.lit(0)))).alias("b"))
    shared = pairs.groupBy("a", "b").agg(F.count("*").alias("shared")).where(F.col("shared") >= min_shared)
    solo = own.groupBy("item").agg(F.count("*").alias("n"))
    both = shared.join(solo.toDF("a", "solo_a"), "a").join(solo.toDF("b", "solo_b"), "b")
    return both.withColumn("degree", ratio("shared", F.least("solo_a", "solo_b"))).where(F.col("degree") >= min_degree).select("a", "b", "shared", "solo_a", "solo_b", "degree")


def examples(rows: DataFrame, key: str, example: str, newest: str, most: int) -> DataFrame:
    """(key, examples): up to `most` examples of each key, newest first."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.col(newest).desc(), example))
    top = rows.withColumn("rank", rank).where(F.col("rank") <= most)
    return top.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", example))), lambda x: x[example]).alias("examples"))


def group_layers(rows: DataFrame, group: str, item: str, layer: str, most: int = DEFAULTS.mega_commit_files) -> DataFrame:
    """(group, layers): the sorted distinct layers of every group with at most `most` items."""
    return bounded_groups(rows, group, item, most, layer).repartition(pieces(rows), "group").groupBy("group").agg(F.array_sort(F.collect_set(layer)).alias("layers"))


def containment(layers: DataFrame) -> DataFrame:
    """One row: groups inside one layer, groups across, and the share inside."""
    inside = F.count(F.when(F.size("layers") == 1, 1))
    return layers.where(F.size("layers") > 0).agg(inside.alias("inside"), (F.count("*") - inside).alias("across")).withColumn("ratio", ratio("inside", F.col("inside") + F.col("across")))


def crossings(layers: DataFrame) -> DataFrame:
    """Every combination of layers that groups cross, how often, and its share of all crossings."""
    each = layers.where(F.size("layers") > 1).groupBy(F.array_join("layers", " + ").alias("crossing")).agg(F.count("*").alias("n"))
    return each.withColumn("share", ratio("n", F.sum("n").over(Window.partitionBy())))


def concentration(rows: DataFrame, item: str, actor: str, min_edits: int = DEFAULTS.knowledge_risk_min_edits, share: float = DEFAULTS.knowledge_risk_share) -> DataFrame:
    """Items with at least min_edits of which one actor has more than `share`: item, edits, owner, owner_share, actors.

    Counts per (item, actor) combine first; the owner is the largest of (count, then smallest name).
    """
    counts = rows.where(F.col(item).isNotNull() & F.col(actor).isNotNull()).groupBy(F.col(item).alias("item"), F.col(actor).alias("actor")).agg(F.count("*").alias("n"))
    ranked = counts.groupBy("item").agg(F.sum("n").alias("edits"), F.max("n").alias("most"), F.count("*").alias("actors"))
    owners = counts.join(ranked, "item").where("n = most").groupBy("item", "edits", "most", "actors").agg(F.min("actor").alias("owner"))
    return owners.withColumn("owner_share", ratio("most", "edits")).where((F.col("edits") >= min_edits) & (F.col("owner_share") > share)).select("item", "edits", "owner", "owner_share", "actors")


def touch_cost(widths: DataFrame, width: str, layer: str | None = None, q: float = 0.9) -> DataFrame:
    """groups, median and floor quantile of a width, of all rows (layer null) and of each layer.

    Counts per distinct width are taken first, so an exact quantile needs one row per width, not per group.
    """
    keys = [F.col(layer).alias("layer")] if layer else []
    by = widths.where(F.col(width).isNotNull()).groupBy(*keys, F.col(width).alias("w")).agg(F.count("*").alias("n"))
    sets = by.withColumn("layer", F.lit(None).cast("string")).select("layer", "w", "n")
    if layer:
        sets = by.select(F.col("layer").cast("string").alias("layer"), "w", "n").unionByName(sets.groupBy("layer", "w").agg(F.sum("n").alias("n")))
    run = Window.partitionBy("layer").orderBy("w")
    at = sets.withColumn("upto", F.sum("n").over(run)).withColumn("total", F.sum("n").over(Window.partitionBy("layer")))
    first = lambda place: F.min(F.when(F.col("upto") > place, F.col("w")))
    low, high = first(F.floor((F.col("total") - 1) / 2)), first(F.floor(F.col("total") / 2))
    quantile = first(F.least(F.col("total") - 1, F.floor(F.lit(q) * F.col("total"))))
    return at.groupBy("layer").agg(F.max("total").alias("groups"), ((low + high) / 2).alias("median_width"), quantile.alias("quantile_width"))


def quantile_of(rows: DataFrame, value: str, q: float, *by: str) -> DataFrame:
    """floor_quantile per key for groups known to be small."""
    return rows.groupBy(*by).agg(floor_quantile(F.collect_list(value), q).alias("quantile"))
