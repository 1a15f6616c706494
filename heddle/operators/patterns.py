"""Where two views of a system disagree. Each pattern is a join of metric tables; what people intend comes
as tables too: declared layer rules (src_layer, dst_layer, allowed), documented modules, removed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.functions.columns import basename
from heddle.operators.graph import with_edge, without_edge

BARREL_NAMES = ("__init__.py", "index.js", "index.ts", "index.tsx", "mod.rs")


def available(history: DataFrame, least: int) -> DataFrame:
    """One row: commits, whether they are enough for the history's metrics, and the reason if not."""
    n = history.agg(F.countDistinct("sha").alias("commits"))
    return n.select("commits", (F.col("commits") >= least).alias("available"), F.when(F.col("commits") < least, F.concat(F.lit("only "), F.col("commits"), F.lit(f" of {least} commits"))).alias("reason"))


def barrels(files: DataFrame, edges: DataFrame, names=BARREL_NAMES) -> DataFrame:
    """(node): files with a barrel's name and an edge of their own."""
    return files.where(basename("file").isin(*names)).select(F.col("file").alias("node")).join(edges.select(F.col("src").alias("node")).distinct(), "node", "left_semi")


def _layered(pairs: DataFrame, layers: DataFrame) -> DataFrame:
    a, b = layers.select(F.col("node").alias("a"), F.col("layer").alias("layer_a")), layers.select(F.col("node").alias("b"), F.col("layer").alias("layer_b"))
    return pairs.join(a, "a").join(b, "b")


def _ruled(pairs: DataFrame, declared: DataFrame, allowed: bool) -> DataFrame:
    """Pairs in layers that a declared rule covers, in either direction."""
    rules = declared.where(F.col("allowed") == allowed).select("src_layer", "dst_layer")
    rules = rules.unionByName(rules.select(F.col("dst_layer").alias("src_layer"), F.col("src_layer").alias("dst_layer"))).distinct()
    return pairs.join(rules, (F.col("layer_a") == F.col("src_layer")) & (F.col("layer_b") == F.col("dst_layer")), "left_semi")


def nominal_seams(pairs: DataFrame, layers: DataFrame, declared: DataFrame, cycles: DataFrame, degree: float) -> DataFrame:
    """Pairs (a, b, degree) that a declared boundary separates, in no common cycle, and yet change together."""
    across = _ruled(_layered(pairs.where(F.col("degree") >= degree), layers).where("layer_a <> layer_b"), declared, False)
    both = cycles.select(F.col("node").alias("a"), "cycle").join(cycles.select(F.col("node").alias("b"), "cycle"), "cycle").select("a", "b")
    return across.join(both, ["a", "b"], "left_anti").select("a", "b", "degree")


def perimeter_holes(pairs: DataFrame, layers: DataFrame, declared: DataFrame, edges: DataFrame) -> DataFrame:
    """Coupled pairs without an edge where the edge is forbidden, too."""
    return without_edge(_ruled(_layered(pairs, layers), declared, False), edges).select("a", "b", "degree")


def hidden_links(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    return without_edge(pairs, edges)


def visible_links(pairs: DataFrame, edges: DataFrame) -> DataFrame:
    return with_edge(pairs, edges)


def dead_links(cycles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Pairs a < b of one cycle that don't change together."""
    inside = cycles.select(F.col("node").alias("a"), "cycle").join(cycles.select(F.col("node").alias("b"), "cycle"), "cycle").where("a < b").select("a", "b")
    return inside.join(pairs.select("a", "b"), ["a", "b"], "left_anti")


def phantoms(documented: DataFrame, files: DataFrame) -> DataFrame:
    """(node) that documents name and that isn't there."""
    return documented.select("node").distinct().join(files.select("node"), "node", "left_anti")


def intent_drift(removed: DataFrame, edges: DataFrame, hot: DataFrame) -> DataFrame:
    """Edges said to be removed that are there, and lead to a hot node."""
    return edges.join(removed.select("src", "dst"), ["src", "dst"], "left_semi").join(hot.select(F.col("node").alias("dst")), "dst", "left_semi").select("src", "dst")


def blind_spots(nodes: DataFrame, edits: DataFrame, least: int) -> DataFrame:
    """(node, edits) of nodes with too little history to be judged by it; edits: (node, edits)."""
    return nodes.select("node").distinct().join(edits, "node", "left").select("node", F.coalesce("edits", F.lit(0)).alias("edits")).where(F.col("edits") < least)


def r1_complexity(cyclomatic: Column | str, nesting: Column | str) -> Column:
    """red over 20 branches or 5 levels, yellow over 10 or 3."""
    c, n = (F.col(x) if isinstance(x, str) else x for x in (cyclomatic, nesting))
    return F.when((c > 20) | (n > 5), "red").when((c > 10) | (n > 3), "yellow").otherwise("green")


def r2_coupling(degree: Column | str, containment: Column | str) -> Column:
    d, c = (F.col(x) if isinstance(x, str) else x for x in (degree, containment))
    return F.when((d > 0.7) | (c < 0.5), "red").when((d >= 0.45) | (c <= 0.75), "yellow").otherwise("green")


def r3_copies(shared: Column | str) -> Column:
    s = F.col(shared) if isinstance(shared, str) else shared
    return F.when(s >= 10, "red").when(s >= 5, "yellow").otherwise("green")


def r5_structure(in_cycle: Column | str, fan_out: Column | str) -> Column:
    i, f = (F.col(x) if isinstance(x, str) else x for x in (in_cycle, fan_out))
    return F.when(F.coalesce(i, F.lit(False)) | (f > 7), "red").when(f >= 4, "yellow").otherwise("green")


def r6_owner(share: Column | str) -> Column:
    s = F.col(share) if isinstance(share, str) else share
    return F.when(s > 0.85, "red").when(s >= 0.6, "yellow").otherwise("green")


def read_levels(covered: DataFrame, lines: DataFrame) -> DataFrame:
    """(file, share): lines read of each file, under 0.3 counting as none; covered: (file, covered), lines: (file, lines)."""
    share = F.coalesce(F.col("covered"), F.lit(0)) / F.col("lines")
    return lines.where("lines > 0").join(covered, "file", "left").select("file", F.when(share < 0.3, 0.0).otherwise(F.least(F.lit(1.0), share)).alias("share"))
