"""What one finding needs to be judged: the rows of each relation that concern its files, within a budget of bytes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.functions.columns import layer_of, source_files
from heddle.functions.params import DEFAULTS

DEPTHS = (1, 2, 3)


def finding_files(findings: DataFrame) -> DataFrame:
    """(id, place, file): the files that a finding's source names, in order; findings: (id, source)."""
    return findings.select("id", F.posexplode(source_files("source")).alias("place", "file"))


def rows_of(files: DataFrame, rows: DataFrame, relation: str) -> DataFrame:
    """(id, relation, place, row): rows (file, ...) of a finding's files as JSON, in the files' order."""
    each = rows.select("file", F.to_json(F.struct(*rows.columns)).alias("row")).groupBy("file").agg(F.max("row").alias("row"))
    return files.join(each, "file").select("id", F.lit(relation).alias("relation"), "place", "row")


def pairs_of(files: DataFrame, pairs: DataFrame) -> DataFrame:
    """(id, relation, place, row): pairs (a, b, shared, degree) of which either end is a finding's file, strongest first."""
    own = files.select("id", "file").distinct()
    ends = own.join(pairs, own["file"] == pairs["a"]).select("id", "a", "b", "shared", "degree").unionByName(own.join(pairs, own["file"] == pairs["b"]).select("id", "a", "b", "shared", "degree")).distinct()
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("degree"), F.desc("shared"), "a", "b")) - 1
    return ends.select("id", F.lit("temporal_coupling").alias("relation"), place.alias("place"), F.to_json(F.struct("a", "b", "shared", "degree")).alias("row"))


def neighbours_of(files: DataFrame, edges: DataFrame, edits: DataFrame) -> DataFrame:
    """(id, relation, place, row): files one edge (src, dst) away from a finding's, most edited first; edits: (file, edits)."""
    own = files.select("id", "file").distinct()
    out = own.join(edges, own["file"] == edges["src"]).select("id", F.col("dst").alias("node")).unionByName(own.join(edges, own["file"] == edges["dst"]).select("id", F.col("src").alias("node"))).distinct()
    out = out.join(own.withColumnRenamed("file", "node"), ["id", "node"], "left_anti").join(edits.withColumnRenamed("file", "node"), "node", "left")
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.coalesce("edits", F.lit(0)).desc(), "node")) - 1
    return out.select("id", F.lit("neighbors").alias("relation"), place.alias("place"), F.to_json(F.struct("node")).alias("row"))


def crossings_of(files: DataFrame, crossings: DataFrame, roots: tuple[str, ...] = ()) -> DataFrame:
    """(id, relation, place, row): crossings (crossing, n) that touch a layer of a finding's files, at any of DEPTHS."""
    layers = files.select("id", F.explode(F.array(*[layer_of("file", roots, d) for d in DEPTHS])).alias("layer")).distinct()
    each = crossings.select("crossing", "n", F.explode(F.split("crossing", r" \+ ")).alias("layer"))
    hit = layers.join(each, "layer").select("id", "crossing", "n").distinct()
    place = F.row_number().over(Window.partitionBy("id").orderBy(F.desc("n"), "crossing")) - 1
    return hit.select("id", F.lit("top_crossings").alias("relation"), place.alias("place"), F.to_json(F.struct("crossing", "n")).alias("row"))


def fitted(parts: DataFrame, order: tuple[str, ...], budget: int = DEFAULTS.slice_budget_bytes) -> DataFrame:
    """(id, relation, place, row, dropped): rows as long as their bytes fit; relations late in `order` are cut first, from their tails.

    dropped counts the rows of the same relation that didn't fit.
    """
    rank = F.array_position(F.array(*[F.lit(o) for o in order]), F.col("relation"))
    run = Window.partitionBy("id").orderBy(rank, "place", "row").rowsBetween(Window.unboundedPreceding, 0)
    upto = parts.withColumn("upto", F.sum(F.octet_length("row") + 2).over(run))
    counted = upto.withColumn("dropped", F.count(F.when(F.col("upto") > budget, 1)).over(Window.partitionBy("id", "relation")))
    return counted.where(F.col("upto") <= budget).drop("upto")


def removed(items: DataFrame, refutations: DataFrame) -> DataFrame:
    """(id, title, reason): findings that a lens dropped, a trial rejected or payback stopped; items: (id, title, status, trial_reasons, payback)."""
    title = items.select("id", "title")
    lens = refutations.where("verdict = 'dropped'").select(F.col("finding_id").alias("id"), F.concat_ws(": ", F.coalesce("lens", F.lit("-")), F.coalesce("reason", F.lit("-"))).alias("reason"))
    trial = items.where("status = 'rejected'").select("id", "title", F.coalesce(F.expr("nullif(array_join(trial_reasons, '; '), '')"), F.lit("-")).alias("reason"))
    stopped = items.where("coalesce(status, '') <> 'rejected' and payback in ('too_costly', 'cold')").select("id", "title", F.concat(F.lit("payback: "), "payback").alias("reason"))
    return title.join(lens, "id").select("id", "title", "reason").unionByName(trial).unionByName(stopped)


def report_gaps(checks: DataFrame, tools: DataFrame, reasons: DataFrame) -> DataFrame:
    """(text, path): what a report could not see; checks: (check, passed, blocks), tools: (name, available), reasons: (reason)."""
    failed = checks.where("not passed").select(F.col("check").alias("text"), F.lit("calibration.checks").alias("path"))
    blocked = checks.where("not passed").select(F.explode(F.split("blocks", ",")).alias("m")).distinct().select(F.concat(F.lit("blocked: "), "m").alias("text"), F.lit("calibration.blocked_metrics").alias("path"))
    missing = tools.where("not available").select(F.concat(F.lit("missing: "), "name").alias("text"), F.concat(F.lit("tools."), "name").alias("path"))
    return failed.unionByName(blocked).unionByName(missing).unionByName(reasons.select(F.col("reason").alias("text"), F.lit("confidence.reasons").alias("path"))).distinct()
