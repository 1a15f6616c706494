"""Dead-code candidates: who isn't used, who is mentioned anyway, and what the logs say."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.params import DEFAULTS
from heddle.operators.ranks import with_place
from heddle.operators.saving import maybe_broadcast, saved

VULTURE = r"^(.+?):(\d+): (unused|unreachable) ([\w ]+?)(?: '([^']+)')?(?: after '[^']+')? \((\d+)% confidence(?:, (\d+) lines?)?\)$"


def parse_report(lines: DataFrame, column: str = "value") -> DataFrame:
    """Rows (file, line, kind, name, confidence, size_lines) of a dead-code report's lines; other lines are left out."""
    part = lambda i: F.regexp_extract(column, VULTURE, i)
    rows = lines.where(F.col(column).rlike(VULTURE))
    return rows.select(part(1).alias("file"), part(2).cast("int").alias("line"), part(4).alias("kind"), part(5).alias("name"), part(6).cast("int").alias("confidence"), F.expr(f"try_cast(nullif(regexp_extract(`{column}`, '{_escaped(VULTURE)}', 7), '') as int)").alias("size_lines"))


def _escaped(pattern: str) -> str:
    return pattern.replace("\\", "\\\\").replace("'", "\\'")


def orphans(nodes: DataFrame, edges: DataFrame, *excluded: DataFrame) -> DataFrame:
    """nodes (node) that nothing points to, without those of each excluded table (node)."""
    left = nodes.join(edges.select(F.col("dst").alias("node")).distinct(), "node", "left_anti")
    for other in excluded:
        left = left.join(other.select("node").distinct(), "node", "left_anti")
    return left


def mentions(names: DataFrame, texts: DataFrame, key: str, text: str) -> DataFrame:
    """(name, texts): in how many texts a candidate's name occurs as a word, 0 included.

    The corpus is split once, and only words that are names go on to be counted.
    """
    wanted = saved(names.select("name").distinct())
    words = texts.select(F.col(key).alias("key"), F.explode(F.array_distinct(F.regexp_extract_all(F.col(text), F.lit(r"\w+"), F.lit(0)))).alias("name"))
    counts = words.join(maybe_broadcast(wanted, wanted.count()), "name", "left_semi").distinct().groupBy("name").agg(F.count("key").alias("texts"))
    return wanted.join(counts, "name", "left").select("name", F.coalesce("texts", F.lit(0)).alias("texts"))


def statuses(candidates: DataFrame, blind: DataFrame) -> DataFrame:
    """candidates (file, line, name, instrumentable) with id P1.. and status; blind: (name, reason)."""
    reasons = blind.groupBy("name").agg(F.array_sort(F.collect_set("reason")).alias("blind_spots"))
    each = candidates.join(reasons, "name", "left").withColumn("blind_spots", F.coalesce("blind_spots", F.expr("cast(array() as array<string>)")))
    status = F.when(F.size("blind_spots") == 0, "provable").when(F.col("instrumentable"), "suspected").otherwise("manual")
    placed = with_place(each.withColumn("status", status), "__place", "file", "line", "name", "kind" if "kind" in each.columns else "status")
    return placed.withColumn("id", F.concat(F.lit("P"), "__place")).drop("__place")


def marker_counts(logs: DataFrame, column: str, pattern: str) -> DataFrame:
    """(id, hits): occurrences of pattern's first group over all lines."""
    found = logs.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(1))).alias("id"))
    return found.groupBy("id").agg(F.count("*").alias("hits"))


def marker_totals(logs: DataFrame, column: str, marker: str, *by: str) -> DataFrame:
    """Occurrences of a literal marker, and texts that have it."""
    n = (F.length(column) - F.length(F.replace(F.col(column), F.lit(marker), F.lit("")))) / len(marker)
    return logs.groupBy(*by).agg(F.coalesce(F.sum(n.cast("long")), F.lit(0)).alias("hits"), F.count(F.when(F.col(column).contains(marker), 1)).alias("texts"))


def observed(candidates: DataFrame, hits: DataFrame, control: int, least: int = DEFAULTS.prune_min_control) -> DataFrame:
    """Candidates (id, status) after a log: instrumented ones are alive if hit, never_fired if not while the control fired often enough."""
    each = candidates.join(hits, "id", "left").withColumn("hits", F.coalesce("hits", F.lit(0)))
    quiet = F.lit("never_fired" if control >= least else "instrumented")
    return each.withColumn("status", F.when(F.col("status") != "instrumented", F.col("status")).when(F.col("hits") > 0, "alive").otherwise(quiet))


def status_counts(candidates: DataFrame) -> DataFrame:
    return candidates.groupBy("status").agg(F.count("*").alias("n"))


def line_ages(blame: DataFrame, now: int) -> DataFrame:
    """blame (file, line, ts) with whole days since the line was touched."""
    return blame.withColumn("days", F.floor((F.lit(now) - F.col("ts")) / 86_400))
