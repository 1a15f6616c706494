"""Batch operators that also make sense on a stream. Rows that come later than the watermark are dropped."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def live_sessions(stream: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """(key, first, last, events) of finished gap sessions; a gap of exactly `gap` still joins, as in operators.timelines.episodes."""
    return stream.withWatermark(at, late).groupBy(F.session_window(at, gap), key).agg(F.min(at).alias("first"), F.max(at).alias("last"), F.count("*").alias("events")).drop("session_window")


def live_marker_counts(lines: DataFrame, column: str, pattern: str) -> DataFrame:
    """(id, hits) so far of pattern's first group; for output mode complete or update."""
    return lines.select(F.explode(F.regexp_extract_all(F.col(column), F.lit(pattern), F.lit(1))).alias("id")).groupBy("id").agg(F.count("*").alias("hits"))
