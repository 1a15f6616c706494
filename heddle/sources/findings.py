"""Where findings come from and go to: CSV with all columns as text, JSON documents, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.functions.documents import schema_problems
from heddle.operators.ledger import rejected_rows, with_refutations

FIELDS = (
    "id", "risk", "title", "axes", "source", "priority", "pain", "spread", "ceiling", "confidence", "status", "owner", "remedy", "remedy_cost", "gain_metric", "gain_before", "gain_target", "gain_direction",
    "gain_actual", "gain_verdict", "opened", "closed", "depends_on", "blind_spots", "note",
)
REQUIRED = ("id", "risk", "title", "source")


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, schema=", ".join(f"{f} string" for f in FIELDS), header=True, multiLine=True, escape='"')


def write_csv(findings: DataFrame, path: str) -> None:
    """Overwrites path; columns in their fixed order, others left out, missing ones empty."""
    known = set(findings.columns)
    findings.select(*[F.col(f).cast("string") if f in known else F.lit(None).cast("string").alias(f) for f in FIELDS]).write.mode("overwrite").csv(path, header=True, escape='"')


def append_csv(findings: DataFrame, path: str, enums: dict[str, tuple[str, ...]] | None = None) -> None:
    """Appends findings; ValueError with the problems if an id repeats, a required field is blank or a value isn't allowed."""
    spark = findings.sparkSession
    known = read_csv(spark, path) if _exists(spark, path) else spark.createDataFrame([], ", ".join(f"{f} string" for f in FIELDS))
    problems = rejected_rows(findings, known, enums or {})
    for f in REQUIRED:
        problems = problems.unionByName(findings.where(F.trim(F.coalesce(F.col(f).cast("string"), F.lit(""))) == "").select("id", F.lit(f"blank {f}").alias("problem")))
    if found := problems.limit(20).collect():
        raise ValueError("; ".join(f"{r['id']}: {r['problem']}" for r in found))
    have = set(findings.columns)
    findings.select(*[F.col(f).cast("string") if f in have else F.lit(None).cast("string").alias(f) for f in FIELDS]).write.mode("append").csv(path, header=True, escape='"')


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def document(findings: DataFrame, refutations: DataFrame) -> DataFrame:
    """One nested row per finding: sources and axes as lists, files of the sources, refutations."""
    split = lambda c, by: F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), by), lambda x: F.trim(x)), lambda x: x != "")
    each = with_refutations(findings, refutations)
    return each.select("id", "risk", "title", "priority", "ceiling", split("axes", ",").alias("axes"), split("source", ";").alias("source"), F.array_sort(F.array_distinct(F.regexp_extract_all("source", F.lit(r"\[file=([^\]]+)\]"), F.lit(1)))).alias("files"), "refutations")


def export(nested: DataFrame, problems: DataFrame, schema: dict | None, path: str) -> None:
    """Writes document() as JSON lines; refuses while the self-check has problems or a row breaks the schema."""
    if found := problems.limit(20).collect():
        raise ValueError("; ".join(f"{r['id']}: {r['problem']}" for r in found))
    if schema:
        for row in nested.toJSON().toLocalIterator():
            if bad := schema_problems(json.loads(row), schema):
                raise ValueError("; ".join(bad))
    nested.write.mode("overwrite").json(path)


def markdown(rows: DataFrame, title: str, most: int = 200) -> str:
    """A small result as a table; says how many rows are left out."""
    found, total = rows.limit(most).collect(), rows.count()
    text = lambda v: "" if v is None else str(v).replace("\\", "\\\\").replace("|", "\\|").replace("\n", " ")
    lines = [f"## {title}", "", "| " + " | ".join(rows.columns) + " |", "|" + "-|" * len(rows.columns), *("| " + " | ".join(text(v) for v in r) + " |" for r in found)]
    return "\n".join(lines + ([f"\n{total - len(found)} more rows"] if total > len(found) else [])) + "\n"
