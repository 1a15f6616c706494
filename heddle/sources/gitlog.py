"""History text to tables. The text is what
`git log --name-only --no-merges --format=__C__%H%x1f%an%x1f%ct%x1f%s` prints."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

HEAD = "__C__"
SCHEMA = "sha string, author string, epoch long, subject string, files array<string>"


def parse_records(records: DataFrame, column: str = "value") -> DataFrame:
    """Commits from rows that each hold one record without its leading mark, such as read_history() makes. All native."""
    lines = F.split(F.regexp_replace(column, "\r", ""), "\n")
    head = F.split(lines[0], "\x1f", 4)
    part = lambda i: F.coalesce(F.try_element_at(head, F.lit(i + 1)), F.lit(""))
    files = F.filter(F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0))), lambda x: F.trim(x) != "")
    rows = records.where(F.trim(F.regexp_replace(column, "[\r\n]", "")) != "")
    return rows.select(part(0).alias("sha"), part(1).alias("author"), F.coalesce(part(2).try_cast("long"), F.lit(0)).alias("epoch"), part(3).alias("subject"), files.alias("files"))


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """Commits of log files. Records are cut at the reader, so a log of any length is split over tasks."""
    return parse_records(spark.read.text(path, lineSep=HEAD))


def commit_files(commits: DataFrame) -> DataFrame:
    """One row per commit and distinct file."""
    return commits.select("sha", "author", "epoch", "subject", F.explode(F.array_distinct("files")).alias("file"))


class GitHistory(DataSource):
    """spark.read.format("git_history").option("repo", ...).option("since", ...): a repository's commits."""

    @classmethod
    def name(cls):
        return "git_history"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return GitReader(self.options)


class GitReader(DataSourceReader):
    def __init__(self, options):
        self.repo, self.since, self.timeout = options["repo"], options.get("since"), int(options.get("timeout", "300"))

    def partitions(self):
        return [InputPartition(0)]

    def read(self, partition):
        command = ["git", "-C", self.repo, "log", "--name-only", "--no-merges", f"--format={HEAD}%H%x1f%an%x1f%ct%x1f%s", *([f"--since={self.since}"] if self.since else [])]
        out = subprocess.run(command, capture_output=True, timeout=self.timeout, check=True).stdout.decode("utf-8", "replace")
        for record in out.split(HEAD)[1:]:
            first, *files = record.replace("\r", "").split("\n")
            sha, author, epoch, subject = (first.split("\x1f", 3) + [""] * 3)[:4]
            yield sha, author, int(epoch) if epoch.isdigit() else 0, subject, [f for f in files if f.strip()]
