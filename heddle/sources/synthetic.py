"""Histories made up from a plan, for tests and demonstrations."""

from __future__ import annotations

import subprocess

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400


def history(spark: SparkSession, plan: list[tuple[str, str, list[str]]], now: int, days: int = 280, ago: int = 300, filler: int = 64, gap_days: float | None = None) -> DataFrame:
    """Commits (sha, author, epoch, subject, files) of a plan of (author, subject, files), oldest first.

    A creation commit for every file goes before, commits to filler.py are added up to `filler` in all, and
    times are even over `days` from `ago` days before now, or gap_days apart.
    """
    files = sorted({f for _, _, fs in plan for f in fs})
    commits = [("maker", f"feat: add {f}", [f]) for f in files] + plan
    commits = [("maker", f"feat: filler {i}", ["filler.py"]) for i in range(max(0, filler - len(commits)))] + commits
    step = gap_days if gap_days is not None else days / max(1, len(commits) - 1)
    rows = [(i, a, s, fs, now - ago * DAY + int(i * step * DAY)) for i, (a, s, fs) in enumerate(commits)]
    df = spark.createDataFrame(rows, "n long, author string, subject string, files array<string>, epoch long")
    return df.select(F.sha1(F.concat_ws(":", F.col("n").cast("string"), "subject")).alias("sha"), "author", "epoch", "subject", "files")


def write_repository(path: str, commits: list[tuple[str, str, dict[str, str]]], start: int = 1_700_000_000, step: int = DAY) -> None:
    """A new git repository of commits (author, subject, {file: body}), `step` seconds apart, checked out."""
    out = []
    for i, (author, subject, files) in enumerate(commits):
        out.append(f"commit refs/heads/main\ncommitter {author} <{author}@example.org> {start + i * step} +0000\ndata {len(subject.encode())}\n{subject}\n")
        out += [f"M 644 inline {name}\ndata {len(body.encode())}\n{body}\n" for name, body in files.items()]
    subprocess.run(["git", "init", "-q", "-b", "main", path], check=True)
    subprocess.run(["git", "-C", path, "fast-import", "--quiet"], input="".join(out).encode(), check=True)
    subprocess.run(["git", "-C", path, "reset", "-q", "--hard"], check=True)
