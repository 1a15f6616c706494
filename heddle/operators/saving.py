"""Tables that are used more than once, kept in the folder that all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

#: Rows up to which a side may be broadcast; it is counted first, and beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000


def saved(df: DataFrame) -> DataFrame:
    """df, computed once, in the folder that the cluster names in spark.checkpoint.dir; a temporary one on a single machine that names none.

    A checkpoint keeps the size that the optimizer once guessed, and joins multiply guesses, so in a loop they grow to numbers that
    take minutes to multiply; the result is a table of unknown size instead.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        root = spark.conf.get("spark.checkpoint.dir", None)
        if not root and not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        context.setCheckpointDir(root or "file://" + tempfile.mkdtemp(prefix="heddle-"))
    kept = df.checkpoint(eager=True)._jdf
    return DataFrame(spark._jsparkSession.internalCreateDataFrame(kept.queryExecution().toRdd(), kept.schema(), False), spark)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows are within limit; otherwise as it is."""
    return df.hint("broadcast") if rows <= limit else df


def pieces(df: DataFrame, mb: float = 4) -> int:
    """Partitions for a shuffle of df's rows: one for each `mb` that the files it reads have on disk, so that tasks don't grow with the input.

    The session's number of partitions where some table isn't read from files.
    """
    sizes = []
    leaves = df._jdf.queryExecution().analyzed().collectLeaves()
    for i in range(leaves.size()):
        sizes.append(int(str(leaves.apply(i).stats().sizeInBytes())))
    if sum(sizes) >= 1 << 62:
        return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return min(20_000, max(1, -int(-sum(sizes) // (mb * 1e6))))


def release(spark) -> None:
    """Lets Spark's cleaner delete the shuffle files and saved tables that nothing refers to any more.

    By itself it only acts when the driver happens to collect its garbage, and a chain of joins has filled disks by then.
    """
    spark._jvm.System.gc()
