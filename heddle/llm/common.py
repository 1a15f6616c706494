"""What the operators of this subpackage share: tables, the shared folder, samples."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from heddle.operators import graph

#: Rows up to which a side may be broadcast; it is counted first, and beyond it the join shuffles.
BROADCAST_ROWS = 1_000_000
#: Whole texts that travel to Python at a time, at most.
ARROW_ROWS = 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_root(spark: SparkSession) -> str:
    """The folder that the driver and all executors see, as the cluster names it.

    Only on a single machine, as in tests, a temporary one is set where none is named; a cluster has to name one.
    """
    root, held = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext._jsc.sc().getCheckpointDir()
    if not root and held.isDefined():
        root = held.get()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        root = "file://" + tempfile.mkdtemp(prefix="heddle-")
    if not held.isDefined():
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder below shared_root(); only its writer knows the name."""
    return f"{shared_root(spark)}/heddle-{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ARROW_ROWS rows from now on.

    A batch is held by the JVM outside its heap, with room to grow, and by Python, in every task of an executor at once.
    """
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= ARROW_ROWS:
        spark.conf.set(key, str(ARROW_ROWS))


def saved(df: DataFrame) -> DataFrame:
    """df, computed once and kept in the shared folder, so that a lost executor costs nothing.

    The files go when the result is no longer referenced (cleanCheckpoints).
    """
    shared_root(df.sparkSession)
    small_batches(df.sparkSession)
    return graph.saved(df)


def maybe_broadcast(df: DataFrame, rows: int, limit: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if its counted rows are within limit; otherwise as it is."""
    return F.broadcast(df) if rows <= limit else df


def crc_mod(doc_id: Column, n: int) -> Column:
    """crc32 of the identifier's decimal text, modulo n (null for a null identifier)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % F.lit(n)


def per_class_sample(df: DataFrame, key: str, label: str, per_class: int) -> DataFrame:
    """About per_class rows of each label value, chosen by a hash of the key.

    A labelled set of at most per_class rows is taken whole. The count of a label is a partial
    aggregate; the number of label values is a property of the labels, not of the corpus.
    """
    counts = {r[label]: r["count"] for r in df.where(F.col(label).isNotNull()).groupBy(label).count().collect()}
    if not counts:
        return df.where(F.lit(False))
    share = F.create_map(*[F.lit(x) for k, n in counts.items() for x in (k, min(1.0, per_class / n))])
    draw = F.pmod(F.xxhash64(F.col(key), F.lit(7)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return df.where(F.col(label).isNotNull() & (draw < share[F.col(label)]))


def without(docs: DataFrame, id_col: str, gone: DataFrame) -> DataFrame:
    """docs without the rows whose identifier is in gone's only column; null identifiers stay."""
    name = fresh(docs, "__gone")
    ids = saved(gone.toDF(name).where(F.col(name).isNotNull()).distinct())
    return docs.join(maybe_broadcast(ids, ids.count()), docs[id_col] == ids[name], "left_anti")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that df doesn't have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def numbered(docs: DataFrame, name: str) -> DataFrame:
    """docs with a struct column that tells its rows apart, the same however often it is computed.

    Rows of a file are told by the file and their place in it, so nothing has to be written. Of any other table a
    copy is saved, as its rows could come in another order when a lost executor's part is computed again.
    """
    if "_metadata" not in {c.lower() for c in docs.columns}:
        node = docs._jdf.queryExecution().analyzed()
        while node.nodeName() in ("Project", "Filter", "SubqueryAlias"):
            node = node.children().head()
        if node.nodeName().startswith("LogicalRelation"):
            try:
                file = F.col("_metadata.file_path")
                return docs.select("*", F.struct(F.xxhash64(file).alias("f"), F.xxhash64(file, F.lit(1)).alias("g"), F.col("_metadata.row_index").alias("i")).alias(name))
            except AnalysisException:
                pass  # a format whose rows have no place
    zero = F.lit(0).cast("long")
    return saved(docs.select("*", F.struct(zero.alias("f"), zero.alias("g"), F.monotonically_increasing_id().alias("i")).alias(name)))


def without_rows(docs: DataFrame, name: str, gone: DataFrame) -> DataFrame:
    """numbered() docs without the rows in gone's only column, and without that number."""
    rows = saved(gone.toDF("__gone"))
    return docs.join(maybe_broadcast(rows, 3 * rows.count()), docs[name] == rows["__gone"], "left_anti").drop(name)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder that this application wrote."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
