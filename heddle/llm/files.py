"""Files that tasks write to and read from the folder that all executors share.

Every attempt of a task writes under a name of its own, and readers only know the names that
finished attempts returned; a lost or repeated attempt leaves a file that nobody reads.
"""

from __future__ import annotations

import uuid


def open_fs(folder: str):
    """(filesystem, path) of a folder given as a URI (file, hdfs, s3 ...) or a plain path."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder if "://" in folder or folder.startswith("file:") else f"file://{folder}")


def attempt_name(partition: int, suffix: str) -> str:
    return f"part-{partition:05d}-{uuid.uuid4().hex}{suffix}"


def partition_id() -> int:
    from pyspark import TaskContext

    task = TaskContext.get()
    return task.partitionId() if task else 0


_TYPES = {"long": "int64", "int": "int32", "string": "string", "boolean": "bool_", "double": "float64"}


def arrow_rows(rows: list[tuple], schema: str):
    """A record batch of rows, under a schema like "a long, b string"."""
    import pyarrow as pa

    fields = [x.split() for x in schema.split(",")]
    columns = list(zip(*rows, strict=True)) or [()] * len(fields)
    kinds = {k: getattr(pa, t)() for k, t in _TYPES.items()} | {"ints": pa.list_(pa.int32())}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[kind]) for c, (_, kind) in zip(columns, fields, strict=True)], [name for name, _ in fields])


def long_ids(decimal):
    """Identifiers that travelled as text (a nullable long would reach pandas as float and lose digits)."""
    import pandas as pd

    return pd.array([None if x is None or x != x else int(x) for x in decimal], "Int64")
