"""Best-fit packing planned on the histogram of lengths.

Documents are tokenised once; what is kept of a piece is its length, place and checksum. The
histogram has at most `capacity` rows, whatever the corpus, and best-fit decreasing runs over its
counts on the driver: longest pieces first, each length's pieces go to the open sequences that
they fill best, whole runs of equal sequences at a time. The plan is a list of slot intervals
(length, ranks from..., sequences from..., offset). Pieces then take the planned slots by their
rank among the pieces of their length.

The rank is found without gathering a length in one task: each length is dealt into salts of a
hundred pieces or more, ranked within, and shifted by the number of pieces in the salts before.

Cases: a null or empty text is one piece holding the end id alone; equal rows are packed each;
a null identifier is packed like any other. Only a document longer than `capacity` is cut. An
empty table gives no rows.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import saved
from heddle.llm.encoding import Encoder, tokenizer_path
from heddle.llm.files import arrow_rows

CAPACITY, END_ID = 2048, 0
#: Ranks in one task, at least, and tasks over all lengths, at most about (bounds the broadcast).
SALT_ROWS, SALTS = 100, 20_000


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) for every piece of every document."""

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def cut(batches):
        encoder, end = Encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows = []
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                for doc, raw in zip(part["doc_id"].to_pylist(), encoder.encode(part["text"].to_pylist()), strict=True):
                    raw += end
                    for piece, start in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[start : start + 4 * capacity]
                        rows.append((doc, piece, start // 4, len(own) // 4, zlib.crc32(own)))
            yield arrow_rows(rows, schema)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(cut, schema)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit decreasing over counts: intervals (length, first rank, count, first sequence, offset), and the number of sequences."""
    open_runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]  # by room left: (first sequence, count)
    slots, sequences = [], 0

    def fill(length: int, rank: int, left: int, first: int, count: int, room: int) -> int:
        """Put up to room // length pieces into each sequence of a run; returns the pieces placed."""
        each, placed = room // length, 0
        full, rest = min(count, left // each), 0
        if full < count:
            rest = left - full * each
        for start, n, k in ((first, full, each), (first + full, 1 if rest else 0, rest)):
            if n:
                for i in range(k):
                    slots.append((length, rank + placed, n, start, capacity - room + i * length))
                    placed += n
                open_runs[room - k * length].append((start, n))
        if (used := full + (1 if rest else 0)) < count:
            open_runs[room].append((first + used, count - used))
        return placed

    for length in sorted(histogram, reverse=True):
        left, rank, room = histogram[length], 0, length
        while left and room <= capacity:
            if not open_runs[room]:
                room += 1
                continue
            first, count = open_runs[room].pop()
            done = fill(length, rank, left, first, count, room)
            left, rank = left - done, rank + done
        if left:
            count = -(-left // (capacity // length))
            fill(length, rank, left, sequences, count, capacity)
            sequences += count
    return slots, sequences


def ranked(all_pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """all_pieces with rank, from 0, among those of equal length."""
    spark, total = all_pieces.sparkSession, sum(histogram.values())
    salts = spark.createDataFrame([(k, -(-n // max(SALT_ROWS, total // SALTS))) for k, n in histogram.items()], "length long, salts long")
    dealt = all_pieces.join(F.broadcast(salts), "length").withColumn("salt", F.pmod(F.xxhash64("doc_id", "piece"), F.col("salts")))
    local = dealt.withColumn("local", F.row_number().over(Window.partitionBy("length", "salt").orderBy("doc_id", "piece")) - 1)
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    shift = dealt.groupBy("length", "salt").agg(F.count("*").alias("n")).withColumn("shift", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # at most one row a salt: lengths + SALTS, whatever the corpus
    return local.join(F.broadcast(shift.drop("n")), ["length", "salt"]).withColumn("rank", F.col("local") + F.col("shift")).drop("local", "shift", "salt", "salts")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    all_pieces = saved(pieces(docs, id_col, text_col, tokenizer or tokenizer_path("word_bpe_49k.json"), capacity, end_id))
    histogram = {r["length"]: r["count"] for r in all_pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    if not histogram:
        return all_pieces.select("*", F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    slots, _ = plan(histogram, capacity)
    by_length: dict[int, np.ndarray] = {}
    for slot in sorted(slots):
        by_length.setdefault(slot[0], []).append(slot[1:])
    held = docs.sparkSession.sparkContext.broadcast({k: np.array(v, np.int64) for k, v in by_length.items()})

    def seat(batches):
        for batch in batches:
            lengths, ranks = batch["length"].to_numpy(), batch["rank"].to_numpy()
            sequence, offset = np.zeros(len(batch), np.int64), np.zeros(len(batch), np.int64)
            order = np.argsort(lengths, kind="stable")
            for at in np.split(order, np.flatnonzero(np.diff(lengths[order])) + 1):
                if len(at):
                    own, rank = held.value[int(lengths[at[0]])], ranks[at]
                    i = np.searchsorted(own[:, 0], rank, "right") - 1
                    sequence[at], offset[at] = own[i, 2] + rank - own[i, 0], own[i, 3]
            yield batch.drop_columns(["rank"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset))

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "rank"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return ranked(all_pieces, histogram).select(*columns).mapInArrow(seat, schema)
