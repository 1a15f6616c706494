"""Copied passages: windows of tokens that two owners share."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from heddle.functions.params import DEFAULTS
from heddle.operators.graph import weak_components
from heddle.operators.saving import pieces

#: Windows that a task packs, or compares, at a time, and pairs that it makes at a time.
AT_ONCE, PAIRS_AT_ONCE = 2_000_000, 4_000_000


def windows(tokens: DataFrame, owner: str, array: str, window: int = DEFAULTS.clone_window) -> DataFrame:
    """(owner, w, window): the hashes of the tokens of every row with a run of `window` tokens. Runs are hashed where they are dealt."""
    long = tokens.where(F.size(array) >= window)
    return long.select(F.col(owner).alias("owner"), F.transform(array, lambda x: F.xxhash64(x)).alias("w"), F.lit(window).alias("window"))


def run_hashes(words: np.ndarray, window: int) -> np.ndarray:
    """64-bit hashes of every run of `window` words."""
    n = len(words) - window + 1
    out = np.zeros(n, np.uint64)
    for i in range(window):
        out ^= words[i : i + n]
        out *= np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xD6E8FEB86659FD93)
    return out


def _owner_codes(owners: list[pa.Array]) -> tuple[pa.Array, np.ndarray]:
    """The distinct owners in order of first appearance, an unknown one among them, and each owner's place."""
    found = pa.concat_arrays(owners).dictionary_encode(null_encoding="encode")
    return found.dictionary, found.indices.to_numpy(zero_copy_only=False)


def _changes(*keys: np.ndarray) -> np.ndarray:
    """Where an element differs from the one before, the first included."""
    out = np.ones(len(keys[0]), bool)
    out[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    return out


def _pack(h: list[np.ndarray], rows: list[np.ndarray], owners: list[pa.Array], bits: int, most: int) -> Iterator[pa.RecordBatch]:
    names, codes = _owner_codes(owners)
    h, code = np.concatenate(h), codes[np.concatenate(rows)]
    order = np.argsort(h, kind="stable") if len(names) == len(codes) else np.lexsort((code, h))
    h, code = h[order], code[order]
    kept = _changes(h, code)
    h, code = h[kept], code[kept]
    first = np.flatnonzero(_changes(h))
    kept = np.arange(len(h)) - np.repeat(first, np.diff(first, append=len(h))) <= most  # one more shows that there are too many
    h, code = h[kept], code[kept]
    place = (h >> np.uint64(64 - bits)).astype(np.int32)
    first = np.flatnonzero(_changes(place))
    ends = np.append(first, len(h)).astype(np.int32)
    for at in range(0, len(first), 1000):
        e = ends[at : at + 1001]
        own = slice(e[0], e[-1])
        lists = [pa.ListArray.from_arrays(e - e[0], v) for v in (pa.array(h[own].view(np.int64)), names.take(pa.array(code[own])))]
        yield pa.RecordBatch.from_arrays([pa.array(place[first[at : at + 1000]]), *lists], ["bucket", "h", "owner"])


def _packed(batches: Iterator[pa.RecordBatch], bits: int, most: int) -> Iterator[pa.RecordBatch]:
    """Every row's windows, by ranges of the hash; of a window's owners no more than show that they are too many."""
    h, rows, owners, n, seen = [], [], [], 0, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        w, window = batch["w"], batch["window"][0].as_py()
        sizes, words = pc.list_value_length(w).to_numpy(zero_copy_only=False), w.flatten().to_numpy(zero_copy_only=False).view(np.uint64)
        within = np.ones(len(words), bool)
        within[(np.cumsum(sizes)[:, None] - np.arange(1, window)).ravel()] = False  # runs that reach into the next row
        h.append(run_hashes(words, window)[within[: len(words) - window + 1]])
        rows.append(np.repeat(np.arange(seen, seen + len(sizes)), sizes - window + 1))
        owners.append(batch["owner"])
        n, seen = n + len(h[-1]), seen + len(sizes)
        if n >= AT_ONCE:
            yield from _pack(h, rows, owners, bits, most)
            h, rows, owners, n, seen = [], [], [], 0, 0
    if n:
        yield from _pack(h, rows, owners, bits, most)


def _whole_buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Of rows in order of their buckets: tables that no bucket is cut by, as large as needed to hold AT_ONCE windows."""
    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        n += len(batch["h"].flatten())
        if n >= AT_ONCE and held[0]["bucket"][0] != batch["bucket"][-1]:
            table = pa.Table.from_batches(held)
            buckets = table["bucket"].to_numpy()
            cut = int(np.searchsorted(buckets, buckets[-1]))
            yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
            n = sum(len(b["h"].flatten()) for b in held)
    if held:
        yield pa.Table.from_batches(held)


def _owned(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """The owners in order; windows with two owners or more, sorted with the owner's place; and each one's number of owners."""
    names, code = _owner_codes([c.flatten() for c in table["owner"].chunks])
    order = pc.array_sort_indices(names)
    rank = np.empty(len(names), np.int64)
    rank[order.to_numpy()] = np.arange(len(names))
    h = np.concatenate([c.flatten().to_numpy(zero_copy_only=False) for c in table["h"].chunks])
    order_h = np.argsort(h)
    same = ~_changes(h[order_h])
    several = order_h[same | np.append(same[1:], False)]
    h, code = h[several], rank[code[several]]
    order_h = np.lexsort((code, h))
    h, code = h[order_h], code[order_h]
    kept = _changes(h, code)
    h, code = h[kept], code[kept]
    first = np.flatnonzero(_changes(h))
    return names.take(order), h, code, np.repeat(np.diff(first, append=len(h)), np.diff(first, append=len(h)))


def _pairs(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for table in _whole_buckets(batches):
        names, h, code, owners = _owned(table)
        known = len(names) - names.null_count  # an unknown owner comes last; it counts as one but is in no pair
        few = (owners <= most) & (code < known)
        h, code = h[few], code[few]
        first = np.flatnonzero(_changes(h))
        n = np.diff(first, append=len(h))
        after = np.repeat(first + n, n) - np.arange(len(h)) - 1  # owners of the same window that follow
        upto, at = np.cumsum(after), 0
        while at < len(h):
            to = max(at + 1, int(np.searchsorted(upto, (upto[at - 1] if at else 0) + PAIRS_AT_ONCE, "right")))
            n = after[at:to]
            a = np.repeat(np.arange(at, to), n)
            b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(n) - n, n)
            pairs, shared = np.unique(code[a] * known + code[b], return_counts=True)
            for i in range(0, len(pairs), 100_000):
                p = pairs[i : i + 100_000]
                yield pa.RecordBatch.from_arrays([names.take(pa.array(p // known)), names.take(pa.array(p % known)), pa.array(shared[i : i + 100_000])], ["a", "b", "shared"])
            at = to


def _skipped(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    for table in _whole_buckets(batches):
        _, h, _, owners = _owned(table)
        yield pa.RecordBatch.from_arrays([pa.array([int((_changes(h) & (owners > most)).sum())])], ["skipped"])


def dealt_windows(owned: DataFrame, most: int) -> DataFrame:
    """(bucket, h, owner): windows and their owners, in lists by ranges of the hash, every range in one task and in order.

    This is the only shuffle of all windows. A task that meets a window with more than `most` owners sends most + 1 of them,
    so one that everybody has is a few rows a task.
    """
    n = pieces(owned)
    bits = max(6, (8 * n - 1).bit_length())
    schema = f"bucket int, h array<bigint>, owner array<{owned.schema['owner'].dataType.simpleString()}>"
    return owned.mapInArrow(partial(_packed, bits=bits, most=most), schema).repartition(n, "bucket").sortWithinPartitions("bucket")


def skipped_windows(owned: DataFrame, most: int = DEFAULTS.clone_max_owners) -> DataFrame:
    """One row: how many windows were left out for having more owners."""
    each = dealt_windows(owned, most).mapInArrow(partial(_skipped, most=most), "skipped bigint")
    return each.agg(F.coalesce(F.sum("skipped"), F.lit(0).cast("long")).alias("skipped"))


def clone_pairs(owned: DataFrame, min_shared: int = DEFAULTS.clone_min_shared, most: int = DEFAULTS.clone_max_owners) -> DataFrame:
    """(a, b, shared): owners a < b that share at least min_shared windows of at most `most` owners. Pairs come from each window's short list of owners."""
    kind = owned.schema["owner"].dataType.simpleString()
    pairs = dealt_windows(owned, most).mapInArrow(partial(_pairs, most=most), f"a {kind}, b {kind}, shared bigint")
    return pairs.groupBy("a", "b").agg(F.sum("shared").alias("shared")).where(F.col("shared") >= min_shared)


def clone_groups(pairs: DataFrame) -> DataFrame:
    """(node, component, size): the connected owners."""
    each = weak_components(pairs.select("a", "b"))
    sizes = each.groupBy("component").agg(F.count("*").alias("size"))
    return each.join(sizes, "component").select("node", "component", "size")
