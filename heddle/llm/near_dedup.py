"""Near-duplicate documents by a containment ensemble.

Two documents are linked if each contains at least SHARE of the other's five-word shingles, that is
if they share SHARE of the larger set; classes are the connected components of the links. (One
direction alone would chain a short text to every long one that quotes it, and those to each
other.)

Documents with equal shingle sets are one class from the start and go on as one node. The nodes are
partitioned by set size, bounds a factor SIZE_STEP apart. In a partition the containment
bound is turned into the smallest Jaccard similarity that a linked pair can have there, and the banding (rows,
bands) is tuned to that similarity by itself: the most rows for which a pair at the bound is
missed with probability MISS at most. A node is indexed in its own partition and looks into
the next one if a linked larger one could lie there. Whoever shares a band is a candidate.

All pairs of a band are never made. Candidates are compared exactly, on their full shingle sets, in three steps:

    1. every node with one other, the weightiest that it shares a band with. A node's weight is the number of nodes in
       its bands, so the weightiest of a family of copies is in its middle, near to most of the others;
    2. in bands with several components, every node outside the band's largest component with the weightiest member of
       that, of all its bands;
    3. what shares a band with another component still, by a prefix filter on rare shingles.

A band whose members are one component is done, as more links would change nothing; so a family of
thousands of copies costs a few comparisons a copy. Step 3 takes the nodes of all other bands, of any size, and only
their shingles that a node of another component has too. A node with fewer of those than SHARE of its
set can have no link left and goes (again and again while a pass leaves less than SHRINKS of the nodes, as each makes other shingles rarer). Of the rest, each
keeps the rarest size - needed + 1; two linked sets share one of these. That is exact: one common band suffices
to be compared, and what merely quotes a common passage is dropped before any pair is made.

Bands, links and labels are joined and aggregated in the cluster. A third of all rows in one band or one
class is combined before the shuffle or is the side that adaptive execution splits.

Cases: a null text counts as empty; all texts without a word are one class. A text of one to four
words has one shingle, all of its words. Rows are told apart by their place: of every class exactly one row is
kept, the one with the smallest identifier (null comes last), whatever identifiers repeat. A class's number is the
smallest identifier in it, null if it has none; texts that share an identifier without being similar are classes
with the same number, each with a kept row. An empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import fresh, maybe_broadcast, numbered, saved, without_rows
from heddle.operators.graph import weak_components
from heddle.operators.saving import release

WORDS, SHARE = 5, 0.8
HASHES, MISS, SIZE_STEP, SHRINKS, SEED = 448, 1.2e-3, 2.0, 0.9, 5
_ROW = "struct<f:bigint,g:bigint,i:bigint>"
#: Texts that are taken apart at a time.
SLICE = 100


@lru_cache
def _letters() -> np.ndarray:
    """For each code point a random odd number, 0 where the code point is part of no word."""
    odd = np.random.default_rng(SEED).integers(0, 1 << 63, 1 << 16, np.uint64) * np.uint64(2) + np.uint64(1)
    code = np.arange(0x110000, dtype=np.uint64)
    low, high = code & np.uint64(0xFFFF), code >> np.uint64(16)
    word = np.fromiter((c == 95 or chr(c).isalnum() for c in range(0x110000)), bool, 0x110000)  # what \w means
    return np.where(word, odd[low] + high * np.uint64(0xC2B2AE3D27D4EB4E), np.uint64(0))


@lru_cache
def _powers(bits: int) -> np.ndarray:
    return np.multiply.accumulate(np.concatenate([np.ones(1, np.uint64), np.full((1 << bits) - 1, 0x9FB21C651E98DF25, np.uint64)]))


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of lower-case texts, one after the other, and for each text the number of its words."""
    a = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    values = _letters()[a]
    at = np.flatnonzero(values)
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    first = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))  # of each word, among the letters
    place = np.arange(len(at)) - np.repeat(first, np.diff(np.append(first, len(at))))
    h = np.add.reduceat(values[at] * _powers(max(10, int(place.max()).bit_length()))[place], first)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    ends = np.cumsum([len(t) + 1 for t in texts])
    return h, np.diff(np.searchsorted(at[first], ends), prepend=0)


def shingle_sets(texts: list[str | None]) -> list[np.ndarray]:
    """For each whole text the ascending distinct 64-bit hashes of its shingles."""
    h, counts = word_hashes([(t or "").lower() for t in texts])
    room = np.where(counts > 0, np.maximum(counts, WORDS), 0)  # a text of fewer words is filled up with zeros
    starts = np.cumsum(room) - room
    w = np.zeros(int(room.sum()) + WORDS, np.uint64)
    w[np.arange(len(h)) + np.repeat(starts - (np.cumsum(counts) - counts), counts)] = h
    n = len(w) - WORDS + 1
    s = np.zeros(n, np.uint64)  # windows that reach into the next text are left out below
    for i in range(WORDS):
        s ^= w[i : i + n]
        s *= np.uint64(0x9E3779B97F4A7C15)
        s ^= s >> np.uint64(29)
    out = []
    for at, count in zip(starts.tolist(), room.tolist(), strict=True):
        own = s[at : at + max(0, count - WORDS + 1)]
        own.sort()
        out.append(own[np.concatenate([[True], own[1:] != own[:-1]])] if count else own)
    return out


@lru_cache
def _multipliers() -> np.ndarray:
    return np.random.default_rng(SEED).integers(0, 1 << 31, HASHES, np.uint32) * np.uint32(2) + np.uint32(1)


def signature(shingles: np.ndarray) -> np.ndarray:
    """MinHash values of a set."""
    x, a, out = (shingles >> np.uint64(32)).astype(np.uint32)[:, None], _multipliers()[None, :], None
    for at in range(0, len(x), 256):
        low = (x[at : at + 256] * a).min(axis=0)
        out = low if out is None else np.minimum(out, low)
    return out


def partition_of(size: int) -> int:
    return int(math.log(size) / math.log(SIZE_STEP) + 1e-9)


def bounds(part: int) -> tuple[int, int]:
    """Smallest size of a partition and of the one after."""
    return math.ceil(SIZE_STEP**part - 1e-9), math.ceil(SIZE_STEP ** (part + 1) - 1e-9)


@lru_cache(None)
def jaccard_bound(part: int, share: float = SHARE) -> float:
    """The least Jaccard similarity of a linked pair whose larger set is in the partition."""
    low, high = bounds(part)
    needed = [(x, math.ceil(share * x - 1e-9)) for x in range(low, min(high, low + 2_000))]
    return min(i / (2 * x - i) for x, i in needed)


@lru_cache(None)
def banding(part: int, share: float = SHARE) -> tuple[int, int]:
    """(bands, rows) of a partition; no bands where only equal sets can be linked."""
    j = jaccard_bound(part, share)
    if j >= 1:
        return 0, 0
    rows = max([r for r in range(1, HASHES + 1) if (1 - j**r) ** (HASHES // r) <= MISS], default=1)
    return HASHES // rows, rows


def bands(shingles: np.ndarray, share: float = SHARE) -> list[int]:
    """The band keys under which a set is indexed and looked up."""
    size = len(shingles)
    if not size:
        return []
    part, out, own = partition_of(size), [], None
    for p in [part] + [part + 1] * (int(size / share + 1e-9) >= bounds(part)[1]):
        count, rows = banding(p, share)
        if count:
            own = signature(shingles) if own is None else own
            keys = own[: count * rows].reshape(count, rows).astype(np.uint64)
            h = np.arange(count, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93) + np.uint64(p + 1)
            for i in range(rows):
                h = (h ^ keys[:, i]) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(32)
            out += h.view(np.int64).tolist()
    return out


def _sketch(share: float):
    import xxhash

    schema = f"row {_ROW}, id long, k1 long, k2 long, size int, bands array<long>"

    def sketch(batches):
        import pyarrow as pa

        for batch in batches:
            for at in range(0, len(batch), SLICE):
                part = batch.slice(at, SLICE)
                sets = shingle_sets(part["text"].to_pylist())
                key = np.array([(xxhash.xxh64_intdigest(s), xxhash.xxh64_intdigest(s, 1)) for s in sets], np.uint64).view(np.int64).reshape(-1, 2)
                yield pa.RecordBatch.from_arrays(
                    [part["row"], part["id"], pa.array(key[:, 0]), pa.array(key[:, 1]), pa.array([len(s) for s in sets], pa.int32()), pa.array([bands(s, share) for s in sets], pa.list_(pa.int64()))],
                    ["row", "id", "k1", "k2", "size", "bands"],
                )

    return sketch, schema


def _sets(batches):
    import pyarrow as pa

    for batch in batches:
        for at in range(0, len(batch), SLICE):
            part = batch.slice(at, SLICE)
            sets = [x.view(np.int64) for x in shingle_sets(part["text"].to_pylist())]
            yield pa.RecordBatch.from_arrays([part["node"], pa.array(sets, pa.list_(pa.int64()))], ["node", "s"])


def _hashed(df: DataFrame, rows: int) -> DataFrame:
    """df, unique in the key of a join, as its small side: broadcast if it may be, else hashed after a shuffle, so that the large side isn't sorted."""
    small = maybe_broadcast(df, rows)
    return df.hint("shuffle_hash") if small is df else small


def only_rows(rows: DataFrame, own: DataFrame) -> DataFrame:
    """The rows whose place is in own (row), found where they are read: own travels as a bit a place, 64 places of a file to a number."""
    block = [F.col("row.f").alias("f"), F.col("row.g").alias("g"), F.expr("shiftright(row.i, 6)").alias("block")]
    bits = saved(own.groupBy(*block).agg(F.expr("bit_or(shiftleft(1L, int(row.i & 63)))").alias("bits")))
    found = rows.select("*", *block).join(maybe_broadcast(bits, 2 * bits.count()), ["f", "g", "block"])
    return found.where("getbit(bits, int(row.i & 63)) = 1").select(*rows.columns)


def sets_of(rows: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, s): the shingle sets of the wanted (node), each read from its own row.

    If the wanted are too many for a broadcast, only their texts are shuffled, not all.
    """
    own = saved(nodes.select("node", "first").join(wanted, "node", "left_semi").select("node", F.col("first.row").alias("row")))
    small = maybe_broadcast(own, 4 * own.count())
    texts = only_rows(rows, own) if small is own else rows
    return saved(texts.join(small, "row").select("node", "text").mapInArrow(_sets, "node long, s array<long>"))


def _ordered(a: str, b: str) -> list[Column]:
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def _needed(size: Column | str, share: float) -> Column:
    return F.ceil(F.lit(share) * (F.col(size) if isinstance(size, str) else size) - F.lit(1e-9))


def linked(rows: DataFrame, nodes: DataFrame, pairs: DataFrame, share: float) -> DataFrame:
    """The pairs (a, b) of nodes whose sets share at least that part of the larger one."""
    for end in ("a", "b"):
        pairs = pairs.join(nodes.select(F.col("node").alias(end), F.col("size").alias(f"n{end}")), end)
    pairs = saved(pairs.where(F.least("na", "nb") >= _needed(F.greatest("na", "nb"), share)).select("a", "b"))
    found = sets_of(rows, nodes, pairs.select(F.col("a").alias("node")).unionByName(pairs.select(F.col("b").alias("node"))).distinct())
    for end in ("a", "b"):
        pairs = pairs.join(found.select(F.col("node").alias(end), F.col("s").alias(f"s{end}")), end)
    links = saved(pairs.where(F.size(F.array_intersect("sa", "sb")) >= _needed(F.greatest(F.size("sa"), F.size("sb")), share)).select("a", "b"))
    del pairs, found
    release(rows.sparkSession)
    return links


def _labelled(members: DataFrame, links: DataFrame) -> DataFrame:
    """The rows (band, node, weight, label) of bands with more than one component."""
    labels = weak_components(links).withColumnRenamed("component", "label")
    now = members.select("band", "node", "weight").join(labels, "node", "left").select("band", "node", "weight", F.coalesce("label", "node").alias("label"))
    now = saved(now)
    several = saved(now.groupBy("band").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("band"))
    return saved(now.join(maybe_broadcast(several, several.count()), "band"))


def _with_majority(now: DataFrame, checked: DataFrame) -> DataFrame:
    """A pair (a, b) not yet checked for every node outside a band's largest component: with that one's weightiest member, of all its bands."""
    parts = now.groupBy("band", "label").agg(F.count("*").alias("n"), F.max(F.struct("weight", "node")).alias("one"))
    top = saved(parts.groupBy("band").agg(F.max_by(F.struct("label", "one"), F.struct("n", "label")).alias("top")))
    outside = now.join(maybe_broadcast(top, 4 * top.count()), "band").where("label <> top.label").select("node", "top.one")
    ones = outside.groupBy("node", F.col("one.node").alias("other")).agg(F.max("one.weight").alias("weight"))
    fresh_ones = ones.select("node", "other", "weight", *_ordered("node", "other")).join(checked, ["a", "b"], "left_anti")
    return saved(fresh_ones.groupBy("node").agg(F.max_by("other", F.struct("weight", "other")).alias("other")).select(*_ordered("node", "other")).distinct())


def _foreign(shingles: DataFrame) -> DataFrame:
    """(shingle, n) of those that nodes of several components have; n counts the nodes."""
    each = shingles.groupBy("shingle").agg(F.count("*").alias("n"), F.min("label").alias("low"), F.max("label").alias("high"))
    return saved(each.where("low <> high").select("shingle", "n"))


def prefix_pairs(rows: DataFrame, nodes: DataFrame, labels: DataFrame, share: float) -> DataFrame:
    """Candidates (a, b) of different components among labels (node, label): every linked pair is one of them."""
    sets = sets_of(rows, nodes, labels.select("node")).join(labels, "node")
    left = sets.select("node", "label", F.size("s").alias("size"), F.explode("s").alias("shingle"))
    before, now = None, labels.count()
    while before is None or now < SHRINKS * before:
        release(rows.sparkSession)
        left = saved(left.join(_foreign(left), "shingle").select("node", "label", "size", "shingle"))
        able = saved(left.groupBy("node", "size").agg(F.count("*").alias("n")).where(F.col("n") >= _needed("size", share)).select("node"))
        before, now = now, able.count()
        left = left.join(maybe_broadcast(able, now), "node", "left_semi")
    own = Window.partitionBy("node")
    placed = left.join(_foreign(left), "shingle").withColumn("place", F.row_number().over(own.orderBy("n", "shingle"))).withColumn("common", F.count("*").over(own))
    rare = saved(placed.where(F.col("place") <= F.col("common") - _needed("size", share) + 1).select("node", "label", "shingle"))
    rare = saved(rare.join(_foreign(rare), "shingle").select("node", "label", "shingle"))
    other = rare.select("shingle", F.col("node").alias("b"), F.col("label").alias("other"))
    return rare.select("shingle", F.col("node").alias("a"), "label").join(other, "shingle").where("a < b and label <> other").select("a", "b").distinct()


def _classes(rows: DataFrame, share: float) -> DataFrame:
    """(row, doc_id, class_id, linked_to, kept) of rows (row, id, text)."""
    sketch, schema = _sketch(share)
    each = saved(rows.mapInArrow(sketch, schema))
    first = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")
    nodes = saved(each.groupBy("k1", "k2").agg(first, F.first("size").alias("size"), F.first("bands").alias("bands")).withColumn("node", F.monotonically_increasing_id()))
    each = saved(each.select("row", "id", "k1", "k2"))
    banded = nodes.select(F.explode("bands").alias("band"), "node")
    shared = saved(banded.groupBy("band").agg(F.count("*").alias("n")).where("n > 1"))
    members = saved(banded.join(_hashed(shared, shared.count()), "band"))
    weights = saved(members.groupBy("node").agg(F.sum("n").alias("weight")))
    members, nodes = saved(members.select("band", "node").join(weights, "node")), saved(nodes.drop("bands"))
    del banded, shared, weights
    release(rows.sparkSession)

    pivots = saved(members.groupBy("band").agg(F.max(F.struct("weight", "node")).alias("pivot")))
    towards = members.join(maybe_broadcast(pivots, 2 * pivots.count()), "band").where("node <> pivot.node").groupBy("node").agg(F.max("pivot").alias("pivot"))
    checked = saved(towards.select("node", F.col("pivot.node").alias("other")).select(*_ordered("node", "other")).distinct())
    del pivots, towards
    links = linked(rows, nodes, checked, share)
    members = _labelled(members, links)
    if not members.isEmpty():
        pairs = _with_majority(members, checked)
        links, checked = saved(links.unionByName(linked(rows, nodes, pairs, share))), checked.unionByName(pairs)
        members = _labelled(members, links)
    if not members.isEmpty():
        pairs = saved(prefix_pairs(rows, nodes, saved(members.select("node", "label").distinct()), share).join(checked, ["a", "b"], "left_anti"))
        links = saved(links.unionByName(linked(rows, nodes, pairs, share)))

    named = nodes.select("k1", "k2", "node", "first").join(weak_components(links).withColumnRenamed("component", "label"), "node", "left").withColumn("label", F.coalesce("label", "node"))
    named = saved(named)
    stays = saved(named.groupBy("label").agg(F.min("first").alias("stays")))
    ends = links.select(F.col("a").alias("node"), F.col("b").alias("other")).unionByName(links.select(F.col("b").alias("node"), F.col("a").alias("other")))
    partner = saved(ends.groupBy("node").agg(F.min("other").alias("other")).join(nodes.select(F.col("node").alias("other"), F.col("first.id").alias("partner")), "other").select("node", "partner"))
    named = saved(named.join(stays, "label").join(partner, "node", "left").select("k1", "k2", "first", "stays", "partner"))
    return each.join(named, ["k1", "k2"]).select(
        "row", F.col("id").alias("doc_id"), F.col("stays.id").alias("class_id"), F.when(F.col("row") == F.col("first.row"), F.col("partner")).otherwise(F.col("first.id")).alias("linked_to"), (F.col("row") == F.col("stays.row")).alias("kept")
    )


def _rows(docs: DataFrame, name: str, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(name).alias("row"), F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """One row per document: doc_id, class_id (the smallest identifier of its class), linked_to (a document that it was found to be linked to, null if there is none), kept."""
    name = fresh(docs, "__n")
    return _classes(_rows(numbered(docs, name), name, id_col, text_col), share).drop("row")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", share: float = SHARE) -> DataFrame:
    """docs with one row of each class; columns as they are."""
    name = fresh(docs, "__n")
    rows = numbered(docs, name)
    return without_rows(rows, name, _classes(_rows(rows, name, id_col, text_col), share).where("not kept").select("row"))
