"""Benchmark decontamination: short test items found inside long documents.

Containment MinHash: a document is far larger than an item, so the Jaccard of the two says
nothing; instead the item is sampled by its smallest shingle hashes and each document's shingles
are looked up in those samples. Items are partitioned by shingle-set size, each partition having
a factor SIZE_STEP between its bounds, and a partition's samples have floor((1 - t) * upper) + 1
hashes. An item with containment t or more lacks at most floor((1 - t) * size) of its shingles,
so at least one of its sampled hashes is in the document: the search loses nothing. Candidates are
then verified by exact containment over the shingles' words, not hashes.

Samples and candidate identifiers are counted before they are broadcast; beyond the limit both
joins shuffle, where adaptive execution splits a hash that very many documents share.

Cases: a null or empty text has no shingles; an item of fewer than five words has none either and
is never reported. Repeated items give a row each distinct item_id; repeated documents count as one
document per identifier. Null identifiers are reported as null. Empty tables give no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import maybe_broadcast, saved, without

WORDS, SHARE, SIZE_STEP = 5, 0.8, 1.25


def words(text: Column) -> Column:
    """Lower-case runs of letters and digits."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def shingle_rows(df: DataFrame, keys: list[str], text: str, make) -> DataFrame:
    """keys and one row per shingle position; make turns five word columns into the shingle.

    explode_outer and the late filter keep the optimizer from computing the words twice.
    """
    split = df.select(*keys, words(F.col(text)).alias("w"))
    at = split.select(*keys, "w", F.explode_outer(F.expr(f"case when size(w) >= {WORDS} then sequence(0, size(w) - {WORDS}) end")).alias("at"))
    return at.where("at is not null").select(*keys, make(*[F.col("w")[F.col("at") + i] for i in range(WORDS)]).alias("shingle"))


def item_samples(items: DataFrame, share: float = SHARE) -> DataFrame:
    """(item_id, shingle, size, part): the sampled hashes of every item."""
    hashes = shingle_rows(items, ["item_id"], "text", F.xxhash64).distinct()
    sized = hashes.withColumn("size", F.count("*").over(Window.partitionBy("item_id")))
    sized = sized.withColumn("part", F.floor(F.log(F.col("size").cast("double")) / F.lit(math.log(SIZE_STEP))))
    upper = F.ceil(F.pow(F.lit(SIZE_STEP), F.col("part") + 1))
    taken = F.floor(F.lit(round(1 - share, 9)) * upper + F.lit(1e-9)) + 1
    return sized.withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("shingle"))).where(F.col("rank") <= taken).select("item_id", "shingle", "size", "part")


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = SHARE) -> DataFrame:
    """(doc_id, item_id, shared, item_shingles, containment) for every pair of at least that containment."""
    docs = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text")).where(F.col("text").isNotNull())
    samples = saved(item_samples(items, share))
    probe = maybe_broadcast(samples.select("shingle", "item_id"), samples.count())
    found = saved(shingle_rows(docs, ["doc_id"], "text", F.xxhash64).join(probe, "shingle").select("doc_id", "item_id").distinct())
    ids = found.select("doc_id").distinct()
    same = lambda a, b: a.eqNullSafe(b)
    picked = maybe_broadcast(ids.withColumnRenamed("doc_id", "__id"), ids.count())
    suspects = docs.join(picked, same(docs["doc_id"], picked["__id"]), "left_semi")
    join_words = lambda *w: F.concat_ws(" ", *w)
    exact = saved(shingle_rows(items, ["item_id"], "text", join_words).distinct())
    sizes = exact.groupBy("item_id").agg(F.count("*").alias("item_shingles"))
    held = exact.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("shingle")), F.lit(0)).alias("bytes")).first()
    both = shingle_rows(suspects, ["doc_id"], "text", join_words).join(maybe_broadcast(exact, max(held["n"], held["bytes"] // 64)), "shingle")
    counted = both.distinct().groupBy("doc_id", "item_id").agg(F.count("*").alias("shared"))
    found = found.select(F.col("doc_id").alias("__d"), F.col("item_id").alias("__i"))
    counted = counted.join(found, same(counted["doc_id"], found["__d"]) & same(counted["item_id"], found["__i"]), "left_semi")
    sizes = sizes.withColumnRenamed("item_id", "__item")
    pairs = counted.join(sizes, same(counted["item_id"], sizes["__item"]))
    return pairs.select("doc_id", "item_id", "shared", "item_shingles", (F.col("shared") / F.col("item_shingles")).alias("containment")).where(F.col("shared") >= F.lit(share) * F.col("item_shingles"))


def without_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the documents that contaminated() reports; columns as they are."""
    return without(docs, "doc_id", contaminated(docs, items).select("doc_id"))
