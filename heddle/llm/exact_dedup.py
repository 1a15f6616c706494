"""Exact duplicates by content-defined chunk recipes.

A text is cut where its own content says so: after the first line end or sentence end that follows
MIN_CHUNK characters, at MAX_CHUNK characters where there is none. The chunks concatenated are the
text. A document's recipe is the ordered list of its chunk identifiers; texts are equal exactly if
their recipes are. An identifier is a 64-bit hash, verified against the chunk bytes themselves:
every distinct (hash, chunk) of the corpus is gathered once, and where two chunks share a hash
they are told apart by an ordinal. After that only lists of numbers move, never texts.

Everything is a DataFrame operation. A text that a third of all rows hold costs each map task one
row per chunk (distinct combines before the shuffle), and its group is one row of the group table,
which joins the documents as the non-skewed side.

Of every group exactly one row stays: rows are told apart by their place, not by their identifier, so
a text is never lost because another one has the same identifier.

Cases: a null text counts as empty and has the empty recipe; all empty texts are one group. A null
identifier sorts below all others, so it is kept only if its whole group has none. Rows that repeat
both identifier and text count each in group_size, and one of them is kept. An empty table gives
no rows. Other columns are ignored and may have any name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from heddle.llm.common import fresh, numbered, saved, without_rows

MIN_CHUNK, MAX_CHUNK = 256, 2048


def chunks(text: Column, least: int = MIN_CHUNK, most: int = MAX_CHUNK) -> Column:
    """The text's content-defined chunks, in order; they concatenate to the text."""
    cut = rf"(?s).{{{least},{most - 1}}}?(?:\n|[.!?](?=\s))|.{{1,{most}}}"
    return F.regexp_extract_all(text, F.lit(cut), F.lit(0))


def chunk_hash(chunk: Column, bits: int = 64) -> Column:
    h = F.xxhash64(chunk)
    return h if bits == 64 else h.bitwiseAND(F.lit((1 << bits) - 1))


def recipes(docs: DataFrame, key_cols: list[str], text_col: str, hash_bits: int = 64) -> DataFrame:
    """(*key_cols, recipe, text_sha256) for every row; hash_bits under 64 is for tests that need collisions."""
    base = docs.select(*key_cols, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("__text"))
    cut, sha = chunks(F.col("__text")), F.sha2(F.col("__text").cast("binary"), 256).alias("text_sha256")
    pieces = base.select(F.explode(cut).alias("chunk")).select(chunk_hash(F.col("chunk"), hash_bits).alias("h"), "chunk")
    shared = saved(pieces.distinct().groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h"))
    if shared.isEmpty():
        return base.select(*key_cols, F.transform(cut, lambda c: chunk_hash(c, hash_bits)).alias("recipe"), sha)
    # Some hashes stand for several chunks. Their chunks get ordinals, and the ordinals join the recipe.
    twins = pieces.distinct().join(shared, "h").select("h", "chunk", F.row_number().over(Window.partitionBy("h").orderBy("chunk")).alias("ordinal"))
    row = saved(base.withColumn("__at", F.monotonically_increasing_id()))
    spots = row.select("__at", F.posexplode(cut).alias("pos", "chunk")).withColumn("h", chunk_hash(F.col("chunk"), hash_bits))
    spots = spots.join(twins, ["h", "chunk"], "left").select("__at", "pos", F.array("h", F.coalesce("ordinal", F.lit(1)).cast("long")).alias("verified"))
    lists = spots.groupBy("__at").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "verified"))), lambda x: x["verified"]).alias("lists"))
    return row.join(lists, "__at", "left").select(*key_cols, F.coalesce(F.flatten("lists"), F.expr("cast(array() as array<bigint>)")).alias("recipe"), sha)


def _judged(rows: DataFrame, hash_bits: int = 64) -> DataFrame:
    """(__row, doc_id, keep_id, group_size, kept, text_sha256, chunks) of rows (__row, __id, __text)."""
    each = saved(recipes(rows, ["__row", "__id"], "__text", hash_bits))  # lists of numbers: texts are cut no more
    groups = saved(each.groupBy("recipe").agg(F.max(F.struct("__id", "__row")).alias("stays"), F.count("*").alias("group_size")))  # saved, so that the join has a shuffle on either side and can split a hot recipe
    return each.join(groups, "recipe").select(
        "__row", F.col("__id").alias("doc_id"), F.col("stays.__id").alias("keep_id"), "group_size", (F.col("__row") == F.col("stays.__row")).alias("kept"), "text_sha256", F.size("recipe").alias("chunks")
    )


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_bits: int = 64) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256, chunks."""
    rows = numbered(docs, fresh(docs, "__n"))
    return _judged(rows.select(F.col(rows.columns[-1]).alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text")), hash_bits).drop("__row")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with one row of every text, the one that exact_dedup() keeps; columns as they are."""
    name = fresh(docs, "__n")
    rows = numbered(docs, name)
    judged = _judged(rows.select(F.col(name).alias("__row"), F.col(id_col).alias("__id"), F.col(text_col).alias("__text")))
    return without_rows(rows, name, judged.where("not kept").select("__row"))
