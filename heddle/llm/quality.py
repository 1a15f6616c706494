"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled good texts, the unlabelled ones are documents of any kind; the model
is that of pulearn. A text is described in two ways. Its form: shares of its characters and words, that is every ASCII mark
on its own, capitals, digits, letters, white space, lines, word length, distinct words, words that
repeat the one before, and length. They say how a text is made, whatever its language. Each is
compared with fixed edges, and a feature says that an edge is reached; so what is learnt from some
values holds for larger ones too. Its content: hashed words, and hashed runs of three characters that make
up GRAM_SHARE of all. Of these the executors count how many positives and unlabelled texts of the training
sample have each, and the CONTENT strongest are kept whose shares differ by LEAST_Z standard errors, either way.

Training takes at most about POSITIVES and UNLABELLED whole texts, chosen by a hash of the
identifier, and executors send counts and feature numbers, not texts. Scoring is one map-only pass over whole
texts.

Cases: a null text counts as empty and is scored by the features that an empty text has. A null
identifier is held out. Labels that repeat an identifier count once, good if any is. Without labels the
prior is one half and every score the same. An empty table gives no rows; other columns are kept
out of the model.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import crc_mod, fresh, per_class_sample, saved
from heddle.llm.files import arrow_rows
from heddle.llm.pulearn import Rows, estimated_prior, fit, sigmoid

POSITIVES, UNLABELLED, ERRORS = 4_000, 12_000, 3.0
_MARKS = np.array([i for i in range(33, 127) if not chr(i).isalnum()])
_SHARES = np.array([1e-9, 0.002, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.35, 0.5, 0.65, 0.8, 0.9, 0.97])
_SIZES = np.array([1, 2, 4, 8, 16, 32, 64, 128, 256, 512, 1024, 4096, 16384])
_LENGTHS = np.array([1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 40])
_BINS, _STATS = len(_SHARES) + 1, 10
SIZE = (len(_MARKS) + _STATS) * _BINS
CONTENT, LEAST_Z, GRAM_SHARE, DIMS = 512, 5.0, 1 / 500, 1 << 14
_CACHED = 100_000


def _classes() -> np.ndarray:
    """0 other, 1 lower or caseless letter, 2 capital, 3 digit, 4 white space; code points from 256 on are one class of their own."""
    out = np.zeros(257, np.int64)
    for i in range(256):
        c = chr(i)
        out[i] = 4 if c.isspace() else 2 if c.isupper() else 1 if c.isalpha() else 3 if c.isdigit() else 0
    return out


_CLASS = _classes()


def bins(text: str | None) -> np.ndarray:
    """For each measure, how many of its edges a whole text reaches."""
    text = text or ""
    a = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
    counts = np.bincount(np.minimum(a, 256), minlength=257)
    kinds, n, words = np.bincount(_CLASS, counts, minlength=5), max(1, len(a)), text.split()
    m = max(1, len(words))
    shares = np.concatenate([counts[_MARKS] / n, [kinds[1] / n, kinds[2] / n, kinds[3] / n, kinds[4] / n, counts[256] / n, counts[10] / m, len(set(words)) / m, sum(map(eq, words, words[1:])) / m]])
    return np.concatenate([np.searchsorted(_SHARES, shares, "right"), [np.searchsorted(_SIZES, len(words), "right"), np.searchsorted(_LENGTHS, n / m, "right")]])


def features(reached: np.ndarray) -> np.ndarray:
    """Feature numbers of a row of bins(), ascending."""
    at = np.repeat(np.arange(len(reached)) * _BINS, reached)
    return at + np.arange(len(at)) - np.repeat(np.cumsum(reached) - reached, reached)


def table_of(weights: np.ndarray) -> np.ndarray:
    """For each measure, the sum of weights by the number of edges reached."""
    by = weights.reshape(-1, _BINS)
    return np.concatenate([np.zeros((len(by), 1)), np.cumsum(by, axis=1)], axis=1)


class Content(dict):
    """Numbers of a text's content features, below 2 * DIMS: runs of characters, then words; holds a bounded number of words."""

    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) > _CACHED:
            self.clear()
        self[word] = h = DIMS + xxhash.xxh64_intdigest(word) % DIMS
        return h

    def of(self, text: str | None, wanted: np.ndarray | None = None) -> np.ndarray:
        """Of a whole text; with a mask of wanted numbers, those alone."""
        text = text or ""
        a = np.frombuffer(text.encode("utf-32-le", "replace"), "<u4")
        three = (a[:-2] * np.uint32(0x9E3779B1) + a[1:-1]) * np.uint32(0x85EBCA6B) + a[2:]
        runs, least = (three ^ (three >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - DIMS.bit_length() + 1), max(1, GRAM_SHARE * len(three))
        words = {self[w] for w in set(text.split())}
        if wanted is None:
            return np.concatenate([np.flatnonzero(np.bincount(runs, minlength=DIMS) >= least), sorted(words)]).astype(np.int64)
        at, counts = np.unique(runs[wanted[runs]], return_counts=True)
        return np.concatenate([at[counts >= least], [w for w in sorted(words) if wanted[w]]]).astype(np.int64)


def strongest(with_p: np.ndarray, with_u: np.ndarray, n: int, m: int) -> np.ndarray:
    """Numbers of the content features whose shares of n positives and m unlabelled texts differ most, at least by LEAST_Z standard errors."""
    pooled = (with_p + with_u + 1) / (n + m + 2)
    z = np.abs(with_p / max(1, n) - with_u / max(1, m)) / np.sqrt(pooled * (1 - pooled) * (1 / max(1, n) + 1 / max(1, m)))
    order = np.lexsort((np.arange(len(z)), -z))[:CONTENT]
    return np.sort(order[z[order] >= LEAST_Z])


def train_model(spark, positives: DataFrame, unlabelled: DataFrame, prior: float, text_col: str = "text") -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of form and of all content features, and bias, from bounded samples of texts."""

    def count(batches):
        content, seen, rows = Content(), np.zeros((2, 2 * DIMS), np.int64), [0, 0]
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                for p, t in zip(part["positive"].to_pylist(), part["text"].to_pylist(), strict=True):
                    seen[int(p), content.of(t)] += 1
                    rows[int(p)] += 1
        at = np.flatnonzero(seen.sum(axis=0))
        yield arrow_rows([(-1, rows[1], rows[0]), *zip(at.tolist(), seen[1, at].tolist(), seen[0, at].tolist(), strict=True)], "f int, p long, u long")

    def number(batches):
        own = Content()
        for batch in batches:
            for at in range(0, len(batch), 200):
                part = batch.slice(at, 200)
                rows = [(p, bins(t).tolist(), np.flatnonzero(np.isin(chosen, own.of(t))).tolist()) for p, t in zip(part["positive"].to_pylist(), part["text"].to_pylist(), strict=True)]
                yield arrow_rows(rows, "positive boolean, f ints, c ints")

    both = positives.select(F.col(text_col).alias("text"), F.lit(True).alias("positive")).unionByName(unlabelled.select(F.col(text_col).alias("text"), F.lit(False).alias("positive")))
    both = saved(both)
    seen, rows = np.zeros((2, 2 * DIMS)), {True: 0, False: 0}
    for r in both.mapInArrow(count, "f int, p long, u long").groupBy("f").agg(F.sum("p").alias("p"), F.sum("u").alias("u")).collect():  # at most 2 * DIMS rows
        if r["f"] < 0:
            rows = {True: r["p"], False: r["u"]}
        else:
            seen[:, r["f"]] = r["p"], r["u"]
    chosen = strongest(seen[0], seen[1], rows[True], rows[False])
    found = sorted((r["positive"], r["f"], r["c"]) for r in both.mapInArrow(number, "positive boolean, f array<int>, c array<int>").collect())
    p, u = (Rows.of([np.concatenate([features(np.array(f)), SIZE + np.array(c, np.int64)]) for x, f, c in found if x == kind]) for kind in (True, False))
    weights, bias = fit(p, u, SIZE + len(chosen), prior)
    content = np.zeros(2 * DIMS)
    content[chosen] = weights[SIZE:]
    return weights[:SIZE], content, bias


def split_samples(docs: DataFrame, labels: DataFrame, label: str, held_out: Column, id_col: str = "doc_id", positives: int = POSITIVES, unlabelled: int = UNLABELLED, errors: float = ERRORS) -> tuple[DataFrame, DataFrame, float]:
    """Trusted positives, unlabelled rows (bounded samples of docs that aren't held out) and the prior.

    held_out is over id_col. The labels chosen are at most about `positives` rows and are broadcast.
    """
    own = labels.where(~F.coalesce(held_out, F.lit(True)) & F.col(label).isNotNull()).groupBy(id_col).agg(F.max(label).alias("label"))
    counts = {r["label"]: r["count"] for r in own.groupBy("label").count().collect()}
    chosen = per_class_sample(own.where("label = 1"), id_col, "label", positives).select(F.col(id_col).alias("__id"))
    p = docs.join(F.broadcast(chosen), docs[id_col] == F.col("__id"), "left_semi")
    rest = docs.where(~F.coalesce(held_out, F.lit(True)))
    rows = rest.count()
    share = min(1.0, unlabelled / max(1, rows))
    prior = estimated_prior(counts.get(1, 0), counts.get(0, 0), min(rows, unlabelled), errors)
    u = rest.where(F.pmod(F.xxhash64(F.col(id_col), F.lit(13)), F.lit(1 << 30)) < F.lit(int(share * (1 << 30))))
    return p, u, prior


def scorer(spark, weights: np.ndarray, content: np.ndarray, bias: float):
    """A column function: text to score."""
    held, each = spark.sparkContext.broadcast((table_of(weights), content, bias)), np.arange(SIZE // _BINS)

    @F.arrow_udf("double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        (table, c, b), own = held.value, Content()
        wanted = c != 0
        for texts in batches:
            out = []
            for at in range(0, len(texts), 200):  # a slice at a time becomes Python strings
                out += [float(sigmoid(table[each, bins(t)].sum() + c[own.of(t, wanted)].sum() + b)) for t in texts.slice(at, 200).to_pylist()]
            yield pa.array(out, pa.float64())

    return score


def fit_scorer(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "quality"):
    p, u, prior = split_samples(docs.select(id_col, text_col), labels, label, held_out, id_col)
    return scorer(docs.sparkSession, *train_model(docs.sparkSession, p, u, prior, text_col))


def quality_fold(id_col: str = "doc_id") -> Column:
    return crc_mod(F.col(id_col), 3) == 1


def score_quality(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label: str = "quality") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    held_out = quality_fold(id_col) if held_out is None else held_out
    score = fit_scorer(docs, labels, held_out, id_col, text_col, label)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), score(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the classifier predicts to be good; columns as they are."""
    score, name = fit_scorer(docs, labels, quality_fold()), fresh(docs, "__score")
    return docs.withColumn(name, score(F.col("text"))).where(F.col(name) >= 0.5).drop(name)
