"""Toxicity classifier by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives, documents of any kind the unlabelled ones; risk and
optimiser are those of pulearn. A text's features are the words it has, their beginnings
of three to seven letters, so that inflected forms of a stem count even if they were never seen, and for beginnings
that come again whether they make up certain shares (RATES) of all words: a stem that any long text has
by chance tells little, one that keeps coming much. Of all features of the training sample (equal texts counting once) those are kept whose share among positives exceeds
that among unlabelled texts by LEAST_Z standard errors; the counts are taken by the executors, and
at most FEATURES of the strongest reach the driver.

Training takes at most about POSITIVES and UNLABELLED whole texts, chosen by a hash of the
identifier. Scoring is one map-only pass over whole texts.

Cases: a null text counts as empty and has the score of a text without any feature. A null
identifier is held out. Labels that repeat an identifier count once, toxic if any is. Without
labels every score is the same. An empty table gives no rows; other columns are kept out of the model.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import crc_mod, saved
from heddle.llm.pulearn import Rows, fit, sigmoid
from heddle.llm.quality import split_samples

POSITIVES, UNLABELLED, FEATURES, LEAST_DOCS, LEAST_Z, ERRORS = 4_000, 12_000, 4_096, 8, 5.0, 1.0
SHORT, LONG, RATES = 3, 7, (0.01, 0.03, 0.08)
_WORD = re.compile(r"[^\W_]+")
_CACHED = 400_000


def features(word: str) -> list[str]:
    """A word's features: itself, and its beginnings marked as such."""
    return [word, *(word[:n] + "*" for n in range(SHORT, min(LONG, len(word)) + 1))]


def words_of(text: str | None) -> tuple[dict[str, int], int]:
    words = _WORD.findall((text or "").lower())
    return Counter(words), len(words)


def reached(count: int, words: int) -> list[float]:
    """The rates that a beginning reaches with its count among so many words."""
    return [r for r in RATES if count >= 2 and count >= r * words]


def text_features(text: str | None) -> set[str]:
    """All features of a whole text; a rate is written behind an @, which no word holds."""
    words, n = words_of(text)
    counts: Counter = Counter()
    for w, k in words.items():
        for f in features(w):
            counts[f] += k
    return set(counts) | {f"{f}@{r}" for f, k in counts.items() if f[-1] == "*" for r in reached(k, n)}


class Finder(dict):
    """The chosen words and beginnings of each word, by word; holds a bounded number of words."""

    def __init__(self, chosen: list[str]):
        super().__init__()
        self.number: dict[str, dict[float, int]] = {}
        for i, f in enumerate(chosen):
            base, _, rate = f.partition("@")
            self.number.setdefault(base, {})[float(rate or 0)] = i

    def __missing__(self, word: str) -> tuple[str, ...]:
        if len(self) > _CACHED:
            self.clear()
        self[word] = own = tuple(f for f in features(word) if f in self.number)
        return own

    def of(self, text: str | None) -> list[int]:
        """Ascending numbers of the features of a whole text."""
        words, n = words_of(text)
        counts: dict[str, int] = {}
        for w, k in words.items():
            for f in self[w]:
                counts[f] = counts.get(f, 0) + k
        return sorted(i for f, k in counts.items() for i in map(self.number[f].get, [0.0, *reached(k, n)]) if i is not None)


def choose(sample: DataFrame) -> list[str]:
    """The strongest features of a bounded sample (text, positive), strongest first."""

    def parts(batches):
        for batch in batches:
            rows = [(bool(p), list(text_features(t))) for p, t in zip(batch["positive"], batch["text"], strict=True)]
            yield pd.DataFrame(rows, columns=["positive", "f"])

    totals = {r["positive"]: r["count"] for r in sample.groupBy("positive").count().collect()}
    n, m = totals.get(True, 0), totals.get(False, 0)
    if not n or not m:
        return []
    each = sample.mapInPandas(parts, "positive boolean, f array<string>").select("positive", F.explode("f").alias("f"))
    counted = each.groupBy("f").agg(F.count(F.when(F.col("positive"), 1)).alias("p"), F.count(F.when(~F.col("positive"), 1)).alias("u")).where(F.col("p") >= LEAST_DOCS)
    pooled = (F.col("p") + F.col("u") + 1) / (n + m + 2)
    z = (F.col("p") / n - F.col("u") / m) / F.sqrt(pooled * (1 - pooled) * (1 / n + 1 / m))
    return [r["f"] for r in counted.withColumn("z", z).where(F.col("z") >= LEAST_Z).orderBy(F.desc("z"), "f").limit(FEATURES).collect()]


def fit_scorer(docs: DataFrame, labels: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic"):
    """A column function: text to probability of being toxic."""
    spark = docs.sparkSession
    p, u, prior = split_samples(docs.select(id_col, text_col), labels, label, held_out, id_col, POSITIVES, UNLABELLED, ERRORS)
    sample = saved(p.select(F.col(text_col).alias("text"), F.lit(True).alias("positive")).unionByName(u.select(F.col(text_col).alias("text"), F.lit(False).alias("positive"))).distinct())
    chosen = choose(sample)
    names = spark.sparkContext.broadcast(chosen)

    def number(batches):
        finder = Finder(names.value)
        for batch in batches:
            yield pd.DataFrame({"positive": batch["positive"], "f": [finder.of(t) for t in batch["text"]]})

    rows = sorted((r["positive"], r["f"]) for r in sample.mapInPandas(number, "positive boolean, f array<int>").collect())
    weights, bias = fit(Rows.of([np.array(f, int) for x, f in rows if x]), Rows.of([np.array(f, int) for x, f in rows if not x]), max(1, len(chosen)), prior)
    held = spark.sparkContext.broadcast((chosen, weights, bias))

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        names, w, b = held.value
        finder = Finder(names)
        for texts in batches:
            yield pd.Series([float(sigmoid(w[finder.of(t)].sum() + b)) for t in texts], dtype="float64")

    return score


def toxicity_fold(id_col: str = "doc_id") -> Column:
    return crc_mod(F.col(id_col), 5) == 0


def score_toxicity(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    held_out = toxicity_fold(id_col) if held_out is None else held_out
    score = fit_scorer(docs, labels, held_out, id_col, text_col, label)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), score(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
