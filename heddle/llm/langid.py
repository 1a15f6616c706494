"""Language identification by nearest centroid.

A text's vector has the logarithmic counts of its hashed character n-grams (one to three letters,
with word ends), weighted by inverse document frequency and brought to length one. Each language
has up to CLUSTERS centroids, found by spherical k-means over its training texts, so that a
language with several kinds of text isn't one blurred mean. A text gets the language of the
centroid with the largest cosine. Each centroid knows how far its own training texts lie from it; a text
farther from the winning centroid than that distance (times SLACK) is marked as rejected.

Training takes at most about PER_LANGUAGE whole texts of each language, chosen by a hash of the
identifier; executors send their n-gram counts, not their texts. Prediction reads all rows, whole
texts, in one map-only pass with a model of fixed size (languages x CLUSTERS x DIMS).

Cases: a null text or one without a letter is `und` with score 0. Texts of one letter are judged
like others. With no labelled text to learn from all rows are `und`. Repeated rows are judged each; an
empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from heddle.llm.common import per_class_sample

DIMS, CLUSTERS, PER_LANGUAGE, SLACK, SEED = 1 << 13, 4, 500, 1.15, 11
_LETTER = None


def _letters() -> np.ndarray:
    """Whether a code point of the basic plane is a letter."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.array([chr(i).isalpha() for i in range(1 << 16)])
    return _LETTER


def grams(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """Hashed n-grams that occur and their counts; None without a letter."""
    if not text:
        return None
    a = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    letter = _letters()[np.minimum(a, 0xFFFF)] | (a > 0xFFFF)
    if not letter.any() or (not letter[a <= 0xFFFF].any() and not any(c.isalpha() for c in text)):
        return None
    a = np.concatenate([[32], np.where(letter, a, 32), [32]]).astype(np.uint32)
    a = a[np.concatenate([[True], (a[1:] != 32) | (a[:-1] != 32)])]
    one, two = a[a != 32], a[:-1] * np.uint32(0x9E3779B1) + a[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + a[2:]
    mixed = np.concatenate([one * np.uint32(0xC2B2AE35), two * np.uint32(0x27D4EB2F) + np.uint32(1), three * np.uint32(0x165667B1) + np.uint32(2)])
    counts = np.bincount((mixed ^ (mixed >> np.uint32(15))) * np.uint32(0x2C1B3C6D) >> np.uint32(32 - DIMS.bit_length() + 1), minlength=DIMS)
    at = np.flatnonzero(counts)
    return at, counts[at]


@dataclass
class Model:
    languages: list[str]  # of each centroid
    centroids: np.ndarray  # DIMS x centroids, columns of length one
    radius: np.ndarray
    idf: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, and whether it is too far away to be trusted."""
        own = grams(text) if self.languages else None
        if own is None:
            return "und", 0.0, True
        at, counts = own
        v = np.log1p(counts) * self.idf[at]
        cosine = (v @ self.centroids[at]) / (np.sqrt(v @ v) or 1.0)
        best = int(cosine.argmax())
        return self.languages[best], float(min(1.0, max(0.0, cosine[best]))), bool(1 - cosine[best] > SLACK * self.radius[best])


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def spherical_kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 12) -> np.ndarray:
    """Centroids of length one; first ones far apart (k-means++ on cosine distance)."""
    picked = [int(rng.integers(len(x)))]
    for _ in range(min(k, len(x)) - 1):
        far = np.clip(1 - (x @ x[picked].T).max(axis=1), 0, None)
        if far.sum() <= 1e-9:
            break
        picked.append(int(rng.choice(len(x), p=far / far.sum())))
    c = x[picked]
    for _ in range(rounds):
        own = (x @ c.T).argmax(axis=1)
        c = _unit(np.array([x[own == i].mean(axis=0) if (own == i).any() else c[i] for i in range(len(c))]))
    return c


def train(rows: list[tuple[str, np.ndarray, np.ndarray]]) -> Model:
    """From (language, n-grams, counts) of each training text."""
    df = np.ones(DIMS)
    for _, at, _ in rows:
        df[at] += 1
    idf, rng = np.log((len(rows) + 2) / df), np.random.default_rng(SEED)
    names, centroids, radius = [], [], []
    for language in sorted({r[0] for r in rows}):
        own = [r for r in rows if r[0] == language]
        x = np.zeros((len(own), DIMS), np.float32)
        for i, (_, at, counts) in enumerate(own):
            x[i, at] = np.log1p(counts) * idf[at]
        x = _unit(x)
        c = spherical_kmeans(x, CLUSTERS, rng)
        near = x @ c.T
        best = near.argmax(axis=1)
        for i in range(len(c)):
            if (best == i).any():
                names.append(language)
                centroids.append(c[i])
                radius.append(1 - float(np.quantile(near[best == i, i], 0.005)))
    return Model(names, np.array(centroids, np.float32).reshape(-1, DIMS).T.copy(), np.array(radius), idf)


def fit(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> Model:
    """docs: the rows to learn from."""
    sample = per_class_sample(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")), "id", "lang", PER_LANGUAGE)

    def count(batches):
        for batch in batches:
            rows = [(lang, own[0].tolist(), own[1].tolist()) for lang, own in zip(batch["lang"], map(grams, batch["text"]), strict=True) if own]
            yield pd.DataFrame(rows, columns=["lang", "at", "counts"])

    found = sample.select("text", "lang").mapInPandas(count, "lang string, at array<int>, counts array<int>").collect()  # PER_LANGUAGE rows a language
    return train([(r["lang"], np.array(r["at"]), np.array(r["counts"])) for r in sorted(found, key=lambda r: (r["lang"], r["at"], r["counts"]))])


def identify(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score and rejected."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([held.value.predict(t) for t in texts], columns=["lang_pred", "score", "rejected"])

    return docs.withColumn("__lang", predict(F.col(text_col))).select(*docs.columns, "__lang.*")


def held_out_languages(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score, rejected; learns from rows that aren't held out."""
    model = fit(docs.where(~F.coalesce(held_out, F.lit(True))), id_col, text_col, lang_col)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(True)).alias("held_out"), F.col(text_col).alias("text"))
    return identify(rows, model).drop("text")
