"""Positive-unlabelled learning with the non-negative unbiased risk estimator, in numpy.

Known are trusted positives P and unlabelled rows U, a mix with a share `prior` of positives. With
a loss l, the risk of negatives can't be seen but is the difference of two risks that can:

    R = prior * R_P(+) + max(0, R_U(-) - prior * R_P(-))

The difference is negative only by overfitting or by chance; where it is, it counts as zero (Kiryo
et al. 2017) and the risk of positives alone is followed. The model is linear on binary features and the loss
logistic, so scores are probabilities of the positive class. Rows are lists of feature numbers.

The prior is estimated from the labelled rows of the training split, with one more of either kind, and
taken some standard errors lower: with too high a prior the difference is below zero before all
negatives are found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Rows:
    """Sparse binary rows: the feature numbers of row i are index[start[i]:start[i + 1]]."""

    index: np.ndarray
    start: np.ndarray

    @classmethod
    def of(cls, rows: list[np.ndarray]) -> Rows:
        start = np.zeros(len(rows) + 1, np.int64)
        np.cumsum([len(r) for r in rows], out=start[1:])
        return cls(np.concatenate([np.asarray(r, np.int64) for r in rows]) if rows else np.zeros(0, np.int64), start)

    def __len__(self) -> int:
        return len(self.start) - 1

    def dot(self, w: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0.0], np.cumsum(w[self.index])])
        return sums[self.start[1:]] - sums[self.start[:-1]]

    def back(self, g: np.ndarray, size: int) -> np.ndarray:
        return np.bincount(self.index, np.repeat(g, np.diff(self.start)), minlength=size)

    def shares(self, size: int) -> np.ndarray:
        """For each feature, the share of rows that have it."""
        return np.bincount(self.index, minlength=size) / max(1, len(self))


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(positive: Rows, unlabelled: Rows, size: int, prior: float, steps: int = 800, rate: float = 0.1, penalty: float = 1e-4) -> tuple[np.ndarray, float]:
    """Weights and bias that minimise the non-negative risk (full batches, Adam, a rate that falls to zero)."""
    w, bias = np.zeros(size), float(np.log(prior / (1 - prior)))
    if not len(positive) or not len(unlabelled):
        return w, bias
    m1, m2, b1, b2 = np.zeros(size), np.zeros(size), 0.0, 0.0
    for step in range(1, steps + 1):
        zp, zu = positive.dot(w) + bias, unlabelled.dot(w) + bias
        sp, su = sigmoid(zp), sigmoid(zu)
        # logistic loss: l(+) = log(1 + e^-z), slope s - 1; l(-) = log(1 + e^z), slope s
        below = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        if below >= 0:
            gp, gu = prior * (sp - 1) / len(positive) - prior * sp / len(positive), su / len(unlabelled)
        else:
            gp, gu = prior * (sp - 1) / len(positive), np.zeros(len(unlabelled))
        g = positive.back(gp, size) + unlabelled.back(gu, size) + penalty * w
        gb = gp.sum() + gu.sum()
        m1, m2 = 0.9 * m1 + 0.1 * g, 0.999 * m2 + 0.001 * g * g
        b1, b2 = 0.9 * b1 + 0.1 * gb, 0.999 * b2 + 0.001 * gb * gb
        c1, c2 = 1 - 0.9**step, 1 - 0.999**step
        now = rate * (1 - (step - 1) / steps)
        w -= now * (m1 / c1) / (np.sqrt(m2 / c2) + 1e-8)
        bias -= now * (b1 / c1) / (np.sqrt(b2 / c2) + 1e-8)
    return w, float(bias)


def estimated_prior(positives: int, negatives: int, unlabelled: int, errors: float) -> float:
    """The share of positives among labelled rows, less some standard errors of it and of the unlabelled sample."""
    n = positives + negatives + 2
    share = (positives + 1) / n
    return max(share / 2, share - errors * (share * (1 - share) * (1 / n + 1 / max(1, unlabelled))) ** 0.5)
