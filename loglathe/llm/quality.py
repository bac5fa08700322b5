"""Quality by ordinal regression: one set of word weights, ordered thresholds between grades."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.llm.base import over_texts, where_texts
from loglathe.llm.linear import (
    BITS, Sample, adam, first_by_hash, held_out, sampled_features, share, sigmoid, word_and_shape_ids,
)

#: Bound of the sample of rated documents that a classifier is fitted on; scoring covers every row.
MAX_RATED = 16_000


@dataclass(frozen=True)
class OrdinalModel:
    """P(grade <= k) = sigmoid(cuts[k] - weights . x), cuts in ascending order."""

    weights: np.ndarray
    cuts: np.ndarray

    def tails(self, texts: list[str]) -> np.ndarray:
        """For each text P(grade >= 1), P(grade >= 2), ..."""
        z = np.zeros(len(texts))
        for i, text in enumerate(texts):
            ids, n = word_and_shape_ids(text)
            z[i] = float(share(n) @ self.weights[ids])
        return sigmoid(z[:, None] - self.cuts[None, :])


def fit_ordinal(
    rows: list, grades: list[int], steps: int = 250, rate: float = 0.1, decay: float = 2e-5, least: int = 4
) -> OrdinalModel:
    """Maximum likelihood of the cumulative-link model with a little weight decay.

    Cuts are the first one plus exponentials, so they stay in order. Grades are 0 ... K; a grade
    without rows gets a share as if it had one.
    """
    y = np.array(grades, int)
    k = max(1, int(y.max(initial=0)))
    counts = np.bincount(y, minlength=k + 1) + 1.0
    below = np.cumsum(counts)[:-1] / counts.sum()
    cuts = np.log(below / (1 - below))
    if not rows:
        return OrdinalModel(np.zeros(1 << BITS), cuts)
    x, d = Sample([(i, share(n)) for i, n in rows], least), 1 << BITS

    def cuts_of(theta):
        return theta[d] + np.concatenate([[0.0], np.cumsum(np.exp(theta[d + 1:]))])

    def gradient(theta):
        z, c = x.dot(theta[:d]), cuts_of(theta)
        edge = np.concatenate([[-np.inf], c, [np.inf]])
        hi, lo = edge[y + 1] - z, edge[y] - z
        f_hi, f_lo = np.where(np.isinf(hi), 1.0, sigmoid(hi)), np.where(np.isinf(lo), 0.0, sigmoid(lo))
        p = np.maximum(f_hi - f_lo, 1e-12)
        g_hi, g_lo = f_hi * (1 - f_hi) / p / len(y), f_lo * (1 - f_lo) / p / len(y)
        out = np.zeros_like(theta)
        out[:d] = x.back(g_hi - g_lo) + decay * theta[:d]
        each = np.array([g_lo[y == j + 1].sum() - g_hi[y == j].sum() for j in range(k)])
        after = np.cumsum(each[::-1])[::-1]         # a step between cuts moves all later cuts
        out[d] = after[0]
        out[d + 1:] = after[1:] * np.exp(theta[d + 1:])
        return out

    start = np.concatenate([np.zeros(d), [cuts[0]], np.log(np.maximum(np.diff(cuts), 1e-3))])
    theta = adam(gradient, start, steps, rate)
    return OrdinalModel(theta[:d], cuts_of(theta))


def train(docs: DataFrame, ratings: DataFrame, max_rated: int = MAX_RATED) -> OrdinalModel:
    """Fit on ``ratings`` (doc_id, grade 0 ... K) outside the held-out fold, at most ``max_rated`` of them.

    Several ratings of one document count as their lowest; null grades are no ratings. Only the
    whole text is an input.
    """
    marks = (
        ratings.where(~held_out() & F.col("grade").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.min("grade").cast("int").alias("grade"))
    )
    found = sampled_features(docs, first_by_hash(marks, max_rated), word_and_shape_ids)
    return fit_ordinal([x for _, x in found], [r.grade for r, _ in found])


def grade(docs: DataFrame, model: OrdinalModel, tail: int = 1) -> DataFrame:
    """doc_id, expected_grade, tail_probability = P(grade >= ``tail``) of every row (null text: empty)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        def work(texts):
            tails = shared.value.tails(texts)
            return [tails.sum(1).tolist(), tails[:, tail - 1].tolist()]
        return work

    return over_texts(docs, make, "expected_grade double, tail_probability double")


def select(docs: DataFrame, model: OrdinalModel, tail: int = 1, least: float = 0.5) -> DataFrame:
    """Rows of ``docs``, unchanged, whose tail probability is at least ``least``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return where_texts(docs, lambda: lambda texts: (shared.value.tails(texts)[:, tail - 1] >= least).tolist())
