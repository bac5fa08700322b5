"""Toxicity by non-negative positive-unlabelled learning."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loglathe.llm.base import over_texts, where_texts
from loglathe.llm.linear import (
    BITS, Sample, adam, damped, first_by_hash, held_out, sampled_features, sigmoid, word_ids,
)

#: Bounds of the samples that a classifier is fitted on; scoring covers every row.
MAX_POSITIVE, MAX_UNLABELLED = 4_000, 8_000


@dataclass(frozen=True)
class ToxicModel:
    weights: np.ndarray
    bias: float
    prior: float

    def scores(self, texts: list[str]) -> list[float]:
        out = []
        for text in texts:
            ids, n = word_ids(text)
            out.append(float(sigmoid(np.float64(self.bias + float(damped(n) @ self.weights[ids])))))
        return out


def fit_nnpu(
    positive: list, unlabelled: list, prior: float, steps: int = 200, rate: float = 0.1, decay: float = 0.25,
    least: int = 4,
) -> ToxicModel:
    """Minimise  prior * E_P[l(g)] + max(0, E_U[l(-g)] - prior * E_P[l(-g)])  with the logistic loss.

    The second term estimates the risk on clean text from unlabelled text alone; where it falls
    below zero the model has begun to overfit, and the step goes up that term instead of down.
    """
    p, n_p, n_u = prior, len(positive), len(unlabelled)
    if not n_p or not n_u:
        return ToxicModel(np.zeros(1 << BITS), float(np.log(p / (1 - p))), p)
    x = Sample([(i, damped(n)) for i, n in positive + unlabelled], least)
    is_p = np.arange(n_p + n_u) < n_p

    def gradient(theta):
        g = x.dot(theta[:-1]) + theta[-1]
        up = np.logaddexp(0, g)                     # l(-g)
        rest = up[~is_p].mean() - p * up[is_p].mean()
        s = sigmoid(g)
        slope = np.where(is_p, -p * s / n_p, s / n_u)
        slope = np.where(is_p, p * (s - 1) / n_p, 0) + slope if rest >= 0 else -slope
        out = np.append(x.back(slope), slope.sum())
        out[:-1] += decay / (n_p + n_u) * theta[:-1]
        return out

    start = np.zeros((1 << BITS) + 1)
    start[-1] = np.log(p / (1 - p))
    theta = adam(gradient, start, steps, rate)
    return ToxicModel(theta[:-1], float(theta[-1]), p)


def _limit(p_scores: np.ndarray, u_scores: np.ndarray, prior: float) -> float:
    """Where to cut: the best estimated F1, from positives and unlabelled texts that weren't fitted on.

    The share of positives among the unlabelled is the least ratio of both tails, wherever that
    many positives lie above; with it the unlabelled tail gives precision and the positives recall.
    """
    cuts = np.unique(np.concatenate([p_scores, u_scores]))
    p_above = 1 - np.searchsorted(np.sort(p_scores), cuts) / len(p_scores)
    u_above = np.maximum(1 - np.searchsorted(np.sort(u_scores), cuts) / len(u_scores), 1 / len(u_scores))
    many = p_above >= 0.3
    share = min(2 * prior, float((u_above[many] / p_above[many]).min()))
    precision = np.minimum(1.0, share * p_above / u_above)
    f1 = 2 * precision * p_above / np.maximum(precision + p_above, 1e-9)
    best = np.flatnonzero(f1 >= f1.max() - 1e-12)
    return float(cuts[best[len(best) // 2]])


def fit_placed(positive: list, unlabelled: list, prior: float, **how) -> ToxicModel:
    """``fit_nnpu`` on three quarters of each sample; the last quarters say where the score is 0.5."""
    def parts(rows):
        return [x for i, x in enumerate(rows) if i % 4 != 3], [x for i, x in enumerate(rows) if i % 4 == 3]

    (p_fit, p_rest), (u_fit, u_rest) = parts(positive), parts(unlabelled)
    model = fit_nnpu(p_fit, u_fit, prior, **how)
    if not p_rest or not u_rest or not model.weights.any():
        return model

    def raw(rows):
        return np.array([float(damped(n) @ model.weights[i]) for i, n in rows])

    return ToxicModel(model.weights, -_limit(raw(p_rest), raw(u_rest), prior), prior)


def train(
    docs: DataFrame, labels: DataFrame, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED,
) -> ToxicModel:
    """Fit on confirmed toxic documents and unlabelled text, both outside the held-out fold.

    The class prior is the share of toxic ones among all labelled rows outside that fold; labels have no
    other use than that and naming the positives. The model is fitted on at most ``max_positive`` and
    ``max_unlabelled`` documents, the first by a hash of their ids.
    Features are the words of whole texts; no other column is read. A document that is labelled
    twice counts as toxic if any row says so; null labels are no labels.
    """
    marks = (
        labels.where(~held_out() & F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
        .groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    )
    n, toxic = marks.agg(F.count("*"), F.sum("toxic")).first()
    prior = min(0.5, ((toxic or 0) + 1) / (n + 10))
    named = first_by_hash(marks.where("toxic = 1").select("doc_id"), max_positive)
    other = first_by_hash(docs.where(~held_out()).select("doc_id").distinct(), max_unlabelled)
    positive = [x for _, x in sampled_features(docs, named, word_ids)]
    unlabelled = [x for _, x in sampled_features(docs, other, word_ids)]
    return fit_placed(positive, unlabelled, prior)


def score(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """doc_id, score of every row (null and empty texts: the score of no words). Nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 MB whatever the input
    return over_texts(docs, lambda: lambda texts: [shared.value.scores(texts)], "score double")


def drop_toxic(docs: DataFrame, model: ToxicModel, limit: float = 0.5) -> DataFrame:
    """Rows of ``docs``, unchanged, that score under ``limit``; copies and repeated rows share one fate."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return where_texts(docs, lambda: lambda texts: [s < limit for s in shared.value.scores(texts)])
