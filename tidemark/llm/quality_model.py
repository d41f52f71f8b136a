"""Quality classifier: ordinal cumulative-link regression on graded ratings.

One weight vector over hashed text serves all grades; ordered thresholds cut its score into grades:
P(grade > k) = sigmoid(score - threshold[k]). From these tails come the expected grade and the probability of reaching
a grade, which selects. With two grades this is logistic regression with one threshold.

A text's features are hashed byte trigrams, as shares of all of the text's, and a few binned figures of its words
(number, variety, mean length). Scoring reads whole texts in one vectorised pass, linear in bytes.

Defined results: a null or empty text, or one without words, has score null, expected grade the least, tail
probability 0 and is not kept. Very long texts are scored whole (the fit passes over labelled ones of more than
``SAMPLE_CHARS`` characters). Ties in probability need no order; of several labels of a document the least counts;
repeated rows are scored alike, each by itself. No labelled rows: everything with words is kept. An empty table gives no
rows; columns beside doc_id and text, whatever their names, are passed through.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.learn import fitted, labelled_rows
from tidemark.llm.textscan import NOT_ALNUM, Slice, slices, words

#: Labelled documents of each grade that the model is fitted on, and the longest of them.
SAMPLE_PER_GRADE, SAMPLE_CHARS = 2000, 50_000
_HASHED, _BINNED = 1 << 13, 64
_SCALE = 8.0


def _trigrams(data: np.ndarray) -> np.ndarray:
    """A bucket for each three neighbouring bytes."""
    code = data[:-2].astype(np.uint32) * np.uint32(0x9E3779B1)
    code += data[1:-1].astype(np.uint32) * np.uint32(0x85EBCA6B)
    code ^= code >> np.uint32(15)
    code += data[2:].astype(np.uint32) * np.uint32(0xC2B2AE35)
    code *= np.uint32(0x27D4EB2F)
    return (code >> np.uint32(32 - 13)).astype(np.int64)


def _bins(part: Slice) -> tuple[np.ndarray, np.ndarray]:
    """For each document three binned figures of its words, as positions after the hashed ones; and its word count."""
    w = words(part, NOT_ALNUM)
    n = w.counts()
    owner = np.repeat(np.arange(len(part)), n)
    order = np.lexsort((w.hashes, owner))
    h, o = w.hashes[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (o[1:] != o[:-1])
    distinct = np.bincount(o[new], minlength=len(part))
    letters = np.bincount(owner, (w.ends - w.starts).astype(np.float64), minlength=len(part))
    some = np.maximum(n, 1)
    # variety falls with length of itself, so it is taken against the square root of the count
    variety = np.minimum(distinct / np.sqrt(some) * 4, 15).astype(np.int64)
    size = np.minimum(np.log2(some) * 2, 31).astype(np.int64)
    mean = np.minimum(letters / some, 15).astype(np.int64)
    return np.stack([_HASHED + variety, _HASHED + 16 + size, _HASHED + 48 + mean], 1), n


@dataclass
class OrdinalModel:
    weights: np.ndarray
    thresholds: np.ndarray
    grades: list[int]

    def tails(self, score: Column) -> list[Column]:
        """P(grade > grades[k]) for every k but the last."""
        return [F.lit(1.0) / (F.lit(1.0) + F.exp(F.lit(float(t)) - score)) for t in self.thresholds]


def score_slice(part: Slice, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Scores of a slice's documents, and how many words each has."""
    bins, n = _bins(part)
    total = np.zeros(len(part))
    if len(part.data) >= 3:
        run = np.concatenate([[0.0], np.cumsum(weights[_trigrams(part.data)], dtype=np.float64)])
        last = np.maximum(part.offsets[1:] - 2, part.offsets[:-1])
        grams = last - part.offsets[:-1]
        first = np.minimum(part.offsets[:-1], len(run) - 1)
        total = (run[np.minimum(last, len(run) - 1)] - run[first]) / np.maximum(grams, 1) * _SCALE
    return total + weights[bins].sum(1), n


def _design(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same features, sorted by row: how many of each row, their columns and values."""
    sizes, cols, values = [], [], []
    for part in slices(pa.array(texts, pa.string())):
        bins, _ = _bins(part)
        for d in range(len(part)):
            data = part.data[part.offsets[d] : part.offsets[d + 1]]
            kind, count = np.unique(_trigrams(data), return_counts=True) if len(data) >= 3 else (np.zeros(0, np.int64), np.zeros(0))
            sizes.append(len(kind) + 3)
            cols += [kind.astype(np.int32), bins[d].astype(np.int32)]
            values += [(count / max(count.sum(), 1) * _SCALE).astype(np.float32), np.ones(3, np.float32)]
    return np.array(sizes), np.concatenate(cols), np.concatenate(values)


def gradient(theta: np.ndarray, design: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, k: int, decay: float) -> tuple[float, np.ndarray]:
    """Mean negative log likelihood with its penalty, and its gradient, at (weights, first cut, logs of the gaps)."""
    sizes, cols, values = design
    n, width = len(y), _HASHED + _BINNED
    weights, steps = theta[:width], theta[width:]
    cuts = np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])]))
    score = np.add.reduceat(values * weights[cols], np.cumsum(sizes) - sizes)
    # P(y) is the difference of two neighbouring tails
    tail = 1 / (1 + np.exp(-(score[:, None] - cuts)))
    full = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], 1)
    slope = np.concatenate([np.zeros((n, 1)), tail * (1 - tail), np.zeros((n, 1))], 1)
    i = np.arange(n)
    prob = np.maximum(full[i, y] - full[i, y + 1], 1e-12)
    d_score = -(slope[i, y] - slope[i, y + 1]) / prob / n
    d_cuts = np.zeros(k + 2)
    np.add.at(d_cuts, y, slope[i, y] / prob / n)
    np.add.at(d_cuts, y + 1, -slope[i, y + 1] / prob / n)
    d_steps = np.cumsum(d_cuts[1:-1][::-1])[::-1].copy()
    d_steps[1:] *= np.exp(steps[1:])
    g = np.bincount(cols, np.repeat(d_score, sizes) * values, minlength=width) + decay * weights
    return float(-np.log(prob).mean() + decay / 2 * weights @ weights), np.concatenate([g, d_steps])


def fit(sample: list[tuple[str, int]], rounds: int = 120, rate: float = 0.3, decay: float = 1e-4) -> OrdinalModel:
    """Maximum likelihood with a small penalty, by Adam on the whole sample; the thresholds stay ordered because each
    is the one before plus an exponential."""
    grades = sorted({y for _, y in sample})
    weights = np.zeros(_HASHED + _BINNED)
    if len(grades) < 2:
        return OrdinalModel(weights, np.zeros(0), grades)
    y = np.searchsorted(grades, [g for _, g in sample])
    design = _design([t for t, _ in sample])
    k = len(grades) - 1
    above = np.array([(y > j).mean() for j in range(k)]).clip(1e-3, 1 - 1e-3)
    start = -np.log(above / (1 - above))
    theta = np.concatenate([weights, start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for it in range(1, rounds + 1):
        _, g = gradient(theta, design, y, k, decay)
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        theta = theta - rate * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)
    weights, steps = theta[: _HASHED + _BINNED], theta[_HASHED + _BINNED :]
    return OrdinalModel(weights, np.cumsum(np.concatenate([steps[:1], np.exp(steps[1:])])), grades)


def score_text(text: Column, model: OrdinalModel) -> Column:
    weights = model.weights.astype(np.float32)

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        out, none = [], []
        for part in slices(texts):
            s, n = score_slice(part, weights)
            out.append(s)
            none.append(n == 0)
        if not out:
            return pa.array([], pa.float64())
        return pa.array(np.concatenate(out), mask=np.concatenate(none))

    return scored(text)


def rate_documents(docs: DataFrame, model: OrdinalModel, reach: int = 1, at_least: float = 0.5) -> DataFrame:
    """``docs`` with __tm_score, __tm_expected (expected grade), __tm_tail (P(grade >= grades[reach])) and __tm_kept."""
    out = docs.withColumn("__tm_score", score_text(F.col("text"), model))
    score, zero = F.col("__tm_score"), F.lit(0.0)
    if not len(model.thresholds):
        only = float(model.grades[0]) if model.grades else 0.0
        return out.withColumn("__tm_expected", F.lit(only)).withColumn("__tm_tail", F.when(score.isNull(), zero).otherwise(1.0)).withColumn("__tm_kept", score.isNotNull())
    tails = model.tails(score)
    expected = F.lit(float(model.grades[0]))
    for k, tail in enumerate(tails):
        expected = expected + F.lit(float(model.grades[k + 1] - model.grades[k])) * tail
    return (
        out.withColumn("__tm_expected", F.coalesce(expected, F.lit(float(model.grades[0]))))
        .withColumn("__tm_tail", F.coalesce(tails[reach - 1], zero))
        .withColumn("__tm_kept", F.col("__tm_tail") >= at_least)
    )


def graded_ratings(labels: DataFrame) -> DataFrame:
    """``labels`` (quality 0/1, toxic 0/1) as (doc_id, rating): 0 poor, 1 good but toxic, 2 good. No quality, no rating."""
    rating = F.when(F.col("quality") == 0, 0).when(F.col("quality") == 1, F.when(F.col("toxic") == 1, 1).otherwise(2))
    return labels.select("doc_id", rating.alias("rating"))


def fit_on(docs: DataFrame, labels: DataFrame, label: str = "rating", per_grade: int = SAMPLE_PER_GRADE, max_chars: int = SAMPLE_CHARS) -> OrdinalModel:
    """The model, fitted in one task of the cluster on a bounded sample."""
    return fitted(labelled_rows(docs, labels, label, per_grade, max_chars), fit)
