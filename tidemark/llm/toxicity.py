"""Toxicity: a linear-chain conditional random field over words, aggregated to documents.

Labels are given for documents only, so words are labelled first: a feature of words (the word, or how it begins) that
toxic documents hold far more often than others, by a likelihood-ratio test, marks the words that have it in toxic
documents. The field is trained on these labelled words. Scoring runs forward-backward over whole texts; the marginals
give offending spans, and the largest marginal, calibrated on the training documents, gives the document's score.

Only the text is an input of a score. Defined results: null, empty or wordless texts have no marginal and get the
calibrated score of a marginal of zero, without spans; very long texts are scored whole (the fit passes over labelled
ones of more than ``SAMPLE_CHARS`` characters); ties in the marginal need no order; repeated rows score alike; without
labelled rows of both kinds every score is the share of toxic ones among them (0 if there are none); an empty table
gives no rows; columns beside doc_id and text, whatever their names, are passed through.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.learn import fitted, labelled_rows
from tidemark.llm.textscan import NOT_ALNUM, Slice, slices, words

#: Labelled documents that the field is fitted on, by label, and the longest of them.
SAMPLE_PER_KIND, SAMPLE_CHARS = {0: 4000, 1: 1500}, 50_000
#: Documents without toxic words that the field itself sees.
CLEAN_SEQUENCES = 1000
#: Likelihood ratio (G) from which a feature marks words; chance gives one as large about once in ten million features.
SIGNIFICANT = 28.0
#: A word is in a span from this marginal on.
SPAN_AT = 0.5
_BUCKETS = 1 << 18
_PREFIXES = (3, 4, 5, 6)


def features(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word starts, ends, document bounds, and for each word the buckets of itself and its first bytes (0: too short)."""
    low = part.lowered(latin=True)
    w = words(low, NOT_ALNUM)
    out = np.zeros((len(w.hashes), 1 + len(_PREFIXES)), np.int32)
    out[:, 0] = w.hashes >> np.uint64(64 - 18)
    if len(w.hashes):
        length = w.ends - w.starts
        data = np.concatenate([low.data, np.zeros(max(_PREFIXES), np.uint8)])
        code = np.zeros(len(w.starts), np.uint64)
        for j in range(max(_PREFIXES)):
            with np.errstate(over="ignore"):
                code = (code + data[w.starts + j].astype(np.uint64) + np.uint64(j + 1)) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
            if j + 1 in _PREFIXES:
                k = _PREFIXES.index(j + 1) + 1
                out[:, k] = np.where(length > j + 1, (code >> np.uint64(64 - 18)).astype(np.int32) | 1, 0)
    return w.starts, w.ends, w.bounds, out


def ratios(u: np.ndarray, bounds: np.ndarray, move: np.ndarray, start: float) -> tuple[np.ndarray, np.ndarray]:
    """Forward and backward ratios of the toxic to the clean state at each word.

    All documents step together, the longest first, so one step is a few operations on a contiguous prefix.
    """
    e = np.exp(np.clip(u, -30, 30))
    t = np.exp(move)
    r, s = np.zeros(len(u)), np.ones(len(u))
    n = np.diff(bounds)
    order = np.argsort(-n, kind="stable")
    order = order[n[order] > 0]
    if not len(order):
        return r, s
    first, n = bounds[:-1][order], n[order]
    alive = np.searchsorted(-n, -np.arange(1, int(n[0]) + 1), "right")
    r[first] = e[first] * np.exp(start)
    for k in range(1, int(n[0])):
        at = first[: alive[k]] + k
        last = r[at - 1]
        r[at] = e[at] * (t[0, 1] + t[1, 1] * last) / (t[0, 0] + t[1, 0] * last)
    for k in range(int(n[0]) - 2, -1, -1):
        at = first[: alive[k + 1]] + k
        ahead = e[at + 1] * s[at + 1]
        s[at] = (t[1, 0] + t[1, 1] * ahead) / (t[0, 0] + t[0, 1] * ahead)
    return r, s


def _emissions(weights: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The sum of each word's feature weights, a feature at a time, which needs no array of words by features."""
    out = weights[x[:, 0]].astype(np.float64)
    for k in range(1, x.shape[1]):
        out += weights[x[:, k]]
    return out


@dataclass
class ToxicModel:
    emission: np.ndarray = field(default_factory=lambda: np.zeros(_BUCKETS, np.float32))
    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    start: float = 0.0
    bias: float = 0.0
    #: Score is sigmoid(scale[0] * logit(largest marginal) + scale[1] * log(1 + expected toxic words) + shift).
    scale: tuple[float, float] = (0.0, 0.0)
    shift: float = -30.0

    def marginals(self, part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        starts, ends, bounds, x = features(part)
        r, s = ratios(_emissions(self.emission, x) + self.bias, bounds, self.move, self.start)
        both = r * s
        return starts, ends, bounds, both / (1 + both)

    def score(self, evidence: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(evidence @ np.array(self.scale) + self.shift)))


def evidence(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """For each document the log odds of its largest marginal and log(1 + expected toxic words)."""
    top = np.clip(_largest(p, bounds), 1e-9, 1 - 1e-9)
    total = np.concatenate([[0.0], np.cumsum(np.where(p >= 0.1, p, 0.0))])
    return np.stack([np.log(top / (1 - top)), np.log1p(total[bounds[1:]] - total[bounds[:-1]])], 1)


def _largest(p: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    out = np.zeros(len(bounds) - 1)
    some = np.flatnonzero(np.diff(bounds) > 0)
    if len(some):
        out[some] = np.maximum.reduceat(p, bounds[some])
    return out


def marking_features(x: np.ndarray, bounds: np.ndarray, toxic: np.ndarray, significant: float = SIGNIFICANT) -> np.ndarray:
    """Which buckets toxic documents hold significantly more often: the likelihood-ratio statistic on document counts."""
    held = np.zeros((2, _BUCKETS))
    for d in range(len(bounds) - 1):
        held[int(toxic[d]), np.unique(x[bounds[d] : bounds[d + 1]])] += 1
    n = np.array([(~toxic).sum(), toxic.sum()], float)[:, None]

    def part(observed, expected):
        return observed * np.log(np.maximum(observed, 1e-12) / np.maximum(expected, 1e-12))

    share = held.sum(0) / n.sum()
    g = 2 * sum(part(held[k], n[k] * share) + part(n[k] - held[k], n[k] * (1 - share)) for k in (0, 1))
    marks = (g >= significant) & (held[1] / n[1] > 20 * held[0] / n[0])
    marks[0] = False
    return marks


def fit(sample: list[tuple[str, int]], rounds: int = 25, rate: float = 0.5, decay: float = 1e-5) -> ToxicModel:
    model = ToxicModel()
    toxic = np.array([y > 0 for _, y in sample], bool)
    if not len(sample) or toxic.all() or not toxic.any():
        model.shift = 30.0 if len(sample) and toxic.all() else -30.0
        return model
    found, offset, bounds = [], 0, [np.zeros(1, np.int64)]
    for part in slices(pa.array([t for t, _ in sample], pa.string())):
        _, _, b, x = features(part)
        found.append(x)
        bounds.append(b[1:] + offset)
        offset += len(x)
    x, bounds = np.concatenate(found), np.concatenate(bounds)
    marks = marking_features(x, bounds, toxic)
    y = np.repeat(toxic, np.diff(bounds))
    y &= np.logical_or.reduce([marks[x[:, k]] for k in range(x.shape[1])])

    # the field sees all toxic documents and some others
    clean = np.flatnonzero(~toxic)
    seen = np.sort(np.concatenate([np.flatnonzero(toxic), clean[:: max(1, len(clean) // CLEAN_SEQUENCES)]]))
    at = np.concatenate([np.arange(bounds[d], bounds[d + 1]) for d in seen])
    sx, sy = x[at], y[at]
    sb = np.concatenate([[0], np.cumsum(np.diff(bounds)[seen])])
    inner = np.ones(len(sx), bool)
    inner[sb[:-1][np.diff(sb) > 0]] = False
    second = np.flatnonzero(inner)
    heads = sb[:-1][np.diff(sb) > 0]
    pair = np.zeros((2, 2))
    np.add.at(pair, (sy[second - 1].astype(int), sy[second].astype(int)), 1)
    used = np.unique(sx)
    slot = np.zeros(_BUCKETS, np.int32)
    slot[used] = np.arange(len(used))
    sx = slot[sx]
    theta = np.zeros(len(used) + 1 + 4 + 1)
    square = np.full(len(theta), 1e-8)
    base = np.log(max(sy.mean(), 1e-6))
    theta[len(used)] = base
    for _ in range(rounds):
        emission, bias, move, start = theta[: len(used)], theta[len(used)], theta[len(used) + 1 : -1].reshape(2, 2), theta[-1]
        u = _emissions(emission, sx) + bias
        r, s = ratios(u, sb, move, start)
        p = r * s / (1 + r * s)
        wrong = sy - p
        # pair marginals: forward state, move, and what is ahead of the second word
        ahead = np.exp(np.clip(u, -30, 30))[second] * s[second]
        t, back = np.exp(move), r[second - 1]
        joint = [np.full(len(second), t[0, 0]), t[0, 1] * ahead, t[1, 0] * back, t[1, 1] * back * ahead]
        whole = sum(joint)
        expected = np.array([(j / whole).sum() for j in joint]).reshape(2, 2)
        g_emission = sum(np.bincount(sx[:, k], wrong, minlength=len(used)) for k in range(sx.shape[1]))
        g = np.concatenate([g_emission / len(sy) - decay * emission, [wrong.sum() / len(sy)], ((pair - expected) / len(sy)).ravel(), [wrong[heads].sum() / len(sy)]])
        if used[0] == 0:
            g[0] = 0.0
        square += g * g
        theta = theta + rate * g / np.sqrt(square)
    model.emission[used] = theta[: len(used)]
    model.bias, model.move, model.start = float(theta[len(used)]), theta[len(used) + 1 : -1].reshape(2, 2), float(theta[-1])
    r, s = ratios(_emissions(model.emission, x) + model.bias, bounds, model.move, model.start)
    _calibrate(model, evidence(r * s / (1 + r * s), bounds), toxic)
    return model


def _calibrate(model: ToxicModel, z: np.ndarray, toxic: np.ndarray, rounds: int = 50) -> None:
    """Logistic regression of the label on the evidence, by Newton's method with a ridge; no weight below zero."""
    a = np.concatenate([z, np.ones((len(z), 1))], 1)
    for use in ([0, 1, 2], [0, 2]):
        x, beta = a[:, use], np.zeros(len(use))
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
            h = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(len(use))
            step = np.linalg.solve(h, x.T @ (toxic - p) - 0.1 * beta)
            beta = beta + step
            if np.abs(step).max() < 1e-8:
                break
        if (beta[:-1] >= 0).all():
            break
    model.scale, model.shift = (float(max(beta[0], 0.0)), float(beta[1]) if len(use) == 3 else 0.0), float(beta[-1])


def fit_on(docs: DataFrame, labels: DataFrame, label: str = "toxic", learnable: Column | None = None, per_kind: dict[int, int] | int = SAMPLE_PER_KIND, max_chars: int = SAMPLE_CHARS) -> ToxicModel:
    """The model, fitted in one task of the cluster on a bounded sample."""
    return fitted(labelled_rows(docs, labels, label, per_kind, max_chars, learnable), fit)


def _spans(part: Slice, starts, ends, bounds, p, d: int) -> list[dict]:
    """Runs of words at SPAN_AT or above, as code point offsets into the text."""
    a, b = bounds[d], bounds[d + 1]
    hit = np.flatnonzero(p[a:b] >= SPAN_AT)
    if not len(hit):
        return []
    base = part.offsets[d]
    text = part.data[base : part.offsets[d + 1]]
    points = np.concatenate([[0], np.cumsum((text & 0xC0) != 0x80)])
    cuts = np.flatnonzero(np.diff(hit) > 1)
    out = []
    for i, j in zip(np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(hit) - 1]]), strict=True):
        lo, hi = starts[a + hit[i]] - base, ends[a + hit[j]] - base
        out.append({"start": int(points[lo]), "end": int(points[hi]), "marginal": float(p[a + hit[i] : a + hit[j] + 1].max())})
    return out


def judge_text(text: Column, model: ToxicModel, with_spans: bool = True) -> Column:
    """struct<score double, spans array<struct<start int, end int, marginal double>>> of whole texts."""
    kind = pa.struct([("score", pa.float64()), ("spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("marginal", pa.float64())])))])

    @F.arrow_udf("score double, spans array<struct<start:int,end:int,marginal:double>>")
    def judged(texts: pa.Array) -> pa.Array:
        scores, spans = [], []
        for part in slices(texts):
            starts, ends, bounds, p = model.marginals(part)
            scores.append(model.score(evidence(p, bounds)))
            hot = set(np.flatnonzero(_largest(p, bounds) >= SPAN_AT).tolist()) if with_spans else ()
            spans += [_spans(part, starts, ends, bounds, p, d) if d in hot else [] for d in range(len(part))]
        flat = np.concatenate(scores) if scores else np.zeros(0)
        return pa.StructArray.from_arrays([pa.array(flat), pa.array(spans, kind.field("spans").type)], ["score", "spans"])

    return judged(text)


def tag_documents(docs: DataFrame, model: ToxicModel) -> DataFrame:
    """``docs`` with __tm_score and __tm_spans."""
    return docs.withColumn("__tm_j", judge_text(F.col("text"), model)).withColumn("__tm_score", F.col("__tm_j.score")).withColumn("__tm_spans", F.col("__tm_j.spans")).drop("__tm_j")
