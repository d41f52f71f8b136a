import itertools
import random

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tests.llm.helpers import EDGE_TEXTS, documents
from tidemark.llm import toxicity as t
from tidemark.llm.textscan import slices


def enumerate_marginals(u, move, start):
    total, hit = 0.0, np.zeros(len(u))
    for path in itertools.product((0, 1), repeat=len(u)):
        s = path[0] * start + sum(x for x, y in zip(u, path, strict=True) if y) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False))
        total += np.exp(s)
        hit += np.array(path) * np.exp(s)
    return hit / total


def test_forward_backward_is_exact():
    rng = np.random.default_rng(0)
    sizes = [3, 0, 7, 1, 5, 7]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    u, move, start = rng.normal(size=bounds[-1]) * 2, rng.normal(size=(2, 2)), 0.7
    r, s = t.ratios(u, bounds, move, start)
    p = r * s / (1 + r * s)
    for a, b in zip(bounds, bounds[1:], strict=False):
        if a < b:
            assert np.allclose(p[a:b], enumerate_marginals(u[a:b], move, start))


def corpus(rng, n):
    vocabulary = [f"{a}{b}" for a in "bcdfglmnprst" for b in ("ato", "iner", "ole", "uma")]
    out = []
    for k in range(n):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 80))]
        toxic = k % 4 == 0
        if toxic:
            for _ in range(rng.randint(1, 3)):
                w.insert(rng.randrange(len(w)), rng.choice(["scumbag", "vexoru" + rng.choice(vocabulary)]))
        out.append((" ".join(w).capitalize() + ".", int(toxic)))
    return out


def test_held_out_accuracy_and_spans(spark):
    rng = random.Random(1)
    model = t.fit(corpus(rng, 400))
    test = corpus(rng, 120)
    rows = t.tag_documents(documents(spark, [x for x, _ in test]), model).orderBy("doc_id").collect()
    assert np.mean([(r["__tm_score"] >= 0.5) == bool(y) for r, (_, y) in zip(rows, test, strict=True)]) > 0.97
    for r, (text, y) in zip(rows, test, strict=True):
        if y and r["__tm_score"] >= 0.5:
            assert any(text[s.start : s.end].lower().startswith(("scum", "vexo")) for s in r["__tm_spans"])


def test_offsets_are_code_points():
    model = t.fit(corpus(random.Random(1), 400))
    text = "Éé ünï scumbag bato"
    part = next(slices(pa.array([text])))
    (span,) = t._spans(part, *model.marginals(part), 0)
    assert text[span["start"] : span["end"]] == "scumbag"


def test_edges(spark):
    model = t.fit(corpus(random.Random(2), 200))
    rows = t.tag_documents(documents(spark, [*EDGE_TEXTS, "same", "same"]), model).orderBy("doc_id").collect()
    scores = [r["__tm_score"] for r in rows]
    assert len(rows) == len(EDGE_TEXTS) + 2 and all(0 <= s <= 1 for s in scores)
    assert scores[0] == scores[1] == scores[2] and scores[-1] == scores[-2]
    assert t.tag_documents(documents(spark, []), model).count() == 0


def test_without_both_kinds(spark):
    docs = documents(spark, ["a b", None])
    labels = spark.createDataFrame([(1, 0)], "doc_id long, toxic int")
    assert all(r["__tm_score"] < 0.5 for r in t.tag_documents(docs, t.fit_on(docs, labels)).collect())
    assert all(r["__tm_score"] < 0.5 for r in t.tag_documents(docs, t.fit_on(docs, labels.limit(0))).collect())


def plain_score(model, text):
    """One document: features word by word, forward and backward sums over two states, then the calibrated score."""
    part = next(slices(pa.array([text or ""])))
    _, _, bounds, x = t.features(part)
    p = []
    if len(x):
        u = [sum(float(model.emission[b]) for b in row) + model.bias for row in x]
        e = [(1.0, float(np.exp(np.clip(v, -30, 30)))) for v in u]
        move = np.exp(model.move)
        f = [(e[0][0], e[0][1] * float(np.exp(model.start)))]
        for k in range(1, len(e)):
            now = [e[k][s] * sum(f[-1][r] * move[r, s] for r in (0, 1)) for s in (0, 1)]
            f.append((now[0] / sum(now), now[1] / sum(now)))
        b = [(1.0, 1.0)]
        for k in range(len(e) - 2, -1, -1):
            now = [sum(move[s, r] * e[k + 1][r] * b[0][r] for r in (0, 1)) for s in (0, 1)]
            b.insert(0, (now[0] / sum(now), now[1] / sum(now)))
        p = [f[k][1] * b[k][1] / (f[k][0] * b[k][0] + f[k][1] * b[k][1]) for k in range(len(e))]
    top = min(max(max(p, default=0.0), 1e-9), 1 - 1e-9)
    z = model.scale[0] * np.log(top / (1 - top)) + model.scale[1] * np.log1p(sum(v for v in p if v >= 0.1)) + model.shift
    return 1 / (1 + np.exp(-z))


def test_query_against_a_plain_version(spark, sf):
    """The whole query: folds, the sample that the field learns from, and every document's score."""
    from tests.llm.helpers import crc_fold, drawn
    from tidemark.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    model = t.fit(drawn(texts, labels, t.SAMPLE_PER_KIND, lambda d: crc_fold(d) != 0))
    rows = queries.op7_toxicity(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert r.held_out == (crc_fold(r.doc_id) == 0) and r.predicted == int(r.score >= 0.5)
        assert abs(r.score - plain_score(model, texts[r.doc_id])) < 1e-6


def test_clashing_columns(spark):
    model = t.fit(corpus(random.Random(2), 200))
    df = documents(spark, ["a scumbag b", "b"]).withColumn("spans", F.lit("x")).withColumn("predicted", F.lit("y"))
    out = t.tag_documents(df.union(df), model).collect()
    assert len(out) == 4 and len({(r.doc_id, r["__tm_score"]) for r in out}) == 2 and all(r.spans == "x" and r.score == 1.5 for r in out)
