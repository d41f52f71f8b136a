import random

import numpy as np
import pytest

from tests.llm.helpers import EDGE_TEXTS, documents
from tidemark.llm import quality_model as q


def graded(rng, g):
    pool = [["zz!!", "##", "BUY"], ["some", "BUY", "words"], ["prose", "some", "words"], ["prose", "reads", "well"]][g]
    return " ".join(rng.choice(pool) + rng.choice(["", "s", "ing"]) for _ in range(60))


def test_ordered_thresholds_and_held_out_grades(spark):
    rng = random.Random(0)
    train = [(graded(rng, g), g) for g in (0, 1, 2, 3) for _ in range(60)]
    model = q.fit(train)
    assert (np.diff(model.thresholds) > 0).all() and model.grades == [0, 1, 2, 3]
    test = [(graded(rng, g), g) for g in (0, 1, 2, 3) for _ in range(20)]
    rows = q.rate_documents(documents(spark, [t for t, _ in test]), model, reach=2).orderBy("doc_id").collect()
    expected = np.array([r["__tm_expected"] for r in rows])
    truth = np.array([g for _, g in test])
    assert np.abs(np.round(expected) - truth).mean() < 0.15
    assert ((np.array([r["__tm_kept"] for r in rows])) == (truth >= 2)).mean() > 0.9


@pytest.mark.parametrize("label", ["quality", "rating"])
def test_labels_held_out(spark, label, sf="/root/testdata/sf0.01"):
    docs, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    labels = labels.join(q.graded_ratings(labels), "doc_id")
    model = q.fit_on(docs, labels.where("doc_id % 3 != 0"), label)
    assert model.grades == [0, 1] if label == "quality" else [0, 1, 2]
    rated = q.rate_documents(docs, model).join(labels.where("doc_id % 3 = 0"), "doc_id").collect()
    right = [r["__tm_kept"] == (r.quality == 1) for r in rated]
    assert sum(right) / len(right) > 0.93
    clean = [r["__tm_kept"] for r in rated if r.quality == 1]
    assert sum(clean) / len(clean) > 0.95


def test_edges(spark):
    model = q.fit([("good prose here", 1), ("bad ### $$", 0)] * 5)
    docs = documents(spark, [*EDGE_TEXTS, "same", "same"])
    rows = {r.doc_id: r for r in q.rate_documents(docs, model).collect()}
    assert len(rows) == len(EDGE_TEXTS) + 2
    for i in (1, 2, 3):
        assert rows[i]["__tm_score"] is None and not rows[i]["__tm_kept"] and rows[i]["__tm_tail"] == 0.0
    assert rows[len(EDGE_TEXTS) + 1]["__tm_score"] == rows[len(EDGE_TEXTS) + 2]["__tm_score"]
    assert q.rate_documents(docs.limit(0), model).count() == 0


def test_without_labels_everything_with_words_stays(spark):
    docs = documents(spark, ["text", None])
    none = spark.createDataFrame([], "doc_id long, rating int")
    kept = {r.doc_id: r["__tm_kept"] for r in q.rate_documents(docs, q.fit_on(docs, none)).collect()}
    assert kept == {1: True, 2: False}


def test_ratings(spark):
    labels = spark.createDataFrame([(1, 0, 1), (2, 1, 1), (3, 1, 0), (4, 1, None), (5, None, 0)], "doc_id long, quality int, toxic int")
    assert [r.rating for r in q.graded_ratings(labels).orderBy("doc_id").collect()] == [0, 1, 2, 2, None]


def test_score_does_not_depend_on_the_slice():
    import pyarrow as pa

    from tidemark.llm.textscan import slices

    texts = ["alpha beta gamma", "", "x", "ab", "delta " * 50, "é à"]
    weights = np.random.default_rng(0).normal(size=q._HASHED + q._BINNED)
    whole = q.score_slice(next(slices(pa.array(texts))), weights)[0]
    alone = [q.score_slice(next(slices(pa.array([t]))), weights)[0][0] for t in texts]
    assert np.allclose(whole, alone)


def test_gradient_is_that_of_the_likelihood():
    rng, r = random.Random(5), np.random.default_rng(5)
    texts, y = [graded(rng, g) for g in (0, 1, 2, 3) * 3], np.array([0, 1, 2, 3] * 3)
    design = q._design(texts)
    theta = np.concatenate([r.normal(size=q._HASHED + q._BINNED) * 0.1, [-0.5, 0.1, -0.3]])
    _, g = q.gradient(theta, design, y, 3, 1e-2)
    places = [*np.unique(design[1])[:: max(1, len(np.unique(design[1])) // 20)], len(theta) - 3, len(theta) - 2, len(theta) - 1]
    for k in places:
        step = np.zeros_like(theta)
        step[k] = 1e-5
        up, down = (q.gradient(theta + s, design, y, 3, 1e-2)[0] for s in (step, -step))
        assert abs((up - down) / 2e-5 - g[k]) < 1e-6


def plain_row(text):
    """Features of a text, from the module's words: shares of hashed trigrams and three binned figures."""
    from tidemark.llm.textscan import NOT_ALNUM

    data, m, row = text.encode(), 0xFFFFFFFF, {}
    for a, b, c in zip(data, data[1:], data[2:], strict=False):
        code = (a * 0x9E3779B1 + b * 0x85EBCA6B) & m
        code ^= code >> 15
        code = ((code + c * 0xC2B2AE35) & m) * 0x27D4EB2F & m
        row[code >> 19] = row.get(code >> 19, 0) + q._SCALE / (len(data) - 2)
    words = bytes(32 if NOT_ALNUM[x] else x for x in data).split()
    n = max(len(words), 1)
    for k in (int(min(len(set(words)) / n**0.5 * 4, 15)), 16 + int(min(np.log2(n) * 2, 31)), 48 + int(min(sum(map(len, words)) / n, 15))):
        row[q._HASHED + k] = 1.0
    return row, len(words)


def test_query_against_a_plain_fit(spark, sf):
    """The whole query: sample, fit with dense arrays and tails written out, scores of every document."""
    from tests.llm.helpers import drawn
    from tidemark.llm import queries

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    grades = {r.doc_id: 0 if r.quality == 0 else 1 if r.toxic == 1 else 2 for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    sample = drawn(texts, grades, q.SAMPLE_PER_GRADE)
    kinds = sorted({y for _, y in sample})
    y, k = np.array([kinds.index(g) for _, g in sample]), len(kinds) - 1
    x = np.zeros((len(sample), q._HASHED + q._BINNED))
    for i, (t, _) in enumerate(sample):
        for c, v in plain_row(t)[0].items():
            x[i, c] = v
    sigmoid = lambda z: 1 / (1 + np.exp(-z))
    above = np.array([(y > j).mean() for j in range(k)]).clip(1e-3, 1 - 1e-3)
    start = -np.log(above / (1 - above))
    w, first, gaps = np.zeros(x.shape[1]), start[0], np.log(np.maximum(np.diff(start), 1e-2))
    state = [(np.zeros_like(w), np.zeros_like(w)), (0.0, 0.0), (np.zeros_like(gaps), np.zeros_like(gaps))]
    for it in range(1, 121):
        cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        z = x @ w
        d_z, d_cut = np.zeros(len(y)), np.zeros(k)
        for i, g in enumerate(y):
            hi = sigmoid(z[i] - cuts[g - 1]) if g > 0 else 1.0
            lo = sigmoid(z[i] - cuts[g]) if g < k else 0.0
            p = max(hi - lo, 1e-12) * len(y)
            s_hi, s_lo = hi * (1 - hi), lo * (1 - lo)
            d_z[i] = -(s_hi - s_lo) / p
            if g > 0:
                d_cut[g - 1] += s_hi / p
            if g < k:
                d_cut[g] -= s_lo / p
        grads = [x.T @ d_z + 1e-4 * w, d_cut.sum(), np.array([d_cut[j + 1 :].sum() for j in range(k - 1)]) * np.exp(gaps)]
        moved = []
        for (m, v), g, old in zip(state, grads, (w, first, gaps), strict=True):
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            moved.append(((m, v), old - 0.3 * (m / (1 - 0.9**it)) / (np.sqrt(v / (1 - 0.99**it)) + 1e-8)))
        state, (w, first, gaps) = [s for s, _ in moved], [o for _, o in moved]
    cuts = first + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    rows = queries.op5_quality_classifier(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        row, n = plain_row(texts[r.doc_id] or "")
        tails = sigmoid(sum(w[c] * v for c, v in row.items()) - cuts) if n else np.zeros(k)
        assert abs(r.tail_probability - tails[0]) < 2e-3 and abs(r.expected_grade - (kinds[0] + sum((b - a) * t for a, b, t in zip(kinds, kinds[1:], tails, strict=False)))) < 4e-3
        assert r.kept == (tails[0] >= 0.5) or abs(tails[0] - 0.5) < 2e-3


def test_repeated_rows_clashing_columns_and_long_labelled_texts(spark):
    model = q.fit([("good prose here", 1), ("bad ### $$", 0)] * 5)
    df = documents(spark, ["good prose", "bad ###"])
    df = df.union(df).withColumn("expected", df.key).withColumn("kept", df.key)
    out = q.rate_documents(df, model).collect()
    assert len(out) == 4 and len({(r.doc_id, r["__tm_score"]) for r in out}) == 2 and all(r.kept == "k" for r in out)
    labels = spark.createDataFrame([(1, 0), (1, 1), (2, 1), (3, None), (None, 1)], "doc_id long, rating int")
    from tidemark.llm.learn import labelled_sample

    assert labelled_sample(documents(spark, ["one", "two" * 100, "three"]), labels, "rating", 5, 50) == [("one", 0)]
