import random

import pytest

from tests.llm.helpers import EDGE_TEXTS, components, documents
from tidemark.llm import components as c
from tidemark.llm import jaccard_join as j


def edit(rng, w, n):
    w = list(w)
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return w


def corpus(seed):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(400)}" for _ in range(n)]
    passage = fresh(60)
    texts = list(EDGE_TEXTS)
    for _ in range(4):
        base = fresh(rng.randint(20, 150))
        texts += [" ".join(edit(rng, base, rng.randrange(6))) for _ in range(25)]
        texts += [" ".join(base)] * 3 + [" ".join(base).upper()]
        chain = base
        for _ in range(12):
            chain = edit(rng, chain, 1)
            texts.append(" ".join(chain))
    texts += [" ".join(fresh(10) + passage + fresh(rng.randint(0, 40))) for _ in range(25)]
    texts += [" ".join(fresh(rng.randint(1, 80))) for _ in range(30)]
    texts += ["short text here", "Short  text\there", "a b c d e", "a b c d e"]
    return texts


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components_against_all_pairs(spark, seed):
    texts = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.link_components(documents(spark, texts)).collect()}
    assert got == components(list(enumerate(texts, 1)))


def test_hot_shingles_and_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(j, "HOT", 2)
    monkeypatch.setattr(j, "RANGE_ENTRIES", 50)
    texts = corpus(4)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in j.link_components(documents(spark, texts).repartition(5)).collect()}
    assert got == components(list(enumerate(texts, 1)))


def test_ids_null_and_repeated(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    rows = [(3, a), (3, a), (3, b), (8, b), (5, a), (None, a), (9, "alone in here")]
    out = j.link_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(out) == len(rows)
    assert {(r.doc_id, r.component_id) for r in out} == {(3, 3), (8, 3), (5, 3), (None, None), (9, 9)}


def test_empty_table(spark):
    assert j.link_components(documents(spark, [])).count() == 0


def test_bit_packing():
    import numpy as np

    x = np.array([0, 1, 2**48 - 1, 12345678901], np.uint64)
    assert (j._unplanes(j._planes(x, 6), 6) == x).all()
    assert len(j._unplanes(j._planes(x[:0], 6), 6)) == 0


def test_components_of_graphs(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, k) for k in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        r, s = sorted((root(a), root(b)))
        parent[s] = r
    got = {r.node: r.component for r in c.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in parent if any(x in e and e[0] != e[1] for e in edges)}
    assert c.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_homes_of_blocks_are_spread_over_ranges(spark):
    docs = documents(spark, corpus(5)).repartition(12).select("doc_id", "text")
    blocks = docs.mapInArrow(j._blocks(16, 5), j._BLOCK_DDL).where("home IS NOT NULL").select("block", "range").collect()
    assert len(blocks) == len({r.block for r in blocks}) == 12
    assert len({r.range for r in blocks}) > 6
