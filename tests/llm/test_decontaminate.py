import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.helpers import EDGE_TEXTS, documents
from tidemark.llm import decontaminate as d


def item(rng, n):
    return " ".join(f"w{rng.randrange(500)}" for _ in range(n))


def plain_words(text):
    out = "".join(c if c.isalnum() or ord(c) > 127 else " " for c in (text or "").lower())
    return out.split()


def brute(texts, items, threshold=0.75):
    found = {}
    for i, text in texts:
        w = plain_words(text)
        for item_id, it in items:
            q = plain_words(it)
            k = min(5, len(q))
            if not k or len(w) < k:
                continue
            grams = lambda x: [tuple(x[a : a + k]) for a in range(len(x) - k + 1)]  # noqa: E731, B023
            own, want = grams(w), grams(q)
            if not set(own) & set(want):
                continue  # all windows have similarity zero
            n = min(len(want), len(own))
            for a in range(len(own) - n + 1):
                part = own[a : a + n]
                both = sum(min(part.count(g), want.count(g)) for g in set(part))
                s = both / (len(part) + len(want) - both)
                if s >= threshold:
                    found[i, item_id] = max(s, found.get((i, item_id), 0))
    return found


@pytest.fixture(scope="module")
def planted():
    rng = random.Random(5)
    items = [(k, item(rng, n)) for k, n in enumerate([40, 25, 12, 5, 3, 1, 30])] + [(90, None), (91, "  ,;"), (92, "rep rep rep rep rep rep rep rep")]
    texts = list(EDGE_TEXTS)
    for k in (0, 1, 2, 3, 4, 6):
        words = items[k][1].split()
        texts.append(f"{item(rng, 30)}. {items[k][1].upper()}! {item(rng, 30)}")
        texts.append(items[k][1])
        texts.append(" ".join(words[: len(words) // 2]))
        edited = list(words)
        edited[-1] = "changed"
        texts.append(f"{item(rng, 10)} {' '.join(edited)} {item(rng, 10)}")
    texts += [items[0][1] + " " + items[1][1]] * 2 + [item(rng, 400), "rep " * 6, "rep " * 20]
    return items, list(enumerate(texts, 1))


def test_against_all_windows(spark, planted):
    items, texts = planted
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, [t for _, t in texts])
    got = {(r.doc_id, r.item_id): r.similarity for r in d.contaminated(docs, bench).collect()}
    want = brute(texts, items)
    assert got.keys() == want.keys()
    assert all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_blocks_of_items_lose_nothing(spark, planted):
    items, texts = planted
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, [t for _, t in texts])
    key = lambda df: sorted((r.doc_id, r.item_id) for r in df.collect())
    assert key(d.contaminated(docs, bench, item_shingles_held=20)) == key(d.contaminated(docs, bench))


def test_clean_documents(spark, planted):
    items, texts = planted
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, [t for _, t in texts])
    bad = {k for k, _ in brute(texts, items)}
    kept = d.clean_documents(docs, bench)
    assert kept.columns == docs.columns or set(kept.columns) == set(docs.columns)
    assert {r.doc_id for r in kept.collect()} == {i for i, _ in texts} - bad


def test_empty_sides(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert d.contaminated(documents(spark, ["a b c d e f"]), bench).count() == 0
    assert d.contaminated(documents(spark, []), spark.createDataFrame([(1, "a b c")], "item_id long, text string")).count() == 0


def test_blocks_cover_the_radius():
    rng = random.Random(0)
    for _ in range(300):
        flips = rng.sample(range(256), d.RADIUS)
        assert min(sum(f // 16 == b for f in flips) for b in range(16)) <= d._PER_BLOCK


def noise(rng, n):
    return np.array([rng.getrandbits(64) for _ in range(n)], np.uint64)


def test_index_finds_all_within_the_radius_and_few_others():
    rng = random.Random(1)
    index = d.ItemIndex(5, [(i, noise(rng, 40)) for i in range(200)])
    near = np.repeat(index.prints[:50], 20, 0)
    for row in near:  # up to the radius away
        for f in rng.sample(range(256), rng.randrange(d.RADIUS + 1)):
            row[f // 8] ^= 1 << f % 8
    got = set(index.candidates(40, near))
    assert got >= {(w, w // 20) for w in range(len(near))}
    all_close = {(w, k) for w in range(len(near)) for k in np.flatnonzero(d.distance(index.prints, near[w][None].repeat(200, 0)) <= d.RADIUS).tolist()}
    assert got == all_close
    far = np.concatenate([d.fingerprint(noise(rng, 40)) for _ in range(500)])
    met, _ = index.met(40, far)
    assert len(met) / (500 * 200) < 0.2  # of all pairs, before the whole distance is looked at
    assert len(list(index.candidates(40, far))) == 0


@pytest.mark.parametrize("repeated", [False, True])
def test_recall_at_the_threshold(repeated):
    """Windows that are as far from their item as 0.75 allows, with and without shingles that occur often."""
    rng, found, n = random.Random(2), 0, 0
    for k in range(1500):
        size = rng.choice([7, 14, 35, 70])
        item = noise(rng, size)
        if repeated:
            item[: size // 3] = item[0]
        other = item.copy()
        moved = rng.sample(range(size), size // 7)
        other[moved] = noise(rng, 1) if repeated and k % 2 else noise(rng, len(moved))
        a, b = Counter(item.tolist()), Counter(other.tolist())
        if d.weighted_jaccard(a, b) >= 0.75:
            n += 1
            found += d.distance(d.fingerprint(item), d.fingerprint(other))[0] <= d.RADIUS
    assert n > 500 and found / n > (0.995 if repeated else 0.998)


def test_window_prints_are_those_of_the_windows():
    rng = random.Random(3)
    own = noise(rng, 200)
    own[20:40] = own[100]
    own[150:160] = own[140:150]
    for size in (1, 7, 30, 200):
        want = np.concatenate([d.fingerprint(own[k : k + size]) for k in range(len(own) - size + 1)])
        assert (d.window_prints(own, size) == want).all()


def test_long_documents_in_stretches(spark, monkeypatch):
    monkeypatch.setattr(d, "_STRETCH", 16)
    rng = random.Random(4)
    items = [(1, item(rng, 40)), (2, item(rng, 25))]
    text = " ".join([item(rng, 3000), items[0][1], item(rng, 50), items[0][1], items[1][1], item(rng, 2000)])
    w = d._one(text)
    index = d.Items(d.item_shingles(items)).indexes[0]
    assert {(i, s) for _, i, s, _, _ in d._scan(index, w, 0.75)} == {(1, 1.0), (2, 1.0)}


def test_items_beyond_one_block(spark, planted):
    items, texts = planted
    bench = spark.createDataFrame(items, "item_id long, text string")
    docs = documents(spark, [t for _, t in texts])
    key = lambda df: sorted((r.doc_id, r.item_id) for r in df.collect())
    assert key(d.contaminated(docs, bench, items_held=2)) == key(d.contaminated(docs, bench))
