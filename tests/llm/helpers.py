"""Plain models that the operators are held against."""

from __future__ import annotations

import re
import zlib

import xxhash

EDGE_TEXTS = [None, "", " \t\n", "one", "two words", "a b c d", "a b c d e", "x" * 5000, "word " * 3000, "é à ü\nß ñ", "tail\n\n\n"]


def documents(spark, texts, first=1, extra=True):
    """Texts as documents 1, 2, ...; with columns whose names clash with what operators might use inside."""
    rows = [(i, t, "en", "src0", len(t) if t else 0, "k", i, 1.5) for i, t in enumerate(texts, first)]
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, pos long, score double"
    df = spark.createDataFrame(rows, schema)
    return df if extra else df.select("doc_id", "text")


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def ascii_lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, k=5):
    w = words(ascii_lower(text))
    if not w:
        return set()
    return {tuple(w)} if len(w) < k else {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}


def components(docs, threshold=(75, 100)):
    """{doc_id: (n, least reachable)} by comparing all pairs."""
    sets = {d: shingle_set(t) for d, t in docs}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = sets[a], sets[b]
            if x and y and threshold[1] * len(x & y) >= threshold[0] * len(x | y):
                r, s = sorted((root(a), root(b)))
                parent[s] = r
    return {d: (len(sets[d]), root(d)) for d in sets}


def drawn(texts, labels, most, learnable=lambda d: True, max_chars=50_000):
    """(text, label) that a model is fitted on: of each label the ``most`` documents whose 64-bit hash of the id is least."""
    hashed = lambda d: int.from_bytes(xxhash.xxh64_digest(int(d).to_bytes(8, "little"), 42), "big", signed=True)
    out = []
    for y in sorted(set(labels.values())):
        ids = sorted((d for d, v in labels.items() if v == y and learnable(d)), key=lambda d: (hashed(d), d))[: most if isinstance(most, int) else most.get(y, 0)]
        out += [(d, texts[d], y) for d in ids if texts.get(d) is not None and len(texts[d]) <= max_chars]
    return [(t, y) for _, t, y in sorted(out)]


def crc_fold(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5
