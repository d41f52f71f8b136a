"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact verification.

Benchmark items and documents become hashes of k-word shingles (k is five, or the item's length where that is less).
For every item size, each window of that size that shares a shingle with some item gets a 256-bit SimHash; windows that
share none have similarity zero. A shingle weighs the square root of how often it occurs, because then the cosine of two
weight vectors is at least 2J/(1+J) for weighted Jaccard J, whatever the weights are: similarity 0.75 means a cosine of
6/7 or more, so 44 differing bits are expected and 63 is the radius, over three standard deviations more.
Measured at the threshold itself, 99.8 % of pairs are within it (99.6 % of pairs that repeat shingles); above 0.8 all are.

The fingerprint is cut into 16 blocks of 16 bits. By the pigeonhole principle two fingerprints within the radius agree in
some block up to three bits. The index is, for every item size and block, the sorted table of all values up to three
bits from an item's block, so a look-up finds all fingerprints within the radius and about one in six of those far away,
which the whole distance then rejects. Candidates are verified by weighted Jaccard similarity of their shingles, exactly,
and the best window of each pair is reported (the earliest of equal ones).

Items are sent to every task in blocks of at most ``ITEM_SHINGLES`` shingles and ``ITEMS_HELD`` items, checked; a worker
builds their tables once. A larger benchmark is taken block by block, with one pass over the documents for each, and
loses nothing.

Defined results: null or empty texts, on either side, match nothing; words are maximal runs of letters and digits (and
of anything outside ASCII), lower-cased; a document shorter than an item is one window; very long documents are scanned
whole, in stretches of bounded size; repeated rows are matched one by one, and equal (doc_id, item_id) rows appear as
often as the document does; empty tables on either side give no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cached_property
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.textscan import NOT_ALNUM, Slice, Words, mix, runs, slices, words

#: Items and shingles of items that a task holds at once (about 45 kB of tables for an item, 100 bytes for a shingle).
ITEMS_HELD, ITEM_SHINGLES = 2_000, 500_000
#: Largest Hamming distance, of 256, at which a window is a candidate.
RADIUS = 63
_BLOCKS, _PER_BLOCK = 16, 3
#: Windows that are fingerprinted at once.
_STRETCH = 2048


def _signs(hashes: np.ndarray) -> np.ndarray:
    """256 signs (+1, -1) for each hash."""
    parts = [hashes, *(mix(hashes ^ np.uint64(seed)) for seed in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5))]
    return np.unpackbits(np.stack(parts, 1).astype("<u8").view(np.uint8).reshape(len(hashes), 32), axis=1).view(np.int8) * 2 - 1


def simhash(sums: np.ndarray) -> np.ndarray:
    """Fingerprints, 32 bytes each, from sums of signs."""
    return np.packbits(sums > 0, axis=1)


def fingerprint(hashes: np.ndarray) -> np.ndarray:
    """Of one multiset of shingles."""
    kinds, counts = np.unique(hashes, return_counts=True)
    return simhash((np.sqrt(counts)[None] @ _signs(kinds)).round(9))


def window_prints(own: np.ndarray, size: int) -> np.ndarray:
    """Of all windows of ``size``. Those without a repeated shingle come from running sums, the others one by one."""
    run = np.concatenate([np.zeros((1, 256), np.int32), np.cumsum(_signs(own), 0, dtype=np.int32)])
    prints = simhash(run[size:] - run[: len(run) - size])
    order = np.argsort(own, kind="stable")
    again = np.flatnonzero(own[order][1:] == own[order][:-1])
    first, second = order[again], order[again + 1]
    near = second - first < size
    mark = np.zeros(len(prints) + 1, np.int64)
    np.add.at(mark, np.maximum(second[near] - size + 1, 0), 1)
    np.add.at(mark, np.minimum(first[near], len(prints) - 1) + 1, -1)
    for k in np.flatnonzero(np.cumsum(mark[:-1]) > 0).tolist():
        prints[k] = fingerprint(own[k : k + size])
    return prints


#: All 16-bit words with at most ``_PER_BLOCK`` bits set.
_FLIPS = np.array([sum(1 << b for b in flips) for r in range(_PER_BLOCK + 1) for flips in combinations(range(16), r)], np.uint16)


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(np.ascontiguousarray(a ^ b).view(np.uint64)).sum(1, dtype=np.int64)


class ItemIndex:
    """Items of one shingle width: fingerprints, the blocks' sorted tables, and the shingles to verify with."""

    def __init__(self, width: int, items: list[tuple[int, np.ndarray]]):
        self.width = width
        self.ids = [i for i, _ in items]
        self.sizes = np.array([len(h) for _, h in items])
        self.counts = [dict(zip(*(x.tolist() for x in np.unique(h, return_counts=True)), strict=True)) for _, h in items]
        self.prints = np.concatenate([fingerprint(h) for _, h in items])
        self.vocabulary = np.unique(np.concatenate([h for _, h in items]))
        low = np.zeros(1 << 20, bool)
        low[(self.vocabulary & np.uint64((1 << 20) - 1)).astype(np.int64)] = True
        self.low = low
        self.by_size: dict[int, np.ndarray] = {int(n): np.flatnonzero(self.sizes == n) for n in np.unique(self.sizes)}
        self.words_of = {n: np.unique(np.concatenate([items[m][1] for m in members])) for n, members in self.by_size.items()}
        # tables[n][b]: sorted values, and of which of the items of n shingles block b is at most three bits from each
        self.tables: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
        for n, members in self.by_size.items():
            blocks = self.prints[members].view("<u2")
            self.tables[n] = []
            for b in range(_BLOCKS):
                near = (blocks[:, b, None] ^ _FLIPS).ravel()
                order = np.argsort(near, kind="stable")
                self.tables[n].append((near[order], (order // len(_FLIPS)).astype(np.uint16)))

    def known(self, hashes: np.ndarray) -> np.ndarray:
        """Which hashes are shingles of items."""
        at = np.flatnonzero(self.low[(hashes & np.uint64((1 << 20) - 1)).astype(np.int64)])
        k = np.searchsorted(self.vocabulary, hashes[at])
        hit = self.vocabulary[np.minimum(k, len(self.vocabulary) - 1)] == hashes[at]
        return at[hit]

    def met(self, n: int, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, which of the items of n shingles) that agree in some block up to three bits."""
        blocks, many = np.ascontiguousarray(prints).view("<u2"), len(self.by_size[n])
        codes = []
        for b, (values, owner) in enumerate(self.tables[n]):
            lo, hi = np.searchsorted(values, blocks[:, b], "left"), np.searchsorted(values, blocks[:, b], "right")
            count = hi - lo
            inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            codes.append(np.repeat(np.arange(len(blocks)), count) * many + owner[np.repeat(lo, count) + inside])
        found = np.unique(np.concatenate(codes))
        return found // many, found % many

    def candidates(self, n: int, prints: np.ndarray) -> Iterator[tuple[int, int]]:
        """(window, item) within the radius, for items of n shingles."""
        members = self.by_size[n]
        w, k = self.met(n, prints)
        close = distance(self.prints[members[k]], prints[w]) <= RADIUS
        yield from zip(w[close].tolist(), members[k[close]].tolist(), strict=True)


def weighted_jaccard(a: dict[int, int], b: dict[int, int]) -> float:
    """Sum of lesser over sum of greater weights; a shingle's weight is how often it occurs."""
    small, large = (a, b) if len(a) <= len(b) else (b, a)
    both = sum(min(w, large.get(h, 0)) for h, w in small.items())
    total = sum(a.values()) + sum(b.values()) - both
    return both / total if total else 0.0


def _windows(near: np.ndarray, length: int, total: int) -> np.ndarray:
    """Starts of windows of ``length`` in a row of ``total`` shingles that hold one of the sorted positions ``near``."""
    if total <= length:
        return np.zeros(1, np.int64)
    lo, hi = np.maximum(near - length + 1, 0), np.minimum(near, total - length)
    mark = np.zeros(total - length + 2, np.int64)
    np.add.at(mark, lo, 1)
    np.add.at(mark, hi + 1, -1)
    return np.flatnonzero(np.cumsum(mark[:-1]) > 0)


def _scan(index: ItemIndex, w: Words, threshold: float) -> Iterator[tuple[int, int, float, int, int]]:
    """(document, item id, similarity, first word, words) of the best window of each pair at the threshold or above."""
    hashes, at = runs(w, index.width)
    hits = index.known(hashes)
    if not len(hits):
        return
    owner = np.searchsorted(w.bounds, at[hits], "right") - 1
    for d in np.unique(owner).tolist():
        a, b = np.searchsorted(at, w.bounds[d]), np.searchsorted(at, w.bounds[d + 1])
        own, near = hashes[a:b], hits[owner == d] - a
        best: dict[int, tuple[float, int, int]] = {}
        for n in index.by_size:
            # items of other sizes do not matter here, and windows that share nothing with these have similarity zero
            touching = near[np.isin(own[near], index.words_of[n])]
            if not len(touching):
                continue
            for start, end in _stretches(_windows(touching, n, len(own)), n, len(own)):
                size = min(n, end - start)
                for k, item in index.candidates(n, window_prints(own[start:end], size)):
                    there = own[start + k : start + k + size].tolist()
                    counts: dict[int, int] = {}
                    for h in there:
                        counts[h] = counts.get(h, 0) + 1
                    s = weighted_jaccard(counts, index.counts[item])
                    if s >= threshold and s > best.get(item, (0.0,))[0]:
                        best[item] = s, start + k, size + index.width - 1
        for item, (s, first, size) in sorted(best.items()):
            yield d, index.ids[item], s, first, size


def _stretches(starts: np.ndarray, n: int, total: int) -> Iterator[tuple[int, int]]:
    """Runs of neighbouring window starts, at most ``_STRETCH`` of them, as (first shingle, end)."""
    cuts = np.flatnonzero(np.diff(starts) > 1)
    for a, b in zip(np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(starts) - 1]]), strict=True):
        for c in range(int(a), int(b) + 1, _STRETCH):
            yield int(starts[c]), min(int(starts[min(c + _STRETCH - 1, int(b))]) + n, total)


def _one(text: str) -> Words:
    data = np.frombuffer((text or "").encode(), np.uint8)
    return words(Slice(0, data, np.array([0, len(data)])), NOT_ALNUM)


def item_shingles(items: list[tuple[int, str]], width: int = 5) -> dict[int, list[tuple[int, np.ndarray]]]:
    """Items by shingle width: ``width``, or the item's number of words where that is less. Texts are lower-cased."""
    found: dict[int, list[tuple[int, np.ndarray]]] = {}
    for item_id, text in items:
        w = _one(text)
        k = min(width, len(w.hashes))
        if k:
            found.setdefault(k, []).append((item_id, runs(w, k)[0]))
    return found


class Items:
    """What is sent to the tasks: items by shingle width. Their indexes are built where they are used, once for a worker."""

    def __init__(self, by_width: dict[int, list[tuple[int, np.ndarray]]]):
        self.by_width = by_width

    @cached_property
    def indexes(self) -> list[ItemIndex]:
        return [ItemIndex(n, items) for n, items in sorted(self.by_width.items())]


def _matcher(held, threshold: float):
    schema = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        indexes = held.value.indexes
        for batch in batches:
            ids, rows = batch.column(0), []
            for part in slices(batch.column(1)):
                w = words(part, NOT_ALNUM)
                for index in indexes:
                    rows += [(ids[part.first + d].as_py(), *rest) for d, *rest in _scan(index, w, threshold)]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _item_blocks(benchmark: DataFrame, most: int, most_items: int) -> Iterator[list[tuple[int, str]]]:
    """The items, streamed to the driver, in blocks of at most ``most`` words (a larger item is a block of its own) and ``most_items`` items."""
    held, size = [], 0
    rows = benchmark.where("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("long"), F.lower("text"))
    for item_id, text in rows.toLocalIterator():
        n = text.count(" ") + text.count("\n") + 1
        if held and (size + n > most or len(held) >= most_items):
            yield held
            held, size = [], 0
        held.append((item_id, text))
        size += n
    if held:
        yield held


def contaminated(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, width: int = 5, item_shingles_held: int = ITEM_SHINGLES, items_held: int = ITEMS_HELD) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words) for every document that holds an item, once for each row and item."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.lower(F.col("text").cast("string")).alias("text"))
    kind = "doc_id long, item_id long, similarity double, first_word long, n_words long"
    out = spark.createDataFrame([], kind)
    for k, block in enumerate(_item_blocks(benchmark, item_shingles_held, items_held)):
        held = spark.sparkContext.broadcast(Items(item_shingles(block, width)))
        part = rows.mapInArrow(_matcher(held, threshold), kind)
        out = out.unionAll(part) if k else part
    return out


def clean_documents(docs: DataFrame, benchmark: DataFrame, threshold: float = 0.75, width: int = 5) -> DataFrame:
    """``docs`` without the documents that hold an item. Rows with a null doc_id are judged by nobody and stay."""
    bad = contaminated(docs, benchmark, threshold, width).select("doc_id").distinct()
    return docs.join(bad, "doc_id", "left_anti")
