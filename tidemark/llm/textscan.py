"""Vectorised scanning of Arrow string columns: word bounds, word hashes and shingle hashes, with no string objects.

All work is done on the UTF-8 bytes of a slice of whole documents. A word's hash is a multilinear one over its bytes
with pseudo-random multipliers by position, then mixed; 64 bits, the same in every process.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; a longer document is a slice of its own.
SLICE_BYTES = 3 << 20


def mix(x: np.ndarray) -> np.ndarray:
    """The published finaliser of splitmix64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def stream(n: int, seed: int) -> np.ndarray:
    """n pseudo-random words."""
    with np.errstate(over="ignore"):
        return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed) * np.uint64(1 << 40)) * np.uint64(0x9E3779B97F4A7C15))


_BYTE = stream(256, 1)
_BY_PLACE = [stream(1 << 12, 2) | np.uint64(1)]
_STEP = stream(64, 3) | np.uint64(1)


def _place(n: int) -> np.ndarray:
    if n > len(_BY_PLACE[0]):
        _BY_PLACE[0] = stream(1 << (n - 1).bit_length(), 2) | np.uint64(1)
    return _BY_PLACE[0]


def separators(codes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(codes)] = True
    return table


#: Space and U+0009..U+000D.
WHITESPACE = separators([0x20, *range(0x09, 0x0E)])
#: All of ASCII but letters and digits.
NOT_ALNUM = separators([b for b in range(128) if not chr(b).isalnum()])

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


@dataclass
class Slice:
    """Documents first..first+n of a batch: their bytes and where each begins."""

    first: int
    data: np.ndarray
    offsets: np.ndarray

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def lowered(self, latin: bool = False) -> "Slice":
        """A-Z in lower case, and with ``latin`` U+00C0..U+00DE too; no byte moves."""
        data = _LOWER[self.data]
        if latin:
            at = np.flatnonzero(data[:-1] == 0xC3) + 1
            at = at[(data[at] >= 0x80) & (data[at] <= 0x9E) & (data[at] != 0x97)]
            data[at] += 0x20
        return Slice(self.first, data, self.offsets)


def slices(column: pa.Array, limit: int = SLICE_BYTES, most: int = 1 << 16) -> Iterator[Slice]:
    """Whole documents, about ``limit`` bytes and at most ``most`` documents at a time; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.fill_null("")
    if not len(column):
        return
    wide = pa.types.is_large_string(column.type)
    _, where, data = column.buffers()
    at = np.frombuffer(where, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = min(max(a + 1, int(np.searchsorted(at, at[a] + limit, "right")) - 1), a + most, len(column))
        yield Slice(a, whole[at[a] : at[b]], at[a : b + 1] - at[a])
        a = b


@dataclass
class Words:
    """starts/ends: byte positions; bounds[d]:bounds[d+1] are document d's words; hashes by word."""

    starts: np.ndarray
    ends: np.ndarray
    bounds: np.ndarray
    hashes: np.ndarray

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)


def word_spans(part: Slice, sep: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends, document bounds, and which bytes are in words. No word crosses documents."""
    n = len(part.data)
    inside = ~sep[part.data]
    edge = np.zeros(n + 1, bool)
    edge[part.offsets] = True
    before = np.empty(n, bool)
    before[:1] = False
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1:] = False
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, part.offsets), inside


def words(part: Slice, sep: np.ndarray) -> Words:
    starts, ends, bounds, inside = word_spans(part, sep)
    if not len(starts):
        return Words(starts, ends, bounds, np.zeros(0, np.uint64))
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(first, lengths)
    with np.errstate(over="ignore"):
        value = _BYTE[part.data[inside]] * _place(int(lengths.max()))[place]
        total = np.add.reduceat(value, first) + lengths.astype(np.uint64)
    return Words(starts, ends, bounds, mix(total))


def runs(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within a document, and the index of each run's first word."""
    n = len(w.hashes)
    if n < k:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    left = np.repeat(w.bounds[1:], w.counts()) - np.arange(n)
    at = np.flatnonzero(left[: n - k + 1] >= k)
    with np.errstate(over="ignore"):
        total = np.zeros(n - k + 1, np.uint64)
        for j in range(k):
            total += w.hashes[j : n - k + 1 + j] * _STEP[j]
    return mix(total[at]), at


def shingles(w: Words, k: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a document's k-word shingles and the document of each; fewer words: all of them as one; none: nothing."""
    full, at = runs(w, k)
    counts = w.counts()
    found, owner = [full], [np.searchsorted(w.bounds, at, "right") - 1]
    for short in range(1, k):
        docs = np.flatnonzero(counts == short)
        if len(docs):
            with np.errstate(over="ignore"):
                total = np.full(len(docs), short, np.uint64)
                for j in range(short):
                    total += w.hashes[w.bounds[docs] + j] * _STEP[j]
            found.append(mix(total ^ np.uint64(0x5851F42D4C957F2D)))
            owner.append(docs)
    return np.concatenate(found), np.concatenate(owner).astype(np.int64)
