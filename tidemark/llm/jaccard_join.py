"""Exact Jaccard self-join of documents as sets of word shingles, by skipping over set relations.

The steps:

1. *Frequencies.* Tasks hash shingles (48 bits of a 64-bit hash name one) and send each range of hashes its share, in
   blocks: sorted differences with the local number of the document. The range counts documents exactly and sends
   back only shingles that two documents hold. A shingle that is hot inside a block travels once; its document list
   goes with the block's own columns by way of one range, another for each block, so nothing gathers in one place.
2. *Prefix lists.* A set's shingles are ordered from rare to frequent. Two sets of the wanted similarity meet in a
   shingle of both prefixes, and only shared shingles are listed, with set size and position. A set whose prefix is
   all its own has no list at all.
3. *Index skipping.* An entry is skipped when the position, here and there, or the sizes leave too little overlap.
4. *Answer skipping.* Lists are cut by bands of sizes, so that members can be similar to their leader, the set that has
   the shingle earliest. It is compared with every member, and a similar one takes over the leader's answers, the
   component found so far: two sets that share their answers are never compared. What is left are entries outside the
   leader's component. They are paired with others of their list only if the overlap derived from what each shares
   with the leader can be enough, and then compared. All links between components are found so, and components are
   joined again.

Candidates from hashes are verified by exact overlap of the shared shingles, which is the whole overlap.

Defined results: null, empty or blank texts have no shingles and link with nothing; texts under five words are one
shingle; very long texts are one set like others, in a block of their own; rows with equal doc_id, repeated ones among
them, are one document that links wherever one of its texts does; a null doc_id is counted but links with nothing and
has no component; sets tied in size, position or leader are told apart by their least doc_id; an empty table gives no
rows; other columns, whatever their names, are ignored. The input must be a stored table or otherwise give the same rows
again when read again.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.components import components
from tidemark.llm.storage import drop, persist
from tidemark.llm.textscan import SLICE_BYTES, WHITESPACE, mix, shingles, slices, words

#: Shingle entries that one range of hashes should hold; sets how many ranges there are.
RANGE_ENTRIES = 1_000_000
#: Bytes of text of a block: as many for each range, between the bounds, so that a block's share of a range stays worth a row.
BLOCK_BYTES_PER_RANGE, MOST_BLOCK_BYTES = 8_000, 4 * SLICE_BYTES
#: From so many documents in a block on, a shingle's document list stays with the block.
HOT = 16
_BITS = np.uint64(48)


def _planes(values: np.ndarray, width: int) -> bytes:
    """Byte planes, lowest first, so that high bytes that are alike lie together for the shuffle's compression."""
    return np.ascontiguousarray(values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width].T).tobytes()


def _unplanes(data: bytes, width: int) -> np.ndarray:
    n = len(data) // width
    out = np.zeros((n, 8), np.uint8)
    out[:, :width] = np.frombuffer(data, np.uint8).reshape(width, n).T
    return out.reshape(-1).view("<u8")


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums modulo 2**64 of values[bounds[i]:bounds[i+1]]."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]


_BLOCK = [("range", pa.int32()), ("block", pa.int64()), ("hashes", pa.binary()), ("owners", pa.binary()), ("home", pa.struct([("doc_id", pa.list_(pa.int64())), ("n", pa.list_(pa.int64())), ("s1", pa.list_(pa.int64())), ("s2", pa.list_(pa.int64())), ("hot_hash", pa.binary()), ("hot_end", pa.list_(pa.int32())), ("hot_owner", pa.list_(pa.int32()))]))]
_BLOCK_DDL = "range int, block long, hashes binary, owners binary, home struct<doc_id:array<long>,n:array<long>,s1:array<long>,s2:array<long>,hot_hash:binary,hot_end:array<int>,hot_owner:array<int>>"


def _blocks(n_ranges: int, width: int):
    """Documents to blocks: for each range the block's shingles, sorted; with one of them, in turn, what stays home."""
    block_bytes = min(max(SLICE_BYTES, n_ranges * BLOCK_BYTES_PER_RANGE), MOST_BLOCK_BYTES)

    def range_of(short: np.ndarray) -> np.ndarray:
        return np.minimum((short.astype(np.float64) * (n_ranges / 2.0**48)).astype(np.int64), n_ranges - 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, made = TaskContext.get().partitionId(), 0
        for batch in batches:
            for part in slices(batch.column(1), block_bytes, most=1 << 15):
                ids = batch.column(0).slice(part.first, len(part))
                full, owner = shingles(words(part.lowered(), WHITESPACE), width)
                order = np.lexsort((full, owner))
                full, owner = full[order], owner[order]
                new = np.ones(len(full), bool)
                new[1:] = (full[1:] != full[:-1]) | (owner[1:] != owner[:-1])
                full, owner = full[new], owner[new]
                bounds = np.searchsorted(owner, np.arange(len(part) + 1))
                with np.errstate(over="ignore"):
                    s1, s2 = _sums(mix(full ^ np.uint64(0xA5A5)), bounds), _sums(mix(full + np.uint64(0x9E3779B97F4A7C15)), bounds)
                linked = ids.is_valid().to_numpy(zero_copy_only=False)[owner] if len(owner) else np.zeros(0, bool)
                short, owner = (full >> (np.uint64(64) - _BITS))[linked], owner[linked]
                order = np.argsort(short, kind="stable")
                short, owner = short[order], owner[order]
                begin = np.flatnonzero(np.concatenate([[True], short[1:] != short[:-1]])) if len(short) else np.zeros(0, np.int64)
                size = np.diff(np.append(begin, len(short)))
                hot = np.repeat(size >= HOT, size)
                hot_size = size[size >= HOT]
                code = np.where(hot, 0, owner + 1)
                keep = ~hot
                keep[begin] = True
                hot_hash = short[begin][size >= HOT]
                home = {
                    "doc_id": ids.to_pylist(), "n": np.diff(bounds).tolist(), "s1": s1.view(np.int64).tolist(), "s2": s2.view(np.int64).tolist(),
                    "hot_hash": _planes(hot_hash, 6), "hot_end": np.cumsum(hot_size).tolist(), "hot_owner": owner[hot].tolist(),
                }
                hot_weight = np.repeat(size, size)[keep & hot] if hot.any() else np.zeros(0, np.int64)
                short, code = short[keep], code[keep]
                weight = np.zeros(len(short), np.int64)
                weight[code == 0] = hot_weight
                places = range_of(short)
                home_range = (task * 0x9E3779B1 + made) % n_ranges
                rows = []
                for r in np.union1d(places, [home_range]).tolist():
                    a, b = np.searchsorted(places, [r, r + 1])
                    steps = np.diff(short[a:b], prepend=np.uint64(0))
                    # a hot entry says 0 and then how many documents it stands for
                    owners = np.concatenate([code[a:b], weight[a:b][code[a:b] == 0]]).astype("<u2")
                    rows.append((r, (task << 32) + made, _planes(steps, 6), owners.tobytes(), home if r == home_range else None))
                made += 1
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows, strict=True), _BLOCK, strict=True)], [n for n, _ in _BLOCK])

    return run


def _count_range(table: pa.Table) -> pa.Table:
    """Of all blocks' shares of one range: exact document counts; back goes what at least two documents hold."""
    shares = [(_unplanes(h, 6).cumsum(dtype=np.uint64), np.frombuffer(o, "<u2")) for h, o in zip(table["hashes"].to_pylist(), table["owners"].to_pylist(), strict=True)]
    sizes = [len(h) for h, _ in shares]
    hashes = np.concatenate([h for h, _ in shares]) if shares else np.zeros(0, np.uint64)
    codes = np.concatenate([o[: len(h)] for h, o in shares]).astype(np.int64)
    weight = np.ones(len(hashes), np.int64)
    weight[codes == 0] = np.concatenate([o[len(h) :] for h, o in shares])
    order = np.argsort(hashes, kind="stable")
    begin = np.flatnonzero(np.diff(hashes[order].view(np.int64), prepend=-1))
    total = np.add.reduceat(weight[order], begin) if len(begin) else np.zeros(0, np.int64)
    df = np.empty(len(hashes), np.int64)
    df[order] = np.repeat(total, np.diff(np.append(begin, len(hashes))))
    level = np.minimum(np.floor(np.log2(np.maximum(df, 1))), 63).astype(np.uint8)
    out_h, out_o, out_l = [], [], []
    for a, n in zip(np.cumsum([0, *sizes])[:-1], sizes, strict=True):
        shared = np.flatnonzero(df[a : a + n] > 1) + a
        out_h.append(_planes(hashes[shared], 6))
        out_o.append(codes[shared].astype("<u2").tobytes())
        out_l.append(level[shared].tobytes())
    return pa.table({"block": table["block"], "hashes": pa.array(out_h, pa.binary()), "owners": pa.array(out_o, pa.binary()), "levels": pa.array(out_l, pa.binary()), "home": table["home"]})


_COUNTED_DDL = _BLOCK_DDL.split(", ", 1)[1].replace("owners binary", "owners binary, levels binary")
_SET_DDL = "doc_id long, n long, s1 long, s2 long, own int, shared binary"


def _prefix(n: np.ndarray, t: Fraction) -> np.ndarray:
    """How many of the first shingles two sets of similarity t must share one of."""
    return n - -(-n * t.numerator // t.denominator) + 1


def _gather_sets(t: Fraction):
    """One block's shares, back together: for each document its shared shingles from rare to frequent."""

    def run(table: pa.Table) -> pa.Table:
        home = next(h for h in table["home"].to_pylist() if h is not None)
        hashes = np.concatenate([_unplanes(h, 6) for h in table["hashes"].to_pylist()])
        owner = np.concatenate([np.frombuffer(o, "<u2") for o in table["owners"].to_pylist()]).astype(np.int64) - 1
        level = np.concatenate([np.frombuffer(x, np.uint8) for x in table["levels"].to_pylist()])
        hot = np.flatnonzero(owner < 0)
        if len(hot):
            hot_hash = _unplanes(home["hot_hash"], 6)
            k = np.searchsorted(hot_hash, hashes[hot])
            end = np.array(home["hot_end"], np.int64)
            begin, members = np.concatenate([[0], end[:-1]]), np.array(home["hot_owner"], np.int64)
            count = end[k] - begin[k]
            inside = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            cold = owner >= 0
            owner = np.concatenate([owner[cold], members[np.repeat(begin[k], count) + inside]])
            level = np.concatenate([level[cold], np.repeat(level[hot], count)])
            hashes = np.concatenate([hashes[cold], np.repeat(hot_hash[k], count)])
        order = np.lexsort((hashes, level, owner))
        hashes, owner = hashes[order], owner[order]
        n = np.array(home["n"], np.int64)
        bounds = np.searchsorted(owner, np.arange(len(n) + 1))
        shared = np.diff(bounds)
        own = n - shared
        listed = (n > 0) & (own < _prefix(n, t)) & (shared > 0)
        flat = np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6])
        blobs = [flat[bounds[d] : bounds[d + 1]].tobytes() if listed[d] else None for d in range(len(n))]
        return pa.table({"doc_id": pa.array(home["doc_id"], pa.int64()), "n": pa.array(n), "s1": pa.array(home["s1"], pa.int64()), "s2": pa.array(home["s2"], pa.int64()), "own": pa.array(own.astype(np.int32)), "shared": pa.array(blobs, pa.binary())})

    return run


def _unpack(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.reshape(-1).view("<u8")


def document_sets(docs: DataFrame, t: Fraction, width: int) -> DataFrame:
    """Every row's doc_id, set size n, 128-bit name of the set, and for sets that may link: how many shingles are theirs
    alone and the shared ones from rare to frequent, 6 bytes each."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    stored = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    if stored >= 1 << 53:  # the plan does not know its size
        stored = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_ranges = max(16, stored // 4 // RANGE_ENTRIES)  # about four stored bytes for each word
    blocks = rows.mapInArrow(_blocks(n_ranges, width), _BLOCK_DDL)
    counted = blocks.groupBy("range").applyInArrow(_count_range, _COUNTED_DDL)
    return counted.groupBy("block").applyInArrow(_gather_sets(t), _SET_DDL)


def _list_entries(t: Fraction):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, n, own, shared = (batch.column(c) for c in ("node", "n", "own", "shared"))
            sizes, firsts = n.to_numpy(zero_copy_only=False), own.to_numpy(zero_copy_only=False).astype(np.int64)
            for a in range(0, batch.num_rows, 256):
                tokens, where, place = [], [], []
                for i, blob in enumerate(shared[a : a + 256].to_pylist(), a):
                    listed = _unpack(blob)[: int(_prefix(sizes[i : i + 1], t)[0]) - firsts[i]]
                    tokens.append(listed)
                    where.append(np.full(len(listed), i))
                    place.append(firsts[i] + np.arange(len(listed)))
                if tokens:
                    at = np.concatenate(where)
                    yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(tokens).view(np.int64)), node.take(pa.array(at)), pa.array(sizes[at]), pa.array(firsts[at]), pa.array(np.concatenate(place))], ["token", "node", "n", "own", "pos"])

    return run


def _enough(t: Fraction, a: str, b: str):
    """The block skip: sizes fit, and what follows a first common shingle, here and there, is as much as similarity t needs.

    Two similar sets have a first common shingle, and that one passes; the others need not.
    """
    p, q = t.numerator, t.denominator
    sizes = f"{q} * {a}.n >= {p} * {b}.n AND {q} * {b}.n >= {p} * {a}.n"
    return F.expr(f"{sizes} AND {p + q} * least({a}.n - {a}.pos, {b}.n - {b}.pos) >= {p} * ({a}.n + {b}.n)")


def _derived(t: Fraction, a: str, b: str):
    """The answer skip, for two members of one leader's list: their overlap is at most the leader's shingles that both
    hold, and the rest that both may hold by their signatures. True where that is enough, or not known."""
    both = "aggregate(zip_with({0}.{2}, {1}.{2}, (v, w) -> bit_count(v & w)), 0, (s, v) -> s + v)"
    room = f"{both.format(a, b, 'held')} + {both.format(a, b, 'rest')} + least({a}.hidden, {b}.hidden)"
    return F.expr(f"{a}.held IS NULL OR {b}.held IS NULL OR {t.numerator + t.denominator} * ({room}) >= {t.numerator} * ({a}.n + {b}.n)")


def _longs(mask: np.ndarray) -> np.ndarray:
    packed = np.packbits(mask, bitorder="little")
    return np.concatenate([packed, np.zeros(-len(packed) % 8, np.uint8)]).view("<i8")


def _compare(t: Fraction):
    """Pairs with both sets, to: similar or not, and b as seen from a. ``held`` marks which of a's shingles b has;
    ``rest`` is a signature of b's others, as long, in which ``hidden`` of them coincide with another."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column("shared_a").to_pylist(), batch.column("shared_b").to_pylist()
            na, nb = batch.column("n_a").to_numpy(), batch.column("n_b").to_numpy()
            inter, held, rest, hidden = np.empty(batch.num_rows, np.int64), [], [], []
            last, own = None, None
            for i in range(batch.num_rows):
                if a[i] != last:
                    last, own = a[i], np.sort(_unpack(a[i]))
                other = _unpack(b[i])
                k = np.minimum(np.searchsorted(own, other), len(own) - 1)
                hit = own[k] == other
                inter[i] = np.count_nonzero(hit)
                mask = np.zeros(len(own), bool)
                mask[k[hit]] = True
                held.append(_longs(mask))
                sign = np.zeros(64 * len(held[-1]), bool)
                sign[(other[~hit] % np.uint64(len(sign))).astype(np.int64)] = True
                rest.append(_longs(sign))
                hidden.append(int(np.count_nonzero(~hit) - np.count_nonzero(sign)))
            similar = t.denominator * inter >= t.numerator * (na + nb - inter)
            longs = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(similar), pa.array(held, longs), pa.array(rest, longs), pa.array(hidden, pa.int32())], ["a", "b", "similar", "held", "rest", "hidden"])

    return run


def _verify(pairs: DataFrame, sets: DataFrame, t: Fraction) -> DataFrame:
    """The pairs (a, b), compared by the exact overlap of their shared shingles over the exact union."""
    left = sets.select(F.col("node").alias("a"), F.col("n").alias("n_a"), F.col("shared").alias("shared_a"))
    right = sets.select(F.col("node").alias("b"), F.col("n").alias("n_b"), F.col("shared").alias("shared_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "n_a", "n_b", "shared_a", "shared_b")
    return both.mapInArrow(_compare(t), "a long, b long, similar boolean, held array<long>, rest array<long>, hidden int")


def link_components(docs: DataFrame, threshold: Fraction = Fraction(3, 4), width: int = 5) -> DataFrame:
    """doc_id, n_shingles, component_id for every row; see the module's text for the steps.

    A component's id is the least doc_id that links reach. Links are between documents whose sets of ``width``-word
    shingles have Jaccard similarity ``threshold`` or more.
    """
    every = persist(document_sets(docs, threshold, width), "sets")
    # One row for each different set, which its copies share; the set's node is the least document that has it.
    named = persist(every.where("n > 0 AND doc_id IS NOT NULL").groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("own").alias("own"), F.first("shared").alias("shared")), "named")
    # A document of several rows whose sets differ ties them together. Usually there is none.
    several = every.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min(F.struct("s1", "s2")).alias("lo"), F.max(F.struct("s1", "s2")).alias("hi")).where("lo != hi").select("doc_id")
    several = persist(every.join(several, "doc_id").select("doc_id", "s1", "s2").join(named.select("s1", "s2", "node"), ["s1", "s2"]).select("doc_id", "node").distinct(), "several")
    sets = named.where("shared IS NOT NULL").select("node", "n", "own", "shared")
    entries = persist(sets.mapInArrow(_list_entries(threshold), "token long, node long, n long, own long, pos long"), "entries")

    # Sizes fall in bands so wide that similar sets are in one band or in neighbours. A list is a shingle and a band: the
    # sets of the band that have the shingle, one of them leading, and with them the sets of the band below.
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(1 / threshold) + 1e-9).cast("int")
    cells = entries.withColumn("below", F.explode(F.array(F.lit(False), F.lit(True)))).withColumn("band", band + F.col("below").cast("int"))
    leaders = cells.groupBy("token", "band").agg(F.min(F.when(~F.col("below"), F.struct("pos", "own", "n", "node"))).alias("l"), F.count(F.lit(1)).alias("c")).where("c > 1 AND l IS NOT NULL")
    leaders = persist(leaders.select("token", "band", F.col("l.node").alias("node"), F.col("l.n").alias("n"), F.col("l.own").alias("own"), F.col("l.pos").alias("pos")), "leaders")
    same_list = (F.col("x.token") == F.col("y.token")) & (F.col("x.band") == F.col("y.band"))
    star = cells.alias("x").join(leaders.alias("y"), same_list & (F.col("x.node") != F.col("y.node")) & _enough(threshold, "x", "y"))
    star = star.select(F.col("y.node").alias("a"), F.col("x.node").alias("b")).distinct()
    seen = persist(_verify(star, sets, threshold), "seen")
    found = components(seen.where("similar").select("a", "b").union(several))

    # What the leader's answers do not cover: entries of lists that reach over more than one component.
    cells = cells.join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    lead = leaders.select("token", "band", F.col("node").alias("lead")).join(found.withColumnRenamed("node", "lead"), "lead", "left").select("token", "band", "lead", F.coalesce("component", "lead").alias("lead_component"))
    mixed = cells.groupBy("token", "band").agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("n").alias("least")).where("c0 < c1").select("token", "band", "least")
    from_lead = seen.select(F.col("a").alias("lead"), F.col("b").alias("node"), "held", "rest", "hidden")
    # an entry that leaves too little even for the smallest set of its list meets nobody
    p, q = threshold.numerator, threshold.denominator
    cells = cells.join(mixed, ["token", "band"]).where(f"{p + q} * (n - pos) >= {p} * (n + least)").drop("least")
    open_lists = persist(cells.join(lead, ["token", "band"]).where("node != lead").join(from_lead, ["lead", "node"], "left"), "open")
    outside = open_lists.where("component != lead_component")
    apart = (F.col("x.component") != F.col("y.component")) & ~(F.col("x.below") & F.col("y.below"))
    rest = outside.alias("x").join(open_lists.alias("y"), same_list & apart & _enough(threshold, "x", "y") & _derived(threshold, "x", "y"))
    rest = rest.select(F.greatest("x.node", "y.node").alias("a"), F.least("x.node", "y.node").alias("b")).distinct()
    more = persist(_verify(rest, sets, threshold).where("similar").select("a", "b"), "more")
    joined = components(found.where("node != component").union(more)) if more.head(1) else found
    drop(entries, leaders, seen, open_lists, more, *([] if joined is found else [found]))

    of_set = named.select("s1", "s2", "node").join(joined, "node", "left").select("s1", "s2", F.coalesce("component", "node").alias("of_set"))
    of_doc = several.select("doc_id", "node").union(several.select("doc_id", "doc_id")).join(joined, "node").groupBy("doc_id").agg(F.min("component").alias("of_doc"))
    # named is written, so the join has two plain exchanges and a set with very many copies can be split
    of_set = persist(of_set, "components")
    drop(named)
    out = every.join(of_set, ["s1", "s2"], "left").join(of_doc, "doc_id", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("of_doc", "of_set", "doc_id")).alias("component_id"))
