"""Best-fit packing by minimum bin slack.

For each bin the longest waiting piece is fixed and a bitset dynamic program over the lengths still available finds
the fullest combination that holds it; the combination is removed and the next bin begins. Only how many pieces of
each length wait matters to that search, so it runs once on the histogram of lengths: at most ``capacity`` counts,
whatever the corpus size. A combination found is taken as many times as the counts allow, which is what bin-by-bin
search would do, since it stays the fullest one until a count runs out.

The histogram is kept by (length, salt), so ranking the pieces of one length, however common, is shared by many tasks.
Pieces as long as a sequence fill one each and need neither search nor rank.

Defined results: a null or empty text is the end token alone; very long texts are tokenised whole and cut into pieces;
repeated rows, rows with equal or null ids among them, are packed as pieces of their own; which of equally long pieces
goes where is told by doc_id, piece and what else is known of them, and does not matter to the fill; no documents give
no rows; columns beside doc_id and text, whatever their names, are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import persist

SALTS = 256


# --- tokens -------------------------------------------------------------------------------------------------------
@lru_cache(maxsize=2)
def _encoder(path: str):
    """The vocabulary of a byte-level BPE ``tokenizers`` file, run by tiktoken, which gives the same ids about four
    times as fast. Added tokens found in a text get their ids, as with ``tokenizers`` by default."""
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    refuse_other_forms(spec)
    shown = _byte_alphabet()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    ranks = {bytes(shown[c] for c in token): rank for token, rank in spec["model"]["vocab"].items() if token not in special}
    return tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)


def refuse_other_forms(spec: dict) -> None:
    """ValueError unless ids come out as modelled here: plain byte-level BPE whose merges stand in the order of their ids."""
    pre, model, added = spec.get("pre_tokenizer") or {}, spec["model"], spec.get("added_tokens") or []
    wrong = [
        ("a normalizer", spec.get("normalizer") is not None),
        ("a model other than BPE", model.get("type", "BPE") != "BPE"),
        ("dropout, byte fallback or affixes", any(model.get(k) for k in ("dropout", "byte_fallback", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))),
        ("a pre-tokenizer other than byte-level with its own pattern", pre.get("type") != "ByteLevel" or not pre.get("use_regex", True)),
        ("add_prefix_space", bool(pre.get("add_prefix_space"))),
        ("added tokens that strip or want words", any(t.get(k) for t in added for k in ("lstrip", "rstrip", "single_word"))),
    ]
    names = [m if isinstance(m, str) else " ".join(m) for m in model["merges"]]
    ids = [model["vocab"].get(m.replace(" ", "", 1), -1) for m in names]
    wrong.append(("merges whose order is not that of ids", any(b <= a for a, b in zip(ids, ids[1:], strict=False)) or -1 in ids))
    if bad := [what for what, is_so in wrong if is_so]:
        raise ValueError(f"this tokenizer file has {', '.join(bad)}")


def _byte_alphabet() -> dict[str, int]:
    """The published printable stand-ins of byte-level BPE: printable Latin-1 stands for itself, the rest follows U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    table = {chr(b): b for b in plain}
    table.update({chr(0x100 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))})
    return table


def _pieces(path: str, capacity: int, end_id: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(path)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 256):
                where, number, starts, lengths, sums, tokens = [], [], [], [], [], []
                for i, text in enumerate(texts[at : at + 256].to_pylist(), at):
                    got = np.array([*encoder.encode(text or "", allowed_special="all"), end_id], "<u4")
                    first = (len(got) - 1) % capacity + 1
                    cuts = [0, *range(first, len(got) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        where.append(i)
                        number.append(k)
                        starts.append(a)
                        lengths.append(b - a)
                        sums.append(zlib.crc32(got[a:b].tobytes()))
                        if with_ids:
                            tokens.append(got[a:b].astype(np.int32))
                out = [ids.take(pa.array(where, pa.int64())), pa.array(number, pa.int32()), pa.array(starts, pa.int64()), pa.array(lengths, pa.int64()), pa.array(sums, pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if with_ids:
                    out.append(pa.array(tokens, pa.list_(pa.int32())))
                    names.append("token_ids")
                yield pa.RecordBatch.from_arrays(out, names)

    return run


def tokenize_pieces(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = False) -> DataFrame:
    """Whole documents as ids plus an end id, cut into pieces of ``capacity`` ids where longer; the first may be shorter."""
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", token_ids array<int>" if with_ids else "")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_pieces(tokenizer, capacity, end_id, with_ids), kind)


# --- the search ---------------------------------------------------------------------------------------------------
def fullest(counts: dict[int, int], lengths: list[int], room: int) -> list[tuple[int, int]]:
    """The (length, times) whose sum is the largest not over ``room``, by bitset subset-sum.

    Bit s of ``reach`` says that s can be made. Lengths enter from long to short, each in binary-split multiples, and
    the search ends as soon as the room is filled, so short pieces stay for bins that need them.
    """
    reach, mask, steps = 1, (1 << (room + 1)) - 1, []
    for k in range(bisect_left(lengths, room + 1) - 1, -1, -1):
        length = lengths[k]
        left, unit = min(counts[length], room // length), 1
        while left > 0:
            take = min(unit, left)
            steps.append((reach, length, take))
            reach |= (reach << (length * take)) & mask
            left, unit = left - take, unit * 2
        if reach >> room & 1:
            break
    at, used = reach.bit_length() - 1, {}
    for before, length, take in reversed(steps):
        if not before >> at & 1:
            used[length] = used.get(length, 0) + take
            at -= length * take
    return sorted(used.items(), reverse=True)


def minimum_bin_slack(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """(times, [(length, pieces of it in one bin)]) for all pieces counted. A bin holds the longest piece still there."""
    counts = {n: c for n, c in counts.items() if c}
    lengths, plan = sorted(counts), []
    while lengths:
        seed = lengths[-1]
        counts[seed] -= 1
        rest = dict(fullest(counts, lengths, capacity - seed)) if capacity > seed else {}
        counts[seed] += 1
        rest[seed] = rest.get(seed, 0) + 1
        times = min(counts[n] // c for n, c in rest.items())
        plan.append((times, sorted(rest.items(), reverse=True)))
        for n, c in rest.items():
            counts[n] -= c * times
            if not counts[n]:
                del counts[n]
                lengths.pop(bisect_left(lengths, n))
    return plan


def _places(plan) -> dict[int, tuple[np.ndarray, ...]]:
    """For each length: where runs of ranks begin, their first bin, pieces in a bin, and offset of the first."""
    found: dict[int, list[tuple[int, int, int, int]]] = {}
    ranks: dict[int, int] = {}
    first_bin = 0
    for times, made in plan:
        offset = 0
        for length, per in made:
            found.setdefault(length, []).append((ranks.get(length, 0), first_bin, per, offset))
            ranks[length] = ranks.get(length, 0) + times * per
            offset += length * per
        first_bin += times
    return {n: tuple(np.array(c, np.int64) for c in zip(*runs, strict=True)) for n, runs in found.items()}


def _assign(places, offsets: dict[int, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, salt, rank = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("length", "__tm_salt", "__tm_rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            edges = np.flatnonzero(np.diff(length[order], prepend=-1, append=-1))
            for a, b in zip(edges, edges[1:], strict=False):
                rows = order[a:b]
                n = int(length[rows[0]])
                begin, bin0, per, off = places[n]
                r = rank[rows] - 1 + offsets[n][salt[rows]]
                k = np.searchsorted(begin, r, "right") - 1
                j = r - begin[k]
                sequence[rows] = bin0[k] + j // per[k]
                offset[rows] = off[k] + (j % per[k]) * n
            keep = [i for i, n in enumerate(batch.schema.names) if not n.startswith("__tm_")]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in keep), pa.array(sequence), pa.array(offset)], [*(batch.schema.names[i] for i in keep), "sequence_id", "offset"])

    return run


def pack_pieces(pieces: DataFrame, capacity: int = 1024) -> DataFrame:
    """``pieces`` (doc_id, piece, length, ...) with sequence_id and offset; every column given is kept.

    The pieces are written once to shared storage. To the driver go at most ``capacity * SALTS`` counts.
    """
    fixed = persist(pieces.withColumn("__tm_salt", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(SALTS)).cast("int")), "pieces")
    rest = fixed.where(F.col("length") < capacity)
    counts = rest.groupBy("length", "__tm_salt").count().collect()
    total: dict[int, int] = {}
    offsets: dict[int, np.ndarray] = {}
    for length, salt, n in sorted(tuple(r) for r in counts):
        offsets.setdefault(length, np.zeros(SALTS, np.int64))[salt] = total.get(length, 0)
        total[length] = total.get(length, 0) + n
    places = _places(minimum_bin_slack(total, capacity))
    order = [c for c in ("doc_id", "piece", "start", "ids_crc32") if c in fixed.columns]
    ranked = rest.withColumn("__tm_rank", F.row_number().over(Window.partitionBy("length", "__tm_salt").orderBy(*order)))
    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema]
    packed = ranked.mapInArrow(_assign(places, offsets), ", ".join([*kept, "sequence_id long", "offset long"]))
    # full pieces: a number below zero each, which no bin has
    full = fixed.where(F.col("length") >= capacity).drop("__tm_salt")
    full = full.withColumn("sequence_id", -1 - F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    return packed.unionByName(full)


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 1024, end_id: int = 2, with_ids: bool = True) -> DataFrame:
    """Tokenise, cut and pack. With ``with_ids`` every piece carries its token ids, ready to be written as sequences."""
    return pack_pieces(tokenize_pieces(docs, tokenizer, capacity, end_id, with_ids), capacity)
