import random
import zlib

import numpy as np
import pytest

from tests.llm.helpers import EDGE_TEXTS, documents
from tidemark.llm import packing as p
from tidemark.llm.queries import tokenizer_path


def best_sum(counts, room):
    sums = {0}
    for n, c in counts.items():
        for _ in range(c):
            sums |= {s + n for s in sums if s + n <= room}
    return max(sums)


@pytest.mark.parametrize("seed", range(20))
def test_fullest_is_the_best_subset_sum(seed):
    rng = random.Random(seed)
    counts = {n: rng.randint(1, 4) for n in rng.sample(range(1, 40), 6)}
    room = rng.randint(1, 90)
    used = p.fullest(counts, sorted(counts), room)
    assert all(c <= counts[n] for n, c in used)
    assert sum(n * c for n, c in used) == best_sum(counts, room)


def test_plan_uses_every_piece_once():
    rng = random.Random(1)
    counts = {n: rng.randint(1, 50) for n in rng.sample(range(1, 1025), 300)}
    plan = p.minimum_bin_slack(dict(counts), 1024)
    used = {}
    for times, made in plan:
        assert sum(n * c for n, c in made) <= 1024
        for n, c in made:
            used[n] = used.get(n, 0) + c * times
    assert used == counts
    bins, least = sum(t for t, _ in plan), -(-sum(n * c for n, c in counts.items()) // 1024)
    assert bins <= max(least * 1.03, least + 1) or bins <= sum(c for n, c in counts.items() if n > 512) * 1.03


def test_round_trip(spark):
    from tokenizers import Tokenizer

    given = [*EDGE_TEXTS, "<|endoftext|> in a text", "again", "again", " ".join(str(i) for i in range(4000))]
    out = p.pack_documents(documents(spark, given), str(tokenizer_path())).collect()
    encode = Tokenizer.from_file(str(tokenizer_path()))
    by_doc, by_bin = {}, {}
    for r in out:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_bin.setdefault(r.sequence_id, []).append(r)
    for i, text in enumerate(given, 1):
        pieces = sorted(by_doc[i], key=lambda r: r.piece)
        ids = encode.encode(text or "", add_special_tokens=False).ids + [2]
        assert [t for r in pieces for t in r.token_ids] == ids
        assert [r.piece for r in pieces] == list(range(len(pieces)))
        assert all(r.length == 1024 for r in pieces[1:])
        assert [r.start for r in pieces] == list(np.cumsum([0, *[r.length for r in pieces]])[:-1])
        assert all(r.ids_crc32 == zlib.crc32(np.array(r.token_ids, "<u4").tobytes()) for r in pieces)
    for pieces in by_bin.values():
        end = 0
        for r in sorted(pieces, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= 1024
    total = sum(r.length for r in out)
    assert len(by_bin) <= -(-total // 1024) + 1


def test_empty_table_and_repeated_rows(spark):
    assert p.pack_documents(documents(spark, []), str(tokenizer_path())).count() == 0
    twice = documents(spark, ["same text"]).union(documents(spark, ["same text"]))
    out = p.pack_documents(twice, str(tokenizer_path())).collect()
    assert len(out) == 2 and len({(r.sequence_id, r.offset) for r in out}) == 2


def test_ids_are_those_of_tokenizers_on_the_corpus(spark):
    """Every document of a table, against the tokenizers library itself."""
    from tokenizers import Tokenizer

    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    encode = Tokenizer.from_file(str(tokenizer_path()))
    rows = docs.collect()
    want = {}
    for r, e in zip(rows, encode.encode_batch([r.text or "" for r in rows], add_special_tokens=False), strict=True):
        ids = [*e.ids, 2]
        first = (len(ids) - 1) % 1024 + 1
        for k, (a, b) in enumerate(zip([0, *range(first, len(ids), 1024)], range(first, len(ids) + 1, 1024), strict=True)):
            want[r.doc_id, k] = (a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes()))
    got = {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in p.pack_documents(docs, str(tokenizer_path()), with_ids=False).collect()}
    assert got == want


def test_full_pieces_and_clashing_columns(spark):
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long, salt int, rank int, count int"
    rows = [(i, 0, 0, 1024 if i % 3 else 500 + i, i, 0, 0, 0) for i in range(60)]
    out = p.pack_pieces(spark.createDataFrame(rows, kind).repartition(4)).collect()
    assert sorted(tuple(r)[:8] for r in out) == rows
    alone = [r for r in out if r.length == 1024]
    assert len({r.sequence_id for r in alone}) == 40 == len(alone) and all(r.offset == 0 for r in alone)
    assert not {r.sequence_id for r in alone} & {r.sequence_id for r in out if r.length < 1024}


@pytest.mark.parametrize("change", [("normalizer", {"type": "NFC"}), ("pre_tokenizer", {"type": "Whitespace"}), ("pre_tokenizer", {"type": "ByteLevel", "add_prefix_space": True}), ("pre_tokenizer", {"type": "ByteLevel", "use_regex": False}), ("added_tokens", [{"id": 9, "content": "x", "lstrip": True}]), ("merges", 1), ("byte_fallback", True)])
def test_other_tokenizers_are_refused(change):
    import copy
    import json

    with open(tokenizer_path(), encoding="utf-8") as f:
        spec = json.load(f)
    p.refuse_other_forms(spec)
    spec, (key, value) = copy.copy(spec), change
    if key == "merges":
        m = spec["model"]["merges"]
        spec["model"] = spec["model"] | {"merges": [m[1], m[0], *m[2:]]}
    elif key == "byte_fallback":
        spec["model"] = spec["model"] | {key: value}
    else:
        spec[key] = value
    with pytest.raises(ValueError):
        p.refuse_other_forms(spec)
