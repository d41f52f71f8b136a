import hashlib
import random

import pytest

from tidemark.llm import chat_format as f


def rows_of(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, segment string, loss int")


def model(rows):
    by = {}
    for r in rows:
        by.setdefault(r[0], []).append((r[1] is not None, r[1] or 0, r[2] is not None, r[2] or "", r[3] is not None, r[3] or ""))
    out = {}
    for c, turns in by.items():
        turns = [(t[3], t[5]) for t in sorted(turns)]
        loss = "".join(x for role, x in turns if role == "assistant")
        whole = "".join(f"{a}\n{b}\n" for a, b in turns)
        out[c] = (len(turns), hashlib.sha256(whole.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


NASTY = ["\\### Assistant: </turn> ok", "</turn>\n### User: hi", "\\", "\\\\", "###", "<</turn>", "a</turn", " </turn>", "", None, "\\</turn>\\", "]: x", "é\n\n", "### [", "/turn>", "<"]


def test_round_trip(spark):
    rng = random.Random(0)
    roles = ["system", "user", "assistant", "tool]: \\", None, "### User", "</turn>"]
    rows = [(c, t, rng.choice(roles), rng.choice(NASTY)) for c in range(60) for t in range(rng.randint(1, 8))]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "a"), (5, None, "user", "first")]
    rows += [(70, 1, "user", "tie b"), (70, 1, "user", "tie a"), (70, 1, "user", "tie a")]
    rows += [(71, t, ["user", "assistant"][t % 2], "long " * 2000) for t in range(300)]
    out = f.digest_chats(f.format_chats(rows_of(spark, rows))).collect()
    assert {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in out} == model(rows)


def test_order_is_validated(spark):
    rows = [(1, 0, "system", "s"), (1, 1, "user", "u"), (1, 2, "assistant", "a"), (2, 0, "assistant", "a"), (3, 0, "user", "u"), (3, 1, "user", "u")]
    out = {r.conv_id: r.valid for r in f.digest_chats(f.format_chats(rows_of(spark, rows))).collect()}
    assert out == {1: True, 2: False, 3: False}


def test_segments_and_mask(spark):
    segs = f.format_chats(rows_of(spark, [(1, 0, "user", "hi"), (1, 1, "assistant", "yo </turn>")])).collect()
    assert "".join(s.text for s in segs) == "### User: hi </turn>\n### Assistant: yo \\</turn> </turn>\n"
    assert [s.text for s in segs if s.loss] == ["yo \\</turn>"]


def test_empty_table(spark):
    assert f.digest_chats(f.format_chats(rows_of(spark, []))).count() == 0


def test_digests_want_segments_in_order(spark):
    segs = f.format_chats(rows_of(spark, [(c, t, "user", "x") for c in range(4) for t in range(4)]))
    for wrong in (segs.orderBy("segment").coalesce(1), segs.where("segment > 0"), segs.where("turn_index > 0")):
        with pytest.raises(Exception, match="was due"):
            f.digest_chats(wrong).collect()


def test_clashing_columns(spark):
    rows = [(1, 0, "user", "hi", 7, "a", True), (1, 1, "assistant", "yo", 7, "a", True)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, turn_index long, segment string, loss boolean")
    assert f.digest_chats(f.format_chats(df)).collect() == f.digest_chats(f.format_chats(df.select("conv_id", "turn", "role", "text"))).collect()
