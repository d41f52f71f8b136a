r"""Chat formatting: a finite-state machine over roles, driven by a declarative template.

The template gives, for each role, the text that opens a turn, the text that closes it, whether its body is under the
loss mask, and which roles may come before it. Bodies are escaped so that no control string can occur in them: a
backslash goes before every backslash and before the first character of every control string, and reading back drops
it again. Turns of a conversation arrive sorted, so one pass holds one turn at a time whatever the conversation's size.

Defined results: a null text is an empty one; a null role is the role ``""``; roles outside the template use its
fallback entry, with the role's name escaped in the opening; turns with equal number are ordered by role and text (null
numbers come first); repeated rows are turns of their own; rows with null ids form one conversation; texts of any length
are formatted whole; an empty table gives no rows; columns beside conv_id, turn, role and text, whatever their names, are
ignored. A conversation that breaks the turn order is formatted all the same and carries ``valid = false`` from the turn
where it broke.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class TurnStyle:
    opening: str
    loss: bool
    after: tuple[str, ...]


@dataclass(frozen=True)
class ChatTemplate:
    """``styles`` maps a role to its opening; ``mark`` begins every opening and ``close`` ends every turn."""

    styles: tuple[tuple[str, TurnStyle], ...]
    mark: str = "### "
    close: str = " </turn>\n"
    start: str = "^"

    def style(self, role: str) -> TurnStyle:
        return dict(self.styles).get(role) or TurnStyle(f"{self.mark}[{self.escape(role, ']')}]: ", False, ())

    def controls(self) -> tuple[str, ...]:
        return self.mark.rstrip(), self.close.strip()

    def escape(self, text: str, also: str = "") -> str:
        parts = [re.escape(c) for c in (*self.controls(), "\\", *also)]
        return re.sub("|".join(parts), lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


TEMPLATE = ChatTemplate((
    ("system", TurnStyle("### System: ", False, ("^",))),
    ("user", TurnStyle("### User: ", False, ("^", "system", "assistant"))),
    ("assistant", TurnStyle("### Assistant: ", True, ("user",))),
))


class _Order:
    """The machine: its state is the last role; a turn moves it on if the role may follow."""

    def __init__(self, template: ChatTemplate):
        self.template, self.state, self.ok = template, template.start, True

    def step(self, role: str) -> bool:
        self.ok = self.ok and self.state in self.template.style(role).after
        self.state = role
        return self.ok


_SEGMENTS = pa.schema([("conv_id", pa.int64()), ("turn_index", pa.int64()), ("segment", pa.int32()), ("text", pa.string()), ("loss", pa.bool_()), ("valid", pa.bool_())])
_SEGMENT_DDL = "conv_id long, turn_index long, segment int, text string, loss boolean, valid boolean"


def _segments(template: ChatTemplate):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, order, turn = False, _Order(template), 0
        conv = None
        for batch in batches:
            rows = []
            for cid, role, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if not seen or cid != conv:
                    seen, conv, order, turn = True, cid, _Order(template), 0
                role, text = role or "", text or ""
                style, valid = template.style(role), order.step(role)
                for k, (part, loss) in enumerate(((style.opening, False), (template.escape(text), style.loss), (template.close, False))):
                    rows.append((cid, turn, k, part, loss, valid))
                turn += 1
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _SEGMENTS, strict=True)], schema=_SEGMENTS)

    return run


def format_chats(conversations: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """Segments of every conversation: three for each turn (opening, body, closing), with loss flags.

    Rows are clustered by conversation and sorted inside the partition; a conversation's formatted text is its
    segments' texts joined in the order (turn_index, segment).
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"), F.col("turn").alias("__tm_t"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "__tm_t", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_segments(template), _SEGMENT_DDL)


class TurnReader:
    """Reads formatted text back, piece by piece: feed() takes text with its loss flag and yields finished turns.

    Only the text and the mask are looked at. A turn is (role, body, whether the body was under the mask).
    """

    def __init__(self, template: ChatTemplate):
        self.template, self.held, self.masked = template, [], []
        close = template.close
        self.end = re.compile(r"(?:[^\\]|\\.)*?" + re.escape(close), re.S)
        self.openings = [(style.opening, role) for role, style in template.styles]
        self.other = re.compile(re.escape(template.mark) + r"\[((?:[^\\\]]|\\.)*)\]: ", re.S)

    def feed(self, text: str, loss: bool) -> Iterator[tuple[str, str, str]]:
        self.held.append(text)
        if loss:
            self.masked.append(text)
        if not text.endswith(self.template.close):
            return
        held = "".join(self.held)
        while held and (m := self.end.match(held)):
            yield self._turn(m[0][: -len(self.template.close)])
            held = held[m.end() :]
        self.held = [held] if held else []

    def _turn(self, raw: str) -> tuple[str, str, str]:
        masked, self.masked = "".join(self.masked), []
        for opening, role in self.openings:
            if raw.startswith(opening):
                return role, unescape(raw[len(opening) :]), unescape(masked)
        m = self.other.match(raw)
        return unescape(m[1]), unescape(raw[m.end() :]), unescape(masked)


def _digest(template: ChatTemplate):
    schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        done: list[tuple] = []

        def fresh(cid):
            return {"id": cid, "reader": TurnReader(template), "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0, "valid": True, "next": (0, 0)}

        def finish(s):
            done.append((s["id"], s["n"], s["turns"].hexdigest(), s["chars"], s["loss"].hexdigest(), s["all"], s["valid"]))

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done, strict=True), schema, strict=True)], schema=schema)
            done.clear()
            return out

        for batch in batches:
            cols = [batch.column(n).to_pylist() for n in ("conv_id", "turn_index", "segment", "text", "loss", "valid")]
            for cid, turn, segment, text, loss, valid in zip(*cols, strict=True):
                if state is None or cid != state["id"]:
                    if state is not None:
                        finish(state)
                    state = fresh(cid)
                if (turn, segment) != state["next"]:
                    raise ValueError(f"conversation {cid}: segment {(turn, segment)} where {state['next']} was due; digests need segments in order")
                state["next"] = (turn, segment + 1) if segment < 2 else (turn + 1, 0)
                state["all"] += len(text)
                state["valid"] = valid
                for role, body, masked in state["reader"].feed(text, loss):
                    state["n"] += 1
                    state["turns"].update(f"{role}\n{body}\n".encode())
                    state["loss"].update(masked.encode())
                    state["chars"] += len(masked)
            if done:
                yield flush()
        if state is not None:
            finish(state)
        if done:
            yield flush()

    return run


def digest_chats(segments: DataFrame, template: ChatTemplate = TEMPLATE) -> DataFrame:
    """What a reader of the formatted text sees, one row for each conversation.

    ``segments`` must be the unshuffled output of :func:`format_chats`: each partition holds whole conversations in order.
    Where it does not, the query fails, as digests are sequential.
    """
    return segments.mapInArrow(_digest(template), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")
