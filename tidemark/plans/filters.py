"""Rewrites of filter lists, and their compilation into one expression. All of it is driver-side and pure."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from datetime import datetime, timezone
from typing import Any

from tidemark.functions.scalars import js_text
from tidemark.plans.nodes import NO_LABEL, TAG_COLUMN, Filter, Group, Node, Op, Predicate

Filters = Sequence[Filter]


def _blank(value: Any) -> bool:
    return value is None or (isinstance(value, str) and not value.strip())


def is_complete(f: Filter) -> bool:
    """Enabled, with a column, an operator and a value; a range needs one of its bounds."""
    if not f.enabled or not f.column or not f.op:
        return False
    if f.op in (Op.BETWEEN, Op.RANGE) and f.column != TAG_COLUMN:
        return not (_blank(f.value) and _blank(f.value2))
    return not _blank(f.value)


def compile_filters(filters: Filters) -> Group | None:
    """One ``and`` of all complete filters. Equalities on one column with one case flag become alternatives, after the
    rest and in order of their first; label equalities stay apart, and the no-label value becomes null."""
    loose: list[Node] = []
    equal: dict[tuple[str, bool], list[Predicate]] = {}
    for f in filter(is_complete, filters):
        labels = f.column == TAG_COLUMN
        p = Predicate(f.column, Op(f.op), None if labels and f.value == NO_LABEL else f.value, f.value2, bool(f.case_sensitive), f.id)
        if p.op == Op.EQ and not labels:
            equal.setdefault((p.column, p.case_sensitive), []).append(p)
        else:
            loose.append(p)
    nodes = [*loose, *(ps[0] if len(ps) == 1 else Group("or", tuple(ps)) for ps in equal.values())]
    return Group("and", tuple(nodes)) if nodes else None


def _is(f: Filter, column: str, op: Op, text: str | None = None) -> bool:
    return f.column == column and f.op == op and (text is None or js_text(f.value) == text)


def filter_in(filters: Filters, column: str, value: Any) -> list[Filter]:
    """Show only this cell's value: the first enabled equality on the column takes it over, else one is added."""
    value = (value or NO_LABEL) if column == TAG_COLUMN else ("" if value is None else value)
    for k, f in enumerate(filters):
        if f.enabled and _is(f, column, Op.EQ):
            if js_text(f.value) == js_text(value):
                return list(filters)
            taken = replace(f, value=value, value2=None, case_sensitive=f.case_sensitive and column != TAG_COLUMN)
            return [*filters[:k], taken, *filters[k + 1 :]]
    return [*filters, Filter(column, Op.EQ, value)]


def filter_out(filters: Filters, column: str, value: Any) -> list[Filter]:
    """Hide this cell's value, once."""
    value = (value or NO_LABEL) if column == TAG_COLUMN else ("" if value is None else value)
    if any(f.enabled and _is(f, column, Op.NEQ, js_text(value)) for f in filters):
        return list(filters)
    return [*filters, Filter(column, Op.NEQ, value)]


def toggle_value(filters: Filters, column: str, value: str) -> list[Filter]:
    """Tick or untick a value of a distribution list."""
    rest = [f for f in filters if not _is(f, column, Op.EQ, value)]
    ticked = any(f.enabled and _is(f, column, Op.EQ, value) for f in filters)
    return rest if ticked else [*rest, Filter(column, Op.EQ, value)]


def only_value(filters: Filters, column: str, value: str) -> list[Filter]:
    return [*(f for f in filters if not _is(f, column, Op.EQ)), Filter(column, Op.EQ, value)]


def show_only_label(filters: Filters, label_id: str | None) -> list[Filter]:
    return [*clear_labels(filters), Filter(TAG_COLUMN, Op.EQ, label_id or NO_LABEL)]


def exclude_label(filters: Filters, label_id: str | None) -> list[Filter]:
    value = label_id or NO_LABEL
    return [*(f for f in filters if not _is(f, TAG_COLUMN, Op.NEQ, value)), Filter(TAG_COLUMN, Op.NEQ, value)]


def clear_labels(filters: Filters) -> list[Filter]:
    return [f for f in filters if f.column != TAG_COLUMN]


@dataclass(frozen=True)
class LabelSummary:
    text: str
    include: tuple[str, ...]
    exclude: tuple[str, ...]


def summarise_labels(filters: Filters, names: dict[str, str]) -> LabelSummary | None:
    """What the enabled label filters show and hide, in words."""

    def name(value: Any) -> str:
        return "No label" if value in (None, NO_LABEL) else names.get(value, f"Unknown label ({value})")

    active = [f for f in filters if f.column == TAG_COLUMN and f.enabled]
    include, exclude = (tuple(name(f.value) for f in active if f.op == op) for op in (Op.EQ, Op.NEQ))
    said = [f"{word}: {', '.join(found)}" for word, found in (("Labels", include), ("Excluding", exclude)) if found]
    return LabelSummary(" • ".join(said), include, exclude) if said else None


def apply_suggestion(filters: Filters, column: str, op: Op | str, query: str, suggestion: str) -> list[Filter]:
    """The suggestion in place of the query, in every enabled filter that asked it."""

    def asked(f: Filter) -> bool:
        text = f.value.strip() if isinstance(f.value, str) else js_text(f.value)
        return f.enabled and f.column == column and f.op == op and text == query

    return [replace(f, value=suggestion) if asked(f) else f for f in filters]


def range_end_from_start(f: Filter) -> Filter:
    """A range whose end is blank takes its start's text as the end, read as the end of that period."""
    from tidemark.functions.scalars import parse_partial_datetime

    if f.op not in (Op.BETWEEN, Op.RANGE) or _blank(f.value) or not _blank(f.value2):
        return f
    end = parse_partial_datetime(f.value, is_end=True) if isinstance(f.value, str) else f.value
    return replace(f, value2=end if end != "" else None)


DAY_MS = 86_400_000


def default_filter(column: str, kind: str, min_ms: int | None = None, max_ms: int | None = None, now_ms: int | None = None) -> Filter:
    """What a new filter starts as: for datetimes the column's whole range (or the day from now), else an empty search."""
    if column == TAG_COLUMN:
        return Filter(column, Op.EQ, NO_LABEL)
    if kind != "datetime":
        return Filter(column, Op.CONTAINS, "")
    if min_ms is None or max_ms is None:
        min_ms = now_ms if now_ms is not None else int(datetime.now(timezone.utc).timestamp() * 1000)
        max_ms = min_ms + DAY_MS
    return Filter(column, Op.BETWEEN, min_ms, max_ms)
