"""Cells of one Arrow batch that are plain: a column whose values are all decimal numbers, or all ISO dates of one form,
is read by Arrow's casts as a whole. What is not plain goes on as text to the rules in :mod:`tidemark.sources.inference`,
so results do not depend on how rows fall into batches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidemark.plans.nodes import Kind

SUMMARY_DDL = "place int, kind string, n long, lo timestamp, hi timestamp, text string"
_MOMENT = pa.timestamp("us", "UTC")
_SUMMARY = pa.schema([("place", pa.int32()), ("kind", pa.string()), ("n", pa.int64()), ("lo", _MOMENT), ("hi", _MOMENT), ("text", pa.string())])
_DATES = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d{1,6})?Z?)?$"
_WORDS = pa.array(["0", "1"])  # truth values, in number columns too

Step = Callable[[pa.RecordBatch], pa.RecordBatch]


def over(step: Step):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield step(batch)

    return run


def _filled(c: pa.Array) -> pa.Array:
    """Null for blank text. Not by ``if_else``: of a slice, which the first batch of a file is, Arrow 23 loses text at the end."""
    blank = pc.equal(c, "")
    return pc.replace_with_mask(c, blank, pa.scalar(None, pa.string())) if pc.any(blank).as_py() else c


def _first(c: pa.Array) -> str:
    return next((x for x in c[:100].to_pylist() if x), "")


def numbers(c: pa.Array) -> pa.Array | None:
    """Finite decimals, null for blank text; None if a cell is anything else or could be an epoch.

    What the cast takes is decimal text, or of a number that is not finite: neither white space nor other notations.
    """
    if not re.match(r"[+-]?\.?[0-9]", _first(c)):  # a cast that fails is dear
        return None
    try:
        v = _filled(c).cast(pa.float64())
    except pa.ArrowInvalid:
        return None
    if not pc.all(pc.is_finite(v)).as_py():
        return None
    long = np.isin(pc.binary_length(c).to_numpy(zero_copy_only=False), (10, 11, 13, 14)).any()
    return None if long and pc.any(pc.match_substring_regex(c, r"^-?(\d{10}|\d{13})$")).as_py() else v


def moments(c: pa.Array) -> pa.Array | None:
    """Dates or date-times without a zone or in UTC, null for blank text; None if a cell is anything else."""
    first = _first(c)
    if not re.match(_DATES, first):
        return None
    c = _filled(c)
    if not pc.all(pc.match_substring_regex(c, _DATES)).as_py():
        return None
    try:
        return c.cast(_MOMENT) if first.endswith("Z") else c.cast(pa.timestamp("us")).cast(_MOMENT)
    except pa.ArrowInvalid:
        return None


def summary(columns: int, utc: bool) -> Step:
    """A row of counts for each kind in plain columns, or a row for each different text, of cells c0, c1, ...

    ``utc`` says that dates without a zone are in UTC; otherwise dates are left to the rules.
    """

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        parts = []
        for k in range(columns):
            c = batch.column(f"c{k}")
            if not len(c):
                continue
            rows: list[tuple]
            if utc and (v := moments(c)) is not None:
                ends = pc.min_max(v)
                rows = [(k, None, v.null_count, None, None, None), (k, str(Kind.DATETIME), len(v) - v.null_count, ends["min"].as_py(), ends["max"].as_py(), None)]
            elif (v := numbers(c)) is not None:
                words = pc.sum(pc.is_in(c, _WORDS)).as_py()
                rows = [(k, None, v.null_count, None, None, None), (k, str(Kind.BOOLEAN), words, None, None, None), (k, str(Kind.NUMBER), len(v) - v.null_count - words, None, None, None)]
            else:
                texts, counts = c.value_counts().flatten()
                n = len(texts)
                none = pa.nulls(n, _MOMENT)
                parts.append(pa.record_batch([pa.array(np.full(n, k, np.int32)), pa.nulls(n, pa.string()), counts, none, none, texts], schema=_SUMMARY))
                continue
            rows = [r for r in rows if r[2]]
            parts.append(pa.record_batch([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(_SUMMARY)], schema=_SUMMARY))
        whole = pa.Table.from_batches(parts, _SUMMARY).combine_chunks().to_batches()
        return whole[0] if whole else pa.RecordBatch.from_arrays([pa.array([], f.type) for f in _SUMMARY], schema=_SUMMARY)

    return step


def values(kinds: dict[int, Kind], lenient: bool, utc: bool) -> Step:
    """Adds v0, v1, ... for columns of those kinds, with null as text where a column is plain and null values elsewhere."""

    def step(batch: pa.RecordBatch) -> pa.RecordBatch:
        made = dict(zip(batch.schema.names, batch.columns, strict=True))
        for k, kind in kinds.items():
            c = made[f"c{k}"]
            v = numbers(c) if kind == Kind.NUMBER else moments(c) if utc else None
            if v is not None and kind == Kind.NUMBER and not lenient:
                v = pc.if_else(pc.is_in(c, _WORDS), pa.scalar(None, pa.float64()), v)
            made[f"v{k}"] = pa.nulls(len(c), pa.float64() if kind == Kind.NUMBER else _MOMENT) if v is None else v
            if v is not None:
                made[f"c{k}"] = pa.nulls(len(c), pa.string())
        return pa.RecordBatch.from_arrays(list(made.values()), list(made))

    return step
