"""Grouping with five aggregates, groups in the order of their first rows."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import iso, kind_of
from tidemark.operators.ordering import row_key, sort_keys
from tidemark.operators.predicates import column
from tidemark.plans.nodes import Aggregation, Kind, Sort

ROWS = "rows"
_FIRST = "__tm_first"


def sanitise(aggregations: Sequence[Aggregation]) -> list[Aggregation]:
    """As a user interface should ask: only ``count`` may lack a column, aliases are trimmed, and there is a count."""
    out = []
    for a in aggregations:
        if a.op != "count" and not a.column:
            continue
        out.append(Aggregation(a.op, None if a.op == "count" else a.column, (a.alias or "").strip() or None))
    return out if any(a.op == "count" for a in out) else [*out, Aggregation()]


def aggregate(a: Aggregation, schema: T.StructType) -> Column:
    """Nulls and numbers that are not finite are passed over; sums and means of what is no number are null."""
    t = schema[a.column].dataType if a.column in schema.names else None
    if a.op == "count":
        return F.count(F.lit(1)) if not a.column else F.lit(0).cast("long") if t is None else F.count(column(a.column))
    if t is None:
        return F.lit(None).cast("double" if a.op in ("sum", "avg") else "string")
    c, kind = column(a.column), kind_of(t)
    if isinstance(t, (T.DoubleType, T.FloatType)):
        c = F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)
    if a.op in ("sum", "avg"):
        if kind != Kind.NUMBER:
            return F.lit(None).cast("double")
        return F.sum(c) if a.op == "sum" else F.avg(c)
    best = F.min(c) if a.op == "min" else F.max(c)
    return iso(best) if kind == Kind.DATETIME else best


@dataclass(frozen=True)
class Grouped:
    """``df``: keys, aggregates, and how many rows each group has, as ``rows``; in order, ready to page."""

    df: DataFrame
    keys: tuple[str, ...]
    rows: DataFrame

    def page(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        df = self.df.offset(max(0, offset)) if offset > 0 else self.df
        return df if limit is None else df.limit(max(0, limit))

    def totals(self) -> tuple[int, int]:
        """(groups, rows), from one pass."""
        got = self.rows.agg(F.count(F.lit(1)), F.sum(ROWS)).first()
        return got[0], got[1] or 0


def _struct(columns: Sequence[Column]) -> Column:
    return F.struct(*(c.alias(f"k{i}") for i, c in enumerate(columns)))


def group_by(df: DataFrame, keys: str | Sequence[str], aggregations: Sequence[Aggregation] = (), sorts: Sequence[Sort] = (), row_id: str = "__rowId") -> Grouped:
    """Groups of ``df`` by the keys, null being a key too.

    Groups come in the order in which their first rows stand under ``sorts``. That needs no order of the rows: each
    group carries the least sort key it has seen, which partial aggregation keeps small.
    """
    keys = [k for k in ([keys] if isinstance(keys, str) else keys) if k]
    if not keys:
        raise ValueError("grouping needs a column")
    made: dict[str, Column] = {}
    for a in aggregations or [Aggregation()]:
        made.pop(a.name, None)
        made[a.name] = aggregate(a, df.schema)
    schema = df.schema
    for k in keys:
        if k not in schema.names:
            df = df.withColumn(k, F.lit(None).cast("string"))
    keyed = [column(k) for k in keys]
    by_rows = [*sort_keys(sorts, schema), row_key(row_id)]
    measures = [F.count(F.lit(1)).alias(ROWS), *(c.alias(n) for n, c in made.items() if n != ROWS)]
    if all(k.rising is not None for k in by_rows):
        out = df.groupBy(*keyed).agg(*measures, F.min(_struct([k.rising for k in by_rows])).alias(_FIRST))
        by = [F.col(_FIRST).asc()]
    elif all(k.falling is not None for k in by_rows):
        out = df.groupBy(*keyed).agg(*measures, F.max(_struct([k.falling for k in by_rows])).alias(_FIRST))
        by = [F.col(_FIRST).desc()]
    else:
        # Text rises in one column and falls in another. Of the rows of a group that are alike in text the first is found
        # by partial aggregation, and only these, as many as there are texts, are ranked.
        text = {i: k for i, k in enumerate(by_rows) if k.rising is None or k.falling is None}
        others = [i for i in range(len(by_rows)) if i not in text]
        texts = [F.col(f"{_FIRST}{i}") for i in text]
        parts = df.withColumns({f"{_FIRST}{i}": k.key for i, k in text.items()}).groupBy(*keyed, *texts).agg(F.min(_struct([by_rows[i].rising for i in others])).alias(_FIRST))
        cells = {i: F.col(_FIRST)[f"k{n}"] for n, i in enumerate(others)}
        order = [cells[i].asc() if i in cells else F.col(f"{_FIRST}{i}").desc() if k.descending else F.col(f"{_FIRST}{i}").asc() for i, k in enumerate(by_rows)]
        first = parts.withColumn("__tm_at", F.row_number().over(Window.partitionBy(*keyed).orderBy(*order))).where("__tm_at = 1").drop("__tm_at")
        names = {k: f"__tm_g{n}" for n, k in enumerate(keys)}
        first = first.select(*(column(k).alias(n) for k, n in names.items()), _FIRST, *(f"{_FIRST}{i}" for i in text))
        same = reduce(Column.__and__, [column(k).eqNullSafe(F.col(n)) for k, n in names.items()])
        out, by = df.groupBy(*keyed).agg(*measures).join(first, same), order
    shown = [column(k) for k in keys] + [column(n) for n in made if n != ROWS] + [F.col(ROWS)]
    return Grouped(out.orderBy(*by).select(*shown), tuple(keys), out.select(ROWS))

