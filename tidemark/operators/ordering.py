"""Sort keys with the null and tie rules of the data model."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import kind_of, natural_key
from tidemark.operators.predicates import column
from tidemark.plans.nodes import Kind, Sort


@dataclass(frozen=True)
class Key:
    """A part of the order. ``rising`` orders ascending, and ``falling`` descending, as ``key`` does in its direction.

    Text, whose order is a collation's, has only one of them.
    """

    key: Column
    descending: bool
    rising: Column | None
    falling: Column | None

    @property
    def order(self) -> Column:
        return self.key.desc() if self.descending else self.key.asc()


def sort_keys(sorts: Sequence[Sort], schema: T.StructType) -> list[Key]:
    """Keys of each known column; others are left out.

    Text goes by its natural key and null as empty text, null numbers as 0, null truth values as false. Numbers that
    are not finite come last ascending and first descending, and so do null datetimes.
    """
    keys: list[Key] = []

    def add(c: Column, down: bool, turned: Column | None) -> None:
        keys.append(Key(c, down, turned if down else c, c if down else turned))

    for s in sorts:
        if s.column not in schema.names:
            continue
        t, c, down = schema[s.column].dataType, column(s.column), s.descending
        kind = kind_of(t)
        if kind == Kind.NUMBER:
            if isinstance(t, (T.DoubleType, T.FloatType)):
                odd = F.coalesce(F.isnan(c) | (F.abs(c) == float("inf")), F.lit(False))
                add(odd, down, ~odd)
                c = F.when(odd, F.lit(0.0)).otherwise(F.coalesce(c, F.lit(0.0)))
            else:
                c = F.coalesce(c, F.lit(0).cast(t))
            add(c, down, -c)
        elif kind == Kind.BOOLEAN:
            c = F.coalesce(c, F.lit(False))
            add(c, down, ~c)
        elif kind == Kind.DATETIME:
            add(c.isNull(), down, c.isNotNull())
            add(c, down, -F.unix_micros(c.cast(T.TimestampType())))
        else:
            add(natural_key(c.cast("string")), down, None)
    return keys


def row_key(row_id: str) -> Key:
    """Ties are in the order of rows, whichever direction."""
    return Key(column(row_id), False, column(row_id), -column(row_id))


def ordering(sorts: Sequence[Sort], schema: T.StructType, row_id: str) -> list[Column]:
    """Columns for ``orderBy``; ties are in the order of rows, whichever direction."""
    return [k.order for k in sort_keys(sorts, schema)] + [column(row_id).asc()]
