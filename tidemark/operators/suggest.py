"""Suggestions for an equality that nothing matches."""

from __future__ import annotations

import unicodedata
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.distance import may_be_within, osa_column
from tidemark.functions.scalars import JS_SPACE
from tidemark.functions.text import kind_of, norm, trimmed
from tidemark.operators.predicates import Scope, column
from tidemark.plans.nodes import TAG_COLUMN, Kind, Node, Op, Predicate, leaves

TOP = 5


@dataclass(frozen=True)
class DidYouMean:
    column: str
    op: Op
    query: str
    suggestions: tuple[str, ...]


def farthest(query: str) -> int:
    """The distance up to which a value is suggested: 2 from five characters, 1 from three, else none."""
    n = len(query.strip(JS_SPACE))
    return 2 if n >= 5 else 1 if n >= 3 else 0


def eligible(node: Node | None, scope: Scope) -> list[Predicate]:
    """Equalities of text columns with text, depth first."""

    def good(p: Predicate) -> bool:
        t = scope.type_of(p.column)
        return p.column != TAG_COLUMN and p.op == Op.EQ and isinstance(p.value, str) and bool(p.value.strip(JS_SPACE)) and (t is None or kind_of(t) == Kind.STRING)

    return [p for p in leaves(node) if good(p)]


def candidates(df: DataFrame, p: Predicate, row_id: str, composed: bool = True) -> DataFrame:
    """(value, distance, occurrences) of the values near the wanted one, best first, at most five.

    Values are counted by normal form; the shortest spelling, then the first, speaks for it. Distances are measured in
    Python only for distinct values that a native bound lets through.
    """
    query = unicodedata.normalize("NFC", p.value.strip(JS_SPACE))
    query = query if p.case_sensitive else query.lower()
    most = farthest(p.value)
    c = column(p.column)
    raw = trimmed(c)
    rows = df.where(c.isNotNull() & (raw != "")).select(raw.alias("raw"), norm(c, p.case_sensitive, composed).alias("key"), column(row_id).alias("at"))
    near = rows.where((F.col("key") != query) & (F.lit(most > 0)) & may_be_within(F.col("key"), query, most))
    found = near.groupBy("key").agg(F.count(F.lit(1)).alias("occurrences"), F.min_by("raw", F.struct(F.char_length("raw"), "at")).alias("value"))
    close = found.withColumn("distance", osa_column(F.col("key"), query, most)).where(F.col("distance") <= most)
    return close.orderBy("distance", F.desc("occurrences"), F.collate(F.col("value"), "UNICODE"), "value").limit(TOP).select("value", "distance", "occurrences")


def did_you_mean(df: DataFrame, node: Node | None, scope: Scope, row_id: str) -> DidYouMean | None:
    """Suggestions for the first eligible equality that has any; other predicates do not matter."""
    for p in eligible(node, scope):
        if farthest(p.value) and p.column in df.columns:
            found = candidates(df, p, row_id, scope.composed(p.column)).collect()
            if found:
                return DidYouMean(p.column, p.op, p.value.strip(JS_SPACE), tuple(r.value for r in found))
    return None
