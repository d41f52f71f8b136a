"""Compiles predicate trees to columns.

Every compiled predicate is two-valued: it is true or false, never null. Predicates on numbers, datetimes and truth
values are written as plain comparisons guarded by ``IS NOT NULL``, which Parquet readers take as pushed filters;
operands are read once, on the driver.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Callable
from dataclasses import dataclass
from datetime import timedelta
from functools import reduce
from typing import Any

from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import EPOCH, JS_SPACE, js_boolean, js_date, js_number, js_text
from tidemark.functions.text import kind_of, norm
from tidemark.plans.nodes import NO_LABEL, TAG_COLUMN, Kind, Node, Op, Predicate, leaves

_PATTERNS = (Op.REGEX, Op.MATCHES, Op.NOT_MATCHES)


@dataclass(frozen=True)
class Scope:
    """What predicates may name: the columns' types, which text columns hold composed text, and the labels' column."""

    schema: T.StructType
    composed: Callable[[str], bool] = lambda _: True
    labels: Column | None = None

    def type_of(self, column: str) -> T.DataType | None:
        return self.schema[column].dataType if column in self.schema.names else None


def column(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def valid_pattern(pattern: str) -> bool:
    """Whether the regular expression compiles, asked once on the driver."""
    try:
        SparkSession.active()._jvm.java.util.regex.Pattern.compile(pattern)
    except IllegalArgumentException:
        return False
    return True


def _string(p: Predicate, c: Column, composed: bool) -> Column:
    if p.op in _PATTERNS:
        if not isinstance(p.value, str):
            return F.lit(False)
        pattern = ("" if p.case_sensitive else "(?iu)") + p.value
        if not valid_pattern(pattern):
            return F.lit(False)
        hit = F.coalesce(c, F.lit("")).rlike(pattern)
        return ~hit if p.op == Op.NOT_MATCHES else hit
    if p.op not in (Op.EQ, Op.NEQ, Op.CONTAINS, Op.STARTS_WITH):
        return F.lit(False)
    wanted = unicodedata.normalize("NFC", js_text(p.value).strip(JS_SPACE))
    wanted = wanted if p.case_sensitive else wanted.lower()
    cell = norm(c, p.case_sensitive, composed)
    return {
        Op.EQ: lambda: cell == wanted,
        Op.NEQ: lambda: cell != wanted,
        Op.CONTAINS: lambda: F.contains(cell, F.lit(wanted)),
        Op.STARTS_WITH: lambda: F.startswith(cell, F.lit(wanted)),
    }[p.op]()


def _ordered(p: Predicate, c: Column, known: Column, read: Callable[[Any], Any], lower: Callable[[Any], Column], upper: Callable[[Any], Column], equal: Callable[[Any], Column]) -> Column:
    """The operators that numbers and datetimes share. lower(x): c >= x as a column, upper(x): c <= x."""
    if p.op in (Op.EQ, Op.NEQ):
        wanted = read(p.value)
        if wanted is None:
            return F.lit(False) if p.op == Op.EQ else known
        return known & (equal(wanted) if p.op == Op.EQ else ~equal(wanted))
    if p.op in (Op.GT, Op.LT):
        wanted = read(p.value)
        if wanted is None:
            return F.lit(False)
        return known & (~upper(wanted) if p.op == Op.GT else ~lower(wanted))
    if p.op in (Op.BETWEEN, Op.RANGE):
        # blank text is a bound that is not given
        bounds = [None if v is None or (isinstance(v, str) and not v.strip()) else read(v) for v in (p.value, p.value2)]
        if bounds == [None, None]:
            return F.lit(False)
        made = [make(b) for make, b in ((lower, bounds[0]), (upper, bounds[1])) if b is not None]
        return reduce(Column.__and__, made, known)
    return F.lit(False)


def _number(p: Predicate, c: Column, t: T.DataType) -> Column:
    if isinstance(t, T.IntegralType):
        # whole literals of the column's own kind, so that the comparison needs no cast
        whole = lambda x: F.lit(max(-(2**63), min(2**63 - 1, int(x))))
        return _ordered(p, c, c.isNotNull(), js_number, lambda x: c >= whole(math.ceil(x)), lambda x: c <= whole(math.floor(x)), lambda x: c == whole(x) if x == int(x) else F.lit(False))
    known = c.isNotNull() & ~F.isnan(c) if isinstance(t, (T.DoubleType, T.FloatType)) else c.isNotNull()
    return _ordered(p, c, known, js_number, lambda x: c >= F.lit(x), lambda x: c <= F.lit(x), lambda x: c == F.lit(x))


def _datetime(p: Predicate, c: Column, t: T.DataType) -> Column:
    def moment(ms: int) -> Column:
        at = EPOCH + timedelta(milliseconds=ms)
        if isinstance(t, T.TimestampNTZType):
            return F.lit(at.replace(tzinfo=None).isoformat(sep=" ")).cast(T.TimestampNTZType())
        return F.lit(at.isoformat(sep=" ")).cast(T.TimestampType())

    c = c.cast(T.TimestampType()) if isinstance(t, T.DateType) else c
    return _ordered(p, c, c.isNotNull(), js_date, lambda x: c >= moment(x), lambda x: c <= moment(x), lambda x: c == moment(x))


def _boolean(p: Predicate, c: Column) -> Column:
    wanted = js_boolean(p.value)
    if wanted is None or p.op not in (Op.EQ, Op.NEQ):
        return F.lit(False)
    return c.isNotNull() & (c == F.lit(wanted) if p.op == Op.EQ else c != F.lit(wanted))


def _labels(p: Predicate, labels: Column | None) -> Column:
    held = F.coalesce(labels, F.array().cast("array<string>")) if labels is not None else F.array().cast("array<string>")
    wanted = p.value if isinstance(p.value, str) and p.value != NO_LABEL else None
    has = F.array_contains(held, wanted) if wanted else F.size(held) == 0
    return {Op.EQ: has, Op.NEQ: ~has}.get(p.op, F.lit(False))


def compile_predicate(p: Predicate, scope: Scope) -> Column:
    if p.column == TAG_COLUMN:
        return _labels(p, scope.labels)
    t = scope.type_of(p.column)
    if t is None:
        return _string(p, F.lit(""), True)
    c, kind = column(p.column), kind_of(t)
    if kind == Kind.NUMBER:
        return _number(p, c, t)
    if kind == Kind.DATETIME:
        return _datetime(p, c, t)
    if kind == Kind.BOOLEAN:
        return _boolean(p, c)
    text = c if isinstance(t, T.StringType) else F.to_json(c) if isinstance(t, (T.ArrayType, T.MapType, T.StructType)) else c.cast("string")
    return _string(p, text, scope.composed(p.column))


def compile_node(node: Node | None, scope: Scope) -> Column:
    """The whole tree; no tree and empty groups are true."""
    if node is None:
        return F.lit(True)
    if isinstance(node, Predicate):
        return compile_predicate(node, scope)
    parts = [compile_node(n, scope) for n in node.items]
    if not parts:
        return F.lit(True)
    return reduce(Column.__and__ if node.op == "and" else Column.__or__, parts)


def names_labels(node: Node | None) -> bool:
    return any(p.column == TAG_COLUMN for p in leaves(node))


def warnings(node: Node | None, scope: Scope) -> list[str]:
    """Predicates that cannot hold for any row, because the column's type does not know the operator."""
    known = {
        Kind.STRING: {Op.EQ, Op.NEQ, Op.CONTAINS, Op.STARTS_WITH, *_PATTERNS},
        Kind.NUMBER: {Op.EQ, Op.NEQ, Op.GT, Op.LT, Op.BETWEEN, Op.RANGE},
        Kind.DATETIME: {Op.EQ, Op.NEQ, Op.GT, Op.LT, Op.BETWEEN, Op.RANGE},
        Kind.BOOLEAN: {Op.EQ, Op.NEQ},
    }
    found = []
    for p in leaves(node):
        t = scope.type_of(p.column)
        kind = Kind.STRING if t is None or p.column == TAG_COLUMN else kind_of(t)
        allowed = {Op.EQ, Op.NEQ} if p.column == TAG_COLUMN else known[kind]
        if p.op not in allowed:
            found.append(f"{p.op} on {kind} column {p.column!r} matches nothing")
    return found

