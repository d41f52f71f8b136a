"""Column profiles and value distributions, over the whole dataset."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.text import display, kind_of
from tidemark.operators.predicates import column
from tidemark.plans.nodes import Kind

#: Share of distinct values in all rows beyond which a distribution says nothing.
MOST_DISTINCT = 0.5
TOO_MANY = "Too many unique values"
EXAMPLES = 5


@dataclass(frozen=True)
class Distribution:
    column: str
    total_rows: int
    distinct: int
    skipped: str | None
    items: DataFrame


def distribution_items(df: DataFrame, name: str, ascending: bool = False) -> DataFrame:
    """(value, count) of the values that are not null, most frequent first; equal counts by value."""
    shown = display(column(name), df.schema[name].dataType)
    order = [F.col("count").asc() if ascending else F.col("count").desc(), F.collate(F.col("value"), "UNICODE").asc(), F.col("value").asc()]
    return df.where(column(name).isNotNull()).groupBy(shown.alias("value")).count().orderBy(*order)


def value_distribution(df: DataFrame, name: str, ascending: bool = False) -> Distribution:
    """How often each value occurs; skipped when more than half as many values as rows are distinct (nulls are rows too)."""
    none = df.sparkSession.createDataFrame([], "value string, count long")
    if name not in df.columns:
        return Distribution(name, 0, 0, None, none)
    items = distribution_items(df, name, ascending)
    total, distinct = df.agg(F.count(F.lit(1)), F.count_distinct(display(column(name), df.schema[name].dataType))).first()
    if total and distinct / total > MOST_DISTINCT:
        return Distribution(name, total, distinct, TOO_MANY, none)
    return Distribution(name, total, distinct, None, items)


def may_have_distribution(df: DataFrame, name: str) -> bool:
    """Distributions are offered for text and truth values."""
    return name in df.columns and kind_of(df.schema[name].dataType) in (Kind.STRING, Kind.BOOLEAN)


def _spans(df: DataFrame) -> list[Column]:
    out = []
    for f in df.schema:
        if kind_of(f.dataType) == Kind.DATETIME:
            c = column(f.name).cast("timestamp")
            out += [F.unix_millis(F.min(c)).alias(f"min {f.name}"), F.unix_millis(F.max(c)).alias(f"max {f.name}")]
    return out


def profile(df: DataFrame) -> DataFrame:
    """(column, type, rows, nulls, min_ms, max_ms) of every column, in one aggregation over the data."""
    counts = [F.count(F.lit(1)).alias("rows"), *(F.count_if(column(c).isNull()).alias(f"nulls {c}") for c in df.columns)]
    one = df.agg(*counts, *_spans(df))
    none = F.lit(None).cast("long")

    def row(f) -> Column:
        span = [F.col(f"`{k} {f.name}`") if kind_of(f.dataType) == Kind.DATETIME else none for k in ("min", "max")]
        return F.struct(F.lit(f.name).alias("column"), F.lit(str(kind_of(f.dataType))).alias("type"), F.col("rows"), F.col(f"`nulls {f.name}`").alias("nulls"), span[0].alias("min_ms"), span[1].alias("max_ms"))

    return one.select(F.inline(F.array(*map(row, df.schema))))


def examples(df: DataFrame, name: str, row_id: str, most: int = EXAMPLES) -> DataFrame:
    """The first distinct values as text, in the order of rows."""
    shown = display(column(name), df.schema[name].dataType)
    return df.where(column(name).isNotNull()).groupBy(shown.alias("value")).agg(F.min(column(row_id)).alias("first")).orderBy("first").limit(most).select("value")


def median(df: DataFrame, c: Column) -> float | None:
    return df.agg(F.percentile(c, 0.5)).first()[0]
