"""Views: immutable compositions of filter, search and sort over a dataset."""

from __future__ import annotations

import unicodedata
from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from typing import TYPE_CHECKING, Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import JS_SPACE
from tidemark.functions.text import display, kind_of, norm
from tidemark.operators.grouping import Grouped, group_by
from tidemark.operators.ordering import ordering, row_key, sort_keys
from tidemark.operators.predicates import Scope, column, compile_node, compile_predicate, names_labels, warnings
from tidemark.operators.suggest import DidYouMean, did_you_mean
from tidemark.plans.nodes import Aggregation, Kind, Node, Sort, leaves

if TYPE_CHECKING:
    from tidemark.dataset import Dataset

_LABELS = "__tm_labels"


@dataclass(frozen=True)
class Search:
    query: str
    columns: tuple[str, ...] = ()
    case_sensitive: bool = False


@dataclass(frozen=True)
class Page:
    rows: list
    total_rows: int
    matched_rows: int


@dataclass(frozen=True)
class FilterReport:
    total_rows: int
    matched_rows: int
    predicate_counts: dict[str, int]
    did_you_mean: DidYouMean | None
    warnings: list[str] = field(default_factory=list)


@dataclass(frozen=True)
class View:
    """What is shown: rows that pass the filter and then the search, in the order of the sorts and then of rows.

    A filter or search put in anew leaves the sorts as they are.
    """

    dataset: "Dataset"
    node: Node | None = None
    search_for: Search | None = None
    sorts: tuple[Sort, ...] = ()

    # --- changing -------------------------------------------------------------------------------------------------
    def filter(self, node: Node | None) -> "View":
        """The filter in place of the one before; the search ends."""
        return replace(self, node=node, search_for=None)

    def search(self, query: str, columns: Sequence[str] = (), case_sensitive: bool = False) -> "View":
        """Rows that hold the text in any of the columns (all of them if none is named). Blank text ends the search."""
        if not query.strip(JS_SPACE):
            return self.clear_search()
        return replace(self, search_for=Search(query, tuple(columns), case_sensitive))

    def clear_search(self) -> "View":
        return replace(self, search_for=None)

    def sort(self, sorts: Sequence[Sort]) -> "View":
        return replace(self, sorts=tuple(sorts))

    # --- reading --------------------------------------------------------------------------------------------------
    @property
    def scope(self) -> Scope:
        return Scope(self.dataset.schema, self.dataset.composed, F.col(_LABELS))

    def _base(self, node: Node | None) -> DataFrame:
        """The data, with the labels of each row if the filter asks for them."""
        df = self.dataset.df
        if not names_labels(node):
            return df
        tags = self.dataset.tags
        if tags is None:
            return df.withColumn(_LABELS, F.array().cast("array<string>"))
        held = tags.records.select(F.col("row_id").alias("__tm_row"), F.col("label_ids").alias(_LABELS))
        return df.join(held, column(self.dataset.row_id) == F.col("__tm_row"), "left").drop("__tm_row")

    def _search_column(self) -> Column:
        s, schema = self.search_for, self.dataset.schema
        own = [c for c in schema.names if c != self.dataset.row_id]
        chosen = [c for c in s.columns if c in own] if s.columns else own
        if not chosen:
            return F.lit(False)
        needle = unicodedata.normalize("NFC", s.query.strip(JS_SPACE))
        needle = needle if s.case_sensitive else needle.lower()

        def cell(name: str) -> Column:
            shown, t = display(column(name), schema[name].dataType), schema[name].dataType
            if kind_of(t) == Kind.STRING:
                return norm(shown, s.case_sensitive, self.dataset.composed(name))
            return shown if s.case_sensitive else F.lower(shown)  # numbers, datetimes and truth values need no trimming

        cells = [F.coalesce(cell(c), F.lit("")) for c in chosen]
        return reduce(Column.__or__, [F.contains(c, F.lit(needle)) for c in cells])

    @property
    def filtered(self) -> DataFrame:
        df = self._base(self.node)
        return (df if self.node is None else df.where(compile_node(self.node, self.scope))).drop(_LABELS)

    @property
    def unsorted(self) -> DataFrame:
        df = self.filtered
        return df if self.search_for is None else df.where(self._search_column())

    @property
    def order(self) -> list[Column]:
        return ordering(self.sorts, self.dataset.schema, self.dataset.row_id)

    @property
    def df(self) -> DataFrame:
        """All rows in order."""
        return self.unsorted.orderBy(*self.order)

    def window(self, offset: int = 0, limit: int | None = None) -> DataFrame:
        """A page as a DataFrame; no limit is to the end, a limit of 0 or less is nothing.

        A page with a limit is a top-k. The rest of a view from some row on may be most of it, so it is not numbered in
        one place: the row before it is found as a top-k, at once, and the rows after that one are sorted like any view.
        """
        if limit is not None and limit <= 0:
            return self.unsorted.limit(0)
        if limit is not None:
            return (self.df.offset(offset) if offset > 0 else self.df).limit(limit)
        return self.df if offset <= 0 else self._after(offset)

    def _after(self, offset: int) -> DataFrame:
        """Rows from place ``offset`` on, in order."""
        keys = [*sort_keys(self.sorts, self.dataset.schema), row_key(self.dataset.row_id)]
        names = [f"__tm_k{i}" for i in range(len(keys))]
        kinds = [f.dataType for f in self.unsorted.select(*(k.key.alias(n) for n, k in zip(names, keys, strict=True))).schema]
        border = self.df.select(*(k.key.cast("string").alias(n) for n, k in zip(names, keys, strict=True))).offset(offset - 1).limit(1).collect()
        if not border:
            return self.unsorted.limit(0)
        later, equal = F.lit(False), F.lit(True)
        for text, kind, k in zip(border[0], kinds, keys, strict=True):
            theirs = F.lit(text).cast(kind)
            # null comes first rising and last falling, as in the order itself
            if text is None:
                beyond = F.lit(False) if k.descending else k.key.isNotNull()
            else:
                beyond = F.coalesce(k.key < theirs, F.lit(True)) if k.descending else F.coalesce(k.key > theirs, F.lit(False))
            later, equal = later | (equal & beyond), equal & k.key.eqNullSafe(theirs)
        return self.unsorted.where(later).orderBy(*self.order)

    def page(self, offset: int = 0, limit: int | None = None) -> Page:
        total, matched = self.counts()
        return Page(self.window(offset, limit).collect(), total, matched)

    def counts(self) -> tuple[int, int]:
        """(rows searched or all, rows shown): the total is of the filtered rows while a search is on."""
        shown = self.unsorted.count()
        if self.search_for is not None:
            return self.filtered.count(), shown
        return self.dataset.df.count(), shown

    def predicate_counts(self) -> DataFrame:
        """One row: ``total``, ``matched`` (the whole filter), and ``p0, p1, ...`` for its predicates, each by itself."""
        df, scope = self._base(self.node), self.scope
        each = [F.count_if(compile_predicate(p, scope)).alias(f"p{i}") for i, p in enumerate(leaves(self.node))]
        return df.agg(F.count(F.lit(1)).alias("total"), F.count_if(compile_node(self.node, scope)).alias("matched"), *each)

    def filter_report(self) -> FilterReport:
        """Counts from one pass; suggestions if a filter leaves no row."""
        got = self.predicate_counts().first()
        ps = leaves(self.node)
        meant = did_you_mean(self.dataset.df, self.node, self.scope, self.dataset.row_id) if ps and not got.matched else None
        counts: dict[str, Any] = {p.id if p.id is not None else str(i): got[f"p{i}"] for i, p in enumerate(ps)}
        return FilterReport(got.total, got.matched, counts, meant, warnings(self.node, self.scope))

    def group_by(self, keys: str | Sequence[str], aggregations: Sequence[Aggregation] = ()) -> Grouped:
        return group_by(self.unsorted, keys, aggregations, self.sorts, self.dataset.row_id)

    def row_ids(self) -> DataFrame:
        return self.unsorted.select(column(self.dataset.row_id))
