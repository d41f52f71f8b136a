"""The query catalogue: every operator over the driver's tables, each with the SQL that gives the same rows.

Order is shown as a rank column, because results are compared as sets.
"""

from __future__ import annotations

import gzip
import json
import re
import tempfile
import uuid
from collections.abc import Callable, Sequence
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.dataset import Dataset, checkpoints
from tidemark.functions import scalars
from tidemark.functions.distance import osa_column
from tidemark.functions.text import display, natural_key, norm, trimmed
from tidemark.operators import profile, suggest
from tidemark.operators.annotations import RECORD_DDL, InvalidExport, Label, TagStore, clean_ids, parse_export
from tidemark.operators.grouping import sanitise
from tidemark.operators.predicates import Scope
from tidemark.operators.view import View
from tidemark.plans import filters as lists
from tidemark.plans.layout import Layout
from tidemark.plans.nodes import NO_LABEL, TAG_COLUMN, Aggregation, Filter, Group, Node, Op, Predicate, Sort, all_of, any_of
from tidemark.sources import delimited, export, inference

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: Row id of each table.
_TABLES = {
    "region": "r_regionkey",
    "nation": "n_nationkey",
    "customer": "c_custkey",
    "supplier": "s_suppkey",
    "part": "p_partkey",
    "orders": "o_orderkey",
    "events": "event_id",
    "documents": "doc_id",
    "labels": "doc_id",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dataset(spark: SparkSession, sf_dir: str, name: str) -> Dataset:
    return Dataset.of(table(spark, sf_dir, name), _TABLES[name])


def lines(spark: SparkSession, sf_dir: str) -> Dataset:
    """``lineitem``, whose rows are told apart by order and line."""
    df = table(spark, sf_dir, "lineitem").withColumn("__rowId", F.col("l_orderkey") * 8 + F.col("l_linenumber"))
    return Dataset.of(df, "__rowId")


def add(name: str, sql: str | None = None):
    def keep(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return keep


def ranked(view: View, columns: Sequence[str], limit: int | None = None, offset: int = 0) -> DataFrame:
    """A page with the place of each row in it. Only the page is numbered, in one task, so it must have a limit."""
    page = view.window(offset, limit).select(*columns, F.monotonically_increasing_id().alias("__tm_at")).coalesce(1)
    return page.withColumn("rank", F.row_number().over(Window.orderBy("__tm_at")).cast("long") + offset).drop("__tm_at")


def numbered_in_order(spark: SparkSession, df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Every row of a sorted result with its rank: written in sorted ranges, then numbered by place in a range and the rows
    of ranges before.

    Written, because a range partitioning that is computed twice may cut elsewhere.
    """
    path = _scratch(spark, "ranked")
    # the high bits of the id are the range, the low 33 the place in it
    df.select(*columns, F.monotonically_increasing_id().alias("__tm_at")).write.parquet(path)
    rows = spark.read.parquet(path).withColumn("__tm_range", F.shiftright("__tm_at", 33))
    sizes = sorted(tuple(r) for r in rows.groupBy("__tm_range").count().collect())  # a row for each range
    before = list(accumulate((n for _, n in sizes), initial=0))
    firsts = spark.createDataFrame([(r, b) for (r, _), b in zip(sizes, before)], "__tm_range long, __tm_first long")
    place = F.col("__tm_at").bitwiseAND((1 << 33) - 1)
    return rows.join(F.broadcast(firsts), "__tm_range").select(*columns, (F.col("__tm_first") + place + 1).alias("rank"))


def ranked_all(spark: SparkSession, view: View, columns: Sequence[str]) -> DataFrame:
    """Every row of a view with its rank."""
    return numbered_in_order(spark, view.df, columns)


def P(column: str, op: str, value=None, value2=None, cs: bool = False, id: str | None = None) -> Predicate:  # noqa: N802, A002
    return Predicate(column, Op(op), value, value2, cs, id)


def filtering(name: str, source: str, node: Node | None, columns: Sequence[str], where: str) -> None:
    """A query that filters a table, and its SQL."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        data = lines(spark, sf_dir) if source == "lineitem" else dataset(spark, sf_dir, source)
        return data.view().filter(node).unsorted.select(*columns)

    add(name, f"SELECT {', '.join(columns)} FROM {source} WHERE {where}")(run)


# --- predicates -------------------------------------------------------------------------------------------------------
_C, _P, _O = ["c_custkey", "c_mktsegment"], ["p_partkey", "p_name"], ["o_orderkey", "o_orderdate"]
_L = ["l_orderkey", "l_linenumber", "l_quantity"]
filtering("filter_str_eq_ci", "customer", P("c_mktsegment", "eq", " buildinG "), _C, "lower(trim(c_mktsegment)) = 'building'")
filtering("filter_str_eq_cs", "customer", P("c_mktsegment", "eq", "BUILDING", cs=True), _C, "trim(c_mktsegment) = 'BUILDING'")
filtering("filter_str_neq", "events", P("event_type", "neq", "CLICK"), ["event_id", "event_type"], "lower(trim(event_type)) <> 'click'")
filtering("filter_contains", "part", P("p_name", "contains", "E"), _P, "contains(lower(trim(p_name)), 'e')")
filtering("filter_contains_blank", "part", P("p_name", "contains", ""), _P, "true")
filtering("filter_starts_with", "supplier", P("s_name", "startsWith", "supplier"), ["s_suppkey", "s_name"], "starts_with(lower(trim(s_name)), 'supplier')")
filtering("filter_regex", "part", P("p_brand", "regex", "^brand#1[0-9]$"), ["p_partkey", "p_brand"], "regexp_matches(p_brand, '(?i)^brand#1[0-9]$')")
filtering("filter_matches_cs", "part", P("p_brand", "matches", "^brand#1", cs=True), ["p_partkey", "p_brand"], "regexp_matches(p_brand, '^brand#1')")
filtering("filter_not_matches", "part", P("p_brand", "notMatches", "#2"), ["p_partkey", "p_brand"], "NOT regexp_matches(p_brand, '#2')")
filtering("filter_invalid_regex", "part", any_of(P("p_brand", "notMatches", "(["), P("p_brand", "regex", "([")), ["p_partkey"], "false")
filtering("filter_num_eq", "lineitem", P("l_quantity", "eq", "17"), _L, "l_quantity = 17")
filtering("filter_num_neq", "lineitem", P("l_quantity", "neq", 17), _L, "l_quantity <> 17")
filtering("filter_num_neq_unreadable", "orders", P("o_totalprice", "neq", "many"), ["o_orderkey"], "o_totalprice IS NOT NULL")
filtering("filter_num_gt", "lineitem", P("l_extendedprice", "gt", 40000), _L, "l_extendedprice > 40000")
filtering("filter_num_lt", "lineitem", P("l_discount", "lt", "1e-2"), _L, "l_discount < 0.01")
filtering("filter_num_whole_bounds", "part", P("p_size", "between", "2.5", "7.9"), ["p_partkey", "p_size"], "p_size >= 2.5 AND p_size <= 7.9")
filtering("filter_num_between", "lineitem", P("l_quantity", "between", 10, 12), _L, "l_quantity BETWEEN 10 AND 12")
filtering("filter_num_open_lower", "lineitem", P("l_quantity", "range", None, 3), _L, "l_quantity <= 3")
filtering("filter_num_open_upper", "lineitem", P("l_quantity", "between", 48, " "), _L, "l_quantity >= 48")
filtering("filter_dt_eq", "orders", P("o_orderdate", "eq", "1996-03-01"), _O, "o_orderdate = TIMESTAMP '1996-03-01'")
filtering("filter_dt_gt", "orders", P("o_orderdate", "gt", "2000-12-31T12:00:00Z"), _O, "o_orderdate > TIMESTAMP '2000-12-31 12:00:00'")
filtering("filter_dt_lt", "orders", P("o_orderdate", "lt", 800_000_000_000), _O, "o_orderdate < TIMESTAMP '1995-05-09 06:13:20'")
filtering("filter_dt_between", "events", P("ts", "between", "2024-01-05", "2024-01-06T06:30:00.250+01:00"), ["event_id", "ts"], "ts BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-06 05:30:00.25'")
filtering("filter_dt_partial_range", "orders", P("o_orderdate", "between", scalars.parse_partial_datetime("1996-02"), scalars.parse_partial_datetime("1996-02", True)), _O, "o_orderdate BETWEEN TIMESTAMP '1996-02-01' AND TIMESTAMP '1996-02-29 23:59:00'")
filtering("filter_nested_and_or", "orders", all_of(P("o_orderstatus", "eq", "o"), any_of(P("o_totalprice", "gt", 300000), P("o_orderpriority", "startsWith", "1"), all_of(P("o_totalprice", "lt", 5000), P("o_orderdate", "gt", "1998")))), ["o_orderkey"], "lower(o_orderstatus) = 'o' AND (o_totalprice > 300000 OR starts_with(lower(o_orderpriority), '1') OR (o_totalprice < 5000 AND o_orderdate > TIMESTAMP '1998-01-01'))")
filtering("filter_empty_or", "orders", Group("or"), ["o_orderkey"], "true")
filtering("filter_none", "region", None, ["r_regionkey", "r_name"], "true")
filtering("filter_unsupported_op_is_empty", "customer", any_of(P("c_name", "gt", "a"), P("c_acctbal", "contains", "1"), P("c_name", "between", "a", "b")), ["c_custkey"], "false")
filtering("filter_unknown_column", "customer", P("nowhere", "eq", " "), ["c_custkey"], "true")
filtering("filter_grouped_eq", "orders", lists.compile_filters([Filter("o_orderstatus", "eq", "F"), Filter("o_totalprice", "gt", 100000), Filter("o_orderstatus", "eq", "p"), Filter("o_orderpriority", "eq", ""), Filter("o_orderkey", "lt", 10, enabled=False)]), ["o_orderkey", "o_orderstatus"], "o_totalprice > 100000 AND lower(o_orderstatus) IN ('f', 'p')")
filtering("filter_in_then_out", "orders", lists.compile_filters(lists.filter_out(lists.filter_in([Filter("o_orderstatus", "eq", "F")], "o_orderstatus", "O"), "o_orderpriority", "5-LOW")), ["o_orderkey"], "lower(o_orderstatus) = 'o' AND lower(o_orderpriority) <> '5-low'")


filtering("filter_distribution_toggle", "orders", lists.compile_filters(lists.toggle_value(lists.toggle_value([Filter("o_orderstatus", "eq", "F")], "o_orderstatus", "O"), "o_orderstatus", "F")), ["o_orderkey"], "lower(o_orderstatus) = 'o'")
filtering("filter_distribution_only", "orders", lists.compile_filters(lists.only_value([Filter("o_orderstatus", "eq", "F"), Filter("o_totalprice", "gt", 1000)], "o_orderstatus", "P")), ["o_orderkey"], "lower(o_orderstatus) = 'p' AND o_totalprice > 1000")


@add("filter_bool_eq", "SELECT doc_id, quality = 1 AS good FROM labels WHERE quality = 1")
def filter_bool_eq(spark, sf_dir):
    df = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") == 1).alias("good"))
    return Dataset.of(df, "doc_id").view().filter(P("good", "eq", "Yes")).unsorted


_HOLED = "CASE WHEN event_id % 7 = 0 THEN NULL ELSE {} END"


def holed(spark: SparkSession, sf_dir: str) -> Dataset:
    """``events`` with nulls: the driver's tables have none."""
    df = table(spark, sf_dir, "events")
    gap = F.col("event_id") % 7 == 0
    cells = [F.when(~gap, F.col(c)).alias(c) for c in ("ts", "event_type", "value")] + [F.when(~gap, F.col("user_id") % 2 == 0).alias("even")]
    return Dataset.of(df.select("event_id", *cells), "event_id")


_HOLES = f"(SELECT event_id, {_HOLED.format('ts')} AS ts, {_HOLED.format('event_type')} AS event_type, {_HOLED.format('value')} AS value, {_HOLED.format('user_id % 2 = 0')} AS even FROM events)"


@add("filter_null_rules", f"""SELECT 'text' AS what, count(*)::BIGINT AS n FROM {_HOLES} WHERE coalesce(event_type, '') <> 'click' UNION ALL SELECT 'number', count(*) FROM {_HOLES} WHERE value IS NOT NULL AND value <> 5
    UNION ALL SELECT 'datetime', count(*) FROM {_HOLES} WHERE ts IS NOT NULL UNION ALL SELECT 'truth', count(*) FROM {_HOLES} WHERE even = false UNION ALL SELECT 'blank', count(*) FROM {_HOLES} WHERE event_type IS NULL""")
def filter_null_rules(spark, sf_dir):
    view = holed(spark, sf_dir).view()
    asked = {"text": P("event_type", "neq", "click"), "number": P("value", "neq", 5), "datetime": P("ts", "neq", "1999-01-01"), "truth": P("even", "neq", True), "blank": P("event_type", "eq", "")}
    parts = [view.filter(p).unsorted.agg(F.lit(what).alias("what"), F.count(F.lit(1)).alias("n")) for what, p in asked.items()]
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3]).unionAll(parts[4])


@add("filter_predicate_counts", "SELECT count(*)::BIGINT AS total, count(*) FILTER (WHERE o_totalprice > 200000 AND (lower(o_orderstatus) = 'f' OR o_orderdate > TIMESTAMP '1999-01-01'))::BIGINT AS matched, count(*) FILTER (WHERE o_totalprice > 200000)::BIGINT AS p0, count(*) FILTER (WHERE lower(o_orderstatus) = 'f')::BIGINT AS p1, count(*) FILTER (WHERE o_orderdate > TIMESTAMP '1999-01-01')::BIGINT AS p2 FROM orders")
def filter_predicate_counts(spark, sf_dir):
    node = all_of(P("o_totalprice", "gt", 200000), any_of(P("o_orderstatus", "eq", "f"), P("o_orderdate", "gt", "1999-01-01")))
    return dataset(spark, sf_dir, "orders").view().filter(node).predicate_counts()


@add("filter_matching_ids", "SELECT n_nationkey FROM nation WHERE contains(lower(n_name), '1')")
def filter_matching_ids(spark, sf_dir):
    return dataset(spark, sf_dir, "nation").view().filter(P("n_name", "contains", "1")).row_ids()


# --- search -----------------------------------------------------------------------------------------------------------
_NUM = "CASE WHEN {0} = floor({0}) AND abs({0}) < 1e15 THEN CAST(CAST({0} AS BIGINT) AS VARCHAR) ELSE CAST({0} AS VARCHAR) END"


@add("search_all_columns", "SELECT n_nationkey FROM nation WHERE contains(lower(n_name), '_1') OR contains(CAST(n_regionkey AS VARCHAR), '_1')")
def search_all_columns(spark, sf_dir):
    return dataset(spark, sf_dir, "nation").view().search("_1").row_ids()


@add("search_scoped_ci", "SELECT c_custkey FROM customer WHERE contains(lower(c_mktsegment), 'mach')")
def search_scoped_ci(spark, sf_dir):
    return dataset(spark, sf_dir, "customer").view().search(" MaCH ", ["c_mktsegment", "nowhere"]).row_ids()


@add("search_cs", "SELECT c_custkey FROM customer WHERE contains(c_mktsegment, 'AUTO')")
def search_cs(spark, sf_dir):
    return dataset(spark, sf_dir, "customer").view().search("AUTO", ["c_mktsegment"], case_sensitive=True).row_ids()


@add("search_within_filter", f"SELECT c_custkey, c_name FROM customer WHERE c_nationkey = 3 AND (contains(lower(c_name), '7') OR contains({_NUM.format('c_acctbal')}, '7') OR contains(lower(c_mktsegment), '7') OR contains(CAST(c_nationkey AS VARCHAR), '7'))")
def search_within_filter(spark, sf_dir):
    return dataset(spark, sf_dir, "customer").view().filter(P("c_nationkey", "eq", 3)).search("7").unsorted.select("c_custkey", "c_name")


@add("search_number_text", f"SELECT event_id FROM events WHERE contains({_NUM.format('value')}, '12.5')")
def search_number_text(spark, sf_dir):
    return dataset(spark, sf_dir, "events").view().search("12.5", ["value"]).row_ids()


@add("search_datetime_text", "SELECT event_id FROM events WHERE contains(strftime(ts, '%Y-%m-%dT%H:%M:%S'), '2024-01-07t13')")
def search_datetime_text(spark, sf_dir):
    # cells and needle are in lower case
    return dataset(spark, sf_dir, "events").view().search("2024-01-07T13", ["ts"]).row_ids()


SQL["search_datetime_text"] = "SELECT event_id FROM events WHERE contains(lower(strftime(ts, '%Y-%m-%dT%H:%M:%S')), '2024-01-07t13')"


@add("search_no_columns", "SELECT c_custkey FROM customer WHERE false")
def search_no_columns(spark, sf_dir):
    return dataset(spark, sf_dir, "customer").view().search("a", ["nowhere"]).row_ids()


@add("search_blank_clears", "SELECT r_regionkey FROM region")
def search_blank_clears(spark, sf_dir):
    return dataset(spark, sf_dir, "region").view().search("x").search("  ").row_ids()


# --- order and pages ----------------------------------------------------------------------------------------------------
def _rank_sql(columns: str, source: str, order: str, limit: int, offset: int = 0) -> str:
    return f"SELECT {columns}, rank FROM (SELECT *, row_number() OVER (ORDER BY {order}) AS rank FROM {source}) WHERE rank > {offset} AND rank <= {offset + limit}"


_NATURAL = "CAST(regexp_extract({0}, '(\\d+)$') AS BIGINT)"


def _rank_all_sql(columns: str, source: str, order: str) -> str:
    return f"SELECT {columns}, row_number() OVER (ORDER BY {order}) AS rank FROM {source}"


@add("sort_num_desc_tiebreak", _rank_all_sql("p_partkey, p_size", "part", "p_size DESC, p_partkey"))
def sort_num_desc_tiebreak(spark, sf_dir):
    return ranked_all(spark, dataset(spark, sf_dir, "part").view().sort([Sort("p_size", True)]), ["p_partkey", "p_size"])


@add("sort_multi", _rank_all_sql("o_orderkey", "orders", "o_orderpriority, o_totalprice DESC, o_orderkey"))
def sort_multi(spark, sf_dir):
    return ranked_all(spark, dataset(spark, sf_dir, "orders").view().sort([Sort("o_orderpriority"), Sort("nowhere"), Sort("o_totalprice", True)]), ["o_orderkey"])


@add("sort_string_natural", _rank_all_sql("p_partkey, p_brand", "part", f"{_NATURAL.format('p_brand')}, p_partkey"))
def sort_string_natural(spark, sf_dir):
    return ranked_all(spark, dataset(spark, sf_dir, "part").view().sort([Sort("p_brand")]), ["p_partkey", "p_brand"])


@add("sort_string_natural_desc", _rank_all_sql("n_nationkey, n_name", "nation", f"{_NATURAL.format('n_name')} DESC"))
def sort_string_natural_desc(spark, sf_dir):
    return ranked_all(spark, dataset(spark, sf_dir, "nation").view().sort([Sort("n_name", True)]), ["n_nationkey", "n_name"])


@add("sort_null_rules", _rank_all_sql("event_id", _HOLES, "coalesce(even, false), coalesce(event_type, ''), coalesce(value, 0) DESC, event_id"))
def sort_null_rules(spark, sf_dir):
    return ranked_all(spark, holed(spark, sf_dir).view().sort([Sort("even"), Sort("event_type"), Sort("value", True)]), ["event_id"])


@add("sort_datetime_nulls", f"{_rank_all_sql('event_id', _HOLES, 'ts DESC NULLS FIRST, event_id')} UNION ALL {_rank_all_sql('-event_id', _HOLES, 'ts ASC NULLS LAST, event_id')}")
def sort_datetime_nulls(spark, sf_dir):
    view = holed(spark, sf_dir).view()
    up = ranked_all(spark, view.sort([Sort("ts")]), ["event_id"]).withColumn("event_id", -F.col("event_id"))
    return ranked_all(spark, view.sort([Sort("ts", True)]), ["event_id"]).unionAll(up)


@add("page_window", _rank_sql("o_orderkey", "orders", "o_totalprice DESC, o_orderkey", 50, 100))
def page_window(spark, sf_dir):
    return ranked(dataset(spark, sf_dir, "orders").view().sort([Sort("o_totalprice", True)]), ["o_orderkey"], 50, 100)


@add("page_past_end", "SELECT r_regionkey, r_name FROM region WHERE false")
def page_past_end(spark, sf_dir):
    return dataset(spark, sf_dir, "region").view().window(10, 5).select("r_regionkey", "r_name")


@add("page_limit_zero", "SELECT r_regionkey FROM region WHERE false")
def page_limit_zero(spark, sf_dir):
    return dataset(spark, sf_dir, "region").view().window(0, 0).select("r_regionkey")


@add("page_to_end", "SELECT r_regionkey FROM region WHERE r_regionkey >= 2")
def page_to_end(spark, sf_dir):
    return dataset(spark, sf_dir, "region").view().window(2).select("r_regionkey")


@add("page_rest_of_sorted_view", "SELECT o_orderkey, o_orderpriority FROM (SELECT *, row_number() OVER (ORDER BY o_orderpriority DESC, o_totalprice, o_orderkey) AS place FROM orders) WHERE place > 1234")
def page_rest_of_sorted_view(spark, sf_dir):
    return dataset(spark, sf_dir, "orders").view().sort([Sort("o_orderpriority", True), Sort("o_totalprice")]).window(1234).select("o_orderkey", "o_orderpriority")


@add("top_k", _rank_sql("event_id, value", "events", "value DESC, event_id", 10))
def top_k(spark, sf_dir):
    return ranked(dataset(spark, sf_dir, "events").view().sort([Sort("value", True)]), ["event_id", "value"], 10)


@add("rows_by_id", "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey IN (5, 3, 1)")
def rows_by_id(spark, sf_dir):
    return dataset(spark, sf_dir, "orders").rows([5, 3, -9, 1]).select("o_orderkey", "o_totalprice")


@add("rows_by_range", "SELECT event_id FROM events WHERE event_id BETWEEN 100 AND 129")
def rows_by_range(spark, sf_dir):
    return dataset(spark, sf_dir, "events").range(100, 30).select("event_id")


@add("parquet_row_ids", "SELECT row_number() OVER (ORDER BY event_id) - 1 AS __rowId, event_id FROM events")
def parquet_row_ids(spark, sf_dir):
    return Dataset.read_parquet(spark, f"{sf_dir}/events.parquet").df.select("__rowId", "event_id")


@add("row_checkpoints", "SELECT unnest([100000, 150000, 200000])::BIGINT AS first_row")
def row_checkpoints(spark, sf_dir):
    return spark.createDataFrame([(r,) for r in checkpoints(120_000, 100_000)], "first_row long")


@add("project_visible", "SELECT c_name, c_custkey FROM customer")
def project_visible(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    layout = Layout(("c_name", "gone", "c_custkey"), frozenset({"c_nationkey"})).toggle("c_acctbal").toggle("c_mktsegment")
    return df.select(*layout.visible(df.columns))


@add("project_hides_null_columns", "SELECT event_id, ts FROM events")
def project_hides_null_columns(spark, sf_dir):
    data = Dataset.of(table(spark, sf_dir, "events").select("event_id", F.lit(None).cast("string").alias("nothing"), "ts"), "event_id")
    return data.df.select("event_id", *data.initial_layout().visible(data.columns))


# --- grouping -----------------------------------------------------------------------------------------------------------
@add("group_single", "SELECT l_returnflag, count(*)::BIGINT AS count, count(*)::BIGINT AS rows FROM lineitem GROUP BY l_returnflag")
def group_single(spark, sf_dir):
    return lines(spark, sf_dir).view().group_by("l_returnflag").df


@add("group_multi", "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 4) AS qty, count(*)::BIGINT AS rows FROM lineitem GROUP BY 1, 2")
def group_multi(spark, sf_dir):
    return lines(spark, sf_dir).view().group_by(["l_returnflag", "", "l_linestatus"], [Aggregation("sum", "l_quantity", "qty")]).df.withColumn("qty", F.round("qty", 4))


@add("group_all_aggs", "SELECT o_orderpriority, count(*)::BIGINT AS n, count(o_totalprice)::BIGINT AS priced, round(sum(o_totalprice), 2) AS total, round(avg(o_totalprice), 4) AS mean, min(o_totalprice) AS least, max(o_totalprice) AS most, count(*)::BIGINT AS rows FROM orders GROUP BY 1")
def group_all_aggs(spark, sf_dir):
    aggs = [Aggregation("count", None, "n"), Aggregation("count", "o_totalprice", "priced"), Aggregation("sum", "o_totalprice", "total"), Aggregation("avg", "o_totalprice", "mean"), Aggregation("min", "o_totalprice", "least"), Aggregation("max", "o_totalprice", "most")]
    out = dataset(spark, sf_dir, "orders").view().group_by("o_orderpriority", aggs).df
    return out.withColumn("total", F.round("total", 2)).withColumn("mean", F.round("mean", 4))


@add("group_string_min_max", 'SELECT p_type, min(p_name) AS "min(p_name)", max(p_brand) AS "max(p_brand)", count(*)::BIGINT AS rows FROM part GROUP BY 1')
def group_string_min_max(spark, sf_dir):
    return dataset(spark, sf_dir, "part").view().group_by("p_type", [Aggregation("min", "p_name"), Aggregation("max", "p_brand")]).df


_ISO = "strftime({0}, '%Y-%m-%dT%H:%M:%S') || CASE WHEN extract('millisecond' FROM {0})::INT % 1000 = 0 THEN '' ELSE '.' || lpad((extract('millisecond' FROM {0})::INT % 1000)::VARCHAR, 3, '0') END || 'Z'"


@add("group_datetime_min_max", f"SELECT event_type, {_ISO.format('lo')} AS first, {_ISO.format('hi')} AS last, rows FROM (SELECT event_type, date_trunc('millisecond', min(ts)) AS lo, date_trunc('millisecond', max(ts)) AS hi, count(*)::BIGINT AS rows FROM events GROUP BY 1)")
def group_datetime_min_max(spark, sf_dir):
    return dataset(spark, sf_dir, "events").view().group_by("event_type", [Aggregation("min", "ts", "first"), Aggregation("max", "ts", "last")]).df


@add("group_missing_column", "SELECT r_name, CAST(NULL AS DOUBLE) AS s, 0::BIGINT AS c, CAST(NULL AS DOUBLE) AS t, count(*)::BIGINT AS rows FROM region GROUP BY 1")
def group_missing_column(spark, sf_dir):
    aggs = [Aggregation("sum", "missing", "s"), Aggregation("count", "missing", "c"), Aggregation("sum", "r_name", "t")]
    return dataset(spark, sf_dir, "region").view().group_by("r_name", aggs).df


@add("group_null_key", f"SELECT event_type, round(sum(value), 4) AS total, count(value)::BIGINT AS valued, count(*)::BIGINT AS rows FROM {_HOLES} GROUP BY 1")
def group_null_key(spark, sf_dir):
    return holed(spark, sf_dir).view().group_by("event_type", [Aggregation("sum", "value", "total"), Aggregation("count", "value", "valued")]).df.withColumn("total", F.round("total", 4))


def _first_seen(order: str, limit: int, offset: int) -> str:
    return f"WITH o AS (SELECT *, row_number() OVER (ORDER BY {order}) AS place FROM events), g AS (SELECT user_id, count(*)::BIGINT AS rows, row_number() OVER (ORDER BY min(place)) AS rank FROM o GROUP BY 1) SELECT * FROM g WHERE rank > {offset} AND rank <= {offset + limit}"


def _group_page(view: View, offset: int, limit: int) -> DataFrame:
    page = view.group_by("user_id").page(offset, limit).select("user_id", "rows", F.monotonically_increasing_id().alias("__tm_at")).coalesce(1)
    return page.withColumn("rank", F.row_number().over(Window.orderBy("__tm_at")).cast("long") + offset).drop("__tm_at")


@add("group_first_seen_page", _first_seen("event_id", 20, 10))
def group_first_seen_page(spark, sf_dir):
    return _group_page(dataset(spark, sf_dir, "events").view(), 10, 20)


@add("group_order_of_sorted_view", _first_seen("value DESC, event_id", 30, 0))
def group_order_of_sorted_view(spark, sf_dir):
    return _group_page(dataset(spark, sf_dir, "events").view().sort([Sort("value", True)]), 0, 30)


@add("group_order_of_text_sort", _first_seen("event_type DESC, ts, event_id", 30, 5))
def group_order_of_text_sort(spark, sf_dir):
    return _group_page(dataset(spark, sf_dir, "events").view().sort([Sort("event_type", True), Sort("ts")]), 5, 30)


@add("group_order_of_opposite_texts", "WITH o AS (SELECT *, row_number() OVER (ORDER BY o_orderpriority DESC, o_orderstatus, o_totalprice DESC, o_orderkey) AS place FROM orders) SELECT o_custkey, count(*)::BIGINT AS rows, row_number() OVER (ORDER BY min(place)) AS rank FROM o GROUP BY 1")
def group_order_of_opposite_texts(spark, sf_dir):
    view = dataset(spark, sf_dir, "orders").view().sort([Sort("o_orderpriority", True), Sort("o_orderstatus"), Sort("o_totalprice", True)])
    return numbered_in_order(spark, view.group_by("o_custkey").df, ["o_custkey", "rows"])


@add("group_sanitised", "SELECT o_orderstatus, round(sum(o_totalprice), 2) AS total, count(*)::BIGINT AS n, count(*)::BIGINT AS rows FROM orders GROUP BY 1")
def group_sanitised(spark, sf_dir):
    asked = sanitise([Aggregation("sum", "o_totalprice", " total "), Aggregation("avg", None, "mean"), Aggregation("count", "o_custkey", "n")])
    return dataset(spark, sf_dir, "orders").view().group_by("o_orderstatus", asked).df.withColumn("total", F.round("total", 2))


@add("group_over_filtered_view", "SELECT event_type, round(avg(value), 6) AS mean, max(value) AS most, count(*)::BIGINT AS rows FROM events WHERE value BETWEEN 10 AND 200 AND lower(event_type) <> 'view' AND contains(CAST(user_id AS VARCHAR), '1') GROUP BY 1")
def group_over_filtered_view(spark, sf_dir):
    view = dataset(spark, sf_dir, "events").view().filter(all_of(P("value", "between", 10, 200), P("event_type", "neq", "VIEW"))).search("1", ["user_id"])
    return view.group_by("event_type", [Aggregation("avg", "value", "mean"), Aggregation("max", "value", "most")]).df.withColumn("mean", F.round("mean", 6))


@add("group_totals", "SELECT count(DISTINCT l_suppkey)::BIGINT AS groups, count(*)::BIGINT AS rows FROM lineitem")
def group_totals(spark, sf_dir):
    return lines(spark, sf_dir).view().group_by("l_suppkey").rows.agg(F.count(F.lit(1)).alias("groups"), F.sum("rows").alias("rows"))


# --- profiles and distributions -------------------------------------------------------------------------------------------
@add("distribution", "SELECT o_orderpriority AS value, count(*)::BIGINT AS count FROM orders GROUP BY 1")
def distribution(spark, sf_dir):
    return dataset(spark, sf_dir, "orders").value_distribution("o_orderpriority").items


@add("distribution_asc", "SELECT source AS value, count(*)::BIGINT AS count, row_number() OVER (ORDER BY count(*), source) AS rank FROM documents GROUP BY 1")
def distribution_asc(spark, sf_dir):
    items = profile.distribution_items(table(spark, sf_dir, "documents"), "source", ascending=True)
    return items.withColumn("rank", F.row_number().over(Window.orderBy("count", "value")).cast("long"))


@add("distribution_truth", "SELECT CASE WHEN toxic = 1 THEN 'true' ELSE 'false' END AS value, count(*)::BIGINT AS count FROM labels GROUP BY 1")
def distribution_truth(spark, sf_dir):
    return profile.distribution_items(table(spark, sf_dir, "labels").select((F.col("toxic") == 1).alias("toxic")), "toxic")


@add("distribution_skipped", "SELECT count(*)::BIGINT AS total, count(DISTINCT c_name)::BIGINT AS distinct_values, CASE WHEN count(DISTINCT c_name) > 0.5 * count(*) THEN 'Too many unique values' END AS skipped, 0::BIGINT AS items FROM customer")
def distribution_skipped(spark, sf_dir):
    d = dataset(spark, sf_dir, "customer").value_distribution("c_name")
    return d.items.agg(F.lit(d.total_rows).cast("long").alias("total"), F.lit(d.distinct).cast("long").alias("distinct_values"), F.lit(d.skipped).alias("skipped"), F.count(F.lit(1)).alias("items"))


_MS = "epoch_ms(date_trunc('millisecond', {}))"


@add("profile_columns", f"""SELECT 'event_id' AS "column", 'number' AS type, count(*)::BIGINT AS rows, count(*) FILTER (WHERE event_id IS NULL)::BIGINT AS nulls, CAST(NULL AS BIGINT) AS min_ms, CAST(NULL AS BIGINT) AS max_ms FROM {_HOLES}
    UNION ALL SELECT 'ts', 'datetime', count(*), count(*) FILTER (WHERE ts IS NULL), {_MS.format('min(ts)')}, {_MS.format('max(ts)')} FROM {_HOLES} UNION ALL SELECT 'event_type', 'string', count(*), count(*) FILTER (WHERE event_type IS NULL), NULL, NULL FROM {_HOLES}
    UNION ALL SELECT 'value', 'number', count(*), count(*) FILTER (WHERE value IS NULL), NULL, NULL FROM {_HOLES} UNION ALL SELECT 'even', 'boolean', count(*), count(*) FILTER (WHERE even IS NULL), NULL, NULL FROM {_HOLES}""")
def profile_columns(spark, sf_dir):
    return profile.profile(holed(spark, sf_dir).df)


@add("profile_examples", "SELECT event_type AS value FROM events GROUP BY 1 ORDER BY min(event_id) LIMIT 5")
def profile_examples(spark, sf_dir):
    return profile.examples(table(spark, sf_dir, "events"), "event_type", "event_id")


@add("median_value", "SELECT median(l_quantity) AS median FROM lineitem")
def median_value(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").agg(F.percentile("l_quantity", 0.5).alias("median"))


# --- suggestions ------------------------------------------------------------------------------------------------------------
_OSA_SQL = "SELECT c_mktsegment AS value, damerau_levenshtein('{0}', lower(c_mktsegment))::INT AS distance, count(*)::BIGINT AS occurrences FROM customer WHERE damerau_levenshtein('{0}', lower(c_mktsegment)) BETWEEN 1 AND 2 GROUP BY 1, 2"


@add("did_you_mean", _OSA_SQL.format("buidlign"))
def did_you_mean(spark, sf_dir):
    return suggest.candidates(table(spark, sf_dir, "customer"), P("c_mktsegment", "eq", "Buidlign"), "c_custkey")


@add("did_you_mean_nations", "WITH x AS (SELECT n_name AS value, damerau_levenshtein('nation_1x', lower(n_name))::INT AS distance, count(*)::BIGINT AS occurrences FROM nation GROUP BY 1, 2) SELECT * FROM x WHERE distance BETWEEN 1 AND 2 AND abs(length(value) - 9) <= 2 ORDER BY distance, occurrences DESC, value LIMIT 5")
def did_you_mean_nations(spark, sf_dir):
    return suggest.candidates(table(spark, sf_dir, "nation"), P("n_name", "eq", "nation_1x"), "n_nationkey")


@add("did_you_mean_whole", "SELECT 'c_mktsegment' AS \"column\", 'buidling' AS query, 'BUILDING' AS suggestion")
def did_you_mean_whole(spark, sf_dir):
    data = dataset(spark, sf_dir, "customer")
    got = data.view().filter(all_of(P("c_acctbal", "gt", 0), P("c_mktsegment", "eq", " buidling "))).filter_report().did_you_mean
    return spark.createDataFrame([(got.column, got.query, s) for s in got.suggestions], "column string, query string, suggestion string")


@add("did_you_mean_ineligible", "SELECT CAST(NULL AS VARCHAR) AS found WHERE false")
def did_you_mean_ineligible(spark, sf_dir):
    data = dataset(spark, sf_dir, "customer")
    asked = [P("c_mktsegment", "contains", "buidling"), P("c_mktsegment", "eq", "ab"), P("c_acctbal", "eq", "x")]
    found = [suggest.did_you_mean(data.df, p, Scope(data.schema), "c_custkey") for p in asked]
    return spark.createDataFrame([(str(f),) for f in found if f], "found string")


@add("osa_pairs", "SELECT n_nationkey, damerau_levenshtein(n_name, 'NATOIN_7')::INT AS distance FROM nation")
def osa_pairs(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", osa_column(F.col("n_name"), "NATOIN_7", 99).alias("distance"))


# --- functions ----------------------------------------------------------------------------------------------------------------
@add("fn_norm", r"SELECT doc_id, length(n)::INT AS n_chars, md5(n) AS digest FROM (SELECT doc_id, lower(nfc_normalize(trim(text, ' ' || chr(9) || chr(10) || chr(13)))) AS n FROM documents)")
def fn_norm(spark, sf_dir):
    n = table(spark, sf_dir, "documents").select("doc_id", norm(F.col("text"), composed=False).alias("n"))
    return n.select("doc_id", F.char_length("n").alias("n_chars"), F.md5("n").alias("digest"))


@add("fn_trim", "SELECT n_nationkey, n_name AS t FROM nation")
def fn_trim(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", trimmed(F.concat(F.lit(" ﻿\t "), F.col("n_name"), F.lit("　\n"))).alias("t"))


@add("fn_number_text", f"SELECT l_orderkey, l_linenumber, CASE WHEN l_discount = 0 THEN '0' ELSE {_NUM.format('l_discount')} END AS d, {_NUM.format('l_extendedprice')} AS p FROM lineitem")
def fn_number_text(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem")
    return df.select("l_orderkey", "l_linenumber", display(F.col("l_discount"), df.schema["l_discount"].dataType).alias("d"), display(F.col("l_extendedprice"), df.schema["l_extendedprice"].dataType).alias("p"))


@add("fn_iso_text", f"SELECT event_id, {_ISO.format('t')} AS iso FROM (SELECT event_id, date_trunc('millisecond', ts) AS t FROM events)")
def fn_iso_text(spark, sf_dir):
    df = table(spark, sf_dir, "events")
    return df.select("event_id", display(F.col("ts"), df.schema["ts"].dataType).alias("iso"))


@add("fn_natural_key", "SELECT count(*)::BIGINT AS n FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey")
def fn_natural_key(spark, sf_dir):
    df = table(spark, sf_dir, "nation").select("n_nationkey", natural_key(F.col("n_name")).alias("k"))
    a, b = df.alias("a"), df.alias("b")
    return a.join(b, F.col("a.n_nationkey") < F.col("b.n_nationkey")).agg(F.count_if(F.col("a.k") < F.col("b.k")).alias("n"))


# --- annotations ----------------------------------------------------------------------------------------------------------------
_CATALOG = (Label("good", "Good", "#00aa00"), Label("bad", "Bad", "#aa0000"), Label("toxic", "Toxic", "#550055"))


def tags(spark: SparkSession, sf_dir: str) -> TagStore:
    """Records made from ``labels``: by quality and toxicity, and a note on every tenth."""
    df = table(spark, sf_dir, "labels")
    ids = F.array_compact(F.array(F.when(F.col("quality") == 1, "good").otherwise("bad"), F.when(F.col("toxic") == 1, "toxic")))
    note = F.when(F.col("doc_id") % 10 == 0, F.concat(F.lit("see "), F.col("doc_id").cast("string")))
    return TagStore.of(_CATALOG, df.select(F.col("doc_id").alias("row_id"), ids.alias("label_ids"), note.alias("note"), F.lit(0).cast("long").alias("updated_at")))


def shown(store: TagStore) -> DataFrame:
    return store.records.select("row_id", "label_ids", "note")


_TAGS = "(SELECT doc_id AS row_id, list_filter([CASE WHEN quality = 1 THEN 'good' ELSE 'bad' END, CASE WHEN toxic = 1 THEN 'toxic' END], lambda x: x IS NOT NULL) AS label_ids, CASE WHEN doc_id % 10 = 0 THEN 'see ' || doc_id END AS note FROM labels)"


def tagged(spark, sf_dir) -> Dataset:
    return dataset(spark, sf_dir, "documents").with_tags(tags(spark, sf_dir))


def tag_filter(name: str, p: Predicate, where: str) -> None:
    def run(spark, sf_dir):
        return tagged(spark, sf_dir).view().filter(p).unsorted.select("doc_id")

    add(name, f"SELECT doc_id FROM documents LEFT JOIN {_TAGS} t ON doc_id = t.row_id WHERE {where}")(run)


tag_filter("tags_filter_label", P(TAG_COLUMN, "eq", "toxic"), "coalesce(list_contains(label_ids, 'toxic'), false)")
tag_filter("tags_filter_not_label", P(TAG_COLUMN, "neq", "toxic"), "NOT coalesce(list_contains(label_ids, 'toxic'), false)")
tag_filter("tags_filter_no_label", P(TAG_COLUMN, "eq", NO_LABEL), "coalesce(len(label_ids), 0) = 0")
tag_filter("tags_filter_any_label", P(TAG_COLUMN, "neq", None), "coalesce(len(label_ids), 0) > 0")
tag_filter("tags_filter_other_op", P(TAG_COLUMN, "contains", "toxic"), "false")
tag_filter("tags_filter_in_tree", all_of(any_of(P(TAG_COLUMN, "eq", "bad"), P("lang", "eq", "FR")), P("n_chars", "gt", 500)), "(coalesce(list_contains(label_ids, 'bad'), false) OR lower(lang) = 'fr') AND n_chars > 500")


def label_list_filter(name: str, rewrite, where: str) -> None:
    def run(spark, sf_dir):
        return tagged(spark, sf_dir).view().filter(lists.compile_filters(rewrite([Filter("lang", "eq", "en"), Filter(TAG_COLUMN, "eq", "good")]))).unsorted.select("doc_id")

    add(name, f"SELECT doc_id FROM documents LEFT JOIN {_TAGS} t ON doc_id = t.row_id WHERE lower(lang) = 'en' AND {where}")(run)


label_list_filter("tags_show_only_label", lambda fs: lists.show_only_label(fs, "bad"), "coalesce(list_contains(label_ids, 'bad'), false)")
label_list_filter("tags_exclude_label", lambda fs: lists.exclude_label(lists.clear_labels(fs), "toxic"), "NOT coalesce(list_contains(label_ids, 'toxic'), false)")
label_list_filter("tags_clear_label_filters", lists.clear_labels, "true")


@add("tags_join_cells", f"SELECT doc_id, array_to_string(list_transform(label_ids, lambda i: CASE i WHEN 'good' THEN 'Good' WHEN 'bad' THEN 'Bad' ELSE 'Toxic' END), ',') AS names, t.note AS note FROM documents LEFT JOIN {_TAGS} t ON doc_id = t.row_id")
def tags_join_cells(spark, sf_dir):
    df = tagged(spark, sf_dir).with_tag_cells()
    names = F.array_join(F.transform("__tag.labels", lambda x: x["name"]), ",")
    return df.select("doc_id", names.alias("names"), F.col("__tag.note").alias("note"))


@add("tag_append", f"SELECT row_id, CASE WHEN row_id % 4 = 1 THEN list_distinct([label_ids[1]]) || CASE WHEN label_ids[1] = 'bad' THEN [] ELSE ['bad'] END || CASE WHEN len(label_ids) = 2 THEN ['toxic'] ELSE [] END ELSE label_ids END AS label_ids, note FROM {_TAGS}")
def tag_append(spark, sf_dir):
    store = tags(spark, sf_dir)
    return shown(store.tag(store.records.where("row_id % 4 = 1").select("row_id"), ["bad", "unknown", " bad "], mode="append"))


SQL["tag_append"] = f"SELECT row_id, CASE WHEN row_id % 4 = 1 AND NOT list_contains(label_ids, 'bad') THEN list_append(label_ids, 'bad') ELSE label_ids END AS label_ids, note FROM {_TAGS}"


@add("tag_remove", f"SELECT row_id, ids AS label_ids, note FROM (SELECT row_id, CASE WHEN row_id % 3 = 0 THEN list_filter(label_ids, lambda x: x <> 'good') ELSE label_ids END AS ids, note FROM {_TAGS}) WHERE len(ids) > 0 OR note IS NOT NULL")
def tag_remove(spark, sf_dir):
    store = tags(spark, sf_dir)
    return shown(store.tag(store.records.where("row_id % 3 = 0").select("row_id"), ["good"], mode="remove"))


@add("tag_replace", f"SELECT coalesce(t.row_id, x.id) AS row_id, CASE WHEN x.id IS NOT NULL THEN ['toxic', 'good'] ELSE label_ids END AS label_ids, CASE WHEN x.id IS NOT NULL THEN 'new' ELSE note END AS note FROM {_TAGS} t FULL JOIN (SELECT doc_id AS id FROM documents WHERE doc_id < 30) x ON t.row_id = x.id")
def tag_replace(spark, sf_dir):
    return shown(tags(spark, sf_dir).tag([*range(30), -1, float("nan")], ["toxic", "good"], note="new"))


@add("tag_clear", f"SELECT row_id, label_ids, note FROM {_TAGS} WHERE row_id >= 50")
def tag_clear(spark, sf_dir):
    return shown(tags(spark, sf_dir).clear(range(50)))


@add("tag_clear_labels_keeps_notes", f"SELECT row_id, CASE WHEN row_id % 2 = 0 THEN CAST([] AS VARCHAR[]) ELSE label_ids END AS label_ids, note FROM {_TAGS} WHERE row_id % 2 = 1 OR note IS NOT NULL")
def tag_clear_labels_keeps_notes(spark, sf_dir):
    store = tags(spark, sf_dir)
    return shown(store.tag(store.records.where("row_id % 2 = 0").select("row_id"), None))


@add("delete_label_cascade", f"SELECT row_id, ids AS label_ids, note FROM (SELECT row_id, list_filter(label_ids, lambda x: x <> 'good') AS ids, note FROM {_TAGS}) WHERE len(ids) > 0 OR note IS NOT NULL")
def delete_label_cascade(spark, sf_dir):
    return shown(tags(spark, sf_dir).delete_label("good"))


def _incoming(spark) -> DataFrame:
    return spark.createDataFrame([(1, ["new", "gone"], None, 5), (10, [], "other", 5), (100_000, ["good"], None, 5), (100_001, ["gone"], None, 5)], RECORD_DDL)


@add("import_merge", f"""SELECT row_id, label_ids, note FROM {_TAGS} WHERE row_id NOT IN (1, 10) UNION ALL SELECT 1, ['new'], max(note) FROM {_TAGS} WHERE row_id = 1
    UNION ALL SELECT 10, CAST([] AS VARCHAR[]), 'other' UNION ALL SELECT 100000, ['good'], NULL""")
def import_merge(spark, sf_dir):
    return shown(tags(spark, sf_dir).import_records([Label("new", "New")], _incoming(spark)))


@add("import_replace", "SELECT 1::BIGINT AS row_id, ['new'] AS label_ids, CAST(NULL AS VARCHAR) AS note UNION ALL SELECT 10, CAST([] AS VARCHAR[]), 'other'")
def import_replace(spark, sf_dir):
    return shown(tags(spark, sf_dir).import_records([Label("new", "New")], _incoming(spark), "replace"))


@add("labels_default", "SELECT 14::BIGINT AS n, 'Reconnaissance' AS first, 'Impact' AS last")
def labels_default(spark, sf_dir):
    names = [x.name for x in TagStore.empty(spark).labels]
    return spark.createDataFrame([(len(names), names[0], names[-1])], "n long, first string, last string")


@add("tag_upsert_label", "SELECT * FROM (VALUES ('good', 'Fine', '#8899ff', 1::BIGINT), ('bad', 'Bad', '#aa0000', 0), ('toxic', 'Toxic', '#550055', 0), ('new', 'Untitled label', '#123456', 7)) t(id, name, color, created_at)")
def tag_upsert_label(spark, sf_dir):
    store = TagStore.of((Label("good", "Good", "#00aa00", created_at=1), *_CATALOG[1:]), tags(spark, sf_dir).records)
    store = store.upsert_label(Label("good", " Fine ", "  "), now=7).upsert_label(Label("new", " ", "#123456"), now=7)
    return spark.createDataFrame([(x.id, x.name, x.color, x.created_at) for x in store.labels], "id string, name string, color string, created_at long")


@add("tag_export_round_trip", f"SELECT row_id, label_ids, note FROM {_TAGS}")
def tag_export_round_trip(spark, sf_dir):
    return shown(TagStore.empty(spark, ()).import_(json.dumps(tags(spark, sf_dir).export(now=5)), "replace"))


@add("tag_import_validation", "SELECT * FROM (VALUES (0, true), (1, true), (2, false), (3, false), (4, false), (5, true)) t(k, valid)")
def tag_import_validation(spark, sf_dir):
    snapshot = {"labels": [{"id": "a", "name": "A", "color": "#fff"}], "tags": {"1": {"labelIds": ["a"]}, "2": None}}
    given = [{"version": 1, "exportedAt": 0, "payload": snapshot}, snapshot, {"version": 2, "payload": snapshot}, {"labels": [{}], "tags": {}}, "no json", json.dumps(snapshot)]

    def valid(x) -> bool:
        try:
            parse_export(x, 0)
        except InvalidExport:
            return False
        return True

    return spark.createDataFrame([(k, valid(x)) for k, x in enumerate(given)], "k int, valid boolean")


@add("tag_clean_ids", "SELECT ['a', 'b', 'c'] AS ids")
def tag_clean_ids(spark, sf_dir):
    return spark.createDataFrame([(clean_ids([" a", "b", "a ", "", None, 3, "c"]),)], "ids array<string>")


@add("layout_order", "SELECT c_mktsegment, c_custkey, c_name, c_nationkey, c_acctbal FROM customer")
def layout_order(spark, sf_dir):
    df = table(spark, sf_dir, "customer")
    return df.select(*Layout(("c_mktsegment", "gone", "c_custkey")).visible(df.columns))


# --- text in and out ---------------------------------------------------------------------------------------------------------------
@add("infer_types", """SELECT * FROM (VALUES ('n_nationkey', 'number', 0::BIGINT), ('n_name', 'string', 0::BIGINT), ('when', 'datetime', 0::BIGINT), ('flag', 'boolean', 0::BIGINT), ('holes', 'number', 13::BIGINT)) t("column", type, nulls)""")
def infer_types(spark, sf_dir):
    df = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    text = df.select(
        (k + 100).cast("string").alias("n_nationkey"), "n_name", F.concat(F.lit("Oct "), (k % 28 + 1).cast("string"), F.lit(" 2025 01:44:33")).alias("when"),
        F.when(k % 2 == 0, " Yes").otherwise("n").alias("flag"), F.when(k % 2 == 0, " ").otherwise(F.concat(F.lit("0x"), F.hex(k + 20))).alias("holes"),
    )
    found = [(i.name, str(i.kind), i.nulls) for i in inference.infer(text)]
    return spark.createDataFrame(found, "column string, type string, nulls long")


def _as_text(df: DataFrame) -> DataFrame:
    return export.as_text(df)


@add("infer_all_rows", "SELECT o_orderkey, o_totalprice, o_orderdate FROM orders")
def infer_all_rows(spark, sf_dir):
    df = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice", "o_orderdate")
    text = _as_text(df)
    back = inference.typed(text, inference.infer(text), lenient=True)
    return back.select(F.col("o_orderkey").cast("long").alias("o_orderkey"), "o_totalprice", F.col("o_orderdate").cast("timestamp_ntz").alias("o_orderdate"))


@add("coerce_strict_rules", "SELECT CAST(NULL AS DOUBLE) AS as_is, v::DOUBLE AS lenient FROM (VALUES (0), (1), (1700000000)) t(v) UNION ALL SELECT 42, 42 UNION ALL SELECT NULL, NULL UNION ALL SELECT NULL, NULL")
def coerce_strict_rules(spark, sf_dir):
    from tidemark.plans.nodes import Kind

    df = spark.createDataFrame([("0",), ("1",), ("1700000000",), (" 42 ",), ("x",), ("",)], "t string")
    return df.select(inference.coerce(F.col("t"), Kind.NUMBER).alias("as_is"), inference.coerce(F.col("t"), Kind.NUMBER, True).alias("lenient"))


def _scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder that the whole cluster can reach; a temporary one in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return f"{(shared or tempfile.mkdtemp()).rstrip('/')}/{name}-{uuid.uuid4().hex}"


@add("csv_roundtrip_typed", "SELECT row_number() OVER (ORDER BY c_custkey) - 1 AS __rowId, c_name, c_acctbal, c_mktsegment FROM customer")
def csv_roundtrip_typed(spark, sf_dir):
    path = _scratch(spark, "customer.csv")
    export.write_csv(dataset(spark, sf_dir, "customer").view().sort([Sort("c_custkey")]).df, path)
    return Dataset.read_csv(spark, path).df.select("__rowId", "c_name", "c_acctbal", "c_mktsegment")


@add("csv_roundtrip_strict_gzip", "SELECT n_nationkey - 0 AS __rowId, n_name, 'a \"q\", ' || n_nationkey AS quoted FROM nation")
def csv_roundtrip_strict_gzip(spark, sf_dir):
    path = _scratch(spark, "nation.csv")
    df = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_name", F.concat(F.lit('a "q", '), F.col("n_nationkey").cast("string")).alias("quoted"))
    export.write_csv(df, path, gzip=True)
    return Dataset.read_csv(spark, path, strict=True).df.select(F.col("__rowId").cast("int").alias("__rowId"), "n_name", "quoted")


@add("csv_multiline_pages", "SELECT page_id, md5(html) AS h FROM pages")
def csv_multiline_pages(spark, sf_dir):
    path = _scratch(spark, "pages.csv")
    export.write_csv(table(spark, sf_dir, "pages").select((F.col("page_id") + 100_000).alias("page_id"), "html"), path)
    back = Dataset.read_csv(spark, path, lenient=True).df
    return back.select((F.col("page_id") - 100_000).cast("long").alias("page_id"), F.md5("html").alias("h"))


@add("csv_strict_pages", "SELECT page_id, md5(html) AS h, row_number() OVER (ORDER BY page_id) - 1 AS __rowId FROM pages")
def csv_strict_pages(spark, sf_dir):
    path = _scratch(spark, "pages.csv")
    export.write_csv(table(spark, sf_dir, "pages").orderBy("page_id").select((F.col("page_id") + 100_000).alias("page_id"), "html"), path)
    back = Dataset.read_csv(spark, path, lenient=True, strict=True).df
    return back.select((F.col("page_id") - 100_000).cast("long").alias("page_id"), F.md5("html").alias("h"), "__rowId")


# A small file with all that the strict rules are about, over and over; {k} is the repetition.
_STRICT_BIT = 'x{k},  two ,mid"quo,"te\r\n\n"a ""q""\nb{k}",,1,more\rlone{k},2,3\r\n'


def _written(spark: SparkSession, name: str, data: bytes) -> str:
    """A file of these bytes that the whole cluster can read."""
    path = _scratch(spark, "written") + f"/{name}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    out = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(where)
    try:
        out.write(bytearray(data))
    finally:
        out.close()
    return path


_STRICT_SQL = """WITH k AS (SELECT unnest(range(0, 200)) AS k) SELECT k * 4 + i AS __rowId, a, b, c FROM k, LATERAL (VALUES (0, 'x' || k, '  two ', 'midquo,te'), (1, '', '', ''), (2, 'a "q"' || chr(10) || 'b' || k, '', '1'), (3, 'lone' || k, '2', '3')) t(i, a, b, c)"""


@add("csv_strict_rules", _STRICT_SQL)
def csv_strict_rules(spark, sf_dir):
    """Blank lines, quotes anywhere, lone CRs, untrimmed cells, a byte order mark, rows too short and too long."""
    text = "\ufeffa,b,c\n" + "".join(_STRICT_BIT.format(k=k) for k in range(200))
    return delimited.read_text(spark, _written(spark, "strict.csv", text.encode())).df


@add("csv_gzip_members", _STRICT_SQL)
def csv_gzip_members(spark, sf_dir):
    """A gzip file of several members, one of them empty, cut inside cells."""
    text = ("a,b,c\n" + "".join(_STRICT_BIT.format(k=k) for k in range(200))).encode()
    cuts = [0, 100, 100, 3333, len(text)]
    return delimited.read_text(spark, _written(spark, "members.csv.gz", b"".join(gzip.compress(text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)))).df


@add("csv_detected_delimiters", "SELECT * FROM (VALUES ('a,b;c,d', ','), ('a' || chr(9) || 'b', chr(9)), ('a;b', ';'), ('\"a,b\";c', ';'), ('abc', ',')) t(head, delimiter)")
def csv_detected_delimiters(spark, sf_dir):
    heads = ["a,b;c,d", "a\tb", "a;b", '"a,b";c', "abc"]
    return spark.createDataFrame([(h, delimited.detect_delimiter(h)) for h in heads], "head string, delimiter string")


@add("export_csv_text", """SELECT '"' || r_regionkey || '","' || replace(r_name, '"', '""') || '"' AS line FROM region""")
def export_csv_text(spark, sf_dir):
    df = table(spark, sf_dir, "region")
    return df.select(export.csv_line(df).alias("line"))


@add("export_grouping", """SELECT '"' || o_orderstatus || '","' || count(*) || '","' || count(*) || '"' AS line FROM orders GROUP BY o_orderstatus""")
def export_grouping(spark, sf_dir):
    df = dataset(spark, sf_dir, "orders").view().group_by("o_orderstatus").df
    return df.select(export.csv_line(df).alias("line"))


@add("clipboard_rows", f"SELECT doc_id || chr(9) || lang || chr(9) || coalesce(array_to_string(list_transform(label_ids, lambda i: CASE i WHEN 'good' THEN 'Good' WHEN 'bad' THEN 'Bad' ELSE 'Toxic' END), ', '), '') || CASE WHEN note IS NOT NULL THEN ' | note: ' || note ELSE '' END AS line FROM documents LEFT JOIN {_TAGS} t ON doc_id = t.row_id")
def clipboard_rows(spark, sf_dir):
    df = tagged(spark, sf_dir).with_tag_cells().select("doc_id", "lang", "__tag")
    return df.select(F.concat_ws("\t", *(export.clipboard_cell(F.col(f"`{f.name}`"), f.dataType) for f in df.schema)).alias("line"))


@add("stream_filtered_counts", "SELECT date_trunc('day', ts) AS day, event_type, count(*)::BIGINT AS rows FROM events WHERE value > 100 GROUP BY 1, 2")
def stream_filtered_counts(spark, sf_dir):
    from tidemark.streaming import ingest

    schema = table(spark, sf_dir, "events").schema
    rows = spark.readStream.schema(schema).format("parquet").load(f"{sf_dir}/events.parquet*")
    counts = ingest.windowed_counts(ingest.stream_filter(rows, P("value", "gt", 100)), "ts", ["event_type"], "1 day", "30 days")
    name = f"tm_{uuid.uuid4().hex}"
    query = counts.writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).select(F.col("start").cast("timestamp_ntz").alias("day"), "event_type", "rows")
