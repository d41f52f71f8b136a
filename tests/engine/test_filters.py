import random
import re
import unicodedata
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidemark.dataset import Dataset
from tidemark.functions import scalars as s
from tidemark.operators.annotations import Label, TagStore
from tidemark.operators.predicates import Scope, compile_predicate, warnings
from tidemark.plans import filters as lists
from tidemark.plans.nodes import NO_LABEL, TAG_COLUMN, Filter, Group, Op, Predicate, all_of, any_of


def data(spark, kind, values):
    return Dataset.of(spark.createDataFrame(list(enumerate(values)), f"__rowId long, v {kind}"), "__rowId")


def hits(ds, node):
    got = {r[0] for r in ds.view().filter(node).row_ids().collect()}
    return [int(i in got) for i in range(ds.df.count())]


def p(op, value=None, value2=None, cs=False, column="v"):
    return Predicate(column, Op(op), value, value2, cs)


def test_numbers(spark):
    ds = data(spark, "double", [10.0, 25.0, 40.0, None, float("nan")])
    assert hits(ds, p("gt", 20)) == [0, 1, 1, 0, 0]
    assert hits(ds, p("neq", 25)) == [1, 0, 1, 0, 0]
    assert hits(ds, p("neq", "many")) == [1, 1, 1, 0, 0]
    assert hits(ds, p("eq", "many")) == [0] * 5
    assert hits(ds, p("lt", "")) == [0] * 5  # blank is 0
    assert hits(ds, p("range", "", 25)) == [1, 1, 0, 0, 0]
    assert hits(ds, p("between", None, None)) == [0] * 5
    assert hits(ds, p("contains", "1")) == [0] * 5


def test_text(spark):
    ds = data(spark, "string", ["Alice", "Bob", "alice cooper", None, " ALICE "])
    assert hits(ds, p("contains", "alice")) == [1, 0, 1, 0, 1]
    assert hits(ds, p("contains", "")) == [1] * 5
    assert hits(ds, p("eq", "alice")) == [1, 0, 0, 0, 1]
    assert hits(ds, p("eq", "ALICE", cs=True)) == [0, 0, 0, 0, 1]
    assert hits(ds, p("neq", "alice")) == [0, 1, 1, 1, 0]
    assert hits(ds, p("eq", "")) == [0, 0, 0, 1, 0]
    assert hits(ds, p("startsWith", "al")) == [1, 0, 1, 0, 1]
    assert hits(ds, p("gt", "a")) == [0] * 5


def test_patterns(spark):
    ds = data(spark, "string", ["ERR-101", "WARN-202", "INFO-303", "É"])
    assert hits(ds, p("matches", "^ERR")) == [1, 0, 0, 0]
    assert hits(ds, p("notMatches", "^ERR")) == [0, 1, 1, 1]
    assert hits(ds, p("regex", "^err", cs=True)) == [0] * 4
    assert hits(ds, p("regex", "é")) == [0, 0, 0, 1]
    assert hits(ds, p("notMatches", "([")) == [0] * 4
    assert hits(ds, p("regex", 5)) == [0] * 4


def test_composed_forms_are_equal(spark):
    ds = data(spark, "string", ["é", "é", "e"])
    assert hits(ds, p("eq", "é")) == [1, 1, 0]
    assert hits(ds, p("eq", "é")) == [1, 1, 0]
    assert hits(Dataset.of(ds.df.limit(1), "__rowId"), p("contains", "é")) == [1]


def test_datetimes(spark):
    ds = data(spark, "timestamp_ntz", [datetime(2024, 1, 1), datetime(2024, 2, 1), None])
    assert hits(ds, p("range", "2024-01-15", "2024-03-01")) == [0, 1, 0]
    assert hits(ds, p("neq", "nonsense")) == [1, 1, 0]
    assert hits(ds, p("eq", s.parse_date("2024-02-01"))) == [0, 1, 0]


def test_truth_values(spark):
    ds = data(spark, "boolean", [True, False, True, None])
    assert hits(ds, p("eq", "yes")) == [1, 0, 1, 0]
    assert hits(ds, p("neq", 1)) == [0, 1, 0, 0]
    assert hits(ds, p("neq", "maybe")) == [0] * 4
    assert hits(ds, p("gt", True)) == [0] * 4


def test_trees(spark):
    rows = [(0, "Open", 100), (1, "Closed", 50), (2, "Open", 200), (3, "Closed", 30)]
    ds = Dataset.of(spark.createDataFrame(rows, "__rowId long, status string, amount long"), "__rowId")
    node = all_of(p("eq", "open", column="status"), any_of(p("gt", 150, column="amount"), p("eq", 100, column="amount")))
    assert hits(ds, node) == [1, 0, 1, 0]
    assert hits(ds, Group("or")) == hits(ds, Group("and")) == hits(ds, None) == [1] * 4
    assert hits(ds, all_of(p("eq", "", column="nowhere"))) == [1] * 4
    report = ds.view().filter(node).filter_report()
    assert (report.total_rows, report.matched_rows, report.predicate_counts) == (4, 2, {"0": 2, "1": 1, "2": 1})
    assert warnings(p("contains", "x", column="amount"), Scope(ds.schema)) == ["contains on number column 'amount' matches nothing"]
    with pytest.raises(ValueError):
        Group("xor")


def test_labels(spark):
    tags = TagStore.of([Label("label-1", "One")], spark.createDataFrame([(0, ["label-1"], None, 0), (2, [], "a note", 0)], "row_id long, label_ids array<string>, note string, updated_at long"))
    ds = data(spark, "string", ["foo", "bar", "baz"]).with_tags(tags)
    t = lambda op, value: p(op, value, column=TAG_COLUMN)
    assert hits(ds, t("eq", "label-1")) == [1, 0, 0]
    assert hits(ds, t("neq", "label-1")) == hits(ds, t("eq", None)) == hits(ds, t("eq", NO_LABEL)) == [0, 1, 1]
    assert hits(ds, t("contains", "label-1")) == [0, 0, 0]
    assert hits(data(spark, "string", ["x"]), t("eq", None)) == [1]


def test_plain_comparisons_are_pushed_to_the_reader(spark, sf):
    ds = Dataset.of(spark.read.parquet(f"{sf}/lineitem.parquet"), "l_orderkey")
    node = all_of(p("between", 5, 7, column="l_quantity"), p("gt", 10, column="l_orderkey"), p("lt", "1999-01-01", column="l_shipdate"))
    spark.conf.set("spark.sql.maxMetadataStringLength", "5000")
    plan = ds.view().filter(node).unsorted.select("l_tax")._jdf.queryExecution().executedPlan().toString()
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    pushed = re.search(r"PushedFilters: \[(.*?)\]", plan)[1]
    assert "GreaterThanOrEqual(l_quantity,5.0)" in pushed and "LessThanOrEqual(l_quantity,7.0)" in pushed and "l_orderkey" in pushed and "l_shipdate" in pushed
    assert "l_comment" not in plan and re.search(r"ReadSchema: struct<.*l_tax", plan)


def plain(op, kind, cell, value, value2, cs):
    """A model of one predicate on one cell."""
    if kind == "string":
        fold = lambda x: unicodedata.normalize("NFC", s.js_text(x).strip(s.JS_SPACE)) if cs else unicodedata.normalize("NFC", s.js_text(x).strip(s.JS_SPACE)).lower()
        a, b = fold(cell), fold(value)
        return {"eq": a == b, "neq": a != b, "contains": b in a, "startsWith": a.startswith(b)}.get(op, False)
    if cell is None:
        return False
    if kind == "boolean":
        b = s.js_boolean(value)
        return b is not None and {"eq": cell == b, "neq": cell != b}.get(op, False)
    b = s.js_number(value)
    if op in ("between", "range"):
        lo, hi = (None if x is None or (isinstance(x, str) and not x.strip()) else s.js_number(x) for x in (value, value2))
        return (lo, hi) != (None, None) and (lo is None or cell >= lo) and (hi is None or cell <= hi)
    if b is None:
        return op == "neq"
    return {"eq": cell == b, "neq": cell != b, "gt": cell > b, "lt": cell < b}.get(op, False)


@pytest.mark.parametrize("kind, cells", [("string", ["a", "A ", "", None, "b a", " é", "é", "1"]), ("double", [0.0, 1.0, -2.5, None, 1e9]), ("long", [0, 1, -2, None, 7]), ("boolean", [True, False, None])])
def test_against_a_model(spark, kind, cells):
    rng = random.Random(kind)
    ds = data(spark, kind, cells)
    values = ["a", " A", "", None, "1", 1, 0, "2.5", -2.5, "x", True, "no", "é", 6.5]
    asked = [(rng.choice(list(Op)), rng.choice(values), rng.choice(values), rng.random() < 0.5) for _ in range(120)]
    asked = [a for a in asked if a[0] not in (Op.REGEX, Op.MATCHES, Op.NOT_MATCHES)]
    scope = Scope(ds.schema, lambda _: False)
    got = ds.df.orderBy("__rowId").select(*(compile_predicate(Predicate("v", *a), scope).alias(f"p{i}") for i, a in enumerate(asked))).collect()
    for i, (op, v, v2, cs) in enumerate(asked):
        want = [plain(op, "double" if kind == "long" else kind, c, v, v2, cs) for c in cells]
        assert [r[f"p{i}"] for r in got] == want, (op, v, v2, cs)


# --- filter lists ---------------------------------------------------------------------------------------------------
def test_completeness():
    ok = lists.is_complete
    assert ok(Filter("a", "eq", "x")) and not ok(Filter("a", "eq", "x", enabled=False)) and not ok(Filter("", "eq", "x")) and not ok(Filter("a", "eq", "  "))
    assert ok(Filter("a", "between", None, "2")) and not ok(Filter("a", "range", " ", None)) and ok(Filter("a", "eq", 0))
    assert not ok(Filter(TAG_COLUMN, "eq", None))


def test_equalities_become_alternatives():
    node = lists.compile_filters([Filter("name", "eq", "Alice"), Filter("name", "eq", "Bob"), Filter("age", "gt", 25)])
    assert node.items[0] == Predicate("age", Op.GT, 25)
    assert node.items[1] == any_of(Predicate("name", Op.EQ, "Alice"), Predicate("name", Op.EQ, "Bob"))
    apart = lists.compile_filters([Filter("n", "eq", "a"), Filter("n", "eq", "b", case_sensitive=True), Filter(TAG_COLUMN, "eq", "x"), Filter(TAG_COLUMN, "eq", NO_LABEL)])
    assert [i.value for i in apart.items] == ["x", None, "a", "b"]
    assert lists.compile_filters([Filter("a", "eq", "")]) is None


def test_list_rewrites():
    a, b = Filter("c", Op.EQ, "x", case_sensitive=True), Filter("d", Op.GT, 1)
    assert lists.filter_in([a, b], "c", "y") == [Filter("c", Op.EQ, "y", case_sensitive=True), b]
    assert lists.filter_in([a, b], "c", "x") == [a, b]
    assert lists.filter_in([b], TAG_COLUMN, None) == [b, Filter(TAG_COLUMN, Op.EQ, NO_LABEL)]
    out = lists.filter_out([b], "c", 5)
    assert out == [b, Filter("c", Op.NEQ, 5)] and lists.filter_out(out, "c", 5) == out
    assert lists.toggle_value([a], "c", "x") == [] and lists.toggle_value([a], "c", "z") == [a, Filter("c", Op.EQ, "z")]
    assert lists.only_value([a, b], "c", "z") == [b, Filter("c", Op.EQ, "z")]
    shown = lists.show_only_label([b, Filter(TAG_COLUMN, Op.NEQ, "q")], "l")
    assert shown == [b, Filter(TAG_COLUMN, Op.EQ, "l")]
    both = lists.exclude_label(shown, None)
    assert both[-1] == Filter(TAG_COLUMN, Op.NEQ, NO_LABEL) and lists.exclude_label(both, None) == both and lists.clear_labels(both) == [b]
    said = lists.summarise_labels([*both, Filter(TAG_COLUMN, Op.EQ, "zz")], {"l": "Label"})
    assert said.text == "Labels: Label, Unknown label (zz) • Excluding: No label" and lists.summarise_labels([b], {}) is None
    assert lists.apply_suggestion([Filter("c", Op.EQ, " lgin "), b], "c", "eq", "lgin", "login")[0].value == "login"


def test_ranges_and_defaults():
    f = lists.range_end_from_start(Filter("t", Op.BETWEEN, "2024-02"))
    assert s.iso_text(f.value2) == "2024-02-29T23:59:00Z"
    kept = Filter("t", Op.BETWEEN, "2024", "2025")
    assert lists.range_end_from_start(kept) == kept
    assert lists.default_filter("t", "datetime", 5, 9) == Filter("t", Op.BETWEEN, 5, 9)
    assert lists.default_filter("t", "datetime", now_ms=1).value2 == 1 + lists.DAY_MS
    assert lists.default_filter("t", "string").op == Op.CONTAINS and lists.default_filter(TAG_COLUMN, "string").value == NO_LABEL
    assert F is not None
