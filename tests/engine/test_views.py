from datetime import datetime

import pytest

from tidemark.dataset import Dataset
from tidemark.operators import profile
from tidemark.operators.grouping import sanitise
from tidemark.operators.suggest import farthest
from tidemark.plans.nodes import Aggregation, Op, Predicate, Sort, all_of


@pytest.fixture(scope="module")
def people(spark):
    rows = [(0, "Alice", 42.0, True, datetime(2024, 1, 1)), (1, "bob", 17.0, False, datetime(2024, 2, 1)), (2, "Charlie", 42.0, True, datetime(2023, 12, 31))]
    return Dataset.of(spark.createDataFrame(rows, "__rowId long, name string, score double, active boolean, timestamp timestamp_ntz"), "__rowId")


def order(ds, *sorts):
    return [r["__rowId"] for r in ds.view().sort([Sort(c, d) for c, d in sorts]).df.collect()]


def table(spark, kind, values):
    return Dataset.of(spark.createDataFrame(list(enumerate(values)), f"__rowId long, value {kind}"), "__rowId")


def test_sorts(people, spark):
    assert order(people, ("score", False)) == [1, 0, 2]
    assert order(people, ("score", True), ("name", False)) == [0, 2, 1]
    assert order(people, ("timestamp", False)) == [2, 0, 1]
    assert order(people, ("active", False)) == [1, 0, 2]
    assert order(people, ("nowhere", False)) == [0, 1, 2]
    assert order(people, ("name", True)) == [2, 1, 0]


def test_null_and_tie_rules(spark):
    assert order(table(spark, "string", ["a", None, "b", None]), ("value", False)) == [1, 3, 0, 2]
    assert order(table(spark, "double", [10.0, 5.0, None, 20.0]), ("value", False)) == [2, 1, 0, 3]
    odd = table(spark, "double", [float("nan"), 1.0, float("inf"), -1.0])
    assert order(odd, ("value", False)) == [3, 1, 0, 2] and order(odd, ("value", True)) == [0, 2, 1, 3]
    assert order(table(spark, "string", ["apple", "Apple", "banana", "Banana", "cherry"]), ("value", False)) == [0, 1, 2, 3, 4]
    days = table(spark, "timestamp_ntz", [None, datetime(2024, 1, 1), datetime(2023, 1, 1)])
    assert order(days, ("value", False)) == [2, 1, 0] and order(days, ("value", True)) == [0, 1, 2]
    assert order(table(spark, "boolean", [True, None, False]), ("value", True)) == [0, 1, 2]


def test_pages(people):
    view = people.view().sort([Sort("score")])
    page = view.page(1, 1)
    assert [r["__rowId"] for r in page.rows] == [0] and (page.total_rows, page.matched_rows) == (3, 3)
    assert [r["__rowId"] for r in view.page(-5).rows] == [1, 0, 2]
    assert view.page(0, 0).rows == [] == view.page(9, 5).rows
    assert [r["__rowId"] for r in people.rows([2, 9, 0]).collect()] == [2, 0]
    assert [r["__rowId"] for r in people.range(1, 5).collect()] == [1, 2]


def test_page_plans_as_top_k(people):
    plan = people.view().sort([Sort("score", True)]).window(10, 5)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject(limit=15" in plan


@pytest.fixture(scope="module")
def cities(spark):
    rows = [(0, "Alice", "Paris"), (1, "Bob", "London"), (2, "Carol", "Paris"), (3, "Dave", "Paris"), (4, "Eve", "London")]
    return Dataset.of(spark.createDataFrame(rows, "__rowId long, name string, city string"), "__rowId")


def test_search(cities, spark):
    view = cities.view().filter(Predicate("city", Op.EQ, "Paris")).search("A", ["name"])
    assert view.counts() == (3, 3) and {r.name for r in view.unsorted.collect()} == {"Alice", "Carol", "Dave"}
    assert cities.view().search("A", ["name"], True).counts() == (5, 1)
    assert cities.view().search("par").sort([Sort("name", True)]).page(0, 2).rows[0].name == "Dave"
    assert view.search("  ") == view.clear_search() and view.search("x", ["nowhere"]).counts() == (3, 0)
    assert view.sort([Sort("name")]).filter(None).sorts == (Sort("name"),)
    typed = table(spark, "double", [30.0, 0.5, None])
    assert typed.view().search("30").counts()[1] == 1 and typed.view().search("30.0").counts()[1] == 0


def test_groups(spark):
    df = spark.createDataFrame([(0, "A", 10.0, "delta"), (1, "A", None, "alpha"), (2, "B", 5.0, "gamma")], "__rowId long, category string, amount double, tag string")
    view = Dataset.of(df, "__rowId").view()
    aggs = [Aggregation("count"), Aggregation("count", "amount"), *(Aggregation(op, "amount") for op in ("sum", "min", "max", "avg"))]
    a, b = view.group_by("category", aggs).df.collect()
    assert tuple(a) == ("A", 2, 1, 10.0, 10.0, 10.0, 10.0, 2) and tuple(b) == ("B", 1, 1, 5.0, 5.0, 5.0, 5.0, 1)
    grouped = view.group_by("category")
    assert [r.category for r in grouped.page(1, 1).collect()] == ["B"] and grouped.page(0, 0).count() == 0 and grouped.totals() == (2, 3)
    assert [r[1] for r in view.group_by("category", [Aggregation("min", "tag")]).df.collect()] == ["alpha", "gamma"]
    assert [r.s for r in view.group_by("category", [Aggregation("sum", "missing", "s")]).df.collect()] == [None, None]
    assert [r.category for r in view.sort([Sort("tag", True)]).group_by("category").df.collect()] == ["B", "A"]
    assert view.filter(Predicate("category", Op.EQ, "Z")).group_by("category").df.count() == 0
    assert view.group_by("nowhere").df.collect()[0]["rows"] == 3
    with pytest.raises(ValueError):
        view.group_by([])
    with pytest.raises(ValueError):
        Aggregation("median", "amount")
    last = view.group_by("category", [Aggregation("min", "amount", "x"), Aggregation("max", "amount", "x")]).df
    assert last.columns == ["category", "x", "rows"]


def test_aggregation_lists():
    assert sanitise([Aggregation("sum"), Aggregation("sum", "a", " s "), Aggregation("count", "a")]) == [Aggregation("sum", "a", "s"), Aggregation("count")]
    assert sanitise([]) == [Aggregation()]
    assert [a.name for a in (Aggregation(), Aggregation("count", "a"), Aggregation("sum", "a"))] == ["count", "count(a)", "sum(a)"]


def test_distributions(cities, spark):
    d = cities.value_distribution("city")
    assert [tuple(r) for r in d.items.collect()] == [("Paris", 3), ("London", 2)] and (d.distinct, d.skipped) == (2, None)
    assert cities.value_distribution("city") is d
    assert cities.value_distribution("name").skipped == "Too many unique values"
    assert cities.value_distribution("nowhere").total_rows == 0
    truth = table(spark, "boolean", [True, False, True, False, None])
    assert [tuple(r) for r in truth.value_distribution("value").items.collect()] == [("false", 2), ("true", 2)]
    assert profile.may_have_distribution(truth.df, "value") and not profile.may_have_distribution(truth.df, "__rowId")


def test_profiles(people):
    rows = {r.column: r for r in people.profile().collect()}
    assert rows["timestamp"].type == "datetime" and rows["timestamp"].min_ms == 1703980800000 and rows["score"].nulls == 0
    assert [r.value for r in profile.examples(people.df, "score", "__rowId").collect()] == ["42", "17"]


def test_suggestions(spark):
    ds = table(spark, "string", ["login success", "payment complete", "Login  Success", None, ""])
    report = ds.view().filter(all_of(Predicate("value", Op.EQ, "login sucess"))).filter_report()
    assert report.did_you_mean.suggestions[0] == "login success" and report.matched_rows == 0
    assert ds.view().filter(Predicate("value", Op.EQ, "login success")).filter_report().did_you_mean is None
    assert [farthest(x) for x in ("ab", "abc", " abcd ", "abcde")] == [0, 1, 1, 2]
    spelt = table(spark, "string", ["Kitten ", "kitten", "KITTEN", "mittens", "kitty", "kittens"])
    found = spelt.view().filter(Predicate("value", Op.EQ, "kittem")).filter_report().did_you_mean
    assert found.suggestions == ("Kitten", "kittens", "kitty")


@pytest.mark.parametrize("sorts", [[], [("value", False)], [("value", True)], [("name", True), ("value", False)], [("at", True)], [("at", False), ("name", True)]])
def test_rest_of_a_view_from_any_row_on(spark, sorts):
    import random

    rng = random.Random(3)
    rows = [(k, rng.choice([None, 1.0, 2.0, float("nan")]), rng.choice([None, "a2", "a10", "b"]), rng.choice([None, datetime(2024, 1, 1), datetime(2024, 1, 2)])) for k in range(40)]
    ds = Dataset.of(spark.createDataFrame(rows, "__rowId long, value double, name string, at timestamp_ntz").repartition(4), "__rowId")
    view = ds.view().sort([Sort(c, d) for c, d in sorts])
    whole = [r["__rowId"] for r in view.df.collect()]
    for offset in (0, 1, 17, 39, 40, 50):
        page = view.window(offset)
        assert page.columns == view.df.columns and [r["__rowId"] for r in page.collect()] == whole[offset:]
    assert "CollectLimit -1" not in view.window(5)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("sorts", [[("name", True)], [("name", True), ("score", False)], [("active", True), ("name", True), ("timestamp", False)], [("name", True), ("other", False)], [("score", False), ("name", False), ("other", True)]])
def test_groups_come_in_the_order_of_their_first_rows(spark, sorts):
    import random

    rng = random.Random(7)
    names = [None, "a2", "a10", "B", "b", "\u00c9"]
    rows = [(k, rng.choice(names), rng.choice([None, 1.0, 2.0]), rng.choice([None, True, False]), rng.choice([None, datetime(2024, 1, 1), datetime(2024, 1, 2)]), rng.choice(names), rng.choice([None, "x", "y", "z"])) for k in range(60)]
    ds = Dataset.of(spark.createDataFrame(rows, "__rowId long, name string, score double, active boolean, timestamp timestamp_ntz, other string, g string"), "__rowId")
    view = ds.view().sort([Sort(c, d) for c, d in sorts])
    for keys in (["g"], ["g", "active"]):
        grouped = view.group_by(keys)
        seen = dict.fromkeys(tuple(r[k] for k in keys) for r in view.df.collect())
        assert [tuple(r[k] for k in keys) for r in grouped.df.collect()] == list(seen)
    assert ("Window" in grouped.df._jdf.queryExecution().executedPlan().toString()) == any(c == "other" for c, _ in sorts)
