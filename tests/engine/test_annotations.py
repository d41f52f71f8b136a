import json

import pytest

from tidemark.operators.annotations import InvalidExport, Label, TagStore, clean_ids, default_labels, parse_export
from tidemark.sources import export

LABELS = (Label("a", "Alpha"), Label("b", "Beta"), Label("c", "Gamma"))


def held(store):
    return {r.row_id: (list(r.label_ids), r.note) for r in store.records.collect()}


@pytest.fixture
def store(spark):
    return TagStore.empty(spark, LABELS).tag([1, 2], ["b", "a"], note="seen", now=1).tag([3], ["c"], now=1)


def test_modes(store):
    assert held(store) == {1: (["b", "a"], "seen"), 2: (["b", "a"], "seen"), 3: (["c"], None)}
    assert held(store.tag([1], ["c", "a", " b "], mode="append"))[1] == (["b", "a", "c"], "seen")
    assert held(store.tag([1], ["b"], mode="remove"))[1] == (["a"], "seen")
    assert held(store.tag([1], ["c", "unknown", "c"]))[1] == (["c"], "seen")
    assert held(store.tag([1], None))[1] == ([], "seen")
    assert 3 not in held(store.tag([3], None)) and 1 not in held(store.tag([1], None, note=""))
    assert held(store.tag([9, -1, float("nan")], note="only a note"))[9] == ([], "only a note")
    with pytest.raises(ValueError):
        store.tag([1], ["a"], mode="toggle")


def test_clear_and_catalogue(store):
    assert set(held(store.clear([1, 77]))) == {2, 3}
    gone = store.delete_label("c").delete_label("zz")
    assert set(held(gone)) == {1, 2} and [x.id for x in gone.labels] == ["a", "b"]
    assert held(store.delete_label("a").delete_label("b"))[1] == ([], "seen")
    named = store.upsert_label(Label("a", "  ", "", created_at=99), now=7)
    assert named.labels[0] == Label("a", "Untitled label", "#8899ff", None, 0, 7)
    assert store.upsert_label(Label("n", " New "), now=7).labels[-1] == Label("n", "New", "#8899ff", None, 7, 7)


def test_defaults(spark):
    assert len(default_labels()) == 14 and TagStore.empty(spark).labels == default_labels() and TagStore.empty(spark, ()).labels == ()


def test_export_import(store, spark, tmp_path):
    out = store.export({"fileName": "x.csv"}, now=5)
    assert out["version"] == 1 and out["payload"]["tags"]["3"] == {"labelIds": ["c"], "updatedAt": 1}
    back = TagStore.empty(spark, ()).import_(json.dumps(out), "replace")
    assert held(back) == held(store) and back.labels == store.labels
    store.save(str(tmp_path / "t.json"))
    assert held(TagStore.load(spark, str(tmp_path / "t.json"))) == held(store)
    assert TagStore.load(spark, str(tmp_path / "none.json")).labels == default_labels()


def test_import_strategies(store):
    payload = {"labels": [{"id": "a", "name": "Renamed", "color": "#1"}, {"id": "n", "name": "New", "color": "#2"}], "tags": {"1": {"labelIds": ["n"]}, "2": {"labelId": "a", "note": "other"}, "x": {"labelIds": ["a"]}, "5": {"labelIds": ["zz"]}, "6": None}}
    merged = store.import_(payload, now=3)
    assert held(merged) == {1: (["n"], "seen"), 2: (["a"], "other"), 3: (["c"], None)} and merged.label_names() == {"a": "Renamed", "b": "Beta", "c": "Gamma", "n": "New"}
    assert held(store.import_(payload, "replace", now=3)) == {1: (["n"], None), 2: (["a"], "other")}
    with pytest.raises(ValueError):
        store.import_(payload, "both")


@pytest.mark.parametrize("bad", ["{", "[]", {"version": 2, "payload": {"labels": [], "tags": {}}}, {"version": 1, "payload": {"labels": [{}], "tags": {}}}, {"labels": [], "tags": []}, {}])
def test_invalid_exports(bad):
    with pytest.raises(InvalidExport):
        parse_export(bad, 0)


def test_clean_ids():
    assert clean_ids([" a ", "a", "", None, 5, "b"]) == ["a", "b"] and clean_ids(None) == []


def test_cells_and_clipboard(store, spark):
    from tidemark.dataset import Dataset

    ds = Dataset.of(spark.createDataFrame([(1, "x\ty"), (3, "z"), (4, None)], "__rowId long, v string"), "__rowId").with_tags(store.tag([3], note="  "))
    rows = {r["__rowId"]: r["__tag"] for r in ds.with_tag_cells().collect()}
    assert [x.name for x in rows[1].labels] == ["Beta", "Alpha"] and rows[1].note == "seen" and rows[3].note is None and rows[4] is None
    text = export.clipboard_text(ds.with_tag_cells().orderBy("__rowId").select("v", "__tag"), ["the\tcolumn", "Tag"])
    assert text.split("\n") == ["the column\tTag", "x y\tBeta, Alpha | note: seen", "z\tGamma", "\t"]
