from tidemark.plans import session
from tidemark.plans.layout import Layout, sorts_from_columns
from tidemark.plans.nodes import Aggregation, Filter, Op, Sort


def test_layout():
    one = Layout(("b", "gone", "a"), frozenset({"c"}))
    assert one.ordered("abcd") == ["b", "a", "c", "d"] and one.visible("abcd") == ["b", "a", "d"]
    assert one.toggle("c").visible("abc") == ["b", "a", "c"] and one.toggle("a").visible("abc") == ["b"]
    assert one.show_all().visible("abc") == ["b", "a", "c"] and one.hide_all("abc").visible("abc") == []
    assert one.move("abc", 2, 0).order == ("c", "b", "a")
    assert Layout.initial({"a": 0, "b": 5}, 5).visible("ab") == ["a"]


def test_sort_states():
    states = [{"column": "a", "sort": "desc", "sort_index": 1}, {"column": "b", "sort": None}, {"column": "c", "sort": "asc", "sort_index": 0}]
    assert sorts_from_columns(states) == [Sort("c"), Sort("a", True)]


def test_storage_key():
    assert session.storage_key("My  File.csv", 12.7, 99) == "my-file-csv-12-99"
    assert session.storage_key("  ", None, float("nan")) == "dataset-0-0"
    assert session.storage_key("x" * 100, -5, 1) == "x" * 64 + "-0-1"


def test_sessions(tmp_path):
    state = session.SessionState((Filter("a", Op.EQ, "x"),), (Sort("b", True),), ("c",), (Aggregation("sum", "d"),), Layout(("a",), frozenset("b")), "q", True)
    assert session.SessionState.from_json(state.to_json()) == state
    folder = session.SessionFolder(tmp_path / "s")
    assert folder.load() is None
    for k in range(6):
        folder.save(state, now=1000.0 + k)
    assert len(list((tmp_path / "s").glob("history-*.json"))) == 3 and folder.load() == state
    (tmp_path / "s" / "latest.json").write_text("{broken")
    assert folder.load() == state
    folder.save(state, now=1000.0 + 30 * 86_400)
    assert len(list((tmp_path / "s").glob("history-*.json"))) == 1


def test_sessions_on_a_shared_file_system(spark, tmp_path):
    from tidemark.sources.sidefiles import SharedFiles

    files, url = SharedFiles(spark), f"file://{tmp_path}/s"
    folder = session.SessionFolder(url, files)
    assert folder.load() is None and files.names(url) == []
    states = [session.SessionState(search=f"é{k}") for k in range(5)]
    for k, state in enumerate(states):
        folder.save(state, now=1000.0 + k)
    assert folder.load() == states[-1] and len(files.names(url)) == 4
    assert session.SessionFolder(tmp_path / "s").load() == states[-1]
    (tmp_path / "s" / "latest.json").write_text("{broken")
    assert folder.load() == states[-1]
    files.remove(f"{url}/latest.json")
    assert files.read(f"{url}/latest.json") is None and files.size(url) > 0


def test_quota():
    entries = [("s", "sessions", 50, 1), ("c1", "row-cache", 80, 9), ("c2", "row-cache", 80, 3), ("a", "annotations", 50, 0)]
    assert session.over_quota(entries, 260) == [] and session.over_quota(entries, 200) == ["c2"] and session.over_quota(entries, 60) == ["c2", "c1", "a"]
