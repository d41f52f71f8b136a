import random

import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import EDGE_TEXTS, documents, words
from tidemark.llm import quality_rules as q


def model(text):
    w, t = words(text), text or ""
    windows = {}
    for i in range(len(w) - 7):
        windows.setdefault(tuple(w[i : i + 8]), []).append(i)
    covered = {i + j for at in windows.values() if len(at) > 1 for i in at for j in range(8)}
    lines = [x for x in t.split("\n") if words(x)]
    n = len(w)
    base = (n, sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(covered))
    return (*base, n < 20 or 100 * base[4] > 30 * n)


def texts():
    rng = random.Random(3)
    made = [" ".join(rng.choice("abcd") for _ in range(rng.randrange(60))) for _ in range(30)]
    made += ["\n".join(rng.choice(["same line here", "other # line", " ", "x\ty"]) for _ in range(12)) for _ in range(10)]
    return [*EDGE_TEXTS, *made, *made[:3], "p q r s t u v w x " * 2]


def test_base_figures(spark):
    given = texts()
    got = {r.doc_id: tuple(r)[1:7] for r in q.apply_rules(documents(spark, given)).collect()}
    assert got == {i: model(t) for i, t in enumerate(given, 1)}


def test_verdict_does_not_depend_on_the_order(spark):
    df = documents(spark, texts())
    rules = q.default_rules()
    a = q.apply_rules(df, rules).select("doc_id", "kept").collect()
    b = q.apply_rules(df, rules[::-1]).select("doc_id", "kept").collect()
    alone = q.with_features(df)
    hit = q.base_failed()
    for r in rules:
        hit = hit | r.reject
    c = alone.select("doc_id", (~hit).alias("kept")).collect()
    assert sorted(a) == sorted(b) == sorted(c)


def test_plan_orders_by_rejection_per_cost(spark):
    docs = documents(spark, texts())
    never, always = q.Rule("never", F.lit(False)), q.Rule("always", F.lit(True))
    plan = q.plan_cascade(docs, [never, always])
    assert [r.name for r, _, _ in plan] == ["always", "never"]
    assert [share for *_, share in plan] == [1.0, 0.0]


def test_a_costly_rule_stands_behind_a_cheap_one_that_rejects_as_much(spark):
    docs = documents(spark, [f"{t} {i}" for i in range(60) for t in texts()])
    costly = F.sha2(F.sha2(F.repeat(F.col("text"), 40), 512), 512) != ""
    plan = q.plan_cascade(docs, [q.Rule("a_costly", costly), q.Rule("b_cheap", F.col("n_words") >= 0), q.Rule("c_rare", F.col("n_words") < 0)])
    assert [r.name for r, _, _ in plan] == ["b_cheap", "a_costly", "c_rare"]
    (_, cheap, one), (_, dear, same), _ = plan
    assert one == same == 1.0 and dear > 3 * cheap


def test_sample_of_a_table_of_many_files(spark, tmp_path, monkeypatch):
    docs = documents(spark, texts())
    docs.repartition(9).write.parquet(str(tmp_path / "docs"))
    monkeypatch.setattr(q, "SAMPLE_FILES", 3)
    stored = spark.read.parquet(str(tmp_path / "docs"))
    assert 0 < q._some_files(stored.select("doc_id", "text")).count() < stored.count()
    assert q._some_files(docs).count() == docs.count()
    assert sorted(map(str, q.apply_rules(stored).drop("failed_rule").collect())) == sorted(map(str, q.apply_rules(docs).drop("failed_rule").collect()))


def test_empty_table(spark):
    assert q.apply_rules(documents(spark, []), q.default_rules()).count() == 0


@pytest.mark.parametrize("text, kept", [("word and other things " * 2 + " ".join(f"clean{i}x prose" for i in range(30)), True), ("### $$$ " * 5 + " ".join(f"tok{i}" for i in range(20)), False), (" ".join(f"LOUD{i}WORD!!" for i in range(40)), False)])
def test_clean_stays_and_junk_goes(spark, text, kept):
    assert q.apply_rules(documents(spark, [text])).first().kept is kept
