"""Queries that answer for every row and the whole of each text."""

import hashlib
import unicodedata

from tidemark.queries import QUERIES


def test_norm_reads_texts_to_their_end(spark, tmp_path):
    texts = ["  " + "word " * 40 + "CAFE\u0301 \n", "short", None, "a" * 60 + "E\u0301", "a" * 60 + "\u00c9"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = [unicodedata.normalize("NFC", (t or "").strip()).lower() for t in texts]
    got = {r.doc_id: (r.n_chars, r.digest) for r in QUERIES["fn_norm"](spark, str(tmp_path)).collect()}
    assert got == {i: (len(t), hashlib.md5(t.encode()).hexdigest()) for i, t in enumerate(want)}
    assert got[3] == got[4]


def test_sorts_rank_every_row(spark, tmp_path, monkeypatch):
    n = 5000
    brands = spark.range(n).selectExpr("id AS p_partkey", "concat('Brand#', id * 7919 % 120) AS p_brand", "CAST(id % 50 AS INT) AS p_size", "'x' AS p_name", "'y' AS p_type")
    brands.repartition(7).write.parquet(f"{tmp_path}/part.parquet")
    monkeypatch.setattr("tidemark.queries._scratch", lambda spark, name: f"{tmp_path}/{name}-{next(folders)}")
    folders = iter(range(9))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # several ranges, however few rows
    natural = sorted(range(n), key=lambda i: (i * 7919 % 120, i))
    got = QUERIES["sort_string_natural"](spark, str(tmp_path)).collect()
    assert [r.p_partkey for r in sorted(got, key=lambda r: r.rank)] == natural
    assert sorted(r.rank for r in got) == list(range(1, n + 1))
    by_size = QUERIES["sort_num_desc_tiebreak"](spark, str(tmp_path)).collect()
    assert [r.p_partkey for r in sorted(by_size, key=lambda r: r.rank)] == sorted(range(n), key=lambda i: (-(i % 50), i))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert spark.read.parquet(f"{tmp_path}/ranked-0").selectExpr("shiftright(__tm_at, 33)").distinct().count() > 1


def test_datetime_nulls_are_ranked_at_both_ends(spark, sf, tmp_path, monkeypatch):
    folders = iter(range(9))
    monkeypatch.setattr("tidemark.queries._scratch", lambda spark, name: f"{tmp_path}/{name}-{next(folders)}")
    n = spark.read.parquet(f"{sf}/events.parquet").count()
    got = QUERIES["sort_datetime_nulls"](spark, sf).collect()
    down = {r.event_id: r.rank for r in got[:n]}
    up = {-r.event_id: r.rank for r in got[n:]}
    assert len(got) == 2 * n and sorted(down.values()) == sorted(up.values()) == list(range(1, n + 1))
    empty = [i for i in down if i % 7 == 0]
    assert max(down[i] for i in empty) == len(empty) and min(up[i] for i in empty) == n - len(empty) + 1


def test_inference_keeps_keys_that_are_written_like_truth_values(spark, sf):
    rows = QUERIES["infer_all_rows"](spark, sf)
    orders = spark.read.parquet(f"{sf}/orders.parquet").select(*rows.columns)
    assert orders.where("o_orderkey <= 1").count() > 0
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, orders.collect()))


def test_queries_ask_the_data_for_normal_form(spark, tmp_path):
    names = ["pale", "cafe\u0301", "caf\u00e9"]
    rows = [(i, t, "Brand#1", "x", 1) for i, t in enumerate(names)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_brand string, p_type string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    # an e with an accent is no e, however it is written
    assert [r.p_partkey for r in QUERIES["filter_contains"](spark, str(tmp_path)).collect()] == [0]
