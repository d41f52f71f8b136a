from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.dataset import checkpoints
from tidemark.functions import scalars as s
from tidemark.functions.distance import is_similar, may_be_within, osa, osa_column
from tidemark.functions.text import display, natural_key, norm, trimmed


@pytest.mark.parametrize("value, number", [("", 0.0), ("  ", 0.0), (" 12 ", 12.0), ("1e5", 1e5), (".5", 0.5), ("5.", 5.0), ("0x1F", 31.0), ("0b11", 3.0), ("0o17", 15.0), ("1,000", None), ("Infinity", None), ("12d", None), ("x", None), (True, None), (None, None), (7, 7.0), (float("nan"), None), ("1e999", None)])
def test_js_number(value, number):
    assert s.js_number(value) == number


@pytest.mark.parametrize("value, truth", [("Yes", True), (" t ", True), ("1", True), (1, True), ("N", False), (0, False), ("2", None), (2, None), (None, None), (True, True)])
def test_js_boolean(value, truth):
    assert s.js_boolean(value) is truth


@pytest.mark.parametrize("text, iso", [("2024-01-15", "2024-01-15T00:00:00Z"), ("2024", "2024-01-01T00:00:00Z"), ("2024-01-15T10:20:30.5Z", "2024-01-15T10:20:30.500Z"), ("2024-01-15T10:20+02:00", "2024-01-15T08:20:00Z"), ("Oct 14 2025 01:44:33", "2025-10-14T01:44:33Z"), ("10/14/2025", "2025-10-14T00:00:00Z"), ("14-Oct-2025", "2025-10-14T00:00:00Z"), ("October 14, 2025", "2025-10-14T00:00:00Z"), ("1969-12-31T23:59:59.999Z", "1969-12-31T23:59:59.999Z")])
def test_dates(text, iso):
    assert s.iso_text(s.parse_date(text)) == iso


def test_no_dates():
    assert [s.parse_date(x) for x in ("hello", "2024-13-01", "2024-02-30", "")] == [None] * 4


@pytest.mark.parametrize("text, end, iso", [("2024", False, "2024-01-01T00:00:00Z"), ("2024", True, "2024-12-31T23:59:00Z"), ("2024-02", True, "2024-02-29T23:59:00Z"), ("2023-02", True, "2023-02-28T23:59:00Z"), ("2024-03-05", True, "2024-03-05T23:59:00Z"), ("2024-03-05T07", True, "2024-03-05T07:59:00Z"), ("2024-03-05T07:08", True, "2024-03-05T07:08:00Z"), ("2024-03-05T07:08:59", False, "2024-03-05T07:08:00Z")])
def test_partial_datetimes(text, end, iso):
    assert s.iso_text(s.parse_partial_datetime(text, end)) == iso


def test_partial_datetimes_that_are_none():
    assert [s.parse_partial_datetime(x) for x in ("", "x", "2024-13", "2024-01-01T00:00Z")] == [""] * 4


NUMBERS = [(30.0, "30"), (0.1, "0.1"), (-0.0, "0"), (1e7, "10000000"), (123456789.25, "123456789.25"), (1e21, "1e+21"), (1.5e22, "1.5e+22"), (1e-6, "0.000001"), (1.5e-7, "1.5e-7"), (-1234.5, "-1234.5"), (1e20, "100000000000000000000"), (0.00012, "0.00012"), (float("nan"), "NaN"), (float("-inf"), "-Infinity"), (2.0**53, "9007199254740992")]


@pytest.mark.parametrize("x, text", NUMBERS)
def test_number_text(x, text):
    assert s.number_text(x) == text


def test_number_text_column(spark):
    df = spark.createDataFrame([(x,) for x, _ in NUMBERS] + [(None,)], "x double")
    assert [r.t for r in df.select(display(F.col("x"), T.DoubleType()).alias("t")).collect()] == [t for _, t in NUMBERS] + [None]
    whole = spark.sql("select cast(5 as bigint) i, cast('12.50' as decimal(9,2)) d, cast(0 as decimal(9,2)) z, true b, timestamp_ntz'2024-01-02 03:04:05.120' t")
    assert [whole.select(display(F.col(f.name), f.dataType)).first()[0] for f in whole.schema] == ["5", "12.5", "0", "true", "2024-01-02T03:04:05.120Z"]


def test_js_text():
    assert [s.js_text(v) for v in (None, True, 1.0, "a", datetime(2024, 1, 1, tzinfo=timezone.utc))] == ["", "true", "1", "a", "2024-01-01T00:00:00Z"]


@pytest.mark.parametrize("n, text", [(0, "0 B"), (-5, "0 B"), (512, "512 B"), (1024, "1.0 KB"), (1536, "1.5 KB"), (5 * 1024**2, "5.0 MB"), (3 * 1024**4, "3072.0 GB")])
def test_format_bytes(n, text):
    assert s.format_bytes(n) == text


@pytest.mark.parametrize("a, b, d", [("ab", "ba", 1), ("hello", "hlelo", 1), ("kitten", "sitting", 3), ("saturday", "sunday", 3), ("", "a", 1), ("", "", 0), ("ca", "abc", 3), ("same", "same", 0)])
def test_osa(a, b, d):
    assert osa(a, b) == osa(b, a) == d
    assert is_similar(a, b, d) and (d == 0 or not is_similar(a, b, d - 1))


def test_osa_bound():
    assert osa("abcdef", "azced", 2) == 3
    assert osa("abc", "xyzuvw", 1) == 2


def test_native_bound_lets_all_near_values_through(spark):
    import itertools

    words = ["".join(w) for n in range(1, 6) for w in itertools.product("ab", repeat=n)]
    df = spark.createDataFrame([(w,) for w in words], "w string")
    got = df.select("w", may_be_within(F.col("w"), "abab", 2).alias("may"), osa_column(F.col("w"), "abab", 9).alias("d")).collect()
    assert all(r.d == osa(r.w, "abab") for r in got) and all(r.may for r in got if r.d <= 2)


def test_text_columns(spark):
    df = spark.createDataFrame([("  ÉCLAIR﻿ ",), ("éclair",), (None,)], "t string")
    assert [r[0] for r in df.select(norm(F.col("t"), composed=False)).collect()] == ["éclair", "éclair", ""]
    assert [r[0] for r in df.select(norm(F.col("t"), True, composed=False)).collect()] == ["ÉCLAIR", "éclair", ""]
    assert df.select(trimmed(F.col("t"))).first()[0] == "ÉCLAIR"


def test_natural_key_orders(spark):
    words = ["file10", "File9", "file2", "", None, "fíle2b", "file002c", "9", "10", "a" * 3 + "1" * 30, "a" * 3 + "2" + "1" * 29]
    df = spark.createDataFrame(list(enumerate(words)), "i int, t string")
    order = [r.i for r in df.orderBy(natural_key(F.col("t")), "i").collect()]
    assert order == [3, 4, 7, 8, 9, 10, 2, 5, 6, 1, 0]


def test_checkpoints():
    assert checkpoints(120_000, 100_000) == [100_000, 150_000, 200_000]
    assert checkpoints(0, 10) == [0] and checkpoints(5, 0) is None and checkpoints(0, 10, total=0) is None
    assert checkpoints(40_000, 100_000, total=60_000) == [0, 50_000]
