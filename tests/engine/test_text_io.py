import gzip
from datetime import datetime, timezone

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tidemark.dataset import Dataset
from tidemark.operators.predicates import column
from tidemark.plans.nodes import Kind, Op, Predicate
from tidemark.sources import delimited as d
from tidemark.sources import export, inference, plaincells
from tidemark.streaming import ingest


def write(tmp_path, name, text, encoding="utf-8"):
    path = tmp_path / name
    data = text.encode(encoding)
    path.write_bytes(gzip.compress(data) if name.endswith(("gz", "gzip")) else data)
    return str(path)


def read(spark, path, **options):
    raw = d.read_text(spark, path, **options)
    return [tuple(r)[1:] for r in raw.df.orderBy("__rowId").collect()]


QUOTED = 'name,age,notes\r\n"Alice, A.",30,"Loves ""quoted"" text"\r\nBob,25,\r\n'


@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("name, text, rows", [
    ("q.csv", QUOTED, [("Alice, A.", "30", 'Loves "quoted" text'), ("Bob", "25", "")]),
    ("t.tsv", 'title\tcomment\n"Newline"\tSecond\n"Spans\nlines"\tRow', [("Newline", "Second"), ("Spans\nlines", "Row")]),
    ("s.csv", 'a;b;c\n1;"x;y";3\n4;5;6\n', [("1", "x;y", "3"), ("4", "5", "6")]),
    ("u.csv", "city,note\nMontréal,ok\n東京,\U0001f600\n", [("Montréal", "ok"), ("東京", "\U0001f600")]),
    ("r.csv", "a,b,c\n1\n1,2,3,4\n , x ,\n", [("1", "", ""), ("1", "2", "3"), (" ", " x ", "")]),
    ("z.csv.gz", "a,b\n1,2\n", [("1", "2")]),
    ("z.tsv.gzip", "a\tb\n1\t2\n", [("1", "2")]),
    ("bom.csv", "﻿a,b\n1,2\n", [("1", "2")]),
    ("empty.csv", "a,b\n", []),
])
def test_readers(spark, tmp_path, name, text, rows, strict):
    assert read(spark, write(tmp_path, name, text), strict=strict) == rows


def test_strict_rules(spark, tmp_path):
    assert read(spark, write(tmp_path, "blank.csv", "a,b\n\n1,2\n\n"), strict=True) == [("", ""), ("1", "2"), ("", "")]
    assert read(spark, write(tmp_path, "cr.csv", "a,b\r1,2\r\r\n3,4"), strict=True) == [("1", "2"), ("", ""), ("3", "4")]
    assert read(spark, write(tmp_path, "mid.csv", 'a,b\nmid"quo,"te,2\n'), strict=True) == [("midquo,te", "2")]
    assert read(spark, write(tmp_path, "latin.csv", "a\né\n", "latin-1"), strict=True, encoding="latin-1") == [("é",)]


@pytest.mark.parametrize("size", ["7", "20", "64", "1000"])
def test_strict_splits_give_the_same_rows(spark, tmp_path, size):
    import random

    rng = random.Random(size)
    bits = ["a", "bc", ",", ",", '"', '""', "\n", "\r\n", "\r", " ", "é", '"x\ny"', '"q,""q"']
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", size)
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        want = []
        folder = tmp_path / "in"
        folder.mkdir()
        for f in range(3):
            text = "h1,h2,h3\n" + "".join(rng.choice(bits) for _ in range(rng.choice([0, 30, 120]))) + rng.choice(["", "\n", '"open\ncell', "\r"])
            (folder / f"{f}.csv").write_bytes(text.encode())
            if text.count('"') % 2:
                text = text.removesuffix("\n")  # the one line end that cannot be told from none
            want += [tuple((r + ["", "", ""])[:3]) for r in list(d.records([text], ","))[1:]]
        raw = d.read_text(spark, str(folder), delimiter=",", strict=True)
        got = raw.df.orderBy("__rowId").collect()
        assert [tuple(r)[1:] for r in got] == want and [r["__rowId"] for r in got] == list(range(len(want)))
        assert raw.plain.count() == len(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


def test_records_do_not_depend_on_pieces():
    text = QUOTED + '\r"a\nb""",x\r\n\n"open'
    whole = list(d.records([text], ","))
    for k in range(1, 9):
        assert list(d.records([text[i : i + k] for i in range(0, len(text), k)], ",")) == whole


def test_row_ids_are_dense_over_files_and_splits(spark, tmp_path):
    for f in range(3):
        (tmp_path / f"part-{f}.csv").write_text("n\n" + "".join(f"{f * 1000 + k}\n" for k in range(1000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    try:
        rows = d.read_text(spark, str(tmp_path), multiline=False).df.collect()
        assert sorted((r["__rowId"], int(r.n)) for r in rows) == [(k, k) for k in range(3000)]
        spark.range(500).coalesce(1).write.parquet(str(tmp_path / "p"))
        ids = Dataset.read_parquet(spark, str(tmp_path / "p")).df.collect()
        assert all(r["__rowId"] == r.id for r in ids)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_headers_and_delimiters():
    assert d.header_names([" a ", "a", "a_2", "", ""]) == ["a", "a_2", "a_2_2", "column_4", "column_5"]
    assert [d.detect_delimiter(x) for x in ("a,b;c,d", "a\tb", "a;b\n,,,", '"a,b";c', "abc", "a,b;c\nd", "a;b\tc;d")] == [",", "\t", ";", ";", ",", ",", ";"]
    assert [d.is_gzip(x) for x in ("a.csv.gz", "a.TSV.gzip", "a.txt.gz", "a.csv")] == [True, True, False, False] and d.is_gzip("x", "application/gzip")


def test_a_missing_file(spark, tmp_path):
    with pytest.raises(Exception, match="none"):
        d.read_text(spark, str(tmp_path / "none.csv"))


KINDS = [("", None), ("  ", None), ("2024-01-15T10:00:00Z", "datetime"), ("1700000000", "datetime"), ("1700000000000", "datetime"), ("Oct 14 2025 01:44:33", "datetime"), ("10/14/2025", "datetime"), ("14-Oct-2025", "datetime"), ("yes", "boolean"), ("1", "boolean"), ("F", "boolean"), ("42", "number"), ("1e5", "number"), ("0x1F", "number"), (".5", "number"), ("-3", "number"), ("1,000", "string"), ("Infinity", "string"), ("12d", "string"), ("NaN", "string"), ("hello", "string"), ("2024-13-01", "string")]


def test_kinds(spark):
    df = spark.createDataFrame([(t,) for t, _ in KINDS], "t string")
    assert [r.kind for r in inference.kinds(df.coalesce(1), ["t"]).collect()] == [k for _, k in KINDS]


def test_values(spark):
    df = spark.createDataFrame([("1700000000",), ("2024-01-15T10:00+02:00",), ("oct 14 2025",), ("5",), ("x",)], "t string")
    got = [r[0] for r in df.select(F.date_format(inference.coerce(F.col("t"), Kind.DATETIME), "yyyy-MM-dd HH:mm:ss.SSS")).collect()]
    assert got == ["2023-11-14 22:13:20.000", "2024-01-15 08:00:00.000", "2025-10-14 00:00:00.000", "1970-01-01 00:00:00.005", None]


def test_column_types(spark):
    assert inference.decide({Kind.DATETIME: 3}) == (Kind.DATETIME, 1.0)
    assert inference.decide({Kind.DATETIME: 1, Kind.STRING: 2})[0] == Kind.STRING
    assert inference.decide({Kind.NUMBER: 84, Kind.BOOLEAN: 16})[0] == Kind.STRING
    assert inference.decide({Kind.BOOLEAN: 9, Kind.NUMBER: 1}) == (Kind.BOOLEAN, 0.9)
    assert inference.decide({}) == (Kind.STRING, 1.0)


def test_people(spark, tmp_path):
    ds = Dataset.read_csv(spark, write(tmp_path, "people.csv", "name,age\nAlice,30\nBob,25\n"))
    assert [tuple(r) for r in ds.df.orderBy("__rowId").collect()] == [(0, "Alice", 30.0), (1, "Bob", 25.0)]
    loaded = d.read_typed(spark, write(tmp_path, "n.csv", "n\n0\n1\n" + "5\n" * 20))
    assert [r.n for r in loaded.df.orderBy("__rowId").limit(3).collect()] == [None, None, 5.0] and loaded.rows == 22
    lenient = d.read_typed(spark, str(tmp_path / "n.csv"), lenient=True).df
    assert [r.n for r in lenient.orderBy("__rowId").limit(3).collect()] == [0.0, 1.0, 5.0]


def test_csv_out(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "b"', None, 30.0, True), (2, "x\ny", "", 0.5, None)], "id int, t string, n string, d double, b boolean")
    for gz in (False, True):
        path = str(tmp_path / f"out{gz}")
        export.write_csv(df.orderBy("id"), path, gzip=gz, one_file=True)
        (file,) = [p for p in (tmp_path / f"out{gz}").iterdir() if p.name.startswith("part-")]
        data = gzip.decompress(file.read_bytes()) if gz else file.read_bytes()
        assert data.decode() == '"id","t","n","d","b"\n"1","a ""b""","","30","true"\n"2","x\ny","","0.5",""\n'
    assert [r[0] for r in df.orderBy("id").select(export.csv_line(df)).collect()] == ['"1","a ""b""","","30","true"', '"2","x\ny","","0.5",""']
    assert export.csv_text(["a", "b"], [['x"', None]]) == '"a","b"\n"x""",""'


def test_names():
    now = datetime(2025, 1, 2, 3, 4, 5, 678000, tzinfo=timezone.utc)
    assert export.export_name("a.b.csv", ".csv.gz", now) == "data_export_a.b_2025-01-02T03-04-05.csv.gz"
    assert export.annotations_name("My File (1).csv", now) == "my-file-1-annotations-2025-01-02T03-04-05-678Z.json"
    assert export.annotations_name(None, now).startswith("annotations-annotations-")


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for k in range(3):
        (tmp_path / "in" / f"{k}.csv").write_text("name,age\n" + "".join(f"p{k}{i},{i + 20}\n" for i in range(10)))
    columns = [inference.Inferred("name", Kind.STRING, 1, 0, 0), inference.Inferred("age", Kind.NUMBER, 1, 0, 0)]
    rows = ingest.stream_filter(ingest.stream_csv(spark, str(tmp_path / "in"), columns, files_per_batch=1), Predicate("age", Op.GT, 24))
    seen = []
    ingest.load_progressively(rows, str(tmp_path / "out"), str(tmp_path / "cp"), seen.append).awaitTermination()
    assert [p.total_rows for p in seen] == [5, 10, 15] and spark.read.parquet(str(tmp_path / "out")).count() == 15
    assert column("a`b") is not None


def ended(calls, seconds=20):
    import time

    until = time.monotonic() + seconds
    while not calls and time.monotonic() < until:
        time.sleep(0.05)
    return calls


def test_load_tells_its_start_end_and_errors(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.csv").write_text("n,s\n1.5,x\n2.5,y\n")
    columns = [inference.Inferred("n", Kind.NUMBER, 1.0, 2, 0), inference.Inferred("s", Kind.STRING, 1.0, 2, 0)]
    rows = ingest.stream_csv(spark, str(tmp_path / "in"), columns)
    started, seen, whole, errors = [], [], [], []
    ingest.load_progressively(rows, str(tmp_path / "out"), str(tmp_path / "cp"), seen.append, True, started.append, whole.append, errors.append).awaitTermination()
    (summary,) = ended(whole)
    assert started == [["n", "s"]] and errors == []
    assert (summary.rows, summary.batches, summary.types) == (2, 1, {"n": Kind.NUMBER, "s": Kind.STRING})
    assert summary.bytes == seen[0].bytes > 0 and summary.seconds > 0

    def fail(progress):
        raise ValueError("no room")

    query = ingest.load_progressively(rows, str(tmp_path / "out2"), str(tmp_path / "cp2"), fail, on_complete=whole.append, on_error=errors.append)
    with pytest.raises(Exception, match="no room"):
        query.awaitTermination()
    assert "no room" in ended(errors)[0] and len(whole) == 1


def test_ping(spark):
    from tidemark.dataset import ping

    assert ping(spark) == "pong"


@pytest.mark.parametrize("name", ["m.csv.gz", "m.csv.gzip"])
def test_gzip_files_of_several_members(spark, tmp_path, name):
    members = [gzip.compress(x.encode()) for x in ('a,b\n1,"x\n', 'y"\n2,z\n', "", "3,w\n" * 5000)]
    (tmp_path / name).write_bytes(b"".join(members))
    assert read(spark, str(tmp_path / name)) == [("1", "x\ny"), ("2", "z"), *[("3", "w")] * 5000]
    (tmp_path / f"cut-{name}").write_bytes(b"".join(members)[:-20])
    with pytest.raises(Exception):  # noqa: B017  the codec's error or EOFError, by way of the JVM
        read(spark, str(tmp_path / f"cut-{name}"))


def test_inflate():
    import os

    data = os.urandom(3 << 20) + b"tail" * 1000
    packed = gzip.compress(data[:1000]) + gzip.compress(data[1000:]) + b"\0" * 7
    assert b"".join(d.inflate(packed)) == data and b"".join(d.inflate(packed, step=100)) == data
    assert data.startswith(b"".join(d.inflate(packed[:5000], 4000)))
    with pytest.raises(EOFError):
        list(d.inflate(packed[:2000]))


def test_default_reader_uses_all_splits_of_a_file(spark, tmp_path):
    (tmp_path / "big.csv").write_text("id,text\n" + "".join(f'{k},"line\n{k} ""q"""\n' for k in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        raw = d.read_text(spark, str(tmp_path / "big.csv"))
        assert raw.plain.select(F.spark_partition_id()).distinct().count() > 10
        assert [tuple(r) for r in raw.df.orderBy("__rowId").collect()] == [(k, str(k), f'line\n{k} "q"') for k in range(3000)]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


@pytest.mark.parametrize("text", ['a,b\n1,2\n', '"a","b ""q"""\r\n"x\ny",""\n', 'a""b,c\n', 'a,"b"c\n', 'mid"q,"x,2\n', "a,b\rc,d\r\n", "\n,\n", "a,b,c\nd\n", '"",\n', '""a,b\n'])
def test_arrow_parser_agrees(text):
    rows = [(r + ["", ""])[:2] for r in d.records([text], ",")]
    got = d.parse_chunk(text.encode(), 2, ",")
    assert [list(r) for r in zip(*(c.to_pylist() for c in got), strict=True)] == rows


def test_header_longer_than_the_first_look(spark, tmp_path):
    names = [f"column_{k}_{'x' * 40}" for k in range(3000)]
    (tmp_path / "wide.csv").write_text(",".join(names) + "\n" + ",".join(map(str, range(3000))) + "\n")
    assert d.read_text(spark, str(tmp_path / "wide.csv")).columns == names


PLAIN = {
    "whole": ["12", "7", "-3", "+4", "99", "30", "41", "66", "72", "81", "500", "1996", "64", "0", "1", ""],
    "decimal": ["1.5", ".5", "2.", "-0.25", "1e3", "7.25", "1.125", "0.1", "-9.75", "", "0"],
    "date": ["1996-03-13", "2024-02-29", "", "0999-12-31"],
    "time": ["1996-03-13T10:00:00Z", "2024-02-29 23:59:59.5Z", ""],
    "local": ["1996-03-13T10:00:00", "2024-02-29 23:59:59.123456", "2024-01-01", ""],
}
ODD = [" 8 ", "0x1F", "1e400", "NaN", "inf", "1700000000", "1700000000123", "-1700000000", "2023-02-30", "1996-03-13T25:00:00", "1996", "1996-03", "Mar 5 2021", "3/4/2020", "true", "n/a", "1_0", "٣", "1 2", "５", "1d", "2024-01-01T10:00:00+02:00", "2024-01-01T10:00:00.123456789Z", " 5"]


@pytest.mark.parametrize("lenient", [False, True])
@pytest.mark.parametrize("odd", [0.0, 0.02, 0.5])
def test_plain_columns_are_read_as_the_rules_read_them(spark, tmp_path, odd, lenient):
    import random

    rng = random.Random(int(odd * 100))
    cell = lambda name: rng.choice(ODD if rng.random() < odd else PLAIN[name])
    lines = [",".join(f'"{cell(n)}\n"' if rng.random() < odd / 9 else cell(n) for n in PLAIN) for _ in range(600)]
    (tmp_path / "p.csv").write_text(",".join(PLAIN) + "\n" + "\n".join(lines) + "\n", encoding="utf-8")
    old = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "5000")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    try:
        raw = d.read_text(spark, str(tmp_path / "p.csv"))
        found = inference.infer(raw.plain, raw.columns)
        loaded = d.read_typed(spark, str(tmp_path / "p.csv"), lenient)
        assert loaded.inferred == found and loaded.rows == 600
        want = inference.typed(raw.df, found, lenient)
        assert loaded.df.schema == want.schema
        assert sorted(map(tuple, loaded.df.collect()), key=lambda r: r[0]) == sorted(map(tuple, want.collect()), key=lambda r: r[0])
        if not odd:
            assert [str(f.kind) for f in found] == ["number", "number", "datetime", "datetime", "datetime"]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old[0])
        spark.conf.set("spark.sql.files.openCostInBytes", old[1])


@pytest.mark.parametrize("blank", [False, True])
def test_plain_cells_of_a_slice(blank):
    for n in (1, 2, 9, 70, 500, 4500):
        want = [None if blank and k % 3 == 1 else k * 1.25 for k in range(n)]
        texts = ["" if v is None else str(v) for v in want]
        assert plaincells.numbers(pa.array(["c_acctbal", *texts])[1:]).to_pylist() == want
        want = [None if v is None else datetime(2000 + k % 25, 1 + k % 12, 1 + k % 28, tzinfo=timezone.utc) for k, v in enumerate(want)]
        texts = ["" if v is None else v.strftime("%Y-%m-%d") for v in want]
        assert plaincells.moments(pa.array(["l_shipdate", *texts])[1:]).to_pylist() == want


def test_load_of_few_rows_and_odd_names(spark, tmp_path):
    (tmp_path / "none.csv").write_text("a,b\n")
    none = d.read_typed(spark, str(tmp_path / "none.csv"))
    assert none.rows == 0 and none.df.columns == ["__rowId", "a", "b"] and none.df.count() == 0
    (tmp_path / "odd.csv").write_text("a.b,c`d,c0,v1\n1.5,2024-01-02,x,\n2.5,2024-01-03,,\n")
    odd = d.read_typed(spark, str(tmp_path / "odd.csv"))
    assert [str(f.kind) for f in odd.inferred] == ["number", "datetime", "string", "string"]
    rows = [tuple(r) for r in odd.df.orderBy("__rowId").collect()]
    assert [(r[0], r[1], r[3], r[4]) for r in rows] == [(0, 1.5, "x", ""), (1, 2.5, "", "")]
    assert odd.df.columns == ["__rowId", "a.b", "c`d", "c0", "v1"] and [r[2].day for r in rows] == [2, 3]
