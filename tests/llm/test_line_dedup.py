import hashlib
import random

from tests.llm.helpers import EDGE_TEXTS, ascii_lower, documents
from tidemark.llm import line_dedup as d

WS = " \t\n\x0b\x0c\r"


def model(rows, min_chars=20, min_docs=3):
    holders = {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            key = ascii_lower(line.strip(WS))
            if len(key) >= min_chars and i is not None:
                holders.setdefault(key, set()).add(i)
    out = []
    for i, text in rows:
        lines = (text or "").split("\n")
        kept = []
        for line in lines:
            docs = holders.get(ascii_lower(line.strip(WS)), set())
            if i is None or len(docs) < min_docs or i == max(docs):
                kept.append(line)
        out.append((i, len(lines), len(lines) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest()))
    return sorted(out, key=str)


def test_against_the_model(spark):
    rng = random.Random(0)
    pool = [f"a shared line of some length {k} É" for k in range(6)] + ["short", "", "  A SHARED LINE of some length 2 É\t", "x" * 19, "y" * 20]
    texts = ["\n".join(rng.choice(pool) for _ in range(rng.randrange(1, 9))) for _ in range(40)]
    texts += [*EDGE_TEXTS, "\n".join(["z" * 30] * 200), "z" * 30 + "\n" + "q" * 25, "Z" * 30]
    rows = list(enumerate(texts, 1))
    got = sorted((tuple(r) for r in d.line_report(documents(spark, texts)).collect()), key=str)
    assert got == model(rows)


def test_ids_null_repeated_and_shared(spark):
    line = "the very same long line here"
    rows = [(None, line), (None, line), (5, line), (5, line), (5, "other\n" + line), (7, line + "\nrest"), (9, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((tuple(r) for r in d.line_report(df).collect()), key=str)
    assert got == model(rows)


def test_long_document_bitmap(spark):
    line = "common line number one two"
    long = "\n".join(line if k % 3 else f"own {k}" for k in range(5000))
    rows = [(1, long), (2, line), (3, line)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted((tuple(r) for r in d.line_report(df).collect()), key=str) == model(rows)
    (r,) = d.drop_bitmaps(df).where("__tm_doc = 1").collect()
    dropped = [w["__tm_word"] * 64 + b for w in r["__tm_words"] for b in range(64) if w["__tm_bits"] >> b & 1]
    assert dropped == [k for k in range(5000) if k % 3]


def test_empty_table_and_other_columns(spark):
    assert d.line_report(documents(spark, [])).count() == 0
    out = d.dedup_lines(documents(spark, ["one\ntwo"]))
    assert out.drop("__tm_words").first().asDict()["text"] == "one\ntwo"
