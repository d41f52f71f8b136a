"""Line dedup with native operators only.

Lines become (128-bit hash of the key, document, position). They are range-partitioned by hash and a salt of the
document, sorted inside each partition by hash, salt, document (largest first) and position, and streamed: a row whose
predecessor has another document is a first occurrence. First occurrences alone are counted, with map-side
pre-aggregation, so a key that fills a third of the corpus reaches a reducer as one row for each task. What goes back
to the documents is a compressed bitmap, 64 lines to a word with untouched words left out, never text.

Defined results: a null or empty text is one empty line; a null doc_id neither loses lines nor counts as a document;
rows with equal doc_id count as one document, and lines that a document repeats tie: all of them go or all stay; very
long texts are split whole, a row for each line; an empty table gives no rows; columns beside doc_id and text, whatever
their names, are passed through or ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.exprs import ascii_lower, let, strip_ws
from tidemark.llm.storage import persist

SALTS = 64
_DOC = ["__tm_doc", "__tm_row"]
_KEY = ["__tm_h1", "__tm_h2"]


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _row(text: Column) -> Column:
    """Tells rows with equal ids and other texts apart."""
    return F.xxhash64(text)


def line_hashes(docs: DataFrame, min_chars: int) -> DataFrame:
    """One row for each line whose key has ``min_chars`` code points: document, position, and the key's two hashes."""
    rows = docs.where(F.col("doc_id").isNotNull()).select(
        F.col("doc_id").alias("__tm_doc"), _row(F.col("text")).alias("__tm_row"), F.posexplode(_lines(F.col("text"))).alias("__tm_pos", "__tm_line")
    )
    rows = rows.withColumn("__tm_line", strip_ws(F.col("__tm_line"))).where(F.char_length("__tm_line") >= min_chars)
    rows = rows.withColumn("__tm_line", ascii_lower(F.col("__tm_line")))
    return rows.select(*_DOC, "__tm_pos", F.xxhash64("__tm_line").alias("__tm_h1"), F.xxhash64(F.lit(1), F.col("__tm_line")).alias("__tm_h2"))


def repeated_keys(lines: DataFrame, min_docs: int) -> DataFrame:
    """Keys found in at least ``min_docs`` documents, with the largest document that holds each."""
    cut = lines.select(*_KEY, F.pmod(F.xxhash64("__tm_doc"), F.lit(SALTS)).cast("int").alias("__tm_salt"), "__tm_doc", "__tm_pos")
    cut = cut.repartitionByRange(*_KEY, "__tm_salt").sortWithinPartitions(*_KEY, "__tm_salt", F.desc("__tm_doc"), "__tm_pos")
    stream = Window.partitionBy(*_KEY, "__tm_salt").orderBy(F.desc("__tm_doc"), "__tm_pos")
    before = F.lag("__tm_doc").over(stream)
    first = cut.withColumn("__tm_first", before.isNull() | (before != F.col("__tm_doc"))).where("__tm_first")
    return first.groupBy(*_KEY).agg(F.count(F.lit(1)).alias("__tm_n"), F.max("__tm_doc").alias("__tm_keep")).where(F.col("__tm_n") >= min_docs).select(*_KEY, "__tm_keep")


def drop_bitmaps(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """(__tm_doc, __tm_row, __tm_words): for each document that loses lines, its bitmap as sorted (word, bits) pairs.

    A set bit is a dropped line; words without one are left out, and documents without one have no row.
    """
    lines = persist(line_hashes(docs, min_chars), "lines")
    # written, so that the join has two plain exchanges and adaptive execution can split a key that many lines have
    repeated = persist(repeated_keys(lines, min_docs), "repeated")
    lost = lines.join(repeated, _KEY).where(F.col("__tm_doc") < F.col("__tm_keep"))
    bit = F.expr("shiftleft(1L, __tm_pos & 63)")
    words = lost.groupBy(*_DOC, F.shiftright("__tm_pos", 6).alias("__tm_word")).agg(F.bit_or(bit).alias("__tm_bits"))
    return words.groupBy(*_DOC).agg(F.sort_array(F.collect_list(F.struct("__tm_word", "__tm_bits"))).alias("__tm_words"))


def _kept_text(text: Column, words: Column) -> Column:
    """The lines whose bit is not set, joined again. The sparse words are spread out once for constant-time look-up."""
    spread = let(F.map_from_entries(words), lambda m: F.transform(F.sequence(F.lit(0), F.array_max(F.map_keys(m))), lambda w: F.coalesce(F.try_element_at(m, w), F.lit(0).cast("long"))))
    kept = let(spread, lambda dense: F.filter(_lines(text), lambda _, i: F.coalesce(F.get(dense, F.shiftright(i, 6)), F.lit(0).cast("long")).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(63))) == 0))
    return F.when(words.isNull(), F.coalesce(text, F.lit(""))).otherwise(F.array_join(kept, "\n"))


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, text_to: str = "text") -> DataFrame:
    """``docs`` with repeated lines taken out of ``text_to``, and ``__tm_words`` (the bitmap, null: nothing lost).

    Keys are lines stripped of ``[\\x20\\x09-\\x0D]`` and lower-cased in A-Z. A key of at least ``min_chars`` code points
    that is in at least ``min_docs`` documents stays only in the largest doc_id that holds it.
    """
    maps = drop_bitmaps(docs, min_chars, min_docs)
    rows = docs.withColumn("__tm_doc", F.col("doc_id")).withColumn("__tm_row", _row(F.col("text")))
    out = rows.join(maps, _DOC, "left")
    return out.withColumn(text_to, _kept_text(F.col("text"), F.col("__tm_words"))).drop(*_DOC)


def line_report(docs: DataFrame, min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """doc_id, n_lines, n_dropped and the SHA-256 of the kept text for every row."""
    out = dedup_lines(docs.select("doc_id", "text"), min_chars, min_docs, "__tm_kept")
    dropped = F.coalesce(F.aggregate("__tm_words", F.lit(0).cast("long"), lambda n, w: n + F.bit_count(w["__tm_bits"])), F.lit(0).cast("long"))
    return out.select("doc_id", F.size(_lines(F.col("text"))).cast("long").alias("n_lines"), dropped.alias("n_dropped"), F.sha2(F.col("__tm_kept"), 256).alias("kept_sha256"))
