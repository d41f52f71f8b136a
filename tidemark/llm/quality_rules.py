"""Quality rules as a short-circuit cascade, with native operators only.

Each rule is a Boolean column that rejects. On a sample every rule is run alone; the time it takes beyond a rule that
looks at nothing is its cost, and the share it rejects its selectivity. Rules then stand in the order of rejection per
cost inside one ``CASE``, which stops at the first that fires. The order changes what is spent, never what is kept.

Defined results: a null or empty text has no words and fails the base; very long texts are read whole; repeated rows,
rows with equal or null ids among them, are judged alike, each by itself; rules that tie in rejection per cost stand by
name; an empty table gives no rows; only doc_id and text are looked at, so other columns may have any name.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.exprs import WS, count_chars, let, strip_ws, words
from tidemark.llm.storage import drop, persist

#: Rows of the sample that selectivities are estimated on, and the files it is drawn from.
SAMPLE_ROWS, SAMPLE_FILES = 1000, 32
#: Of which half is timed, each row as often as this.
SAMPLE_COPIES = 8
#: Characters that count as symbols.
SYMBOLS = "#*$%&|<>"


def _combine(a: Column, b: Column, gap: int, n: Column) -> Column:
    """Hashes of runs twice as long: element i with element i + gap."""
    return F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(gap + 1), n), lambda x, y: F.xxhash64(x, y))


def _repeated(w: Column) -> Column:
    """Words inside 8-word windows that the text holds twice or more.

    Window hashes come from three doublings of the word hashes. Most texts repeat no window, which one hash set tells;
    only the others are sorted to find the windows and the stretch that they cover together.
    """
    n = F.size(w)
    eights = let(F.transform(w, lambda x: F.xxhash64(x)), lambda one: let(_combine(one, one, 1, n - 1), lambda two: let(_combine(two, two, 2, n - 3), lambda four: _combine(four, four, 4, n - 7))))

    def covered(h: Column) -> Column:
        ordered = F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

        def starts(p: Column) -> Column:
            m = F.size(p) - 1
            both = F.zip_with(F.slice(p, F.lit(1), m), F.slice(p, F.lit(2), m), lambda x, y: F.when(x["h"] == y["h"], F.array(x["i"], y["i"])))
            return F.sort_array(F.array_distinct(F.flatten(F.filter(both, lambda x: x.isNotNull()))))

        zero = F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n"))
        step = lambda acc, i: F.struct((i + 8).alias("end"), (acc["n"] + (i + 8 - F.greatest(i, acc["end"]))).cast("long").alias("n"))
        return let(ordered, lambda p: F.aggregate(starts(p), zero, step, lambda acc: acc["n"]))

    found = let(eights, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(n < 9, F.lit(0).cast("long")).otherwise(found)


def features(text: Column) -> Column:
    """A struct of the base figures of a text."""
    t = F.coalesce(text, F.lit(""))
    bare = t
    for ch in WS:
        bare = F.replace(bare, F.lit(ch), F.lit(""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: strip_ws(x) != "")
    line_counts = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    by_words = let(words(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeated(w).alias("n_repeat_words")))
    return F.struct(by_words.alias("w"), line_counts.alias("l"), F.char_length(bare).cast("long").alias("word_chars"), count_chars(t, SYMBOLS).alias("n_symbols"))


def with_features(docs: DataFrame) -> DataFrame:
    """doc_id, text and the base figures. A null text counts as an empty one."""
    rows = docs.select("doc_id", "text").withColumn("__tm_f", features(F.col("text")))
    f = "__tm_f."
    return rows.select(
        "doc_id", "text", F.col(f + "w.n_words").alias("n_words"), F.col(f + "word_chars").alias("word_chars"), F.col(f + "n_symbols").alias("n_symbols"),
        F.col(f + "l.n_dup_lines").alias("n_dup_lines"), F.col(f + "w.n_repeat_words").alias("n_repeat_words"), F.col(f + "l.n_lines").alias("n_full_lines"),
    )


@dataclass(frozen=True)
class Rule:
    """``reject`` may name doc_id, text and the columns of :func:`with_features`."""

    name: str
    reject: Column


def base_failed() -> Column:
    return (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))


def default_rules() -> list[Rule]:
    n, t = F.col("n_words"), F.coalesce(F.col("text"), F.lit(""))
    letters = F.char_length(t) - F.char_length(F.regexp_replace(t, r"\p{L}+", ""))
    capitals = F.char_length(F.regexp_replace(t, r"\P{Lu}+", ""))
    return [
        Rule("symbols", 10 * F.col("n_symbols") > n),
        Rule("word_length", (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n)),
        Rule("dup_lines", 2 * F.col("n_dup_lines") > F.col("n_full_lines")),
        Rule("exclaiming", 20 * count_chars(t, "!") > 3 * n),
        Rule("digits", 2 * count_chars(t, "0123456789") > F.col("word_chars")),
        Rule("shouting", 2 * capitals > letters),
        Rule("letters", 2 * letters < F.col("word_chars")),
        Rule("ellipsis", 20 * F.size(F.regexp_extract_all(t, F.lit(r"(?:\.\.\.|…)\s*(?:\n|$)"), F.lit(0))) > 7 * F.col("n_full_lines")),
    ]


def _some_files(docs: DataFrame) -> DataFrame:
    """``docs`` cut down to at most SAMPLE_FILES of its files, evenly taken, if it is a plain scan of more; else all of it."""
    files = docs._jdf.inputFiles()
    if len(files) <= SAMPLE_FILES:
        return docs
    chosen = [files[k * len(files) // SAMPLE_FILES] for k in range(SAMPLE_FILES)]
    chosen += [f.replace(":///", ":/") for f in chosen]  # names without a host are spelt both ways
    try:
        return docs.where(F.col("_metadata.file_path").isin(chosen))
    except AnalysisException:  # no plain scan: its rows have no file
        return docs


def _seconds(df: DataFrame, condition: Column) -> float:
    """Of the second of two equal runs: the first compiles."""
    for _ in range(2):
        began = time.perf_counter()
        df.agg(F.count_if(condition)).first()
    return time.perf_counter() - began


def plan_cascade(docs: DataFrame, rules: list[Rule], sample_rows: int = SAMPLE_ROWS, copies: int = SAMPLE_COPIES) -> list[tuple[Rule, float, float]]:
    """(rule, seconds on the sample, share rejected), by rejection per second, best first; ties by name.

    The sample is drawn by a hash of the id from SAMPLE_FILES files, at the fraction that gives ``sample_rows`` rows or
    so, and written once with its figures. For the timings each row of half of it is taken ``copies`` times, so that a
    rule costs more than a job does; what is less than a tenth of an empty job counts as a tenth of one.
    """
    some = _some_files(docs)
    total = some.count()
    if not total:
        return [(r, 0.0, 0.0) for r in rules]
    part = int(min(1.0, sample_rows / total) * 1_000_000)
    sample = persist(with_features(some.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part)), "rules-sample")
    n, *hits = sample.agg(F.count(F.lit(1)), *(F.count_if(r.reject) for r in rules)).first()
    many = sample.where(F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(2)) == 0).withColumn("__tm_copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
    nothing = _seconds(many, F.col("__tm_copy") < 0)
    found = [(r, max(_seconds(many, r.reject) - nothing, nothing / 10), hit / max(n, 1)) for r, hit in zip(rules, hits, strict=True)]
    drop(sample)
    return sorted(found, key=lambda x: (-x[2] / x[1], x[0].name))


def apply_rules(docs: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """doc_id, the base figures, base_failed, kept, and the rule that rejected (null: none)."""
    rules = default_rules() if rules is None else rules
    rows = with_features(docs)
    cascade = F.when(base_failed(), F.lit("base"))
    for rule, _, _ in plan_cascade(docs.select("doc_id", "text"), rules):
        cascade = cascade.when(rule.reject, F.lit(rule.name))
    out = rows.withColumn("base_failed", base_failed()).withColumn("failed_rule", cascade)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", F.col("failed_rule").isNull().alias("kept"), "failed_rule")
