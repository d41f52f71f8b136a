"""Type inference of text columns: one aggregation over all rows, then one projection."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.scalars import FALSE_WORDS, TRUE_WORDS
from tidemark.functions.text import let, trimmed
from tidemark.operators.predicates import column
from tidemark.plans.nodes import Kind

#: Share of the values that are not null which a type needs; equal shares go by this order.
NEEDED = ((Kind.BOOLEAN, 0.90), (Kind.DATETIME, 0.60), (Kind.NUMBER, 0.85))

_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"
_RADIX = r"^0([xX][0-9a-fA-F]{1,15}|[oO][0-7]{1,20}|[bB][01]{1,60})$"
_EPOCH = r"^-?(\d{10}|\d{13})$"
_ISO = r"^\d{4}(-\d{2}(-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,9})?)?\s?(Z|[+-]\d{2}:?\d{2})?)?)?)?$"

_PLAIN_ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}:\d{2}(\.\d{1,9})?(Z|[+-]\d{2}:\d{2})?)?$"
_PLAUSIBLE = r"^[A-Za-z]{3,9} \d|^\d{1,4}[/ -][A-Za-z0-9]"

# The written forms of dates, as (what the text looks like, Spark's pattern), that are understood.
_FORMS = (
    (r"^[A-Za-z]{3} \d{1,2} \d{4} \d{2}:\d{2}:\d{2}$", "MMM d yyyy HH:mm:ss"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4} \d{2}:\d{2}$", "MMM d yyyy HH:mm"),
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2} \d{4}$", "MMMM d yyyy"),
    (r"^[A-Za-z]{4,9} \d{1,2}, \d{4}$", "MMMM d, yyyy"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}:\d{2}$", "M/d/yyyy HH:mm:ss"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{2}:\d{2}$", "M/d/yyyy HH:mm"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"),
    (r"^\d{4}/\d{1,2}/\d{1,2}$", "yyyy/M/d"),
    (r"^\d{4}/\d{1,2}/\d{1,2} \d{2}:\d{2}:\d{2}$", "yyyy/M/d HH:mm:ss"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4}$", "d-MMM-yyyy"),
    (r"^\d{1,2}-[A-Za-z]{3}-\d{4} \d{2}:\d{2}:\d{2}$", "d-MMM-yyyy HH:mm:ss"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),
    (r"^\d{1,2} [A-Za-z]{3} \d{4} \d{2}:\d{2}:\d{2}$", "d MMM yyyy HH:mm:ss"),
)


# What follows takes trimmed text. Branches are in the order in which a text is tried, and nothing is made of a text
# beyond the first that fits, so most cells cost one or two patterns.


def _is_boolean(t: Column) -> Column:
    return (F.octet_length(t) <= 5) & F.lower(t).isin(*TRUE_WORDS, *FALSE_WORDS)


def _is_epoch(t: Column) -> Column:
    return F.octet_length(t).isin(10, 11, 13, 14) & t.rlike(_EPOCH)


def _looks_numeric(t: Column) -> Column:
    """The first character is a digit, sign or point: a test of one byte that most text fails."""
    return F.ascii(t).between(43, 57)


def _too_large(t: Column) -> Column:
    """Text of a number that is not finite; asked only of long texts and of those with an exponent."""
    return ((F.octet_length(t) > 300) | t.rlike("[eE]")) & F.coalesce(F.abs(t.try_cast("double")) == float("inf"), F.lit(False))


def _boolean(t: Column) -> Column:
    return F.when(_is_boolean(t), F.lower(t).isin(*TRUE_WORDS))


def _number(t: Column) -> Column:
    """A finite number in decimal or with a radix prefix, else null."""
    base = F.when(F.substring(t, 2, 1).isin("x", "X"), 16).when(F.substring(t, 2, 1).isin("o", "O"), 8).otherwise(2)
    radix = F.call_function("conv", F.substring(t, 3, 64), base, F.lit(10))
    # only an exponent or very many digits go beyond what a number holds, and then it is one of the infinities
    number = F.when(t.rlike(_DECIMAL), t).when(t.rlike(_RADIX), radix).try_cast("double")
    return F.when(_looks_numeric(t) & ~_too_large(t), number)


def _epoch(t: Column) -> Column:
    """Ten digits as seconds, thirteen as milliseconds."""
    return F.timestamp_millis(F.when(_is_epoch(t), t.try_cast("long") * F.when(F.octet_length(t) <= 11, 1000).otherwise(1)))


def _date(t: Column) -> Column:
    """ISO text, or a written form that the text looks like; without a zone it is UTC."""
    fixed = F.regexp_replace(t, r"\s(?=Z|[+-]\d{2}:?\d{2}$)", "")
    fixed = F.regexp_replace(F.regexp_replace(fixed, r"([+-]\d{2})(\d{2})$", "$1:$2"), r"([T ]\d{2}:\d{2})(?=$|Z|[+-])", "$1:00")
    n = F.octet_length(t)
    iso = F.when(t.rlike(_PLAIN_ISO), t).when(n == 4, F.concat(t, F.lit("-01-01"))).when(n == 7, F.concat(t, F.lit("-01"))).otherwise(fixed)
    # written forms hold a name or a slash; month names are spelt as Spark spells them
    form = F.lit(None).cast("string")
    for looks, written in reversed(_FORMS):
        form = F.when(t.rlike(looks), written).otherwise(form)
    tidy = F.concat(F.regexp_extract(t, "^[^A-Za-z]*", 0), F.upper(F.regexp_extract(t, "^[^A-Za-z]*([A-Za-z]?)", 1)), F.lower(F.regexp_replace(t, "^[^A-Za-z]*[A-Za-z]?", "")))
    digit_first = F.ascii(t).between(48, 57)
    plausible = n.between(8, 32) & t.rlike(_PLAUSIBLE)
    return F.when(digit_first & t.rlike(_ISO), iso.try_cast("timestamp")).when(plausible, F.try_to_timestamp(tidy, form))


def kinds(df: DataFrame, columns: list[str]) -> DataFrame:
    """(place, kind, moment) of every cell of the columns, which are text: one narrow row for each, so that one small
    expression, compiled once, looks at all columns."""
    cells = df.select(F.posexplode(F.array(*(F.coalesce(column(c), F.lit("")) for c in columns))).alias("place", "text"))
    return _kinds_of(cells).select("place", "kind", F.col("date").alias("moment"))


def _kinds_of(cells: DataFrame) -> DataFrame:
    """``kind`` and ``date`` of the column ``text``, beside all other columns."""
    cells = cells.withColumn("t", trimmed(F.col("text")))
    t = F.col("t")
    cells = cells.withColumn("decimal", _looks_numeric(t) & t.rlike(_DECIMAL)).withColumn("word", _is_boolean(t))
    decimal, word = F.col("decimal"), F.col("word")
    cells = cells.withColumn("date", F.when(decimal, F.when(~word, _epoch(t))).when(~word, _date(t)))
    number = F.when(decimal & ~_too_large(t), True).otherwise(_number(t).isNotNull())
    kind = (
        F.when(t == "", F.lit(None).cast("string"))
        .when(word, str(Kind.BOOLEAN))
        .when(F.col("date").isNotNull(), str(Kind.DATETIME))
        .when(number, str(Kind.NUMBER))
        .otherwise(str(Kind.STRING))
    )
    return cells.withColumn("kind", kind)


@dataclass(frozen=True)
class Inferred:
    name: str
    kind: Kind
    confidence: float
    rows: int
    nulls: int
    min_ms: int | None = None
    max_ms: int | None = None


def decide(counts: dict[Kind, int]) -> tuple[Kind, float]:
    """The type with the largest share among those that reach theirs, and that share; text gets what is left."""
    total = sum(counts.values())
    if not total:
        return Kind.STRING, 1.0
    shares = sorted(((counts.get(k, 0) / total, k, need) for k, need in NEEDED), key=lambda x: -x[0])
    for share, k, need in shares:
        if share >= need:
            return k, share
    return Kind.STRING, 1.0 - shares[0][0]


def infer(df: DataFrame, columns: list[str] | None = None) -> list[Inferred]:
    """Types of text columns from all their rows, in one pass."""
    columns = list(df.columns if columns is None else columns)
    return _decided(kinds(df, columns).select("place", "kind", F.lit(1).alias("n"), F.col("moment").alias("lo"), F.col("moment").alias("hi")), columns)


def infer_counted(counted: DataFrame, columns: list[str]) -> list[Inferred]:
    """The same from counts of plain columns and of different texts (:func:`plaincells.summary`)."""
    cells = _kinds_of(counted.withColumnRenamed("kind", "known"))
    kind = F.when(F.col("text").isNull(), F.col("known")).otherwise(F.col("kind"))
    return _decided(cells.select("place", kind.alias("kind"), "n", F.coalesce("lo", "date").alias("lo"), F.coalesce("hi", "date").alias("hi")), columns)


def _decided(cells: DataFrame, columns: list[str]) -> list[Inferred]:
    found = cells.groupBy("place", "kind").agg(F.sum("n").alias("n"), F.unix_millis(F.min("lo")).alias("lo"), F.unix_millis(F.max("hi")).alias("hi")).collect()
    rows = sum(r.n for r in found if r.place == 0)
    out = []
    for i, c in enumerate(columns):
        own = {r.kind: r for r in found if r.place == i}
        counts = {k: own[str(k)].n for k in Kind if str(k) in own}
        decided, confidence = decide(counts)
        dates = own[str(Kind.DATETIME)] if decided == Kind.DATETIME else None
        out.append(Inferred(c, decided, confidence, rows, rows - sum(counts.values()), dates and dates.lo, dates and dates.hi))
    return out


def coerce(raw: Column, to: Kind, lenient: bool = False) -> Column:
    """A text as a value of the column's type; what is of another kind is null.

    By default ``0`` and ``1`` are truth values and 10 or 13 digits are epochs, in number columns too, where
    they become null; ``lenient`` reads them as the numbers they are. A number in a datetime column is milliseconds.
    """
    return F.coalesce(raw, F.lit("")) if to == Kind.STRING else _coerced(trimmed(raw), to, lenient)


def _coerced(t: Column, to: Kind, lenient: bool) -> Column:
    if to == Kind.BOOLEAN:
        return _boolean(t)
    if to == Kind.NUMBER:
        return _number(t) if lenient else F.when(~t.isin("0", "1") & ~_is_epoch(t), _number(t))  # the numbers among the words
    number = F.when(~t.isin("0", "1"), F.timestamp_millis(F.floor(_number(t)).try_cast("long")))
    return F.when(_is_epoch(t), _epoch(t)).when(_looks_numeric(t) & (t.rlike(_DECIMAL) | t.rlike(_RADIX)), number).otherwise(_date(t))


def typed(df: DataFrame, inferred: list[Inferred], lenient: bool = False, read: dict[str, str] | None = None) -> DataFrame:
    """All columns as their types; columns that were not inferred pass through.

    ``read`` names, for some columns, another with values that were read already, where the text is null.
    """
    read = read or {}
    kinds = {i.name: i.kind for i in inferred}
    # trimmed in a step of its own: what follows names it many times
    bare = {c: f"__tm_t{k}" for k, c in enumerate(df.columns) if kinds.get(c, Kind.STRING) != Kind.STRING}
    df = df.withColumns({name: trimmed(column(c)) for c, name in bare.items()})
    kept = [c for c in df.columns if c not in bare.values() and c not in read.values()]
    value = lambda c: F.coalesce(*([column(read[c])] if c in read else []), _coerced(F.col(bare[c]), kinds[c], lenient))
    made = [value(c).alias(c) if c in bare else F.coalesce(column(c), F.lit("")).alias(c) if c in kinds else column(c) for c in kept]
    # A higher-order function keeps this projection out of whole-stage code, where all columns together make one method
    # that is too large for the JIT; by itself it is split into a method for each (three times as fast on 16 columns).
    return df.select(let(made[0], lambda v: v).alias(kept[0]), *made[1:])
