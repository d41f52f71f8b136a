"""Column expressions for text: trimming, normal forms, and how values are written and ordered."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import JS_SPACE
from tidemark.plans.nodes import Kind

#: Text of only these is in normal form C already.
ALWAYS_NFC = r"^[\u0000-˿]*$"


def nfc(c: Column) -> Column:
    """Unicode normal form C, which Spark has no function for; in Arrow batches."""

    @F.pandas_udf("string")
    def composed(texts: pd.Series) -> pd.Series:
        return texts.str.normalize("NFC")

    return composed(c)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once, however often the body names it: a lambda variable is a binding."""
    return F.transform(F.array(value), body).getItem(0)


def trimmed(c: Column) -> Column:
    """Without white space at both ends. Most text begins and ends with a visible ASCII character and is left as it is."""
    visible = F.ascii(c).between(33, 126) & F.ascii(F.substring(c, -1, 1)).between(33, 126)
    return F.when(visible, c).otherwise(F.btrim(c, F.lit(JS_SPACE)))


def norm(c: Column, case_sensitive: bool = False, composed: bool = True) -> Column:
    """Trimmed, in normal form C, in lower case unless case counts; null is empty text.

    ``composed`` says that the column is known to hold nothing that form C would change, which spares the one
    Python function here and keeps the expression in generated code.
    """
    out = trimmed(F.coalesce(c, F.lit("")))
    out = out if composed else nfc(out)
    return out if case_sensitive else F.lower(out)


def kind_of(t: T.DataType) -> Kind:
    """The logical type of a Spark type; what has none is text (nested values as JSON)."""
    if isinstance(t, T.BooleanType):
        return Kind.BOOLEAN
    if isinstance(t, T.NumericType):
        return Kind.NUMBER
    if isinstance(t, (T.TimestampType, T.TimestampNTZType, T.DateType)):
        return Kind.DATETIME
    return Kind.STRING


def iso(c: Column) -> Column:
    """UTC to the millisecond, which is left out where it is zero."""
    whole = F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSS")
    return F.concat(F.regexp_replace(whole, r"\.000$", ""), F.lit("Z"))


def number_text(c: Column, t: T.DataType) -> Column:
    """The shortest decimal text of a number, without exponent from 1e-6 up to 1e21."""
    if isinstance(t, T.IntegralType):
        return c.cast("string")
    if isinstance(t, T.DecimalType):
        return F.when(c == 0, "0").otherwise(F.regexp_replace(F.regexp_replace(c.cast("string"), r"(\.\d*?)0+$", "$1"), r"\.$", ""))
    text = c.cast("string")
    parts = r"^-?(\d)\.(\d+)E(-?\d+)$"
    sign = F.when(text.startswith("-"), "-").otherwise("")
    first, e = F.regexp_extract(text, parts, 1), F.regexp_extract(text, parts, 3).try_cast("int")
    rest = F.regexp_replace(F.regexp_extract(text, parts, 2), "^0$", "")
    n = F.char_length(rest)
    up = F.concat(first, F.when(n <= e, F.rpad(rest, e, "0")).otherwise(F.concat(F.substr(rest, F.lit(1), e), F.lit("."), F.substr(rest, e + 1, n))))
    down = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), first, rest)
    scientific = F.concat(first, F.when(n > 0, F.concat(F.lit("."), rest)).otherwise(""), F.when(e > 0, "e+").otherwise("e-"), F.abs(e).cast("string"))
    spread = F.when(e >= 21, scientific).when(e >= 0, up).when(e > -7, down).otherwise(scientific)
    return F.when(c == 0, "0").when(text.contains("E"), F.concat(sign, spread)).otherwise(F.regexp_replace(text, r"\.0$", ""))


def display(c: Column, t: T.DataType) -> Column:
    """Any value as the text that search, distributions and exports show; null stays null."""
    kind = kind_of(t)
    if kind == Kind.NUMBER:
        return number_text(c, t)
    if kind == Kind.DATETIME:
        return iso(c)
    if isinstance(t, (T.ArrayType, T.MapType, T.StructType)):
        return F.to_json(c)
    return c.cast("string")


def natural_key(c: Column) -> Column:
    """Orders text by base letters, whatever case and accents, and runs of digits by their value.

    A run of digits becomes 0, its length without leading zeros, and its digits, so any length compares as a number.
    """
    runs = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(r"(\d+|\D+)"), F.lit(1))

    def spread(x: Column) -> Column:
        digits = F.regexp_replace(x, "^0+(?=.)", "")
        return F.when(x.rlike(r"^\d"), F.concat(F.lit("0"), F.lpad(F.char_length(digits).cast("string"), 4, "0"), digits)).otherwise(x)

    return F.collate(F.array_join(F.transform(runs, spread), ""), "UNICODE_CI_AI")
