"""Small native column helpers shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import let

__all__ = ["WS", "WS_RUN", "ascii_lower", "count_chars", "let", "strip_ws", "words"]

WS = " \t\n\x0b\x0c\r"
WS_RUN = r"[\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """A-Z only. ``lower`` is fast and does just that where all is ASCII."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, upper, upper.lower()))


def strip_ws(c: Column) -> Column:
    return F.btrim(c, F.lit(WS))


def words(text: Column) -> Column:
    """Maximal runs outside space and U+0009..U+000D; none for null."""
    bare = strip_ws(F.coalesce(text, F.lit("")))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, WS_RUN, -1))


def count_chars(text: Column, chars: str) -> Column:
    """How often the given ASCII characters occur, as a difference of byte lengths."""
    rest = text
    for ch in chars:
        rest = F.replace(rest, F.lit(ch), F.lit(""))
    return (F.octet_length(text) - F.octet_length(rest)).cast("long")
