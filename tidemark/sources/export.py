"""Sinks: delimited text, plain or gzipped, groupings, annotations, and the clipboard form."""

from __future__ import annotations

import json
import re
from collections.abc import Sequence
from datetime import datetime, timezone
from pathlib import Path
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.scalars import js_text
from tidemark.functions.text import display
from tidemark.operators.grouping import Grouped
from tidemark.operators.predicates import column


def as_text(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Every column as the text that is exported; null is empty."""
    return df.select(*(F.coalesce(display(column(c), df.schema[c].dataType), F.lit("")).alias(c) for c in (columns or df.columns)))


def csv_line(df: DataFrame) -> Column:
    """One line of a row: every cell in quotes, quotes inside doubled, null as an empty cell."""
    cells = [F.concat(F.lit('"'), F.replace(F.coalesce(display(column(c), df.schema[c].dataType), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) for c in df.columns]
    return F.concat_ws(",", *cells)


def csv_text(headers: Sequence[str], rows: Sequence[Sequence[Any]]) -> str:
    """A small table as one text, without a line end after the last line."""
    quote = lambda v: '"' + js_text(v).replace('"', '""') + '"'
    return "\n".join(",".join(map(quote, row)) for row in [headers, *rows])


def write_csv(df: DataFrame, path: str, gzip: bool = False, one_file: bool = False, mode: str = "errorifexists") -> None:
    """``df`` as CSV below ``path``, in its order: a file with a header for each partition, whose names keep the order,
    which :func:`tidemark.sources.delimited.read_text` reads back as one table. ``one_file=True`` has one task write
    one file, for results that people take away."""
    text = as_text(df)
    text = text.coalesce(1) if one_file else text
    text.write.mode(mode).csv(path, header=True, quoteAll=True, escape='"', quote='"', emptyValue="", nullValue="", compression="gzip" if gzip else "none", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def write_grouping(grouped: Grouped, path: str, gzip: bool = False, one_file: bool = False, mode: str = "errorifexists") -> None:
    """Group columns, aggregates and the rows of each group."""
    write_csv(grouped.df, path, gzip, one_file, mode)


def write_annotations(envelope: dict[str, Any], path: str | Path) -> None:
    Path(path).write_text(json.dumps(envelope, ensure_ascii=False, indent=2), encoding="utf-8")


def _stamp(now: datetime | None) -> str:
    now = (now or datetime.now(timezone.utc)).astimezone(timezone.utc)
    return now.strftime("%Y-%m-%dT%H-%M-%S-") + f"{now.microsecond // 1000:03d}Z"


def export_name(source: str, extension: str = ".csv", now: datetime | None = None) -> str:
    """``data_export_``, the name without its last extension, and the second of the export."""
    return f"data_export_{re.sub(r'[.][^/.]+$', '', source)}_{_stamp(now)[:19]}{extension}"


def annotations_name(source: str | None, now: datetime | None = None) -> str:
    stem = re.sub(r"[^a-z0-9]+", "-", re.sub(r"[.][^.]+$", "", source or "").strip().lower()).strip("-")
    return f"{stem or 'annotations'}-annotations-{_stamp(now)}.json"


def _flat(c: Column) -> Column:
    return F.regexp_replace(c, "[\t\r\n]+", " ")


def clipboard_cell(c: Column, t: T.DataType) -> Column:
    """A cell for the clipboard: no tabs or line ends; labels and note of an annotation, lists with commas."""
    if isinstance(t, T.StructType) and set(t.names) == {"labels", "note"}:
        names = F.filter(F.transform(c["labels"], lambda x: x["name"]), lambda x: x != "")
        parts = F.array(F.when(F.size(names) > 0, F.array_join(names, ", ")), F.when(F.trim(c["note"]) != "", F.concat(F.lit("note: "), c["note"])))
        return F.coalesce(_flat(F.array_join(F.array_compact(parts), " | ")), F.lit(""))
    if isinstance(t, T.ArrayType) and not isinstance(t.elementType, (T.ArrayType, T.MapType, T.StructType)):
        return F.coalesce(_flat(F.array_join(F.transform(c, lambda x: F.coalesce(display(x, t.elementType), F.lit(""))), ", ")), F.lit(""))
    return F.coalesce(_flat(display(c, t)), F.lit(""))


def clipboard_text(df: DataFrame, headers: Sequence[str] | None = None) -> str:
    """Header line and rows, tab-separated; the rows are a selection made by hand, so they fit the driver."""
    if not df.columns:
        return ""
    line = F.concat_ws("\t", *(clipboard_cell(column(c), df.schema[c].dataType) for c in df.columns))
    rows = [r[0] for r in df.select(line).collect()]
    shown = [re.sub("[\t\r\n]+", " ", h) for h in (headers or df.columns)]
    return "\n".join(["\t".join(shown), *rows]) if rows else ""

