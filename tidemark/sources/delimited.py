"""Delimited text: delimiter detection, headers, and two readers.

The reader by default follows the data model: blank lines are rows, a quote anywhere opens a quoted stretch, and a lone
CR ends a record. It reads splits of a file in parallel: since every quote turns the quoted state around, whether a split
begins inside quotes is the parity of the quotes before it, which one light pass tells together with the records of each
split, so rows get their numbers as they are parsed. Records that lie over split borders come as fragments, and only
those are put together file by file. Where a stretch of lines is plain (every quote at a border of a cell, every row of
the same width) Arrow's parser reads it, else the one below, with the same result. ``.gz`` files are one split each.
Files that are packed under other names, and other encodings than UTF-8, are read a file to a task. Where the last quote
of a file is never closed, the line end at the very end of the file is not kept.

``strict=False`` is Spark's own reader, with Spark's rules where they differ.
"""

from __future__ import annotations

import codecs
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import csv as arrow_csv
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.predicates import column
from tidemark.plans.nodes import Kind
from tidemark.sources import plaincells
from tidemark.sources.inference import Inferred, infer, infer_counted, typed
from tidemark.sources.rowid import BROADCAST_SPLITS, numbered, scan_with_row_ids

DELIMITERS = (",", "\t", ";")
_GZIP_NAME = re.compile(r"\.(csv|tsv)\.g?z(ip)?$", re.I)
#: Bytes of a file that are looked at for its header: more, if the header does not end in them.
SNIFF_BYTES = (1 << 16, 1 << 20)


def is_gzip(name: str, mime: str | None = None) -> bool:
    """By MIME type if there is one that says so, else by name."""
    return (mime or "").lower() in ("application/gzip", "application/x-gzip") or bool(_GZIP_NAME.search(name))


def records(chunks: Iterable[str], delimiter: str) -> Iterator[list[str]]:
    """Records of a text that comes in pieces. Quotes may open anywhere; ``""`` inside them is one; CR, LF and CRLF end
    a record outside; a blank line is a record of one empty field; the last record needs no line end."""
    special = re.compile(f'["\r\n{re.escape(delimiter)}]')
    row: list[str] = []
    cell: list[str] = []
    quoted = pending = after_cr = started = False
    for text in chunks:
        at, n = 0, len(text)
        while at < n:
            if after_cr:
                after_cr = False
                if text[at] == "\n":
                    at += 1
                    continue
            started = True
            if quoted:
                if pending:
                    pending = False
                    if text[at] == '"':
                        cell.append('"')
                        at += 1
                        continue
                    quoted = False
                else:
                    end = text.find('"', at)
                    if end < 0:
                        cell.append(text[at:])
                        break
                    cell.append(text[at:end])
                    pending, at = True, end + 1
                    continue
            m = special.search(text, at)
            if not m:
                cell.append(text[at:])
                break
            cell.append(text[at : m.start()])
            mark, at = m[0], m.end()
            if mark == '"':
                quoted = True
                continue
            row.append("".join(cell))
            cell.clear()
            if mark != delimiter:
                yield row
                row, started, after_cr = [], False, mark == "\r"
    if started:
        row.append("".join(cell))
        yield row


def detect_delimiter(text: str) -> str:
    """The most frequent of the delimiters outside quotes in the first line; comma, tab, semicolon if equal."""
    counts, quoted = dict.fromkeys(DELIMITERS, 0), False
    for ch in text:
        if ch == '"':
            quoted = not quoted
        elif not quoted and ch in "\r\n":
            break
        elif not quoted and ch in counts:
            counts[ch] += 1
    best = max(DELIMITERS, key=lambda d: counts[d])
    return best if counts[best] else ","


def header_names(cells: list[str]) -> list[str]:
    """Trimmed names; blank ones are numbered, repeated ones get _2, _3, ... until they differ from all others."""
    out: list[str] = []
    for k, cell in enumerate(cells, 1):
        name = base = cell.strip() or f"column_{k}"
        n = 1
        while name in out:
            n += 1
            name = f"{base}_{n}"
        out.append(name)
    return out


def inflate(data: bytes, most: int | None = None, step: int = 1 << 20) -> Iterator[bytes]:
    """Gzip data of one member or several, unpacked in pieces; with ``most`` the beginning of what may be cut off.

    EOFError where a whole is asked for and the last member has no end. Zeros after a member are padding.
    """
    view, given = memoryview(data), 0
    while len(view) and (most is None or given < most):
        if view[0] == 0 and not any(view):
            return
        box, at = zlib.decompressobj(31), 0
        while not box.eof and at < len(view) and (most is None or given < most):
            piece = box.decompress(view[at : at + step])
            at += step
            if piece:
                given += len(piece)
                yield piece
        if not box.eof:
            if most is None:
                raise EOFError("the gzip data ends inside a member")
            return
        view = view[min(at, len(view)) - len(box.unused_data) :]


def _files(spark: SparkSession, path: str) -> list[str]:
    """Names of all files, without reading any."""
    return sorted(spark.read.format("binaryFile").load(path).inputFiles())


def _first_file(spark: SparkSession, path: str) -> str:
    files = _files(spark, path)
    if not files:
        raise FileNotFoundError(path)
    return files[0]


def _head(spark: SparkSession, path: str, encoding: str) -> str:
    """The beginning of the first file, read by the cluster's own file system and unpacked if need be."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(_first_file(spark, path))
    text = ""
    for most in SNIFF_BYTES:
        stream = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).open(where)
        try:
            data = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(jvm.org.apache.commons.io.input.BoundedInputStream(stream, most)))
        finally:
            stream.close()
        whole = len(data) < most
        if data[:2] == b"\x1f\x8b":
            data = b"".join(inflate(data, most))
        text = codecs.getincrementaldecoder(encoding)("replace").decode(data).removeprefix("\ufeff")
        found = records([text], ",")
        if whole or (next(found, None) and next(found, None)):
            break
    return text


@dataclass(frozen=True)
class Raw:
    """All columns as text, null-free; ``df`` has a dense row id too, which ``plain`` saves the counting for."""

    df: DataFrame
    plain: DataFrame
    columns: list[str]
    delimiter: str
    #: Makes the rows of a step over Arrow batches of the row id and c0, c1, ..., within the tasks that parse, if it can.
    each: Callable[[plaincells.Step, str], DataFrame] | None = None


def _strict_rows(columns: int, delimiter: str, encoding: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content"), strict=True):
                data = content.as_py()
                chunks = inflate(data) if data[:2] == b"\x1f\x8b" else (data[a : a + (1 << 20)] for a in range(0, len(data), 1 << 20))
                found = records(_without_bom(codecs.iterdecode(chunks, encoding, "replace")), delimiter)
                next(found, None)
                held, at = [], 0
                for row in found:
                    held.append((row + [""] * columns)[:columns])
                    if len(held) == 10_000:
                        yield _batch(path, at, held, columns)
                        at, held = at + len(held), []
                if held:
                    yield _batch(path, at, held, columns)

    return run


def _without_bom(pieces: Iterable[str]) -> Iterator[str]:
    first = True
    for piece in pieces:
        yield piece.removeprefix("﻿") if first and piece else piece
        first = first and not piece


def _batch(path: str, at: int, rows: list[list[str]], columns: int) -> pa.RecordBatch:
    cells = [pa.array([r[k] for r in rows], pa.string()) for k in range(columns)]
    return pa.RecordBatch.from_arrays([pa.array([path] * len(rows)), pa.array(range(at, at + len(rows)), pa.int64()), *cells], ["__tm_file", "__tm_place", *(f"c{k}" for k in range(columns))])


def read_text(spark: SparkSession, path: str, delimiter: str | None = None, encoding: str = "utf-8", strict: bool = True, multiline: bool = True, row_id: str = "__rowId") -> Raw:
    """A delimited file, or a folder of files with one header each, as text columns.

    Short rows are filled with empty text, long ones cut. ``multiline=False`` is for ``strict=False`` and lets Spark's
    reader split large files, for data without line ends inside quotes.
    """
    head = _head(spark, path, encoding)
    delimiter, each = delimiter or detect_delimiter(head), None
    names = header_names(next(records([head], delimiter), []))
    if not names:
        raise ValueError(f"{path} has no header")
    if strict and encoding.lower().replace("_", "-") in ("utf-8", "utf8", "us-ascii", "ascii") and not any(is_gzip(f) and not f.endswith(".gz") for f in _files(spark, path)):
        each = _strict_splits(spark, path, len(names), delimiter, row_id)
        rows = placed = each(None, None)
    elif strict:
        kind = ", ".join(["__tm_file string", "__tm_place long", *(f"c{k} string" for k in range(len(names)))])
        rows = spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(_strict_rows(len(names), delimiter, encoding), kind)
        placed = numbered(rows, ["__tm_file"], "__tm_place", row_id)
    else:
        schema = ", ".join(f"c{k} string" for k in range(len(names)))
        rows = spark.read.schema(schema).csv(path, header=True, sep=delimiter, quote='"', escape='"', mode="PERMISSIVE", encoding=encoding, multiLine=multiline, enforceSchema=True, nullValue="\u0000", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
        placed = scan_with_row_ids(rows, row_id)
    cells = [(F.col(f"c{k}") if strict else F.coalesce(F.col(f"c{k}"), F.lit(""))).alias(n) for k, n in enumerate(names)]
    return Raw(placed.select(column(row_id), *cells), rows.select(*cells), names, delimiter, each)


# --- splits -----------------------------------------------------------------------------------------------------------
def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[tuple[int, int], pa.BinaryArray]]:
    """((file, block), lines) of each run of rows of one split."""
    for batch in batches:
        file, block = (batch.column(n).to_numpy(zero_copy_only=False) for n in ("file", "block"))
        cuts = np.concatenate([[0], np.flatnonzero((file[1:] != file[:-1]) | (block[1:] != block[:-1])) + 1, [batch.num_rows]])
        lines = batch.column("value").cast(pa.binary())
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield (int(file[a]), int(block[a])), lines[int(a) : int(b)]


class Splits:
    """What every task knows of all splits: 40 bytes for each, found by file and block."""

    def __init__(self, rows: list[tuple[int, int, int, int, int]]):
        """(file, block, number, base, bits) with bits: 1 the last of its file, 2 begins inside quotes, 4 the first."""
        self.table = np.array(sorted(rows), np.int64).reshape(-1, 5)

    def __getitem__(self, key: tuple[int, int]) -> tuple[int, int, bool, int, bool]:
        """(number, base, last, quoted, first)"""
        t = self.table
        a, b = np.searchsorted(t[:, 0], key[0], "left"), np.searchsorted(t[:, 0], key[0], "right")
        _, _, number, base, bits = t[a + np.searchsorted(t[a:b, 1], key[1])].tolist()
        return number, base, bool(bits & 1), (bits >> 1) & 1, bool(bits & 4)


def _quotes(lines: pa.BinaryArray) -> np.ndarray:
    return pc.count_substring(lines, b'"').to_numpy(zero_copy_only=False).astype(np.int64)


def _lone_returns(lines: pa.BinaryArray, quotes: np.ndarray, quoted: int) -> np.ndarray:
    """For each line the CRs outside quotes that are not at its end, if the first line begins ``quoted``."""
    found = np.zeros(len(lines), np.int64)
    has = np.flatnonzero(pc.match_substring(lines, b"\r").to_numpy(zero_copy_only=False))
    if len(has):
        before = (quoted + np.cumsum(quotes) - quotes) % 2
        for i in has.tolist():
            parts = lines[i].as_py().removesuffix(b"\r").split(b'"')
            found[i] = sum(part.count(b"\r") for part in parts[int(before[i]) :: 2])
    return found


def _count_splits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each split the parity of its quotes, and how many records end in it at a line end, or before one at a lone CR,
    if it begins outside quotes (n0) or inside (n1, without the record that it begins in)."""
    now, parity, n, open_, head = None, 0, [0, 0], [0, 0], True
    rows = []

    def finish():
        if now is not None:
            rows.append((*now, parity, *n))

    for key, lines in _stretches(batches):
        if key != now:
            finish()
            now, parity, n, open_, head = key, 0, [0, 0], [0, 0], True
        quotes = _quotes(lines)
        after = (parity + np.cumsum(quotes)) % 2
        for s in (0, 1):
            lone = _lone_returns(lines, quotes, parity ^ s)
            ends = np.flatnonzero(after == s)
            if not len(ends):
                open_[s] += int(lone.sum())
                continue
            n[s] += open_[s] + int(lone[: ends[-1] + 1].sum()) + len(ends)
            if s and head:
                n[s] -= open_[s] + int(lone[: ends[0] + 1].sum()) + 1
                head = False
            open_[s] = int(lone[ends[-1] + 1 :].sum())
        parity = int(after[-1])
    finish()
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["file", "block", "parity", "n0", "n1"])


def _fragments(splits):
    """What of a split lies in records over its borders: lines up to the first that ends outside quotes, in a split that
    begins inside them (part 1, or 2 if there is no such line: the split lies within a record), and lines after the
    last (part 3)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, number, held, head, quoted, last = None, 0, [], False, 0, False

        def piece(part: int, lines: list[pa.BinaryArray], more: bool) -> pa.RecordBatch:
            text = _joined_lines(lines).to_pybytes() + (b"\n" if more else b"")
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((now[0], number, part, text), (pa.int64(), pa.int64(), pa.int32(), pa.binary()), strict=True)], ["file", "split", "part", "text"])

        def finish() -> Iterator[pa.RecordBatch]:
            if now is not None and held and quoted:
                yield piece(2 if head else 3, held, not last)

        for key, lines in _stretches(batches):
            if key != now:
                yield from finish()
                now, held = key, []
                number, _, last, quoted, _ = splits.value[key]
                head = bool(quoted)
            after = (quoted + np.cumsum(_quotes(lines))) % 2
            ends = np.flatnonzero(after == 0)
            if len(ends) and head:
                yield piece(1, [*held, lines[: int(ends[0]) + 1]], True)
                head = False
            held = [lines[int(ends[-1]) + 1 :]] if len(ends) else [*held, lines]
            held = [x for x in held if len(x)]
            quoted = int(after[-1])
        yield from finish()

    return run


def _joined_lines(lines: list[pa.BinaryArray]) -> pa.Buffer:
    whole = pa.concat_arrays(lines)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(whole)], pa.int32()), whole), b"\n")[0].as_buffer()


def _regular(data: bytes, delimiter: str) -> bool:
    """Whether every quote opens or closes a whole cell or is one of a doubled pair inside one, and every CR is before LF."""
    if data.count(b"\r") != data.count(b"\r\n"):
        return False
    b = np.frombuffer(data, np.uint8)
    at = np.flatnonzero(b == 34)
    border = np.isin(np.arange(256), [ord(delimiter), 10, 13, 34])
    opens, closes = at[0::2], at[1::2]
    before, behind = opens[opens > 0] - 1, closes[closes < len(b) - 1] + 1
    return len(at) % 2 == 0 and bool(border[b[before]].all() and border[b[behind]].all())


def parse_chunk(data: bytes, columns: int, delimiter: str) -> list[pa.Array]:
    """Columns of whole records; short ones are filled, long ones cut."""
    names = [f"c{k}" for k in range(columns)]
    if _regular(data, delimiter):
        try:
            table = arrow_csv.read_csv(
                pa.BufferReader(data),
                arrow_csv.ReadOptions(use_threads=False, block_size=len(data) + 1, column_names=names),
                arrow_csv.ParseOptions(delimiter=delimiter, newlines_in_values=True, ignore_empty_lines=False),
                arrow_csv.ConvertOptions(check_utf8=False, column_types=dict.fromkeys(names, pa.string()), strings_can_be_null=False),
            )
            return [c.combine_chunks() for c in table.columns]
        except pa.ArrowInvalid:  # rows of other widths
            pass
    rows = [(r + [""] * columns)[:columns] for r in records([data.decode("utf-8", "replace")], delimiter)]
    return [pa.array([r[k] for r in rows], pa.string()) for k in range(columns)]


def _split_rows(splits, columns: int, delimiter: str, row_id: str, step: plaincells.Step | None):
    """Lines of splits, in order, to their complete records, numbered, and what ``step`` makes of them."""

    def batch(first: int, cells: list[pa.Array], skip: int) -> pa.RecordBatch:
        cells = [c[skip:] for c in cells]
        return pa.RecordBatch.from_arrays([pa.array(np.arange(first, first + len(cells[0]))), *cells], [row_id, *(f"c{k}" for k in range(columns))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, head, quoted, at, skip = None, [], False, 0, 0, 0
        for key, lines in _stretches(batches):
            if key != now:
                now, held = key, []
                _, at, _, quoted, first = splits.value[key]
                head, skip = bool(quoted), int(first)
                bom = first and lines[0].as_py().startswith(b"\xef\xbb\xbf")
                lines = pa.concat_arrays([pa.array([lines[0].as_py()[3:]], pa.binary()), lines[1:]]) if bom else lines
            after = (quoted + np.cumsum(_quotes(lines))) % 2
            ends = np.flatnonzero(after == 0)
            quoted = int(after[-1])
            if not len(ends):
                held = [] if head else [*held, lines]
                continue
            begin, end = (int(ends[0]) + 1 if head else 0), int(ends[-1]) + 1
            whole, head, held = [*held, lines[begin:end]], False, [lines[end:]] if end < len(lines) else []
            if sum(map(len, whole)):
                cells = parse_chunk(_joined_lines(whole).to_pybytes() + b"\n", columns, delimiter)
                made = batch(at, cells, skip)
                yield step(made) if step else made
                at += len(cells[0]) - skip
                skip = 0

    return run


def _joined(columns: int, delimiter: str):
    """Fragments of whole files, in order, to the records they make: (split of the first, place among its own, cells)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, where = [], None

        def made() -> pa.RecordBatch:
            cells = parse_chunk(b"".join(held), columns, delimiter)
            n = len(cells[0])
            return pa.RecordBatch.from_arrays([pa.array([where[1]] * n, pa.int64()), pa.array(range(n), pa.int64()), *cells], ["split", "place", *(f"c{k}" for k in range(columns))])

        for batch in batches:
            for file, split, part, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (file != where[0] or part == 3):
                    yield made()
                    held = []
                where = where if held else (file, split)
                held.append(text)
                if part == 1:
                    yield made()
                    held = []
        if held:
            yield made()

    return run


def _strict_splits(spark: SparkSession, path: str, columns: int, delimiter: str, row_id: str) -> Callable[[plaincells.Step | None, str | None], DataFrame]:
    """Numbered rows of all splits, or what a step makes of them in rows of the given kind; what goes to the driver and back is one row of five numbers for each split."""
    place = F.xxhash64(F.col("_metadata.file_path")).alias("file")
    order = {h: k for k, (_, h) in enumerate(sorted(tuple(r) for r in spark.read.format("binaryFile").load(path).select("_metadata.file_path", place).collect()))}
    lines = spark.read.option("lineSep", "\n").text(path).select(place, F.col("_metadata.file_block_start").alias("block"), "value")
    # where no line has an odd quote or a CR before its end, lines are records, which one native count tells
    odd_quotes = (F.octet_length("value") - F.octet_length(F.replace("value", F.lit('"'), F.lit("")))) % 2
    early_return = F.instr("value", "\r").between(1, F.char_length("value") - 1)
    plain = lines.groupBy("file", "block").agg(F.lit(0).alias("parity"), F.count(F.lit(1)).alias("n0"), F.count(F.lit(1)).alias("n1"), F.bool_or((odd_quotes > 0) | early_return).alias("other")).collect()
    if any(r.other for r in plain):
        plain = lines.mapInArrow(_count_splits, "file long, block long, parity int, n0 long, n1 long").collect()
    counted = sorted(((order[r.file], r) for r in plain), key=lambda x: (x[0], x[1].block))
    known, quoted, odd = [], 0, False
    for k, (file, r) in enumerate(counted):
        first, last = k == 0 or counted[k - 1][0] != file, k + 1 == len(counted) or counted[k + 1][0] != file
        quoted = 0 if first else quoted
        n = max((r.n1 if quoted else r.n0) - (1 if first and not quoted else 0), 0)
        known.append((r, n, last | quoted << 1 | first << 2))
        quoted = (quoted + r.parity) % 2
        odd |= bool(quoted)
    cells = ", ".join(f"c{k} string" for k in range(columns))

    def table(bases: list[int]):
        return spark.sparkContext.broadcast(Splits([(r.file, r.block, k, b, bits) for k, ((r, _, bits), b) in enumerate(zip(known, bases, strict=True))]))

    across: dict[int, int] = {}
    if odd:  # some split ends inside quotes
        pieces = lines.mapInArrow(_fragments(table([0] * len(known))), "file long, split long, part int, text binary")
        pieces = pieces.repartition("file").sortWithinPartitions("file", "split", "part")
        joined = pieces.mapInArrow(_joined(columns, delimiter), f"split long, place long, {cells}")
        across = dict(joined.groupBy("split").count().collect())
    bases = list(accumulate((n + across.get(k, 0) for k, (_, n, _) in enumerate(known)), initial=0))[:-1]
    own, rest = table(bases), None
    if across:
        after = spark.createDataFrame([(k, bases[k] + known[k][1]) for k in sorted(across)], "split long, after long")
        after = F.broadcast(after) if len(across) <= BROADCAST_SPLITS else after
        rest = joined.join(after, "split").select((F.col("after") + F.col("place")).alias(row_id), *(f"c{k}" for k in range(columns)))

    def each(step: plaincells.Step | None, kind: str | None) -> DataFrame:
        rows = lines.mapInArrow(_split_rows(own, columns, delimiter, row_id, step), kind or f"`{row_id}` long, {cells}")
        if rest is None:
            return rows
        return rows.unionAll(rest.mapInArrow(plaincells.over(step), kind) if step else rest)

    return each


@dataclass(frozen=True)
class Loaded:
    """A typed table, and what was found out about its columns; ``rows`` is the row count of the inference pass."""

    df: DataFrame
    inferred: list[Inferred]
    rows: int
    delimiter: str


def read_typed(spark: SparkSession, path: str, lenient: bool = False, **options) -> Loaded:
    """:func:`read_text`, then types inferred from all rows in one pass and one projection to them."""
    raw = read_text(spark, path, **options)
    if raw.each is None:
        found = infer(raw.plain, raw.columns)
        return Loaded(typed(raw.df, found, lenient), found, found[0].rows if found else 0, raw.delimiter)
    utc = spark.conf.get("spark.sql.session.timeZone") in ("UTC", "Etc/UTC", "GMT", "Z")
    found = infer_counted(raw.each(plaincells.summary(len(raw.columns), utc), plaincells.SUMMARY_DDL), raw.columns)
    kinds = {k: f.kind for k, f in enumerate(found) if f.kind in (Kind.NUMBER, Kind.DATETIME)}
    row_id = raw.df.columns[0]
    written = {Kind.NUMBER: "double", Kind.DATETIME: "timestamp"}
    ddl = ", ".join([f"`{row_id}` long", *(f"c{k} string" for k in range(len(found))), *(f"v{k} {written[kind]}" for k, kind in kinds.items())])
    rows = raw.each(plaincells.values(kinds, lenient, utc), ddl)
    read = {raw.columns[k]: f"__tm_v{k}" for k in kinds}
    rows = rows.select(column(row_id), *(F.col(f"c{k}").alias(c) for k, c in enumerate(raw.columns)), *(F.col(f"v{k}").alias(f"__tm_v{k}") for k in kinds))
    return Loaded(typed(rows, found, lenient, read), found, found[0].rows if found else 0, raw.delimiter)
