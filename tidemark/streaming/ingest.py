"""Progressive loading: files that arrive in a folder as a stream of typed rows, with progress for each batch."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from tidemark.functions.text import kind_of
from tidemark.operators.predicates import Scope, column, compile_node
from tidemark.plans.nodes import Kind, Node
from tidemark.sources.inference import Inferred, typed
from tidemark.sources.sidefiles import SharedFiles


@dataclass(frozen=True)
class Progress:
    """``bytes`` is the size of the batch as stored."""

    batch: int
    rows: int
    total_rows: int
    bytes: int


@dataclass(frozen=True)
class Summary:
    """Of one run; ``types`` are the columns' logical types."""

    rows: int
    bytes: int
    batches: int
    seconds: float
    types: dict[str, Kind]


class _End(StreamingQueryListener):
    """Calls ``done`` with the error's text, or None, when the query of that name ends, and then stops listening."""

    def __init__(self, spark: SparkSession, name: str, done: Callable[[str | None], None]):
        self.spark, self.name, self.done, self.run = spark, name, done, None

    def onQueryStarted(self, event) -> None:  # within start(), so before the end
        if event.name == self.name:
            self.run = event.runId

    def onQueryProgress(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if self.run is not None and event.runId == self.run:
            self.spark.streams.removeListener(self)
            self.done(event.exception)


def stream_csv(spark: SparkSession, folder: str, columns: Sequence[Inferred], delimiter: str = ",", lenient: bool = False, files_per_batch: int = 16) -> DataFrame:
    """CSV files with one header each, of columns whose types are known, as a streaming DataFrame."""
    schema = ", ".join(f"c{k} string" for k in range(len(columns)))
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).csv(folder, header=True, sep=delimiter, quote='"', escape='"', multiLine=True, nullValue="\u0000", emptyValue="")
    named = raw.select(*(F.coalesce(F.col(f"c{k}"), F.lit("")).alias(c.name) for k, c in enumerate(columns)))
    return typed(named, list(columns), lenient)


def stream_filter(df: DataFrame, node: Node | None) -> DataFrame:
    """The same predicates as on tables; they look at one row at a time and so need no state."""
    return df.where(compile_node(node, Scope(df.schema)))


def windowed_counts(df: DataFrame, time: str, keys: Sequence[str] = (), width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Rows for each window and key; rows later than the watermark are passed over and closed windows leave the state."""
    at = column(time).cast("timestamp")
    rows = df.withColumn("__tm_at", at).withWatermark("__tm_at", late)
    out = rows.groupBy(F.window("__tm_at", width).alias("w"), *map(column, keys)).agg(F.count(F.lit(1)).alias("rows"))
    return out.select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *map(column, keys), "rows")


def load_progressively(
    df: DataFrame,
    target: str,
    checkpoint: str,
    on_progress: Callable[[Progress], None] | None = None,
    available_now: bool = True,
    on_start: Callable[[list[str]], None] | None = None,
    on_complete: Callable[[Summary], None] | None = None,
    on_error: Callable[[str], None] | None = None,
) -> StreamingQuery:
    """Append each batch to a Parquet table and report it. A batch that is tried again replaces its own files.

    ``on_start`` gets the columns before anything is read; at the end ``on_complete`` gets the summary of this run or
    ``on_error`` the error's text, from Spark's listener and so perhaps a moment after ``awaitTermination`` returns.
    """
    spark = df.sparkSession
    files = SharedFiles(spark)
    total = {"rows": 0, "bytes": 0, "batches": 0}
    began = time.monotonic()

    def write(batch: DataFrame, number: int) -> None:
        place = f"{target}/batch={number}"
        batch.write.mode("overwrite").parquet(place)
        made = Progress(number, rows := batch.sparkSession.read.parquet(place).count(), total["rows"] + rows, files.size(place))
        total.update(rows=made.total_rows, bytes=total["bytes"] + made.bytes, batches=total["batches"] + 1)
        if on_progress:
            on_progress(made)

    def done(error: str | None) -> None:
        if error is not None and on_error:
            on_error(error)
        elif error is None and on_complete:
            types = {f.name: kind_of(f.dataType) for f in df.schema}
            on_complete(Summary(total["rows"], total["bytes"], total["batches"], time.monotonic() - began, types))

    writer = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer
    if on_start:
        on_start(list(df.columns))
    if not (on_complete or on_error):
        return writer.start()
    end = _End(spark, f"load-{uuid.uuid4().hex}", done)
    spark.streams.addListener(end)
    try:
        return writer.queryName(end.name).start()
    except Exception:
        spark.streams.removeListener(end)
        raise
