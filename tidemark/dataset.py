"""The facade: a table with row ids, its views, distributions, suggestions and annotations."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions.text import ALWAYS_NFC, kind_of
from tidemark.operators import profile
from tidemark.operators.annotations import TagStore
from tidemark.operators.predicates import column
from tidemark.operators.view import View
from tidemark.plans.layout import Layout
from tidemark.plans.nodes import Kind

ROW_ID = "__rowId"


def configure(builder: SparkSession.Builder) -> SparkSession.Builder:
    """Settings that results depend on: datetimes are shown and read in UTC."""
    return builder.config("spark.sql.session.timeZone", "UTC").config("spark.sql.adaptive.enabled", "true")


def ping(spark: SparkSession) -> str:
    """``pong`` once an executor has answered; an error if none does."""
    return spark.range(1, numPartitions=1).select(F.lit("pong").alias("answer")).collect()[0].answer


@dataclass(frozen=True)
class Dataset:
    """One table. ``row_id`` names a column that is unique and rises in the order of rows."""

    df: DataFrame
    row_id: str = ROW_ID
    tags: TagStore | None = None
    _memo: dict = field(default_factory=dict, compare=False, repr=False)

    # --- making one -----------------------------------------------------------------------------------------------
    @classmethod
    def of(cls, df: DataFrame, row_id: str, nfc_free: Sequence[str] | None = None) -> "Dataset":
        """A table that has its row ids. ``nfc_free`` names text columns known to need no normal form."""
        out = cls(df, row_id)
        out._memo.update({("composed", c): True for c in nfc_free or ()})
        return out

    @classmethod
    def read_parquet(cls, spark: SparkSession, path: str) -> "Dataset":
        """Rows are numbered by file and place in it."""
        from tidemark.sources.rowid import parquet_with_row_ids

        return cls(parquet_with_row_ids(spark, path, ROW_ID))

    @classmethod
    def read_csv(cls, spark: SparkSession, path: str, **options) -> "Dataset":
        """Delimited text with inferred types; see :func:`tidemark.sources.delimited.read_typed`."""
        from tidemark.sources.delimited import read_typed

        return cls(read_typed(spark, path, row_id=ROW_ID, **options).df)

    # --- reading --------------------------------------------------------------------------------------------------
    @property
    def schema(self) -> T.StructType:
        return self.df.schema

    @property
    def columns(self) -> list[str]:
        return [c for c in self.df.columns if c != self.row_id]

    def composed(self, name: str) -> bool:
        """Whether a text column holds nothing that normal form C would change; asked of the data once and kept."""
        key = ("composed", name)
        if key not in self._memo:
            text = name in self.schema.names and isinstance(self.schema[name].dataType, T.StringType)
            self._memo[key] = not text or not self.df.where(~column(name).rlike(ALWAYS_NFC)).head(1)
        return self._memo[key]

    def view(self) -> View:
        return View(self)

    def value_distribution(self, name: str, ascending: bool = False) -> profile.Distribution:
        """Of all rows, whatever is filtered; kept once it was asked for."""
        key = ("distribution", name, ascending)
        if key not in self._memo:
            self._memo[key] = profile.value_distribution(self.df.drop(self.row_id), name, ascending)
        return self._memo[key]

    def profile(self) -> DataFrame:
        return profile.profile(self.df.drop(self.row_id))

    def initial_layout(self) -> Layout:
        rows = self.profile().collect()
        return Layout.initial({r.column: r.nulls for r in rows}, rows[0].rows if rows else 0)

    def rows(self, ids: Sequence[int]) -> DataFrame:
        """Rows by id, in the order asked; unknown ids are left out."""
        wanted = self.df.sparkSession.createDataFrame(list(enumerate(map(int, ids))), "__tm_at long, __tm_id long")
        return wanted.join(self.df, column(self.row_id) == F.col("__tm_id")).orderBy("__tm_at").select(*map(column, self.df.columns))

    def range(self, offset: int, limit: int) -> DataFrame:
        """Rows by place in the unsorted table, whose ids are dense."""
        first = max(0, offset)
        return self.df.where(column(self.row_id).between(first, first + max(0, limit) - 1)).orderBy(column(self.row_id))

    def with_tags(self, tags: TagStore) -> "Dataset":
        return replace(self, tags=tags)

    def with_tag_cells(self, df: DataFrame | None = None) -> DataFrame:
        """The rows with ``__tag``: struct of the labels (id, name, color) and the note; null where there is nothing."""
        df = self.df if df is None else df
        if self.tags is None:
            raise ValueError("the dataset has no annotations")
        cells = self.tags.cells().select(F.col("row_id").alias("__tm_row"), F.struct("labels", "note").alias("__tag"))
        return df.join(cells, column(self.row_id) == F.col("__tm_row"), "left").drop("__tm_row")

    def text_columns(self) -> list[str]:
        return [f.name for f in self.schema if f.name != self.row_id and kind_of(f.dataType) == Kind.STRING]


def checkpoints(start: int, count: int, interval: int = 50_000, total: int | None = None) -> list[int] | None:
    """Which row checkpoints a reader of ``count`` rows from ``start`` needs: the last at or before it and those inside."""
    if count <= 0 or (total is not None and total <= 0):
        return None
    start = max(0, start)
    first = start // interval * interval
    end = start + count if total is None else min(start + count, total)
    return [first, *range(first + interval, end, interval)]
