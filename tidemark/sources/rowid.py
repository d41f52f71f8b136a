"""Dense row numbers in file order, without moving rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Up to so many splits the table of their first numbers is small enough to send to every task (16 bytes each and a path).
BROADCAST_SPLITS = 200_000


def numbered(df: DataFrame, split: list[str], place: str, row_id: str) -> DataFrame:
    """``place`` counts rows inside a split; splits are numbered one after another by their names."""
    firsts = df.groupBy(*split).agg(F.min(place).alias("__tm_low"), F.count(F.lit(1)).alias("__tm_n")).orderBy(*split).collect()
    at, bases = 0, []
    for r in firsts:
        bases.append((*(r[c] for c in split), r["__tm_low"], at))
        at += r["__tm_n"]
    kinds = ", ".join(f"{c} {df.schema[c].dataType.simpleString()}" for c in split)
    base = df.sparkSession.createDataFrame(bases, f"{kinds}, __tm_low long, __tm_base long")
    base = F.broadcast(base) if len(bases) <= BROADCAST_SPLITS else base
    out = df.join(base, split)
    return out.withColumn(row_id, F.col("__tm_base") + F.col(place) - F.col("__tm_low")).drop(*split, place, "__tm_low", "__tm_base")


def parquet_with_row_ids(spark: SparkSession, path: str, row_id: str) -> DataFrame:
    df = spark.read.parquet(path)
    df = df.select("*", F.col("_metadata.file_path").alias("__tm_file"), F.col("_metadata.row_index").alias("__tm_place"))
    return numbered(df, ["__tm_file"], "__tm_place", row_id)


def scan_with_row_ids(df: DataFrame, row_id: str) -> DataFrame:
    """For a plain scan of text files: Spark reads each split in order within one task, so the id that rises by one
    inside a task, less the split's first, is the place in the split."""
    df = df.select("*", F.col("_metadata.file_path").alias("__tm_file"), F.col("_metadata.file_block_start").alias("__tm_block"), F.monotonically_increasing_id().alias("__tm_place"))
    return numbered(df, ["__tm_file", "__tm_block"], "__tm_place", row_id)
