"""Durable intermediate tables in the folder that every executor can reach."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``. Where that is unset, a private temporary one, but only in local mode:
    executors of a cluster would not see each other's files."""
    set_dir = spark.conf.get("spark.checkpoint.dir", None)
    if set_dir:
        return set_dir.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if not getattr(spark, "_tidemark_dir", None):
        spark._tidemark_dir = "file://" + tempfile.mkdtemp(prefix="tidemark-")
    return spark._tidemark_dir


def _remove(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


@atexit.register
def _clean() -> None:
    for spark, path in _made:
        try:
            if spark.sparkContext._jsc is not None:
                _remove(spark, path)
        except Exception:  # the session may be gone already; its folder is then left to the cluster
            return


def drop_table(df_path: str, spark: SparkSession) -> None:
    """Delete a table made by :func:`persist_path` that no later read needs."""
    _remove(spark, df_path)
    if (spark, df_path) in _made:
        _made.remove((spark, df_path))


def drop(*tables: DataFrame) -> None:
    """Delete tables made by :func:`persist`, once nothing reads them any more."""
    for df in tables:
        drop_table(df._tidemark_path, df.sparkSession)


def persist_path(df: DataFrame, name: str, rebalance: bool = True) -> str:
    """Write ``df`` as Parquet below the shared folder and return the path.

    A table on shared storage cuts lineage, survives the loss of any executor, and fixes the value of everything
    that is read from it more than once. Rows are dealt anew into files of the size that adaptive execution aims at,
    since digests of a corpus are small and would otherwise be as many small files as the corpus has tasks.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/tidemark-{name}-{uuid.uuid4().hex}"
    (df.hint("rebalance") if rebalance else df).write.parquet(path)
    _made.append((spark, path))
    return path


def persist(df: DataFrame, name: str, rebalance: bool = True) -> DataFrame:
    """:func:`persist_path`, read back."""
    path = persist_path(df, name, rebalance)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._tidemark_path = path
    return out
