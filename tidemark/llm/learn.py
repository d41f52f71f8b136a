"""Bounded samples of labelled rows, and fitting on them in one task of the cluster."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Distinct labels at most.
MOST_GRADES = 16


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, per_grade: dict[int, int] | int, max_chars: int, learnable: Column | None = None) -> DataFrame | None:
    """(__tm_id, __tm_text, __tm_y): for each label at most ``per_grade`` documents (or as many as it says for the label), drawn by a
    hash of doc_id; None without labels.

    A document with several labels has the least; nulls in id, label or text are passed over, and so are texts of more
    than ``max_chars`` characters, which bounds what the fit holds: such texts are scored, but never learnt from.
    ``learnable`` says which label rows may be seen.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull())
    rows = rows if learnable is None else rows.where(learnable)
    rows = rows.groupBy(F.col("doc_id").alias("__tm_id")).agg(F.min(label).cast("int").alias("__tm_y"))
    grades = sorted(r[0] for r in rows.select("__tm_y").distinct().limit(MOST_GRADES + 1).collect())
    if len(grades) > MOST_GRADES:
        raise ValueError(f"more than {MOST_GRADES} different labels")
    drawn = None
    for g in grades:
        part = rows.where(F.col("__tm_y") == g).orderBy(F.xxhash64("__tm_id"), "__tm_id").limit(per_grade if isinstance(per_grade, int) else per_grade.get(g, 0))
        drawn = part if drawn is None else drawn.unionAll(part)
    if drawn is None:
        return None
    texts = docs.select(F.col("doc_id").alias("__tm_id"), F.col("text").cast("string").alias("__tm_text")).where(F.col("__tm_text").isNotNull() & (F.char_length("__tm_text") <= max_chars))
    return texts.join(F.broadcast(drawn), "__tm_id").select("__tm_id", "__tm_text", "__tm_y")  # bounded by what was drawn


def labelled_sample(*args, **options) -> list[tuple[str, int]]:
    """(text, label) of :func:`labelled_rows`, sorted by doc_id, text and label."""
    rows = labelled_rows(*args, **options)
    return [] if rows is None else [(t, y) for _, t, y in sorted(map(tuple, rows.collect()))]


def fitted(rows: DataFrame | None, fit: Callable[[list[tuple[str, int]]], Any]) -> Any:
    """``fit`` of the sorted sample, run by one task, so that the driver holds the model and never the sample.

    The sample is bounded, so the task is; if its executor is lost, it runs again and gives the same model.
    """
    if rows is None:
        return fit([])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sample = sorted(row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([(t, y) for _, t, y in sample]))], pa.binary())], ["model"])

    found = rows.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0][0]) if found else fit([])
