"""A corpus pipeline of five operators over ``documents``.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before kept. All but the last return the
columns of ``documents``; the last returns the packed pieces.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import decontaminate, jaccard_join, line_dedup, packing, quality_model
from tidemark.llm.queries import tokenizer_path
from tidemark.llm.storage import persist


def _own(out: DataFrame, docs: DataFrame) -> DataFrame:
    return out.select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier keeps: more likely than not better than the lowest grade."""
    model = quality_model.fit_on(docs, quality_model.graded_ratings(spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return _own(quality_model.rate_documents(docs, model).where("__tm_kept"), docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without their repeated lines; n_chars follows the text. Documents stay, even if nothing is left of them."""
    out = line_dedup.dedup_lines(docs, text_to="__tm_kept")
    out = out.withColumn("text", F.when(F.col("text").isNotNull(), F.col("__tm_kept")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("__tm_words").isNull(), F.col("n_chars")).otherwise(F.char_length("text")))
    return _own(out, docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group that links connect, the document with the least doc_id. Rows without a doc_id stay."""
    groups = jaccard_join.link_components(docs)
    later = groups.where("doc_id != component_id").select("doc_id").distinct()
    return docs.join(later, "doc_id", "left_anti").select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return _own(decontaminate.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")), docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of at most 1024 tokens."""
    return packing.pack_documents(docs, str(tokenizer_path()), with_ids=False)


STAGES = [
    ("quality classifier", quality),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", decontamination),
    ("best-fit packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = persist(docs, "stage", rebalance=False)
    return docs


#: Model fitting and tokenisation are beyond SQL; tests hold run() against a brute-force version.
ORACLE_SQL = None
