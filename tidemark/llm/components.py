"""Connected components of an undirected graph, by alternating large-star and small-star steps (Kiveris et al. 2014).

No step gathers a node's edges: their least neighbour is found per (node, salt of the neighbour) first, and goes back to
the edges by the same pair, so a hub that holds most of the edges is dealt over ``SALTS`` keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.storage import drop_table, persist_path

#: Shares that the edges of one node are dealt into.
SALTS = 256


def _with_least(edges: DataFrame) -> DataFrame:
    """edges (u, v) and ``m``, the least v of each u."""
    cut = edges.withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    share = cut.groupBy("u", "salt").agg(F.min("v").alias("p"))  # at most SALTS rows for a node
    share = share.select("u", "salt", F.min("p").over(Window.partitionBy("u")).alias("m"))
    return cut.join(share, ["u", "salt"]).select("u", "v", "m")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges (u, v) with u > v. Each node's neighbours are tied to the least of them and the node."""
    if large:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        out = _with_least(both).where("v > u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
    else:
        tied = _with_least(edges)
        out = tied.select(F.col("v").alias("u"), F.col("m").alias("v")).union(tied.where("v = m").select("u", "v"))
    return out.where(F.col("u") != F.col("v")).distinct()


def _done(edges: DataFrame) -> bool:
    """Whether all edges are stars: no node is tied to two others, or tied and the one that others are tied to."""
    ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("down"), F.lit(0).alias("up")).union(edges.select(F.col("v"), F.lit(0), F.lit(1)))
    seen = ends.groupBy("x").agg(F.sum("down").alias("down"), F.max("up").alias("up"))
    return not seen.where("down > 1 OR (down > 0 AND up > 0)").head(1)


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has an edge; ``edges`` has two columns. A component's id is its least node.

    Each round is written to shared storage, so lineage stays one round long and any executor may be lost. Nulls,
    loops and repeated edges tie nothing; no edges give no rows.
    """
    a, b = (F.col(c) for c in edges.columns)
    spark = edges.sparkSession
    now = edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(a.isNotNull() & b.isNotNull() & (a != b)).distinct()
    path = persist_path(now, "edges")
    for _ in range(most_rounds):
        fixed = spark.read.parquet(path)
        if _done(fixed):
            break
        new_path = persist_path(_star(_star(fixed, True), False), "edges")
        drop_table(path, spark)
        path = new_path
    else:
        raise RuntimeError(f"no end after {most_rounds} rounds")
    stars = spark.read.parquet(path)
    out = stars.select(F.col("u").alias("node"), F.col("v").alias("component")).union(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
    out._tidemark_path = path
    return out
