"""Connected components of an edge table by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logwarden.llm.common import written


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Link the neighbours of each node to the least of them: those after the node, or those before it and itself."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
    linked = both.join(least, "u")
    if large:
        out = linked.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
    return out.where(F.col("u") != F.col("v")).distinct()


def components(edges: DataFrame, folder: str, name: str) -> DataFrame:
    """``node, label`` of every node of an edge; ``label`` is the least node of its component.

    ``edges`` has two comparable columns ``u`` and ``v``.  Each round writes its edges to the shared folder; the number of
    rounds grows with the logarithm of the longest path, not with the number of edges.
    """
    now = written(edges.where(F.col("u") != F.col("v")).distinct(), folder, f"{name}-0")
    before = None
    for step in range(1, 100):
        now = written(_star(_star(now, True), False), folder, f"{name}-{step}")
        state = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if tuple(state) == before:
            break
        before = tuple(state)
    return now.select(F.col("u").alias("node"), F.col("v").alias("label")).union(
        now.select(F.col("v").alias("node"), F.col("v").alias("label"))
    ).distinct()
