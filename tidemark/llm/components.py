"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from tidemark.llm.frames import staged


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step on edges (u > v): neighbours of a node are linked to the smallest of them and the node."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges
    # a node with very many neighbours is summed up per task first, and its join can be split
    least = both.groupBy(F.col("u").alias("_u")).agg(F.min("v").alias("_least"))
    met = both.join(least, F.col("u") == F.col("_u")).withColumn("_least", F.least("u", "_least"))
    if large:
        moved = met.where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("_least").alias("v"))
    else:
        moved = met.select(F.col("v").alias("u"), F.col("_least").alias("v")).unionByName(met.select("u", F.col("_least").alias("v")))
    return moved.where(F.col("u") > F.col("v")).distinct()


def connected(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of `edges` (u, v): root is the smallest node it can reach.

    Loops and repeats are no harm; null ends are dropped. Each round is a written table.
    """
    edges = staged(edges.where(F.col("u") != F.col("v")).select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), "edges")
    before = None
    if edges.isEmpty():
        return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    while True:
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before = now
        edges = staged(_star(_star(edges, large=True), large=False), "edges")
    return staged(edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()), "roots")
