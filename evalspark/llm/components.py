"""Connected components of a graph of long node ids, by alternating large and small stars.

Each round, a node's larger neighbours are linked to the smallest node it knows, then its smaller ones; stars of the
components remain. The smallest neighbour comes from a partial aggregation and is joined back, so the edges of
one node need not meet in one task. Every round is cut by a written table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evalspark.llm.common import cut


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges: (a, b) with a > b, distinct."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        near = near.unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = near.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    linked = near.join(least, "u")
    if large:
        out = linked.filter(F.col("v") > F.col("u")).select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
    return out.filter(F.col("a") != F.col("b")).distinct()


def components(edges: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """``node, root``: for every node of an edge the smallest node that it is linked with, at any distance.

    Edges with a null end and loops are left out; no edges give no rows. Raises if ``rounds`` were not enough, which
    takes chains of more than about 2**30 nodes.
    """
    edges = edges.filter(F.col(a) != F.col(b)).select(F.greatest(a, b).alias("a"), F.least(a, b).alias("b"))
    edges = cut(edges.distinct())
    state = None
    for _ in range(rounds):
        edges = cut(_star(_star(edges, True), False))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
            return roots.unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
        state = now
    raise RuntimeError(f"components did not settle in {rounds} rounds")
