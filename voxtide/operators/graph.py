"""Connected components of an edge list, by alternating star contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..tables import materialize


def _stars(edges: DataFrame) -> DataFrame:
    """Every node joins the least of itself and its neighbours: (u, v) with u > v."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("least"))
    least = materialize(least.select("u", F.least("u", "least").alias("least")), "least")
    # the nodes above u join the least node around u; a large star is read and joined in many tasks
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("least").alias("v")).distinct()


def _small_stars(edges: DataFrame) -> DataFrame:
    """The lesser neighbours of a node, and the node, join the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("least"))
    least = materialize(least, "least")
    moved = edges.join(least, "u").filter("v <> least").select(F.col("v").alias("u"), F.col("least").alias("v"))
    return moved.unionByName(least.select("u", F.col("least").alias("v"))).distinct()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(node, component): the least node that each node of an edge reaches, itself included.

    Edges point either way and may repeat; loops count as nodes. Each round is two contractions, of which every
    aggregate is combined before its shuffle; the number of rounds grows with the logarithm of the longest path. Nodes
    need an order. An edge with a null end is ignored. A run that doesn't settle in `max_rounds` rounds is an error.
    """
    ends = edges.select(F.col(src).alias("a"), F.col(dst).alias("b")).filter("a is not null and b is not null")
    pairs = ends.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now = materialize(pairs, "edges")
    loops = ends.filter("a = b").select(F.col("a").alias("node"))
    if now.isEmpty():
        return loops.distinct().select("node", F.col("node").alias("component"))
    before = None
    for _ in range(max_rounds):
        now = materialize(_small_stars(materialize(_stars(now), "large")), "small")
        # settled once nothing changes: compare the number of edges and an order-free digest of them
        digest = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if digest == before:
            break
        before = digest
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    found = now.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = now.select(F.col("v").alias("node")).distinct().select("node", F.col("node").alias("component"))
    lone = loops.distinct().join(found.select("node").unionByName(roots.select("node")), "node", "left_anti")
    return found.unionByName(roots).unionByName(lone.select("node", F.col("node").alias("component")))
