"""Connected components by alternating large-star and small-star."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, drop


def star(edges: DataFrame, large: bool) -> DataFrame:
    """One operation on edges (a > b): every node's neighbours (large: the larger ones) move to its smallest neighbour."""
    near = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
    if large:
        near = near.union(near.select(F.col("v"), F.col("u")))
    least = near.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("w"), F.least("u", "m").alias("m"))
    moved = near.join(least, F.col("u") == F.col("w")).where("v > u" if large else "v > m").select(F.col("v").alias("a"), F.col("m").alias("b"))
    own = least.where("w > m").select(F.col("w").alias("a"), F.col("m").alias("b"))
    out = cut((moved if large else moved.union(own)).distinct())
    drop(edges)
    return out


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """node, component (the smallest node it reaches) of every node of links (a, b); null ends and loops are ignored.

    Each operation aggregates a node's neighbours before it joins their minimum back, so that a node with very many
    links is a skewed join that Spark splits, never one task's list. It ends when an alternation changes nothing.
    """
    edges = cut(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = lambda e: e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
    before = state(edges)
    for _ in range(rounds):
        if not before[0]:
            break
        edges = star(star(edges, True), False)
        now = state(edges)
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"no fixed point after {rounds} alternations")
    ends = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = cut(edges.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("component")).union(ends))
    drop(edges)
    return out
