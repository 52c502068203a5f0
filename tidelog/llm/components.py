"""Connected components of a distributed edge list by alternating large-star and small-star steps
(Kiveris et al., "Connected Components in MapReduce and Beyond", 2014)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch

#: Far above the logarithm of any component that fits a cluster.
MAX_ROUNDS = 60


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step. The minimum of a node's neighbours is aggregated before rows meet it, so a node
    with many neighbours is spread by the join's skew handling rather than gathered."""
    both = edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    if not large:
        both = both.where("b <= a")
    least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
    out = both.join(least, "a")
    if large:
        out = out.where("b > a")
    out = out.select(F.greatest("b", "m").alias("a"), F.least("b", "m").alias("b"))
    return out.union(least.select("a", F.col("m").alias("b"))).where("a <> b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """node, component for every node of edges(a, b): component is the smallest node it reaches.

    Nulls and loops are ignored. Each round is written to the shared folder, so lineage stays short
    and a lost executor costs one round at most; only a row count and a sum come to the driver.
    """
    scratch = Scratch(edges.sparkSession)
    now = scratch.write_numbers(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(MAX_ROUNDS):
        mark = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if mark == before or not mark.n:
            break
        before = mark
        last, now = now, scratch.write_numbers(_star(_star(now, True), False))
        scratch.drop(last)
    else:
        raise RuntimeError(f"components didn't settle in {MAX_ROUNDS} rounds")
    stars = now.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.union(stars.select(F.col("component").alias("node"), "component").distinct())
