"""Whole-batch retention by age and size, and what it leaves to collect."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .records import running
from .tables import written


def expired(seg: DataFrame, now: Column, max_age_s: int | None = None, max_bytes: int | None = None) -> DataFrame:
    """seg with expired: a batch expires if all before it did and it is too old, or what is still
    kept from it on is more than max_bytes. So a batch behind a younger one stays.

    What is kept from a batch on is the partition's total less what stands before; the first batch that
    stays is an aggregate. So no partition's descriptors are gathered or sorted in one task.
    """
    old = F.lit(False) if max_age_s is None else F.col("received_at") + F.expr(f"INTERVAL {max_age_s} SECOND") <= now
    out = seg
    large = F.lit(False)
    if max_bytes is not None:
        totals = seg.groupBy("part").agg(F.sum("byte_length").alias("_total"))
        out = running(seg, _to=F.col("byte_length")).join(totals, "part")
        large = F.col("_total") - F.col("_to") + F.col("byte_length") > max_bytes
    out = out.withColumn("_out", old | large)
    first = out.where("not _out").groupBy("part").agg(F.min("base_offset").alias("_first"))
    marked = out.join(first, "part", "left").withColumn("expired", F.coalesce(F.col("base_offset") < F.col("_first"), F.lit(True)))
    return marked.drop("_out", "_to", "_total", "_first")


def report(marked: DataFrame) -> DataFrame:
    """Per partition: counts and bytes of both kinds, and the first offset that is kept."""
    gone, kept = F.col("expired"), ~F.col("expired")

    def total(c: Column, when: Column) -> Column:
        return F.coalesce(F.sum(F.when(when, c)), F.lit(0)).cast("long")

    end = F.max(F.col("base_offset") + F.col("record_count"))
    start = F.coalesce(F.min(F.when(kept, F.col("base_offset"))), end)
    return marked.groupBy("part").agg(
        F.count_if(gone).alias("expired_batches"), total(F.col("byte_length"), gone).alias("expired_bytes"),
        F.count_if(kept).alias("retained_batches"), total(F.col("byte_length"), kept).alias("retained_bytes"),
        F.min("base_offset").alias("old_start"), start.alias("new_start"), end.alias("next_offset"),
    )


#: <uuid>.<suffix> right below its folder; nested names and others aren't ours to delete.
RECOGNISED = r"^(segments|index|producer-state)/[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\.(parquet|json)$"


def orphans(inventory: DataFrame, live: DataFrame) -> DataFrame:
    """Recognised objects (object, bytes) that nothing live refers to."""
    return inventory.where(F.col("object").rlike(RECOGNISED)).join(live.select("object").distinct(), "object", "left_anti")


def reachable(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """node, depth of what roots(node) reach over edges(parent, child), level by level: each level is a
    join of the one before, written, so there is no limit to rows or levels but the graph's depth. A node
    is at its least depth; cycles end."""
    edges = written(edges)
    level = found = written(roots.select("node", F.lit(0).alias("depth")).distinct())
    depth = 0
    while level.limit(1).count():
        depth += 1
        further = edges.join(level, edges["parent"] == level["node"]).select(F.col("child").alias("node")).distinct()
        level = written(further.join(found.select("node"), "node", "left_anti").select("node", F.lit(depth).alias("depth")))
        found = found.unionByName(level)
    return found
