"""Offsets, segments, bounded scans and checks over an ordered log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..limits import PAGE_FANOUT


def assign_offsets(df: DataFrame, partition: list[str], order: list[str], bucket: Column, name: str = "off") -> DataFrame:
    """df with dense offsets from 0 in each partition, in the given total order.

    bucket must not decrease along the order. Rows are numbered within (partition, bucket) and the
    buckets' counts are summed up before, so a partition is never sorted in one task.
    """
    keyed = df.withColumn("_bucket", bucket)
    counts = keyed.groupBy(*partition, "_bucket").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*partition).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select(*partition, "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    within = Window.partitionBy(*partition, "_bucket").orderBy(*order)
    out = keyed.withColumn("_nth", F.row_number().over(within)).join(bases, [*partition, "_bucket"])
    return out.withColumn(name, (F.col("_base") + F.col("_nth") - 1).cast("long")).drop("_bucket", "_n", "_base", "_nth")


#: Offsets whose descriptors are summed up by themselves before a partition's sums are put together.
SPAN = 65_536


def running(seg: DataFrame, **values: Column) -> DataFrame:
    """seg with running sums, each row's value included, along the base offsets of its partition.

    Descriptors are summed within spans of offsets, and the spans' totals before them; so a partition's
    descriptors never meet in one task, only a row for each of its spans does.
    """
    keyed = seg.withColumn("_span", F.expr(f"base_offset div {SPAN}")).withColumns({f"_v_{n}": v for n, v in values.items()})
    totals = keyed.groupBy("part", "_span").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = Window.partitionBy("part").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("part", "_span", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_b_{n}") for n in values])
    within = Window.partitionBy("part", "_span").orderBy("base_offset").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = keyed.withColumns({f"_w_{n}": F.sum(f"_v_{n}").over(within) for n in values}).join(bases, ["part", "_span"])
    out = out.withColumns({n: F.col(f"_b_{n}") + F.col(f"_w_{n}") for n in values})
    return out.drop("_span", *[f"_{k}_{n}" for k in "vbw" for n in values])


def segments(rec: DataFrame, records: int = 50) -> DataFrame:
    """Descriptors of segments of so many records; byte_length is that of the batch with its header."""
    size = (F.lit(61) + F.sum(F.lit(7) + F.octet_length("props"))).cast("long")
    seg = F.expr(f"off div {records}").cast("long")
    return rec.groupBy("part", seg.alias("seg")).agg(F.min("off").alias("base_offset"), F.count("*").alias("record_count"), size.alias("byte_length"), F.max("ts").alias("received_at"))


def paged(seg: DataFrame, fanout: int = PAGE_FANOUT) -> DataFrame:
    """Descriptors with their page; sealed tells those in full pages from the last 1 to fanout."""
    counts = seg.groupBy("part").agg(F.count("*").alias("n"))
    out = running(seg, rn=F.lit(1).cast("long")).join(counts, "part")
    return out.withColumn("page", F.expr(f"(rn - 1) div {fanout}")).withColumn("sealed", F.expr(f"rn <= ((n - 1) div {fanout}) * {fanout}")).drop("rn", "n")


def offset_ranges(seg: DataFrame) -> DataFrame:
    return seg.groupBy("part").agg(F.min("base_offset").alias("earliest"), F.max(F.col("base_offset") + F.col("record_count")).alias("latest"))


def bounded(seg: DataFrame, offset: int, max_bytes: int, allow_oversized: bool) -> DataFrame:
    """The segments of a bounded scan from an offset: whole batches while they fit in max_bytes; if
    none fits and allow_oversized is set, the first alone, marked oversized_first_batch."""
    live = seg.where(F.col("base_offset") + F.col("record_count") - 1 >= offset)
    live = running(live, running=F.col("byte_length"), nth=F.lit(1).cast("long"))
    fits = F.col("running") <= max_bytes
    first = (F.col("nth") == 1) & F.lit(allow_oversized)
    return live.where(fits | first).withColumn("oversized_first_batch", first & (F.col("byte_length") > max_bytes)).drop("running", "nth")


def records_of(rec: DataFrame, chosen: DataFrame, offset: int, records: int = 50) -> DataFrame:
    """The records of chosen segments from an offset on."""
    keyed = rec.where(F.col("off") >= offset).withColumn("seg", F.expr(f"off div {records}").cast("long"))
    return keyed.join(chosen.drop("ts"), ["part", "seg"])


def shared_budget(seg: DataFrame, offset: int, max_bytes: int) -> DataFrame:
    """A scan of several partitions in their order under one budget: the first batch of the answer
    may exceed it. The fold runs over one row per partition that holds running sums of batch sizes
    up to the budget only, so its arrays are short however long the partitions are."""
    live = seg.where(F.col("base_offset") + F.col("record_count") - 1 >= offset)
    live = running(live, running=F.col("byte_length"), nth=F.lit(1).cast("long"))
    runs = live.where((F.col("running") <= max_bytes) | (F.col("nth") == 1)).groupBy("part").agg(F.sort_array(F.collect_list("running")).alias("runs"))
    parts = runs.agg(F.sort_array(F.collect_list(F.struct("part", "runs"))).alias("parts"))
    step = """
        aggregate(parts, named_struct('left', cast({budget} as bigint), 'any', false,
                  'out', cast(array() as array<struct<part:int,n_batches:bigint,bytes:bigint,oversized:boolean>>)),
          (s, p) -> transform(array(greatest(cast(size(filter(p.runs, r -> r <= s.left)) as bigint), if(s.any, 0L, 1L))), n ->
            named_struct('left', greatest(0L, s.left - if(n = 0, 0L, p.runs[cast(n as int) - 1])), 'any', s.any or n > 0,
              'out', concat(s.out, array(named_struct('part', p.part, 'n_batches', n, 'bytes', if(n = 0, 0L, p.runs[cast(n as int) - 1]),
                'oversized', not s.any and p.runs[0] > s.left)))))[0],
          s -> s.out)"""
    return parts.select(F.explode(F.expr(step.format(budget=max_bytes))).alias("x")).select("x.*")


def locate(requests: DataFrame, seg: DataFrame, span: int = 1024) -> DataFrame:
    """The segment that holds each requested (part, off). Segments are listed under every span of
    offsets they reach into, so the range condition becomes an equality and a filter."""
    last = F.col("base_offset") + F.col("record_count") - 1
    listed = seg.select("part", "base_offset", "record_count", F.explode(F.sequence(F.expr(f"base_offset div {span}"), F.expr(f"(base_offset + record_count - 1) div {span}"))).alias("_span"))
    asked = requests.withColumn("_span", F.expr(f"off div {span}"))
    return asked.join(listed, ["part", "_span"]).where(F.col("off").between(F.col("base_offset"), last)).drop("_span")


def contiguity_violations(seg: DataFrame) -> DataFrame:
    """Segments that don't start where the one before ends."""
    end = F.col("base_offset") + F.col("record_count")
    keyed = seg.withColumn("_span", F.expr(f"base_offset div {SPAN}")).withColumn("_end", end)
    # the first of a span follows the last of the span before that has any
    last = keyed.groupBy("part", "_span").agg(F.max_by("_end", "base_offset").alias("_last"))
    last = last.select("part", "_span", F.lag("_last").over(Window.partitionBy("part").orderBy("_span")).alias("_before"))
    within = F.lag("_end").over(Window.partitionBy("part", "_span").orderBy("base_offset"))
    return keyed.withColumn("_lag", within).join(last, ["part", "_span"]).withColumn("expected", F.coalesce("_lag", "_before")).where("expected <> base_offset").select("part", "base_offset", "expected")


def offset_status(requests: DataFrame, ranges: DataFrame) -> DataFrame:
    status = F.when((F.col("off") < F.col("earliest")) | (F.col("off") > F.col("latest")), "OFFSET_OUT_OF_RANGE").when(F.col("off") == F.col("latest"), "AT_END").otherwise("IN_RANGE")
    return requests.join(ranges, "part").select("part", "off", status.alias("status"))


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")
