"""Running sums over descriptors in spans against one window per partition."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidelog.operators import records, retention


@pytest.fixture
def seg(spark, monkeypatch):
    monkeypatch.setattr(records, "SPAN", 200)
    rng, rows = random.Random(4), []
    for part, n in ((0, 120), (1, 1), (2, 37)):
        at = rng.randint(0, 300)
        for i in range(n):
            size = rng.randint(1, 90)
            rows.append((part, i, at, size, rng.randint(60, 900), rng.randint(0, 50)))
            at += size + (rng.randint(1, 600) if rng.random() < 0.05 else 0)
    return spark.createDataFrame(rows, "part int, seg long, base_offset long, record_count long, byte_length long, received_at long")


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_running_sums(seg):
    order = Window.partitionBy("part").orderBy("base_offset")
    want = seg.withColumn("total", F.sum("byte_length").over(order)).withColumn("nth", F.row_number().over(order).cast("long"))
    assert rows(records.running(seg, total=F.col("byte_length"), nth=F.lit(1).cast("long"))) == rows(want)


def test_gaps(seg):
    order = Window.partitionBy("part").orderBy("base_offset")
    want = seg.withColumn("expected", F.lag(F.col("base_offset") + F.col("record_count")).over(order)).where("expected <> base_offset").select("part", "base_offset", "expected")
    assert want.count() > 2 and rows(records.contiguity_violations(seg)) == rows(want)


@pytest.mark.parametrize("max_bytes", [None, 0, 4000, 10**9])
def test_expiry(seg, max_bytes):
    stamped = seg.withColumn("received_at", F.timestamp_seconds("received_at"))
    order = Window.partitionBy("part").orderBy("base_offset")
    old = F.col("received_at") + F.expr("INTERVAL 5 SECOND") <= F.timestamp_seconds(F.lit(48))
    left = F.sum("byte_length").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    want = stamped.withColumn("out", old | (F.lit(False) if max_bytes is None else left > max_bytes)).withColumn("expired", F.bool_and("out").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("out")
    got = retention.expired(stamped, F.timestamp_seconds(F.lit(48)), 5, max_bytes)
    assert rows(got.select("part", "seg", "expired")) == rows(want.select("part", "seg", "expired"))


def test_reachable_nodes(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("a", "c"), ("x", "y"), ("c", "d")], "parent string, child string")
    roots = spark.createDataFrame([("a",), ("z",)], "node string")
    assert rows(retention.reachable(edges, roots)) == [("a", 0), ("b", 1), ("c", 1), ("d", 2), ("z", 0)]
