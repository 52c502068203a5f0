"""Cutting ordered rows into requests that keep within the limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import limits
from ..operators.records import running
from ..operators.tables import written

#: What a request aims at: with a record as large as a batch may be besides, half of it is free.
REQUEST_BYTES = limits.BATCH_BYTES // 2


def cut(rows: DataFrame, place: Column) -> tuple[DataFrame, list[int]]:
    """rows(key, value, ...) with nth (place, dense from 0) and request, and the requests in order.

    A request takes the records of REQUEST_RECORDS places and of REQUEST_BYTES bytes: as many as both allow.
    The rows are written once; only the requests' numbers come to the driver.
    """
    size = F.lit(64) + F.coalesce(F.octet_length("key"), F.lit(0)) + F.coalesce(F.octet_length("value"), F.lit(0))
    summed = running(rows.withColumns({"part": F.lit(0), "base_offset": place.cast("long")}), _bytes=size)
    number = F.expr(f"base_offset div {limits.REQUEST_RECORDS}"), F.expr(f"_bytes div {REQUEST_BYTES}")
    # both go up with the place, so their sum tells requests apart in order
    out = written(summed.withColumn("nth", F.col("base_offset")).withColumn("request", number[0] + number[1]).drop("part", "base_offset", "_bytes"))
    return out, sorted(r.request for r in out.select("request").distinct().collect())
