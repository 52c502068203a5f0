"""Batch files of the public record-batch format, version 2, in and out of the log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import LogError
from ..functions.codec import decoded, encode_batch
from ..operators.records import SPAN, assign_offsets
from ..operators.tables import written
from .log import AppendResult, Batch, EventLog
from .requests import cut


def read_batches(log: EventLog, path: str) -> DataFrame:
    """file and the fields of each record in the batch files below path. A file that can't be read has
    one row with the error's code instead."""
    files = log.spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("content").alias("data"))
    return decoded(files).select("file", "record.*", "error")


def import_batches(log: EventLog, topic: str, partition: int, path: str) -> list[AppendResult]:
    """Appends the records of all files in the order of their offsets; none if a file can't be read or
    offsets come twice. Files are decoded once; each request keeps within the limits of records and bytes."""
    rows = written(read_batches(log, path))
    bad = rows.where("error is not null").limit(1).collect()
    if bad:
        raise LogError(bad[0].file, bad[0].error)
    n, distinct, first = rows.agg(F.count("*"), F.count_distinct("offset"), F.min("offset")).first()
    if n != distinct:
        raise LogError("offsets come twice", "CORRUPT_MESSAGE")
    out = []
    if not n:
        return out
    dense = assign_offsets(rows.withColumn("_all", F.lit(0)), ["_all"], ["offset"], F.expr(f"offset div {SPAN}"), "place")
    cut_rows, requests = cut(dense.select("timestamp_ms", "key", "value", "headers", "place"), F.col("place"))
    for r in requests:
        out += log.append_batches(topic, partition, [Batch(cut_rows.where(F.col("request") == r))])
    return out


def export_batch(log: EventLog, topic: str, partition: int, offset: int, records: int = 1000) -> bytes:
    """At most so many records from an offset on as one batch; b"" at the end of the log."""
    rows = log.fetch(topic, partition, offset).where(F.col("offset") < offset + records).orderBy("offset").limit(records).collect()
    if not rows:
        return b""
    as_bytes = lambda x: None if x is None else bytes(x)
    made = [{"timestamp_ms": r.timestamp_ms, "key": as_bytes(r.key), "value": as_bytes(r.value), "headers": [(h.key, as_bytes(h.value)) for h in r.headers or []]} for r in rows]
    return encode_batch(made, rows[0].offset)
