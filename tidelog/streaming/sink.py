"""Writing a stream into the log exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.records import assign_offsets
from ..operators.tables import written
from ..sources.log import Batch, EventLog
from ..sources.requests import cut


class LogSink:
    """For writeStream.foreachBatch. A micro-batch is cut into requests within the log's limits, each an
    idempotent batch of the producer. Which micro-batch was written last, and the sequence after it, is
    committed as a group offset. One that Spark runs again is skipped if it's known there, else from
    its first request on that the log lacks; the order within a micro-batch is by the given columns,
    which makes a repeated run cut it the same way."""

    def __init__(self, log: EventLog, topic: str, partition: int, producer_id: int, order: list[str]):
        self.log, self.topic, self.partition, self.producer_id, self.order = log, topic, partition, producer_id, order
        self.group, self.key = f"sink-{producer_id}", (topic, partition)

    def __call__(self, df: DataFrame, batch_id: int) -> None:
        done = self.log.committed_offsets(self.group, [self.key]).first()
        if done.metadata is not None and int(done.metadata) >= batch_id:
            return
        first = max(0, done.offset)
        state = self.log.root_of(*self.key).producer(self.producer_id)
        known = state.batches[-1][0] if state and state.batches else -1
        # sorted in as many tasks as there are ranges of the order
        ranges = written(df.repartitionByRange(*self.order).withColumns({"_range": F.spark_partition_id(), "_all": F.lit(0)}))
        for c in ("key", "value"):
            ranges = ranges.withColumn(c, F.col(c).cast("binary") if c in ranges.columns else F.lit(None).cast("binary"))
        dense = assign_offsets(ranges, ["_all"], self.order, F.col("_range"), "_place")
        rows, requests = cut(dense.drop("_all", "_range"), F.col("_place"))
        for i, r in enumerate(requests or [0]):
            if first + i > known:
                part = rows.where(F.col("request") == r)
                self.log.append_batches(*self.key, [Batch(part, self.producer_id, 0, first + i, sequence_count=1)])
        self.log.commit_offsets(self.group, {self.key: (first + len(requests or [0]), str(batch_id))})
