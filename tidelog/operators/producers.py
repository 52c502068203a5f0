"""Idempotent producers: a fold per producer over its batches in order of arrival."""

from __future__ import annotations

from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..limits import PAGE_FANOUT, RETRY_WINDOW, SEQUENCE_RANGE
from .records import assign_offsets

APPENDED, DUPLICATE, OUT_OF_ORDER, FENCED, CONFLICT = "APPENDED", "DUPLICATE", "OUT_OF_ORDER_SEQUENCE_NUMBER", "INVALID_PRODUCER_EPOCH", "CONFLICTING_SEQUENCE"


@dataclass
class ProducerState:
    """A producer's epoch and its last RETRY_WINDOW batches: (sequence, count, fingerprint, tag).

    tag is what a duplicate is answered with: the base offset, or the arrival where offsets come later.
    """

    epoch: int
    batches: list[tuple[int, int, str, int]] = field(default_factory=list)

    def accept(self, epoch: int, sequence: int, count: int, fingerprint: str, tag: int) -> tuple[str, int | None]:
        """The verdict, and for a duplicate the first one's tag. Rejections leave the state as it was."""
        if epoch < self.epoch:
            return FENCED, None
        if epoch > self.epoch:
            if sequence != 0:
                return OUT_OF_ORDER, None
            self.epoch, self.batches = epoch, []
        for s, c, f, t in self.batches:
            if s == sequence:
                return (DUPLICATE, t) if (c, f) == (count, fingerprint) else (CONFLICT, None)
        expected = (self.batches[-1][0] + self.batches[-1][1]) % SEQUENCE_RANGE if self.batches else 0
        if sequence != expected:
            return OUT_OF_ORDER, None
        self.batches = [*self.batches, (sequence, count, fingerprint, tag)][-RETRY_WINDOW:]
        return APPENDED, tag


FOLDED = "producer_id long, arrival long, epoch int, sequence long, record_count long, fingerprint string, verdict string, original long"


def fold(arrivals: DataFrame) -> DataFrame:
    """arrivals(producer_id, arrival, epoch, sequence, record_count, fingerprint) with verdict and, for
    accepted and duplicate batches, original: the arrival that was appended.

    Single-batch requests don't depend on other producers. Rows of a producer are sorted by the
    shuffle and streamed, so a task holds five batches, however long a producer's history is.
    """
    names = [c.split()[0] for c in FOLDED.split(", ")]

    def run(batches):
        last, state = None, None
        for batch in batches:
            verdicts, originals = [], []
            for producer, arrival, epoch, sequence, count, fingerprint in zip(*(batch.column(c).to_pylist() for c in names[:6])):
                if state is None or producer != last:
                    last, state = producer, ProducerState(epoch)
                verdict, original = state.accept(epoch, sequence, count, fingerprint, arrival)
                verdicts.append(verdict)
                originals.append(original)
            cols = [*(batch.column(c) for c in names[:6]), pa.array(verdicts, pa.string()), pa.array(originals, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=names)

    rows = arrivals.select(*[F.col(c.split()[0]).cast(c.split()[1]) for c in FOLDED.split(", ")[:6]])
    return rows.repartition("producer_id").sortWithinPartitions("producer_id", "arrival").mapInArrow(run, FOLDED)


def last_batches(accepted: DataFrame, keep: int = RETRY_WINDOW) -> DataFrame:
    """The retry window: the last batches of each producer's latest epoch."""
    latest = Window.partitionBy("producer_id").orderBy(F.desc("epoch"), F.desc("arrival"))
    top = accepted.withColumn("nth", F.row_number().over(latest)).where(F.col("nth") <= keep)
    return top.withColumn("latest", F.max("epoch").over(Window.partitionBy("producer_id"))).where("epoch = latest").drop("latest")


def page_rollup(producers: DataFrame, levels: int = 2, fanout: int = PAGE_FANOUT) -> DataFrame:
    """producers(producer_id, batches) in pages of fanout ids in order, and pages of so many pages: page,
    level, min_id, max_id, n (producers), batches. Ids are numbered within spans, so none gathers all."""
    placed = assign_offsets(producers.withColumn("_all", F.lit(0)), ["_all"], ["producer_id"], F.expr("producer_id div 65536"), "place")
    out, pages = None, placed.select("place", F.col("producer_id").alias("min_id"), F.col("producer_id").alias("max_id"), F.lit(1).cast("long").alias("n"), "batches")
    for level in range(levels):
        sums = [F.min("min_id").alias("min_id"), F.max("max_id").alias("max_id"), F.sum("n").alias("n"), F.sum("batches").alias("batches")]
        pages = pages.groupBy(F.expr(f"place div {fanout}").alias("place")).agg(*sums)
        one = pages.select(F.col("place").alias("page"), F.lit(level).alias("level"), "min_id", "max_id", "n", "batches")
        out = one if out is None else out.union(one)
    return out
