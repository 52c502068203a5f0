"""The log as a Spark data source, `spark.read(Stream).format("tidelog")`, with the options root and
topic: batch reads give all that is committed; streams go on from where the checkpoint left off."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..limits import SEQUENCE_RANGE
from .log import EventLog, Root
from .store import LocalStore

SCHEMA = "partition int, offset long, timestamp_ms long, key binary, value binary, producer_id long, sequence int"
_TYPES = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64(), pa.int32()]


@dataclass
class Part(InputPartition):
    """Some offsets of one segment."""

    path: str
    partition: int
    base: int
    low: int
    high: int


class _Reader:
    def __init__(self, options: dict):
        self.root, self.topic = options["root"].rstrip("/"), options["topic"]
        # revisions are small local or mounted files; the reader runs without a session
        self.log = EventLog.reading(LocalStore(self.root), self.root)
        self.start_at = options.get("startingoffsets", options.get("startingOffsets", "earliest"))

    def roots(self) -> dict[int, Root]:
        return {p: self.log.root_of(self.topic, p) for p in range(self.log.partition_count(self.topic))}

    def parts(self, start: dict[int, int], end: dict[int, int], roots: dict[int, Root]) -> list[Part]:
        out = []
        for p, root in roots.items():
            low, high = max(start.get(p, 0), root.start_offset), end.get(p, root.next_offset)
            for s in root.segments_from(low):
                if s.base_offset >= high:
                    break
                if s.end > low:
                    out.append(Part(f"{self.root}/topics/{self.topic}/{p}/{s.object}", p, s.base_offset, low, high))
        return out

    def read(self, part: Part) -> Iterator[pa.RecordBatch]:
        import pyarrow.dataset as ds

        names = [c.split(" ")[0] for c in SCHEMA.split(", ")]
        for batch in ds.dataset(part.path, format="parquet").to_batches(filter=(ds.field("delta") >= part.low - part.base) & (ds.field("delta") < part.high - part.base)):
            x = batch.to_pydict()
            seq = [-1 if f < 0 else (f + d) % SEQUENCE_RANGE for f, d in zip(x["first_sequence"], x["delta"])]
            cols = [[part.partition] * len(seq), [part.base + d for d in x["delta"]], x["timestamp_ms"], x["key"], x["value"], x["producer_id"], seq]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=names)


class _Batch(_Reader, DataSourceReader):
    def partitions(self):
        return self.parts({}, {}, self.roots()) or [Part("", 0, 0, 0, 0)]

    def read(self, part: Part):
        return super().read(part) if part.path else iter(())


class _Stream(_Reader, DataSourceStreamReader):
    def initialOffset(self) -> dict:
        return {str(p): (r.next_offset if self.start_at == "latest" else r.start_offset) for p, r in self.roots().items()}

    def latestOffset(self) -> dict:
        return {str(p): r.next_offset for p, r in self.roots().items()}

    def partitions(self, start: dict, end: dict):
        return self.parts({int(k): v for k, v in start.items()}, {int(k): v for k, v in end.items()}, self.roots())

    def commit(self, end: dict) -> None:
        json.dumps(end)


class TidelogSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "tidelog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return _Batch(self.options)

    def streamReader(self, schema):
        return _Stream(self.options)
