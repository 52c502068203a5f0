"""Stateful operators on streams: the idempotent-producer machine, and windows with late data."""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import asdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.groups import REPLAYED, REPLAYED_NAMES, Group, Member, step
from ..operators.producers import FOLDED, ProducerState

#: Needed by transformWithState.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
_STATE = "epoch int, batches array<struct<sequence:bigint,count:bigint,fingerprint:string,tag:bigint>>"
_NAMES = [c.split()[0] for c in FOLDED.split(", ")]


class _Producers(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("producer", _STATE)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        found = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        kept = self.state.get() if self.state.exists() else None
        state = ProducerState(int(found["epoch"].iloc[0])) if kept is None else ProducerState(kept[0], [tuple(b) for b in kept[1]])
        out = []
        for r in found.itertuples(index=False):
            verdict, original = state.accept(int(r.epoch), int(r.sequence), int(r.record_count), r.fingerprint, int(r.arrival))
            out.append((key[0], r.arrival, r.epoch, r.sequence, r.record_count, r.fingerprint, verdict, original))
        self.state.update((state.epoch, [tuple(b) for b in state.batches]))
        yield pd.DataFrame(out, columns=_NAMES).astype({"original": "Int64"})

    def close(self) -> None:
        pass


def dedup_stream(arrivals: DataFrame) -> DataFrame:
    """producers.fold for a stream: verdicts against the state that earlier micro-batches left."""
    return arrivals.groupBy("producer_id").transformWithStateInPandas(_Producers(), outputStructType=FOLDED, outputMode="Append", timeMode="None")


def group_to_json(g: Group) -> str:
    return json.dumps(asdict(g), default=lambda b: {"hex": b.hex()})


def group_from_json(text: str) -> Group:
    x = json.loads(text, object_hook=lambda d: bytes.fromhex(d["hex"]) if d.keys() == {"hex"} else d)
    members = {n: Member(**(m | {"protocols": tuple(m["protocols"])})) for n, m in x.pop("members").items()}
    return Group(**x, members=members)


class _Groups(StatefulProcessor):
    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle, self.state = handle, handle.getValueState("group", "state string")

    def _load(self) -> Group:
        return group_from_json(self.state.get()[0]) if self.state.exists() else Group()

    def _keep(self, g: Group) -> None:
        """Stores the group and wakes up when its next session or phase ends."""
        self.state.update((group_to_json(g),))
        for at in list(self.handle.listTimers()):
            self.handle.deleteTimer(at)
        if g.members:
            phase = [g.phase_deadline] if g.state in ("joining", "awaiting") else []
            self.handle.registerTimer(min([m.deadline for m in g.members.values()] + phase))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        g = self._load()
        found = pd.concat(list(rows)).sort_values("n", kind="stable")
        out = [step(g, e) for e in found.itertuples(index=False)]
        self._keep(g)
        yield pd.DataFrame(out, columns=REPLAYED_NAMES)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        g, now = self._load(), timerValues.getCurrentProcessingTimeInMs()
        g.tick(now)
        self._keep(g)
        yield pd.DataFrame([(key[0], -1, now, "tick", None, "NONE", g.state, g.generation, len(g.members), g.leader)], columns=REPLAYED_NAMES)

    def close(self) -> None:
        pass


def group_stream(calls: DataFrame) -> DataFrame:
    """groups.replay for a stream of calls, with timers for sessions and phases that end without one.
    Calls carry wall-clock milliseconds, as the timers do."""
    return calls.groupBy("group").transformWithStateInPandas(_Groups(), outputStructType=REPLAYED, outputMode="Append", timeMode="ProcessingTime")


def windowed_counts(events: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Counts per window and event type; events later than the watermark are left out."""
    stamped = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", late)
    return stamped.groupBy(F.window("at", window).alias("w"), "event_type").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "event_type", "n")
