import time

from pyspark.sql import functions as F

from tidelog.operators.groups import Group, replay
from tidelog.operators.producers import fold
from tidelog.sources.log import EventLog
from tidelog.sources.stream import TidelogSource
from tidelog.streaming.sink import LogSink
from tidelog.streaming.stateful import STATE_STORE, dedup_stream, group_from_json, group_stream, group_to_json, windowed_counts


def test_sink_is_exactly_once(spark, tmp_path):
    log = EventLog(spark, str(tmp_path / "log"))
    log.create_topic("t")
    sink = LogSink(log, "t", 0, log.allocate_producer_id(), ["id"])
    batch = spark.range(3).selectExpr("id", "id as timestamp_ms", "cast(cast(id as string) as binary) as value")
    sink(batch, 0)
    sink(batch, 0)
    sink(batch.where("id > 5"), 1)
    sink(batch.where("id = 1"), 2)
    assert [bytes(r.value) for r in log.fetch("t", 0, 0).orderBy("offset").collect()] == [b"0", b"1", b"2", b"1"]


def test_large_micro_batches_are_cut_and_go_on_where_they_stopped(spark, tmp_path, monkeypatch):
    from tidelog.sources import requests

    monkeypatch.setattr(requests, "REQUEST_BYTES", 300)
    log = EventLog(spark, str(tmp_path / "log"))
    log.create_topic("t")
    sink = LogSink(log, "t", 0, log.allocate_producer_id(), ["id"])
    batch = spark.range(40).selectExpr("id", "id as timestamp_ms", "cast(format_string('%02d', id) as binary) as value")
    append, calls = log.append_batches, []

    def failing(*a):
        calls.append(a)
        if len(calls) == 8:
            raise RuntimeError("the driver is lost")
        return append(*a)

    log.append_batches = failing
    try:
        sink(batch, 0)
    except RuntimeError:
        pass
    sink(batch, 0)
    sink(batch, 0)
    sink(batch.where("id < 2"), 1)
    assert [bytes(r.value).decode() for r in log.fetch("t", 0, 0).orderBy("offset").collect()] == [f"{i:02d}" for i in [*range(40), 0, 1]]
    assert len(log.root_of("t", 0).segments) > 8


def test_source_goes_on_where_it_left_off(spark, tmp_path):
    spark.dataSource.register(TidelogSource)
    root = str(tmp_path / "log")
    log = EventLog(spark, root)
    log.create_topic("t", 2)
    rows = lambda *v: [{"timestamp_ms": 1, "value": x.encode()} for x in v]
    log.append("t", 0, rows("a", "b"))
    log.append("t", 1, rows("c"))
    batch = spark.read.format("tidelog").option("root", root).option("topic", "t").load()
    assert sorted((r.partition, r.offset, bytes(r.value)) for r in batch.collect()) == [(0, 0, b"a"), (0, 1, b"b"), (1, 0, b"c")]

    def run():
        q = spark.readStream.format("tidelog").option("root", root).option("topic", "t").load()
        out = q.writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).trigger(availableNow=True).start()
        out.awaitTermination(120)
        return sorted((r.partition, r.offset) for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == [(0, 0), (0, 1), (1, 0)]
    log.append("t", 0, rows("d"))
    assert run() == [(0, 0), (0, 1), (0, 2), (1, 0)]


def test_stream_fold_equals_the_batch_fold(spark, tmp_path):
    spark.conf.set(*STATE_STORE)
    rows = [(p, a, a // 6, a % 6 if a % 5 else max(0, a % 6 - 1), 1, "f") for p in range(3) for a in range(18)]
    ddl = "producer_id long, arrival long, epoch int, sequence long, record_count long, fingerprint string"
    df = spark.createDataFrame(rows, ddl)
    for lo in (0, 9):  # two files, so two micro-batches
        df.where(F.col("arrival").between(lo, lo + 8)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = dedup_stream(stream).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).option("path", str(tmp_path / "out")).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(180)
    got = {(r.producer_id, r.arrival): (r.verdict, r.original) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r.producer_id, r.arrival): (r.verdict, r.original) for r in fold(df).collect()}


def test_windows_leave_late_data_out(spark, tmp_path):
    rows = [("2024-01-01 01:00:00", "a"), ("2024-01-01 02:00:00", "a"), ("2024-01-03 00:00:00", "b")]
    df = spark.createDataFrame(rows, "t string, event_type string").selectExpr("cast(t as timestamp_ntz) as ts", "event_type")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = windowed_counts(spark.readStream.schema("ts timestamp_ntz, event_type string").parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("tidelog_windows").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.event_type, r.n) for r in spark.table("tidelog_windows").collect()] == [("a", 2)]


def test_group_state_survives_storing():
    g = Group()
    g.join("a", ("x", "y"), 5, 6, 1, new=True)
    g.sync("a", 1, {"a": b"\x00\xff"}, 2)
    assert group_from_json(group_to_json(g)) == g


def test_group_stream_equals_replay_and_ends_sessions(spark, tmp_path):
    spark.conf.set(*STATE_STORE)
    now = int(time.time() * 1000)
    kinds = [("enter", "a", 0), ("sync", "a", 1), ("heartbeat", "a", 1), ("enter", "b", 0), ("join", "a", 0), ("sync", "a", 2), ("commit", "b", 2)]
    ddl = "group string, n long, at_ms long, kind string, member string, generation long, protocols string, session_ms long, rebalance_ms long"
    df = spark.createDataFrame([("g", i, now + i, k, m, g, "range", 3000, 3000) for i, (k, m, g) in enumerate(kinds)], ddl)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = group_stream(spark.readStream.schema(ddl).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("tidelog_groups").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="1 second").start()
    try:
        for _ in range(90):
            time.sleep(1)
            got = spark.table("tidelog_groups").collect()
            if any(r.kind == "tick" and r.state == "empty" for r in got):
                break
    finally:
        q.stop()
    calls = sorted((tuple(r) for r in got if r.n >= 0), key=lambda r: r[1])
    assert calls == sorted((tuple(r) for r in replay(df).collect()), key=lambda r: r[1])
    assert any(r.kind == "tick" and r.state == "empty" for r in got)
