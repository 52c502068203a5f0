import json
import threading

import pytest

from tidelog import errors
from tidelog.__main__ import main
from tidelog.sources.log import Batch, EventLog
from tidelog.sources.store import HadoopStore, LocalStore, verify_store


@pytest.fixture
def log(spark, tmp_path):
    clock = [1000]
    made = EventLog(spark, str(tmp_path), now_ms=lambda: clock[0])
    made.clock = clock
    return made


def rows(*values):
    return [{"timestamp_ms": 1, "key": None, "value": v.encode()} for v in values]


def values(df):
    return [bytes(r.value).decode() for r in df.orderBy("offset").collect()]


def test_stores_put_only_if_absent(spark, tmp_path):
    for store in (LocalStore(str(tmp_path / "a")), HadoopStore(spark, f"file://{tmp_path}/b")):
        verify_store(store)
        for said in (b"1", b"", b"12"):
            store.put("again", said)
            assert store.get("again") == said
        assert not store.put_if_absent("again", b"x") and store.get("again") == b"12"
        assert store.names("nothing") == [] and store.get("nothing") is None


def test_topics_keep_their_first_partition_count(log):
    assert log.create_topic("b", 3) == 3 and log.create_topic("b", 5) == 3 and log.create_topic("a") == 1
    assert [tuple(r) for r in log.topics().collect()] == [("a", 1), ("b", 3)]
    assert log.describe().count() == 4
    for bad in ("", ".", "..", "x/y", "a" * 250):
        with pytest.raises(errors.InvalidName):
            log.create_topic(bad)
    with pytest.raises(errors.UnknownTopicOrPartition):
        log.append("a", 1, rows("x"))


def test_append_and_fetch(log):
    log.create_topic("t")
    r = log.append("t", 0, rows("a", "b"))
    assert (r.base_offset, r.last_offset, r.high_watermark) == (0, 1, 2)
    log.append("t", 0, [{"timestamp_ms": 5, "key": b"", "value": None, "headers": [("h", None)]}])
    assert log.offsets("t", 0) == (0, 3)
    got = log.fetch("t", 0, 1).orderBy("offset").collect()
    assert [(g.offset, g.base_offset) for g in got] == [(1, 0), (2, 2)]
    assert bytes(got[1].key) == b"" and got[1].value is None and got[0].key is None
    assert log.fetch("t", 0, 3).count() == 0
    for bad in (-1, 4):
        with pytest.raises(errors.OffsetOutOfRange):
            log.fetch("t", 0, bad)
    with pytest.raises(errors.UnsupportedRecord):
        log.append("t", 0, [{"value": b"x", "headers": [("h", None), ("h", None)]}])
    assert log.verify_segments("t", 0).where("ok").count() == 2


def test_bounded_fetch(log):
    log.create_topic("t")
    for v in ("a" * 40, "b" * 40, "c" * 40):
        log.append("t", 0, rows(v))
    one = log.root_of("t", 0).segments[0].byte_length
    f = log.fetch_bounded("t", 0, 0, 2 * one)
    assert f.records.count() == 2 and f.high_watermark == 3 and not f.oversized_first_batch
    f = log.fetch_bounded("t", 0, 1, 1)
    assert values(f.records) == ["b" * 40] and f.oversized_first_batch
    assert log.fetch_bounded("t", 0, 1, 1, False).records.count() == 0


def test_producers(log):
    log.create_topic("t")
    p = log.allocate_producer_id()
    assert log.allocate_producer_id() == p + 1
    send = lambda seq, *v, epoch=0: log.append("t", 0, rows(*v), producer_id=p, epoch=epoch, sequence=seq)
    assert send(0, "a", "b").base_offset == 0
    before = log.root_of("t", 0).revision
    again = send(0, "a", "b")
    assert again.duplicate and (again.base_offset, again.last_offset) == (0, 1) and log.root_of("t", 0).revision == before
    with pytest.raises(errors.ConflictingSequence):
        send(0, "a", "c")
    with pytest.raises(errors.OutOfOrderSequence):
        send(3, "d")
    assert send(2, "c").base_offset == 2
    assert send(0, "e", epoch=1).base_offset == 3
    with pytest.raises(errors.InvalidProducerEpoch):
        send(3, "z")
    # all or nothing
    with pytest.raises(errors.OutOfOrderSequence):
        log.append_batches("t", 0, [Batch(rows("f"), p, 1, 1), Batch(rows("g"), p, 1, 5)])
    assert log.offsets("t", 0) == (0, 4)
    got = log.append_batches("t", 0, [Batch(rows("e"), p, 1, 0), Batch(rows("f"), p, 1, 1)])
    assert [(g.base_offset, g.duplicate) for g in got] == [(3, True), (4, False)]
    assert [r.sequence for r in log.fetch("t", 0, 0).orderBy("offset").collect()] == [0, 1, 2, 0, 1]


def test_two_writers_at_once(log):
    log.create_topic("t")
    got = []
    threads = [threading.Thread(target=lambda v=v: got.append(log.append("t", 0, rows(v)).base_offset)) for v in "abcd"]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert sorted(got) == [0, 1, 2, 3] and sorted(values(log.fetch("t", 0, 0))) == list("abcd")


def test_pages_give_the_same_root(log, monkeypatch):
    from tidelog.sources import index

    monkeypatch.setattr(index, "FANOUT", 2)
    log.create_topic("t")
    p = log.allocate_producer_id()
    for i in range(5):
        log.append("t", 0, rows(f"v{i}"), producer_id=p + 5 * i, epoch=0, sequence=0)
    assert log.store.names("topics/t/0/index")
    fresh = EventLog(log.spark, log.root)
    assert values(fresh.fetch("t", 0, 2)) == ["v2", "v3", "v4"]
    assert fresh.append("t", 0, rows("v1"), producer_id=p + 5, epoch=0, sequence=0).duplicate
    fresh.maintain("t", 0, max_bytes=1, apply=True)
    assert fresh.offsets("t", 0) == (5, 5) and fresh.append("t", 0, rows("v1"), producer_id=p + 5, epoch=0, sequence=0).duplicate


def test_maintenance(log):
    log.create_topic("t")
    for at, v in ((1000, "a"), (2000, "b"), (3000, "c")):
        log.clock[0] = at
        log.append("t", 0, rows(v))
    log.store.put_if_absent("topics/t/0/segments/0c0c0c0c-0000-0000-0000-00000000aaaa.parquet", b"lost")
    log.store.put_if_absent("topics/t/0/segments/notes.txt", b"keep")
    size = log.root_of("t", 0).segments[0].byte_length
    seen = log.maintain("t", 0, 1000, now_ms=1999)
    assert (seen["expired_batches"], seen["orphan_objects"], seen["published"]) == (0, 1, False)
    seen = log.maintain("t", 0, 1000, size, now_ms=2000)
    assert (seen["expired_batches"], seen["new_start_offset"], seen["retained_bytes"]) == (2, 2, size)
    assert log.offsets("t", 0) == (0, 3)
    done = log.maintain("t", 0, 1000, size, apply=True, now_ms=2000)
    assert done["published"] and done["deleted_objects"] == 3
    assert log.offsets("t", 0) == (2, 3) and values(log.fetch("t", 0, 2)) == ["c"]
    assert log.store.get("topics/t/0/segments/notes.txt") == b"keep"
    assert log.maintain("t", 0, apply=True)["deleted_objects"] == 0
    log.maintain("t", 0, max_bytes=0, apply=True)
    assert log.offsets("t", 0) == (3, 3) and log.append("t", 0, rows("d")).base_offset == 3


def test_group_offsets(log):
    log.create_topic("t", 2)
    log.commit_offsets("g", {("t", 0): (5, None)})
    log.commit_offsets("g", {("t", 0): (7, ""), ("t", 1): (1, "m")})
    assert [tuple(r) for r in log.committed_offsets("g").collect()] == [("t", 0, 7, ""), ("t", 1, 1, "m")]
    assert [tuple(r) for r in log.committed_offsets("g", [("t", 1), ("u", 0)]).collect()] == [("t", 1, 1, "m"), ("u", 0, -1, None)]
    with pytest.raises(errors.UnknownTopicOrPartition):
        log.commit_offsets("g", {("t", 2): (1, None)})


def test_command_line(log, capsys):
    log.create_topic("t")
    log.append("t", 0, rows("a"))
    assert main(["offsets", log.root, "t", "0"]) == 0 and json.loads(capsys.readouterr().out)["latest"] == 1
    assert main(["verify-store", log.root]) == 0
    assert main(["maintain", log.root, "t", "7"]) == 1


def test_fetch_many_shares_one_budget(log):
    log.create_topic("t", 2)
    for p in (0, 1):
        for v in ("a" * 40, "b" * 40):
            log.append("t", p, rows(v))
    one = log.root_of("t", 0).segments[0].byte_length
    counts = lambda got: [type(g).__name__ if isinstance(g, errors.LogError) else (g.records.count(), g.oversized_first_batch) for g in got]
    asked = [("t", 0, 2), ("t", 0, 1), ("u", 0, 0), ("t", 1, 0)]
    assert counts(log.fetch_many(asked, 3 * one)) == [(0, False), (1, False), "UnknownTopicOrPartition", (2, False)]
    assert counts(log.fetch_many(asked, 1)) == [(0, False), (1, True), "UnknownTopicOrPartition", (0, False)]


def test_batch_files_in_and_out(log, tmp_path):
    from tidelog.functions.codec import decode_batches, encode_batch
    from tidelog.sources.importer import export_batch, import_batches

    folder = tmp_path / "files"
    folder.mkdir()
    made = [{"timestamp_ms": i, "key": None if i % 2 else b"k", "value": f"v{i}".encode(), "headers": [("h", b"x")] if i == 2 else []} for i in range(5)]
    (folder / "b").write_bytes(encode_batch(made[3:], 13))
    (folder / "a").write_bytes(encode_batch(made[:2], 10) + encode_batch(made[2:3], 12))
    log.create_topic("t")
    assert [r.last_offset for r in import_batches(log, "t", 0, str(folder))] == [4]
    assert values(log.fetch("t", 0, 0)) == [f"v{i}" for i in range(5)]
    got = decode_batches(export_batch(log, "t", 0, 1))
    assert [{k: g[k] for k in made[0]} for g in got] == made[1:] and got[0]["offset"] == 1 and export_batch(log, "t", 0, 5) == b""
    (folder / "c").write_bytes(b"junk")
    with pytest.raises(errors.LogError) as e:
        import_batches(log, "t", 0, str(folder))
    assert e.value.code == "CORRUPT_MESSAGE" and log.offsets("t", 0) == (0, 5)


def test_produce_and_lookups(log):
    log.create_topic("t")
    assert [r.last_offset for r in log.produce("t", 0, [Batch(rows("a")), Batch(rows("b"))], acks=1)] == [1]
    assert log.produce("t", 0, [Batch(rows("c"))], acks=0) is None and log.offsets("t", 0) == (0, 3)
    p, epoch = log.init_producer()
    assert (epoch, log.init_producer(producer_id=p, epoch=0)) == (0, (p + 1, 0))
    got = log.produce("t", 0, [Batch(rows("d"), p, 0, 0), Batch(rows("e"), p, 0, 1)])
    assert [r.base_offset for r in got] == [3, 4] and len(log.root_of("t", 0).segments) == 4
    for bad in (lambda: log.produce("t", 0, [Batch(rows("x"), p, 0, 2)], acks=1), lambda: log.produce("t", 0, [Batch(rows("x"))], acks=2), lambda: log.init_producer(producer_id=4), lambda: log.list_offset("t", 0, 1777000000000)):
        with pytest.raises(errors.InvalidRequest):
            bad()
    assert (log.list_offset("t", 0, -2), log.list_offset("t", 0, -1)) == (0, 5)


@pytest.mark.parametrize("expires", [False, True])
def test_collection_does_not_take_what_an_append_publishes(spark, log, expires):
    """Between an append's write and its commit all is collected that no revision names."""
    log.create_topic("t")
    log.append("t", 0, rows("old"))
    other = EventLog(spark, log.root, now_ms=lambda: 10_000)
    write, done = log._write, []

    def slow(folder, df):
        name = write(folder, df)
        if not done:
            done.append(other.maintain("t", 0, max_bytes=0 if expires else None, apply=True))
        return name

    log._write = slow
    r = log.append("t", 0, rows("new"))
    assert done[0]["published"] and done[0]["deleted_objects"] == 1 + expires and done[0]["expired_batches"] == expires
    assert r.base_offset == 1 and values(log.fetch("t", 0, 1, verify=True)) == ["new"]
    assert other.maintain("t", 0)["orphan_objects"] == 0


def test_reads_start_again_if_their_segments_are_collected(spark, log):
    log.create_topic("t")
    for v in "abc":
        log.append("t", 0, rows(v))
    size = log.root_of("t", 0).segments[0].byte_length
    scan, done = log._scan, []

    def slow(folder, segments, offset):
        if not done:
            done.append(EventLog(spark, log.root).maintain("t", 0, max_bytes=size, apply=True))
        return scan(folder, segments, offset)

    log._scan = slow
    with pytest.raises(errors.OffsetOutOfRange):
        log.fetch("t", 0, 0)
    done.clear()
    log.append("t", 0, rows("d"))
    assert log.offsets("t", 0) == (2, 4) and values(log.fetch("t", 0, 3)) == ["d"]
    gone = log.root_of("t", 0).segments[-1].object
    log.store.delete(f"topics/t/0/{gone}")
    with pytest.raises(errors.CorruptMessage):
        log.fetch("t", 0, 3)


def test_reads_hold_content_against_its_digest(spark, log):
    log.create_topic("t")
    log.append("t", 0, rows("a"))
    log.append("t", 0, rows("b"))
    first, second = (f"topics/t/0/{s.object}" for s in log.root_of("t", 0).segments)
    assert values(log.fetch("t", 0, 0, verify=True)) == ["a", "b"]
    import shutil

    log.store.delete(second)
    shutil.copytree(f"{log.root}/{first}", f"{log.root}/{second}")
    with pytest.raises(errors.CorruptMessage):
        log.fetch("t", 0, 0, verify=True)
    assert values(log.fetch("t", 0, 0)) == ["a", "a"]


def test_what_is_stored_is_what_was_measured(spark, log):
    log.create_topic("t")
    df = spark.range(20).selectExpr("cast(cast(rand() as string) as binary) as value")
    assert log.append("t", 0, df).last_offset == 19
    assert log.verify_segments("t", 0).where("ok").count() == 1


def test_conditional_puts_are_refused_where_they_are_not_known(spark, tmp_path):
    from tidelog.sources.store import S3Store

    with pytest.raises(Exception, match="conditional"):
        S3Store(spark, f"file://{tmp_path}").put_if_absent("a", b"x")


def test_imports_keep_within_the_limits(log, tmp_path, monkeypatch):
    from tidelog.functions.codec import encode_batch
    from tidelog.sources import importer, requests

    made = [{"timestamp_ms": i, "key": None, "value": bytes([65 + i]) * 500, "headers": []} for i in range(12)]
    (tmp_path / "files").mkdir()
    (tmp_path / "files" / "a").write_bytes(encode_batch(made, 1000))
    monkeypatch.setattr(requests, "REQUEST_BYTES", 1500)
    monkeypatch.setattr(requests.limits, "REQUEST_RECORDS", 5)
    log.create_topic("t")
    got = importer.import_batches(log, "t", 0, str(tmp_path / "files"))
    assert got[-1].last_offset == 11 and len(got) >= 4
    assert [v[0] for v in values(log.fetch("t", 0, 0))] == [chr(65 + i) for i in range(12)]
