"""Window forms of the greedy rules, against walks over random segments."""

import random

from pyspark.sql import functions as F

from tidelog.operators import records, retention
from tidelog.operators.producers import ProducerState, fold


def _segments(rnd, n, part):
    at, out = 0, []
    for _ in range(n):
        k = rnd.randint(1, 5)
        out.append((part, at, k, rnd.randint(1, 50), rnd.randint(0, 100)))
        at += k
    return out


def test_retention_and_bounds_equal_the_walks(spark):
    rnd = random.Random(5)
    parts = {p: _segments(rnd, rnd.randint(1, 12), p) for p in range(60)}
    seg = spark.createDataFrame([r for x in parts.values() for r in x], "part int, base_offset long, record_count long, byte_length long, at long")
    seg = seg.withColumn("received_at", F.timestamp_seconds("at"))
    got = {(r.part, r.base_offset): r.expired for r in retention.expired(seg, F.timestamp_seconds(F.lit(60)), 20, 90).collect()}
    for p, rows in parts.items():
        left, going = sum(r[3] for r in rows), True
        for r in rows:
            going = going and (r[4] + 20 <= 60 or left > 90)
            left -= r[3] if going else 0
            assert got[p, r[1]] == going
    for allow in (True, False):
        chosen = {}
        for r in records.bounded(seg, 3, 70, allow).collect():
            chosen.setdefault(r.part, []).append((r.base_offset, r.oversized_first_batch))
        for p, rows in parts.items():
            live, want, left = [r for r in rows if r[1] + r[2] - 1 >= 3], [], 70
            for r in live:
                if r[3] > left:
                    break
                want.append((r[1], False))
                left -= r[3]
            if not want and live and allow:
                want = [(live[0][1], True)]
            assert sorted(chosen.get(p, [])) == want


def test_age_boundary_to_the_second(spark):
    rows = [(0, 0, 2, 10, 1000), (0, 2, 3, 10, 2000), (0, 5, 1, 10, 500)]
    seg = spark.createDataFrame(rows, "part int, base_offset long, record_count long, byte_length long, at long").withColumn("received_at", F.timestamp_seconds("at"))
    start = lambda now: retention.report(retention.expired(seg, F.timestamp_seconds(F.lit(now)), 1000)).first().new_start
    assert [start(n) for n in (1999, 2000, 3000)] == [0, 2, 6]


def test_offsets_are_dense_whatever_the_buckets(spark):
    df = spark.range(500).selectExpr("id", "cast(id % 3 as int) as part", "id * 7 % 50 as t")
    for bucket in (F.col("t"), F.expr("t div 10"), F.lit(0)):
        rows = records.assign_offsets(df, ["part"], ["t", "id"], bucket).collect()
        for p in range(3):
            mine = sorted((r.off, r.t, r.id) for r in rows if r.part == p)
            assert [m[0] for m in mine] == list(range(len(mine)))
            assert [m[1:] for m in mine] == sorted(m[1:] for m in mine)


def test_fold_equals_the_machine_one_by_one(spark):
    rnd = random.Random(9)
    rows = [(p, a, rnd.randint(0, 2), rnd.randint(0, 6), rnd.randint(1, 2), rnd.choice("ab")) for p in range(40) for a in range(30)]
    got = {(r.producer_id, r.arrival): (r.verdict, r.original) for r in fold(spark.createDataFrame(rows, "producer_id long, arrival long, epoch int, sequence long, record_count long, fingerprint string")).collect()}
    states = {}
    for p, a, e, s, c, f in rows:
        state = states.setdefault(p, ProducerState(e))
        assert got[p, a] == state.accept(e, s, c, f, a)


def test_sequences_wrap():
    top = (1 << 31) - 1
    state = ProducerState(0, [(top - 3, 2, "x", 0)])
    assert state.accept(0, top - 1, 3, "y", 2)[0] == "APPENDED"
    assert state.accept(0, 1, 1, "z", 5)[0] == "APPENDED"
