"""Named queries over the log view of the tables, each with SQL that gives the same rows.

The log view: events are records of four partitions (user_id % 4), ordered by time and id, with
dense offsets; each 50 records are a segment.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec
from ..functions import scalars as S
from ..operators import groups, producers, records, retention

QUERIES = {}
ORACLES = {}
NOW = "2024-01-20 00:00:00"
AGE_S = 5 * 86_400
KEEP_BYTES = 20_000


def query(oracle: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if oracle:
            ORACLES[fn.__name__] = oracle
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def rec(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events").withColumn("part", (F.col("user_id") % 4).cast("int"))
    return records.assign_offsets(events, ["part"], ["ts", "event_id"], F.to_date("ts"))


def seg(spark: SparkSession, sf_dir: str) -> DataFrame:
    return records.segments(rec(spark, sf_dir))


REC = """rec AS (SELECT *, CAST(user_id % 4 AS INTEGER) AS part,
  row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS off FROM events)"""
SEG = f"""{REC}, seg AS (SELECT part, off // 50 AS seg, min(off) AS base_offset, count(*) AS record_count,
  CAST(61 + sum(7 + octet_length(encode(props))) AS BIGINT) AS byte_length, max(ts) AS received_at FROM rec GROUP BY 1, 2)"""
RUN = f"""{SEG}, run AS (SELECT *, sum(byte_length) OVER w AS running, row_number() OVER w AS nth FROM seg
  WHERE base_offset + record_count - 1 >= 120 WINDOW w AS (PARTITION BY part ORDER BY base_offset))"""


@query(f"WITH {REC} SELECT event_id, part, off FROM rec")
def log_assign_offsets(spark, sf_dir):
    return rec(spark, sf_dir).select("event_id", "part", "off")


@query(f"""WITH {SEG}, n AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY base_offset) AS rn, count(*) OVER (PARTITION BY part) AS n FROM seg)
SELECT part, seg, base_offset, record_count, byte_length, received_at, (rn - 1) // 64 AS page, rn <= ((n - 1) // 64) * 64 AS sealed FROM n""")
def log_segments(spark, sf_dir):
    return records.paged(seg(spark, sf_dir))


@query(f"""WITH {SEG}, n AS (SELECT *, (row_number() OVER (PARTITION BY part ORDER BY base_offset) - 1) // 16 AS page FROM seg)
SELECT part, page, min(base_offset) AS first_offset, max(base_offset + record_count) AS next_offset, count(*) AS n_segments, CAST(sum(byte_length) AS BIGINT) AS bytes FROM n GROUP BY part, page""")
def log_page_rollup(spark, sf_dir):
    pages = records.paged(seg(spark, sf_dir), 16)
    return pages.groupBy("part", "page").agg(F.min("base_offset").alias("first_offset"), F.max(F.col("base_offset") + F.col("record_count")).alias("next_offset"), F.count("*").alias("n_segments"), F.sum("byte_length").alias("bytes"))


@query(f"WITH {SEG} SELECT part, min(base_offset) AS earliest, max(base_offset + record_count) AS latest FROM seg GROUP BY part")
def log_offset_ranges(spark, sf_dir):
    return records.offset_ranges(seg(spark, sf_dir))


@query(f"WITH {REC} SELECT part, off, event_id, user_id, event_type, props FROM rec WHERE off >= 100")
def log_fetch_from_offset(spark, sf_dir):
    return rec(spark, sf_dir).where("off >= 100").select("part", "off", "event_id", "user_id", "event_type", "props")


@query(f"""WITH {RUN}, hw AS (SELECT part, max(off) + 1 AS high_watermark FROM rec GROUP BY part)
SELECT rec.part, rec.off, rec.event_id, run.base_offset, nth = 1 AND byte_length > 8192 AS oversized_first_batch, high_watermark
FROM run JOIN rec ON rec.part = run.part AND rec.off // 50 = run.seg JOIN hw ON hw.part = rec.part
WHERE (running <= 8192 OR nth = 1) AND off >= 120""")
def log_fetch_bounded(spark, sf_dir):
    r = rec(spark, sf_dir)
    s = records.segments(r)
    marks = records.offset_ranges(s).select("part", F.col("latest").alias("high_watermark"))
    chosen = records.bounded(s, 120, 8192, True).select("part", "seg", "base_offset", "oversized_first_batch")
    return records.records_of(r, chosen, 120).join(marks, "part").select("part", "off", "event_id", "base_offset", "oversized_first_batch", "high_watermark")


@query(f"""WITH {RUN} SELECT part, allowed, count(nth) FILTER (running <= 1 OR nth = 1 AND allowed) AS n_batches,
  bool_or(nth = 1 AND allowed AND byte_length > 1) AS oversized FROM run, (VALUES (true), (false)) AS a(allowed) GROUP BY part, allowed""")
def log_fetch_oversized(spark, sf_dir):
    s = seg(spark, sf_dir)
    parts = s.select("part").distinct()
    out = None
    for allowed in (True, False):
        got = records.bounded(s, 120, 1, allowed).groupBy("part").agg(F.count("*").alias("n_batches"), F.bool_or("oversized_first_batch").alias("oversized"))
        one = parts.join(got, "part", "left").select("part", F.lit(allowed).alias("allowed"), F.coalesce("n_batches", F.lit(0).cast("long")).alias("n_batches"), F.coalesce("oversized", F.lit(False)).alias("oversized"))
        out = one if out is None else out.union(one)
    return out


@query(f"""WITH RECURSIVE {RUN}, fold AS (
  SELECT -1 AS part, CAST(9000 AS BIGINT) AS budget, false AS any_yet, CAST(0 AS BIGINT) AS n_batches, CAST(0 AS BIGINT) AS bytes, false AS oversized
  UNION ALL
  SELECT f.part + 1, greatest(0, f.budget - t.bytes), f.any_yet OR t.n > 0, t.n, t.bytes, t.over FROM fold f, LATERAL (
    SELECT count(*) AS n, CAST(coalesce(sum(byte_length), 0) AS BIGINT) AS bytes, coalesce(bool_or(running > f.budget), false) AS over
    FROM run WHERE run.part = f.part + 1 AND (running <= f.budget OR nth = 1 AND NOT f.any_yet)) t WHERE f.part < 3)
SELECT CAST(part AS INTEGER) AS part, n_batches, bytes, oversized FROM fold WHERE part >= 0 AND part IN (SELECT part FROM run)""")
def log_fetch_multi_partition(spark, sf_dir):
    return records.shared_budget(seg(spark, sf_dir), 120, 9000)


@query(f"""WITH {SEG} SELECT rec.part, rec.off, seg.base_offset, seg.record_count FROM rec JOIN seg ON rec.part = seg.part
  AND rec.off BETWEEN seg.base_offset AND seg.base_offset + seg.record_count - 1""")
def log_locate_offset(spark, sf_dir):
    r = rec(spark, sf_dir)
    return records.locate(r.select("part", "off"), records.segments(r).select("part", "base_offset", "record_count")).select("part", "off", "base_offset", "record_count")


@query(f"""WITH {SEG}, v AS (SELECT 'whole' AS variant, * FROM seg UNION ALL SELECT 'holes', * FROM seg WHERE seg % 7 <> 3),
e AS (SELECT *, lag(base_offset + record_count) OVER (PARTITION BY variant, part ORDER BY base_offset) AS expected FROM v)
SELECT variant, part, base_offset, expected FROM e WHERE expected <> base_offset""")
def log_contiguity_check(spark, sf_dir):
    s = seg(spark, sf_dir)
    whole = records.contiguity_violations(s).select(F.lit("whole").alias("variant"), "*")
    return whole.union(records.contiguity_violations(s.where("seg % 7 <> 3")).select(F.lit("holes").alias("variant"), "*"))


@query(f"""WITH {SEG}, r AS (SELECT part, min(base_offset) AS earliest, max(base_offset + record_count) AS latest FROM seg GROUP BY part),
q AS (SELECT part, unnest([-1, 0, 100, latest - 1, latest, latest + 1]) AS off, earliest, latest FROM r)
SELECT part, off, CASE WHEN off < earliest OR off > latest THEN 'OFFSET_OUT_OF_RANGE' WHEN off = latest THEN 'AT_END' ELSE 'IN_RANGE' END AS status FROM q""")
def log_offset_status(spark, sf_dir):
    ranges = records.offset_ranges(seg(spark, sf_dir))
    asked = ranges.select("part", F.explode(F.expr("array(-1L, 0L, 100L, latest - 1, latest, latest + 1)")).alias("off"))
    return records.offset_status(asked, ranges)


@query(f"""WITH {REC} SELECT part, min(epoch_us(ts) // 1000) AS min_ms, max(epoch_us(ts) // 1000) AS max_ms, max(epoch_us(ts) // 1000) - min(epoch_us(ts) // 1000) AS span_ms, count(*) AS n FROM rec GROUP BY part""")
def log_timestamp_span(spark, sf_dir):
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    out = rec(spark, sf_dir).groupBy("part").agg(F.min(ms).alias("min_ms"), F.max(ms).alias("max_ms"), F.count("*").alias("n"))
    return out.select("part", "min_ms", "max_ms", S.timestamp_span(F.col("min_ms"), F.col("max_ms")).alias("span_ms"), "n")


def _retention_oracle(old: str, large: str) -> str:
    return f"""WITH {SEG}, m AS (SELECT *, ({old}) OR ({large}) AS gone_alone FROM
  (SELECT *, sum(byte_length) OVER (PARTITION BY part ORDER BY base_offset ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS left_bytes FROM seg)),
x AS (SELECT *, bool_and(gone_alone) OVER (PARTITION BY part ORDER BY base_offset ROWS UNBOUNDED PRECEDING) AS expired FROM m)
SELECT part, count(*) FILTER (expired) AS expired_batches, CAST(coalesce(sum(byte_length) FILTER (expired), 0) AS BIGINT) AS expired_bytes,
  count(*) FILTER (NOT expired) AS retained_batches, CAST(coalesce(sum(byte_length) FILTER (NOT expired), 0) AS BIGINT) AS retained_bytes,
  min(base_offset) AS old_start, coalesce(min(base_offset) FILTER (NOT expired), max(base_offset + record_count)) AS new_start,
  max(base_offset + record_count) AS next_offset FROM x GROUP BY part"""


_OLD, _LARGE = f"received_at + INTERVAL {AGE_S} SECOND <= TIMESTAMP '{NOW}'", f"left_bytes > {KEEP_BYTES}"


def _now():
    return F.lit(NOW).cast("timestamp_ntz")


@query(_retention_oracle(_OLD, "false"))
def retention_by_age(spark, sf_dir):
    return retention.report(retention.expired(seg(spark, sf_dir), _now(), AGE_S))


@query(_retention_oracle("false", _LARGE))
def retention_by_bytes(spark, sf_dir):
    return retention.report(retention.expired(seg(spark, sf_dir), _now(), None, KEEP_BYTES))


@query(_retention_oracle(_OLD, _LARGE))
def retention_combined(spark, sf_dir):
    return retention.report(retention.expired(seg(spark, sf_dir), _now(), AGE_S, KEEP_BYTES))


@query(f"""WITH per AS ({_retention_oracle(_OLD, _LARGE)})
SELECT count(*) AS partitions, CAST(sum(expired_batches) AS BIGINT) AS expired_batches, CAST(sum(expired_bytes) AS BIGINT) AS expired_bytes,
  CAST(sum(retained_batches) AS BIGINT) AS retained_batches, CAST(sum(retained_bytes) AS BIGINT) AS retained_bytes,
  count(*) FILTER (new_start > old_start) AS partitions_moved, CAST(sum(new_start - old_start) AS BIGINT) AS records_expired FROM per""")
def retention_report(spark, sf_dir):
    per = retention_combined(spark, sf_dir)
    sums = [F.sum(c).alias(c) for c in ("expired_batches", "expired_bytes", "retained_batches", "retained_bytes")]
    return per.agg(F.count("*").alias("partitions"), *sums, F.count_if(F.col("new_start") > F.col("old_start")).alias("partitions_moved"), F.sum(F.col("new_start") - F.col("old_start")).alias("records_expired"))


def _uuid(of: str) -> str:
    h = f"md5({of})"
    return f"concat(substr({h}, 1, 8), '-', substr({h}, 9, 4), '-', substr({h}, 13, 4), '-', substr({h}, 17, 4), '-', substr({h}, 21, 12))"


_NAME = f"concat('segments/', {_uuid("concat(part, '/', seg)")}, '.parquet')"
_LOST = f"concat('segments/', {_uuid("concat('lost/', part, '/', seg)")}, '.parquet')"


@query(f"""WITH {SEG}, live AS (SELECT {_NAME} AS object FROM seg),
inventory AS (SELECT object, 100 AS bytes FROM live UNION ALL SELECT {_LOST}, byte_length FROM seg WHERE seg % 10 = 0
  UNION ALL SELECT concat('segments/notes-', part, '.txt'), 1 FROM seg WHERE seg = 0 UNION ALL SELECT concat('segments/deep/', {_NAME}), 1 FROM seg WHERE seg = 0)
SELECT object, bytes FROM inventory WHERE regexp_matches(object, '{retention.RECOGNISED}') AND object NOT IN (SELECT object FROM live)""")
def gc_orphans(spark, sf_dir):
    s = seg(spark, sf_dir)
    # what each segment stands for in the listing, in one pass over them
    entry = "named_struct('object', {0}, 'bytes', cast({1} as bigint))".format
    rare = f"if(seg % 10 = 0, array({entry(_LOST, 'byte_length')}), array())"
    strange = "concat('segments/notes-', part, '.txt')", f"concat('segments/deep/', {_NAME})"
    first = f"if(seg = 0, array({entry(strange[0], 1)}, {entry(strange[1], 1)}), array())"
    inventory = s.selectExpr(f"inline(concat(array({entry(_NAME, 100)}), {rare}, {first}))")
    live = s.selectExpr(f"{_NAME} as object")
    return retention.orphans(inventory, live)


_EDGES = """
  leaf AS (SELECT part, concat('l0-', part, '-', seg {div} 4) AS parent, concat('s-', part, '-', seg) AS child, seg {div} 4 AS page FROM seg),
  l1 AS (SELECT DISTINCT part, concat('l1-', part, '-', page {div} 4) AS parent, parent AS child, page {div} 4 AS page FROM leaf),
  root AS (SELECT DISTINCT part, concat('root-', part) AS parent, parent AS child FROM l1),
  edge AS (SELECT parent, child FROM leaf UNION ALL SELECT parent, child FROM l1 UNION ALL SELECT parent, child FROM root)"""


@query(f"""WITH RECURSIVE {SEG}, {_EDGES.format(div="//")}, tree AS (
  SELECT concat('root-', part) AS node, 0 AS depth FROM (SELECT DISTINCT part FROM seg WHERE part < 2)
  UNION ALL SELECT child, depth + 1 FROM tree JOIN edge ON parent = node) SELECT node, CAST(depth AS INTEGER) AS depth FROM tree""")
def gc_live_trace(spark, sf_dir):
    """What is reachable from the roots of two partitions."""
    s = seg(spark, sf_dir)
    leaf = s.selectExpr("part", "concat('l0-', part, '-', seg div 4) as parent", "concat('s-', part, '-', seg) as child", "seg div 4 as page")
    l1 = leaf.selectExpr("part", "concat('l1-', part, '-', page div 4) as parent", "parent as child").distinct()
    root = l1.selectExpr("part", "concat('root-', part) as parent", "parent as child").distinct()
    edges = leaf.select("parent", "child").union(l1.select("parent", "child")).union(root.select("parent", "child"))
    roots = table(spark, sf_dir, "events").selectExpr("user_id % 4 as part").where("part < 2").selectExpr("concat('root-', part) as node")
    return retention.reachable(edges, roots)


# Producers: each user sends one-record batches in order; every fourth batch is sent again after up to eight others.
def _arrivals(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "events")
    mine = Window.partitionBy("user_id").orderBy("ts", "event_id")
    sent = e.select(F.col("user_id").alias("producer_id"), (F.row_number().over(mine) - 1).cast("long").alias("sequence"), "event_id", "props")
    sent = sent.withColumn("last", F.max("sequence").over(Window.partitionBy("producer_id")))
    first = sent.withColumn("arrival", F.col("sequence") * 10).withColumn("resent", F.lit(False))
    again = sent.where("event_id % 4 = 0").withColumn("arrival", F.expr("least(last, sequence + event_id % 9) * 10 + 1 + event_id % 9")).withColumn("resent", F.lit(True))
    # resends of one producer may fall on one arrival: the later sequence comes later
    both = first.unionByName(again)
    order = Window.partitionBy("producer_id").orderBy("arrival", "sequence")
    return both.withColumn("arrival", F.row_number().over(order).cast("long")).withColumns({"epoch": F.lit(0), "record_count": F.lit(1).cast("long"), "fingerprint": F.sha2("props", 256)})


_ARRIVALS = """sent AS (SELECT user_id AS producer_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence, event_id, props FROM events),
tail AS (SELECT *, max(sequence) OVER (PARTITION BY producer_id) AS last FROM sent),
both_ AS (SELECT *, sequence * 10 AS sent_at, false AS resent FROM tail UNION ALL
  SELECT *, least(last, sequence + event_id % 9) * 10 + 1 + event_id % 9, true FROM tail WHERE event_id % 4 = 0),
arr AS (SELECT *, row_number() OVER (PARTITION BY producer_id ORDER BY sent_at, sequence) AS arrival FROM both_),
judged AS (SELECT *, max(sequence) FILTER (NOT resent) OVER (PARTITION BY producer_id ORDER BY arrival) AS latest FROM arr),
verdicts AS (SELECT *, CASE WHEN NOT resent THEN 'APPENDED' WHEN latest - sequence < 5 THEN 'DUPLICATE' ELSE 'OUT_OF_ORDER_SEQUENCE_NUMBER' END AS verdict FROM judged)"""


@query(f"WITH {_ARRIVALS} SELECT producer_id, arrival, sequence, verdict FROM verdicts")
def producer_dedup(spark, sf_dir):
    return producers.fold(_arrivals(spark, sf_dir)).select("producer_id", "arrival", "sequence", "verdict")


@query(f"""WITH {_ARRIVALS}, placed AS (SELECT producer_id, sequence, row_number() OVER (PARTITION BY producer_id % 4 ORDER BY arrival, producer_id) - 1 AS off FROM verdicts WHERE verdict = 'APPENDED')
SELECT v.producer_id, v.arrival, v.verdict, off AS base_offset FROM verdicts v JOIN placed p ON v.producer_id = p.producer_id AND v.sequence = p.sequence WHERE verdict <> 'OUT_OF_ORDER_SEQUENCE_NUMBER'""")
def producer_dedup_offsets(spark, sf_dir):
    """New offsets of what is accepted; duplicates are answered with those of the first."""
    judged = producers.fold(_arrivals(spark, sf_dir))
    accepted = judged.where("verdict = 'APPENDED'").withColumn("part", F.pmod("producer_id", F.lit(4)))
    placed = records.assign_offsets(accepted, ["part"], ["arrival", "producer_id"], F.expr("arrival div 64"), "base_offset")
    placed = placed.select("producer_id", F.col("arrival").alias("original"), "base_offset")
    return judged.where("original is not null").join(placed, ["producer_id", "original"]).select("producer_id", "arrival", "verdict", "base_offset")


_EPOCHS = """src AS (SELECT user_id AS producer_id, CAST(day(ts) // 10 AS INTEGER) AS epoch, ts, event_id FROM events),
b AS (SELECT *, row_number() OVER (PARTITION BY producer_id, epoch ORDER BY ts, event_id) - 1 AS sequence, row_number() OVER (PARTITION BY producer_id ORDER BY ts, event_id) AS nth,
  count(*) OVER (PARTITION BY producer_id) AS n, max(epoch) OVER (PARTITION BY producer_id) AS newest FROM src)"""


@query(f"""WITH {_EPOCHS} SELECT producer_id, nth AS arrival, epoch, sequence, 'APPENDED' AS verdict FROM b
UNION ALL SELECT producer_id, n + nth, epoch, sequence, 'INVALID_PRODUCER_EPOCH' FROM b WHERE epoch < newest AND event_id % 5 = 0""")
def producer_epoch_fence(spark, sf_dir):
    """Ten-day epochs; some batches of older epochs are sent again at the end and are fenced off."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("producer_id"), F.expr("cast(day(ts) div 10 as int)").alias("epoch"), "ts", "event_id")
    mine = Window.partitionBy("producer_id")
    b = e.withColumn("sequence", (F.row_number().over(Window.partitionBy("producer_id", "epoch").orderBy("ts", "event_id")) - 1).cast("long"))
    b = b.withColumn("arrival", F.row_number().over(mine.orderBy("ts", "event_id")).cast("long")).withColumn("n", F.count("*").over(mine)).withColumn("newest", F.max("epoch").over(mine))
    late = b.where("epoch < newest and event_id % 5 = 0").withColumn("arrival", F.col("n") + F.col("arrival"))
    both = b.unionByName(late).withColumns({"record_count": F.lit(1).cast("long"), "fingerprint": F.lit("")})
    return producers.fold(both).select("producer_id", "arrival", "epoch", "sequence", "verdict")


@query("""WITH sent AS (SELECT user_id AS producer_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS sequence, event_id FROM events),
arr AS (SELECT *, sequence * 2 AS arrival, false AS changed FROM sent UNION ALL SELECT *, sequence * 2 + 1, true FROM sent WHERE event_id % 6 = 1)
SELECT producer_id, arrival, sequence, CASE WHEN changed THEN 'CONFLICTING_SEQUENCE' ELSE 'APPENDED' END AS verdict FROM arr""")
def producer_conflict(spark, sf_dir):
    """A sequence that comes again with another content."""
    e = table(spark, sf_dir, "events")
    sent = e.select(F.col("user_id").alias("producer_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).cast("long").alias("sequence"), "event_id", "props")
    first = sent.withColumn("arrival", F.col("sequence") * 2).withColumn("fingerprint", F.sha2("props", 256))
    changed = sent.where("event_id % 6 = 1").withColumn("arrival", F.col("sequence") * 2 + 1).withColumn("fingerprint", F.sha2(F.concat("props", F.lit("!")), 256))
    both = first.unionByName(changed).withColumns({"epoch": F.lit(0), "record_count": F.lit(1).cast("long")})
    return producers.fold(both).select("producer_id", "arrival", "sequence", "verdict")


@query(f"""WITH {_ARRIVALS}, r AS (SELECT *, row_number() OVER (PARTITION BY producer_id ORDER BY arrival DESC) AS nth FROM verdicts WHERE verdict = 'APPENDED')
SELECT producer_id, sequence, nth FROM r WHERE nth <= 5""")
def producer_last_five(spark, sf_dir):
    accepted = producers.fold(_arrivals(spark, sf_dir)).where("verdict = 'APPENDED'")
    return producers.last_batches(accepted).select("producer_id", "sequence", F.col("nth").cast("long").alias("nth"))


@query("""SELECT event_id, (2147483647 - event_id % 5 + k) % 2147483648 AS next_sequence,
  CAST((CAST(2147483645 AS BIGINT) + k + 2147483648) % 4294967296 - 2147483648 AS INTEGER) AS wrapped FROM (SELECT event_id, user_id % 7 AS k FROM events)""")
def sequence_wrap(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 7).alias("k"))
    return e.select("event_id", S.next_sequence(F.expr("2147483647L - event_id % 5"), F.col("k")).alias("next_sequence"), S.wrapped_int(F.lit(2147483645).cast("long") + F.col("k")).alias("wrapped"))


_FRAMED = "concat(octet_length(encode(event_type)), ':', event_type, octet_length(encode(props)), ':', props)"


@query(f"WITH {REC} SELECT part, off // 50 AS seg, sha256(string_agg({_FRAMED}, '' ORDER BY off)) AS fingerprint FROM rec GROUP BY 1, 2")
def batch_fingerprint(spark, sf_dir):
    r = rec(spark, sf_dir).withColumn("seg", F.expr("off div 50"))
    row = F.struct("off", S.framed(F.col("event_type"), F.col("props")).alias("f"))
    texts = F.transform(F.sort_array(F.collect_list(row)), lambda x: x.f)
    return r.groupBy("part", "seg").agg(F.sha2(F.array_join(texts, ""), 256).alias("fingerprint"))


@query(f"""WITH {REC}, d AS (SELECT part, off // 50 AS seg, sha256(string_agg(props, '|' ORDER BY off)) AS stored,
  sha256(string_agg(CASE WHEN event_id % 503 = 7 THEN concat(props, ' ') ELSE props END, '|' ORDER BY off)) AS found FROM rec GROUP BY 1, 2)
SELECT part, seg FROM d WHERE stored <> found""")
def segment_integrity(spark, sf_dir):
    """Segments whose digest no longer fits after some records were tampered with."""
    r = rec(spark, sf_dir).withColumn("seg", F.expr("off div 50")).withColumn("read", F.when(F.col("event_id") % 503 == 7, F.concat("props", F.lit(" "))).otherwise(F.col("props")))

    def digest(c: str):
        return F.sha2(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("off", c))), lambda x: x[c]), "|"), 256)

    return r.groupBy("part", "seg").agg(digest("props").alias("stored"), digest("read").alias("found")).where("stored <> found").select("part", "seg")


# Commits: user u of group u % 8 commits, with every event, how far it has come in topic event_type, partition u % 4.
def _commits(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").selectExpr("concat('g', user_id % 8) as `group`", "event_type as topic", "cast(user_id % 4 as int) as partition", "event_id * 2 as offset", "if(event_id % 3 = 0, null, props) as metadata", "event_id as revision")


_COMMITS = """commits AS (SELECT concat('g', user_id % 8) AS "group", event_type AS topic, CAST(user_id % 4 AS INTEGER) AS partition, event_id * 2 AS "offset",
  CASE WHEN event_id % 3 = 0 THEN NULL ELSE props END AS metadata, event_id AS revision FROM events),
cur AS (SELECT * EXCLUDE nth FROM (SELECT *, row_number() OVER (PARTITION BY "group", topic, partition ORDER BY revision DESC) AS nth FROM commits) WHERE nth = 1)"""


@query(f"WITH {_COMMITS} SELECT * FROM cur")
def offset_commit_latest(spark, sf_dir):
    return groups.latest_commits(_commits(spark, sf_dir))


@query(f"""WITH {_COMMITS}, req AS (SELECT row_number() OVER (ORDER BY g, t, p) - 1 AS pos, concat('g', g) AS "group", t AS topic, CAST(p AS INTEGER) AS partition
  FROM (SELECT unnest(range(0, 3)) AS g), (VALUES ('click'), ('nothing'), ('view')) AS x(t), (SELECT unnest(range(0, 6)) AS p))
SELECT CAST(pos AS INTEGER) AS pos, req."group", req.topic, req.partition, coalesce("offset", -1) AS "offset", metadata FROM req LEFT JOIN cur ON cur."group" = req."group" AND cur.topic = req.topic AND cur.partition = req.partition""")
def offset_fetch_selected(spark, sf_dir):
    keys = [(f"g{g}", t, p) for g in range(3) for t in ("click", "nothing", "view") for p in range(6)]
    asked = spark.createDataFrame([(i, *k) for i, k in enumerate(keys)], "pos int, group string, topic string, partition int")
    return groups.fetch_offsets(asked, groups.latest_commits(_commits(spark, sf_dir)))


_TOPICS = [("click", 4), ("view", 2), ("purchase", 3)]


@query(f"""WITH {_COMMITS}, t(topic, n) AS (VALUES ('click', 4), ('view', 2), ('purchase', 3))
SELECT "group", c.topic, partition, "offset" - 50 AS "offset", CASE WHEN n IS NULL OR partition NOT BETWEEN 0 AND n - 1 THEN 'UNKNOWN_TOPIC_OR_PARTITION'
  WHEN "offset" - 50 < 0 THEN 'INVALID_COMMIT_OFFSET_SIZE' WHEN octet_length(encode(metadata)) > 4096 THEN 'OFFSET_METADATA_TOO_LARGE' ELSE 'NONE' END AS error FROM commits c LEFT JOIN t ON t.topic = c.topic""")
def offset_commit_validate(spark, sf_dir):
    topics = spark.createDataFrame(_TOPICS, "topic string, partition_count int")
    return groups.validate_commits(_commits(spark, sf_dir).withColumn("offset", F.col("offset") - 50), topics)


@query(f"""WITH {_COMMITS} SELECT "group", topic, string_agg(concat(partition, '=', "offset"), ',' ORDER BY partition) AS offsets FROM cur GROUP BY "group", topic""")
def offset_fetch_all_by_topic(spark, sf_dir):
    out = groups.offsets_by_topic(groups.latest_commits(_commits(spark, sf_dir)))
    return out.select("group", "topic", F.array_join(F.transform("entries", lambda e: F.concat(e.partition.cast("string"), F.lit("="), e.offset.cast("string"))), ",").alias("offsets"))


def _members(spark, sf_dir) -> DataFrame:
    """Suppliers as members of their nation's group; which protocols one supports follows from both keys."""
    s = table(spark, sf_dir, "supplier")
    s = s.selectExpr("cast(s_nationkey as string) as `group`", "s_suppkey as member", "s_suppkey % 2 as flip", "s_nationkey % 5 + if(s_suppkey % 7 = 0, 1, 0) as five")
    s = s.withColumn("leader", F.col("member") == F.min("member").over(Window.partitionBy("group")))
    order = F.expr("if(flip = 0, array('range', 'roundrobin', 'sticky'), array('sticky', 'roundrobin', 'range'))")
    return s.select("group", "member", "leader", "five", F.posexplode(order).alias("position", "protocol")).where("not (protocol = 'sticky' and five = 0) and not (protocol = 'range' and five = 4)")


_MEMBERS = """m AS (SELECT CAST(s_nationkey AS VARCHAR) AS "group", s_suppkey AS member, s_suppkey % 2 AS flip, s_nationkey % 5 + CASE WHEN s_suppkey % 7 = 0 THEN 1 ELSE 0 END AS five FROM supplier),
l AS (SELECT *, member = min(member) OVER (PARTITION BY "group") AS leader FROM m),
o AS (SELECT l.*, x.protocol, CASE WHEN flip = 0 THEN x.a ELSE x.b END AS position FROM l, (VALUES ('range', 0, 2), ('roundrobin', 1, 1), ('sticky', 2, 0)) AS x(protocol, a, b)
  WHERE NOT (protocol = 'sticky' AND five = 0) AND NOT (protocol = 'range' AND five = 4))"""


@query(f"""WITH {_MEMBERS}, n AS (SELECT "group", count(DISTINCT member) AS members FROM o GROUP BY 1),
s AS (SELECT "group", protocol, count(DISTINCT member) AS k, min(position) FILTER (leader) AS pos FROM o GROUP BY 1, 2),
f AS (SELECT s.*, row_number() OVER (PARTITION BY s."group" ORDER BY pos) AS nth FROM s JOIN n ON s."group" = n."group" WHERE k = members AND pos IS NOT NULL)
SELECT n."group", members, protocol FROM n LEFT JOIN f ON f."group" = n."group" AND nth = 1""")
def group_protocol_select(spark, sf_dir):
    return groups.select_protocol(_members(spark, sf_dir))


@query("""WITH cur AS (SELECT CAST(s_nationkey AS VARCHAR) AS "group", s_suppkey AS member FROM supplier),
sub AS (SELECT * FROM cur WHERE NOT (member % 11 = 0) UNION ALL SELECT "group", member FROM cur WHERE member % 13 = 0 UNION ALL SELECT "group", -1 FROM cur WHERE member % 17 = 0),
once AS (SELECT "group", member, count(*) AS times FROM sub GROUP BY 1, 2)
SELECT coalesce(c."group", o."group") AS "group", count(*) FILTER (c.member IS NULL OR o.member IS NULL OR times > 1) AS mismatches,
  count(*) FILTER (c.member IS NULL OR o.member IS NULL OR times > 1) = 0 AS exact FROM cur c FULL JOIN once o ON c."group" = o."group" AND c.member = o.member GROUP BY 1""")
def group_assignment_exact(spark, sf_dir):
    cur = table(spark, sf_dir, "supplier").selectExpr("cast(s_nationkey as string) as `group`", "s_suppkey as member")
    submitted = cur.where("member % 11 <> 0").union(cur.where("member % 13 = 0")).union(cur.where("member % 17 = 0").selectExpr("`group`", "-1L"))
    return groups.assignment_exact(cur, submitted)


@query("""WITH b AS (SELECT user_id AS member, ts AS seen, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM (SELECT DISTINCT user_id, ts FROM events))
SELECT member, seen AS last_seen, seen + INTERVAL 43200 SECOND AS expired_at FROM b WHERE seen + INTERVAL 43200 SECOND <= coalesce(nxt, TIMESTAMP '2024-02-01 00:00:00')""")
def group_session_expiry(spark, sf_dir):
    beats = table(spark, sf_dir, "events").select(F.col("user_id").alias("member"), F.col("ts").alias("at")).distinct()
    return groups.session_expiries(beats, 43_200, F.lit("2024-02-01 00:00:00").cast("timestamp_ntz"))


@query()
def group_generation_replay(spark, sf_dir):
    """Every event is a call of its user in group user_id % 8: entries, joins, syncs, heartbeats, leaves and commits."""
    e = table(spark, sf_dir, "events")
    kind = "case event_id % 7 when 0 then 'enter' when 1 then 'join' when 2 then 'sync' when 3 then 'leave' when 4 then 'commit' else 'heartbeat' end"
    calls = e.selectExpr("concat('g', user_id % 8) as `group`", "unix_millis(cast(ts as timestamp)) as at_ms", "event_id", f"{kind} as kind", "concat('m', user_id % 5) as member", "event_id % 4 as generation", "'range,roundrobin' as protocols", "7200000L as session_ms", "3600000L as rebalance_ms")
    return groups.replay(calls.withColumn("n", F.row_number().over(Window.partitionBy("group").orderBy("at_ms", "event_id")).cast("long")))


@query("""WITH t(topic, n) AS (VALUES ('click', 4), ('view', 2), ('purchase', 3)) SELECT topic, CAST(unnest(range(0, n)) AS INTEGER) AS partition, 1 AS leader, '1' AS replicas, '1' AS isr FROM t""")
def topic_describe(spark, sf_dir):
    topics = spark.createDataFrame(_TOPICS, "topic string, partition_count int")
    parts = topics.select("topic", F.explode(F.sequence(F.lit(0), F.col("partition_count") - 1)).alias("partition"))
    return parts.select("topic", "partition", F.lit(1).alias("leader"), F.lit("1").alias("replicas"), F.lit("1").alias("isr"))


@query("SELECT DISTINCT event_type AS topic FROM events")
def topic_list(spark, sf_dir):
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("topic")).distinct()


@query("SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role HAVING count(*) > 1")
def duplicate_keys(spark, sf_dir):
    return records.duplicate_keys(table(spark, sf_dir, "conversations"), "conv_id", "role")


@query("""WITH n AS (SELECT url AS name FROM pages UNION ALL SELECT replace(replace(replace(url, ':', '_'), '/', '.'), '?', '-') FROM pages UNION ALL VALUES ('.'), ('..'), (''), (repeat('a', 249)), (repeat('a', 250)))
SELECT name, regexp_full_match(name, '[A-Za-z0-9._-]{1,249}') AND name NOT IN ('.', '..') AS valid FROM n""")
def identifier_validation(spark, sf_dir):
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("name"))
    clean = urls.select(F.replace(F.replace(F.replace("name", F.lit(":"), F.lit("_")), F.lit("/"), F.lit(".")), F.lit("?"), F.lit("-")))
    more = spark.createDataFrame([(".",), ("..",), ("",), ("a" * 249,), ("a" * 250,)], "name string")
    return urls.union(clean).union(more).select("name", S.valid_name(F.col("name")).alias("valid"))


@query("""SELECT o_custkey AS request, count(*) AS n_records, CAST(sum(octet_length(encode(o_orderpriority)) + 70) AS BIGINT) AS bytes, count(*) > 15 OR sum(octet_length(encode(o_orderpriority)) + 70) > 1100 AS too_large FROM orders GROUP BY o_custkey""")
def request_limits(spark, sf_dir):
    size = F.sum(F.octet_length("o_orderpriority") + 70)
    out = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("request")).agg(F.count("*").alias("n_records"), size.alias("bytes"))
    return out.withColumn("too_large", (F.col("n_records") > 15) | (F.col("bytes") > 1100))


@query("""WITH v AS (SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END) * o_orderkey * o_orderkey * o_orderkey AS x FROM orders),
z AS (SELECT o_orderkey, x, CAST(CASE WHEN x >= 0 THEN CAST(x AS HUGEINT) * 2 ELSE -2 * CAST(x AS HUGEINT) - 1 END AS UBIGINT) AS u FROM v)
SELECT o_orderkey, x, CASE WHEN u < 128 THEN 1 WHEN u < 16384 THEN 2 WHEN u < 2097152 THEN 3 WHEN u < 268435456 THEN 4 WHEN u < 34359738368 THEN 5
  WHEN u < 4398046511104 THEN 6 WHEN u < 562949953421312 THEN 7 WHEN u < 72057594037927936 THEN 8 WHEN u < 9223372036854775808 THEN 9 ELSE 10 END AS bytes FROM z""")
def varint_size(spark, sf_dir):
    """x is null where the cube isn't a 64-bit number, on which the SQL stops; such a number has no encoding, so bytes is null too."""
    cube = "if(o_orderkey % 2 = 0, 1, -1) * o_orderkey * o_orderkey * o_orderkey"
    fits = "o_orderkey between -2097152 and 2097151"
    v = table(spark, sf_dir, "orders").selectExpr("o_orderkey", f"if({fits}, {cube}, null) as x")
    return v.select("o_orderkey", "x", F.when(F.expr(f"not ({fits})"), None).otherwise(S.varint_size(F.col("x"))).alias("bytes"))


@query(f"""WITH {_COMMITS}, ends AS (SELECT event_type AS topic, CAST(user_id % 4 AS INTEGER) AS partition, max(event_id) * 2 + 10 AS latest FROM events GROUP BY 1, 2)
SELECT cur."group", cur.topic, cur.partition, greatest(0, latest - "offset") AS lag FROM cur JOIN ends ON cur.topic = ends.topic AND cur.partition = ends.partition""")
def consumer_lag(spark, sf_dir):
    ends = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("topic"), (F.col("user_id") % 4).cast("int").alias("partition")).agg((F.max("event_id") * 2 + 10).alias("latest"))
    cur = groups.latest_commits(_commits(spark, sf_dir))
    return cur.join(ends, ["topic", "partition"]).select("group", "topic", "partition", F.greatest(F.lit(0).cast("long"), F.col("latest") - F.col("offset")).alias("lag"))


@query("SELECT date_trunc('day', ts) AS day, event_type, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1, 2")
def daily_event_windows(spark, sf_dir):
    w = F.window(F.col("ts"), "1 day")
    out = table(spark, sf_dir, "events").groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))
    return out.select(F.col("w.start").alias("day"), "event_type", "n", "users")


@query("""WITH s AS (SELECT user_id AS producer_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS nth, event_id FROM events),
sent AS (SELECT producer_id, (2147483640 + nth) % 2147483648 AS sequence, nth FROM s WHERE event_id % 50 <> 7),
p AS (SELECT *, (lag(sequence) OVER (PARTITION BY producer_id ORDER BY nth) + 1) % 2147483648 AS expected FROM sent)
SELECT producer_id, sequence, expected FROM p WHERE expected <> sequence""")
def producer_sequence_gaps(spark, sf_dir):
    """Where a producer's sequence, close to its wrap, doesn't follow the one before."""
    e = table(spark, sf_dir, "events")
    mine = Window.partitionBy("producer_id").orderBy("nth")
    s = e.select(F.col("user_id").alias("producer_id"), (F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")) - 1).alias("nth"), "event_id").where("event_id % 50 <> 7")
    s = s.withColumn("sequence", S.next_sequence(F.lit(2147483640), F.col("nth")))
    return s.withColumn("expected", S.next_sequence(F.lag("sequence").over(mine), F.lit(1))).where("expected <> sequence").select("producer_id", "sequence", "expected")


@query(f"""WITH {_ARRIVALS}, st AS (SELECT producer_id, max(sequence) AS last_sequence, count(*) AS batches FROM verdicts WHERE verdict = 'APPENDED' GROUP BY 1),
ask AS (SELECT unnest(range(0, 300, 3)) AS producer_id)
SELECT ask.producer_id, coalesce(last_sequence, -1) AS last_sequence, coalesce(batches, 0) AS batches FROM ask LEFT JOIN st ON ask.producer_id = st.producer_id""")
def producer_lookup(spark, sf_dir):
    accepted = producers.fold(_arrivals(spark, sf_dir)).where("verdict = 'APPENDED'")
    state = accepted.groupBy("producer_id").agg(F.max("sequence").alias("last_sequence"), F.count("*").alias("batches"))
    asked = spark.range(0, 300, 3).withColumnRenamed("id", "producer_id")
    none = F.lit(-1).cast("long")
    return asked.join(state, "producer_id", "left").select("producer_id", F.coalesce("last_sequence", none).alias("last_sequence"), F.coalesce("batches", F.lit(0).cast("long")).alias("batches"))


_CODES = {"APPENDED": 0, "DUPLICATE": 0, "OUT_OF_ORDER_SEQUENCE_NUMBER": 45, "INVALID_PRODUCER_EPOCH": 47, "CONFLICTING_SEQUENCE": 87}


@query(f"""WITH {_ARRIVALS}, {_EPOCHS}, every_one AS (SELECT verdict FROM verdicts
  UNION ALL SELECT 'APPENDED' FROM b UNION ALL SELECT 'INVALID_PRODUCER_EPOCH' FROM b WHERE epoch < newest AND event_id % 5 = 0
  UNION ALL SELECT 'APPENDED' FROM events UNION ALL SELECT 'CONFLICTING_SEQUENCE' FROM events WHERE event_id % 6 = 1)
SELECT CASE verdict WHEN 'OUT_OF_ORDER_SEQUENCE_NUMBER' THEN 45 WHEN 'INVALID_PRODUCER_EPOCH' THEN 47 WHEN 'CONFLICTING_SEQUENCE' THEN 87 ELSE 0 END AS code, count(*) AS n FROM every_one GROUP BY 1""")
def error_codes(spark, sf_dir):
    """Verdicts on resent, fenced and changed batches as numeric codes of the public protocol."""
    mapped = F.create_map(*[F.lit(x) for pair in _CODES.items() for x in pair])
    judged = producers.fold(_arrivals(spark, sf_dir)).select("verdict").union(producer_epoch_fence(spark, sf_dir).select("verdict")).union(producer_conflict(spark, sf_dir).select("verdict"))
    return judged.groupBy(F.element_at(mapped, F.col("verdict")).alias("code")).agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT CAST(s_nationkey AS VARCHAR) AS "group", s_suppkey AS member, 1000 + s_suppkey % 7 * 100 AS rebalance_ms, octet_length(encode(s_name)) AS bytes FROM supplier),
f AS (SELECT *, min(member) OVER (PARTITION BY "group") AS leader FROM m)
SELECT "group", count(*) AS members, max(5000 + rebalance_ms) AS phase_deadline, CAST(sum(bytes) AS BIGINT) AS protocol_bytes, min(member) FILTER (member <> leader) AS next_leader FROM f GROUP BY "group" """)
def group_phase(spark, sf_dir):
    """Per group: when its phase is overdue, how much its protocols take, and who leads if the leader goes."""
    m = table(spark, sf_dir, "supplier").selectExpr("cast(s_nationkey as string) as `group`", "s_suppkey as member", "1000 + s_suppkey % 7 * 100 as rebalance_ms", "octet_length(s_name) as bytes")
    m = m.withColumn("leader", F.min("member").over(Window.partitionBy("group")))
    return m.groupBy("group").agg(F.count("*").alias("members"), F.max(F.col("rebalance_ms") + 5000).alias("phase_deadline"), F.sum("bytes").alias("protocol_bytes"), F.min(F.when(F.col("member") != F.col("leader"), F.col("member"))).alias("next_leader"))


@query(f"""WITH {SEG}, x AS ({_retention_oracle(_OLD, _LARGE)}), kept AS (SELECT concat('s-', seg.part, '-', seg.seg) AS object FROM seg JOIN x ON seg.part = x.part WHERE base_offset >= new_start),
planned AS (SELECT object FROM kept UNION SELECT concat('p-', user_id % 16) FROM events)
SELECT object FROM (SELECT concat('s-', part, '-', seg) AS object FROM seg UNION ALL SELECT concat('p-', user_id % 20) FROM events) EXCEPT SELECT object FROM planned""".replace(f"WITH {SEG}, m AS", "WITH m AS"))
def gc_removable(spark, sf_dir):
    """The inventory except what stays live after retention: kept segments and producer pages."""
    s = seg(spark, sf_dir)
    starts = retention.report(retention.expired(s, _now(), AGE_S, KEEP_BYTES)).select("part", "new_start")
    name = F.concat(F.lit("s-"), F.col("part").cast("string"), F.lit("-"), F.col("seg").cast("string")).alias("object")
    kept = s.join(starts, "part").where("base_offset >= new_start").select(name)
    users = table(spark, sf_dir, "events").select("user_id").distinct()
    pages = lambda n: users.selectExpr(f"concat('p-', user_id % {n}) as object").distinct()
    return s.select(name).union(pages(20)).subtract(kept.union(pages(16)).distinct())


@query(f"""WITH {_MEMBERS}, n AS (SELECT "group", count(DISTINCT member) AS members FROM o GROUP BY 1)
SELECT o."group", protocol FROM o JOIN n ON o."group" = n."group" GROUP BY o."group", protocol, members HAVING count(DISTINCT member) = members""")
def group_shared_protocols(spark, sf_dir):
    """Protocols of some member without those that another one lacks."""
    m = _members(spark, sf_dir)
    offered = m.select("group", "protocol").distinct()
    people = m.select("group", "member").distinct()
    lacking = people.join(offered, "group").join(m.select("group", "member", "protocol"), ["group", "member", "protocol"], "left_anti").select("group", "protocol")
    return offered.exceptAll(lacking.distinct())


@query("""WITH r AS (SELECT o_custkey AS request, o_orderpriority AS topic, o_orderkey % 6 AS partition, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS pos FROM orders),
t AS (SELECT request, topic, min(pos) AS first_pos, string_agg(CAST(partition AS VARCHAR), ',' ORDER BY pos) AS partitions FROM r WHERE partition <> 5 GROUP BY 1, 2)
SELECT request, string_agg(concat(topic, ':', partitions), ';' ORDER BY first_pos) AS answer FROM t GROUP BY request""")
def request_regroup(spark, sf_dir):
    """Requests flattened to partitions, filtered, and put together again in the order of the request."""
    mine = Window.partitionBy("request").orderBy("o_orderkey")
    flat = table(spark, sf_dir, "orders").selectExpr("o_custkey as request", "o_orderpriority as topic", "o_orderkey % 6 as partition", "o_orderkey").withColumn("pos", F.row_number().over(mine)).where("partition <> 5")
    join = lambda pairs, f, sep: F.array_join(F.transform(F.sort_array(pairs), f), sep)
    topics = flat.groupBy("request", "topic").agg(F.min("pos").alias("first"), join(F.collect_list(F.struct("pos", "partition")), lambda x: x.partition.cast("string"), ",").alias("parts"))
    return topics.groupBy("request").agg(join(F.collect_list(F.struct("first", "topic", "parts")), lambda x: F.concat(x.topic, F.lit(":"), x.parts), ";").alias("answer"))


@query("""SELECT o_orderkey, CASE WHEN acks < -1 OR acks > 1 THEN 'INVALID_REQUIRED_ACKS' WHEN idempotent AND acks <> -1 THEN 'INVALID_REQUIRED_ACKS' WHEN acks = 0 THEN 'NO_RESPONSE' ELSE 'NONE' END AS verdict
FROM (SELECT o_orderkey, o_orderkey % 5 - 2 AS acks, o_custkey % 2 = 0 AS idempotent FROM orders)""")
def request_acks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "o_orderkey % 5 - 2 as acks", "o_custkey % 2 = 0 as idempotent")
    bad = ~F.col("acks").between(-1, 1) | F.col("idempotent") & (F.col("acks") != -1)
    return o.select("o_orderkey", F.when(bad, "INVALID_REQUIRED_ACKS").when(F.col("acks") == 0, "NO_RESPONSE").otherwise("NONE").alias("verdict"))


@query(f"""WITH {REC}, b AS (SELECT part, off // 50 AS seg, event_id, CASE WHEN event_id % 211 = 0 THEN -2 WHEN event_id % 307 = 1 THEN 5 ELSE -1 END AS producer_id, CASE WHEN event_id % 307 = 1 THEN 0 ELSE -1 END AS epoch FROM rec)
SELECT part, seg, count(*) AS n, bool_and(producer_id >= -1 AND (producer_id >= 0) = (epoch >= 0)) AND count(DISTINCT producer_id) = 1 AS valid FROM b GROUP BY part, seg""")
def batch_semantics(spark, sf_dir):
    """Batches whose records agree on one producer, with ids and epochs given together or not at all."""
    r = rec(spark, sf_dir).selectExpr("part", "off div 50 as seg", "case when event_id % 211 = 0 then -2 when event_id % 307 = 1 then 5 else -1 end as producer_id", "case when event_id % 307 = 1 then 0 else -1 end as epoch")
    fit = F.bool_and((F.col("producer_id") >= -1) & ((F.col("producer_id") >= 0) == (F.col("epoch") >= 0))) & (F.min("producer_id") == F.max("producer_id"))
    return r.groupBy("part", "seg").agg(F.count("*").alias("n"), fit.alias("valid"))


@query(f"""WITH {REC} SELECT part, off, epoch_us(ts) // 1000 AS timestamp_ms, event_type AS "key", props AS value, CAST(NULL AS VARCHAR) AS error FROM rec""")
def decode_batches(spark, sf_dir):
    """Each segment as a batch of the public format, decoded again."""
    r = rec(spark, sf_dir).withColumn("seg", F.expr("off div 50"))
    row = F.struct("off", F.unix_millis(F.col("ts").cast("timestamp")).alias("timestamp_ms"), F.encode("event_type", "UTF-8").alias("key"), F.encode("props", "UTF-8").alias("value"))
    rows = F.transform(F.sort_array(F.collect_list(row)), lambda x: F.struct(x.timestamp_ms.alias("timestamp_ms"), x.key.alias("key"), x.value.alias("value")))
    data = r.groupBy("part", "seg").agg(rows.alias("rows"), F.min("off").alias("base")).select("part", "base", codec.encoded("rows").alias("data"))
    back = codec.decoded(data)
    return back.select("part", (F.col("base") + F.col("record.offset")).alias("off"), "record.timestamp_ms", F.decode("record.key", "UTF-8").alias("key"), F.decode("record.value", "UTF-8").alias("value"), "error")


@query("""WITH p AS (SELECT user_id AS producer_id, count(*) AS n FROM events GROUP BY 1), r AS (SELECT *, row_number() OVER (ORDER BY producer_id) - 1 AS nth FROM p)
SELECT nth // 64 AS page, CAST(0 AS INTEGER) AS level, min(producer_id) AS min_id, max(producer_id) AS max_id, count(*) AS n, CAST(sum(n) AS BIGINT) AS batches FROM r GROUP BY 1
UNION ALL SELECT nth // 4096, 1, min(producer_id), max(producer_id), count(*), CAST(sum(n) AS BIGINT) FROM r GROUP BY 1""")
def producer_page_rollup(spark, sf_dir):
    """Producers in pages of 64 and pages of pages: what ids, how many producers and batches each has."""
    p = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("producer_id")).agg(F.count("*").alias("batches"))
    return producers.page_rollup(p, levels=2)


@query("""WITH n AS (SELECT url AS name FROM pages UNION ALL SELECT split_part(url, '/', 3) FROM pages UNION ALL SELECT replace(replace(split_part(url, '://', 2), '/', '.'), '?', '-') FROM pages UNION ALL VALUES ('a/b'), ('/a'), ('a/'), ('a//b'), ('.'), (''), ('a/../b'), ('::1'), ('host name'), ('x' || repeat('y', 255)))
SELECT name, name = '' OR (NOT contains(name, '//') AND NOT starts_with(name, '/') AND NOT ends_with(name, '/') AND len(list_filter(string_split(name, '/'), lambda x: x IN ('.', '..') OR NOT regexp_full_match(x, '[A-Za-z0-9._-]+'))) = 0) AS valid_prefix,
  regexp_full_match(name, '[A-Za-z0-9._-]{1,249}') AND name NOT IN ('.', '..') AS valid_component,
  length(name) BETWEEN 1 AND 255 AND NOT regexp_matches(name, '[\\s/]') AS valid_host FROM n""")
def identifier_kinds(spark, sf_dir):
    """Key prefixes, path components and advertised hosts."""
    urls = table(spark, sf_dir, "pages").select(F.col("url").alias("name"))
    hosts = urls.select(F.split_part("name", F.lit("/"), F.lit(3)))
    clean = urls.select(F.replace(F.replace(F.split_part("name", F.lit("://"), F.lit(2)), F.lit("/"), F.lit(".")), F.lit("?"), F.lit("-")))
    odd = ["a/b", "/a", "a/", "a//b", ".", "", "a/../b", "::1", "host name", "x" + "y" * 255]
    names = urls.union(hosts).union(clean).union(spark.createDataFrame([(x,) for x in odd], "name string"))
    name = F.col("name")
    return names.select("name", S.valid_prefix(name).alias("valid_prefix"), S.valid_name(name).alias("valid_component"), S.valid_host(name).alias("valid_host"))
