"""Removal of repeated 200-byte strings by distributed prefix doubling.

The name of the 2h bytes at a position is the pair of the names of h bytes at the position and h
further on; names are 64-bit mixtures of such pairs, so doubling needs no shuffle within a text.
Spark then ranks positions by name in rounds over growing lengths. Each round drops what is unique,
settles what is repeated as a whole, and passes on only what is neither:

1. CORE bytes. Every 200-byte string has one anchor, the CORE-byte string in it whose name is
   smallest (leftmost of equals), which depends on the string alone. Positions that share an anchor
   form one row of about 85 positions. A row whose anchor's name is unique in the corpus holds
   nothing repeated. If all bytes spanned by a row are repeated at the same place about an equal
   anchor, every string of the row is.
2. 185 bytes: rows that differ from others with the same anchor are cut into blocks of STEP
   positions, named by the bytes that all strings of a block share, and settled alike.
3. 200 bytes: what is left, near the ends of matches, position by position.

Of rows with equal spans only one goes on to the next round, so copies don't multiply. The tables
hold a row for some 85 bytes of text. Matches never cross documents. Names have 64 bits in rounds 1
and 2 on top of an equal 64-bit key, and a 128-bit hash of the bytes themselves in round 3.

by_rank_pairs() is the plain method, ranks of all byte positions re-ranked by Spark at growing offsets. It
gives the same starts and shuffles a multiple of what the rounds above do; figures are in the README.

Defined results: empty tables give empty results; texts of any length are read whole, long ones in
overlapping pieces; ties, that is strings that occur more than twice, all count; columns besides doc_id and
text aren't read; null text is empty; texts below 200 bytes are kept whole; repeated rows are copies
of one another, so their text goes entirely if it has 200 bytes; null ids are carried along.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, slices, utf8_buffer

THRESHOLD = 200
CORE = 32
STEP = 16
_SPREAD = THRESHOLD - CORE + 1  # CORE-byte strings in one of THRESHOLD bytes
_SHARED = THRESHOLD - STEP + 1  # bytes that all strings of a block share
#: Text bytes that are named at a time in a worker: some 80 times as much memory.
_SLICE_BYTES = 1 << 20
_INDEX_BITS = 26
#: Bytes of a table that one task sums up into another, where shuffles have more partitions than that asks for.
_TASK_BYTES = 2 << 20
_P1, _P2, _P3 = np.uint64(0x9E3779B185EBCA87), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
_S29, _S32 = np.uint64(29), np.uint64(32)


def _pair(a, b):
    x = a * _P1
    x ^= x >> _S29
    x += b * _P2
    x ^= x >> _S32
    return x


def _bytes_names() -> np.ndarray:
    x = (np.arange(256, dtype=np.uint64) + np.uint64(1)) * _P1
    return (x ^ (x >> _S29)) * _P3


def names(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The names of the CORE and of the 128 bytes at each position, by doubling."""
    h, length, core = _bytes_names()[data], 1, None
    while length < 128:
        h = _pair(h[:-length], h[length:]) if len(h) > length else h[:0]
        length *= 2
        if length == CORE:
            core = h
    return core, h


def _span_names(h128: np.ndarray, start: np.ndarray, count: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Of all bytes of the strings that start at `start` and the count - 1 positions after it, and of
    how far the anchor is; the spans have 200 to 368 bytes, so three overlapping names cover them."""
    reach = count + (THRESHOLD - 1 - 128)
    x = _pair(_pair(h128[start], h128[start + reach // 2]), h128[start + reach])
    return _pair(x, count.astype(np.uint64) * _P3 + offset.astype(np.uint64))


def anchor_rows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """key, span name, text number, first position in the text, positions and anchor's distance."""
    none = np.zeros(0, np.int64)
    if len(data) < THRESHOLD:
        return none, none, none, none, none, none
    core, h128 = names(data)
    index = np.uint64((1 << _INDEX_BITS) - 1)
    least = (core * _P3) & ~index | np.arange(len(core), dtype=np.uint64)
    width = 1
    while width * 2 <= _SPREAD:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    least = np.minimum(least[: len(least) - (_SPREAD - width)], least[_SPREAD - width :])
    anchor = (least & index).astype(np.int64)
    valid = np.ones(len(anchor), bool)
    for end in offsets[1:]:
        valid[max(0, end - THRESHOLD + 1) : end] = False
    at = np.flatnonzero(valid)
    if not len(at):
        return none, none, none, none, none, none
    cut = np.flatnonzero((at[1:] != at[:-1] + 1) | (anchor[at[1:]] != anchor[at[:-1]]))
    first, last = at[np.r_[0, cut + 1]], at[np.r_[cut, len(at) - 1]]
    count = last - first + 1
    distance = anchor[first] - first
    text = np.searchsorted(offsets, first, "right") - 1
    return core[anchor[first]].view(np.int64), _span_names(h128, first, count, distance).view(np.int64), text, first - offsets[text], count, distance


def _pieces(batch: pa.RecordBatch):
    """A batch in parts of about _SLICE_BYTES; of longer texts, overlapping pieces, so that each
    200-byte string is in one: row numbers, where in the text it begins, bytes, offsets."""
    row = 0
    for part in slices(batch, "text", _SLICE_BYTES):
        data, offsets = utf8_buffer(part.column("text"))
        for start in range(0, max(1, len(data)), _SLICE_BYTES) if part.num_rows == 1 else [0]:
            piece = data[start : start + _SLICE_BYTES + THRESHOLD - 1] if part.num_rows == 1 else data
            yield row, start, piece, np.array([0, len(piece)]) if part.num_rows == 1 else offsets
        row += part.num_rows


def _rows_of_anchors(batches):
    for batch in batches:
        t1, t2 = np.asarray(batch.column("t1")), np.asarray(batch.column("t2"))
        for row, start, data, offsets in _pieces(batch):
            key, span, text, first, count, distance = anchor_rows(data, offsets)
            text = text + row
            cols = [pa.array(key), pa.array(span), pa.array(t1[text]), pa.array(t2[text]), pa.array(first + start, pa.int64()), pa.array(count, pa.int32()), pa.array(distance, pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "span", "t1", "t2", "first", "count", "distance"])


_ROWS = "key long, span long, t1 long, t2 int, first long, count int, distance int"


def _named_part(data: bytes, first: np.ndarray, count: np.ndarray) -> list[tuple[int, np.ndarray, np.ndarray]]:
    """Rows of one text in runs near each other: where the run begins, the numbers of its rows, and
    the names of 128 bytes from there on; a long text isn't named as a whole."""
    order = np.argsort(first, kind="stable")
    out, i = [], 0
    while i < len(order):
        lo = max(0, int(first[order[i]]))
        j = i
        while j < len(order) and first[order[j]] < lo + _SLICE_BYTES:
            j += 1
        rows = order[i:j]
        hi = int((first[rows] + count[rows]).max()) + THRESHOLD
        out.append((lo, rows, names(np.frombuffer(data[lo:hi], np.uint8))[1]))
        i = j
    return out


def block_rows(data: bytes, first: np.ndarray, count: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, ...]:
    """Rows of round 2 from rows of round 1: key, span name, first, count, distance, number of the row."""
    out: list[list[np.ndarray]] = [[] for _ in range(6)]
    for lo, rows, h128 in _named_part(data, first, count):
        f, n, d = first[rows] - lo, count[rows], distance[rows]
        lowest, highest = (d - n + 1) // STEP, d // STEP
        many = highest - lowest + 1
        of = np.repeat(np.arange(len(rows)), many)
        j = np.arange(len(of)) - np.repeat(np.r_[0, np.cumsum(many)][:-1], many) + lowest[of]
        high, low = np.minimum(d[of], j * STEP + STEP - 1), np.maximum((d - n + 1)[of], j * STEP)
        anchor = (f + d)[of]
        shared = anchor - j * STEP
        key = _pair(_pair(h128[shared], h128[shared + _SHARED - 128]), j.astype(np.uint64))
        start, size = anchor - high, high - low + 1
        for k, x in enumerate((key.view(np.int64), _span_names(h128, start, size, high).view(np.int64), start + lo, size, high, rows[of])):
            out[k].append(x)
    return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _to_blocks(batches):
    for batch in batches:
        for t1, t2, text, rows in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "text", "rows"))):
            first, count, distance, weight = (np.array([r[k] for r in rows], np.int64) for k in ("first", "count", "distance", "weight"))
            key, span, f, n, d, of = block_rows(text.encode("utf-8"), first, count, distance)
            cols = [pa.array(key), pa.array(span), pa.array([t1] * len(f), pa.int64()), pa.array([t2] * len(f), pa.int32()), pa.array(f, pa.int64()), pa.array(n, pa.int32()), pa.array(d, pa.int32()), pa.array(weight[of], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "span", "t1", "t2", "first", "count", "distance", "weight"])


def _to_positions(batches):
    for batch in batches:
        for t1, t2, text, rows in zip(*(batch.column(c).to_pylist() for c in ("t1", "t2", "text", "rows"))):
            data = text.encode("utf-8")
            at = [(p, r["weight"]) for r in rows for p in range(r["first"], r["first"] + r["count"])]
            digests = [xxhash.xxh3_128_digest(data[p : p + THRESHOLD]) for p, _ in at]
            halves = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
            cols = [pa.array(halves[:, 0].copy()), pa.array(halves[:, 1].copy()), pa.array([t1] * len(at), pa.int64()), pa.array([t2] * len(at), pa.int32()), pa.array([p for p, _ in at], pa.int64()), pa.array([w for _, w in at], pa.int64())]
            yield pa.RecordBatch.from_arrays(cols, names=["key", "key2", "t1", "t2", "first", "weight"])


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [(s, e) for s, e in out]


def _full(data: bytes, spans: list[tuple[int, int]]) -> tuple:
    return len(data), [{"start": s, "stop": e} for s, e in spans], b"".join(_kept(data, spans))


def _digest(data: bytes, spans: list[tuple[int, int]]) -> tuple:
    sha = hashlib.sha256()
    for part in _kept(data, spans):
        sha.update(part)
    return len(data), sum(e - s for s, e in spans), len(spans), sha.hexdigest()


def _kept(data: bytes, spans: list[tuple[int, int]]):
    at = 0
    for s, e in [*spans, (len(data), len(data))]:
        yield data[at:s]
        at = e


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))
FULL = (_full, "n_bytes long, spans array<struct<start:bigint,stop:bigint>>, kept binary", [pa.int64(), _SPANS, pa.binary()])
DIGEST = (_digest, "n_bytes long, n_removed long, n_spans long, kept_sha256 string", [pa.int64()] * 3 + [pa.string()])


def _finish(form):
    make, ddl, types = form
    cols = ["doc_id", *(c.split()[0] for c in ddl.split(", "))]

    def run(batches):
        for batch in batches:
            rows = []
            for text, found in zip(batch.column("text").to_pylist(), batch.column("rows").to_pylist()):
                spans = merged([(r["first"], r["first"] + r["count"] - 1 + THRESHOLD) for r in found or []])
                rows.append(make(text.encode("utf-8"), spans))
            arrays = [pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *arrays], names=cols)

    return run


_ID = ["t1", "t2"]


def _by_text(rows: DataFrame, *cols: str) -> DataFrame:
    """The rows of a text together: as many as the text has, whatever its copies."""
    return rows.select(*_ID, *cols).distinct().groupBy(*_ID).agg(F.collect_list(F.struct(*cols)).alias("rows"))


def _dealt_anew(rows: DataFrame, key: str) -> DataFrame:
    """The rows of an aggregate, with a key that Spark takes for another one: a join then has a shuffle of
    its own and can split a hot key, which it can't if it shares the aggregate's."""
    return rows.withColumn(key, F.col(key).bitwiseXOR(F.lit(0)))


def remove_repeats(docs: DataFrame, form=FULL) -> DataFrame:
    """doc_id of every row, with its bytes less those that a repeated 200-byte string covers."""
    text = F.coalesce("text", F.lit(""))
    docs = docs.select("doc_id", F.xxhash64(text).alias("t1"), F.hash(text).alias("t2"), text.alias("text"))

    scratch = Scratch(docs.sparkSession)

    def few(df: DataFrame, *read: DataFrame) -> DataFrame:
        """df, summed up from tables, in as many tasks as their size asks for."""
        return df.coalesce(max(8, docs.sparkSession.sparkContext.defaultParallelism, scratch.size(*read) // _TASK_BYTES))

    # only what is read more than once is written, and what is found, so that the rest can go

    # round 1: copies of a text are told apart by their rows alone, which are equal
    rows = scratch.write_numbers(docs.select("t1", "t2", "text"), _rows_of_anchors, _ROWS)
    repeated = rows.groupBy("key").count().where("count > 1").select("key")
    live = scratch.write_numbers(rows.join(_dealt_anew(repeated, "key"), "key"))
    scratch.drop(rows)
    spans = live.groupBy("key", "span").agg(F.count("*").alias("n"), F.min(F.struct("t1", "t2", "first", "count", "distance")).alias("one"))
    spans = scratch.write_numbers(few(spans, live))
    several = spans.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").select("key")
    covered = [live.join(spans.where("n > 1").select("key", "span"), ["key", "span"]).select(*_ID, "first", "count")]
    open_rows = spans.join(several, "key").select("one.*", F.least("n", F.lit(2)).alias("weight"))

    # round 2: a weight of 2 stands for rows that are settled and only serve others to compare with
    joined = docs.join(_dealt_anew(_by_text(open_rows, "first", "count", "distance", "weight"), "t1"), _ID)
    blocks = scratch.write_numbers(joined.select("t1", "t2", "text", "rows"), _to_blocks, f"{_ROWS}, weight long")
    first = F.min(F.struct((-F.col("weight")).alias("order"), *_ID, "first", "count")).alias("one")
    kinds = scratch.write_numbers(few(blocks.groupBy("key", "span").agg(F.sum("weight").alias("alike"), first), blocks))
    covered.append(blocks.where("weight = 1").join(kinds.where("alike > 1").select("key", "span"), ["key", "span"]).select(*_ID, "first", "count"))
    mixed = kinds.groupBy("key").agg(F.count("*").alias("kinds")).where("kinds > 1").select("key")
    open_blocks = kinds.join(mixed, "key").select("one.*", F.least("alike", F.lit(2)).alias("weight"))

    # round 3
    joined = docs.join(_dealt_anew(_by_text(open_blocks, "first", "count", "weight"), "t1"), _ID)
    positions = scratch.write_numbers(joined.select("t1", "t2", "text", "rows"), _to_positions, "key long, key2 long, t1 long, t2 int, first long, weight long")
    several = positions.groupBy("key", "key2").agg(F.sum("weight").alias("total")).where("total > 1").select("key", "key2")
    covered.append(positions.where("weight = 1").join(_dealt_anew(several, "key"), ["key", "key2"]).select(*_ID, "first", F.lit(1).alias("count")))

    found = _by_text(covered[0].unionByName(covered[1]).unionByName(covered[2]), "first", "count")
    found = scratch.write_numbers(few(found, live, blocks, positions))
    scratch.drop(live, spans, blocks, kinds, positions)
    out = docs.join(found, _ID, "left").select("doc_id", "text", "rows")
    kind = docs.schema["doc_id"].dataType.simpleString()
    return out.mapInArrow(_finish(form), f"doc_id {kind}, {form[1]}")


#: Bytes that a position's first rank is made of.
FIRST = 8


def _to_ranks(batches):
    for batch in batches:
        for number, text in zip(batch.column("d").to_pylist(), batch.column("text").to_pylist()):
            data = text.encode("utf-8")
            for start in range(0, len(data) - FIRST + 1, _SLICE_BYTES):
                part = np.frombuffer(data[start : start + _SLICE_BYTES + FIRST - 1], np.uint8)
                ranks = np.lib.stride_tricks.sliding_window_view(part, FIRST).copy().view(">i8").astype(np.int64).ravel()
                cols = [pa.array(np.full(len(ranks), number)), pa.array(np.arange(start, start + len(ranks), dtype=np.int64)), pa.array(ranks)]
                yield pa.RecordBatch.from_arrays(cols, names=["d", "p", "r"])


def by_rank_pairs(docs: DataFrame) -> DataFrame:
    """doc_id, start of every repeated string of THRESHOLD bytes by plain prefix doubling.

    The rank of h bytes at a position and that of the h bytes after it are a pair; equal pairs get one rank.
    Unique positions are dropped in each round, until the length is the threshold.
    """
    scratch = Scratch(docs.sparkSession)
    numbered = scratch.write(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.monotonically_increasing_id().alias("d")))
    live = scratch.write(numbered.select("d", "text").mapInArrow(_to_ranks, "d long, p long, r long"))
    length = FIRST
    while length < THRESHOLD:
        step = min(length, THRESHOLD - length)
        shared = scratch.write(live.groupBy("r").count().where("count > 1").select("r"))
        live = scratch.write(live.join(shared, "r"))
        pairs = scratch.write(live.join(live.select("d", (F.col("p") - step).alias("p"), F.col("r").alias("r2")), ["d", "p"]))
        # equal pairs get one number, written before it's used
        ranks = scratch.write(pairs.groupBy("r", "r2").count().where("count > 1").select("r", "r2", F.monotonically_increasing_id().alias("rank")))
        scratch.drop(live, shared)
        live = scratch.write(pairs.join(ranks, ["r", "r2"]).select("d", "p", F.col("rank").alias("r")))
        scratch.drop(pairs, ranks)
        length += step
    return live.join(numbered.select("d", "doc_id"), "d").select("doc_id", F.col("p").alias("start"))
