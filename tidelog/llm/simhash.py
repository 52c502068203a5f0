"""SimHash near-duplicates, linked through deletion-variant signatures.

Two 64-bit fingerprints within DISTANCE bits are cut into SEGMENTS = (DISTANCE + 1) / 2 segments;
by the pigeonhole principle one segment differs in at most one bit. Each distinct fingerprint is
indexed under every segment with one bit wildcarded, an equality join brings together what shares
such a variant, and the full distance is verified. A variant shared by many fingerprints is dealt
again under variants of the other segment, cut in two halves; after that a group holds 2^18 distinct
fingerprints at most, whatever the input.

Only links of a spanning forest of each group leave it, and equal fingerprints are one node, so
copies never meet as pairs. Components come from `components`.

Defined results: empty tables give empty results; texts of any length count whole, one at a time; a
text without words (null or empty) has fingerprint zero and is linked like any
other; repeated rows give repeated rows; component_id is the smallest non-null doc_id of the
component, null if it has none; fingerprints that tie are one node; columns besides doc_id and text
aren't read, and one_of_each() keeps them whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, shuffle_partitions
from .components import components

DISTANCE = 3
WORDS = 3
SEED = 42
BITS = 64
SEGMENTS = (DISTANCE + 1) // 2
_WIDTH = BITS // SEGMENTS
#: Groups of more distinct fingerprints than this are dealt again before they are compared.
SPLIT_OVER = 4096
#: Fingerprints compared at a time.
_BLOCK = 1024


def fingerprint(text: str | None, words: int = WORDS) -> int:
    """Of the word shingles, repeats included: a bit is set if it is in over half of their hashes."""
    parts = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not parts:
        return 0
    hashed, joined = xxhash.xxh64_intdigest, b" ".join(parts)
    if len(parts) <= words:
        return hashed(joined, SEED)
    ends = np.cumsum([len(p) + 1 for p in parts])
    starts = [0, *ends[: -words].tolist()]
    stops = (ends[words - 1 :] - 1).tolist()
    h = np.array([hashed(joined[s:e], SEED) for s, e in zip(starts, stops)], np.uint64)
    totals = np.zeros(BITS, np.int64)
    for i in range(0, len(h), 1 << 16):
        totals += np.unpackbits(h[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(totals * 2 > len(h), bitorder="little").view(np.uint64)[0])


def _fingerprinted(docs: DataFrame):
    """What fingerprints() are made of, how, and their columns."""

    def run(batches):
        for batch in batches:
            fp = np.array([fingerprint(t) for t in batch.column("text").to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("t1"), pa.array(fp.view(np.int64))], names=["doc_id", "t1", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("t1"), "text"), run, f"doc_id {kind}, t1 long, fp long"


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, t1 (a hash of the text) and fp, the fingerprint as a signed long, of every whole text."""
    rows, run, ddl = _fingerprinted(docs)
    return rows.mapInArrow(run, ddl)


def forest(fps: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that join distinct fingerprints under the relation of at most distance bits: of each that
    isn't the first of its component to the first, so that few rounds join components of groups."""
    n = len(fps)
    parent = list(range(n))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    u = fps.view(np.uint64)
    for i in range(0, n, _BLOCK):
        for j in range(i, n, _BLOCK):
            near = np.bitwise_count(u[i : i + _BLOCK, None] ^ u[None, j : j + _BLOCK]) <= distance
            for x, y in zip(*np.nonzero(np.triu(near, 1) if i == j else near)):
                a, b = root(i + int(x)), root(j + int(y))
                if a != b:
                    parent[max(a, b)] = min(a, b)
    return [(int(fps[i]), int(fps[r])) for i in range(n) if (r := root(i)) != i]


def _masked(fp, low: int, width: int):
    """For width bits from bit low on: an array of (number of the bit, those bits with it cleared)."""
    part = F.shiftrightunsigned(fp, low).bitwiseAND((1 << width) - 1) if width < 64 else fp
    return F.array(*[F.struct(F.lit(low + b).cast("long").alias("bit"), part.bitwiseAND(~(1 << b)).alias("rest")) for b in range(width)])


def variants(distinct: DataFrame) -> DataFrame:
    """key, fp: each fingerprint under each segment with each bit wildcarded, SEGMENTS * _WIDTH rows.
    A key holds the number of the wildcarded bit above the rest of its segment."""
    rows = [F.transform(_masked(F.col("fp"), s * _WIDTH, _WIDTH), lambda v: F.shiftleft(v.bit, _WIDTH).bitwiseOR(v.rest)) for s in range(SEGMENTS)]
    return distinct.select(F.explode(F.concat(*rows)).alias("key"), "fp")


_FOUND = "a long, b long, key long"


def _links_of_groups(rows: DataFrame, keys: list[str], split_over: int | None):
    """Forest links (a, b) of the groups of a key; of groups over split_over, the rows (a, key) instead:
    what they are made of, how, and their columns.

    A partition is sorted and streamed: split_over fingerprints of one group are held at most. None
    is for groups that the pigeonhole argument bounds.
    """

    def run(batches):
        out: list[list[int]] = [[], [], []]
        held: list[np.ndarray] = []
        last, size, passed = None, 0, False

        def flush():
            nonlocal out
            cols = [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int64())]
            out = [[], [], []]
            return pa.RecordBatch.from_arrays(cols, names=["a", "b", "key"])

        def pass_on():
            for fps in held:
                out[0].extend(fps.tolist())
                out[1].extend([None] * len(fps))
                out[2].extend([last[0]] * len(fps))
            held.clear()

        def close():
            if held:
                for a, b in forest(np.unique(np.concatenate(held))) if size > 1 else []:
                    out[0].append(a)
                    out[1].append(b)
                    out[2].append(None)
                held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            ks = np.stack([np.asarray(batch.column(k)) for k in keys], 1)
            fps = np.asarray(batch.column("fp"))
            new = np.r_[last is None or tuple(ks[0]) != last, (ks[1:] != ks[:-1]).any(1)]
            begin = np.flatnonzero(new)
            stop = np.r_[begin[1:], len(ks)]
            lead = int(begin[0]) if len(begin) else len(ks)
            # groups of one row, which most are, are passed over; the last may go on in the next batch
            several = [(int(s), int(e)) for s, e in zip(begin, stop) if e - s > 1 or e == len(ks)]
            for s, e in [(0, lead), *several] if lead else several:
                if s >= lead:
                    close()
                    last, size, passed = tuple(ks[s]), 0, False
                held.append(fps[s:e])
                size += e - s
                if split_over is not None and (passed or size > split_over):
                    passed = True
                    pass_on()
            if len(out[0]) > 10_000:
                yield flush()
        close()
        yield flush()

    sent = rows.repartition(shuffle_partitions(rows.sparkSession), *keys).sortWithinPartitions(*keys)
    return sent.select(*keys, "fp"), run, _FOUND


def links(distinct: DataFrame, split_over: int = SPLIT_OVER) -> DataFrame:
    """a, b: links that join all fingerprints within DISTANCE bits, directly or through others."""
    scratch = Scratch(distinct.sparkSession)
    # the few rows are dealt out first: each becomes SEGMENTS * _WIDTH
    keyed = variants(distinct.repartition(shuffle_partitions(distinct.sparkSession), "fp"))
    found = scratch.write_numbers(*_links_of_groups(keyed, ["key"], split_over))
    out = found.where("key is null").select("a", "b")
    large = found.where("key is not null").select("key", F.col("a").alias("fp"))
    if large.limit(1).count():
        sent, run, ddl = _links_of_groups(_split(large), ["key", "bit2", "rest2"], None)
        out = out.union(sent.mapInArrow(run, ddl).select("a", "b"))
    return out


def _split(members: DataFrame) -> DataFrame:
    """Rows of large groups under variants of the other segment's halves as well: of the bits left
    to differ there, one half has one at most, so what is within the distance still meets."""
    half = _WIDTH // 2
    parts = []
    for s in range(SEGMENTS):
        other = (1 - s) * _WIDTH
        two = [_masked(F.col("fp"), other + h * half, half) for h in (0, 1)]
        mine = members.where(F.shiftright("key", _WIDTH + 5) == s)
        parts.append(mine.select("key", "fp", F.explode(F.concat(*two)).alias("v")).select("key", F.col("v.bit").alias("bit2"), F.col("v.rest").alias("rest2"), "fp"))
    return parts[0].union(parts[1])


def _labelled(docs: DataFrame) -> DataFrame:
    """doc_id, t1, fp, component (a fingerprint), component_id of every row."""
    scratch = Scratch(docs.sparkSession)
    # workers write the tables: each file that Spark writes costs its executor processes, see write_numbers
    fps = scratch.write_numbers(*_fingerprinted(docs))
    distinct = scratch.write_numbers(fps.groupBy("fp").agg(F.min("doc_id").alias("least")))
    comp = scratch.write_numbers(components(links(distinct)))
    # a component is named by a fingerprint; its smallest doc_id is what the result carries
    named = comp.join(distinct, comp.node == distinct.fp).groupBy("component").agg(F.min("least").alias("component_id"))
    of_fp = scratch.write_numbers(comp.join(named, "component").select(F.col("node").alias("fp"), "component", "component_id"))
    labels = distinct.join(of_fp, "fp", "left").select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("component_id", "least").alias("component_id"))
    scratch.drop(comp)
    return fps.join(labels, "fp").select("doc_id", "t1", "fp", "component", "component_id")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id of every row."""
    return _labelled(docs).select("doc_id", "fp", "component_id")


def hexed(fp):
    """A signed long as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def one_of_each(docs: DataFrame) -> DataFrame:
    """docs with one row of each component: of the smallest doc_id, rows without one last; of rows that
    share it, the one whose text has the smallest hash. So a doc_id that stands on texts of several
    components is kept in each where it comes first. Of rows equal in doc_id and text one stays."""
    found = Scratch(docs.sparkSession).write_numbers(_labelled(docs).select("doc_id", "t1", "component"))
    first = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1")
    keep = found.groupBy("component").agg(F.min(first).alias("m")).select(F.col("m.doc_id").alias("_kept_id"), F.col("m.t1").alias("_kept_text"))
    out = docs.join(keep, docs["doc_id"].eqNullSafe(keep["_kept_id"]) & (F.xxhash64(docs["text"]) == keep["_kept_text"]), "left_semi")
    if not found.groupBy("doc_id", "t1").count().where("count > 1").limit(1).count():
        return out
    # repeated rows are aggregated, with a part in each task, rather than gathered
    hashed = F.xxhash64(*[_quoted(c) for c in docs.columns if not _unhashable(docs, c)])
    copies = out.groupBy("doc_id", F.xxhash64("text").alias("_t1")).agg(F.min_by(F.struct(*map(_quoted, docs.columns)), hashed).alias("_row"))
    return copies.select("_row.*")


def _quoted(column: str) -> str:
    return f"`{column.replace('`', '``')}`"


def _unhashable(docs: DataFrame, column: str) -> bool:
    return "map<" in docs.schema[column].dataType.simpleString() or docs.schema[column].dataType.simpleString() == "variant"
