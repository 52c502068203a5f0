"""Approximate nearest neighbours by multi-index hashing of learned rotated binary codes.

Codes: ROTATIONS orthogonal rotations of the centred vectors, each turned towards its signs by
iterative quantization on a bounded sample, give a bit per component and rotation. Codes are cut
into substrings of PART bits, each with an inverted list per value. Two codes within a radius agree
in one of m substrings up to floor(radius / m) bits, so a query probes in each substring the lists of
values that near and finds every code within the radius; these are checked on the whole code, then
ranked by the exact distance. The radius is the one within which RECALL of the sample's own nearest
neighbours lie: of a sample row the nearest k in as many rows as the table has, which is one at least,
so a small sample errs on the safe side.

The index is dealt in blocks of rows. A block's index is built once; then all queries pass it, streamed.
A query that finds fewer than K rows within its radius in the whole table searches once more
without a radius, so no answer is short. No list is capped.

Defined results: vectors that are null, zero, of another length than most of the sample, or hold
null or non-finite components take no part; a query's own row isn't a candidate, repeated rows of
its vec_id neither; other repeated rows are candidates of their own, but are held and compared once;
ties go to the smaller vec_id; rows without vec_id take no part; rows of equal vec_id and vector ask
once, an id with several vectors has a ranking for each of them; an empty table gives an empty result;
columns besides vec_id and embedding aren't read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

K = 10
QUERY_EVERY = 100
#: Rows that the rotations and the radius are fitted on: the bound of the sample. So many of them ask.
SAMPLE_ROWS = 4000
SAMPLE_QUERIES = 400
ROTATIONS = 2
#: Share of the sample's nearest neighbours that the radius takes in; measured recall in the README.
RECALL = 0.98
PART = 16
INDEX_BLOCK = 16_384
#: Queries whose distances to a block are held at a time.
QUERY_BLOCK = 256
_ITERATIONS = 30


def fit(sample: np.ndarray, rotations: int = ROTATIONS, seed: int = 7) -> tuple[np.ndarray, np.ndarray]:
    """The mean and, side by side, the rotations: iterative quantization from random starts."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(0) if len(sample) else np.zeros(sample.shape[1])
    x = sample - mean
    out = []
    for _ in range(rotations):
        r, _ = np.linalg.qr(rng.normal(size=(x.shape[1], x.shape[1])))
        for _ in range(_ITERATIONS if len(x) > x.shape[1] else 0):
            signs = np.where(x @ r >= 0, 1.0, -1.0)
            u, _, v = np.linalg.svd(x.T @ signs)
            r = u @ v
        out.append(r)
    return mean, np.concatenate(out, 1)


def encode(vectors: np.ndarray, mean: np.ndarray, rotation: np.ndarray) -> np.ndarray:
    """Codes as rows of 16-bit substrings, the last one padded with zeros."""
    bits = (vectors - mean) @ rotation >= 0
    bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % PART)))
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint16)


def _apart(queries: np.ndarray, codes: np.ndarray) -> np.ndarray:
    return np.bitwise_count(queries ^ codes).sum(-1, dtype=np.int64)


def fitted_radius(sample: np.ndarray, model: tuple[np.ndarray, np.ndarray], k: int, recall: float) -> int:
    """Bits within which so many of the sample's k nearest neighbours lie; all bits if none has any."""
    bits = model[1].shape[1]
    codes, apart = encode(sample, *model), []
    for i in range(min(len(sample), SAMPLE_QUERIES)):
        d = ((sample - sample[i]) ** 2).sum(1)
        d[i] = np.inf
        near = np.argsort(d, kind="stable")[: min(k, len(sample) - 1)]
        apart.append(_apart(codes[near], codes[i]))
    apart = np.sort(np.concatenate(apart)) if apart else np.zeros(0, np.int64)
    return int(apart[min(len(apart) - 1, int(np.ceil(recall * len(apart))))]) if len(apart) else bits


class Block:
    """The index of some rows: for each substring, the values that occur, and the rows of each of them."""

    def __init__(self, ids: np.ndarray, copies: np.ndarray, vectors: np.ndarray, codes: np.ndarray):
        self.ids, self.copies, self.vectors, self.codes = ids, copies, vectors, codes
        self.lists = []
        for j in range(codes.shape[1]):
            values, of, counts = np.unique(codes[:, j], return_inverse=True, return_counts=True)
            self.lists.append((values, np.argsort(of, kind="stable"), np.r_[0, np.cumsum(counts)]))

    def within(self, query: np.ndarray, radius: int) -> tuple[np.ndarray, int]:
        """The rows whose codes differ from the query's in radius bits at most, and how many were probed."""
        each, seen = radius // len(self.lists), np.zeros(len(self.ids), bool)
        for j, (values, rows, begin) in enumerate(self.lists):
            near = np.flatnonzero(np.bitwise_count(values ^ query[j]) <= each)
            sizes = begin[near + 1] - begin[near]
            # the places of all rows on the lists that are probed
            seen[rows[np.arange(sizes.sum()) + np.repeat(begin[near] - np.r_[0, np.cumsum(sizes)][:-1], sizes)]] = True
        probed = np.flatnonzero(seen)
        return probed[_apart(self.codes[probed], query) <= radius], len(probed)

    def search(self, query_id: int, vector: np.ndarray, code: np.ndarray, k: int, radius: int | None) -> tuple[np.ndarray, np.ndarray]:
        """The rows nearest to a query among those within the radius, or all, and their distances; at
        least all that are among its k nearest, whatever copies they have."""
        rows = np.arange(len(self.ids)) if radius is None else self.within(code, radius)[0]
        rows = rows[self.ids[rows] != query_id]
        d = np.sqrt(((self.vectors[rows] - vector) ** 2).sum(1))
        best = np.lexsort((self.ids[rows], d))[:k]
        return rows[best], d[best]


def _valid(embeddings: DataFrame) -> DataFrame:
    """vec_id, embedding, copies."""
    e = F.col("embedding")
    if embeddings.schema["embedding"].dataType.simpleString() not in ("array<float>", "array<double>"):
        embeddings = embeddings.withColumn("embedding", e.cast("array<double>"))
    bad = F.exists(e, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(F.col("vec_id").isNotNull() & e.isNotNull() & ~bad & F.exists(e, lambda x: x != 0))
    return rows.groupBy("vec_id", "embedding").agg(F.count("*").alias("copies"))


_FOUND = "query_id long, asked long, vec_id long, score double, copies long"


def _searched(rows: DataFrame, asking: DataFrame, blocks: int, shared, k: int, radius: int | None) -> DataFrame:
    """The k nearest rows of each query in each block, within the radius if there is one."""

    def run(batches):
        model = shared.value
        last, held, index = None, [], None

        def built() -> Block:
            ids, copies = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            vectors = np.concatenate([x[2] for x in held])
            return Block(ids, copies, vectors, encode(vectors, *model))

        for batch in batches:
            number, asks = np.asarray(batch.column("block")), np.asarray(batch.column("asks").cast(pa.int8()))
            edges = np.flatnonzero((number[1:] != number[:-1]) | (asks[1:] != asks[:-1])) + 1 if len(number) else ()
            for s, e in zip([0, *edges], [*edges, len(number)]) if len(number) else ():
                ids, marks = np.asarray(batch.column("vec_id"))[s:e], np.asarray(batch.column("mark"))[s:e]
                vectors = np.asarray(batch.column("embedding").slice(s, e - s).flatten(), np.float64).reshape(e - s, -1)
                if number[s] != last:
                    last, held, index = number[s], [], None
                if not asks[s]:
                    held.append((ids, marks, vectors))
                    continue
                if not held and index is None:
                    continue
                if index is None:
                    index, held = built(), []
                for q in range(0, e - s, QUERY_BLOCK):
                    codes = encode(vectors[q : q + QUERY_BLOCK], *model)
                    found = [index.search(int(ids[q + i]), vectors[q + i], codes[i], k, radius) for i in range(len(codes))]
                    of = np.repeat(np.arange(q, q + len(codes)), [len(r) for r, _ in found])
                    at = np.concatenate([r for r, _ in found])
                    cols = [ids[of], marks[of], index.ids[at], np.concatenate([d for _, d in found]), index.copies[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["query_id", "asked", "vec_id", "score", "copies"])

    # the column mark has a row's copies, or a hash that tells a query's vectors apart
    dealt = rows.select(F.pmod(F.xxhash64("vec_id", "embedding"), F.lit(blocks)).alias("block"), F.lit(False).alias("asks"), "vec_id", F.col("copies").alias("mark"), "embedding")
    every_block = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))).alias("block")
    asked = asking.select(every_block, F.lit(True).alias("asks"), "vec_id", F.xxhash64("embedding").alias("mark"), "embedding")
    return dealt.unionByName(asked).repartition(blocks, "block").sortWithinPartitions("block", "asks").mapInArrow(run, _FOUND)


def nearest(embeddings: DataFrame, k: int = K, every: int = QUERY_EVERY, recall: float = RECALL, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """query_id, rank, vec_id, score for every row whose vec_id is divisible by `every`.

    With a recall of 1 nothing is left out: all rows are compared.
    """
    spark = embeddings.sparkSession
    scratch = Scratch(spark)
    rows = scratch.write(_valid(embeddings))
    chosen = [r.embedding for r in rows.orderBy(F.xxhash64("vec_id"), "vec_id", F.xxhash64("embedding")).limit(sample_rows).select("embedding").collect()]
    sizes = [len(v) for v in chosen]
    width = max(set(sizes), key=lambda n: (sizes.count(n), n)) if sizes else 1
    sample = np.array([v for v in chosen if len(v) == width], np.float64).reshape(-1, width)
    rows = rows.where(F.size("embedding") == width)
    total = rows.count()
    model = fit(sample)
    # k of all rows are as near as so many of the sample
    radius = None if recall >= 1 else fitted_radius(sample, model, max(1, -(-k * len(sample) // max(1, total))), recall)
    shared = spark.sparkContext.broadcast(model)  # 64 KB a rotation and 64 components
    asking = rows.where(F.col("vec_id") % every == 0)
    blocks = max(1, -(-total // INDEX_BLOCK))
    found = scratch.write(_searched(rows, asking, blocks, shared, k, radius))
    if radius is not None:
        enough = found.groupBy("query_id", "asked").agg(F.sum("copies").alias("n")).where(F.col("n") >= k)
        short = asking.join(enough, (asking.vec_id == enough.query_id) & (F.xxhash64(asking.embedding) == enough.asked), "left_anti")
        if short.limit(1).count():
            enough = enough.select("query_id", "asked")
            found = found.join(enough, ["query_id", "asked"], "left_semi").unionByName(_searched(rows, short, blocks, shared, k, None))
    order = Window.partitionBy("query_id", "asked").orderBy("score", "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    each = ranked.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k).cast("long")))))
    ranked = each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")
