"""Benchmark decontamination: which documents hold at least a given share of a test item's word shingles.

Size-partitioned MinHash containment search, in DataFrame functions alone. Items are partitioned by
size, that is their number of distinct shingles, in powers of two. An item's signature are its k
smallest shingle hashes (bottom-k MinHash), k fixed for the partition: what a document may lack of the
largest size in it, one more, and EXTRA of the smallest size. A document that holds the wanted share
of an item lacks only so many of its shingles, so of the signature it holds the rest, however long the
document: the search misses nothing. Documents that hold fewer aren't candidates, so a phrase that many
items and documents share yields none unless it's a large part of an item. Documents smaller than the wanted share of a partition's
smallest item aren't probed with it. Candidates are verified by the exact share of the item's
shingles, compared as strings. Documents carry no signatures: of a long one, a bounded sample
of shingles rarely holds one of a short item's.

Words are maximal runs of letters and digits in lower case. Items of fewer than WORDS words are one
shingle of all their words and are sought among the documents' shingles of that width.

Signatures are broadcast if there are at most BROADCAST_ROWS, else joined by a shuffle on the hash; so
are candidates, and items if their texts have at most BROADCAST_BYTES. Texts are read again for the
candidates only. Items, candidates and results are few beside the documents: they are written by as
many tasks as their size asks for, not by one for each shuffle partition, since every file costs
processes (Hadoop forks several for each where it lacks its native library).

Defined results: items without words match nothing, null texts hold nothing; one row for each
doc_id and item_id whatever rows repeat (the largest share of equal ids, null ids among them); empty
tables give empty results; texts of any length are searched whole; ties don't occur; columns besides
doc_id, item_id and text aren't read, and decontaminated() keeps them whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch

THRESHOLD = 0.8
WORDS = 5
#: Members of a signature that a document must hold beyond the first, as a share of the smallest size.
EXTRA = 0.5
#: What may be broadcast: rows of signatures or candidates, some 40 bytes each, and bytes of items' texts.
BROADCAST_ROWS = 500_000
BROADCAST_BYTES = 16 << 20
#: What one task writes: bytes of items' texts, rows of the result.
ITEM_BYTES = 4 << 20
RESULT_ROWS = 50_000
_NOT_WORD = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _NOT_WORD), "")


def _let(value: Column, make) -> Column:
    """make(value), with value computed once however often make names it: the optimizer would write
    it out in every place, within lambdas too."""
    return F.transform(F.array(value), make)[0]


def _starts(words_: Column, width: int) -> Column:
    return F.when(F.size(words_) >= width, F.sequence(F.lit(0), F.size(words_) - width)).otherwise(F.array().cast("array<int>"))


def hashes(words_: Column, width: int) -> Column:
    return F.transform(_starts(words_, width), lambda i: F.xxhash64(*[F.get(words_, i + k) for k in range(width)]))


def shingles(words_: Column, width: int) -> Column:
    return F.transform(_starts(words_, width), lambda i: F.array_join(F.slice(words_, i + 1, width), " "))


def _by_width(words_: Column, width: Column, widest: int, make) -> Column:
    """make(words, width) for a width that differs from row to row."""
    out = make(words_, widest)
    for w in range(1, widest):
        out = F.when(width == w, make(words_, w)).otherwise(out)
    return out


def signatures(items: DataFrame, threshold: float = THRESHOLD, width: int = WORDS, extra: float = EXTRA) -> DataFrame:
    """item, width, size, least_size, need, h: the bottom-k signature of each item(item, text), a row per
    hash; need is how many of its members a document that fits holds."""
    by_item = _let(words(F.col("text")), lambda w: F.struct(F.least(F.size(w), F.lit(width)).alias("width"), F.array_sort(F.array_distinct(_by_width(w, F.least(F.size(w), F.lit(width)), width, hashes))).alias("h")))
    cut = items.select("item", by_item.alias("x")).select("item", "x.width", "x.h").where(F.size("h") > 0)
    cut = cut.withColumn("size", F.size("h"))
    lower = F.pow(F.lit(2), F.floor(F.log2(F.col("size")))).cast("int")
    lacking = lambda size: F.floor(F.lit(1 - threshold) * size + F.lit(1e-9)).cast("int")
    cut = cut.withColumn("h", F.slice("h", 1, lacking(2 * lower - 1) + 1 + F.floor(lower * F.lit(extra)).cast("int")))
    need = F.greatest(F.lit(1), F.size("h") - lacking(F.col("size")))
    return cut.select("item", "width", "size", F.ceil(F.lit(threshold) * lower - F.lit(1e-9)).cast("int").alias("least_size"), need.alias("need"), F.explode("h").alias("h"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """df, to be broadcast if it's known to be small."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def candidates(docs: DataFrame, signed: DataFrame, width: int = WORDS) -> DataFrame:
    """doc_id, t1 (hash of the text), item of documents that hold as many members as they need."""
    stats = {r["width"]: r["count"] for r in signed.groupBy("width").count().collect()}  # at most `width` rows
    texts = docs.select("doc_id", F.xxhash64("text").alias("t1"), words(F.col("text")).alias("w"))
    out = None
    for w in sorted(stats):
        probed = texts.select("doc_id", "t1", F.size("w").alias("n"), F.explode(F.array_distinct(hashes(F.col("w"), w))).alias("h"))
        part = _small(signed.where(F.col("width") == w).select("item", "least_size", "need", "h"), stats[w])
        near = probed.join(part, "h").where(F.col("n") - (w - 1) >= F.col("least_size"))
        # all shingles of a row are in one task, so the counts are made before the shuffle
        near = near.groupBy("doc_id", "t1", "item").agg(F.count("*").alias("held"), F.first("need").alias("need")).where("held >= need").drop("held", "need")
        out = near if out is None else out.union(near)
    if out is None:
        out = docs.select("doc_id", F.lit(0).cast("long").alias("t1"), F.lit(0).cast("long").alias("item")).limit(0)
    return out


def _text_bytes(items: DataFrame) -> int:
    return items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]


def _contained(docs: DataFrame, items: DataFrame, threshold: float, width: int) -> tuple[DataFrame, int]:
    """doc_id, t1, item (hash of its text), n_shingles, n_found of every document and item that fit;
    the number of candidates."""
    scratch = Scratch(docs.sparkSession)
    texts = items.select(F.xxhash64("text").alias("item"), "text").distinct()
    items = scratch.write(texts.coalesce(1 + _text_bytes(items) // ITEM_BYTES))
    signed = scratch.write(signatures(items, threshold, width))
    # how many there are isn't known yet: no more files than tasks run at once
    found = scratch.write(candidates(docs, signed, width).coalesce(max(8, docs.sparkSession.sparkContext.defaultParallelism)))
    # the shingles of each item, made once
    parts = _let(words(F.col("text")), lambda w: F.struct(F.least(F.size(w), F.lit(width)).alias("width"), F.array_distinct(_by_width(w, F.least(F.size(w), F.lit(width)), width, shingles)).alias("mine")))
    held = items.select("item", parts.alias("x")).select("item", "x.width", "x.mine")
    if _text_bytes(items) <= BROADCAST_BYTES:
        held = F.broadcast(held)
    n = found.count()
    found_rows = _small(found.select(F.col("doc_id").alias("_doc"), F.col("t1").alias("_t1"), "item"), n)
    texts = docs.select("doc_id", F.xxhash64("text").alias("t1"), "text")
    near = texts.join(found_rows, texts["doc_id"].eqNullSafe(found_rows["_doc"]) & (texts["t1"] == found_rows["_t1"])).select("doc_id", "t1", "text", "item").join(held, "item")
    theirs = _let(words(F.col("text")), lambda w: _by_width(w, F.col("width"), width, shingles))
    near = near.select("doc_id", "t1", "item", F.size("mine").alias("n_shingles"), F.size(F.array_intersect("mine", theirs)).alias("n_found"))
    return near.where(F.col("n_found") >= F.col("n_shingles") * F.lit(threshold) - F.lit(1e-9)), n


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WORDS) -> DataFrame:
    """doc_id, item_id, n_shingles, n_found, containment."""
    ids = items.select(F.xxhash64("text").alias("item"), "item_id").distinct()
    near, n = _contained(docs, items, threshold, width)
    named = near.join(ids, "item")
    best = named.groupBy("doc_id", "item_id").agg(F.max(F.struct("n_found", "n_shingles")).alias("m")).coalesce(1 + n // RESULT_ROWS)
    return best.select("doc_id", "item_id", F.col("m.n_shingles").cast("long").alias("n_shingles"), F.col("m.n_found").cast("long").alias("n_found"), (F.col("m.n_found") / F.col("m.n_shingles")).alias("containment"))


def decontaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WORDS) -> DataFrame:
    """The rows of docs that hold no item."""
    near, _ = _contained(docs, items, threshold, width)
    bad = near.select(F.col("doc_id").alias("_bad_id"), "t1").distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad["_bad_id"]) & (F.xxhash64(docs["text"]) == bad["t1"]), "left_anti")


#: The same rows by counting every shingle.
ORACLE = r"""
WITH dw AS (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM documents),
iw AS (SELECT item_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark),
items AS (SELECT DISTINCT item_id, least(5, len(w)) AS width, array_to_string(w[i : i + least(5, len(w)) - 1], ' ') AS s
          FROM (SELECT item_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM iw WHERE len(w) > 0)),
widths AS (SELECT DISTINCT width FROM items),
docs AS (SELECT DISTINCT doc_id, text, width, array_to_string(w[i : i + width - 1], ' ') AS s
         FROM (SELECT doc_id, text, w, width, unnest(range(1, len(w) - width + 2)) AS i FROM dw, widths WHERE len(w) >= width)),
sizes AS (SELECT item_id, count(*) AS n FROM items GROUP BY item_id),
found AS (SELECT doc_id, text, item_id, count(*) AS hits FROM docs JOIN items USING (width, s) GROUP BY doc_id, text, item_id)
SELECT doc_id, item_id, max(n) AS n_shingles, max(hits) AS n_found, max(hits) / max(n) AS containment
FROM found JOIN sizes USING (item_id) WHERE hits >= n * 0.8 - 1e-9 GROUP BY doc_id, item_id
"""
