"""Near-duplicates, decontamination, repeats and neighbours against brute force and edge cases."""

import hashlib
import random
import re
from collections import Counter
from pathlib import Path

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidelog.llm import ann, common, decontaminate, simhash, suffix_dedup
from tidelog.llm.components import components

rnd = random.Random(11)
WORDS = ["".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(400)]


def text(n, r=rnd):
    return " ".join(r.choice(WORDS) for _ in range(n))


def roots(n, pairs):
    p = list(range(n))

    def find(i):
        while p[i] != i:
            p[i] = p[p[i]]
            i = p[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        if a != b:
            p[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def naive_fingerprint(t):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)])]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    for t in (None, "", " \t", "One", "one two", "ONE two\vThree É", text(500), "a b " * 70_000):
        assert simhash.fingerprint(t) == naive_fingerprint(t)


def test_fingerprints_use_sparks_hash(spark):
    h = spark.sql("select xxhash64('one two three') as h").first().h
    assert simhash.fingerprint("one two three") == h % (1 << 64)


@pytest.mark.parametrize("split_over", [4096, 20, 2])
def test_links_join_what_brute_force_joins(spark, split_over):
    r = random.Random(3)
    fps = set()
    for _ in range(3):
        centre = r.getrandbits(64)
        for _ in range(150):
            x = centre
            for _ in range(r.randint(0, 5)):
                x ^= 1 << r.randrange(64)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    want = roots(len(fps), zip(*np.nonzero(np.triu(near, 1))))
    signed = fps.view(np.int64).tolist()
    at = {v: i for i, v in enumerate(signed)}
    found = simhash.links(spark.createDataFrame([(v,) for v in signed], "fp long"), split_over)
    assert roots(len(fps), [(at[x.a], at[x.b]) for x in found.collect()]) == want


def test_near_duplicates(spark):
    base = text(300)
    rows = [(1, base), (2, base + " "), (3, base.upper()), (4, base.replace(" ", "  ", 1)), (5, text(200)), (6, None), (7, ""), (8, base), (8, base), (None, text(100)), (None, None)]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, fp int, _kept_id string")
    got = sorted(((r.doc_id, r.component_id) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 1), (4, 1), (5, 5), (6, 6), (7, 6), (8, 1), (8, 1), (None, None), (None, 6)], key=str)
    kept = simhash.one_of_each(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == [1, 5, 6]
    other = text(150)
    again = [(1, base), (3, other), (8, base), (8, base), (8, other + " x"), (9, text(120)), (9, text(90)), (9, None), (None, None), (None, text(80)), (None, base)]
    kept = simhash.one_of_each(spark.createDataFrame([(*r, {"k": 1}) for r in again], "doc_id long, text string, extra map<string,int>"))
    assert sorted([(r.doc_id, r.text) for r in kept.collect()], key=str) == sorted([(1, base), (3, other), *again[5:8], again[9]], key=str)
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.one_of_each(df.limit(0)).count() == 0


def test_components_of_a_long_path_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, 1000 + i) for i in range(1, 200)] + [(5, 5), (None, 3)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(301)) and all(got[1000 + i] == 1000 for i in range(200)) and len(got) == 501
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def naive_shingles(t, n):
    w = [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)}, len(w)


def test_decontamination_equals_brute_force(spark):
    items = [(i, text(rnd.randint(6, 40))) for i in range(30)] + [(90, "Two words"), (91, "only"), (92, ""), (93, None), (None, text(9))]
    docs = []
    for i in range(80):
        parts = [text(rnd.randint(0, 300))]
        if i % 3 == 0:
            w = items[i % 30][1].upper().split()
            cut = rnd.randint(0, len(w) // 3)
            parts += [", ".join(w[cut:]), text(50)]
        docs.append((i, " ".join(parts)))
    docs += [(200, "Two, WORDS!"), (201, None), (202, ""), (203, items[0][1]), (203, items[0][1]), (203, text(20)), (None, items[1][1])]
    df, bench = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, t1 int, item_id int"), spark.createDataFrame(items, "item_id long, text string")
    want = set()
    for d, t in docs:
        for i, b in items:
            n = min(5, naive_shingles(b, 1)[1])
            if n:
                mine, theirs = naive_shingles(b, n)[0], naive_shingles(t, n)[0]
                if len(mine & theirs) >= 0.8 * len(mine):
                    want.add((d, i, len(mine), len(mine & theirs)))
    got = {(r.doc_id, r.item_id, r.n_shingles, r.n_found) for r in decontaminate.contaminated(df, bench).collect()}
    assert got == want and (203, 0) in {g[:2] for g in got}
    clean = decontaminate.decontaminated(df, bench)
    bad = {w[0] for w in want}
    assert clean.columns == df.columns
    assert Counter(r.doc_id for r in clean.collect()) == Counter(d for d, t in docs if d not in bad or (d == 203 and t != items[0][1]))
    assert decontaminate.decontaminated(df, bench.limit(0)).count() == len(docs) and decontaminate.contaminated(df.limit(0), bench).count() == 0


def test_items_without_an_id_are_found(spark):
    words = text(12)
    items = spark.createDataFrame([(None, words), (1, text(12))], "item_id long, text string")
    docs = spark.createDataFrame([(1, f"so {words} it is"), (2, text(40)), (None, words)], "doc_id long, text string")
    got = {(r.doc_id, r.item_id, r.containment) for r in decontaminate.contaminated(docs, items).collect()}
    assert got == {(1, None, 1.0), (None, None, 1.0)}
    assert [r.doc_id for r in decontaminate.decontaminated(docs, items).collect()] == [2]


def test_joins_without_broadcasts_give_the_same(spark, monkeypatch):
    items = spark.createDataFrame([(i, text(20)) for i in range(20)], "item_id long, text string")
    docs = items.select(F.col("item_id").alias("doc_id"), F.concat(F.lit("so "), "text", F.lit(" it is")).alias("text"))
    monkeypatch.setattr(decontaminate, "BROADCAST_ROWS", 3)
    monkeypatch.setattr(decontaminate, "BROADCAST_BYTES", 3)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.contaminated(docs, items).collect()) == [(i, i) for i in range(20)]


def test_few_rows_are_written_to_few_files(spark, tmp_path, monkeypatch):
    """However many partitions shuffles have: each file costs executors several processes."""
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path / "between"))
    docs = spark.createDataFrame([(i, f"the {i} quick brown fox {i} jumps over {i}") for i in range(300)], "doc_id long, text string")
    held = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        items = docs.selectExpr("doc_id as item_id", "text")
        decontaminate.contaminated(docs, items).write.parquet(str(tmp_path / "out"))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("doc_id", "item_id").collect())) == [(i, i) for i in range(300)]
    files = {p.name: len(list(p.glob("part-*"))) for p in [*tmp_path.glob("between/*/*"), tmp_path / "out"]}
    assert files.pop("2") <= max(8, spark.sparkContext.defaultParallelism) and files == {"0": 1, "1": 1, "out": 1}


def test_a_phrase_that_many_share_makes_no_candidates(spark):
    stock = text(9)
    items = spark.createDataFrame([(i, f"{stock} {text(20)}") for i in range(500)], "item long, text string")
    whole = [r.text for r in items.where("item < 3").orderBy("item").collect()]
    docs = spark.createDataFrame([(i, f"{text(30)} {stock} {text(30)}") for i in range(60)] + [(100 + i, f"{text(400)} {w} {text(9)}") for i, w in enumerate(whole)], "doc_id long, text string")
    found = decontaminate.candidates(docs, decontaminate.signatures(items)).collect()
    assert sorted((r.doc_id, r.item) for r in found) == [(100, 0), (101, 1), (102, 2)]


def brute_repeats(texts, size=200):
    count = Counter(b[i : i + size] for b in texts for i in range(len(b) - size + 1))
    out = []
    for b in texts:
        covered = bytearray(len(b))
        for i in range(len(b) - size + 1):
            if count[b[i : i + size]] > 1:
                covered[i : i + size] = b"\1" * size
        kept = bytes(x for x, c in zip(b, covered) if not c)
        out.append((len(b), sum(covered), len(re.findall(b"\1+", bytes(covered))), hashlib.sha256(kept).hexdigest()))
    return out


def test_repeats_equal_brute_force(spark, monkeypatch):
    r = random.Random(3)
    base = "".join(r.choice("abcdé ") for _ in range(3000))
    texts = [base, base[500:1100], "x" * 900, None, "", base[:199], base[:200], base[1500:1702] + "q" * 250, "ab" * 300 + base[1000:1199], base[:700] + "Z" + base[701:1400], "same text " * 30, "same text " * 30]
    for _ in range(15):  # copies with a changed character here and there
        t = list(base[r.randrange(500) : 2500])
        for _ in range(r.randint(1, 12)):
            t[r.randrange(len(t))] = "#"
        texts.append("".join(t))
    want = sorted(brute_repeats([(t or "").encode() for t in texts]))
    df = spark.createDataFrame([(None if i == 3 else i // 2, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, rows string")
    for slice_bytes in (1 << 20, 700):  # the second cuts long texts in overlapping pieces
        monkeypatch.setattr(suffix_dedup, "_SLICE_BYTES", slice_bytes)
        assert sorted(tuple(x)[1:] for x in suffix_dedup.remove_repeats(df, suffix_dedup.DIGEST).collect()) == want
    full = suffix_dedup.remove_repeats(df.where("text = 'same text '"))
    assert full.count() == 0 and suffix_dedup.remove_repeats(df).where("octet_length(kept) > n_bytes").count() == 0


def test_repeats_are_found_with_few_tables_and_files(spark, tmp_path, monkeypatch):
    """Each file costs executors several processes; joins can still split a hot key."""
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(common.Scratch, "drop", lambda self, *tables: None)
    r = random.Random(4)
    base = "".join(r.choice("abcdé ") for _ in range(2000))
    texts = [base[i * 20 :] + base[: 300 - i] + "#" + base[500 - i : 900] for i in range(30)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    held = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        got = sorted(tuple(x)[1:] for x in suffix_dedup.remove_repeats(df, suffix_dedup.DIGEST).collect())
        keyed = df.selectExpr("doc_id as key")
        shared, own = (keyed.join(x, "key")._jdf.queryExecution().toString().count("Exchange hashpartitioning") for c in [keyed.groupBy("key").count()] for x in (c, suffix_dedup._dealt_anew(c, "key")))
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == sorted(brute_repeats([t.encode() for t in texts])) and own == shared + 1
    files = [len(list(tmp_path.glob(f"*/{i}/part-*"))) for i in range(13)]
    most = max(8, spark.sparkContext.defaultParallelism)
    assert not any(files[7:]) and all(files[:7]) and max(files[2], files[4], files[6]) <= most


def processes_begun(spark, path, run):
    """Commands of the processes that the JVM begins meanwhile."""
    jvm = spark._jvm
    recording = jvm.jdk.jfr.Recording()
    recording.enable("jdk.ProcessStart")
    recording.start()
    run()
    recording.stop()
    file = jvm.java.io.File(str(path)).toPath()
    recording.dump(file)
    recording.close()
    return [e.getString("command") for e in jvm.jdk.jfr.consumer.RecordingFile.readAllEvents(file)]


def test_repeats_write_tables_without_processes(spark, tmp_path):
    df = spark.createDataFrame([(i, "some text " * 30 + f"{i} " * 90) for i in range(20)], "doc_id long, text string")
    assert processes_begun(spark, tmp_path / "plain.jfr", lambda: df.write.parquet(str(tmp_path / "plain")))
    assert processes_begun(spark, tmp_path / "tables.jfr", lambda: suffix_dedup.remove_repeats(df)) == []


@pytest.mark.parametrize("kind", ["long", "string"])
def test_near_duplicates_write_tables_without_processes(spark, tmp_path, kind):
    df = spark.createDataFrame([(i, f"{i % 5} " * 9 + text(9) if i < 5 else "") for i in range(20)], "doc_id long, text string")
    df = df.withColumn("doc_id", F.col("doc_id").cast(kind))
    assert processes_begun(spark, tmp_path / "all.jfr", lambda: simhash.near_duplicates(df).collect()) == []
    assert processes_begun(spark, tmp_path / "one.jfr", lambda: simhash.one_of_each(df)) == []


@pytest.mark.parametrize("kind", ["double", "decimal(20,2)", "date", "interval day to second"])
def test_near_duplicates_keep_other_kinds_of_ids(spark, kind):
    of = {"date": "date_add(date'2020-01-01', cast(i as int))", "interval day to second": "make_dt_interval(cast(i as int))"}.get(kind, f"cast(i as {kind})")
    df = spark.createDataFrame([(i, "some words that are alike" if i else "") for i in range(3)], "i long, text string").selectExpr(f"{of} as doc_id", "text")
    ids = [r.doc_id for r in df.orderBy("doc_id").collect()]
    found = simhash.near_duplicates(df)
    assert found.schema["doc_id"].dataType == df.schema["doc_id"].dataType
    assert sorted((r.doc_id, r.component_id) for r in found.collect()) == [(ids[0], ids[0]), (ids[1], ids[1]), (ids[2], ids[1])]


def test_tables_of_numbers_are_whole(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_folder", lambda spark: str(tmp_path))
    monkeypatch.setattr(common, "_GROUP_BYTES", 100)
    df = spark.range(0, 1000, 1, 4).selectExpr("id", "if(id % 3 = 0, null, cast(id as int)) as n", "array(struct(id as a), struct(id + 1 as a)) as l").where("id < 250 or id >= 500")

    def twice(batches):
        for batch in batches:
            yield batch.select(["id"])
            yield batch.select(["id"])

    def failing(batches):
        for batch in batches:
            yield batch.select(["id"])
            raise ValueError("stopped")

    mounted = common.Scratch(spark)
    elsewhere = common.Scratch(spark)
    find = elsewhere._path

    class Store:
        getScheme = staticmethod(lambda: "store")

    elsewhere._path = lambda name: (find(name)[0], Store)
    for scratch in (mounted, elsewhere):
        out = scratch.write_numbers(df)
        assert out.dtypes == df.dtypes and sorted(out.collect()) == sorted(df.collect())
        assert sorted(r.id for r in scratch.write_numbers(df.where("id < 9"), twice, "id long").collect()) == sorted([*range(9)] * 2)
        assert scratch.write_numbers(df.limit(0)).count() == 0
    assert not [*tmp_path.rglob(".part-*.parquet-*")]
    with pytest.raises(Exception, match="stopped"):
        mounted.write_numbers(df, failing, "id long")
    assert not [*Path(mounted.folder).glob("3/part-*")] and spark.read.schema("id long").parquet(f"{mounted.folder}/3").count() == 0


def test_rank_pairs_find_the_same_starts(spark):
    r = random.Random(8)
    base = "".join(r.choice("abé ") for _ in range(900))
    texts = [base, base[100:520], "x" * 230, None, "ab" * 150, base[:199], base[300:500] + "q", base[300:500] + "z"]
    as_bytes = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + 200] for b in as_bytes for i in range(len(b) - 199))
    want = sorted((n, i) for n, b in enumerate(as_bytes) for i in range(len(b) - 199) if count[b[i : i + 200]] > 1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(x) for x in suffix_dedup.by_rank_pairs(df).collect()) == want
    assert suffix_dedup.by_rank_pairs(df.limit(0)).count() == 0


def test_names_are_of_the_bytes_alone():
    a, b = b"x" * 40 + b"0123456789" * 40, b"0123456789" * 40
    one, two = (suffix_dedup.names(np.frombuffer(t, np.uint8)) for t in (a, b))
    assert (one[0][40:] == two[0]).all() and (one[1][40:] == two[1]).all() and len(set(two[1][:10].tolist())) == 10


def brute_nearest(ids, x, k=10):
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        d[ids == ids[i]] = np.inf
        best = np.lexsort((ids, d))[:k]
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in best if d[j] < np.inf]
    return out


def test_recall_and_scores(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute_nearest(ids, x)
    got: dict[int, list] = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(g) == 10 for g in got.values())
    assert sum(len({v for v, _ in got[q]} & {v for v, _ in want[q]}) for q in want) >= 0.95 * 10 * len(want)
    place = {i: n for n, i in enumerate(ids)}
    assert all(s == pytest.approx(float(np.sqrt(((x[place[q]] - x[place[v]]) ** 2).sum())), abs=1e-12) for q, g in got.items() for v, s in g)


def test_a_full_radius_is_exact(spark):
    r = np.random.default_rng(5)
    x = r.normal(size=(700, 12)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<float>, rank int")
    got: dict[int, list] = {}
    for row in ann.nearest(df, recall=1).orderBy("query_id", "rank").collect():
        got.setdefault(row.query_id, []).append(row.vec_id)
    assert got == {q: [v for v, _ in g] for q, g in brute_nearest(np.arange(700), x.astype(float)).items()}


def clustered(rows, seed=3, size=64, each=100):
    r = np.random.default_rng(seed)
    return (np.repeat(r.normal(size=(rows // each, size)), each, 0) + 0.15 * r.normal(size=(rows, size))).astype(np.float32)


def test_lists_of_near_values_hold_all_codes_in_the_radius():
    for x, radius in ((clustered(3000), 20), (np.random.default_rng(1).normal(size=(900, 24)), 17)):
        model = ann.fit(x[:500].astype(float))
        codes = ann.encode(x, *model)
        block = ann.Block(np.arange(len(x)), np.ones(len(x), np.int64), x, codes)
        for q in range(0, len(x), 97):
            near, probed = block.within(codes[q], radius)
            assert near.tolist() == np.flatnonzero(np.bitwise_count(codes ^ codes[q]).sum(1) <= radius).tolist() and len(near) <= probed


def test_probed_rows_grow_slower_than_rows():
    """Of vectors that lie in groups, whose number grows with the rows."""
    probed = []
    for rows in (2_000, 8_000, 32_000):
        x = clustered(rows).astype(float)
        sample = x[np.random.default_rng(2).permutation(rows)[:2000]]
        model = ann.fit(sample)
        radius, codes = ann.fitted_radius(sample, model, -(-10 * 2000 // rows), ann.RECALL), ann.encode(x, *model)
        block = ann.Block(np.arange(rows), np.ones(rows, np.int64), x, codes)
        probed.append(np.mean([block.within(codes[q], radius)[1] for q in range(0, rows, rows // 40)]))
    assert probed[1] < 3 * probed[0] and probed[2] < 3 * probed[1] and probed[2] < 0.1 * 32_000, probed


def test_recall_on_groups_and_queries_far_from_all(spark):
    x = clustered(3000)
    x[100], x[200] = 40.0, -35.0
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>").repartition(7)
    got: dict[int, list] = {}
    for r in ann.nearest(df).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    want = brute_nearest(np.arange(3000), x.astype(float))
    assert all(len(g) == 10 for g in got.values()) and got.keys() == want.keys()
    assert sum(len(set(got[q]) & {v for v, _ in want[q]}) for q in want) >= 0.9 * 10 * len(want)
    assert all(got[q] == [v for v, _ in want[q]] for q in (100, 200))


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [None, 1.0]), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (100, [0.0, 1.0]), (9, []), (2, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted((r.query_id, r.rank, r.vec_id) for r in ann.nearest(df).collect())
    assert got == [(0, 1, 1), (0, 2, 2), (0, 3, 2), (0, 4, 100), (100, 1, 0), (100, 2, 1), (100, 3, 2), (100, 4, 2)]
    assert ann.nearest(df.limit(0)).count() == 0


def test_repeated_queries(spark):
    rows = [(i, [1.0, i / 10]) for i in range(1, 20)]
    equal = spark.createDataFrame([*rows, (100, [1.0, 0.0]), (100, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [(r.query_id, r.rank, r.vec_id) for r in ann.nearest(equal, recall=1).orderBy("rank").collect()] == [(100, i, i) for i in range(1, 11)]
    other = spark.createDataFrame([*rows, (100, [1.0, 0.0]), (100, [1.0, 2.0])], "vec_id long, embedding array<double>")
    got = sorted((r.rank, r.vec_id) for r in ann.nearest(other, recall=1).collect())
    assert got == sorted([(i, i) for i in range(1, 11)] + [(i, 20 - i) for i in range(1, 11)])


def test_pipeline_stages_against_brute_force(spark, tmp_path):
    import corpus_pipeline

    base = "the house and the garden of the king were in the middle of the town and all the people of the town came to see them "
    item = text(30)
    rows = [(i, base + text(60), "en", "s") for i in range(20)]
    rows += [(50, rows[3][1].upper(), "en", "s"), (51, base + text(20) + " " + item + " " + base, "en", "s"), (52, "12 34", "en", "s"), (53, base + "call +1 (988) 555-2485", "en", "s"), (54, None, None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    now, columns = spark.read.parquet(str(tmp_path / "documents.parquet")), docs.columns
    kept = []
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        now = stage(spark, now, str(tmp_path))
        now.write.parquet(str(tmp_path / f"stage{i}"))
        now = spark.read.parquet(str(tmp_path / f"stage{i}"))
        kept.append({r.doc_id for r in now.collect()})
        assert i == 4 or now.columns == columns
    everything = {r[0] for r in rows}
    assert kept == [everything - {52, 54}, everything - {50, 52, 54}] + [everything - {50, 51, 52, 54}] * 3
    hidden = spark.read.parquet(str(tmp_path / "stage3")).where("doc_id = 53").first().text
    assert "988" not in hidden and re.search(r"\+1 \([2-9]\d\d\) [2-9]\d\d-\d{4}$", hidden)
    assert {tuple(r) for r in corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "n_tokens").collect()} == {(r.doc_id, r.n_tokens) for r in now.collect()}


#: Names that operators use for columns of their own, and one that has to be quoted.
CLASHING = ["t1", "fp", "component", "component_id", "_kept_id", "_kept_text", "_t1", "_row", "_bad_id", "item", "h", "w", "n", "rank", "size", "key", "held_out", "a.b", "c`d"]


def test_pipeline_on_odd_rows_and_columns(spark, tmp_path):
    """Repeated ids and rows, null ids and columns of clashing names, then no rows at all."""
    import corpus_pipeline

    base = "the house and the garden of the king were in the middle of the town and all the people of the town came to see them "
    item, a, b, c = text(30), base + text(60), base + text(60), base + text(60)
    rows = [(1, a, "en"), (1, a, "en"), (1, b, "en"), (None, c, "en"), (None, c, None), (None, None, None), (2, "", None), (3, base + text(20) + " " + item, "en")]
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{x.replace('`', '``')}` string" for x in CLASHING)
    docs = spark.createDataFrame([(*r, None, None, *(f"{x}!" if r[0] else None for x in CLASHING)) for r in rows], schema)
    items = spark.createDataFrame([(1, item, "x"), (None, None, None)], "item_id long, text string, doc_id string")
    for name, wanted in (("some", Counter([(1, a), (1, b), (None, c)])), ("none", Counter())):
        folder = str(tmp_path / name)
        (docs if wanted else docs.limit(0)).write.parquet(f"{folder}/documents.parquet")
        (items if wanted else items.limit(0)).write.parquet(f"{folder}/benchmark.parquet")
        now = spark.read.parquet(f"{folder}/documents.parquet")
        for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
            stage(spark, now, folder).write.parquet(f"{folder}/{i}")
            now = spark.read.parquet(f"{folder}/{i}")
            if i < 4:
                assert now.columns == docs.columns
                assert all(r["c`d"] == ("c`d!" if r.doc_id else None) for r in now.collect())
            if i == 3:
                assert Counter((r.doc_id, r.text) for r in now.collect()) == wanted
        assert now.count() == wanted.total() == corpus_pipeline.run(spark, folder).count()


def test_stages_write_few_files_of_many(spark, tmp_path):
    """Each costs executors processes. Rows of unknown size stay in the tasks they are in."""
    import corpus_pipeline

    rows = [(i, ["en", "de"][i % 2], ["the cat and the dog ", "der Hund und die Katze "][i % 2] * 9 + f"{i} " + text(40)) for i in range(300)]
    held = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.files.maxPartitionBytes": "4k", "spark.sql.files.openCostInBytes": "4k"}
    before = {k: spark.conf.get(k) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
        docs.repartition(60).write.parquet(str(tmp_path / "documents.parquet"))
        spark.createDataFrame([(1, text(30))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
        read = spark.read.parquet(str(tmp_path / "documents.parquet"))
        assert read.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
        files, kept = {}, {}
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, read, str(tmp_path)).write.parquet(str(tmp_path / name))
            files[name] = len([*(tmp_path / name).glob("part-*")])
            kept[name] = spark.read.parquet(str(tmp_path / name)).count()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert max(files.values()) <= 2 * spark.sparkContext.defaultParallelism
    assert {kept[n] for n in ("decontamination", "pii", "bpe")} == {300}
    assert kept["language_id"] == corpus_pipeline.identify_language(spark, docs, str(tmp_path)).count()
    assert kept["simhash_near_dedup"] == corpus_pipeline.drop_near_duplicates(spark, docs, str(tmp_path)).count()
    many = spark.range(0, 100, 1, 50)
    assert common.by_size(many, docs).rdd.getNumPartitions() == 50 and common.by_size(many.limit(0), docs.limit(0)).count() == 0
