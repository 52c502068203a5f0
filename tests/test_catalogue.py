"""Every catalogue query against its SQL on the smallest tables."""

import os
from collections import Counter

import duckdb
import pytest

from tidelog.plans import catalogue

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    return con


@pytest.mark.parametrize("name", sorted(catalogue.ORACLES))
def test_same_rows(spark, db, name):
    df = catalogue.QUERIES[name](spark, DATA)
    found = db.execute(catalogue.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r[n] for n in sorted(names)) for r in df.collect()) == Counter(tuple(r[names.index(n)] for n in sorted(names)) for r in found.fetchall())


def test_varint_size_of_large_keys(spark, tmp_path):
    """Rows whose cube isn't a 64-bit number are kept, without x and bytes; all others are those of the SQL."""
    edges = [k + d for k in (-2097152, 2097152) for d in (-2, -1, 0, 1, 2)]
    keys = [None, 0, 1, -1, 149_999, 8_999_999, -(1 << 63), (1 << 63) - 1, *edges]
    cubes = {k: (k if k % 2 == 0 else -k) * k * k for k in keys if k is not None}
    fitting = [k for k in keys if k is None or -(1 << 63) <= cubes[k] < 1 << 63]
    assert -2097152 in fitting and 2097151 in fitting and len(fitting) == len(keys) - 8
    spark.createDataFrame([(k,) for k in keys], "o_orderkey long").write.parquet(str(tmp_path / "orders.parquet"))
    got = [tuple(r) for r in catalogue.QUERIES["varint_size"](spark, str(tmp_path)).select("o_orderkey", "x", "bytes").collect()]
    con = duckdb.connect()
    con.execute(f"CREATE VIEW orders AS SELECT * FROM read_parquet('{tmp_path}/orders.parquet/*.parquet') WHERE o_orderkey IS NULL OR o_orderkey BETWEEN {min(fitting[1:])} AND {max(fitting[1:])}")
    assert Counter(got) == Counter(con.execute(catalogue.ORACLES["varint_size"]).fetchall()) + Counter((k, None, None) for k in keys if k not in fitting)


def test_entry_has_all():
    import __spark_entry__ as entry

    assert set(catalogue.QUERIES) <= set(entry.queries())
    assert set(catalogue.ORACLES) <= set(entry.oracle_sql())


def test_entry_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
