"""The registered queries over the smallest tables: their SQL where there is some, else columns and counts."""

import os
from collections import Counter

import duckdb
import pytest

from tidelog.llm import queries

DATA = "/root/testdata/sf0.001"
ROWS = {
    "op2_simhash_near_dedup": ("documents", ["doc_id", "fingerprint", "component_id"]),
    "op4_html_main_text": ("pages", ["page_id", "url", "text", "n_chars"]),
    "op5_pii_pseudonyms": ("documents", ["doc_id", "text"]),
    "op7_bpe": ("documents", ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]),
    "op9_suffix_dedup": ("documents", ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]),
    "op10_language_id": ("documents", ["doc_id", "held_out", "lang_pred", "score"]),
}


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql_gives_the_same(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        path = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path + '/*' if os.path.isdir(path) else path}')")
    df = queries.QUERIES[name](spark, DATA)
    found = con.execute(queries.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(df.columns) == sorted(names)
    assert Counter(tuple(r[n] for n in sorted(names)) for r in df.collect()) == Counter(tuple(r[names.index(n)] for n in sorted(names)) for r in found.fetchall())


@pytest.mark.parametrize("name", sorted(ROWS))
def test_a_row_for_each_row(spark, name):
    table, columns = ROWS[name]
    df = queries.QUERIES[name](spark, DATA)
    assert df.columns[: len(columns)] == columns
    key = columns[0]
    assert sorted(r[key] for r in df.select(key).collect()) == sorted(r[key] for r in spark.read.parquet(f"{DATA}/{table}.parquet").select(key).collect())


def test_all_are_registered():
    import __spark_entry__ as entry

    assert {f"op{n}" for n in range(1, 11)} | {"pipeline"} <= {n.split("_")[0] for n in entry.queries()}
