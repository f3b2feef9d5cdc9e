"""Queries with SQL against it, in DuckDB over the same tables."""

import glob
import os

import duckdb
import pytest

from stowage.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_agrees_with_sql(spark, oracle, name):
    made = QUERIES[name](spark, SF)
    columns = sorted(made.columns)
    rows = sorted(str([r[c] for c in columns]) for r in made.collect())
    found = oracle.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    assert rows == sorted(str([r[names.index(c)] for c in columns]) for r in found.fetchall())


def test_ten_queries():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 11))


def test_secrets_in_texts_agree_with_sql(spark, tmp_path):
    """More secrets than the tables have."""
    texts = ['token = "abcdefgh1"', "é password:short PASSWORD: longenough= ", "AKIA" + "A1" * 8 + " AKIA", "x" + "0af" * 15 + "g", "token=secret= abcdefgh1", "token=token=abcdefgh api-key=x apikey='zzzzzzzz'", "-----BEGIN EC PRIVATE KEY-----", "ghp_" + "a" * 36 + " xoxb-1234567890-abcdef AIza" + "b" * 35, None, "", "a\nsecret:\n abcdefghijk\tToKeN:abcdefgh"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = sorted(tuple(r) for r in QUERIES["op9_secret_scan"](spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    want = sorted(con.execute(f"SELECT doc_id, n_assign, n_access, n_hex, base_sha256, spans FROM ({ORACLES['op9_secret_scan']})").fetchall())
    assert rows == want and sum(bool(r[5]) for r in rows) >= 7
