"""Every driver query against its SQL, in DuckDB over the same tables."""

import glob
import math
import os

import duckdb
import pytest

from stowage.plans import codec_queries, file_queries  # noqa: F401
from stowage.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return "null"
    if isinstance(value, (list, tuple)):
        return str([plain(x) for x in value])
    return repr(float(value)) if isinstance(value, float) else str(value)


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_agrees_with_sql(spark, oracle, name):
    made = QUERIES[name](spark, SF)
    columns = sorted(made.columns)
    rows = sorted([plain(r[c]) for c in columns] for r in made.collect())
    found = oracle.execute(ORACLES[name])
    names = [d[0] for d in found.description]
    want = sorted([plain(r[names.index(c)]) for c in sorted(names)] for r in found.fetchall())
    assert columns == sorted(names)
    assert rows == want
