"""The registry: every query runs on the least tables, and those with SQL agree with it."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from causalith.queries import ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
FAST = ["ate_naive", "ate_naive_clustered", "ate_by_naive", "ate_pool", "balance_raw", "frame_summary", "identify", "validate", "graphs", "dseparated", "iv", "frontdoor", "did", "event_study", "rmst", "rmtl", "ate_in_sql", "devices"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return con


@pytest.mark.parametrize("name", FAST)
def test_same_as_sql(spark, duck, name):
    got = QUERIES[name](spark, SF)
    want = duck.execute(ORACLE_SQL[name])
    names = [c[0] for c in want.description]
    assert sorted(names) == sorted(got.columns)
    assert sorted(map(str, (tuple(r[c] for c in names) for r in got.collect()))) == sorted(map(str, want.fetchall()))


def test_registry(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() == 1
