"""Every registered query with SQL against DuckDB on the smallest tables; the rest runs and has columns."""

import glob
import math
import os

import duckdb
import pytest

import __spark_entry__ as entry
from cellweave.operators import tracking
from cellweave.plans import tracking as plans
from cellweave.session import scope

DATA = os.environ.get("CELLWEAVE_TESTDATA", "/root/testdata/sf0.001")
QUERIES, SQL = entry.queries(), entry.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS FROM '{f}'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows_as_sql(spark, con, name):
    result = con.execute(SQL[name])
    columns = [c[0] for c in result.description]
    want = sorted(tuple(map(plain, r)) for r in result.fetchall())
    with scope():
        df = QUERIES[name](spark, DATA)
        assert sorted(columns) == sorted(df.columns)
        assert sorted(tuple(plain(r[c]) for c in columns) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_queries_without_sql_run_and_have_columns(spark, name):
    with scope():
        df = QUERIES[name](spark, DATA)
        assert df.columns and len(set(df.columns)) == len(df.columns) and df.count() > 0


def test_sql_belongs_to_queries():
    assert set(SQL) <= set(QUERIES)
    assert entry.entry


def test_every_candidate_is_made_and_has_features(spark):
    made = QUERIES["candidates_topk"](spark, DATA)
    keys = ["dataset_id", "t", "pair_id", "sample_rank"]
    n = {(r["dataset_id"], r["t"]): r["count"] for r in plans._cells(spark, DATA).groupBy("dataset_id", "t").count().collect()}
    got = {(r["dataset_id"], r["t"]): r["count"] for r in made.groupBy("dataset_id", "t").count().collect()}
    want = {(d, t): min(16, tracking.count_candidates(k, n[d, t + 1])) for (d, t), k in n.items() if (d, t + 1) in n}
    assert got == {k: v for k, v in want.items() if v} and max(got.values()) > 4
    wanted = made.where("ops_json <> '[]'").select(keys).collect()
    assert sorted(map(tuple, wanted)) == sorted(map(tuple, QUERIES["candidate_features"](spark, DATA).select(keys).collect()))
