"""Every query with a SQL text equals it on the smallest data folder."""

import duckdb
import pytest

from check_oracle import rows_of
from covermetrics.plans.registry import Book, all_plans
from covermetrics.sources.book import BASE_TABLES

FOLDER = "/root/testdata/sf0.001"
PLANS = all_plans()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in BASE_TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{FOLDER}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", list(PLANS))
def test_query_matches_sql(spark, con, name):
    p = PLANS[name]
    df = p.build(Book(spark, FOLDER))
    got, got_columns = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert len(set(df.columns)) == len(df.columns)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan
    if p.sql is None:
        assert got
        return
    rel = con.execute(p.sql)
    columns = [d[0] for d in rel.description]
    want, want_columns = rows_of(columns, rel.fetchall())
    assert got_columns == want_columns
    assert got == want
