"""Every registered query against its SQL in DuckDB, over whole tables."""

import math

import duckdb
import pytest

from skein.plans.queries import oracle_sql, queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    yield con
    con.close()


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    return v.replace(tzinfo=None) if hasattr(v, "tzinfo") else v


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_equals_sql(spark, sf, duck, name):
    d = queries()[name](spark, sf)
    cols = sorted(d.columns)
    want = duck.sql(oracle_sql()[name])
    assert cols == sorted(want.columns)
    at = [want.columns.index(c) for c in cols]
    a = sorted(repr(tuple(plain(r[c]) for c in cols)) for r in d.collect())
    b = sorted(repr(tuple(plain(r[i]) for i in at)) for r in want.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql())))
def test_runs(spark, sf, name):
    assert queries()[name](spark, sf).count() > 0


def test_no_cross_joins(spark, sf):
    for name, q in queries().items():
        plan = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
