"""Every registered relational query against DuckDB on the smallest tables."""

import decimal

import duckdb
import pytest

from lumenql.plans import catalog

from .conftest import SF


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in catalog.TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return float(f"{v:.9g}")
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, list):
        return tuple(map(plain, v))
    return bytes(v) if isinstance(v, bytearray) else v


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    names = sorted(df.columns)
    rows = sorted(repr([plain(r[n]) for n in names]) for r in df.collect())
    if name not in catalog.ORACLE_SQL:
        assert rows
        return
    got = duck.execute(catalog.ORACLE_SQL[name])
    found = [d[0] for d in got.description]
    assert sorted(found) == names
    assert rows == sorted(repr([plain(r[found.index(n)]) for n in names]) for r in got.fetchall())


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in sorted(catalog.QUERIES) if n.startswith(("fn_", "filter_", "agg_", "join_", "script_"))])
def test_no_python_in_plans(spark, name):
    plan = plan_of(catalog.QUERIES[name](spark, SF))
    assert "Python" not in plan and "Pandas" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    plan = catalog.QUERIES["filter_between"](spark, SF)._jdf.queryExecution().toString()
    assert "GreaterThanOrEqual(p_size,10)" in plan and "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan


def test_top_k_needs_no_full_sort(spark):
    assert "TakeOrderedAndProject" in plan_of(catalog.QUERIES["limit_topk"](spark, SF))


def test_match_is_a_semi_join(spark):
    assert "LeftSemi" in plan_of(catalog.QUERIES["fts_match_sql"](spark, SF))
