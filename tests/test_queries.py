"""Every registered query with SQL gives the rows that DuckDB gives, on the smallest tables."""

import decimal
import math

import duckdb
import pytest

from priorwise.plans import base, evaluate_queries, feature_queries, history_queries, identity_queries, linkage_queries, sequence_queries, source_queries, variant_queries  # noqa: F401

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted([tuple(plain(r[i]) for i in order) for r in data], key=lambda r: tuple((x is None, str(x)) for x in r))


@pytest.mark.parametrize("name", sorted(base.SQL))
def test_like_sql(spark, duck, name):
    df = base.QUERIES[name](spark, SF)
    want = duck.sql(base.SQL[name])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(base.QUERIES) - set(base.SQL)))
def test_runs(spark, name):
    assert base.QUERIES[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries()) and set(base.QUERIES) <= set(e.queries())


def test_row_helpers_without_a_key(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"copy (select * replace (case when o_orderkey % 50 = 7 then null else o_orderkey + 9000000000 end as o_orderkey) from '{SF}/orders.parquet') to '{tmp_path}/orders.parquet'")
    con.execute(f"create view orders as select * from '{tmp_path}/orders.parquet'")
    df, want = base.QUERIES["row_helpers"](spark, str(tmp_path)), con.sql(base.SQL["row_helpers"])
    assert rows(df.columns, [tuple(r) for r in df.collect()]) == rows(want.columns, want.fetchall())
