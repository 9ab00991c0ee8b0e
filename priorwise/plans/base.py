"""Views of the given tables that stand in for event tables, in Spark and in SQL, and a registry of queries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: A total order of lineitem (its shorter keys repeat).
LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_quantity", "l_extendedprice"]


def query(sql: str | None = None):
    """Registers a query under its function's name, with the SQL that gives its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem with period (year shipped) and label (returned)."""
    df = table(spark, sf_dir, "lineitem")
    return df.withColumns({"period": F.year("l_shipdate"), "y": (F.col("l_returnflag") == "R").cast("int")})


LINES = "(select *, year(l_shipdate) as period, case when l_returnflag = 'R' then 1 else 0 end as y from lineitem)"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with y (value above 100)."""
    return table(spark, sf_dir, "events").withColumn("y", (F.col("value") > 100).cast("int"))


EVENTS = "(select *, case when value > 100 then 1 else 0 end as y from events)"
