"""Queries of sources and sinks: each writes to a new folder under the shared one, reads it again and returns what came back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions.expr import report
from ..operators import history as h
from ..session import shared_folder
from ..sources import io
from ..sources.io import table
from .base import LINES, lines, query
from .history_queries import _triple


def _folder(spark, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


@query("select s_suppkey, s_name, s_nationkey, round(s_acctbal, 2) as s_acctbal from supplier")
def csv_round_trip(spark, sf_dir):
    """Suppliers to gzip CSV with a header, and back with a schema."""
    path = _folder(spark, "csv")
    io.write_csv(table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey", F.round("s_acctbal", 2).alias("s_acctbal")), path, gzip=True)
    assert io.header(spark, path) == ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"]
    return io.read_csv(spark, path, "s_suppkey bigint, s_name string, s_nationkey int, s_acctbal double")


@query("select n_name, count(*) as suppliers from supplier join nation on s_nationkey = n_nationkey group by n_name")
def lookup_from_csv(spark, sf_dir):
    """Suppliers by nation, whose names come from a CSV of more columns with repeated rows."""
    path = _folder(spark, "lookup")
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey", "n_name")
    io.write_csv(n.unionByName(n.where("n_regionkey < 3")), path)
    names = io.lookup_csv(spark, path, "n_nationkey", "n_name", "n_nationkey int, n_regionkey int, n_name string")
    return table(spark, sf_dir, "supplier").join(names, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(F.count("*").alias("suppliers"))


@query("select l_orderkey, l_linenumber, round(l_quantity * l_discount, 4) + 0.0 as saved from lineitem")
def cached_features(spark, sf_dir):
    """Features written once; the second call reads what the first left, other versions are apart."""
    d = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", report(F.col("l_quantity") * F.col("l_discount"), 4).alias("saved"))
    path = _folder(spark, "features")
    io.cached_features(d, path, "v1")
    io.cached_features(d.withColumn("saved", F.lit(0.0)), path, "v2")
    return io.cached_features(d.withColumn("saved", F.col("saved") + 1), path, "v1")


@query("select l_suppkey, l_returnflag, count(*) as n from lineitem group by all having count(*) > 1")
def repeated_keys(spark, sf_dir):
    return io.unique_key(table(spark, sf_dir, "lineitem"), ["l_suppkey", "l_returnflag"])


@query("select o_orderpriority, count(*) as n from orders where o_orderpriority not in ('1-URGENT', '2-HIGH') group by all")
def unknown_values(spark, sf_dir):
    return io.outside_domain(table(spark, sf_dir, "orders"), "o_orderpriority", ["1-URGENT", "2-HIGH"])


@query("select o_orderkey, o_custkey, round(o_totalprice / 1000, 6) as prediction from orders")
def checked_template(spark, sf_dir):
    """Every order with its one prediction; the check of both sides passes."""
    o = table(spark, sf_dir, "orders")
    return io.checked_template(o.select("o_orderkey", "o_custkey"), o.select("o_orderkey", report(F.col("o_totalprice") / 1000).alias("prediction")), "o_orderkey", "prediction")


@query("select c_custkey, c_nationkey, o.n, o.total from customer join (select o_custkey as c_custkey, count(*) as n, round(sum(o_totalprice), 2) as total from orders group by all) o using (c_custkey)")
def one_to_one(spark, sf_dir):
    """Customers and their orders' sums: a join that raises where a key repeats on a side."""
    o = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"), F.round(F.sum("o_totalprice"), 2).alias("total"))
    return io.one_to_one(table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey"), o, ["c_custkey"])


@query(f"""
with g as (select l_suppkey, l_linestatus, period, count(*) as n, sum(y)::double as s from {LINES} group by all),
m as (select l_linestatus, avg(y) as prior from {LINES} where l_discount < 0.04 group by all),
st as (select *, coalesce(sum(n) over w, 0) as n_prior, coalesce(sum(s) over w, 0) as s_prior from g window w as (partition by l_suppkey, l_linestatus order by period range between unbounded preceding and 1 preceding)),
r as (select st.*, coalesce(m.prior, 0.5) as prior, (s_prior + 200.0 * coalesce(m.prior, 0.5)) / (n_prior + 200.0) as rate from st left join m using (l_linestatus))
select l_suppkey, l_linestatus, period, n_prior::bigint as n_prior, s_prior::bigint as s_prior, round(rate, 6) as rate, round(rate - prior, 6) + 0.0 as dev, round(ln(1 + n_prior), 6) as conf from r
""")
def masked_prior_triple(spark, sf_dir):
    """A prior from the rows of a mask only; the counts are those of all rows."""
    return _triple(h.prior_period_triple(lines(spark, sf_dir), ["l_suppkey"], ["l_linestatus"], "period", "y", prior="train", history=F.col("l_discount") < 0.04))


@query(f"""
with t as (select period, l_linestatus, y::double as y, l_discount * 5 as a, 0.3::double as b from {LINES}), f as (select period, avg(a * a) as aa, avg(a * b) as ab, avg(b * b) as bb, avg(a * y) as ay, avg(b * y) as zy from t group by period),
g as (select avg(aa) + 0.01 as aa, avg(ab) as ab, avg(bb) + 0.01 as bb, avg(ay) + 0.005 as ay, avg(zy) + 0.005 as zy from f)
select round((ay * bb - zy * ab) / (aa * bb - ab * ab), 6) as weight_a, round((zy * aa - ay * ab) / (aa * bb - ab * ab), 6) as weight_b from g
""")
def joint_blend(spark, sf_dir):
    """Two members' weights for the mean over years of each year's Brier score, drawn towards one half each."""
    from ..operators import evaluate

    d = lines(spark, sf_dir).select("period", "y", (F.col("l_discount") * 5).alias("a"), F.lit(0.3).alias("b"))
    w = evaluate.joint_blend(d, ["a", "b"], "y", "period", [0.5, 0.5], 0.01)
    return spark.range(1).select(report(F.lit(w[0])).alias("weight_a"), report(F.lit(w[1])).alias("weight_b"))
