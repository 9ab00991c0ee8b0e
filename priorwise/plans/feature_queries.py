"""Queries of row features, combined aggregates, fitted codes, networks and boosted trees."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import expr as x
from ..operators import evaluate as e
from ..operators import history as h
from ..operators import linkage as k
from ..operators import models as m
from ..sources.io import table
from .base import LINES, lines, query
from .evaluate_queries import SCORED, scored


@query("""
select l_orderkey, l_linenumber, round(l_quantity * l_discount, 6) as l_quantity_x_l_discount, round(l_quantity * returned, 6) as l_quantity_x_returned, round(l_discount * returned, 6) as l_discount_x_returned
from (select *, case when l_returnflag = 'R' then 1 else 0 end as returned from lineitem)
""")
def feature_products(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))
    return d.select("l_orderkey", "l_linenumber", *[x.report(c).alias(n) for n, c in x.products(["l_quantity", "l_discount"], ["returned"]).items()])


@query(f"""
with c as (select l_suppkey, period, avg(y) as r from {LINES} group by all), s as (select l_suppkey, avg(y) as base from {LINES} group by all),
p as (select l_suppkey, period, lag(r, 1) over w as last1, lag(r, 3) over w as last3 from c window w as (partition by l_suppkey order by period))
select l_suppkey, period, round(last1 - base, 6) as last1_dev, round(last3 - base, 6) as last3_dev, round(last1 - last3, 6) as last1_trend from p join s using (l_suppkey)
""")
def rate_trends(spark, sf_dir):
    """Rates of one and three periods ago against the supplier's own over all, and each other."""
    from pyspark.sql import Window

    d = lines(spark, sf_dir)
    w = Window.partitionBy("l_suppkey").orderBy("period")
    g = d.groupBy("l_suppkey", "period").agg(F.sum("y").alias("_s"), F.count("*").alias("_n"))
    base = g.groupBy("l_suppkey").agg((F.sum("_s") / F.sum("_n")).alias("base"))
    r = F.col("_s") / F.col("_n")
    p = g.withColumns({"last1": F.lag(r, 1).over(w), "last3": F.lag(r, 3).over(w)}).join(base, "l_suppkey")
    return p.select("l_suppkey", "period", *[x.report(c).alias(n) for n, c in x.trends(["last1", "last3"], "base").items()])


@query("""
select o_orderkey, case when home then o_totalprice else c_acctbal end as own_value, case when home then c_acctbal else o_totalprice end as other_value
from (select *, o_orderstatus = 'O' as home from orders) join customer on o_custkey = c_custkey
""")
def oriented_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return d.select("o_orderkey", *[c.alias(n) for n, c in x.oriented(F.col("o_orderstatus") == "O", {"value": ("o_totalprice", "c_acctbal")}).items()])


@query("""
select l_returnflag, sum(case when l_quantity between 1 and 10 then 1 else 0 end)::bigint as few, sum(case when l_quantity between 10 and 40 then 1 else 0 end)::bigint as some, count(*) as n from lineitem group by 1
""")
def range_flags(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").withColumns(x.range_flags("l_quantity", {"few": (1, 10), "some": (10, 40)}))
    return d.groupBy("l_returnflag").agg(F.sum("few").alias("few"), F.sum("some").alias("some"), F.count("*").alias("n"))


@query("""
with a as (select l_partkey, count(*) as returned from lineitem where l_returnflag = 'R' group by 1), b as (select l_partkey, count(*) as accepted, max(l_discount) as top from lineitem where l_returnflag = 'A' group by 1),
c as (select l_partkey, sum(l_quantity) as late from lineitem where year(l_shipdate) >= 2000 group by 1)
select coalesce(a.l_partkey, b.l_partkey, c.l_partkey) as l_partkey, returned, accepted, top, late from a full join b on a.l_partkey = b.l_partkey full join c on coalesce(a.l_partkey, b.l_partkey) = c.l_partkey
""")
def combined_aggregates(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem")
    a = d.where("l_returnflag = 'R'").groupBy("l_partkey").agg(F.count("*").alias("returned"))
    b = d.where("l_returnflag = 'A'").groupBy("l_partkey").agg(F.count("*").alias("accepted"), F.max("l_discount").alias("top"))
    c = d.where("year(l_shipdate) >= 2000").groupBy("l_partkey").agg(F.sum("l_quantity").alias("late"))
    return k.side_by_side([a, b, c], ["l_partkey"])


@query("select l_suppkey, l_returnflag, l_linestatus, l_quantity, min(l_discount) as l_discount from lineitem group by 1, 2, 3, 4")
def dedup_except(spark, sf_dir):
    return k.dedup_except(table(spark, sf_dir, "lineitem").select("l_suppkey", "l_returnflag", "l_linestatus", "l_quantity", "l_discount"), "l_discount")


@query("""
with c as (select l_suppkey, l_returnflag, count(*) as n, avg(l_quantity) as q, avg(l_discount) as d from lineitem group by all), o as (select l_suppkey, avg(l_quantity) as q, avg(l_discount) as d from lineitem group by all)
select l_suppkey, l_returnflag, n, round((c.q - o.q) * n / (n + 20), 6) + 0.0 as l_quantity, round((c.d - o.d) * n / (n + 20), 6) + 0.0 as l_discount from c join o using (l_suppkey)
""")
def measure_deviations(spark, sf_dir):
    d = h.measure_deviations(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_returnflag", ["l_quantity", "l_discount"], 20.0)
    return d.withColumns({c: x.report(c) for c in ("l_quantity", "l_discount")})


@query("select count(*) as n, 0::bigint as differing from events")
def order_shuffle(spark, sf_dir):
    """Scores that come row by row don't depend on the order and partitioning of the rows."""
    plan = lambda d: d.select("event_id", x.sigmoid(F.col("p") - F.col("q")).alias("s"))
    return e.order_shuffle_test(scored(spark, sf_dir), plan, "event_id")


@query("""
with v as (select distinct o_orderpriority as v from orders where year(o_orderdate) < 1996), c as (select v, row_number() over (order by v) - 1 as code from v)
select o_orderkey, coalesce(c.code, -1)::int as code from (select o_orderkey, case when o_orderkey % 9 = 0 then 'none' when o_orderkey % 11 = 0 then null else o_orderpriority end as p from orders) left join c on p = v
""")
def ordinal_codes(spark, sf_dir):
    """Codes fitted on early orders; changed and missing values are unknown."""
    d = table(spark, sf_dir, "orders")
    levels = m.fit_codes(d.where("year(o_orderdate) < 1996"), "o_orderpriority")
    p = F.when(F.col("o_orderkey") % 9 == 0, "none").when(F.col("o_orderkey") % 11 == 0, F.lit(None)).otherwise(F.col("o_orderpriority"))
    return d.select("o_orderkey", m.ordinal_codes(p, levels).alias("code"))


@query(f"""
with f as (select *, l_orderkey % 5 as fold from {LINES}), c as (select l_suppkey, fold, sum(y) as s, count(*) as n from f group by all), t as (select l_suppkey, sum(s) as s, sum(n) as n from c group by all)
select l_orderkey, l_linenumber, round((t.s - c.s) / nullif(t.n - c.n, 0), 6) as p from f join c using (l_suppkey, fold) join t on t.l_suppkey = f.l_suppkey
""")
def out_of_fold_rates(spark, sf_dir):
    """Each row scored by its supplier's rate over the other folds."""
    d = lines(spark, sf_dir).select("l_orderkey", "l_linenumber", "l_suppkey", "y", (F.col("l_orderkey") % 5).alias("fold"))
    return m.out_of_fold_rates(d, ["l_suppkey"], "fold", "y").select("l_orderkey", "l_linenumber", x.report("p").alias("p"))


def _relu(s: str) -> str:
    return f"greatest({s}, 0.0)"


def _dot(parts, weights, more="0.0") -> str:
    return "(" + " + ".join([str(more), *[f"({float(w)!r}) * ({p})" for p, w in zip(parts, weights)]]) + ")"


_R = np.random.default_rng(3)
ENSEMBLE = {
    "embed_w": np.round(_R.normal(size=(2, 2)), 2), "embed_b": np.round(_R.normal(size=(2, 2)), 2), "cards": np.array([3]),
    "block0_w": np.round(_R.normal(size=(3, 7)), 2), "block0_r": np.round(_R.normal(size=(2, 7)), 2), "block0_s": np.round(_R.normal(size=(2, 3)), 2), "block0_b": np.round(_R.normal(size=(2, 3)), 2),
    "block1_w": np.round(_R.normal(size=(2, 3)), 2), "block1_r": np.round(_R.normal(size=(2, 3)), 2), "block1_s": np.round(_R.normal(size=(2, 2)), 2), "block1_b": np.round(_R.normal(size=(2, 2)), 2),
    "head_w": np.round(_R.normal(size=(2, 2)), 2), "head_b": np.round(_R.normal(size=2), 2),
}
PERIODIC = {
    "freq": np.round(_R.normal(size=(2, 2)), 2), "embed_w": np.round(_R.normal(size=(2, 4, 2)), 2), "embed_b": np.round(_R.normal(size=(2, 2)), 2), "table0": np.round(_R.normal(size=(4, 2)), 2),
    "dense0_w": np.round(_R.normal(size=(6, 3)), 2), "dense0_b": np.round(_R.normal(size=3), 2), "dense1_w": np.round(_R.normal(size=(3, 1)), 2), "dense1_b": np.round(_R.normal(size=1), 2),
}


def _ensemble_sql(net) -> str:
    """The members' unrolled expressions over a, b and c, layer by layer in nested selects."""
    cols = [_relu(f"{v} * ({net['embed_w'][i, d]}) + ({net['embed_b'][i, d]})") for i, v in enumerate("ab") for d in range(2)] + [f"case when c = {j} then 1.0 else 0.0 end" for j in range(3)]
    sql = "select *, " + ", ".join(f"{v} as e{i}" for i, v in enumerate(cols)) + " from t"
    names = [[f"e{i}" for i in range(7)]] * 2
    for n in range(2):
        w, r, s, b = (net[f"block{n}_{p}"] for p in "wrsb")
        new = [[_relu(f"{_dot(names[i], r[i] * w[o])} * ({s[i, o]}) + ({b[i, o]})") for o in range(len(w))] for i in range(2)]
        sql = "select *, " + ", ".join(f"{v} as h{n}_{i}_{o}" for i, vs in enumerate(new) for o, v in enumerate(vs)) + f" from ({sql})"
        names = [[f"h{n}_{i}_{o}" for o in range(len(w))] for i in range(2)]
    outs = [f"1 / (1 + exp(-{_dot(names[i], net['head_w'][i], net['head_b'][i])}))" for i in range(2)]
    return f"with t as (select event_id, p as a, q as b, lane % 3 as c from {SCORED}) select event_id, round(({' + '.join(outs)}) / 2, 6) as score from ({sql})"


def _periodic_sql(net) -> str:
    parts = []
    for i, v in enumerate("ab"):
        waves = [f"{f}(2 * pi() * {v} * ({w}))" for f in ("cos", "sin") for w in net["freq"][i]]
        parts += [_relu(_dot(waves, net["embed_w"][i][:, d], net["embed_b"][i, d])) for d in range(2)]
    parts += ["case c " + " ".join(f"when {j} then {net['table0'][j, d]}" for j in range(4)) + " end" for d in range(2)]
    sql = "select event_id, " + ", ".join(f"{v} as e{i}" for i, v in enumerate(parts)) + " from t"
    hidden = [_relu(_dot([f"e{i}" for i in range(6)], net["dense0_w"][:, o], net["dense0_b"][o])) for o in range(3)]
    out = _dot([f"h{o}" for o in range(3)], net["dense1_w"][:, 0], net["dense1_b"][0])
    return f"with t as (select event_id, p as a, q as b, lane % 4 as c from {SCORED}) select event_id, round(1 / (1 + exp(-{out})), 6) as score from (select event_id, {', '.join(f'{v} as h{i}' for i, v in enumerate(hidden))} from ({sql}))"


@query(_ensemble_sql(ENSEMBLE))
def batch_ensemble(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", x.report(m.batch_ensemble([F.col("p"), F.col("q")], [F.col("lane") % 3], ENSEMBLE)).alias("score"))


@query(_periodic_sql(PERIODIC))
def periodic_network(spark, sf_dir):
    return scored(spark, sf_dir).select("event_id", x.report(m.periodic_network([F.col("p"), F.col("q")], [F.col("lane") % 4], PERIODIC)).alias("score"))


@query("select count(*) as n, count(*) as agree from events")
def boosted_trees_export(spark, sf_dir):
    """Rows on which the fitted model and its exported arrays give one probability."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = scored(spark, sf_dir).select("p", "q", "hour", F.col("y").cast("double").alias("y"))
    model, trees = m.boosted_trees(d, ["p", "q", "hour"], "y", trees=5, depth=3)
    own = model.transform(VectorAssembler(inputCols=["p", "q", "hour"], outputCol="_f").transform(d)).withColumn("a", vector_to_array("probability")[1])
    both = own.withColumn("b", x.sigmoid(2 * m.tree_scores([F.col("p"), F.col("q"), F.col("hour")], trees)))
    return both.agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("a") - F.col("b")) < 1e-9).alias("agree"))


@query(f"""
with q as (select quantile_cont(value, list_transform(range(11), lambda i: i / 10.0)) as v from {SCORED}), u as (select event_id, value, v, len(list_filter(v, lambda z: z < value)) as below, len(list_filter(v, lambda z: z <= value)) as upto from {SCORED}, q)
select event_id, round(case when value <= v[1] then 0 when value >= v[11] then 10 when upto > below then (below + upto - 1) / 2.0 else below - 1 + (value - v[below]) / (v[below + 1] - v[below]) end / 10, 6) as place from u
""")
def quantile_place(spark, sf_dir):
    """The probability whose normal quantile quantile_normal gives, by the error function's inverse series: here the normal value is turned back."""
    d = scored(spark, sf_dir)
    fitted = m.fit_quantile_normal(d, "value", 11)
    z = m.quantile_normal(F.col("value"), fitted)

    @F.pandas_udf("double")
    def back(v):
        from math import erfc

        return v.map(lambda t: erfc(-t / 2**0.5) / 2)

    # columns that are named twice stay apart, so each is computed once
    d, p = d.select("event_id", z.alias("z")).select("event_id", F.when(F.col("z").isNotNull(), back("z")).alias("p")), F.col("p")
    return d.select("event_id", x.report(F.when(p < 1.5e-7, 0.0).when(p > 1 - 1.5e-7, 1.0).otherwise(p)).alias("place"))
