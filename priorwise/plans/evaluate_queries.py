"""Queries of evaluation, ensembles, profiles, bins and models."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import expr as x
from ..operators import ensemble as n
from ..operators import evaluate as e
from ..operators import models as m
from ..sources.io import period_scan, table
from .base import LINES, lines, query

PURCHASE = "event_type = 'purchase'"


def scored(spark, sf_dir):
    """events with a label (purchase), two predictors, and axes."""
    d = table(spark, sf_dir, "events")
    return d.select(
        "event_id", "user_id", "event_type", "value", (F.expr(PURCHASE)).cast("int").alias("y"), x.clip(F.col("value") / 500, 0.02, 0.98).alias("p"),
        (0.05 + 0.3 * F.pmod(F.col("event_id") * 7919, F.lit(1000)) / 1000).alias("q"), F.hour("ts").alias("hour"), F.dayofweek("ts").alias("dow"), F.floor((F.dayofmonth("ts") - 1) / 10).cast("int").alias("part"), (F.col("user_id") % 8).alias("lane"),
    )


SCORED = f"""(select event_id, user_id, event_type, value, case when {PURCHASE} then 1 else 0 end as y, least(greatest(value / 500, 0.02), 0.98) as p, 0.05 + 0.3 * ((event_id * 7919) % 1000) / 1000 as q,
  hour(ts)::int as hour, dayofweek(ts)::int + 1 as dow, ((day(ts) - 1) // 10)::int as part, user_id % 8 as lane from events)"""


@query(f"select round(avg((p - y) ** 2), 6) as brier, round(100000 * (1 - avg((p - y) ** 2) / (avg(y) * (1 - avg(y)))), 3) as skill, round(greatest(100000 * (1 - avg((q - y) ** 2) / (avg(y) * (1 - avg(y)))), 0), 3) as skill_q from {SCORED}")
def brier_skill(spark, sf_dir):
    return scored(spark, sf_dir).agg(x.report(e.brier("p", "y")).alias("brier"), x.report(e.skill("p", "y", False), 3).alias("skill"), x.report(e.skill("q", "y"), 3).alias("skill_q"))


SHIFTS = [i / 8 for i in range(-16, 17)]
GRID = ", ".join(f"({s}::double)" for s in SHIFTS)


def _best_shift_sql(by: str) -> str:
    g, k = (f"{by}, ", f"group by {by}") if by else ("", "")
    return f"""
with s as (select {g}v.g as shift, avg((1 / (1 + exp(-(ln(p / (1 - p)) + v.g))) - y) ** 2) as brier from {SCORED}, (values {GRID}) v(g) group by all)
select {g}arg_min(shift, (round(brier, 9), abs(shift), shift)) as shift, round(arg_min(brier, (round(brier, 9), abs(shift), shift)), 6) as brier from s {k}
"""


@query(_best_shift_sql(""))
def best_shift_grid(spark, sf_dir):
    return e.best_shift(scored(spark, sf_dir), "p", "y", SHIFTS).withColumn("brier", x.report("brier"))


@query(_best_shift_sql("dow"))
def best_shift_by_slice(spark, sf_dir):
    return e.best_shift(scored(spark, sf_dir), "p", "y", SHIFTS, ["dow"]).withColumn("brier", x.report("brier"))


@query(f"""
select t as temperature, b as intercept, round(avg((1 / (1 + exp(-(ln(p / (1 - p)) / t + b))) - y) ** 2), 6) as brier from {SCORED}, (select unnest([0.5, 1.0, 2.0, 4.0]) as t), (select unnest([-2.0, -1.0, 0.0, 1.0]) as b) group by all
""")
def temperature_grid(spark, sf_dir):
    return e.temperature_scores(scored(spark, sf_dir), "p", "y", [0.5, 1, 2, 4], [-2, -1, 0, 1]).withColumn("brier", x.report("brier"))


@query(f"""
select cast(case when p <= 0.1 then 0 else ceil(p * 10 - 1e-9) - 1 end as int) as bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as rate, round(avg(y) - avg(p), 6) + 0.0 as gap from {SCORED} group by 1
""")
def calibration_bins(spark, sf_dir):
    return e.calibration(scored(spark, sf_dir), "p", "y", [i / 10 for i in range(11)]).withColumns({c: x.report(c) for c in ("mean_p", "rate", "gap")})


@query(f"""
with g as (select case grouping_id(event_type, hour, dow, lane) when 15 then 'all' when 7 then 'event_type' when 11 then 'hour' when 13 then 'dow' else 'lane' end as axis,
  case grouping_id(event_type, hour, dow, lane) when 15 then 'all' else coalesce(event_type, hour::varchar, dow::varchar, lane::varchar) end as cell, count(*) as n, avg(y) as rate, avg(p) as mean_p, avg((p - y) ** 2) as brier
  from {SCORED} group by grouping sets ((), (event_type), (hour), (dow), (lane)))
select axis, cell, n, round(rate, 6) as rate, round(mean_p, 6) as mean_p, round(rate - mean_p, 6) + 0.0 as residual, round(brier, 6) as brier from g where n >= 300
""")
def group_report(spark, sf_dir):
    out = e.group_report(scored(spark, sf_dir), "p", "y", ["event_type", "hour", "dow", "lane"], 300)
    return out.withColumns({c: x.report(c) for c in ("rate", "mean_p", "residual", "brier")})


RES = f"""(select 'hour' as axis, hour::varchar as cell, part, y - p as r from {SCORED} union all select 'lane', lane::varchar, part, y - p from {SCORED})"""


@query(f"""
with g as (select axis, cell, part, count(*) as n, avg(r) as r from {RES} group by all),
w as (select axis, cell, max(r) filter (part = 0) as r0, max(r) filter (part = 1) as r1, max(r) filter (part = 2) as r2, min(n) as n, count(*) as k from g where part <= 2 group by all)
select axis, cell, round(r0, 6) as r_0, round(r1, 6) as r_1, round(r2, 6) as r_2, n as min_n from w where k = 3 and n >= 50 and (greatest(r0, r1, r2) < 0 or least(r0, r1, r2) > 0)
""")
def stable_residuals(spark, sf_dir):
    res = e.residuals_by_period(scored(spark, sf_dir), "p", "y", "part", ["hour", "lane"])
    return e.stable_residuals(res, "part", [0, 1, 2], 50).withColumns({f"r_{i}": x.report(f"r_{i}") for i in range(3)})


@query(f"""
with g as (select axis, cell, part, count(*) as n, avg(r) as r from {RES} group by all),
d as (select axis, cell, sum(n * r) / sum(n) as discovered from g where part <= 1 and n >= 30 group by all having count(*) = 2 and (min(r) > 0 or max(r) < 0) and abs(sum(n * r) / sum(n)) >= 0.01)
select axis, cell, round(discovered, 6) as discovered, round(g.r, 6) as confirmed from d left join (select * from g where part = 2) g using (axis, cell)
""")
def confirmed_cells(spark, sf_dir):
    res = e.residuals_by_period(scored(spark, sf_dir), "p", "y", "part", ["hour", "lane"])
    return e.confirmed_cells(res, "part", [0, 1], 2, 0.01, 30).withColumns({c: x.report(c) for c in ("discovered", "confirmed")})


@query(f"""
with c as (select lane, hour, count(*) / (count(*) + 50.0) * avg(y - p) as c from {SCORED} where part <= 1 group by all),
s as (select y, p, least(greatest(p + coalesce(c, 0), 0), 1) as q from {SCORED} s left join c using (lane, hour) where part = 2)
select count(*) as n, round(avg((p - y) ** 2), 6) as brier_before, round(avg((q - y) ** 2), 6) as brier_after from s
""")
def residual_transfer(spark, sf_dir):
    out = e.residual_transfer(scored(spark, sf_dir), "p", "y", "part", ["lane", "hour"], 1, 2, 50.0)
    return out.withColumns({c: x.report(c) for c in ("brier_before", "brier_after")})


@query(f"""
with t as (select count(*) as nn, avg(y) as r from {SCORED}), g as (select lane, count(*) as n, avg(y - p) as bias, stddev_samp(y - p) / sqrt(count(*)) as se from {SCORED} group by lane)
select lane, n, round(bias, 6) as bias, round(se, 6) as se, round(bias / se, 4) as t, round(n / nn * bias ** 2 / (r * (1 - r)) * 100000, 3) as points from g, t
""")
def bias_decomposition(spark, sf_dir):
    out = e.bias_decomposition(scored(spark, sf_dir), "p", "y", ["lane"])
    return out.withColumns({"bias": x.report("bias"), "se": x.report("se"), "t": x.report("t", 4), "points": x.report("points", 3)})


@query(f"""select w as weight, round(avg((w * p + (1 - w) * q - y) ** 2), 6) as brier from {SCORED}, (select unnest(range(0, 21)) / 20.0 as w) group by w""")
def blend_sweep(spark, sf_dir):
    return e.blend_sweep(scored(spark, sf_dir), "p", "q", "y", [i / 20 for i in range(21)]).withColumn("brier", x.report("brier"))


@query(f"""
with s as (select *, event_id % 2 as half from {SCORED}),
c as (select half, lane, count(*) as n, sum((p - q) * (y - q)) as b, sum((p - q) ** 2) as a from s group by all), g as (select half, least(greatest(sum(b) / sum(a), 0), 1) as g from c group by half)
select 1 - half as half, lane, n, round(n / (n + 500.0) * (least(greatest(b / a, 0), 1) - g) + g, 6) + 0.0 as weight from c join g using (half)
""")
def crossfit_cell_weights(spark, sf_dir):
    d = scored(spark, sf_dir).withColumn("half", F.col("event_id") % 2)
    return e.crossfit_weights(d, "p", "q", "y", "half", "lane").withColumn("weight", x.report("weight"))


def _backfit_sql(passes: int) -> str:
    sql = f"with g0 as (select lane, hour, count(*) as n, sum(y - p) as s, 0.0::double as a, 0.0::double as b from {SCORED} group by all)"
    i = 0
    for _ in range(passes):
        for own, other, key in (("a", "b", "lane"), ("b", "a", "hour")):
            keep = "a as keep" if own == "b" else "b as keep"
            sql += f", h{i} as (select lane, hour, n, s, {keep}, sum(s - n * {other}) over (partition by {key}) / (sum(n) over (partition by {key}) + 100.0) as e from g{i})"
            cols = "e - (select sum(n * e) / sum(n) from h%d) as %s, keep as %s" % (i, own, other)
            sql += f", g{i + 1} as (select lane, hour, n, s, {cols} from h{i})"
            i += 1
    return sql + f" select lane, hour, n, round(a, 6) + 0.0 as effect_first, round(b, 6) + 0.0 as effect_second from g{i}"


@query(_backfit_sql(2))
def backfit_two_factor(spark, sf_dir):
    return e.backfit(scored(spark, sf_dir), "p", "y", "lane", "hour", 2).withColumns({c: x.report(c) for c in ("effect_first", "effect_second")})


@query(f"""
with r as (select value, y, hour from {SCORED}), c as (select corr(value, y) as xy, corr(value, hour) as xz, corr(y, hour) as yz from r)
select 'value' as feature, round((xy - xz * yz) / sqrt((1 - xz ** 2) * (1 - yz ** 2)), 6) as partial from c
""")
def partial_corr(spark, sf_dir):
    v = e.partial_corr(scored(spark, sf_dir), "value", "y", ["hour"])
    return spark.createDataFrame([("value", v)], "feature string, partial double").withColumn("partial", x.report("partial"))


@query(f"""
with s as (select lane, part, avg((p - y) ** 2) as b from {SCORED} group by all), j as (select a.b as a, c.b as b from s a join s c on a.lane = c.lane and a.part = 0 and c.part = 1)
select count(*) as pairs, round(avg(b - a), 6) + 0.0 as mean_diff, round(avg(b - a) / (stddev_samp(b - a) / sqrt(count(*))), 4) as t from j
""")
def paired_t(spark, sf_dir):
    d = scored(spark, sf_dir).groupBy("lane", "part").agg(e.brier("p", "y").alias("b"))
    return e.paired_t(d, "lane", "part", "b", 0, 1).withColumns({"mean_diff": x.report("mean_diff"), "t": x.report("t", 4)})


@query(f"""
with s as (select lane, part, avg(p) as v from {SCORED} group by all), g as (select lane, count(*) as k, var_samp(v) as v from s group by lane having count(*) > 1)
select sum(k * (k - 1) / 2)::bigint as pairs, round(avg(v), 9) as variance from g
""")
def seed_variance(spark, sf_dir):
    d = scored(spark, sf_dir).groupBy("lane", "part").agg(F.avg("p").alias("v"))
    return e.seed_variance(d, "part", "lane", "v").withColumn("variance", x.report("variance", 9))


@query(f"select event_id, y, round(p, 6) as p, round((p - y) ** 2, 6) as loss from {SCORED} order by (p - y) ** 2 desc, event_id limit 20")
def topk_worst(spark, sf_dir):
    return e.worst_rows(scored(spark, sf_dir), "p", "y", "event_id", 20).select("event_id", "y", x.report("p").alias("p"), x.report("loss").alias("loss"))


@query(f"""select lane, round(corr(p, q), 6) as between_models, round(corr(p, y), 6) as with_label from {SCORED} group by lane""")
def prediction_corr(spark, sf_dir):
    return scored(spark, sf_dir).groupBy("lane").agg(x.report(F.corr("p", "q")).alias("between_models"), x.report(F.corr("p", "y")).alias("with_label"))


@query(f"""
with t as (select part as held_out, fold from (select distinct part from {SCORED}) cross join (select 0 as fold)),
f as (select a.held_out, avg(s.y) as rate from (select distinct part as held_out from {SCORED}) a join {SCORED} s on s.part <> a.held_out group by all)
select held_out, count(*) as n, round(any_value(f.rate), 6) as train_rate, round(avg((f.rate - s.y) ** 2), 6) as brier from f join {SCORED} s on s.part = f.held_out group by held_out
""")
def leave_one_out_gate(spark, sf_dir):
    """The rate of the other folds, scored on each fold: totals less the fold's own, in one pass."""
    g = scored(spark, sf_dir).groupBy("part").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    t = g.agg(F.sum("n").alias("all_n"), F.sum("s").alias("all_s"))
    r = (F.col("all_s") - F.col("s")) / (F.col("all_n") - F.col("n"))
    d = g.crossJoin(F.broadcast(t)).withColumn("r", r)
    brier = (F.col("s") * (1 - F.col("r")) ** 2 + (F.col("n") - F.col("s")) * F.col("r") ** 2) / F.col("n")
    return d.select(F.col("part").alias("held_out"), "n", x.report("r").alias("train_rate"), x.report(brier).alias("brier"))


# Profiles and bins


@query("""
with c as (select o_custkey, o_orderpriority, count(*) as n from orders group by all), s as (select *, n / sum(n) over (partition by o_custkey) as p from c)
select o_custkey, sum(n)::bigint as n, round(-sum(p * ln(p)), 6) + 0.0 as entropy, round(max(p), 6) as top_share, arg_min(o_orderpriority, (-n, o_orderpriority)) as top from s group by o_custkey
""")
def profile_mix(spark, sf_dir):
    c = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderpriority").agg(F.count("*").alias("n"))
    from pyspark.sql import Window

    s = c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("o_custkey")))
    return s.groupBy("o_custkey").agg(F.sum("n").alias("n"), x.report(-F.sum(F.col("p") * F.log("p"))).alias("entropy"), x.report(F.max("p")).alias("top_share"), F.min_by("o_orderpriority", F.struct(-F.col("n"), "o_orderpriority")).alias("top"))


@query(f"""
with r as (select l_suppkey, l_extendedprice - avg(l_extendedprice) over (partition by l_suppkey, l_returnflag) as d from {LINES})
select l_suppkey, count(*) as n, round(stddev_samp(d), 4) as residual_std from r group by l_suppkey
""")
def residual_std(spark, sf_dir):
    from pyspark.sql import Window

    d = lines(spark, sf_dir).withColumn("d", F.col("l_extendedprice") - F.avg("l_extendedprice").over(Window.partitionBy("l_suppkey", "l_returnflag")))
    return d.groupBy("l_suppkey").agg(F.count("*").alias("n"), x.report(F.stddev_samp("d"), 4).alias("residual_std"))


@query("""
select c_nationkey, count(*) filter (o_orderstatus = 'F') as f, count(*) filter (o_orderstatus = 'O') as o, count(*) filter (o_orderstatus = 'P') as p,
  round(count(*) filter (o_orderstatus = 'F') / count(*) filter (o_orderstatus in ('F', 'O', 'P')), 6) as share_f from orders join customer on c_custkey = o_custkey group by c_nationkey
""")
def pivot_share(spark, sf_dir):
    d = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    g = d.groupBy("c_nationkey").pivot("o_orderstatus", ["F", "O", "P"]).count().fillna(0)
    return g.select("c_nationkey", F.col("F").alias("f"), F.col("O").alias("o"), F.col("P").alias("p"), x.report(F.col("F") / (F.col("F") + F.col("O") + F.col("P"))).alias("share_f"))


@query("""
with e as (select list_sort(list_distinct([quantile_cont(l_extendedprice, i / 10.0) for i in range(11)])) as e from lineitem) select 0 as bin, 0 as n where false
""".replace("select 0 as bin, 0 as n where false", "select greatest(len(list_filter(e.e, lambda v: v < l_extendedprice)) - 1, 0)::int as bin, count(*) as n, round(min(l_extendedprice), 2) as lowest, round(max(l_extendedprice), 2) as highest from lineitem, e group by 1")
    .replace("[quantile_cont(l_extendedprice, i / 10.0) for i in range(11)]", "quantile_cont(l_extendedprice, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1])"))
def quantile_bins(spark, sf_dir):
    d = m.quantile_bins(table(spark, sf_dir, "lineitem").select("l_extendedprice"), "l_extendedprice", 10)
    return d.groupBy("bin").agg(F.count("*").alias("n"), x.report(F.min("l_extendedprice"), 2).alias("lowest"), x.report(F.max("l_extendedprice"), 2).alias("highest"))


@query("""
select case when l_quantity <= 0 then null when l_quantity <= 10 then 0 when l_quantity <= 24 then 1 when l_quantity <= 25 then 2 when l_quantity <= 50 then 3 end as bin, len(list_filter([10.0, 24.0, 25.0], lambda v: v <= l_quantity))::int as left_bin, count(*) as n from lineitem group by all
""")
def fixed_bins(spark, sf_dir):
    d = table(spark, sf_dir, "lineitem").select(x.bin_right("l_quantity", [0, 10, 24, 25, 50]).alias("bin"), x.bin_left("l_quantity", F.array(F.lit(10.0), F.lit(24.0), F.lit(25.0))).alias("left_bin"))
    return d.groupBy("bin", "left_bin").agg(F.count("*").alias("n"))


# Ensembles


MEMBERS = ["m1", "m2", "m3", "m4"]


def members(spark, sf_dir):
    d = scored(spark, sf_dir)
    return d.withColumns({"m1": F.col("p"), "m2": F.col("q"), "m3": x.clip(F.col("p") * 0.5 + 0.1), "m4": x.clip(F.col("q") * 0.8 + F.col("lane") / 100)})


MEMBERS_SQL = f"(select *, p as m1, q as m2, p * 0.5 + 0.1 as m3, q * 0.8 + lane / 100 as m4 from {SCORED})"


@query(f"""
with m as (select event_id, list_sort([m1, m2, m3, m4]) as s, [m1, m2, m3, m4] as v from {MEMBERS_SQL}), a as (select event_id, s, v, (v[1] + v[2] + v[3] + v[4]) / 4 as mean from m)
select event_id, round(mean, 9) as mean, round(1 / (1 + exp(-(ln(v[1] / (1 - v[1])) + ln(v[2] / (1 - v[2])) + ln(v[3] / (1 - v[3])) + ln(v[4] / (1 - v[4]))) / 4)), 9) as mean_logit, round((s[2] + s[3]) / 2, 9) as median, round((s[2] + s[3]) / 2, 9) as trimmed, round(s[4], 9) as highest,
  round(greatest(abs(v[1] - mean), abs(v[2] - mean), abs(v[3] - mean), abs(v[4] - mean)), 9) as spread from a
""")
def ensemble_aggregators(spark, sf_dir):
    a = n.aggregated(MEMBERS)
    return members(spark, sf_dir).select("event_id", *[x.report(c, 9).alias(k) for k, c in a.items()])


@query(f"""
with t as (select lane, count(*) / (count(*) + 300.0) * avg(y - q) as c from {SCORED} where part = 0 group by lane), w as (select distinct user_id from {SCORED} where part = 0),
r as (select m.*, case when event_type in ('click', 'view') then 0.6 * m1 + 0.4 * m3 else m1 end as routed, w.user_id is not null as is_warm from {MEMBERS_SQL} m left join w using (user_id)),
x as (select r.*, case when is_warm then 0.5 * routed + 0.3 * m2 + 0.2 * m4 else 0.2 * routed + 0.5 * m2 + 0.3 * m4 end as mixed from r where part > 0),
z as (select x.*, 1 / (1 + exp(-(ln(mixed / (1 - mixed)) + 2.0 * coalesce(t.c, 0)))) as f from x left join t using (lane)),
s as (select *, list_sort([m1, m2, m3, m4]) as l from z), d as (select *, (l[2] + l[3]) / 2 as med from s),
h as (select *, greatest(abs(m1 - med), abs(m2 - med), abs(m3 - med), abs(m4 - med)) as sp from d), k as (select *, 1 / (1 + exp(-ln(f / (1 - f)) * (1 + 0.2 * greatest(1 - sp / 0.3, 0)))) as sharp from h)
select event_id, is_warm, round(mixed, 6) as mixed, round(1 / (1 + exp(-(ln(sharp / (1 - sharp)) / 1.1 - 0.05))), 6) as final from k
""")
def route_mix_correct(spark, sf_dir):
    """Routing, warm and cold mix, frozen logit corrections, sharpening by consensus, temperature and shift; tables come from part 0, rows from later parts."""
    d = members(spark, sf_dir)
    history = d.where("part = 0")
    frozen = history.groupBy("lane").agg((F.count("*") / (F.count("*") + 300.0) * F.avg(F.col("y") - F.col("q"))).alias("c"))
    rows = d.where("part > 0").withColumn("routed", n.route(F.col("event_type").isin("click", "view"), "m1", "m3"))
    rows = n.warm_mix(rows, history, "user_id", {"routed": 0.5, "m2": 0.3, "m4": 0.2}, {"routed": 0.2, "m2": 0.5, "m4": 0.3}, "mixed").withColumn("f", F.col("mixed"))
    rows = n.add_corrections(rows, "f", [(frozen, ["lane"], "c", 2.0)]).withColumn("sharp", n.sharpen("f", MEMBERS, 0.2, 0.3))
    return rows.select("event_id", "is_warm", x.report("mixed").alias("mixed"), x.report(n.temper("sharp", 1.1, -0.05)).alias("final"))


# Models


@query(f"""
with t as (select nullif(l_quantity, 7) as q, l_extendedprice as e, period from {LINES}), f as (select * from t where period <= 1998), md as (select median(q) as mq, median(e) as me from f),
s as (select avg(coalesce(q, mq)) as aq, stddev_pop(coalesce(q, mq)) as sq, avg(e) as ae, stddev_pop(e) as se from f, md)
select period, count(*) as n, sum(case when q is null then 1 else 0 end)::bigint as missing, round(avg((coalesce(q, mq) - aq) / sq), 6) + 0.0 as quantity, round(avg((e - ae) / se), 6) + 0.0 as price from t, md, s where period > 1998 group by period
""")
def fold_standardise(spark, sf_dir):
    """Median, mean and deviation of the years to 1998, applied to the later ones."""
    d = lines(spark, sf_dir).withColumn("q", F.nullif("l_quantity", F.lit(7.0)))
    fitted = m.fit_standard(period_scan(d, "l_shipdate", 1900, 1998), ["q", "l_extendedprice"])
    out = m.standardise(period_scan(d, "l_shipdate", 1999, 2100), fitted)
    return out.groupBy("period").agg(F.count("*").alias("n"), F.sum("q_missing").alias("missing"), x.report(F.avg("q")).alias("quantity"), x.report(F.avg("l_extendedprice")).alias("price"))


TREES = (np.array([[0, 1], [1, 0], [0, 0]]), np.array([[100.0, 12.0], [6.0, 200.0], [50.0, 300.0]]), np.array([[0.1, -0.2, 0.3, 0.05], [-0.1, 0.2, 0.15, -0.3], [0.02, 0.04, 0.06, 0.08]]))


@query("""
with t as (select event_id, value as a, hour(ts) as b from events)
select event_id, round(-1.0 + [0.1, -0.2, 0.3, 0.05][1 + (a > 100)::int + 2 * (b > 12)::int] + [-0.1, 0.2, 0.15, -0.3][1 + (b > 6)::int + 2 * (a > 200)::int] + [0.02, 0.04, 0.06, 0.08][1 + (a > 50)::int + 2 * (a > 300)::int], 6) as score from t
""")
def tree_score(spark, sf_dir):
    d = table(spark, sf_dir, "events")
    return d.select("event_id", x.report(m.oblivious_trees([F.col("value"), F.hour("ts")], *TREES, bias=-1.0)).alias("score"))


@query(f"""
with m as (select lane, sum(value) as w, sum(value * p) / sum(value) as mx, sum(value * y) / sum(value) as my, sum(value * p * y) / sum(value) as xy, sum(value * p * p) / sum(value) as xx, sum(value * y * y) / sum(value) as yy from {SCORED} group by lane)
select lane, round(mx, 6) as mean_x, round(my, 6) as mean_y, round(xy - mx * my, 6) + 0.0 as cov, round((xy - mx * my) / sqrt((xx - mx * mx) * (yy - my * my)), 5) + 0.0 as corr from m
""")
def weighted_moments(spark, sf_dir):
    out = e.weighted_moments(scored(spark, sf_dir), "p", "y", "value", ["lane"])
    return out.select("lane", *[x.report(c, 5 if c == "corr" else 6).alias(c) for c in ("mean_x", "mean_y", "cov", "corr")])


@query("with c as (select quantile_cont(event_id, 0.7) as cut from events) select event_id <= cut as is_first, count(*) as n, min(event_id) as lowest, max(event_id) as highest from events, c group by 1")
def position_split(spark, sf_dir):
    from ..sources.io import position_split as split

    d = split(table(spark, sf_dir, "events").select("event_id"), "event_id")
    return d.groupBy("is_first").agg(F.count("*").alias("n"), F.min("event_id").alias("lowest"), F.max("event_id").alias("highest"))


@query(f"""
with g as (select part, round(p, 9) as p, sum(y) as pos, sum(1 - y) as neg from {SCORED} group by all),
w as (select *, coalesce(sum(neg) over (partition by part order by p rows between unbounded preceding and 1 preceding), 0) as below from g)
select part, sum(pos + neg)::bigint as n, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) as auc from w group by part
""")
def auc_by_period(spark, sf_dir):
    return e.auc(scored(spark, sf_dir), "p", "y", ["part"]).withColumn("auc", x.report("auc"))


@query(f"""
with t as (select l_linestatus, period, avg(y) as r from {LINES} group by all), h as (select a.period as test, b.l_linestatus, sum(b.y) / count(*) as p from (select distinct period from {LINES} where period >= (select min(period) + 3 from {LINES})) a join {LINES} b on b.period between a.period - 3 and a.period - 1 group by all),
s as (select test, l.l_linestatus, y, p from {LINES} l join h on h.test = l.period and h.l_linestatus = l.l_linestatus)
select test::int as test, count(*) as n, round(avg((p - y) ** 2), 6) as brier from s group by test
""")
def rolling_origin(spark, sf_dir):
    """Three years give the rates of the next one, for every year with three before it."""
    r = e.rolling_rates(lines(spark, sf_dir), ["l_linestatus"], "period", "y", 3)
    return e.rolling_brier(r, "period").select(F.col("period").alias("test"), "n", x.report("brier").alias("brier"))


@query(f"""
with h as (select user_id, avg(y) as r from {SCORED} where part = 0 group by user_id), c as (select user_id, count(*) as n, avg(y) as r from {SCORED} where part = 1 group by user_id),
r as (select s.event_id, s.q, coalesce(c.n, 0) as n, least(greatest(coalesce(c.r, 0.2), 0.01), 0.99) as cr, least(greatest(coalesce(h.r, 0.2), 0.01), 0.99) as hr from {SCORED} s left join c using (user_id) left join h using (user_id) where part = 2)
select event_id, round(1 / (1 + exp(-(ln(q / (1 - q)) + case when n > 0 then 0.5 * n / (n + 20.0) * (ln(cr / (1 - cr)) - ln(hr / (1 - hr))) else 0 end))), 6) as corrected from r
""")
def form_correction(spark, sf_dir):
    d = scored(spark, sf_dir)
    h = d.where("part = 0").groupBy("user_id").agg(F.avg("y").alias("hr"))
    c = d.where("part = 1").groupBy("user_id").agg(F.count("*").alias("n"), F.avg("y").alias("cr"))
    r = d.where("part = 2").join(c, "user_id", "left").join(h, "user_id", "left")
    return r.select("event_id", x.report(n.form_correction("q", F.coalesce("cr", F.lit(0.2)), F.coalesce("n", F.lit(0)), F.coalesce("hr", F.lit(0.2)), 0.5, 20.0)).alias("corrected"))


@query(f"""
with t as (select event_id, value / 100 as a, hour / 12.0 as b from {SCORED}),
d as (select *, -((a - 0.5) ** 2 + (b - 0.5) ** 2) / 0.5 as d1, -((a - 1) ** 2 + (b - 1) ** 2) / 0.5 as d2, -((a - 2) ** 2 + (b - 1.5) ** 2) / 0.5 as d3 from t),
w as (select *, exp(d1 - greatest(d1, d2, d3)) as w1, exp(d2 - greatest(d1, d2, d3)) as w2, exp(d3 - greatest(d1, d2, d3)) as w3 from d)
select event_id, round((0.1 * w1 + 0.3 * w2 + 0.7 * w3) / (w1 + w2 + w3), 6) as score from w
""")
def softmax_neighbours(spark, sf_dir):
    d = scored(spark, sf_dir)
    return d.select("event_id", x.report(m.softmax_neighbours([F.col("value") / 100, F.col("hour") / 12.0], np.array([[0.5, 0.5], [1, 1], [2, 1.5]]), np.array([0.1, 0.3, 0.7]), 0.5)).alias("score"))


@query(f"""
select period, sum(case when l_linestatus = 'F' and period < 1998 then 1 else 0 end)::bigint as before, sum(case when l_linestatus = 'F' and period >= 1998 then 1 else 0 end)::bigint as after, sum(case when l_linestatus <> 'F' then 1 else 0 end)::bigint as other,
  round(count(*) / greatest(max(month(l_shipdate)), 1), 4) as per_month from {LINES} group by period
""")
def regime_indicators(spark, sf_dir):
    from ..operators import history as h

    d = lines(spark, sf_dir).withColumns(h.regime_indicators(F.col("l_linestatus") == "F", "period", 1998))
    return d.groupBy("period").agg(F.sum("regime_before").alias("before"), F.sum("regime_after").alias("after"), F.sum("regime_other").alias("other"), x.report(h.rate_per_month(F.count("*"), F.max(F.month("l_shipdate")), 1), 4).alias("per_month"))


@query()
def kmeans_profile(spark, sf_dir):
    d = m.kmeans(table(spark, sf_dir, "embeddings"), "embedding", 8)
    return d.groupBy("cluster", "label").agg(F.count("*").alias("n"))


@query()
def bin_logit(spark, sf_dir):
    d = m.bin_logit(lines(spark, sf_dir).select("l_quantity", "l_extendedprice", "l_discount", "y"), ["l_quantity", "l_extendedprice", "l_discount"], "y")
    return d.agg(F.count("*").alias("n"), x.report(F.avg("p"), 4).alias("mean_p"), x.report(F.avg("y"), 4).alias("rate"))


@query()
def bootstrap_ci(spark, sf_dir):
    d = scored(spark, sf_dir)
    return e.bootstrap(d, "event_id", F.pow(F.col("q") - F.col("y"), 2) - F.pow(F.col("p") - F.col("y"), 2), 100)


@query(f"""
with g as (select round(p, 9) as p, sum(y) as pos, sum(1 - y) as neg from {SCORED} group by 1), w as (select *, coalesce(sum(neg) over (order by p rows between unbounded preceding and 1 preceding), 0) as below from g)
select sum(pos + neg)::bigint as n, round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) as auc from w
""")
def auc_overall(spark, sf_dir):
    return e.auc(scored(spark, sf_dir), "p", "y").withColumn("auc", x.report("auc"))
