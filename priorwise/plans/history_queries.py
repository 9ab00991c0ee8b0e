"""Queries of the history operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.expr import report
from ..operators import history as h
from ..sources.io import period_scan, table
from .base import EVENTS, LINES, events, lines, query

TRIPLE = f"""
with g as (select {{keys}}, period, count(*) as n, sum(y)::double as s from {{source}} group by all),
p as (select {{cell}}, period, sum(n) as n, sum(s) as s from g group by all),
m as (select {{cell}}, period, sum(s) over w / nullif(sum(n) over w, 0) as prior from p window w as (partition by {{cell}} order by period range between unbounded preceding and 1 preceding)),
st as (select *, coalesce(sum(n) over w, 0) as n_prior, coalesce(sum(s) over w, 0) as s_prior from g window w as (partition by {{keys}} order by period range between unbounded preceding and 1 preceding)),
r as (select st.*, coalesce(m.prior, 0.5) as prior, (s_prior + 200.0 * coalesce(m.prior, 0.5)) / (n_prior + 200.0) as rate from st left join m using ({{cell}}, period))
select {{keys}}, period, n_prior::bigint as n_prior, s_prior::bigint as s_prior, round(rate, 6) as rate, round(rate - prior, 6) + 0.0 as dev, round(ln(1 + n_prior), 6) as conf from r
"""


def _triple(df):
    return df.withColumns({"n_prior": F.col("n_prior").cast("long"), "s_prior": F.col("s_prior").cast("long"), **{c: report(c) for c in ("rate", "dev", "conf")}})


@query(TRIPLE.format(keys="l_suppkey, l_linestatus", cell="l_linestatus", source=LINES))
def prior_period_triple(spark, sf_dir):
    return _triple(h.prior_period_triple(lines(spark, sf_dir), ["l_suppkey"], ["l_linestatus"], "period", "y"))


@query(TRIPLE.format(keys="l_suppkey, l_linestatus, l_returnflag", cell="l_linestatus, l_returnflag", source=LINES.replace("l_returnflag = 'R'", "l_discount > 0.05")))
def prior_period_triple_fine(spark, sf_dir):
    df = lines(spark, sf_dir).withColumn("y", (F.col("l_discount") > 0.05).cast("int"))
    return _triple(h.prior_period_triple(df, ["l_suppkey"], ["l_linestatus", "l_returnflag"], "period", "y"))


@query(TRIPLE.format(keys="l_partkey, l_linestatus", cell="l_linestatus", source=LINES))
def counterpart_triple(spark, sf_dir):
    return _triple(h.prior_period_triple(lines(spark, sf_dir), ["l_partkey"], ["l_linestatus"], "period", "y"))


@query(f"""
with t as (select * from {LINES} where l_shipdate >= timestamp '1995-01-01' and l_shipdate < timestamp '2000-01-01'),
g as (select l_suppkey, l_linestatus, count(*) as n, sum(y) as s from t group by all), m as (select l_linestatus, avg(y) as prior from t group by all),
f as (select l_suppkey, l_linestatus, (s + 200.0 * prior) / (n + 200.0) as rate, (s + 200.0 * prior) / (n + 200.0) - prior as dev, ln(1 + n) as conf from g join m using (l_linestatus)),
x as (select l_suppkey, l_linestatus, count(*) as n_rows from {LINES} where period >= 2000 group by all)
select x.l_suppkey, x.l_linestatus, n_rows, round(coalesce(rate, 0.5), 6) as rate, round(coalesce(dev, 0), 6) + 0.0 as dev, round(coalesce(conf, 0), 6) as conf from x left join f using (l_suppkey, l_linestatus)
""")
def frozen_lookup(spark, sf_dir):
    """Tables of 1995 to 1999 applied to the rows of later years."""
    df = lines(spark, sf_dir)
    frozen = h.frozen_triple(period_scan(df, "l_shipdate", 1995, 1999), ["l_suppkey"], ["l_linestatus"], "period", 1999, "y")
    rows = period_scan(df, "l_shipdate", 2000, 2100).groupBy("l_suppkey", "l_linestatus").agg(F.count("*").alias("n_rows"))
    out = h.apply_frozen(rows, frozen, ["l_suppkey", "l_linestatus"], {"rate": 0.5, "dev": 0.0, "conf": 0.0})
    return out.withColumns({c: report(c) for c in ("rate", "dev", "conf")})


@query(f"""
with a as (select *, row_number() over u - 1 as n_entity, coalesce(sum(y) over (u rows between unbounded preceding and 1 preceding), 0) as s_entity,
  row_number() over c - 1 as n_cell, coalesce(sum(y) over (c rows between unbounded preceding and 1 preceding), 0) as s_cell from {EVENTS}
  window u as (partition by user_id order by ts, event_id), c as (partition by user_id, event_type order by ts, event_id)),
b as (select *, (s_entity + 25.0) / (n_entity + 50.0) as base from a)
select event_id, n_entity, n_cell, round(base, 6) as base, round((s_cell + 50.0 * base) / (n_cell + 50.0) - base, 6) + 0.0 as dev from b
""")
def asof_row_deviation(spark, sf_dir):
    out = h.asof_deviation(events(spark, sf_dir), "user_id", "event_type", ["ts", "event_id"], F.col("y"))
    return out.select("event_id", F.col("n_entity").cast("long").alias("n_entity"), F.col("n_cell").cast("long").alias("n_cell"), report("base").alias("base"), report("dev").alias("dev"))


@query(f"""
with g as (select l_suppkey, l_linestatus, period, count(*) as n, sum(y) as s from {LINES} group by all),
f as (select *, coalesce(sum(n) over w, 0) as n2, coalesce(sum(s) over w, 0) as s2 from g window w as (partition by l_suppkey, l_linestatus order by period range between unbounded preceding and 1 preceding)),
u as (select l_suppkey, period, sum(n) as n, sum(s) as s from g group by all),
u1 as (select l_suppkey, period, coalesce(sum(n) over w, 0) as n1, coalesce(sum(s) over w, 0) as s1 from u window w as (partition by l_suppkey order by period range between unbounded preceding and 1 preceding)),
t as (select period, sum(n) as n, sum(s) as s from g group by all),
m as (select period, sum(s) over w / nullif(sum(n) over w, 0) as prior from t window w as (order by period range between unbounded preceding and 1 preceding))
select l_suppkey, l_linestatus, f.period, round(case when n2 >= 1 then (s2 + 100.0 * prior) / (n2 + 100.0) when n1 >= 1 then (s1 + 100.0 * prior) / (n1 + 100.0) else prior end, 6) as rate,
  case when n2 >= 1 then 2 when n1 >= 1 then 1 else 0 end as level from f join u1 using (l_suppkey, period) left join m using (period)
""")
def backoff_rate(spark, sf_dir):
    return h.backoff_rate(lines(spark, sf_dir), ["l_suppkey"], ["l_linestatus"], "period", F.col("y")).withColumn("rate", report("rate"))


@query(f"""
with c as (select user_id, event_type, count(*) as n, sum(y) as s from {EVENTS} group by all),
b as (select *, (sum(s) over (partition by user_id) + 300.0 * (select sum(s) / sum(n) from c)) / (sum(n) over (partition by user_id) + 300.0) as base from c)
select user_id, event_type, n, round(base, 6) as base, round((s + 300.0 * base) / (n + 300.0) - base, 6) + 0.0 as dev from b
""")
def hier_shrunk_dev(spark, sf_dir):
    return h.hier_shrunk_dev(events(spark, sf_dir), "user_id", "event_type", F.col("y")).withColumns({"base": report("base"), "dev": report("dev")})


def _league(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("league"))
    return lines(spark, sf_dir).select("l_suppkey", "l_linestatus", "period", "y").join(s, "l_suppkey")


LEAGUE = f"(select l.l_suppkey, l.l_linestatus, l.period, l.y, s.s_nationkey as league from {LINES} l join supplier s on s.s_suppkey = l.l_suppkey)"
CUM = "range between unbounded preceding and 1 preceding"


@query(f"""
with g as (select l_suppkey, l_linestatus, league, period, count(*) as n, sum(y) as s from {LEAGUE} group by all),
c as (select *, coalesce(sum(n) over w, 0) as n_c, coalesce(sum(s) over w, 0) as s_c from g window w as (partition by l_suppkey, l_linestatus, league order by period {CUM})),
e0 as (select l_suppkey, league, period, sum(n) as n, sum(s) as s from g group by all),
e as (select l_suppkey, league, period, coalesce(sum(n) over w, 0) as n_e, coalesce(sum(s) over w, 0) as s_e from e0 window w as (partition by l_suppkey, league order by period {CUM})),
pc0 as (select league, l_linestatus, period, sum(n) as n, sum(s) as s from g group by all),
pc as (select league, l_linestatus, period, sum(s) over w / nullif(sum(n) over w, 0) as p_c from pc0 window w as (partition by league, l_linestatus order by period {CUM})),
pe0 as (select league, period, sum(n) as n, sum(s) as s from g group by all),
pe as (select league, period, sum(s) over w / nullif(sum(n) over w, 0) as p_e from pe0 window w as (partition by league order by period {CUM}))
select l_suppkey, l_linestatus, league, period, n_c::bigint as n_c, round(coalesce((s_c + 300.0 * p_c) / (n_c + 300.0) - (s_e + 300.0 * p_e) / (n_e + 300.0) - (p_c - p_e), 0), 6) + 0.0 as dev
from c join e using (l_suppkey, league, period) left join pc using (league, l_linestatus, period) left join pe using (league, period)
""")
def platoon_dev(spark, sf_dir):
    out = h.league_deviation(_league(spark, sf_dir), "l_suppkey", "l_linestatus", "league", "period", F.col("y"))
    return out.withColumns({"n_c": F.col("n_c").cast("long"), "dev": report("dev")})


@query(f"""
with g as (select l_suppkey, l_linestatus, league, period, count(*) as n, sum(y) as s from {LEAGUE} group by all),
c as (select *, coalesce(sum(n) over w, 0) as n_c, coalesce(sum(s) over w, 0) as s_c from g window w as (partition by l_suppkey, l_linestatus, league order by period {CUM})),
e0 as (select l_suppkey, league, period, sum(n) as n, sum(s) as s from g group by all),
e as (select l_suppkey, league, period, coalesce(sum(n) over w, 0) as n_e, coalesce(sum(s) over w, 0) as s_e from e0 window w as (partition by l_suppkey, league order by period {CUM})),
pc as (select league, l_linestatus, sum(s) / sum(n) as p_c from g group by all), pe as (select league, sum(s) / sum(n) as p_e from g group by all)
select l_suppkey, l_linestatus, league, period, n_c::bigint as n_c, round((s_c + 300.0 * p_c) / (n_c + 300.0) - (s_e + 300.0 * p_e) / (n_e + 300.0) - (p_c - p_e), 6) + 0.0 as dev
from c join e using (l_suppkey, league, period) join pc using (league, l_linestatus) join pe using (league)
""")
def platoon_dev_frozen_league(spark, sf_dir):
    """The half-strict form: counts of earlier periods, league means of all."""
    out = h.league_deviation(_league(spark, sf_dir), "l_suppkey", "l_linestatus", "league", "period", F.col("y"), frozen_prior=True)
    return out.withColumns({"n_c": F.col("n_c").cast("long"), "dev": report("dev")})


@query(f"""
with g as (select l_suppkey, l_linestatus, league, period, count(*) as n, sum(y) as s from {LEAGUE} group by all),
ec as (select *, coalesce(sum(n) over w, 0) as n_ec, coalesce(sum(s) over w, 0) as s_ec from g window w as (partition by l_suppkey, l_linestatus, league order by period {CUM})),
e0 as (select l_suppkey, league, period, sum(n) as n, sum(s) as s from g group by all), e as (select l_suppkey, league, period, coalesce(sum(n) over w, 0) as n_e, coalesce(sum(s) over w, 0) as s_e from e0 window w as (partition by l_suppkey, league order by period {CUM})),
lc0 as (select league, l_linestatus, period, sum(n) as n, sum(s) as s from g group by all), lc as (select league, l_linestatus, period, coalesce(sum(n) over w, 0) as n_lc, coalesce(sum(s) over w, 0) as s_lc from lc0 window w as (partition by league, l_linestatus order by period {CUM})),
l0 as (select league, period, sum(n) as n, sum(s) as s from g group by all), l as (select league, period, coalesce(sum(n) over w, 0) as n_l, coalesce(sum(s) over w, 0) as s_l from l0 window w as (partition by league order by period {CUM})),
j as (select *, (s_l + 50.0) / (n_l + 100.0) as p_l from ec join e using (l_suppkey, league, period) join lc using (league, l_linestatus, period) join l using (league, period)),
k as (select *, (s_lc + 100.0 * p_l) / (n_lc + 100.0) as p_lc from j)
select l_suppkey, l_linestatus, league, period, n_ec::bigint as n_ec, n_e::bigint as n_e, n_lc::bigint as n_lc, n_l::bigint as n_l, round((s_ec + 100.0 * p_lc) / (n_ec + 100.0), 6) as rate, round((s_e + 100.0 * p_l) / (n_e + 100.0), 6) as base from k
""")
def long_form_priors(spark, sf_dir):
    out = h.long_form_priors(_league(spark, sf_dir), "l_suppkey", "l_linestatus", "league", "period", F.col("y"))
    return out.select("l_suppkey", "l_linestatus", "league", "period", *[F.col(c).cast("long").alias(c) for c in ("n_ec", "n_e", "n_lc", "n_l")], report("rate").alias("rate"), report("base").alias("base"))


WEEK = "cast(floor((epoch(ts) - 4 * 86400) / 604800) as bigint)"


def _cumulative(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("week", F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - 4 * 86400) / 604800))
    df = h.asof_sums(df, ["user_id"], ["ts", "event_id"], {"n_before": F.lit(1), "s_before": F.col("y")})
    return df.withColumn("rate", F.when(F.col("n_before") > 0, F.col("s_before") / F.col("n_before")))


@query(f"""
with a as (select *, {WEEK} as week, row_number() over u - 1 as n_before, coalesce(sum(y) over (u rows between unbounded preceding and 1 preceding), 0) as s_before from {EVENTS} window u as (partition by user_id order by ts, event_id)),
r as (select *, round_even(coalesce(s_before / nullif(n_before, 0), 0) * n_before, 0)::bigint as s_cum from a)
select event_id, week, n_before::bigint as n_before, s_cum, greatest(n_before - first(n_before) over w, 0)::bigint as n_in, greatest(s_cum - first(s_cum) over w, 0)::bigint as s_in from r window w as (partition by user_id, week order by ts, event_id)
""")
def in_period_counts(spark, sf_dir):
    """Counts within a week, rebuilt from cumulative rates and their numbers."""
    df = _cumulative(spark, sf_dir).withColumn("s_cum", h.recovered_counts("rate", "n_before"))
    out = h.in_period_counts(df, "user_id", "week", ["ts", "event_id"], "n_before", "s_cum")
    return out.select("event_id", "week", *[F.col(c).cast("long").alias(c) for c in ("n_before", "s_cum", "n_in", "s_in")])


@query(f"""
with a as (select *, (coalesce(sum(y) over (u rows between unbounded preceding and 1 preceding), 0) + 10.0) / (row_number() over u - 1 + 20.0) as x from {EVENTS} window u as (partition by user_id order by ts, event_id))
select event_type, count(*) as n, round(avg(y) - (select avg(y) from a), 6) + 0.0 as effect, round(least(greatest(regr_slope(y, x), 0.2), 1.8), 6) as slope from a group by event_type
""")
def cell_effect_slope(spark, sf_dir):
    df = h.asof_sums(events(spark, sf_dir), ["user_id"], ["ts", "event_id"], {"n_before": F.lit(1), "s_before": F.col("y")})
    df = df.withColumn("x", h.shrunk(F.col("s_before"), F.col("n_before"), 0.5, 20.0))
    return h.cell_effects(df, "event_type", "x", "y", 0.2, 1.8).withColumns({"effect": report("effect"), "slope": report("slope")})


@query(f"""
with e as (select *, value / 100.0 as x from {EVENTS}),
m as (select event_id, count(*) over w as n, sum(x) over w as sx, sum(y) over w as sy, sum(x * y) over w as sxy, sum(x * x) over w as sxx from e window w as (partition by event_type order by ts, event_id rows between unbounded preceding and 1 preceding)),
s as (select *, case when n >= 2 and sxx / n - (sx / n) ** 2 > 1e-12 then (sxy / n - sx * sy / (n * n)) / (sxx / n - (sx / n) ** 2) else 1.0 end as slope from m)
select event_id, n::bigint as n_before, round(1 + n / (n + 100.0) * (slope - 1), 5) as slope, round(case when n > 0 then n / (n + 100.0) * sy / n else 0 end, 6) as mean from s
""")
def asof_cell_slope(spark, sf_dir):
    df = events(spark, sf_dir).withColumns({"x": F.col("value") / 100.0, "day": F.to_date("ts")})
    out = h.asof_cell_slope(df, "event_type", "day", ["ts", "event_id"], "x", "y")
    return out.select("event_id", F.col("n_before").cast("long").alias("n_before"), report("slope", 5).alias("slope"), report("mean").alias("mean"))


@query(f"""
with g as (select l_linestatus, l_suppkey, count(*) as n, avg(y) as r from {LINES} group by all),
m as (select l_linestatus, count(*) as entities, sum(r * n) / sum(n) as p, var_pop(r) as v, avg(1.0 / n) as i from g group by all)
select l_linestatus, entities, round(p, 6) as p, round(case when v - p * (1 - p) * i > 1e-12 then p * (1 - p) / (v - p * (1 - p) * i) end, 2) as strength from m
""")
def shrinkage_strength(spark, sf_dir):
    return h.shrinkage_strength(lines(spark, sf_dir), "l_suppkey", "l_linestatus", F.col("y")).withColumns({"p": report("p"), "strength": report("strength", 2)})


@query(f"""
with g as (select period, l_suppkey, count(*) as n, avg(y) as r from {LINES} group by all having count(*) >= 20)
select period, count(*) as entities, round(var_pop(r), 8) as observed, round(avg(r * (1 - r) / n), 8) as noise, round(greatest(var_pop(r) - avg(r * (1 - r) / n), 0), 8) + 0.0 as true_variance from g group by period
""")
def between_entity_variance(spark, sf_dir):
    out = h.between_entity_variance(lines(spark, sf_dir), "l_suppkey", "period", F.col("y"))
    return out.withColumns({c: report(c, 8) for c in ("observed", "noise", "true_variance")})


@query(f"""
with g as (select l_suppkey, period, sum(l_discount * l_quantity) as xw, sum(l_quantity) as w from {LINES} group by all),
s as (select l_suppkey, period, sum(xw) over w as a, coalesce(sum(w) over w, 0) as b from g window w as (partition by l_suppkey order by period {CUM}))
select l_suppkey, period, round(a / nullif(b, 0), 6) as mean_prior, b as weight_prior from s
""")
def weighted_prior_mean(spark, sf_dir):
    return h.weighted_prior_mean(lines(spark, sf_dir), ["l_suppkey"], "period", "l_discount", "l_quantity").withColumn("mean_prior", report("mean_prior"))


@query(f"""
with g as (select l_suppkey, period, avg(y) as r from {LINES} group by all),
p as (select a.l_suppkey, a.period, (coalesce(5 * b.r, 0) + coalesce(4 * c.r, 0) + coalesce(3 * d.r, 0)) / nullif((case when b.r is not null then 5 else 0 end + case when c.r is not null then 4 else 0 end + case when d.r is not null then 3 else 0 end), 0) as projected
  from g a left join g b on b.l_suppkey = a.l_suppkey and b.period = a.period - 1 left join g c on c.l_suppkey = a.l_suppkey and c.period = a.period - 2 left join g d on d.l_suppkey = a.l_suppkey and d.period = a.period - 3)
select l_suppkey, period, round(projected, 6) as projected, round(case when stddev_pop(projected) over w > 1e-9 then (projected - avg(projected) over w) / stddev_pop(projected) over w else 0 end, 5) + 0.0 as z from p window w as (partition by period)
""")
def projection(spark, sf_dir):
    g = lines(spark, sf_dir).groupBy("l_suppkey", "period").agg(F.avg("y").alias("r"))
    return h.projection(g, ["l_suppkey"], "period", "r").withColumns({"projected": report("projected"), "z": report("z", 5)})


@query(f"""
with g as (select l_suppkey, period, count(*) as n, sum(l_discount) as v, count(*) filter (y = 1) as nc, coalesce(sum(l_discount) filter (y = 1), 0) as vc from {LINES} group by all),
s as (select l_suppkey, period, coalesce(sum(n) over w, 0) as n, sum(v) over w as v, coalesce(sum(nc) over w, 0) as nc, sum(vc) over w as vc from g window w as (partition by l_suppkey order by period {CUM}))
select l_suppkey, period, n::bigint as n_prior, nc::bigint as nc_prior, round(case when n >= 30 and nc >= 30 then vc / nc - v / n else 0 end, 6) + 0.0 as mod from s
""")
def conditional_modulation(spark, sf_dir):
    out = h.modulation(lines(spark, sf_dir), "l_suppkey", "period", "l_discount", F.col("y") == 1)
    return out.withColumns({"n_prior": F.col("n_prior").cast("long"), "nc_prior": F.col("nc_prior").cast("long"), "mod": report("mod")})


@query(f"""
with u as (select 'l_returnflag' as axis, l_returnflag as cell, l_discount, l_quantity from lineitem union all select 'l_linestatus', l_linestatus, l_discount, l_quantity from lineitem),
g as (select axis, cell, count(*) as n, sum(case when l_discount > 0.05 then 1 else 0 end) as a, sum(case when l_quantity > 25 then 1 else 0 end) as b from u group by all),
v as (select 'cheap' as label, axis, cell, n, a as s from g union all select 'large', axis, cell, n, b from g)
select label, axis, cell, n, round(n / (n + 300.0) * (s / n - sum(s) over w / sum(n) over w), 6) + 0.0 as dev from v window w as (partition by label, axis)
""")
def label_axis_grid(spark, sf_dir):
    labels = {"cheap": (F.col("l_discount") > 0.05).cast("int"), "large": (F.col("l_quantity") > 25).cast("int")}
    return h.label_axis_grid(lines(spark, sf_dir), labels, ["l_returnflag", "l_linestatus"]).withColumn("dev", report("dev"))


@query(f"""
with w as (select period, pow(0.9, period - 1995) * case when l_linestatus = 'F' and period < 1998 then 0.5 else 1.0 end as w, y from {LINES})
select period, count(*) as n, round(sum(w), 4) as weight, round(sum(w * y) / sum(w), 6) as weighted_rate from w group by period
""")
def decayed_weights(spark, sf_dir):
    w = h.decay_weight("period", 1995, 0.9, (F.col("l_linestatus") == "F") & (F.col("period") < 1998), 0.5)
    return lines(spark, sf_dir).withColumn("w", w).groupBy("period").agg(F.count("*").alias("n"), report(F.sum("w"), 4).alias("weight"), report(F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("weighted_rate"))


@query(f"""
with r as (select user_id, event_id, ts, value, count(*) over (partition by user_id order by ts, event_id) as n, avg(y) over (partition by user_id order by ts, event_id) as rate from {EVENTS})
select user_id, arg_max(value, (ts, event_id)) as value, round(arg_max(rate, (ts, event_id)), 6) as rate, arg_max(n, (ts, event_id)) as n from r group by user_id having arg_max(n, (ts, event_id)) >= 10
""")
def latest_state(spark, sf_dir):
    from pyspark.sql import Window

    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    df = events(spark, sf_dir).withColumns({"n": F.count("*").over(w), "rate": F.avg("y").over(w)})
    return h.latest_state(df, "user_id", ["ts", "event_id"], ["value", "rate"], 10, "n").select("user_id", "value", report("rate").alias("rate"), "n")


@query(f"""
with t as (select user_id, count(*) as n, sum(y) as s from {EVENTS} where day(ts) <= 20 group by user_id),
c as (select event_id, user_id, ts, row_number() over w - 1 as n, coalesce(sum(y) over (w rows between unbounded preceding and 1 preceding), 0) as s from {EVENTS} window w as (partition by user_id order by ts, event_id))
select event_id, greatest(c.n - coalesce(t.n, 0), 0)::bigint as n_in, greatest(c.s - coalesce(t.s, 0), 0)::bigint as s_in from c left join t using (user_id) where day(ts) > 20
""")
def scoring_counts(spark, sf_dir):
    """Counts since the frozen totals of the first twenty days."""
    d = events(spark, sf_dir)
    totals = d.where(F.dayofmonth("ts") <= 20).groupBy("user_id").agg(F.count("*").alias("n"), F.sum("y").alias("s"))
    rows = h.asof_sums(d, ["user_id"], ["ts", "event_id"], {"n": F.lit(1), "s": F.col("y")}).where(F.dayofmonth("ts") > 20)
    out = h.scoring_counts(rows, totals, "user_id", "n", "s")
    return out.select("event_id", F.col("n_in").cast("long").alias("n_in"), F.col("s_in").cast("long").alias("s_in"))
