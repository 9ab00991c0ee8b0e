"""Queries of fitted temperatures, seed combinations and bootstrapped scores."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from ..functions import expr as x
from ..operators import calibrate as c
from ..operators import variants as v
from .base import query
from .evaluate_queries import SCORED, scored

SCALES = [0.25, 0.5, 0.75, 1.0, 1.25, 1.5]
LOGITS = f"z as materialized (select part, ln(p / (1 - p)) as z, y from {SCORED})"
_Q = "1 / (1 + exp(-(s.a * z.z + s.b)))"


@query(f"""
with recursive {LOGITS}, start as (select part, unnest({SCALES}) as a from (select distinct part from z)),
s(i, part, a, b) as (select 0, part, a::double, 0.0::double from start union all
  select i + 1, part, a, b - least(greatest(g / h, -0.1), 0.1) from (
    select i, part, a, b, 2 * avg((q - y) * q * (1 - q)) as g, 2 * avg(q * q * (1 - q) * (1 - q) + (q - y) * q * (1 - q) * (1 - 2 * q)) as h
    from (select s.i, s.part, s.a, s.b, z.y, {_Q} as q from s join z on z.part = s.part where s.i < 10) group by all)),
f as (select s.part, s.a, s.b, avg(({_Q} - y) ** 2) as e, avg(y) as r from s join z on z.part = s.part where s.i = 10 group by all),
best as (select part, arg_min(a, (round(e, 12), a)) as scale, arg_min(b, (round(e, 12), a)) as b, min(e) as e, min(r) as r from f group by part)
select part, scale, round(b, 6) + 0.0 as intercept, round(e, 8) as brier, round(100000 * (1 - e / (r * (1 - r))), 3) as skill from best
""")
def temperature_search(spark, sf_dir):
    """For each third of a month the best of six scales, each with its fitted intercept."""
    d = c.best_temperature(scored(spark, sf_dir), "p", "y", SCALES, "part")
    return d.select("part", "scale", x.report("intercept").alias("intercept"), x.report("brier", 8).alias("brier"), x.report("skill", 3).alias("skill"))


@query(f"""
with recursive {LOGITS},
grid as (select unnest(range(21)) / 10.0::double as a), shifts as (select unnest(range(-8, 5)) / 4.0::double as b),
s(i, a, b) as (select 0, arg_min(a, e), arg_min(b, e) from (select s.a, s.b, avg(({_Q} - y) ** 2) as e from (select a, b from grid, shifts) s, z group by all) union all
  select i + 1, a - least(greatest((ga * hbb - gb * hab) / (haa * hbb - hab * hab), -0.5), 0.5), b - least(greatest((gb * haa - ga * hab) / (haa * hbb - hab * hab), -0.5), 0.5) from (
    select i, a, b, avg(g * z) as ga, avg(g) as gb, avg(h * z * z) as haa, avg(h * z) as hab, avg(h) as hbb from (
      select i, a, b, z, (q - y) * q * (1 - q) as g, q * q * (1 - q) * (1 - q) + (q - y) * q * (1 - q) * (1 - 2 * q) as h
      from (select s.i, s.a, s.b, z.z, z.y, {_Q} as q from s, z where s.i < 12)) group by all)),
f as (select a, b, count(*) as n, avg(({_Q} - y) ** 2) as e, avg(y) as r from s, z where s.i = 12 group by all)
select round(a, 5) + 0.0 as scale, round(b, 5) + 0.0 as intercept, n, round(e, 8) as brier, round(100000 * (1 - e / (r * (1 - r))), 3) as skill from f
""")
def temperature_fit(spark, sf_dir):
    """Scale and intercept fitted together. Predictions of this table say little, so the best scale is near 0; SQL starts at the best point of a grid."""
    d = c.fit_temperature(scored(spark, sf_dir), "p", "y")
    return d.select(x.report("scale", 5).alias("scale"), x.report("intercept", 5).alias("intercept"), "n", x.report("brier", 8).alias("brier"), x.report("skill", 3).alias("skill"))


BRANCHES = {"all": {"1": "a1", "2": "a2", "3": "a3"}, "left": {"1": "l1", "2": "l2"}, "right": {"1": "r1", "2": "r2", "3": "r3"}}
ROUTES = {0: {"all": 0.6, "left": 0.4}, 1: {"all": 0.3, "right": 0.7}}
SIZES = {"all": 2, "left": 1, "right": 2}
#: Predictions of a seed: the branch's, moved by up to 0.05 by the row and the seed.
SEEDS = {name: (base, k) for k, (base, name) in enumerate([("p", "a1"), ("p", "a2"), ("p", "a3"), ("q", "l1"), ("q", "l2"), ("0.5 * p + 0.5 * q", "r1"), ("0.5 * p + 0.5 * q", "r2"), ("0.5 * p + 0.5 * q", "r3")], 3)}
SEED_SQL = {name: f"(({base}) + 0.05 * (((event_id * {2 * k + 1} + {k * 37}) % 101) / 100.0 - 0.5))" for name, (base, k) in SEEDS.items()}


def _seeded(spark, sf_dir):
    d = scored(spark, sf_dir)
    return d.select("event_id", "y", (F.col("lane") >= 4).cast("int").alias("route"), *[F.expr(e.replace("100.0", "100.0D").replace("0.05", "0.05D").replace("0.5 *", "0.5D *")).alias(k) for k, e in SEED_SQL.items()])


SEEDED = f"(select event_id, y, case when lane >= 4 then 1 else 0 end as route, {', '.join(f'{e}::double as {k}' for k, e in SEED_SQL.items())} from {SCORED})"


def _mean(branch, chosen) -> str:
    return "(" + " + ".join(BRANCHES[branch][s] for s in chosen) + f") / {len(chosen)}"


def _one_combination(chosen: dict) -> str:
    p = "case route " + " ".join(f"when {r} then " + " + ".join(f"{w} * {_mean(b, chosen[b])}" for b, w in ws.items()) for r, ws in ROUTES.items()) + " end"
    name = " ".join(f"{b}:{'+'.join(chosen[b])}" for b in sorted(chosen))
    return f"select '{name}' as combination, round(avg(({p} - y) ** 2), 8) as brier, round(100000 * (1 - avg(({p} - y) ** 2) / (avg(y) * (1 - avg(y)))), 3) as skill from d"


CHOICES = [dict(zip(sorted(BRANCHES), some)) for some in itertools.product(*[itertools.combinations(sorted(BRANCHES[b]), SIZES[b]) for b in sorted(BRANCHES)])]


@query(f"with d as materialized {SEEDED} " + " union all ".join(_one_combination(some) for some in CHOICES))
def seed_combinations(spark, sf_dir):
    d = v.seed_combinations(_seeded(spark, sf_dir), BRANCHES, ROUTES, "route", "y", SIZES)
    return d.select("combination", x.report("brier", 8).alias("brier"), x.report("skill", 3).alias("skill"))


@query(f"""
with d as materialized {SEEDED}, s as (select (var_pop(a1 - a2) + var_pop(a1 - a3) + var_pop(a2 - a3)) / 6 as noise, avg(y) * (1 - avg(y)) as spread, avg(((a1 + a2 + a3) / 3 - y) ** 2) as e from d),
k as (select unnest([1, 2, 4, 16, 0]) as seeds)
select seeds, round(100000 * (1 - e / spread) + 100000 * noise / spread / 3 - case when seeds = 0 then 0 else 100000 * noise / spread / seeds end, 3) as skill, round(100000 * noise / spread, 3) as per_seed, round(noise, 9) as variance from s, k
""")
def seed_extrapolation(spark, sf_dir):
    d = v.seed_extrapolation(_seeded(spark, sf_dir), ["a1", "a2", "a3"], "y", [1, 2, 4, 16, 0])
    return d.select("seeds", x.report("skill", 3).alias("skill"), x.report("per_seed", 3).alias("per_seed"), x.report("variance", 9).alias("variance"))


ROUNDS = 40
CANDIDATES = {"p": "p", "q": "q", "half": "0.5 * p + 0.5 * q", "flat": "0.2"}


def _mix(of: str) -> str:
    return f"((xor({of}, {of} >> 16) * 73244475) & 4294967295)"


@query(f"""
with d as materialized (select ('0x' || substr(md5(event_id::varchar), 1, 8))::bigint as h1, ('0x' || substr(md5(event_id::varchar), 9, 8))::bigint as h2, y, {', '.join(f'(({e}) - y) ** 2 as e{i}' for i, e in enumerate(CANDIDATES.values()))} from {SCORED}),
a as (select *, (h1 + round * (2 * h2 + 1)) & 4294967295 as x from d, (select unnest(range({ROUNDS})) as round)),
b as (select *, {_mix("x")} as x1 from a), c as (select *, {_mix("x1")} as x2 from b),
w as (select *, len(list_filter({v.POISSON}, lambda cut: xor(x2, x2 >> 16) >= cut)) as w from c),
r as (select round, sum(w) as n, sum(w * y) / sum(w) as r, {', '.join(f'sum(w * e{i}) / sum(w) as e{i}' for i in range(len(CANDIDATES)))} from w group by round),
s as (select round, {', '.join(f'round(100000 * (1 - e{i} / (r * (1 - r))), 6) as s{i}' for i in range(len(CANDIDATES)))} from r where r > 0 and r < 1),
t as (select *, greatest({', '.join(f's{i}' for i in range(len(CANDIDATES)))}) as top from s),
{', '.join(f"u{i} as (select '{name}' as candidate, quantile_cont(s{i}, 0.025) as skill_low, avg(s{i}) as skill_mean, quantile_cont(s{i}, 0.975) as skill_high, count(*) filter (s{i} = top and not ({' or '.join(f's{j} = top' for j in range(i)) or 'false'})) as wins, quantile_cont(s0 - s{i}, 0.025) as diff_low, avg(s0 - s{i}) as diff_mean, quantile_cont(s0 - s{i}, 0.975) as diff_high, count(*) filter (s0 - s{i} > 0) as first_ahead from t)" for i, name in enumerate(CANDIDATES))},
u as ({' union all '.join(f'select * from u{i}' for i in range(len(CANDIDATES)))})
select candidate, round(skill_low, 3) as skill_low, round(skill_mean, 3) as skill_mean, round(skill_high, 3) as skill_high, wins, round(diff_low, 3) + 0.0 as diff_low, round(diff_mean, 3) + 0.0 as diff_mean, round(diff_high, 3) + 0.0 as diff_high, first_ahead from u
""")
def bootstrap_skill(spark, sf_dir):
    d = v.bootstrap_skill(scored(spark, sf_dir), "event_id", "y", {k: F.expr(e).cast("double") for k, e in CANDIDATES.items()}, ROUNDS)
    return d.select("candidate", *[c if c in ("wins", "first_ahead") else x.report(c, 3).alias(c) for c in d.columns[1:]])


#: A tiny network: two sequences of codes with vectors of one number each, a query of one, two attention units, one dense layer of two.
NET = {
    "table0": [[0.0], [0.4], [-0.3], [0.2], [0.7]], "seq0": [[0.1], [0.5], [-0.4]], "seq1": [[0.2], [0.9], [-0.6], [0.3]], "query": [[0.0], [0.8], [-0.5], [0.6]],
    "att0_w": [[0.5, -0.3], [0.2, 0.4], [-0.6, 0.7], [0.9, 0.1], [-0.2, 0.8]], "att0_b": [0.1, 0.05], "att1_w": [1.2, -0.7], "att1_b": 0.3,
    "dense0_w": [[0.3, -0.4], [0.6, 0.2], [1.5, -0.8], [-0.9, 1.1]], "dense0_b": [0.2, 0.3], "dense1_w": [[0.7], [-0.5]], "dense1_b": [-0.4],
}


def _att(u: int) -> str:
    w = [row[u] for row in NET["att0_w"]]
    return f"greatest({w[0]} * s0 + {w[1]} * s1 + {w[2]} * q + {w[3]} * s0 * q + {w[4]} * s1 * q + {NET['att0_b'][u]}, 0)"


def _dense(u: int) -> str:
    w = [row[u] for row in NET["dense0_w"]]
    return f"greatest({w[0]} * x + {w[1]} * e + {w[2]} * p0 + {w[3]} * p1 + {NET['dense0_b'][u]}, 0)"


@query(f"""
with r as (select event_id, value / 500 as x, {[v[0] for v in NET["table0"]]}[(case when event_id % 6 > 4 then 0 else event_id % 6 end) + 1] as e, {[v[0] for v in NET["query"]]}[user_id % 4 + 1] as q, event_id % 5 as len from events),
place as (select event_id, i, {[v[0] for v in NET["seq0"]]}[(event_id + i * 7) % 3 + 1] as s0, {[v[0] for v in NET["seq1"]]}[(event_id * 3 + i) % 4 + 1] as s1, (event_id + i) % 9 = 4 as hole from r, unnest(range(len)) as g(i)),
open as (select event_id, s0, s1 from place where not hole union all select event_id, {NET["seq0"][0][0]}, {NET["seq1"][0][0]} from r where event_id not in (select event_id from place where not hole)),
scored as (select event_id, s0, s1, x, e, {NET["att1_w"][0]} * {_att(0)} + {NET["att1_w"][1]} * {_att(1)} + {NET["att1_b"]} as a from open join r using (event_id)),
w as (select *, exp(a - max(a) over (partition by event_id)) as w from scored),
pooled as (select event_id, max(x) as x, max(e) as e, sum(w * s0) / sum(w) as p0, sum(w * s1) / sum(w) as p1 from w group by event_id)
select event_id, round(1 / (1 + exp(-({NET["dense1_w"][0][0]} * {_dense(0)} + {NET["dense1_w"][1][0]} * {_dense(1)} + {NET["dense1_b"][0]}))), 6) as score from pooled
""")
def attention_network(spark, sf_dir):
    """Sequences of 0 to 4 places with holes, codes beyond their table, and queries of four kinds."""
    import numpy as np

    from ..operators import models as m
    from ..sources.io import table

    d = table(spark, sf_dir, "events").withColumn("len", (F.col("event_id") % 5).cast("int"))
    d = d.withColumn("i", F.when(F.col("len") > 0, F.sequence(F.lit(0), F.col("len") - 1)))
    hole = lambda i, v: F.when((F.col("event_id") + i) % 9 != 4, v)
    seq0 = F.transform("i", lambda i: hole(i, (F.col("event_id") + i * 7) % 3))
    seq1 = F.transform("i", lambda i: hole(i, (F.col("event_id") * 3 + i) % 4))
    net = {k: np.asarray(v) for k, v in NET.items()}
    return d.select("event_id", x.report(m.attention_network([F.col("value") / 500], [F.col("event_id") % 6], [seq0, seq1], F.col("user_id") % 4, net)).alias("score"))


@query("""
select user_id % 10 as lane, event_type, count(*) as n, sum(case when value > 100 then 1.0 else 0.0 end)::double as s from events where dayofmonth(ts) < 20 and dayofmonth(ts) >= 9 group by all
""")
def history_state(spark, sf_dir):
    """Sums by day, saved in two parts, a day of the first replaced by the second, and read back for the eleven days before the 20th."""
    import uuid

    from ..operators import history as h
    from ..session import shared_folder
    from ..sources import io

    d = io.table(spark, sf_dir, "events").select((F.col("user_id") % 10).alias("lane"), "event_type", F.dayofmonth("ts").alias("day"), (F.col("value") > 100).cast("int").alias("y"))
    path = f"{shared_folder(spark)}/history-{uuid.uuid4().hex}"
    first = h.period_sums(d, ["lane", "event_type"], "day", "y")
    io.save_history(first.where("day <= 15").withColumn("s", F.when(F.col("day") == 12, -1.0).otherwise(F.col("s"))), path, "day")
    io.save_history(first.where("day = 12 or day > 15"), path, "day")
    return io.load_history(spark, path, ["lane", "event_type"], "day", before=20, last=11)


@query(f"""
with recursive z as materialized (select ln(p / (1 - p)) as z, y, part, dow from {SCORED}),
s(i, a, b) as (select 0, 1.0::double, 0.0::double union all
  select i + 1, a, b - least(greatest(g / h, -0.1), 0.1) from (
    select i, a, avg(b) as b, 2 * avg((q - y) * q * (1 - q)) as g, 2 * avg(q * q * (1 - q) * (1 - q) + (q - y) * q * (1 - q) * (1 - 2 * q)) as h
    from (select s.i, s.a, s.b, z.y, {_Q} as q from s, z where s.i < 10) group by i, a)),
r as (select part, dow, y - {_Q} as r from z, s where i = 10)
select 'part' as axis, part::varchar as cell, count(*) as n, round(avg(r), 6) + 0.0 as residual from r group by part union all select 'dow', dow::varchar, count(*), round(avg(r), 6) + 0.0 from r group by dow
""")
def residuals_after_shift(spark, sf_dir):
    return c.residuals_after_shift(scored(spark, sf_dir), "p", "y", ["part", "dow"]).withColumn("residual", x.report("residual"))


#: Values of orders with gaps: no number, not finite, unknown words.
GAPS = "(select o_orderkey, case o_orderkey % 5 when 0 then null when 1 then 'nan'::double when 2 then 'infinity'::double else o_totalprice end as v, case when o_orderkey % 4 = 0 then null else o_orderpriority end as w, case when o_orderkey % 3 = 0 then 'x' || o_orderkey else o_orderkey::varchar end as t, 0.05 + 0.9 * (o_orderkey % 100) / 100.0 as p from orders)"


@query(f"""
select o_orderkey, case when isnan(v) then null else v end as number, coalesce(isfinite(v), false) as finite, try_cast(t as bigint) as cast_t, case w when '1-URGENT' then 10 when '5-LOW' then 1 else -1 end as coded,
  case w when '1-URGENT' then 1 when '3-MEDIUM' then 2 when '5-LOW' then 3 else 0 end as learned, coalesce(w = '1-URGENT', false)::int as w_urgent, coalesce(w = '5-LOW', false)::int as w_low, (v is null)::int + (w is null)::int as gaps,
  round(sqrt((o_orderkey % 7) ** 2 + (o_orderkey % 11) ** 2), 6) as hypot, round(1 / (1 + exp(-ln(p / (1 - p)) / (1 + 2.0 * (o_orderkey % 10) / 10))), 6) as drawn, round(1 / (1 + exp(-(ln(p / (1 - p)) + ln(0.3 / 0.7) - ln(0.5 / 0.5)))), 6) as levelled from {GAPS}
""")
def row_helpers(spark, sf_dir):
    """Small expressions on values with gaps."""
    from ..operators import ensemble as n
    from ..sources.io import table

    k = F.col("o_orderkey")
    v = F.when(k % 5 == 0, F.lit(None)).when(k % 5 == 1, float("nan")).when(k % 5 == 2, float("inf")).otherwise(F.col("o_totalprice"))
    d = table(spark, sf_dir, "orders").select(k, v.cast("double").alias("v"), F.when(k % 4 == 0, F.lit(None)).otherwise(F.col("o_orderpriority")).alias("w"), F.when(k % 3 == 0, F.concat(F.lit("x"), k)).otherwise(k.cast("string")).alias("t"), (0.05 + 0.9 * (k % 100) / 100).alias("p"))
    urgent, low = x.indicators("w", ["1-URGENT", "5-LOW"])
    return d.select(
        k, x.nan_to_null("v").alias("number"), x.finite("v").alias("finite"), x.safe_cast("t", "bigint").alias("cast_t"), x.dictionary("w", {"1-URGENT": 10, "5-LOW": 1}, -1).alias("coded"),
        x.learned_codes("w", ["5-LOW", "1-URGENT", "3-MEDIUM"]).alias("learned"), urgent.alias("w_urgent"), low.alias("w_low"), x.null_count(["v", "w"]).alias("gaps"),
        x.report(x.hypotenuse(k % 7, k % 11)).alias("hypot"), x.report(n.attenuated("p", (k % 10) / 10, 2.0)).alias("drawn"), x.report(n.level("p", 0.3, 0.5)).alias("levelled"),
    )


@query(f"""
with a as (select event_id, event_type, q as x, y, case when event_type = 'view' then null else event_type end as cell from {SCORED}),
f as (select cell, avg(y) - (select avg(y) from a) as effect, coalesce(case when var_pop(x) > 0 then regr_slope(y, x) end, 1.0) as slope from a where cell is not null group by cell)
select event_id, round(0.2 + coalesce(effect, 0) + coalesce(slope, 1) * (x - 0.2), 6) as adjusted from a left join f on f.cell = a.event_type
""")
def adjusted_skill(spark, sf_dir):
    """Cells that the effects lack keep slope 1 and no effect."""
    from ..operators import history as h

    d = scored(spark, sf_dir).select("event_id", "event_type", F.col("q").alias("x"), "y").withColumn("cell", F.when(F.col("event_type") != "view", F.col("event_type")))
    effects = h.cell_effects(d, "cell", "x", "y").where("cell is not null").withColumnRenamed("cell", "event_type")
    return h.adjusted_skill(d, effects, "event_type", "x", 0.2).select("event_id", x.report("adjusted").alias("adjusted"))


@query(f"""
with recursive z as materialized (select ln(p / (1 - p)) as z, y from {SCORED}),
s(i, a, b) as (select 0, 0.0::double, (select ln(avg(y) / (1 - avg(y))) from z) union all
  select i + 1, a - (ga * hbb - gb * hab) / (haa * hbb - hab * hab), b - (gb * haa - ga * hab) / (haa * hbb - hab * hab) from (
    select i, a, b, avg((q - y) * z) as ga, avg(q - y) as gb, avg(q * (1 - q) * z * z) as haa, avg(q * (1 - q) * z) as hab, avg(q * (1 - q)) as hbb
    from (select s.i, s.a, s.b, z.z, z.y, {_Q} as q from s, z where s.i < 8) group by all))
select round(a, 3) + 0.0 as slope, round(b, 3) + 0.0 as intercept from s where i = 8
""")
def platt_scaling(spark, sf_dir):
    from ..operators import models as m

    slope, intercept = m.platt(scored(spark, sf_dir), "p", "y")
    return spark.range(1).select(x.report(F.lit(slope), 3).alias("slope"), x.report(F.lit(intercept), 3).alias("intercept"))
