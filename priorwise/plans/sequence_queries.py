"""Queries of the ordered operators."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.expr import report
from ..operators import history as h
from ..operators import sequence as q
from ..sources.io import table
from .base import EVENTS, LINES, events, lines, query

ORDER = ["ts", "event_id"]
W = "partition by user_id order by ts, event_id"


@query(f"""
with a as (select *, lag(event_type) over ({W}) as previous from events), b as (select *, case when previous <> event_type then 1 else 0 end as changed from a),
c as (select *, sum(changed) over ({W}) as island from b)
select event_id, previous, changed, (island - changed)::bigint as changes_before, row_number() over (partition by user_id, island order by ts, event_id) as run from c
""")
def switch_features(spark, sf_dir):
    return q.change_features(table(spark, sf_dir, "events"), "user_id", ORDER, "event_type").select("event_id", "previous", "changed", "changes_before", "run")


@query(f"""
select event_id, round(case when count(*) over w >= 5 then avg(y) over w end, 6) as share from {EVENTS} window w as ({W} rows between 20 preceding and 1 preceding)
""")
def rolling_share(spark, sf_dir):
    df = events(spark, sf_dir)
    return df.select("event_id", report(q.rolling_mean(df, "user_id", ORDER, F.col("y"), 20, 5)).alias("share"))


@query(f"""
with a as (select *, case when row_number() over w = 1 then 0 when value < lag(value) over w - 50 or event_type = lag(event_type) over w then 1 else 0 end as r from {EVENTS} window w as ({W})),
b as (select *, sum(r) over ({W}) as session from a),
c as (select *, row_number() over (partition by user_id, session order by ts, event_id) as position, count(*) over (partition by user_id, session) as n from b),
s as (select user_id, session, max(case when event_type = 'purchase' then 1 else 0 end) as o from b group by all),
r as (select user_id, session, (coalesce(sum(o) over x, 0) + 5.0) / (count(*) over x + 10.0) as session_rate from s window x as (partition by user_id order by session rows between unbounded preceding and 1 preceding))
select event_id, session::bigint as session, position, position = 1 as is_first, position = n as is_last, round(session_rate, 6) as session_rate from c join r using (user_id, session)
""")
def session_by_reset(spark, sf_dir):
    w = Window.partitionBy("user_id").orderBy(*ORDER)
    reset = (F.col("value") < F.lag("value").over(w) - 50) | (F.col("event_type") == F.lag("event_type").over(w))
    out = q.sessions_by_reset(events(spark, sf_dir), "user_id", ORDER, reset)
    out = q.asof_session_rate(out, "user_id", "session", F.col("event_type") == "purchase")
    return out.select("event_id", "session", "position", "is_first", "is_last", report("session_rate").alias("session_rate"))


WEEK_SQL = "cast(floor((epoch(ts) - 4 * 86400) / 604800) as bigint)"


def _weeks(spark, sf_dir):
    return events(spark, sf_dir).withColumn("week", F.floor((F.unix_timestamp(F.col("ts").cast("timestamp")) - 4 * 86400) / 604800))


@query(f"""
with e as (select *, {WEEK_SQL} as week from events), p as (select distinct user_id, week from e),
j as (select p.user_id, p.week, e.event_type, e.ts, e.event_id, row_number() over (partition by p.user_id, p.week order by e.ts desc, e.event_id desc) as i from p join e on e.user_id = p.user_id and e.week < p.week)
select p.user_id, p.week, coalesce(string_agg(j.event_type, ',' order by j.ts, j.event_id), '') as sequence from p left join j on j.user_id = p.user_id and j.week = p.week and j.i <= 16 group by p.user_id, p.week
""")
def last_k_sequence(spark, sf_dir):
    out = q.last_k(_weeks(spark, sf_dir), "user_id", "week", ORDER, "event_type", 16)
    return out.select("user_id", "week", F.array_join("sequence", ",").alias("sequence"))


@query("""
with j as (select *, row_number() over (partition by user_id order by ts desc, event_id desc) as i from events)
select user_id, string_agg(event_type, ',' order by ts, event_id) as sequence from j where i <= 16 group by user_id
""")
def frozen_last_k(spark, sf_dir):
    return q.frozen_last_k(table(spark, sf_dir, "events"), "user_id", ORDER, "event_type", 16).select("user_id", F.array_join("sequence", ",").alias("sequence"))


CUMULATIVE = f"""select *, row_number() over w - 1 as n, coalesce(sum(y) over (w rows between unbounded preceding and 1 preceding), 0) as s from {EVENTS} window w as ({W})"""
LABEL = "case when lead(n) over w = n + 1 and round_even(lead(c) over w - c, 0) in (0, 1) and abs(lead(c) over w - c - round_even(lead(c) over w - c, 0)) <= 0.25 then round_even(lead(c) over w - c, 0)::int end"


def _cumulative(spark, sf_dir):
    df = h.asof_sums(events(spark, sf_dir), ["user_id"], ORDER, {"n": F.lit(1), "s": F.col("y")})
    return df.withColumn("rate", F.when(F.col("n") > 0, F.col("s") / F.col("n")))


@query(f"""
with a as ({CUMULATIVE}), b as (select *, coalesce(s / nullif(n, 0), 0) * n as c from a)
select event_id, {LABEL} as label, y from b window w as ({W})
""")
def label_reconstruct(spark, sf_dir):
    return q.reconstruct_label(_cumulative(spark, sf_dir), "user_id", ORDER, "rate", "n").select("event_id", "label", "y")


@query(f"""
with a as ({CUMULATIVE}), b as (select *, coalesce(s / nullif(n, 0), 0) * n as c, lead(user_id) over (order by ts, event_id) as next_user from a)
select event_id, case when next_user = user_id then {LABEL} end as label from b window w as ({W})
""")
def label_reconstruct_adjacent(spark, sf_dir):
    return q.reconstruct_label(_cumulative(spark, sf_dir), "user_id", ORDER, "rate", "n", adjacent=True).select("event_id", "label")


@query(f"""
with a as (select *, row_number() over w - 1 as n, coalesce(sum(y) over (w rows between unbounded preceding and 1 preceding), 0) as lost, count(*) filter (y = 0 and value < 20) over (w rows between unbounded preceding and 1 preceding) as gained from {EVENTS} window w as ({W})),
b as (select *, (n - lost - gained) % 5 as stock from a),
c as (select *, lead(stock) over w as stock2, lead(lost) over w - lost as dl, lead(gained) over w - gained as dg, lead(event_id) over w is null as last from b window w as ({W}))
select event_id, case when last then 'lost' when stock + 1 <> stock2 + dl + dg then null when dl > 0 then 'lost' when dl = 0 and stock2 + dg > stock then 'kept' else 'other' end as outcome from c
""")
def outcome_balance(spark, sf_dir):
    df = events(spark, sf_dir)
    df = h.asof_sums(df, ["user_id"], ORDER, {"n": F.lit(1), "lost": F.col("y"), "gained": F.when((F.col("y") == 0) & (F.col("value") < 20), 1).otherwise(0)})
    df = df.withColumn("stock", (F.col("n") - F.col("lost") - F.col("gained")) % 5)
    return q.balanced_outcomes(df, ["user_id"], ORDER, "stock", "lost", "gained").select("event_id", "outcome")


@query(f"""
with a as ({CUMULATIVE}), b as (select *, coalesce(s / nullif(n, 0), 0) * n as c from a), l as (select {LABEL} as label, y from b window w as ({W}))
select count(label) as known, count(*) filter (label = y) as agree, round(count(*) filter (label = y) / count(label), 6) as rate, count(*) filter (label = y) / count(label) >= 0.9999 as ok from l
""")
def label_agreement(spark, sf_dir):
    df = q.reconstruct_label(_cumulative(spark, sf_dir), "user_id", ORDER, "rate", "n")
    return q.agreement(df, "label", "y").withColumn("rate", report("rate"))


@query("""
select event_id, case when event_type = 'purchase' then 'success' when value > 150 then 'reverse' when value > 60 then 'middle' when value is not null then 'other' end as state4,
  case when event_type = 'purchase' then 'success' when value > 150 then 'reverse' when value > 60 then 'middle' when event_type = 'click' then 'other_ball' when event_type = 'view' then 'other_strike' else 'other' end as state6 from events
""")
def multi_state(spark, sf_dir):
    first = [("success", F.col("event_type") == "purchase"), ("reverse", F.col("value") > 150), ("middle", F.col("value") > 60)]
    more = [*first, ("other_ball", F.col("event_type") == "click"), ("other_strike", F.col("event_type") == "view")]
    known = F.col("value").isNotNull()
    return table(spark, sf_dir, "events").select("event_id", q.multi_state(first, "other", known).alias("state4"), q.multi_state(more, "other", known).alias("state6"))


@query("""
with m as (select s_nationkey, year(l_shipdate) * 12 + month(l_shipdate) as month, avg(l_discount) as v from lineitem join supplier on s_suppkey = l_suppkey group by all),
g as (select *, avg(v) over b as mb, avg(v) over a as ma, count(v) over b as nb, count(v) over a as na from m
  window b as (partition by s_nationkey order by month rows between 10 preceding and 1 preceding), a as (partition by s_nationkey order by month rows between current row and 9 following)),
r as (select *, round(ma - mb, 9) as gap, row_number() over (partition by s_nationkey order by abs(round(ma - mb, 9)) desc, month) as i from g where nb >= 5 and na >= 5)
select s_nationkey, month::bigint as month, round(gap, 6) + 0.0 as gap from r where i = 1
""")
def changepoint_scan(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    m = lines(spark, sf_dir).join(s, "l_suppkey").groupBy("s_nationkey", (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("month")).agg(F.avg("l_discount").alias("v"))
    return q.changepoints(m, "s_nationkey", "month", "v").withColumn("gap", report("gap"))


@query(f"""
with g as (select l_suppkey, period, avg(y) as r from {LINES} group by all),
p as (select a.l_suppkey, a.period, a.r, b.r as next_r from g a join g b on b.l_suppkey = a.l_suppkey and b.period = a.period + 1)
select period, count(*) as pairs, round(corr(r, next_r), 5) as persistence from p group by period
""")
def period_pairs(spark, sf_dir):
    g = lines(spark, sf_dir).groupBy("l_suppkey", "period").agg(F.avg("y").alias("r"))
    return q.period_pairs(g, "l_suppkey", "period", "r").groupBy("period").agg(F.count("*").alias("pairs"), report(F.corr("r", "next_value"), 5).alias("persistence"))


@query("""
with d as (select user_id, value - lag(value) over (partition by user_id order by ts, event_id) as d from events)
select user_id, count(*) as rows, count(*) filter (d <= 0) as faults from d group by user_id
""")
def order_faults(spark, sf_dir):
    return q.order_faults(table(spark, sf_dir, "events"), "user_id", ORDER, "value")
