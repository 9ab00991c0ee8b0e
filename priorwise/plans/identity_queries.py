"""Queries of identity maps: greedy assignment, checked maps, maps that grow through each other, staged pairing, linked triples."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as x
from ..operators import history as h
from ..operators import identity as k
from ..sources.io import table
from .base import LINES, lines, query

#: Suppliers and lanes of parts: every supplier meets every lane, so choices conflict.
MET = "(select l_suppkey, l_partkey % 60 as lane, count(*) as n from lineitem group by all)"


@query(f"""
with recursive e as materialized {MET},
s(i, a, b, n, used_a, used_b) as (
  (select 1, l_suppkey, lane, n, [l_suppkey], [lane] from e order by n desc, l_suppkey, lane limit 1)
  union all (select s.i + 1, e.l_suppkey, e.lane, e.n, list_append(used_a, e.l_suppkey), list_append(used_b, e.lane) from s, e
    where not list_contains(used_a, e.l_suppkey) and not list_contains(used_b, e.lane) order by e.n desc, e.l_suppkey, e.lane limit 1))
select a as l_suppkey, b as lane, n from s
""")
def greedy_assignment(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").groupBy("l_suppkey", (F.col("l_partkey") % 60).alias("lane")).agg(F.count("*").alias("n"))
    return k.greedy_assignment(df, "l_suppkey", "lane", local=500)


def _checked_sql(votes: str, a: str, b: str, least: int, share: float, agreement: float) -> str:
    """Statements that make the edges of `votes` (a, b, n, agree): <votes>_top before and <votes>_map after one right id each."""
    return f"""{votes}_sum as (select {a}, {b}, sum(n) as n, sum(agree) as agree from {votes} group by all),
{votes}_top as (select {a}, arg_min({b}, (-n, {b})) as {b}, max(n) as n_top, sum(n) as n_total, arg_min(agree, (-n, {b})) as agree from {votes}_sum group by {a}),
{votes}_ok as (select * from {votes}_top where n_total >= {least} and n_top / n_total >= {share} and agree / n_top >= {agreement}),
{votes}_map as (select * from {votes}_ok qualify row_number() over (partition by {b} order by n_top desc, {a}) = 1)"""


#: Least votes, share and agreement of the checked map; parts and lanes of suppliers, so that shares differ at every size.
LIMITS = (3, 0.034, 0.64)


@query(f"""
with v as (select l_partkey % 400 as part, l_suppkey % 40 as lane, count(*) as n, count(*) filter (l_returnflag = 'R' or l_linestatus = 'F') as agree from lineitem group by all),
{_checked_sql("v", "part", "lane", *LIMITS)}
select part, lane, n_top::bigint as n_top, n_total::bigint as n_total, round(n_top / n_total, 6) as share, round(agree / n_top, 6) as agreement from v_map
""")
def checked_map(spark, sf_dir):
    """Parts to lanes of suppliers; the check and the uniqueness of lanes each drop edges (tests count them)."""
    return k.checked_map(part_votes(spark, sf_dir), "part", "lane", *LIMITS).withColumns({c: x.report(c) for c in ("share", "agreement")})


def part_votes(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumns({"part": F.col("l_partkey") % 400, "lane": F.col("l_suppkey") % 40})
    return k.checked_votes(df, "part", "lane", F.expr("l_returnflag = 'R' or l_linestatus = 'F'"))


#: Orders as seen by two systems: customers and months under ids of their own in the second, some of them disturbed.
TWO_SIDES = """(select o_custkey % 97 as a, case when o_orderkey % 5 = 0 then 'x' || (o_custkey % 89) else 'b' || (o_custkey % 97) end as b,
  month(o_orderdate) * 10 + o_orderkey % 7 as c, case when o_orderkey % 6 = 0 then 'y' || (o_orderkey % 11) else 'd' || (month(o_orderdate) * 10 + o_orderkey % 7) end as d, o_orderstatus as s, o_orderpriority as t from orders)"""


def _two_sides(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    c = F.month("o_orderdate") * 10 + F.col("o_orderkey") % 7
    return o.select(
        (F.col("o_custkey") % 97).alias("a"), F.when(F.col("o_orderkey") % 5 == 0, F.concat(F.lit("x"), F.col("o_custkey") % 89)).otherwise(F.concat(F.lit("b"), F.col("o_custkey") % 97)).alias("b"),
        c.alias("c"), F.when(F.col("o_orderkey") % 6 == 0, F.concat(F.lit("y"), F.col("o_orderkey") % 11)).otherwise(F.concat(F.lit("d"), c)).alias("d"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("t"),
    )


def _grow_sql(rounds: int) -> str:
    """Rounds of both maps, one after the other."""
    parts = ["ab0 as (select 3 as a, 'b3' as b, 0 as round)", "cd0 as (select 14 as c, 'd14' as d, 0 as round union all select 25, 'd25', 0)"]
    for i in range(1, rounds + 1):
        for mine, other, x1, x2, on, agree in (("ab", "cd", "a", "b", "c, d", "s <> 'Q'"), ("cd", "ab", "c", "d", "a, b", "t <> 'Q'")):
            known = f"{other}{i - 1 if mine == 'ab' else i}"
            parts.append(f"v{mine}{i} as (select {x1}, {x2}, count(*) as n, count(*) filter ({agree}) as agree from g semi join {known} using ({on}) where {x1} not in (select {x1} from {mine}{i - 1}) and {x2} not in (select {x2} from {mine}{i - 1}) group by all)")
            parts.append(_checked_sql(f"v{mine}{i}", x1, x2, 2, 0.5, 0.5))
            parts.append(f"{mine}{i} as (select * from {mine}{i - 1} union all select {x1}, {x2}, {i} from v{mine}{i}_map)")
    return ",\n".join(parts)


GROWN = 6


@query(f"""
with g as materialized {TWO_SIDES}, {_grow_sql(GROWN)}
select 'ab' as map, a::bigint as "left", b as "right", round from ab{GROWN} union all select 'cd', c::bigint, d, round from cd{GROWN}
""")
def grow_both(spark, sf_dir):
    """Two maps from one and two given edges. It ends by itself; SQL runs a fixed number of rounds, the last without effect (tests)."""
    g = _two_sides(spark, sf_dir)
    ab = spark.createDataFrame([(3, "b3")], "a long, b string")
    cd = spark.createDataFrame([(14, "d14"), (25, "d25")], "c long, d string")
    ab, cd = k.grow_both(g, ab, cd, "a", "b", "c", "d", F.expr("s <> 'Q'"), F.expr("t <> 'Q'"), least=2, share=0.5, agreement=0.5)
    return ab.select(F.lit("ab").alias("map"), F.col("a").cast("long").alias("left"), F.col("b").alias("right"), "round").unionByName(cd.select(F.lit("cd").alias("map"), F.col("c").cast("long").alias("left"), F.col("d").alias("right"), "round"))


#: One table twice: the second lacks the priority of some rows and has another customer on others, so keys meet partly, nulls included.
SIDES = """l as (select o_orderkey as left_id, o_custkey % 50 as cust, case when o_orderkey % 3 = 0 then null else o_orderpriority end as priority, o_orderstatus as status, year(o_orderdate) * 12 + month(o_orderdate) as m, o_totalprice as price from orders),
r as (select o_orderkey + 1000000 as right_id, case when o_orderkey % 11 = 0 then null else o_custkey % 50 end as cust, case when o_orderkey % 3 = 0 then null else o_orderpriority end as priority, o_orderstatus as status, year(o_orderdate) * 12 + month(o_orderdate) as m, o_totalprice as price from orders)"""
STAGES = [["cust", "priority", "status", "m"], ["priority", "status", "m"]]


def _stage_sql(i: int, keys: list[str]) -> str:
    same = " and ".join(f"x.{c} is not distinct from y.{c}" for c in keys)
    left, right = ("l", "r") if not i else (f"(select * from l where left_id not in (select left_id from p{i - 1}))", f"(select * from r where right_id not in (select right_id from p{i - 1}))")
    by = ", ".join(keys)
    prior = f"select * from p{i - 1} union all " if i else ""
    return f"""x{i} as (select *, count(*) over (partition by {by}) as n, row_number() over (partition by {by} order by price, left_id) as nth from {left}),
y{i} as (select *, count(*) over (partition by {by}) as n, row_number() over (partition by {by} order by price, right_id) as nth from {right}),
p{i} as ({prior}select left_id, right_id, case when x.n = 1 then {2 * i + 1} else {2 * i + 2} end as stage, x.nth as occurrence from x{i} x join y{i} y on {same} and x.n = y.n and x.nth = y.nth)"""


@query(f"with {SIDES}, {', '.join(_stage_sql(i, s) for i, s in enumerate(STAGES))} select left_id, right_id, stage, occurrence::int as occurrence from p{len(STAGES) - 1}")
def staged_pairing(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    priority = F.when(F.col("o_orderkey") % 3 != 0, F.col("o_orderpriority")).alias("priority")
    rest = [priority, F.col("o_orderstatus").alias("status"), (F.year("o_orderdate") * 12 + F.month("o_orderdate")).alias("m"), F.col("o_totalprice").alias("price")]
    left = o.select(F.col("o_orderkey").alias("left_id"), (F.col("o_custkey") % 50).alias("cust"), *rest)
    right = o.select((F.col("o_orderkey") + 1000000).alias("right_id"), F.when(F.col("o_orderkey") % 11 != 0, F.col("o_custkey") % 50).alias("cust"), *rest)
    return k.staged_pairing(left, right, STAGES, "left_id", "right_id", ["price"], ["price"])


LINK = "(select l_partkey, min(l_suppkey) as entity from lineitem group by l_partkey)"


@query(f"""
with g as (select entity, l_linestatus as cell, period, count(*) as n, sum(case when l_discount > 0.05 then 1 else 0 end) as s from {LINES} join {LINK} using (l_partkey) group by all),
want as (select distinct l_suppkey as entity, l_linestatus as cell, period from {LINES}),
c as (select w.entity, w.cell, w.period, coalesce(sum(n), 0) as n, coalesce(sum(s), 0) as s from want w left join g on g.entity = w.entity and g.cell = w.cell and g.period < w.period group by all),
t as (select w.entity, w.period, coalesce(sum(n), 0) as n, coalesce(sum(s), 0) as s from (select distinct entity, period from want) w left join g on g.entity = w.entity and g.period < w.period group by all),
pc as (select w.cell, w.period, sum(s) / sum(n) as prior from (select distinct cell, period from want) w left join g on g.cell = w.cell and g.period < w.period group by all),
pg as (select w.period, sum(s) / sum(n) as prior from (select distinct period from want) w left join g on g.period < w.period group by all),
r as (select c.*, t.n as n_all, t.s as s_all, coalesce(pg.prior, 0.5) as g, coalesce(pc.prior, pg.prior, 0.5) as p from c join t using (entity, period) left join pc on pc.cell = c.cell and pc.period = c.period left join pg on pg.period = c.period)
select entity, cell, period::int as period, round((s + 50 * p) / (n + 50), 6) as rate, round((s + 50 * p) / (n + 50) - (s_all + 50 * g) / (n_all + 50), 6) + 0.0 as dev, round(ln(1 + n), 6) as conf from r
""")
def linked_triple(spark, sf_dir):
    """Discounts of parts, which a map links to suppliers, as features of the suppliers' own rows."""
    df = lines(spark, sf_dir)
    link = df.groupBy("l_partkey").agg(F.min("l_suppkey").alias("entity"))
    sensor = df.select("l_partkey", F.col("l_linestatus").alias("cell"), "period", (F.col("l_discount") > 0.05).cast("int").alias("hit"))
    wanted = df.select(F.col("l_suppkey").alias("entity"), F.col("l_linestatus").alias("cell"), "period")
    return h.linked_triple(sensor, link, "l_partkey", wanted, "entity", "cell", "period", "hit", 50.0).withColumns({c: x.report(c) for c in ("rate", "dev", "conf")})


@query("""
with k as (select l_suppkey, l_partkey % 50 as lane from lineitem group by all having count(distinct l_linestatus) = 1)
select l_orderkey, l_linenumber, l_suppkey, l_partkey % 50 as lane, l_linestatus from lineitem where exists (select 1 from k where k.l_suppkey = lineitem.l_suppkey and k.lane = l_partkey % 50)
""")
def keep_single(spark, sf_dir):
    """Rows of (supplier, lane) that stand with one line status only, however many rows they have."""
    from ..operators import linkage

    df = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", (F.col("l_partkey") % 50).alias("lane"), "l_linestatus")
    return linkage.keep_single(df, ["l_suppkey", "lane"], "l_linestatus")


@query("""
with e as (select event_id, user_id, ts, event_type, case event_type when 'click' then 1 when 'purchase' then 2 else 3 end as state, case when value > 100 then 1 else 0 end as ball, event_id % 13 = 0 as lost from events),
c as (select *, row_number() over w - 1 as n, coalesce(sum(ball) over (w rows between unbounded preceding and 1 preceding), 0) as s from e window w as (partition by user_id order by ts, event_id)),
r as (select *, case when lost then null else s / nullif(n, 0)::double end as rate from c),
u as (select *, coalesce(rate, 0) * n as t, lead(coalesce(rate, 0) * n) over w - coalesce(rate, 0) * n as up, lead(n) over w as m from r window w as (partition by user_id order by ts, event_id))
select event_id, case when state <> 3 then state when m is not null and abs(up - round(up)) < 0.25 and round(up) = 1 then 3 when m is not null and abs(up - round(up)) < 0.25 and round(up) = 0 then 4 else -1 end as state_split from u
""")
def split_state(spark, sf_dir):
    """A state split by whether a second counter rises at the next row; where a rate is lost it can't be told."""
    from ..operators import sequence as q

    e = table(spark, sf_dir, "events").select("event_id", "user_id", "ts", F.when(F.col("event_type") == "click", 1).when(F.col("event_type") == "purchase", 2).otherwise(3).alias("state"), (F.col("value") > 100).cast("int").alias("ball"))
    d = h.asof_sums(e, ["user_id"], ["ts", "event_id"], {"n": F.lit(1.0), "s": F.col("ball")})
    d = d.withColumn("rate", F.when(F.col("event_id") % 13 != 0, F.col("s") / F.nullif(F.col("n"), F.lit(0.0))))
    return q.split_state(d, "user_id", ["ts", "event_id"], "state", "n", "rate", 3, (3, 4, -1)).select("event_id", "state_split")
