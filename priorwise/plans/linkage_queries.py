"""Queries of the linkage operators and of joins, sets, strings and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import expr as x
from ..operators import linkage as k
from ..sources import io
from ..sources.io import table
from .base import LINE_ORDER, LINES, lines, query


def _orders(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumn("day", F.date_format("o_orderdate", "yyyy-MM-dd"))
    left = o.select("o_custkey", "day", "o_orderstatus", F.col("o_orderkey").alias("left_id"))
    status = F.when(F.col("o_orderkey") % 7 == 0, "?").otherwise(F.col("o_orderstatus")).alias("o_orderstatus")  # a seventh is known under another status
    right = o.select("o_custkey", "day", status, (F.col("o_orderkey") + 1000000).alias("right_id"))
    return left, right


ORDERS = """l as (select o_custkey, strftime(o_orderdate, '%Y-%m-%d') as day, o_orderstatus, o_orderkey as left_id from orders),
r as (select o_custkey, strftime(o_orderdate, '%Y-%m-%d') as day, case when o_orderkey % 7 = 0 then '?' else o_orderstatus end as o_orderstatus, o_orderkey + 1000000 as right_id from orders)"""


@query(f"""with {ORDERS},
lu as (select * from l qualify count(*) over (partition by o_custkey, day, o_orderstatus) = 1), ru as (select * from r qualify count(*) over (partition by o_custkey, day, o_orderstatus) = 1)
select lu.*, ru.right_id from lu join ru using (o_custkey, day, o_orderstatus)""")
def unique_key_match(spark, sf_dir):
    return k.unique_key_match(*_orders(spark, sf_dir), ["o_custkey", "day", "o_orderstatus"])


@query(f"""with {ORDERS},
la as (select o_custkey, o_orderstatus, day, count(*) as nl from l group by all), rb as (select o_custkey, o_orderstatus, day, count(*) as nr from r group by all),
a1 as (select o_custkey, sum(nl) as nl from la group by all), b1 as (select o_custkey, sum(nr) as nr from rb group by all),
a2 as (select o_custkey, o_orderstatus, sum(nl) as nl from la group by all), b2 as (select o_custkey, o_orderstatus, sum(nr) as nr from rb group by all)
select 1 as depth, 'o_custkey' as key, sum(nl)::bigint as left_rows, (sum(nl) filter (nr is not null))::bigint as matched, count(*) filter (nl = 1 and nr = 1) as unique_matched from a1 left join b1 using (o_custkey)
union all select 2, 'o_custkey+o_orderstatus', sum(nl)::bigint, (sum(nl) filter (nr is not null))::bigint, count(*) filter (nl = 1 and nr = 1) from a2 left join b2 using (o_custkey, o_orderstatus)
union all select 3, 'o_custkey+o_orderstatus+day', sum(nl)::bigint, (sum(nl) filter (nr is not null))::bigint, count(*) filter (nl = 1 and nr = 1) from la left join rb using (o_custkey, o_orderstatus, day)""")
def match_depth(spark, sf_dir):
    return k.match_depth(*_orders(spark, sf_dir), ["o_custkey", "o_orderstatus", "day"])


VOTES = "(select l_suppkey, l_partkey, count(*) as n from lineitem group by all)"


@query(f"""
with v as (select *, n / sum(n) over (partition by l_suppkey) as share_a, n / sum(n) over (partition by l_partkey) as share_b,
  row_number() over (partition by l_suppkey order by n desc, l_partkey) as ra, row_number() over (partition by l_partkey order by n desc, l_suppkey) as rb from {VOTES})
select l_suppkey, l_partkey, n, round(share_a, 6) as share_a, round(share_b, 6) as share_b from v where ra = 1 and rb = 1 and n >= 2 and share_a >= 0.001 and share_b >= 0.02
""")
def mutual_best_map(spark, sf_dir):
    v = k.evidence(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")
    return k.mutual_best(v, "l_suppkey", "l_partkey", 2, 0.0).where("share_a >= 0.001 and share_b >= 0.02").withColumns({c: x.report(c) for c in ("share_a", "share_b")})


@query(f"""
with g as (select l_suppkey, sum(n) as n_total, max(n) as n_top, arg_min(l_partkey, (-n, l_partkey)) as l_partkey from {VOTES} group by l_suppkey)
select l_suppkey, l_partkey, n_top, n_total::bigint as n_total, round(n_top / n_total, 6) as share from g where n_top >= 2
""")
def majority_vote_map(spark, sf_dir):
    v = k.evidence(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_partkey")
    return k.majority_map(v, "l_suppkey", "l_partkey", 2, 0.0).withColumn("share", x.report("share"))


@query(f"""
with c as (select l_suppkey, l_partkey, l_orderkey, year(l_shipdate) as y from lineitem), m as (select l_partkey, min(l_suppkey) as l_suppkey from lineitem group by l_partkey having count(distinct year(l_shipdate)) >= 2),
v as (select c.l_orderkey % 50 as bucket, c.l_suppkey % 10 as lane, count(*) as n from c semi join m using (l_partkey, l_suppkey) group by all)
select bucket, arg_min(lane, (-n, lane)) as lane, max(n) as n_top, sum(n)::bigint as n_total, round(max(n) / sum(n), 6) as share from v group by bucket having max(n) >= 1
""")
def chained_map(spark, sf_dir):
    """A map of bucket to lane from the rows whose part and supplier agree with a known map."""
    df = table(spark, sf_dir, "lineitem").withColumns({"bucket": F.col("l_orderkey") % 50, "lane": F.col("l_suppkey") % 10})
    known = df.groupBy("l_partkey").agg(F.min("l_suppkey").alias("l_suppkey"), F.countDistinct(F.year("l_shipdate")).alias("c")).where("c >= 2")
    return k.expand_map(df, known, "bucket", "lane", ("l_partkey", "l_suppkey"), least=1, share=0.0).withColumn("share", x.report("share"))


@query(f"""
with p as (select l_suppkey, l_partkey % 20 as lane, period from {LINES}), e as (select distinct period as held_out from p),
v as (select held_out, period = held_out as mine, l_suppkey, lane, count(*) as n from p cross join e group by all),
r as (select *, n / sum(n) over (partition by held_out, mine, l_suppkey) as sa, row_number() over (partition by held_out, mine, l_suppkey order by n desc, lane) as ra,
  row_number() over (partition by held_out, mine, lane order by n desc, l_suppkey) as rb from v),
b as (select * from r where ra = 1 and rb = 1 and n >= 1)
select e.held_out::int as held_out, count(a.lane) as edges, count(c.lane) as agree from e left join b a on a.held_out = e.held_out and a.mine left join b c on c.held_out = e.held_out and not c.mine and c.l_suppkey = a.l_suppkey and c.lane = a.lane group by e.held_out
""")
def map_stability(spark, sf_dir):
    p = lines(spark, sf_dir).select("l_suppkey", (F.col("l_partkey") % 20).alias("lane"), "period")
    return k.leave_one_out(p, "l_suppkey", "lane", "period", 1, 0.0)


PAIR_ORDER = ", ".join(LINE_ORDER)


@query(f"""
with h as (select *, l_orderkey % 2 as half, row_number() over (partition by l_suppkey, year(l_shipdate) * 12 + month(l_shipdate), l_returnflag, l_orderkey % 2 order by {PAIR_ORDER}) as occurrence,
  count(*) over (partition by l_suppkey, year(l_shipdate) * 12 + month(l_shipdate), l_returnflag, l_orderkey % 2) as n, year(l_shipdate) * 12 + month(l_shipdate) as month from lineitem)
select a.l_suppkey, a.month, a.l_returnflag, a.occurrence, a.l_orderkey as left_order, b.l_orderkey as right_order from h a join h b on a.half = 0 and b.half = 1 and a.l_suppkey = b.l_suppkey and a.month = b.month and a.l_returnflag = b.l_returnflag and a.occurrence = b.occurrence and a.n = b.n
""")
def occurrence_pairing(spark, sf_dir):
    df = table(spark, sf_dir, "lineitem").withColumn("month", F.year("l_shipdate") * 12 + F.month("l_shipdate"))
    a = df.where("l_orderkey % 2 = 0").withColumn("left_order", F.col("l_orderkey"))
    b = df.where("l_orderkey % 2 = 1").select("l_suppkey", "month", "l_returnflag", F.col("l_orderkey").alias("right_order"), *[F.col(c).alias(f"_{c}") for c in LINE_ORDER])
    out = k.occurrence_pairing(a, b, ["l_suppkey", "month", "l_returnflag"], LINE_ORDER, [f"_{c}" for c in LINE_ORDER])
    return out.select("l_suppkey", "month", "l_returnflag", "occurrence", "left_order", "right_order")


@query("""
with r as (select o_custkey, row_number() over (partition by o_custkey order by o_orderdate, o_orderkey) as a, row_number() over (partition by o_custkey order by o_totalprice, o_orderkey) as b from orders)
select o_custkey, count(*) as n, round(corr(a, b), 6) + 0.0 as rank_corr from r group by o_custkey having count(*) >= 5
""")
def order_consistency(spark, sf_dir):
    return k.order_consistency(table(spark, sf_dir, "orders"), "o_custkey", ["o_orderdate", "o_orderkey"], ["o_totalprice", "o_orderkey"]).withColumn("rank_corr", x.report("rank_corr"))


@query("""
with a as (select c_custkey, c_nationkey from customer), b as (select case when c_custkey % 7 = 0 then c_custkey + 1000000 else c_custkey end as c_custkey, (c_nationkey + case when c_custkey % 11 = 0 then 1 else 0 end)::int as c_nationkey from customer)
select coalesce(a.c_custkey, b.c_custkey) as c_custkey, a.c_nationkey as left_value, b.c_nationkey as right_value, case when a.c_custkey is not null and b.c_custkey is not null then 'both' when a.c_custkey is not null then 'left' else 'right' end as side from a full join b on a.c_custkey = b.c_custkey
""")
def map_compare(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    value = (F.col("c_nationkey") + F.when(F.col("c_custkey") % 11 == 0, 1).otherwise(0)).cast("int")
    b = c.select(F.when(F.col("c_custkey") % 7 == 0, F.col("c_custkey") + 1000000).otherwise(F.col("c_custkey")).alias("c_custkey"), value.alias("c_nationkey"))
    return k.compare_maps(c, b, "c_custkey", "c_nationkey")


@query("""
with b as (select case when c_custkey % 3 = 0 then c_custkey + 1000000 else c_custkey end as c_custkey, nullif(c_nationkey, 3) as c_nationkey, c_acctbal + case when c_custkey % 10 = 0 then 1 else 0 end as c_acctbal from customer)
select 'c_nationkey' as "column", count(*) as rows, count(*) filter (a.c_nationkey is distinct from b.c_nationkey) as different from customer a join b using (c_custkey)
union all select 'c_acctbal', count(*), count(*) filter (a.c_acctbal is distinct from b.c_acctbal) from customer a join b using (c_custkey)
""")
def version_mismatches(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.when(F.col("c_custkey") % 3 == 0, F.col("c_custkey") + 1000000).otherwise(F.col("c_custkey"))
    b = c.withColumns({"c_custkey": key, "c_nationkey": F.nullif("c_nationkey", F.lit(3)), "c_acctbal": F.col("c_acctbal") + F.when(F.col("c_custkey") % 10 == 0, 1).otherwise(0)})
    return k.mismatches(c, b, "c_custkey", ["c_nationkey", "c_acctbal"])


@query("""
with s as (select l_partkey * 50 + l_suppkey as l_suppkey, year(l_shipdate) as y, count(*) as n from lineitem group by all)
select y::int as period, count(*) as suppliers, count(*) filter (exists (select 1 from s b where b.l_suppkey = s.l_suppkey and b.y = s.y - 1)) as warm, count(*) filter (not exists (select 1 from s b where b.l_suppkey = s.l_suppkey and b.y = s.y - 1)) as cold from s group by y
""")
def semi_anti(spark, sf_dir):
    """Parts from a supplier in a year that the year before had (warm) and hadn't (cold)."""
    s = lines(spark, sf_dir).select((F.col("l_partkey") * 50 + F.col("l_suppkey")).alias("l_suppkey"), "period").distinct()
    before = s.select("l_suppkey", (F.col("period") + 1).alias("period"))
    warm, cold = s.join(before, ["l_suppkey", "period"], "left_semi"), s.join(before, ["l_suppkey", "period"], "left_anti")
    both = warm.withColumn("w", F.lit(1)).unionByName(cold.withColumn("w", F.lit(0)))
    return both.groupBy("period").agg(F.count("*").alias("suppliers"), F.count_if(F.col("w") == 1).alias("warm"), F.count_if(F.col("w") == 0).alias("cold"))


@query("""
with m as (select l_partkey, max(year(l_shipdate)) as last_seen from lineitem group by all)
select p_partkey, last_seen::int as last_seen, coalesce(last_seen <= 2000, true) as stale from part left join m on l_partkey = p_partkey
""")
def stale_entities(spark, sf_dir):
    m = lines(spark, sf_dir).groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.max("period").alias("last_seen"))
    s = table(spark, sf_dir, "part").select("p_partkey")
    return s.join(m, "p_partkey", "left").select("p_partkey", "last_seen", F.coalesce(F.col("last_seen") <= 2000, F.lit(True)).alias("stale"))


@query("""
with p as (select o_orderkey, case when o_orderkey % 6 <> 0 then o_totalprice end as p from orders)
select o.o_orderkey, p is not null as matched, coalesce(p, 0.5) as prediction from orders o left join p on p.o_orderkey = o.o_orderkey
""")
def template_merge(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    p = o.select("o_orderkey", F.when(F.col("o_orderkey") % 6 != 0, F.col("o_totalprice")).alias("prediction"))
    return io.merge_template(o.select("o_orderkey"), p, "o_orderkey", "prediction")


@query("""
with c as (select distinct c_nationkey % 20 as k from customer), s as (select distinct s_nationkey + 5 as k from supplier)
select 'union' as op, k from (select k from c union select k from s) union all select 'difference', k from (select k from c except select k from s)
union all select 'intersection', k from (select k from c intersect select k from s)
""")
def set_ops(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((F.col("c_nationkey") % 20).alias("k"))
    s = table(spark, sf_dir, "supplier").select((F.col("s_nationkey") + 5).alias("k"))
    parts = {"union": c.union(s).distinct(), "difference": c.subtract(s), "intersection": c.intersect(s)}
    out = None
    for op, df in parts.items():
        df = df.select(F.lit(op).alias("op"), "k")
        out = df if out is None else out.unionByName(df)
    return out


@query("""
select c_custkey, regexp_replace(lower(trim(' ' || c_name || ' ')), '[^a-z0-9]+', '_', 'g') as name, cast(nullif(regexp_extract(c_name, '(\\d+)$', 1), '') as bigint) as number, upper(substr(c_mktsegment, 1, 1)) as initial,
  case when lower(c_mktsegment) like 'auto%' then 'car' when lower(c_mktsegment) like 'build%' then 'house' else regexp_replace(lower(trim(c_mktsegment)), '[^a-z0-9]+', '_', 'g') end as segment,
  length(regexp_replace(c_name, '[^aeiou]', '', 'g'))::int as vowels, concat_ws('|', c_custkey::varchar, c_nationkey::varchar, c_mktsegment) as joined, replace(c_mktsegment, 'E', 'e') as replaced,
  starts_with(c_mktsegment, 'M') as prefixed, try_cast(substr(c_name, 10, 3) as integer) as slice, case when c_mktsegment in ('MACHINERY', 'FURNITURE') then null else c_mktsegment end as masked from customer
""")
def string_normalise(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select(
        "c_custkey", x.normal_text(F.concat(F.lit(" "), "c_name", F.lit(" "))).alias("name"), x.trailing_number("c_name").alias("number"), x.initial("c_mktsegment").alias("initial"),
        k.alias_map(c, "c_mktsegment", [("auto", "car"), ("build", "house")]).alias("segment"), F.regexp_count("c_name", F.lit("[aeiou]")).alias("vowels"),
        F.concat_ws("|", F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string"), "c_mktsegment").alias("joined"), F.replace("c_mktsegment", F.lit("E"), F.lit("e")).alias("replaced"),
        F.col("c_mktsegment").startswith("M").alias("prefixed"), F.expr("try_cast(substring(c_name, 10, 3) as int)").alias("slice"), F.when(~F.col("c_mktsegment").isin("MACHINERY", "FURNITURE"), F.col("c_mktsegment")).alias("masked"),
    )


@query("select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) = 1")
def dedup_first(spark, sf_dir):
    return k.first_per_key(table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_totalprice"), ["o_custkey"], [F.desc("o_totalprice"), "o_orderkey"])
