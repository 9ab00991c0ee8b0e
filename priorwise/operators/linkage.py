"""Linking tables that share no ids: unique keys, mutual-best and majority maps, pairing by occurrence, audits of the result."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keep_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows whose key occurs once; all rows of a repeated key go."""
    return df.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(*keys))).where("_n = 1").drop("_n")


def keep_single(df: DataFrame, keys: Sequence[str], context: str) -> DataFrame:
    """Rows whose key stands with one value of the context only, however many rows it has; a null context is no value."""
    one = df.groupBy(F.struct(*keys).alias("_k")).agg(F.min(context).alias("_lo"), F.max(context).alias("_hi")).where("_lo = _hi").select("_k")
    return df.withColumn("_k", F.struct(*keys)).join(one, "_k", "left_semi").drop("_k")


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_i", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_i = 1").drop("_i")


def unique_key_match(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join on keys that occur exactly once on both sides; rows with a null key part are left out."""
    return keep_unique(left.dropna(subset=list(keys)), keys).join(keep_unique(right.dropna(subset=list(keys)), keys), list(keys))


def evidence(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n): how often two ids meet."""
    return pairs.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))


def mutual_best(votes: DataFrame, a: str, b: str, least: int = 3, purity: float = 0.985, by: Sequence[str] = ()) -> DataFrame:
    """(a, b, n, share_a, share_b): pairs that are each other's best (ties to the smaller id) with enough votes and purity on both sides, within `by`."""
    wa, wb = Window.partitionBy(*by, a), Window.partitionBy(*by, b)
    v = votes.withColumns({
        "share_a": F.col("n") / F.sum("n").over(wa), "share_b": F.col("n") / F.sum("n").over(wb),
        "_ra": F.row_number().over(wa.orderBy(F.desc("n"), b)), "_rb": F.row_number().over(wb.orderBy(F.desc("n"), a)),
    })
    return v.where((F.col("_ra") == 1) & (F.col("_rb") == 1) & (F.col("n") >= least) & (F.col("share_a") >= purity) & (F.col("share_b") >= purity)).drop("_ra", "_rb")


def majority_map(votes: DataFrame, a: str, b: str, least: int = 3, share: float = 0.5) -> DataFrame:
    """(a, b, n_top, n_total, share): each a's most frequent b (ties to the smaller), where it has the share of its votes."""
    g = votes.groupBy(a).agg(F.sum("n").alias("n_total"), F.min(F.struct((-F.col("n")).alias("_n"), F.col(b).alias("_b"))).alias("_m"))
    out = g.select(a, F.col("_m._b").alias(b), (-F.col("_m._n")).alias("n_top"), "n_total").withColumn("share", F.col("n_top") / F.col("n_total"))
    return out.where((F.col("n_top") >= least) & (F.col("share") >= share))


def expand_map(pairs: DataFrame, known: DataFrame, a: str, b: str, context: tuple[str, str], **limits) -> DataFrame:
    """Two chained majority maps: votes for (a, b) count only where the context ids (c, d) agree with the map known(c, d)."""
    return majority_map(evidence(pairs.join(known.select(*context), list(context), "left_semi"), a, b), a, b, **limits)


def occurrence_pairing(left: DataFrame, right: DataFrame, keys: Sequence[str], left_order: Sequence[str], right_order: Sequence[str], min_count: bool = False) -> DataFrame:
    """Pairs the i-th row of a key on the left with the i-th on the right, where both sides have as many rows of it
    (min_count: also where they differ, as far as the shorter side goes)."""

    def numbered(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
        w = Window.partitionBy(*keys)
        return df.withColumns({"occurrence": F.row_number().over(w.orderBy(*order)), name: F.count(F.lit(1)).over(w)})

    out = numbered(left, left_order, "_nl").join(numbered(right, right_order, "_nr"), [*keys, "occurrence"])
    return (out if min_count else out.where("_nl = _nr")).drop("_nl", "_nr")


def match_depth(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(depth, key, left_rows, matched, unique_matched) for the first 1, 2, ... keys: rows of the left whose key the right has,
    and keys that occur once on both sides. Both sides are counted by the full key once."""
    la, rb = [d.groupBy(*keys).agg(F.count(F.lit(1)).alias(n)) for d, n in ((left, "nl"), (right, "nr"))]
    out = None
    for i in range(1, len(keys) + 1):
        k = list(keys[:i])
        x = la.groupBy(*k).agg(F.sum("nl").alias("nl")).join(rb.groupBy(*k).agg(F.sum("nr").alias("nr")), k, "left")
        row = x.agg(F.sum("nl").alias("left_rows"), F.coalesce(F.sum(F.when(F.col("nr").isNotNull(), F.col("nl"))), F.lit(0)).alias("matched"), F.count(F.when((F.col("nl") == 1) & (F.col("nr") == 1), 1)).alias("unique_matched"))
        row = row.select(F.lit(i).alias("depth"), F.lit("+".join(k)).alias("key"), "left_rows", "matched", "unique_matched")
        out = row if out is None else out.unionByName(row)
    return out


def leave_one_out(pairs: DataFrame, a: str, b: str, period: str, least: int = 3, purity: float = 0.985) -> DataFrame:
    """(held_out, edges, agree) for each period: edges of its map that the map of the other periods has too. Pairs are counted by period once,
    and the other periods' votes are totals less the period's own."""
    c = pairs.dropna(subset=[a, b, period]).groupBy(a, b, F.col(period).alias("held_out")).agg(F.count(F.lit(1)).alias("n"))
    periods = c.select("held_out").distinct()
    each = [r[0] for r in periods.orderBy("held_out").collect()]  # a few
    totals = c.groupBy(a, b).agg(F.sum("n").alias("_all")).withColumn("held_out", F.explode(F.array(*map(F.lit, each)).cast(f"array<{dict(c.dtypes)['held_out']}>")))
    rest = totals.join(c.withColumnRenamed("n", "_own"), [a, b, "held_out"], "left").withColumn("n", F.col("_all") - F.coalesce("_own", F.lit(0))).where("n > 0").select(a, b, "held_out", "n")
    mine = mutual_best(c, a, b, least, purity, ["held_out"]).select("held_out", a, b)
    other = mutual_best(rest, a, b, least, purity, ["held_out"]).select("held_out", a, b, F.lit(1).alias("_r"))
    found = mine.join(other, ["held_out", a, b], "left").groupBy("held_out").agg(F.count(F.lit(1)).alias("edges"), F.count("_r").alias("agree"))
    return periods.join(found, "held_out", "left").select("held_out", F.coalesce("edges", F.lit(0)).alias("edges"), F.coalesce("agree", F.lit(0)).alias("agree"))


def side_by_side(aggregates: Sequence[DataFrame], keys: Sequence[str]) -> DataFrame:
    """Aggregates with one row a key, column by column: a key that some lack has nulls there. Null keys meet each other."""
    marked = [d.withColumnsRenamed({k: f"_{k}{i}" for k in keys}) for i, d in enumerate(aggregates)]
    out = marked[0]
    for i, d in enumerate(marked[1:], 1):
        on = reduce(lambda x, y: x & y, [F.coalesce(*[F.col(f"_{k}{j}") for j in range(i)]).eqNullSafe(F.col(f"_{k}{i}")) for k in keys])
        out = out.join(d, on, "full")
    names = [c for d in aggregates for c in d.columns if c not in keys]
    return out.select(*[F.coalesce(*[F.col(f"_{k}{i}") for i in range(len(marked))]).alias(k) for k in keys], *names)


def dedup_except(df: DataFrame, column: str) -> DataFrame:
    """One row for all that are equal but for one column: that with its least value (null only where all are)."""
    rest = [c for c in df.columns if c != column]
    return df.groupBy(*rest).agg(F.min(column).alias(column)).select(*df.columns)


def order_consistency(df: DataFrame, group: str, first: Sequence[Column | str], second: Sequence[Column | str], least: int = 5) -> DataFrame:
    """(group, n, rank_corr): correlation of two orders within a group of at least `least` rows."""
    w = Window.partitionBy(group)
    r = df.withColumns({"_a": F.row_number().over(w.orderBy(*first)), "_b": F.row_number().over(w.orderBy(*second))})
    return r.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.corr("_a", "_b").alias("rank_corr")).where(F.col("n") >= least)


def compare_maps(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """(key, left_value, right_value, side): both, left or right; a full join with provenance. Keys must be unique and not null."""
    a, b = left.select(key, F.col(value).alias("left_value"), F.lit(1).alias("_l")), right.select(key, F.col(value).alias("right_value"), F.lit(1).alias("_r"))
    j = a.join(b, key, "full")
    return j.select(key, "left_value", "right_value", F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "both").when(F.col("_l").isNotNull(), "left").otherwise("right").alias("side"))


def mismatches(left: DataFrame, right: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """(column, rows, different): null-safe comparison of two versions on the keys that they share."""
    j = left.alias("l").join(right.alias("r"), key)
    a = j.agg(F.count(F.lit(1)).alias("rows"), *[F.count(F.when(~F.col(f"l.{c}").eqNullSafe(F.col(f"r.{c}")), 1)).alias(c) for c in columns])
    return a.select("rows", F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("different")) for c in columns])).alias("_x")).select("_x.column", "rows", "_x.different")


def alias_map(df: DataFrame, column: str, rules: Sequence[tuple[str, str]]) -> Column:
    """The name that the first matching prefix rule gives, else the value in normal form."""
    from ..functions.expr import normal_text

    c, out = normal_text(column), None
    for prefix, name in rules:
        hit = c.startswith(prefix)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return c if out is None else out.otherwise(c)
