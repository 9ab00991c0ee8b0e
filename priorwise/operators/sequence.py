"""Ordered operators within an entity: changes, runs, sessions, sequences, label reconstruction, changepoints."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import half_even
from ..session import settled


def change_features(df: DataFrame, entity: str, order: Sequence[str], value: str) -> DataFrame:
    """Adds previous (null at the first row), changed (0/1), changes_before (changes up to the row before) and run (rows since the value
    last changed, this one included)."""
    w = Window.partitionBy(entity).orderBy(*order)
    up = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("previous", F.lag(value).over(w))
    out = out.withColumn("changed", F.coalesce((F.col("previous") != F.col(value)).cast("int"), F.lit(0)))
    out = out.withColumn("_island", F.sum("changed").over(up))
    island = Window.partitionBy(entity, "_island").orderBy(*order)
    return out.withColumns({"changes_before": F.col("_island") - F.col("changed"), "run": F.row_number().over(island)}).drop("_island")


def rolling_mean(df: DataFrame, entity: str, order: Sequence[str], value: Column, rows: int = 500, least: int = 20) -> Column:
    """The mean of up to `rows` rows before this one; null with fewer than `least`."""
    w = Window.partitionBy(entity).orderBy(*order).rowsBetween(-rows, -1)
    return F.when(F.count(value).over(w) >= least, F.avg(value).over(w))


def sessions_by_reset(df: DataFrame, entity: str, order: Sequence[str], reset: Column) -> DataFrame:
    """Adds session (from 0), position in it, first and last flags. reset: true where a session begins; it may use lag over the entity."""
    w = Window.partitionBy(entity).orderBy(*order)
    up = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = df.withColumn("_r", F.when(F.row_number().over(w) == 1, 0).otherwise(F.coalesce(reset.cast("int"), F.lit(0))))
    out = out.withColumn("session", F.sum("_r").over(up)).drop("_r")
    s = Window.partitionBy(entity, "session").orderBy(*order)
    out = out.withColumns({"position": F.row_number().over(s), "_n": F.count(F.lit(1)).over(Window.partitionBy(entity, "session"))})
    return out.withColumns({"is_first": F.col("position") == 1, "is_last": F.col("position") == F.col("_n")}).drop("_n")


def asof_session_rate(df: DataFrame, entity: str, session: str, outcome: Column, prior: float = 0.5, k: float = 10.0) -> DataFrame:
    """Adds session_rate: the entity's shrunk outcome rate over earlier sessions, the same for all rows of a session."""
    s = df.groupBy(entity, session).agg(F.max(outcome.cast("int")).alias("_o"))
    w = Window.partitionBy(entity).orderBy(session).rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("session_rate", (F.coalesce(F.sum("_o").over(w), F.lit(0)) + prior * k) / (F.count(F.lit(1)).over(w) + k)).drop("_o")
    return df.join(s, [entity, session])


def last_k(df: DataFrame, entity: str, period: str, order: Sequence[str], value: str, k: int = 16) -> DataFrame:
    """(entity, period, sequence): up to k latest values of rows before the period, oldest first. Rows are cut to the last k of each
    period before they are gathered, so no list exceeds k per period."""
    newest = Window.partitionBy(entity, period).orderBy(*[F.col(c).desc() for c in order])
    some = df.withColumn("_i", F.row_number().over(newest)).where(F.col("_i") <= k)
    by = some.groupBy(entity, period).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).alias("_v")))).alias("_s"))
    w = Window.partitionBy(entity).orderBy(period).rowsBetween(-k, -1)  # k earlier periods hold k rows at least
    past = F.flatten(F.collect_list("_s").over(w))
    return by.withColumn("_p", past).select(entity, period, F.transform(F.when(F.size("_p") > k, F.slice("_p", -k, k)).otherwise(F.col("_p")), lambda x: x["_v"]).alias("sequence"))


def frozen_last_k(df: DataFrame, entity: str, order: Sequence[str], value: str, k: int = 16) -> DataFrame:
    """(entity, sequence): the last k values of all rows, for scoring."""
    newest = Window.partitionBy(entity).orderBy(*[F.col(c).desc() for c in order])
    some = df.withColumn("_i", F.row_number().over(newest)).where(F.col("_i") <= k)
    return some.groupBy(entity).agg(F.transform(F.array_sort(F.collect_list(F.struct(F.col("_i").alias("i"), F.col(value).alias("v"))), lambda a, b: b["i"] - a["i"]), lambda x: x["v"]).alias("sequence"))


def reconstruct_label(df: DataFrame, entity: str, order: Sequence[str], rate: str, n: str, tolerance: float = 0.25, adjacent: bool = False) -> DataFrame:
    """Adds label (0, 1 or null): the step of rate * n to the entity's next row, where n goes up by 1 and the step is within tolerance of a label.

    adjacent: the next row in the order of all rows must be the entity's (fewer rows have one); it is the row of the
    entity whose place in the whole order is next, found without a window over all rows."""
    w = Window.partitionBy(entity).orderBy(*order)
    count = F.coalesce(F.col(rate), F.lit(0.0)) * F.col(n)
    step = F.lead(count).over(w) - count
    ok = (F.lead(n).over(w) == F.col(n) + 1) & (F.abs(step - half_even(step)) <= tolerance) & half_even(step).isin(0, 1)
    out = df.withColumn("label", F.when(ok, half_even(step).cast("int")))
    if adjacent:
        out = out.withColumn("_next", F.lead(F.struct(*order)).over(w))
        near = global_next(df, order).withColumnRenamed("_following", "_g")
        out = out.join(near, list(order), "left").withColumn("label", F.when(F.col("_g") == F.col("_next"), F.col("label"))).drop("_next", "_g")
    return out


def balanced_outcomes(df: DataFrame, block: Sequence[str], order: Sequence[str], stock: str, lost: str, gained: str) -> DataFrame:
    """Adds outcome (kept, lost, other or null) of one newcomer a row, from a stock and two counters as they stand before the row.

    With the block's next row, newcomer and stock must be accounted for: stock + 1 = next stock + step of gained + step of lost. Where that
    holds, a row with no step of lost and more in stock or gained than before has kept its newcomer, one with a step has lost
    somebody. Rows that break the balance have no outcome. A block's last row has no next one and counts as lost, as blocks end with a
    loss; leaving such rows out would raise the share of kept ones."""
    w = Window.partitionBy(*block).orderBy(*order)
    after, step = F.lead(stock).over(w), lambda c: F.lead(c).over(w) - F.col(c)
    left = after + step(gained)
    last = F.lead(F.lit(1)).over(w).isNull()
    held = F.when(step(lost) > 0, "lost").when((step(lost) == 0) & (left > F.col(stock)), "kept").otherwise("other")
    return df.withColumn("outcome", F.when(last, "lost").when(F.col(stock) + 1 == left + step(lost), held))


#: Rows of a range of global_next.
RANGE_ROWS = 500_000


def global_next(df: DataFrame, order: Sequence[str], parts: int | None = None) -> DataFrame:
    """(order, _following): for each row the order columns of the next row of all. Rows are dealt out in ranges of the whole order, so equal
    first columns don't share a range; there is one for each RANGE_ROWS rows (counted). The ranges are settled, so a task that runs again sees
    the same; each looks ahead in itself, and its last row takes the first row of the next range that has any, from a table of a row a range."""
    parts = parts or -(-df.count() // RANGE_ROWS) or 1
    ranged = settled(df.select(*order).repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    inner = ranged.withColumn("_following", F.lead(F.struct(*order)).over(Window.partitionBy("_part").orderBy(*order)))
    heads = ranged.groupBy("_part").agg(F.min(F.struct(*order)).alias("_head"))
    after = heads.select("_part", F.lead("_head").over(Window.orderBy("_part")).alias("_after"))  # at most `parts` rows
    return inner.join(F.broadcast(after), "_part").select(*order, F.coalesce("_following", "_after").alias("_following"))


def split_state(df: DataFrame, entity: str, order: Sequence[str], state: str, n: str, rate: str, split, names: tuple, near: float = 0.25) -> DataFrame:
    """Adds <state>_split: rows whose state is `split` become names[0] or names[1] by whether a second counter goes up at the entity's next row,
    names[2] where that can't be told; other states stay. The counter is rate times n, both cumulative before the row; the next row must
    count exactly one more, and the increment must be within `near` of 0 or 1. A null rate or n counts as 0."""
    w = Window.partitionBy(entity).orderBy(*order)
    count, total = F.coalesce(F.col(n), F.lit(0.0)), F.coalesce(F.col(rate), F.lit(0.0)) * F.coalesce(F.col(n), F.lit(0.0))
    up = F.lead(total).over(w) - total
    told = (F.abs(F.lead(count).over(w) - count - 1) < 1e-8) & (F.abs(up - F.round(up)) < near)
    kind = F.when(told & (F.round(up) == 1), names[0]).when(told & (F.round(up) == 0), names[1]).otherwise(names[2])
    return df.withColumn("_k", kind).withColumn(f"{state}_split", F.when(F.col(state) == split, F.col("_k")).otherwise(F.col(state))).drop("_k")


def agreement(df: DataFrame, label: str, truth: str, least: float = 0.9999) -> DataFrame:
    """(known, agree, rate, ok): how often a reconstructed label equals the true one."""
    a = df.agg(F.count(label).alias("known"), F.count(F.when(F.col(label) == F.col(truth), 1)).alias("agree"))
    return a.withColumn("rate", F.col("agree") / F.col("known")).withColumn("ok", F.coalesce(F.col("rate") >= least, F.lit(False)))


def multi_state(states: Sequence[tuple[str, Column]], other: str | None, known: Column) -> Column:
    """The first state whose condition holds, else `other`; null where nothing is known."""
    out = None
    for name, c in states:
        out = F.when(c, name) if out is None else out.when(c, name)
    return F.when(known, out.otherwise(other))


def changepoints(df: DataFrame, entity: str, period: str, value: str, width: int = 10, least: int = 5) -> DataFrame:
    """(entity, period, gap): the period with the largest gap between the means of up to `width` values before it and from it on, with
    `least` on each side; of equal gaps the first."""
    w = Window.partitionBy(entity).orderBy(period)
    before, after = w.rowsBetween(-width, -1), w.rowsBetween(0, width - 1)
    g = df.withColumns({"_b": F.avg(value).over(before), "_a": F.avg(value).over(after), "_nb": F.count(value).over(before), "_na": F.count(value).over(after)})
    g = g.where((F.col("_nb") >= least) & (F.col("_na") >= least)).withColumn("gap", F.round(F.col("_a") - F.col("_b"), 9))
    best = g.groupBy(entity).agg(F.max_by(F.struct(period, "gap"), F.struct(F.abs("gap"), -F.col(period))).alias("_m"))
    return best.select(entity, f"_m.{period}", "_m.gap")


def period_pairs(df: DataFrame, entity: str, period: str, value: str) -> DataFrame:
    """(entity, period, value, next_value) for entities with values in a period and the next one."""
    w = Window.partitionBy(entity).orderBy(period)
    out = df.withColumns({"_p": F.lead(period).over(w), "next_value": F.lead(value).over(w)})
    return out.where(F.col("_p") == F.col(period) + 1).select(entity, period, value, "next_value")


def order_faults(df: DataFrame, entity: str, order: Sequence[str], counter: str) -> DataFrame:
    """(entity, rows, faults): rows at which a counter that must rise goes down or stays."""
    w = Window.partitionBy(entity).orderBy(*order)
    d = df.withColumn("_d", F.col(counter) - F.lag(counter).over(w))
    return d.groupBy(entity).agg(F.count(F.lit(1)).alias("rows"), F.count(F.when(F.col("_d") <= 0, 1)).alias("faults"))
