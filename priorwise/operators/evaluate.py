"""Evaluation of probabilities: skill, calibration, residual tables over many axes, shifts, blends, stability across folds.

Grids are aggregates side by side in one pass over the rows, never copies of the rows for each grid point."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bin_right, col, logit, sigmoid
from ..session import settled


#: Ranges of scores that a window over all of them is split into.
RANGES = 200


def brier(p: str | Column, y: str | Column) -> Column:
    return F.avg(F.pow(col(p) - col(y), 2))


def skill(p: str | Column, y: str | Column, floor: bool = True) -> Column:
    """100000 * (1 - Brier / (r (1 - r))) with the label rate r; not below 0 with floor; null if all labels are equal."""
    r = F.avg(col(y))
    s = 100000 * (1 - brier(p, y) / F.nullif(r * (1 - r), F.lit(0.0)))
    return F.greatest(s, F.lit(0.0)) if floor else s


def _stacked(df: DataFrame, by: Sequence[str], points: Sequence[tuple], names: Sequence[str], value) -> DataFrame:
    """(by, names, value) with value(point) aggregated for every point in one pass."""
    aggs = [value(pt).alias(f"_{i}") for i, pt in enumerate(points)]
    one = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    rows = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, pt)], F.col(f"_{i}").alias("value")) for i, pt in enumerate(points)])
    return one.select(*by, F.inline(rows))


def shift_scores(df: DataFrame, p: str, y: str, shifts: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, shift, brier) of logit shifts."""
    z = df.withColumn("_z", logit(p))
    return _stacked(z, by, [(float(s),) for s in shifts], ["shift"], lambda pt: brier(sigmoid(F.col("_z") + pt[0]), y)).withColumnRenamed("value", "brier")


def best_shift(df: DataFrame, p: str, y: str, shifts: Sequence[float], by: Sequence[str] = (), digits: int = 9) -> DataFrame:
    """(by, shift, brier): the shift of the least Brier score (rounded to `digits`), of equals the smallest by size, then by value."""
    s = shift_scores(df, p, y, shifts, by).withColumn("_b", F.round("brier", digits))
    best = F.min_by(F.struct("shift", "brier"), F.struct("_b", F.abs("shift"), "shift")).alias("_m")
    return (s.groupBy(*by).agg(best) if by else s.agg(best)).select(*by, "_m.shift", "_m.brier")


def temperature_scores(df: DataFrame, p: str, y: str, temperatures: Sequence[float], intercepts: Sequence[float]) -> DataFrame:
    """(temperature, intercept, brier) of sigmoid(z / temperature + intercept) on a grid."""
    z = df.withColumn("_z", logit(p))
    points = [(float(t), float(b)) for t in temperatures for b in intercepts]
    return _stacked(z, [], points, ["temperature", "intercept"], lambda pt: brier(sigmoid(F.col("_z") / pt[0] + pt[1]), y)).withColumnRenamed("value", "brier")


def calibration(df: DataFrame, p: str, y: str, edges: Sequence[float]) -> DataFrame:
    """(bin, n, mean_p, rate, gap) for right-closed bins of p, the first with its left edge."""
    b = df.withColumn("bin", bin_right(p, edges, lowest=True))
    return b.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_p"), F.avg(y).alias("rate")).withColumn("gap", F.col("rate") - F.col("mean_p"))


def group_report(df: DataFrame, p: str, y: str, axes: Sequence[str], least: int = 750) -> DataFrame:
    """(axis, cell, n, rate, mean_p, residual, brier) for all axes in one scan of grouping sets; cells under `least` rows are left out.
    The axis "all" has everything."""
    d = df.select(*axes, col(p).alias("_p"), col(y).alias("_y"))
    g = d.groupingSets([[], *[[F.col(a)] for a in axes]], *axes).agg(F.grouping_id(*axes).alias("_g"), F.count(F.lit(1)).alias("n"), F.avg("_y").alias("rate"), F.avg("_p").alias("mean_p"), brier("_p", "_y").alias("brier"))
    full = (1 << len(axes)) - 1
    axis, cell = F.when(F.col("_g") == full, "all"), F.when(F.col("_g") == full, "all")
    for i, a in enumerate(axes):
        here = F.col("_g") == full - (1 << (len(axes) - 1 - i))
        axis, cell = axis.when(here, a), cell.when(here, F.col(a).cast("string"))
    return g.where(F.col("n") >= least).select(axis.alias("axis"), cell.alias("cell"), "n", "rate", "mean_p", (F.col("rate") - F.col("mean_p")).alias("residual"), "brier")


def residuals_by_period(df: DataFrame, p: str, y: str, period: str, axes: Sequence[str]) -> DataFrame:
    """(axis, cell, period, n, residual) in one scan."""
    cells = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("cell")) for a in axes])
    d = df.select(period, (col(y) - col(p)).alias("_r"), F.inline(cells))
    return d.groupBy("axis", "cell", period).agg(F.count(F.lit(1)).alias("n"), F.avg("_r").alias("residual"))


def stable_residuals(res: DataFrame, period: str, periods: Sequence, least: int = 100) -> DataFrame:
    """(axis, cell, r_<period>.., min_n): cells with enough rows and one sign of the residual in all the periods."""
    r = res.where(F.col(period).isin(list(periods))).groupBy("axis", "cell").pivot(period, list(periods)).agg(F.first("n").alias("n"), F.first("residual").alias("r"))
    ns, rs = [F.col(f"{t}_n") for t in periods], [F.col(f"{t}_r") for t in periods]
    same = F.greatest(*rs) < 0
    ok = F.least(*ns) >= least
    for n in ns:
        ok = ok & n.isNotNull()
    return r.where(ok & (same | (F.least(*rs) > 0))).select("axis", "cell", *[c.alias(f"r_{t}") for c, t in zip(rs, periods)], F.least(*ns).alias("min_n"))


def residual_transfer(df: DataFrame, p: str, y: str, period: str, cell: Sequence[str], fit_to: int, score_on: int, k: float = 5000.0) -> DataFrame:
    """(n, brier_before, brier_after) on a period after residuals of the cells up to another, shrunk by n / (n + k), are added to p."""
    fit = df.where(F.col(period) <= fit_to).groupBy(*cell).agg((F.count(F.lit(1)) / (F.count(F.lit(1)) + k) * F.avg(col(y) - col(p))).alias("_c"))
    d = df.where(F.col(period) == score_on).join(fit, list(cell), "left").withColumn("_q", F.greatest(F.least(col(p) + F.coalesce("_c", F.lit(0.0)), F.lit(1.0)), F.lit(0.0)))
    return d.agg(F.count(F.lit(1)).alias("n"), brier(p, y).alias("brier_before"), brier("_q", y).alias("brier_after"))


def bias_decomposition(df: DataFrame, p: str, y: str, cell: Sequence[str]) -> DataFrame:
    """(cell, n, bias, se, t, points): points is the skill that removing the cell's bias would gain, n / N * bias^2 / (r (1 - r)) * 100000."""
    total = df.agg(F.count(F.lit(1)).alias("_N"), F.avg(y).alias("_r"))
    g = df.groupBy(*cell).agg(F.count(F.lit(1)).alias("n"), F.avg(col(y) - col(p)).alias("bias"), (F.stddev_samp(col(y) - col(p)) / F.sqrt(F.count(F.lit(1)))).alias("se"))
    out = g.crossJoin(F.broadcast(total)).withColumns({"t": F.when(F.col("se") > 0, F.col("bias") / F.col("se")), "points": F.col("n") / F.col("_N") * F.pow("bias", F.lit(2)) / (F.col("_r") * (1 - F.col("_r"))) * 100000})
    return out.select(*cell, "n", "bias", "se", "t", "points")


def confirmed_cells(res: DataFrame, period: str, discover: Sequence, confirm, least_t: float = 0.0, least: int = 50) -> DataFrame:
    """(axis, cell, discovered, confirmed): cells whose mean residual keeps one sign over the discovery periods, with the residual of a
    period that took no part."""
    d = res.where(F.col(period).isin(list(discover)) & (F.col("n") >= least)).groupBy("axis", "cell").agg(F.count(F.lit(1)).alias("_k"), F.min("residual").alias("_lo"), F.max("residual").alias("_hi"), (F.sum(F.col("n") * F.col("residual")) / F.sum("n")).alias("discovered"))
    d = d.where((F.col("_k") == len(discover)) & ((F.col("_lo") > 0) | (F.col("_hi") < 0)) & (F.abs("discovered") >= least_t))
    c = res.where(F.col(period) == confirm).select("axis", "cell", F.col("residual").alias("confirmed"))
    return d.join(c, ["axis", "cell"], "left").select("axis", "cell", "discovered", "confirmed")


def grams(df: DataFrame, columns: Sequence[str], *by: str) -> list[np.ndarray]:
    """For each group the matrix of sums of products of the columns and a constant: one aggregate over the rows."""
    c = [F.lit(1.0), *[F.col(x).cast("double") for x in columns]]
    n = len(c)
    at = [(i, j) for i in range(n) for j in range(i, n)]
    made = []
    for row in df.groupBy(*by).agg(*[F.sum(c[i] * c[j]).alias(f"g{i}_{j}") for i, j in at]).collect():
        out = np.zeros((n, n))
        for (i, j), v in zip(at, row[len(by) :]):
            out[i, j] = out[j, i] = v or 0.0
        made.append(out)
    return made


def gram(df: DataFrame, columns: Sequence[str]) -> np.ndarray:
    """The matrix of sums of products of the columns and a constant."""
    return grams(df, columns)[0]


def partial_corr(df: DataFrame, x: str, y: str, controls: Sequence[str]) -> float | None:
    """Correlation of the least-squares residuals of x and y on the controls, from the Gram matrix (a small solve on the driver)."""
    g = gram(df, [*controls, x, y])
    k = len(controls) + 1
    a, b = g[:k, :k], g[:k, k:]
    s = g[k:, k:] - b.T @ np.linalg.pinv(a) @ b
    return None if s[0, 0] <= 0 or s[1, 1] <= 0 else float(s[0, 1] / np.sqrt(s[0, 0] * s[1, 1]))


def blend_sweep(df: DataFrame, p: str, q: str, y: str, weights: Sequence[float]) -> DataFrame:
    """(weight, brier) of w p + (1 - w) q: the score is quadratic in w, so three sums give every point."""
    d = df.select((col(p) - col(q)).alias("_d"), (col(q) - col(y)).alias("_e"))
    s = d.agg(F.avg(F.col("_d") ** 2).alias("_a"), F.avg(F.col("_d") * F.col("_e")).alias("_b"), F.avg(F.col("_e") ** 2).alias("_c"))
    w = F.explode(F.array(*[F.lit(float(v)) for v in weights])).alias("weight")
    return s.select("*", w).select("weight", (F.col("_a") * F.col("weight") ** 2 + 2 * F.col("_b") * F.col("weight") + F.col("_c")).alias("brier"))


def best_blend(df: DataFrame, p: str, q: str, y: str, by: Sequence[str] = (), low: float = 0.0, high: float = 1.0) -> DataFrame:
    """(by, n, weight): the closed-form best weight within bounds; 0.5 where p and q are equal."""
    aggs = [F.count(F.lit(1)).alias("n"), F.sum((col(p) - col(q)) * (col(y) - col(q))).alias("_b"), F.sum((col(p) - col(q)) ** 2).alias("_a")]
    g = df.groupBy(*by).agg(*aggs) if by else df.agg(*aggs)
    return g.select(*by, "n", F.when(F.col("_a") > 0, F.greatest(F.least(F.col("_b") / F.col("_a"), F.lit(high)), F.lit(low))).otherwise(0.5).alias("weight"))


def crossfit_weights(df: DataFrame, p: str, q: str, y: str, half: str, cell: str, k: float = 500.0) -> DataFrame:
    """(half, cell, n, weight): the weight for a half's rows from the other half (halves are 0 and 1): the cell's best, shrunk to the global one by n / (n + k)."""
    cells = best_blend(df, p, q, y, [half, cell]).withColumnRenamed("weight", "_w")
    whole = best_blend(df, p, q, y, [half]).select(half, F.col("weight").alias("_g"))
    out = cells.join(F.broadcast(whole), half)
    return out.select((1 - F.col(half)).alias(half), cell, "n", (F.col("n") / (F.col("n") + k) * (F.col("_w") - F.col("_g")) + F.col("_g")).alias("weight"))


def backfit(df: DataFrame, p: str, y: str, first: str, second: str, passes: int = 4, k: float = 100.0) -> DataFrame:
    """(first, second, n, effect_first, effect_second): additive residual map; rows are aggregated to (first, second) once, then each pass
    refits one factor to what the other leaves, shrunk by n / (n + k) and centred. The aggregate is settled once, and an effect is a table
    of one row for each value of its factor (null is one), settled after its step, so no plan grows with the passes."""
    g = settled(df.groupBy(F.struct(F.col(first).alias("v")).alias("_first"), F.struct(F.col(second).alias("v")).alias("_second")).agg(F.count(F.lit(1)).alias("n"), F.sum(col(y) - col(p)).alias("_s")))
    effects: dict[str, DataFrame] = {}
    for _ in range(passes):
        for own, other in (("_first", "_second"), ("_second", "_first")):
            met = g.join(effects[other].withColumnRenamed("effect", "_o"), other) if other in effects else g.withColumn("_o", F.lit(0.0))
            raw = met.groupBy(own).agg(F.sum("n").alias("_n"), (F.sum(F.col("_s") - F.col("n") * F.col("_o")) / (F.sum("n") + k)).alias("_e"))
            mean = raw.agg((F.sum(F.col("_n") * F.col("_e")) / F.sum("_n")).alias("_mean"))  # one row
            effects[own] = settled(raw.crossJoin(F.broadcast(mean)).select(own, (F.col("_e") - F.col("_mean")).alias("effect")))
    out = g.drop("_s")
    for own in ("_first", "_second"):
        out = out.join(effects[own].withColumnRenamed("effect", f"effect{own}"), own) if own in effects else out.withColumn(f"effect{own}", F.lit(0.0))
    return out.select(F.col("_first.v").alias(first), F.col("_second.v").alias(second), "n", "effect_first", "effect_second")


def bootstrap(df: DataFrame, key: str, value: Column, rounds: int = 200, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(mean, low, high, wins): percentile interval of a mean under a Poisson bootstrap whose weights come from a hash of (key, round);
    wins counts rounds with a positive mean."""
    cuts = np.cumsum([np.exp(-1) / math.factorial(j) for j in range(10)])

    def partial(it):
        w, s = np.zeros(rounds), np.zeros(rounds)
        for pdf in it:
            v = pdf["_v"].to_numpy(float)
            h = pdf["_h"].to_numpy().view(np.uint64)
            for i in range(rounds):
                u = h * np.uint64(2 * i + 1) + np.uint64(i * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
                u = (u ^ (u >> np.uint64(31))) * np.uint64(0x94D049BB133111EB)
                k = np.searchsorted(cuts, (u >> np.uint64(11)) / float(1 << 53), side="right")
                w[i] += k.sum()
                s[i] += k @ v
        yield pd.DataFrame({"i": range(rounds), "w": w, "s": s})

    d = df.select(F.xxhash64(key).alias("_h"), value.cast("double").alias("_v")).dropna()
    means = d.mapInPandas(partial, "i int, w double, s double").groupBy("i").agg((F.sum("s") / F.nullif(F.sum("w"), F.lit(0.0))).alias("m"))
    a = means.agg(F.array_sort(F.collect_list("m")).alias("_m")).crossJoin(d.agg(F.avg("_v").alias("mean")))  # `rounds` numbers
    at = lambda q: F.get("_m", F.lit(int(round(q * (rounds - 1)))))
    return a.select("mean", at(low).alias("low"), at(high).alias("high"), F.size(F.filter("_m", lambda x: x > 0)).alias("wins"))


def paired_t(df: DataFrame, pair: str, variant: str, value: str, a, b) -> DataFrame:
    """(pairs, mean_diff, t) of b - a over pairs that have both."""
    d = df.where(F.col(variant).isin(a, b)).groupBy(pair).agg(F.max(F.when(F.col(variant) == a, F.col(value))).alias("_a"), F.max(F.when(F.col(variant) == b, F.col(value))).alias("_b")).dropna(subset=["_a", "_b"])
    g = d.agg(F.count(F.lit(1)).alias("pairs"), F.avg(F.col("_b") - F.col("_a")).alias("mean_diff"), F.stddev_samp(F.col("_b") - F.col("_a")).alias("_s"))
    return g.select("pairs", "mean_diff", F.when(F.col("_s") > 0, F.col("mean_diff") / (F.col("_s") / F.sqrt("pairs"))).alias("t"))


def worst_rows(df: DataFrame, p: str, y: str, key: str, k: int = 20) -> DataFrame:
    """The k rows of the largest squared error, ties by key."""
    return df.withColumn("loss", F.pow(col(p) - col(y), 2)).orderBy(F.desc("loss"), key).limit(k)


def seed_variance(df: DataFrame, seed: str, key: str, value: str) -> DataFrame:
    """(pairs, variance): variance between seeds from all pairs of a key's predictions, half the mean squared difference."""
    g = df.groupBy(key).agg(F.count(value).alias("_k"), F.var_samp(value).alias("_v")).where("_k > 1")
    return g.agg(F.sum(F.col("_k") * (F.col("_k") - 1) / 2).cast("long").alias("pairs"), F.avg("_v").alias("variance"))


def auc(df: DataFrame, p: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, n, auc): the chance that a positive row has a higher p than a negative one, ties half. Rows are aggregated to distinct
    values of p (rounded to 9 places) before the window, which runs within `by` and one of RANGES ranges of p; the negatives
    of the ranges below are added from a table of a row for each."""
    d = df.groupBy(*by, F.round(p, 9).alias("_p")).agg(F.sum(col(y)).alias("_pos"), F.sum(1 - col(y)).alias("_neg"))
    cuts = sorted(set(df.agg(F.percentile_approx(F.round(p, 9), [i / RANGES for i in range(1, RANGES)])).first()[0] or []))
    d = d.withColumn("_range", F.size(F.filter(F.array(*[F.lit(float(c)) for c in cuts]).cast("array<double>"), lambda c: c < F.col("_p"))))
    totals = d.groupBy(*by, "_range").agg(F.sum("_neg").alias("_all"))
    up = Window.partitionBy(*(by or [F.lit(1)])).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_base", F.coalesce(F.sum("_all").over(up), F.lit(0))).drop("_all")
    w = Window.partitionBy(*by, "_range").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("_neg").over(w), F.lit(0))).join(totals, [*by, "_range"]).withColumn("_below", F.col("_in") + F.col("_base"))
    won = F.sum(F.col("_pos") * (F.col("_below") + F.col("_neg") / 2))
    pairs = F.sum("_pos") * F.sum("_neg")
    g = d.groupBy(*by) if by else d
    return g.agg(F.sum(F.col("_pos") + F.col("_neg")).cast("long").alias("n"), F.when(pairs > 0, won / pairs).alias("auc"))


def rolling_origin(df: DataFrame, period: str, width: int, first: int | None = None, last: int | None = None):
    """(test period, rows of the `width` periods before it, rows of it) for each test period, for models that must be fitted anew each time.
    Without bounds the test periods are those of the table that have `width` periods before them. Rates need no such passes: rolling_rates."""
    if first is None or last is None:
        lo, hi = df.agg(F.min(period), F.max(period)).first()
        first, last = (first if first is not None else (lo or 0) + width), (last if last is not None else (-1 if hi is None else hi))
    for t in range(first, last + 1):
        yield t, df.where((F.col(period) >= t - width) & (F.col(period) < t)), df.where(F.col(period) == t)


def rolling_rates(df: DataFrame, keys: Sequence[str], period: str, y: str, width: int) -> DataFrame:
    """(keys, period, n, s, rate): each key's rows and label sum in a period and its rate over the `width` periods before, for every period of the
    table with as many before it. The rows are read and summed by (keys, period) once; all origins share the sums."""
    g = df.groupBy(*keys, period).agg(F.count(F.lit(1)).alias("n"), F.sum(col(y).cast("double")).alias("s"))
    w = Window.partitionBy(*keys).orderBy(period).rangeBetween(-width, -1)
    first = F.broadcast(df.agg(F.min(period).alias("_first")))  # one row
    out = g.withColumn("rate", F.sum("s").over(w) / F.sum("n").over(w)).crossJoin(first)
    return out.where(F.col(period) >= F.col("_first") + width).drop("_first")


def rolling_brier(rates: DataFrame, period: str) -> DataFrame:
    """(period, n, brier) of the rates of rolling_rates on 0/1 labels, from their sums; keys without a rate are left out."""
    known = rates.where("rate is not null")
    return known.groupBy(period).agg(F.sum("n").alias("n"), (F.sum(F.col("s") * F.pow(1 - F.col("rate"), F.lit(2)) + (F.col("n") - F.col("s")) * F.pow("rate", F.lit(2))) / F.sum("n")).alias("brier"))


def joint_blend(df: DataFrame, members: Sequence[str], y: str, fold: str, anchor: Sequence[float], penalty: float) -> list[float]:
    """Weights that minimise the mean over folds of each fold's Brier score plus penalty * |w - anchor|^2: the folds' Gram matrices (one
    aggregate for all) give the small linear system in closed form. Rows without fold are left out."""
    k = len(members)
    a, b = np.eye(k) * penalty, penalty * np.asarray(anchor, float)
    names = grams(df.dropna(subset=[fold]), [*members, y], fold)  # a handful of folds
    for g in names:
        a += g[1 : k + 1, 1 : k + 1] / g[0, 0] / len(names)
        b += g[1 : k + 1, k + 1] / g[0, 0] / len(names)
    return [float(v) for v in np.linalg.solve(a, b)]


def weighted_moments(df: DataFrame, x: str, y: str, w: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, mean_x, mean_y, cov, corr) with weights w, from six sums."""
    c = F.col
    sums = [F.sum(w).alias("_w"), *[F.sum(c(w) * e).alias(n) for n, e in (("_x", c(x)), ("_y", c(y)), ("_xy", c(x) * c(y)), ("_xx", c(x) * c(x)), ("_yy", c(y) * c(y)))]]
    g = df.groupBy(*by).agg(*sums) if by else df.agg(*sums)
    mx, my = c("_x") / c("_w"), c("_y") / c("_w")
    cov, vx, vy = c("_xy") / c("_w") - mx * my, c("_xx") / c("_w") - mx * mx, c("_yy") / c("_w") - my * my
    return g.select(*by, mx.alias("mean_x"), my.alias("mean_y"), cov.alias("cov"), F.when((vx > 0) & (vy > 0), cov / F.sqrt(vx * vy)).alias("corr"))


def order_shuffle_test(df: DataFrame, plan, key: str, seed: int = 0, parts: int = 7) -> DataFrame:
    """(n, differing): rows of plan(df), and those without an equal row in plan of the same rows in another order and partitioning.
    A plan that scores rows one by one has none. key names a column that varies, by whose hash rows are dealt out anew."""
    other = df.repartition(parts, F.xxhash64(key, F.lit(seed))).sortWithinPartitions(F.xxhash64(key, F.lit(seed + 1)))
    a, b = plan(df), plan(other)
    count = lambda d, name: d.groupBy(*[F.col(c) for c in a.columns]).agg(F.count(F.lit(1)).alias(name))
    both = count(a, "_a").unionByName(count(b, "_b").withColumn("_a", F.lit(0).cast("long") - F.col("_b")).drop("_b"))
    net = both.groupBy(*a.columns).agg(F.sum("_a").alias("_net"), F.sum(F.greatest("_a", F.lit(0))).alias("_n"))
    return net.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.greatest("_net", F.lit(0))), F.lit(0)).alias("differing"))
