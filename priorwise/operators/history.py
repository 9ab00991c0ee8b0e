"""History features that never look ahead: state of prior periods or prior rows, shrunk rates, deviations and slopes.

Common form: rate = (s + alpha * prior) / (n + alpha), dev = rate - base, conf = log1p(n). Tables are aggregated to
(keys, period) before any window, so windows run over groups instead of rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import clip, half_even


def shrunk(s: Column, n: Column, prior: Column | float, alpha: float) -> Column:
    """The rate s / n drawn towards prior with the weight of alpha rows."""
    return (F.coalesce(s, F.lit(0)) + alpha * prior) / (F.coalesce(n, F.lit(0)) + alpha)


def period_sums(df: DataFrame, keys: Sequence[str], period: str, label: Column | str) -> DataFrame:
    """(keys, period, n, s): rows and label sum."""
    y = F.col(label) if isinstance(label, str) else label
    return df.groupBy(*keys, period).agg(F.count(F.lit(1)).alias("n"), F.sum(y.cast("double")).alias("s"))


def prior_sums(sums: DataFrame, keys: Sequence[str], period: str, names: Sequence[str] = ("n", "s"), last: int | None = None) -> DataFrame:
    """Adds <name>_prior: the sum over earlier periods of the same keys, or over the `last` periods before; zero without any."""
    w = Window.partitionBy(*keys).orderBy(period).rangeBetween(Window.unboundedPreceding if last is None else -last, -1)
    return sums.withColumns({f"{c}_prior": F.coalesce(F.sum(c).over(w), F.lit(0)) for c in names})


def prior_table(sums: DataFrame, keys: Sequence[str], period: str, by: Sequence[str] = ()) -> DataFrame:
    """The label's mean over earlier periods by `by` (all rows without): (by, period, prior), null in the first period."""
    s = sums.groupBy(*by, period).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    s = prior_sums(s, list(by) or [F.lit(1)], period)
    return s.select(*by, period, F.when(F.col("n_prior") > 0, F.col("s_prior") / F.col("n_prior")).alias("prior"))


def encode_triple(df: DataFrame, n: str, s: str, prior: Column | float, base: Column | float, alpha: float, name: str = "") -> DataFrame:
    """Adds <name>rate, <name>dev, <name>conf."""
    rate = shrunk(F.col(s), F.col(n), prior, alpha)
    return df.withColumns({f"{name}rate": rate, f"{name}dev": rate - base, f"{name}conf": F.log1p(F.col(n).cast("double"))})


def prior_period_triple(df: DataFrame, entity: Sequence[str], cell: Sequence[str], period: str, label: Column | str, alpha: float = 200.0, prior: str | float = "prior_period", default: float = 0.5, history: Column | None = None) -> DataFrame:
    """(entity, cell, period, n_prior, s_prior, rate, dev, conf) for every group that occurs in a period.

    prior: a constant, "all" (the cell's mean over all rows: it sees the future), "train" (over the rows of `history`) or
    "prior_period" (the cell's mean over earlier periods, then `default`). dev is against the prior."""
    sums = period_sums(df, [*entity, *cell], period, label)
    state = prior_sums(sums, [*entity, *cell], period)
    if isinstance(prior, str):
        if prior == "prior_period":
            means, on = prior_table(sums, cell, period, cell), [*cell, period]
        else:
            some = period_sums(df.where(history) if prior == "train" else df, [*entity, *cell], period, label)
            means, on = some.groupBy(*cell).agg((F.sum("s") / F.sum("n")).alias("prior")), list(cell)
        state = state.join(means, on, "left")
        p = F.coalesce("prior", F.lit(default))
    else:
        p = F.lit(float(prior))
    return encode_triple(state, "n_prior", "s_prior", p, p, alpha).select(*entity, *cell, period, "n_prior", "s_prior", "rate", "dev", "conf")


def frozen_triple(df: DataFrame, entity: Sequence[str], cell: Sequence[str], period: str, cutoff: int, label: Column | str, alpha: float = 200.0) -> DataFrame:
    """A lookup for scoring: totals of the periods up to cutoff, whatever cells the last period has."""
    t = df.where(F.col(period) <= cutoff)
    y = F.col(label) if isinstance(label, str) else label
    sums = t.groupBy(*entity, *cell).agg(F.count(F.lit(1)).alias("n"), F.sum(y.cast("double")).alias("s"))
    means = t.groupBy(*cell).agg(F.avg(y.cast("double")).alias("prior"))
    return encode_triple(sums.join(means, list(cell)), "n", "s", F.col("prior"), F.col("prior"), alpha)


def apply_frozen(rows: DataFrame, frozen: DataFrame, keys: Sequence[str], values: dict[str, float]) -> DataFrame:
    """Scored rows with frozen values or their defaults: a join on the real keys, never a window or aggregate over the scored rows."""
    out = rows.join(frozen.select(*keys, *[F.col(v).alias(f"_{v}") for v in values]), list(keys), "left")
    return out.withColumns({v: F.coalesce(f"_{v}", F.lit(d)) for v, d in values.items()}).drop(*[f"_{v}" for v in values])


def asof_sums(df: DataFrame, keys: Sequence[str], order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """Adds for each value its sum over earlier rows of the same keys (0 without any); order must end in a unique key."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumns({name: F.coalesce(F.sum(v).over(w), F.lit(0)) for name, v in values.items()})


def asof_sums_in_buckets(df: DataFrame, keys: Sequence[str], bucket: str, order: Sequence[str], values: dict[str, Column]) -> DataFrame:
    """asof_sums for keys with very many rows: totals of earlier buckets (a column that order never goes back on, such as the day)
    plus a running sum within the bucket, so no task holds all rows of a key."""
    at = df.withColumns({f"_v_{n}": v for n, v in values.items()})
    sums = at.groupBy(*keys, bucket).agg(*[F.sum(f"_v_{n}").alias(f"_b_{n}") for n in values])
    w = Window.partitionBy(*keys).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, bucket, *[F.coalesce(F.sum(f"_b_{n}").over(w), F.lit(0)).alias(f"_b_{n}") for n in values])
    w = Window.partitionBy(*keys, bucket).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    out = at.withColumns({f"_w_{n}": F.coalesce(F.sum(f"_v_{n}").over(w), F.lit(0)) for n in values}).join(sums, [*keys, bucket])
    return out.withColumns({n: F.col(f"_w_{n}") + F.col(f"_b_{n}") for n in values}).drop(*[f"_{x}_{n}" for x in "vbw" for n in values])


def asof_deviation(df: DataFrame, entity: str, cell: str, order: Sequence[str], label: Column, prior: float = 0.5, k_entity: float = 50.0, k_cell: float = 50.0) -> DataFrame:
    """Row-level: the entity's shrunk rate before the row (base), and its rate in the row's cell shrunk towards base (dev is the difference)."""
    one, y = F.lit(1), label.cast("double")
    out = asof_sums(df, [entity], order, {"n_entity": one, "s_entity": y})
    out = asof_sums(out, [entity, cell], order, {"n_cell": one, "s_cell": y})
    out = out.withColumn("base", shrunk(F.col("s_entity"), F.col("n_entity"), prior, k_entity))
    return out.withColumn("dev", shrunk(F.col("s_cell"), F.col("n_cell"), F.col("base"), k_cell) - F.col("base"))


def backoff_rate(df: DataFrame, first: Sequence[str], second: Sequence[str], period: str, label: Column, alpha: float = 100.0, least: int = 1) -> DataFrame:
    """(first, second, period, rate, level): the prior-period rate of the full key, else of the first key, else of all rows,
    each shrunk towards the mean of all rows before the period; level 2, 1 or 0. Without any history: null, level 0."""
    sums = period_sums(df, [*first, *second], period, label)
    full = prior_sums(sums, [*first, *second], period)
    upper = prior_sums(sums.groupBy(*first, period).agg(F.sum("n").alias("n"), F.sum("s").alias("s")), first, period).select(*first, period, F.col("n_prior").alias("_n1"), F.col("s_prior").alias("_s1"))
    means = prior_table(sums, [], period)
    out = full.join(upper, [*first, period]).join(F.broadcast(means), period, "left")
    two, one = F.col("n_prior") >= least, F.col("_n1") >= least
    rate = F.when(two, shrunk(F.col("s_prior"), F.col("n_prior"), F.col("prior"), alpha)).when(one, shrunk(F.col("_s1"), F.col("_n1"), F.col("prior"), alpha)).otherwise(F.col("prior"))
    return out.select(*first, *second, period, rate.alias("rate"), F.when(two, 2).when(one, 1).otherwise(0).alias("level"))


def hier_shrunk_dev(df: DataFrame, entity: str, cell: str, label: Column, k_entity: float = 300.0, k_cell: float = 300.0) -> DataFrame:
    """(entity, cell, n, base, dev): entity rate shrunk to the global mean, cell rate shrunk to the entity's."""
    cells = df.groupBy(entity, cell).agg(F.count(F.lit(1)).alias("n"), F.sum(label.cast("double")).alias("s"))
    w = Window.partitionBy(entity)
    total = cells.agg((F.sum("s") / F.sum("n")).alias("mean"))
    out = cells.crossJoin(F.broadcast(total))
    base = shrunk(F.sum("s").over(w), F.sum("n").over(w), F.col("mean"), k_entity)
    out = out.withColumn("base", base)
    return out.select(entity, cell, "n", "base", (shrunk(F.col("s"), F.col("n"), F.col("base"), k_cell) - F.col("base")).alias("dev"))


def league_deviation(df: DataFrame, entity: str, cell: str, league: str, period: str, label: Column, alpha: float = 300.0, frozen_prior: bool = False) -> DataFrame:
    """(entity, cell, league, period, dev): an entity's prior-period rate in a cell, less its prior-period overall rate, each shrunk
    towards the league's. League means are of earlier periods too (first period: neutral 0) unless frozen_prior takes all periods."""
    sums = period_sums(df, [entity, cell, league], period, label)
    by_cell = prior_sums(sums, [entity, cell, league], period).select(entity, cell, league, period, F.col("n_prior").alias("n_c"), F.col("s_prior").alias("s_c"))
    whole = sums.groupBy(entity, league, period).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    by_entity = prior_sums(whole, [entity, league], period).select(entity, league, period, F.col("n_prior").alias("n_e"), F.col("s_prior").alias("s_e"))
    out = by_cell.join(by_entity, [entity, league, period])
    for by, name in (([league, cell], "p_c"), ([league], "p_e")):
        if frozen_prior:
            out = out.join(sums.groupBy(*by).agg((F.sum("s") / F.sum("n")).alias(name)), by)
        else:
            out = out.join(prior_table(sums, by, period, by).withColumnRenamed("prior", name), [*by, period], "left")
    dev = shrunk(F.col("s_c"), F.col("n_c"), F.col("p_c"), alpha) - shrunk(F.col("s_e"), F.col("n_e"), F.col("p_e"), alpha)
    return out.select(entity, cell, league, period, "n_c", F.coalesce(dev - (F.col("p_c") - F.col("p_e")), F.lit(0.0)).alias("dev"))


def long_form_priors(df: DataFrame, entity: str, cell: str, league: str, period: str, label: Column, alpha: float = 100.0) -> DataFrame:
    """Cumulative state before the period at four levels (entity and cell, entity, league and cell, league), joined on (.., period);
    rate is the chain of shrinkages league < league and cell < entity and cell."""
    sums = period_sums(df, [entity, cell, league], period, label)
    levels = {"ec": [entity, cell, league], "e": [entity, league], "lc": [league, cell], "l": [league]}
    out = sums.select(entity, cell, league, period)
    for name, keys in levels.items():
        s = sums.groupBy(*keys, period).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        out = out.join(prior_sums(s, keys, period).select(*keys, period, F.col("n_prior").alias(f"n_{name}"), F.col("s_prior").alias(f"s_{name}")), [*keys, period])
    c = F.col
    p_l = shrunk(c("s_l"), c("n_l"), 0.5, alpha)
    p_lc = shrunk(c("s_lc"), c("n_lc"), p_l, alpha)
    return out.withColumns({"rate": shrunk(c("s_ec"), c("n_ec"), p_lc, alpha), "base": shrunk(c("s_e"), c("n_e"), p_l, alpha)})


def recovered_counts(rate: str, n: str) -> Column:
    """Whole counts from a cumulative rate and its number of rows; halves go to even, a null rate counts as 0."""
    return half_even(F.coalesce(F.col(rate), F.lit(0.0)) * F.col(n)).cast("bigint")


def in_period_counts(df: DataFrame, entity: str, period: str, order: Sequence[str], n: str, s: str) -> DataFrame:
    """Adds n_in and s_in: cumulative counts less those at the first row of the (entity, period), not below zero."""
    w = Window.partitionBy(entity, period).orderBy(*order)
    base = lambda c: F.first(c).over(w)
    return df.withColumns({"n_in": F.greatest(F.col(n) - base(n), F.lit(0)), "s_in": F.greatest(F.col(s) - base(s), F.lit(0))})


def cell_effects(df: DataFrame, cell: str, x: str, y: str, low: float | None = None, high: float | None = None) -> DataFrame:
    """(cell, n, effect, slope): mean label less the global mean, and the slope of y on x (population moments; 1 without spread),
    clipped if bounds are given."""
    g = df.agg(F.avg(y).alias("_g"))
    slope = F.coalesce(F.when(F.var_pop(x) > 0, F.regr_slope(y, x)), F.lit(1.0))
    out = df.groupBy(cell).agg(F.count(F.lit(1)).alias("n"), F.avg(y).alias("_m"), slope.alias("slope"))
    return out.crossJoin(F.broadcast(g)).select(cell, "n", (F.col("_m") - F.col("_g")).alias("effect"), clip("slope", low, high).alias("slope"))


def adjusted_skill(df: DataFrame, effects: DataFrame, cell: str, x: str, mean: Column | float) -> DataFrame:
    """Adds adjusted: mean + effect + slope * (x - mean) by the row's cell (unknown cells: effect 0, slope 1)."""
    out = df.join(effects.select(cell, "effect", "slope"), cell, "left")
    m = F.lit(mean) if not isinstance(mean, Column) else mean
    return out.withColumn("adjusted", m + F.coalesce("effect", F.lit(0.0)) + F.coalesce("slope", F.lit(1.0)) * (F.col(x) - m)).drop("effect", "slope")


def asof_cell_slope(df: DataFrame, cell: str, bucket: str, order: Sequence[str], x: str, y: str, k: float = 100.0) -> DataFrame:
    """Row-level slope of y on x and mean label in the row's cell from moments of earlier rows, shrunk towards 1 and 0 by n / (n + k).
    A few cells hold all rows, so the running sums are taken by bucket."""
    v = {"_n": F.lit(1.0), "_x": F.col(x), "_y": F.col(y), "_xy": F.col(x) * F.col(y), "_xx": F.col(x) * F.col(x)}
    out = asof_sums_in_buckets(df, [cell], bucket, order, v)
    n = F.col("_n")
    var = F.col("_xx") / n - (F.col("_x") / n) ** 2
    slope = F.when((n >= 2) & (var > 1e-12), (F.col("_xy") / n - F.col("_x") * F.col("_y") / (n * n)) / var).otherwise(1.0)
    w = n / (n + k)
    return out.withColumn("slope", 1 + w * (slope - 1)).withColumn("mean", F.when(n > 0, w * F.col("_y") / n).otherwise(0.0)).drop("_x", "_y", "_xy", "_xx").withColumnRenamed("_n", "n_before")


def shrinkage_strength(df: DataFrame, entity: str, cell: str, label: Column) -> DataFrame:
    """(cell, entities, p, strength): p (1 - p) / (variance of entity rates - mean binomial noise); null if noise explains all."""
    g = df.groupBy(cell, entity).agg(F.count(F.lit(1)).alias("n"), F.avg(label.cast("double")).alias("r"))
    m = g.groupBy(cell).agg(F.count(F.lit(1)).alias("entities"), (F.sum(F.col("r") * F.col("n")) / F.sum("n")).alias("p"), F.var_pop("r").alias("_v"), F.avg(1 / F.col("n")).alias("_i"))
    true = F.col("_v") - F.col("p") * (1 - F.col("p")) * F.col("_i")
    return m.select(cell, "entities", "p", F.when(true > 1e-12, F.col("p") * (1 - F.col("p")) / true).alias("strength"))


def between_entity_variance(df: DataFrame, entity: str, period: str, label: Column, least: int = 20) -> DataFrame:
    """(period, entities, observed, noise, true): variance of entity rates by period less binomial noise, not below 0."""
    g = df.groupBy(period, entity).agg(F.count(F.lit(1)).alias("n"), F.avg(label.cast("double")).alias("r")).where(F.col("n") >= least)
    out = g.groupBy(period).agg(F.count(F.lit(1)).alias("entities"), F.var_pop("r").alias("observed"), F.avg(F.col("r") * (1 - F.col("r")) / F.col("n")).alias("noise"))
    return out.withColumn("true_variance", F.greatest(F.col("observed") - F.col("noise"), F.lit(0.0)))


def weighted_prior_mean(df: DataFrame, keys: Sequence[str], period: str, x: str, weight: str) -> DataFrame:
    """(keys, period, mean_prior, weight_prior): the weighted mean of x over earlier periods; weights count where x is not null."""
    w = F.when(F.col(x).isNotNull(), F.col(weight))
    sums = df.groupBy(*keys, period).agg(F.sum(F.col(x) * F.col(weight)).alias("_xw"), F.coalesce(F.sum(w), F.lit(0)).alias("_w"))
    out = prior_sums(sums, keys, period, ["_xw", "_w"])
    return out.select(*keys, period, F.when(F.col("_w_prior") > 0, F.col("_xw_prior") / F.col("_w_prior")).alias("mean_prior"), F.col("_w_prior").alias("weight_prior"))


def projection(sums: DataFrame, keys: Sequence[str], period: str, value: str, weights: Sequence[float] = (5, 4, 3)) -> DataFrame:
    """(keys, period, projected, z): weighted mean of the last periods (newest first, absent ones left out), z-normalised by period."""
    w = Window.partitionBy(*keys).orderBy(period)
    parts = [F.sum(value).over(w.rangeBetween(-i, -i)) for i in range(1, len(weights) + 1)]
    total = sum(F.coalesce(p * k, F.lit(0.0)) for p, k in zip(parts, weights))
    weight = sum(F.when(p.isNotNull(), k).otherwise(0) for p, k in zip(parts, weights))
    out = sums.withColumn("projected", F.when(weight > 0, total / weight))
    out = out.join(out.groupBy(period).agg(F.avg("projected").alias("_mean"), F.stddev_pop("projected").alias("_sd")), period)
    return out.select(*keys, period, "projected", F.when(F.col("_sd") > 0, (F.col("projected") - F.col("_mean")) / F.col("_sd")).otherwise(0.0).alias("z"))


def measure_deviations(df: DataFrame, entity: str, cell: str, measures: Sequence[str], strength: float) -> DataFrame:
    """(entity, cell, n, measures): each measure's mean in a cell less the entity's own mean, times n / (n + strength). Rows without entity or
    cell are left out; both levels come from one aggregate over the rows."""
    d = df.dropna(subset=[entity, cell]).groupBy(entity, cell).agg(F.count(F.lit(1)).alias("n"), *[a for m in measures for a in (F.sum(m).alias(f"_s_{m}"), F.count(m).alias(f"_n_{m}"))])
    own = d.groupBy(entity).agg(*[(F.sum(f"_s_{m}") / F.sum(f"_n_{m}")).alias(f"_o_{m}") for m in measures])
    return d.join(own, entity).select(entity, cell, "n", *[((F.col(f"_s_{m}") / F.col(f"_n_{m}") - F.col(f"_o_{m}")) * F.col("n") / (F.col("n") + strength)).alias(m) for m in measures])


def decay_weight(period: str, base: int, d: float, regime: Column | None = None, down: float = 1.0) -> Column:
    """d ** (period - base), times `down` in a regime that no longer holds."""
    w = F.pow(F.lit(d), F.col(period) - base)
    return w if regime is None else w * F.when(regime, down).otherwise(1.0)


def modulation(df: DataFrame, entity: str, period: str, value: str, condition: Column, least: int = 30) -> DataFrame:
    """(entity, period, mod): mean of value under a condition less its mean overall, over earlier periods; 0 under `least` rows of either."""
    sums = df.groupBy(entity, period).agg(
        F.count(F.lit(1)).alias("n"), F.sum(value).alias("v"), F.count(F.when(condition, 1)).alias("nc"), F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0.0)).alias("vc")
    )
    out = prior_sums(sums, [entity], period, ["n", "v", "nc", "vc"])
    enough = (F.col("nc_prior") >= least) & (F.col("n_prior") >= least)
    return out.select(entity, period, "n_prior", "nc_prior", F.when(enough, F.col("vc_prior") / F.col("nc_prior") - F.col("v_prior") / F.col("n_prior")).otherwise(0.0).alias("mod"))


def label_axis_grid(df: DataFrame, labels: dict[str, Column], axes: Sequence[str], k: float = 300.0) -> DataFrame:
    """(label, axis, cell, n, dev) for every label and axis in one pass: deviations from the label's mean, shrunk by n / (n + k)."""
    sums = {name: F.sum(y.cast("double")).alias(f"_{name}") for name, y in labels.items()}
    cells = df.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("cell")) for a in axes])).alias("_a")).groupBy("_a.axis", "_a.cell").agg(F.count(F.lit(1)).alias("n"), *sums.values())
    long = cells.select("axis", "cell", "n", F.explode(F.array(*[F.struct(F.lit(x).alias("label"), F.col(f"_{x}").alias("s")) for x in labels])).alias("_l")).select("axis", "cell", "n", "_l.label", "_l.s")
    w = Window.partitionBy("label", "axis")
    mean = F.sum("s").over(w) / F.sum("n").over(w)
    return long.select("label", "axis", "cell", "n", (F.col("n") / (F.col("n") + k) * (F.col("s") / F.col("n") - mean)).alias("dev"))


def latest_state(df: DataFrame, entity: str, order: Sequence[str], values: Sequence[str], least: int = 10, n: str | None = None) -> DataFrame:
    """(entity, values): each entity's values at its last row, left out where its count n is under `least`."""
    out = df.groupBy(entity).agg(*[F.max_by(v, F.struct(*order)).alias(v) for v in values], *([F.max_by(n, F.struct(*order)).alias(n)] if n else []))
    return out.where(F.col(n) >= least) if n else out


def regime_indicators(segment: Column, period: str, change: int, name: str = "regime") -> dict[str, Column]:
    """Columns for a segment whose level breaks at a period: in the segment before it, in it from then on, and elsewhere."""
    after = F.col(period) >= change
    return {f"{name}_before": (segment & ~after).cast("int"), f"{name}_after": (segment & after).cast("int"), f"{name}_other": (~segment).cast("int")}


def rate_per_month(n: Column, month: Column, first_month: int) -> Column:
    """n per month of the period that has passed, this one included."""
    return n / F.greatest(month - first_month + 1, F.lit(1))


def scoring_counts(rows: DataFrame, totals: DataFrame, entity: str, n: str, s: str) -> DataFrame:
    """Adds n_in and s_in to scored rows: cumulative counts less the entity's frozen totals (entity, n, s), not below zero; new entities have base 0."""
    base = totals.select(entity, F.col(n).alias("_n"), F.col(s).alias("_s"))
    out = rows.join(base, entity, "left")
    less = lambda c, b: F.greatest(F.col(c) - F.coalesce(b, F.lit(0)), F.lit(0))
    return out.withColumns({"n_in": less(n, "_n"), "s_in": less(s, "_s")}).drop("_n", "_s")


def linked_triple(sensor: DataFrame, link: DataFrame, sensor_id: str, wanted: DataFrame, entity: str, cell: str, period: str, label: Column | str, alpha: float = 100.0, default: float = 0.5) -> DataFrame:
    """(entity, cell, period, rate, dev, conf) for each distinct (entity, cell, period) of `wanted`, from the periods before of another table.

    sensor: (sensor_id, cell, period, label); link: (sensor_id, entity), a sensor id once. The rate in the cell is drawn towards the cell's mean,
    dev is against the entity's own rate, drawn towards the mean of all linked rows; both means are those of the periods before,
    `default` where there are none. Rows without a link are left out."""
    own = period_sums(sensor.join(link.select(sensor_id, entity).dropna(), sensor_id), [entity, cell], period, label)
    want = wanted.select(entity, cell, period).dropna().distinct()
    zero = [F.lit(0).cast("long").alias("n"), F.lit(0.0).alias("s")]

    def before(keys: list[str]) -> DataFrame:
        """Sums over earlier periods for all periods that are wanted or known."""
        both = own.select(*keys, period, "n", "s").unionByName(want.select(*keys, period, *zero)).groupBy(*keys, period).agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        return prior_sums(both, keys or [F.lit(1)], period).select(*keys, period, "n_prior", "s_prior")

    def mean(keys: list[str], name: str) -> DataFrame:
        return before(keys).select(*keys, period, F.when(F.col("n_prior") > 0, F.col("s_prior") / F.col("n_prior")).alias(name))

    mine = before([entity]).withColumnsRenamed({"n_prior": "_n", "s_prior": "_s"})
    state = want.join(before([entity, cell]), [entity, cell, period]).join(mine, [entity, period]).join(mean([cell], "_cell"), [cell, period]).join(mean([], "_all"), period)
    overall = F.coalesce("_all", F.lit(default))
    state = state.withColumn("_base", shrunk(F.col("_s"), F.col("_n"), overall, alpha))
    return encode_triple(state, "n_prior", "s_prior", F.coalesce("_cell", overall), F.col("_base"), alpha).select(entity, cell, period, "rate", "dev", "conf")
