"""Temperature and intercept of logits by Newton's method on the Brier score.

The few numbers that are fitted live on the driver; each step is one aggregate over the rows, whose tasks send a row of sums for each
group and scale. A scale multiplies the logit (it is one over a temperature)."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import col, logit, sigmoid

#: Groups that may be fitted side by side; more raise, as their state lives on the driver.
GROUPS = 10_000
#: Largest logit that is told apart, and cells of a block of rows by scales.
EDGE, CELLS = 30.0, 1 << 18


def _rows(df: DataFrame, p, y, by: str | None) -> DataFrame:
    group = F.col(by).cast("string") if by else F.lit("")
    return df.select(group.alias("g"), logit(p).alias("z"), col(y).cast("double").alias("y")).where("z is not null and y is not null and g is not null")


def _sums(rows: DataFrame, state: dict[str, np.ndarray], start: np.ndarray) -> dict[str, np.ndarray]:
    """For each group and point (scale, intercept) of its state: n, label sum, squared error, its gradient by scale and intercept, its second
    derivatives by scale, both and intercept. Groups that the state lacks stand at `start`."""

    def partial(it):
        total: dict[str, np.ndarray] = {}
        for batch in it:
            names = batch.column("g").dictionary_encode()
            z, y, code = batch.column("z").to_numpy(), batch.column("y").to_numpy(), names.indices.to_numpy()
            for i, name in enumerate(names.dictionary.to_pylist()):
                at = state.get(name, start)
                t = total.setdefault(name, np.zeros((len(at), 8)))
                some = np.flatnonzero(code == i)
                for a in range(0, len(some), step := max(1, CELLS // len(at))):
                    zz, yy = z[some[a : a + step], None], y[some[a : a + step], None]
                    q = 1 / (1 + np.exp(-np.clip(zz * at[:, 0] + at[:, 1], -EDGE, EDGE)))
                    e, d = q - yy, q * (1 - q)
                    slope, curve = 2 * e * d, 2 * (d * d + e * d * (1 - 2 * q))
                    t += np.stack([np.full(len(at), len(zz)), np.full(len(at), yy.sum()), *[x.sum(axis=0) for x in (e * e, slope * zz, slope, curve * zz * zz, curve * zz, curve)]], 1)
        for name, t in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(t)), pa.array(range(len(t)), pa.int32()), *[pa.array(t[:, j]) for j in range(8)]], ["g", "i", *[f"s{j}" for j in range(8)]])

    schema = "g string, i int, " + ", ".join(f"s{j} double" for j in range(8))
    merged = rows.mapInArrow(partial, schema).groupBy("g", "i").agg(*[F.sum(f"s{j}").alias(f"s{j}") for j in range(8)])
    got = merged.limit(GROUPS * len(start) + 1).collect()
    if len(got) > GROUPS * len(start):
        raise ValueError(f"more than {GROUPS} groups")
    out: dict[str, np.ndarray] = {}
    for r in sorted(got, key=lambda r: (r["g"], r["i"])):
        out.setdefault(r["g"], np.zeros((len(start), 8)))[r["i"]] = r[2:]
    return out


def _table(df: DataFrame, by: str | None, rows: list[tuple]) -> DataFrame:
    """rows: group, scale, intercept, n, label sum, squared error."""
    kind = next((f.dataType.simpleString() for f in df.schema.fields if f.name == by), "string")
    out = df.sparkSession.createDataFrame(rows, "g string, scale double, intercept double, n double, s double, e double")
    rate = F.col("s") / F.col("n")
    skill = 100000 * (1 - F.col("e") / F.col("n") / F.nullif(rate * (1 - rate), F.lit(0.0)))
    found = out.select(*([F.col("g").cast(kind).alias(by)] if by else []), "scale", "intercept", F.col("n").cast("long").alias("n"), (F.col("e") / F.col("n")).alias("brier"), skill.alias("skill"))
    return found


def fit_intercepts(df: DataFrame, p, y, scales: Sequence[float], by: str | None = None, passes: int = 10, step: float = 0.1, tolerance: float = 1e-9) -> DataFrame:
    """(by, scale, intercept, n, brier, skill): for each scale the intercept that a Newton search from 0 finds for the Brier score of
    sigmoid(scale * logit + intercept). Each of at most `passes` steps is clipped to `step`; one where the curvature is under 1e-10 ends that
    search, and all end when no step exceeds `tolerance`. Rows without p, y or group are left out; no rows give none."""
    rows, start = _rows(df, p, y, by), np.array([[float(s), 0.0] for s in scales])
    state: dict[str, np.ndarray] = {}
    for i in range(passes + 1):
        sums, largest = _sums(rows, state, start), 0.0
        state = {g: state.get(g, start) for g in sums}
        if i == passes:
            break
        new = {}
        for g, t in sums.items():
            slope, curve = t[:, 4] / t[:, 0], t[:, 7] / t[:, 0]
            move = np.where(np.abs(curve) < 1e-10, 0.0, np.clip(slope / np.where(np.abs(curve) < 1e-10, 1.0, curve), -step, step))
            new[g] = state[g] - np.stack([np.zeros(len(move)), move], 1)
            largest = max(largest, np.abs(move).max())
        if largest <= tolerance:
            break  # the sums are those of the state
        state = new
    return _table(df, by, [(g, *map(float, state[g][i]), *map(float, t[i, :3])) for g, t in sums.items() for i in range(len(start))])


def best_temperature(df: DataFrame, p, y, scales: Sequence[float], by: str | None = None, **how) -> DataFrame:
    """The row of fit_intercepts with the least Brier score (rounded to 12 places), of equals the smallest scale; one for each group."""
    found = fit_intercepts(df, p, y, scales, by, **how)
    names = [c for c in found.columns if c != by]
    best = F.min_by(F.struct(*names), F.struct(F.round("brier", 12), "scale")).alias("_m")
    out = found.groupBy(by).agg(best) if by else found.agg(best).where("_m is not null")
    return out.select(*([by] if by else []), *[f"_m.{c}" for c in names])


def fit_temperature(df: DataFrame, p, y, by: str | None = None, passes: int = 10, step: float = 0.5, tolerance: float = 1e-8) -> DataFrame:
    """(by, scale, intercept, n, brier, skill): the scale and intercept of the least Brier score, by Newton's method in both from (1, 0).

    Where the second derivatives are no minimum's, they are shifted until they are; steps are clipped to `step`; one that raises the score is
    halved. All groups take their steps in the same passes. After `passes` the best point seen is returned."""
    rows, start = _rows(df, p, y, by), np.array([[1.0, 0.0]])
    state: dict[str, np.ndarray] = {}
    best: dict[str, tuple[np.ndarray, np.ndarray]] = {}
    ended: set[str] = set()
    for _ in range(passes):
        sums = _sums(rows, state, start)
        for g, (t, *_) in sums.items():
            if g in ended:
                continue
            at = state.get(g, start)
            if g in best and t[2] > best[g][1][2] * (1 + 1e-14):
                move = (at - best[g][0]) / 2
                at = best[g][0]
            else:
                best[g] = at, t
                h = np.array([[t[5], t[6]], [t[6], t[7]]]) / t[0]
                low = np.linalg.eigvalsh(h)[0]
                if low < 1e-10:
                    h += np.eye(2) * (1e-6 - low)
                move = -np.clip(np.linalg.solve(h, t[3:5] / t[0]), -step, step)[None, :]
            state[g] = at + move
            if np.abs(move).max() <= tolerance:
                ended.add(g)
        if len(ended) == len(sums):
            break
    return _table(df, by, [(g, *map(float, v[0]), *map(float, t[:3])) for g, (v, t) in best.items()])


def residuals_after_shift(df: DataFrame, p: str, y: str, axes: Sequence[str], least: int = 1) -> DataFrame:
    """(axis, cell, n, residual): mean label less mean prediction in each cell of the axes, after the one shift of all logits that gives the least
    Brier score. Cells under `least` rows are left out; no rows give none."""
    shift = fit_intercepts(df, p, y, [1.0]).first()
    moved = F.lit(None).cast("double") if shift is None else sigmoid(logit(p) + shift["intercept"])
    cells = F.inline(F.array(*[F.struct(F.lit(a).alias("axis"), F.col(a).cast("string").alias("cell")) for a in axes]))
    d = df.where(F.col(p).isNotNull() & F.col(y).isNotNull()).select((col(y) - moved).alias("_r"), cells)
    return d.groupBy("axis", "cell").agg(F.count(F.lit(1)).alias("n"), F.avg("_r").alias("residual")).where(F.col("n") >= least)
