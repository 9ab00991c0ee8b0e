"""Scores of many variants from one pass: every combination of seeds, and bootstrap rounds of several candidates."""

from __future__ import annotations

import itertools
import math
from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import col

#: Seed combinations that are scored on the driver; more raise.
COMBINATIONS = 1_000_000
MASK = 0xFFFFFFFF
#: Weights of 0, 1, 2, .. have the Poisson chances: the weight is how many of these bounds a 32-bit number reaches.
POISSON = [math.floor(sum(math.exp(-1) / math.factorial(j) for j in range(i + 1)) * 2**32) for i in range(11)]


def moments(df: DataFrame, columns: Sequence[str], by: str | Column) -> dict:
    """For each value of `by` (a few) the matrix of sums of products of a constant and the columns, from one aggregate."""
    c = [F.lit(1.0), *[F.col(x).cast("double") for x in columns]]
    at = [(i, j) for i in range(len(c)) for j in range(i, len(c))]
    out = {}
    for row in df.dropna(subset=list(columns)).groupBy(col(by).alias("_by")).agg(*[F.sum(c[i] * c[j]).alias(f"_{i}_{j}") for i, j in at]).collect():
        out[row[0]] = m = np.zeros((len(c), len(c)))
        for (i, j), v in zip(at, row[1:]):
            m[i, j] = m[j, i] = v
    return out


def seed_combinations(df: DataFrame, branches: Mapping[str, Mapping[str, str]], routes: Mapping, route: str | Column, y: str, sizes: Mapping[str, int]) -> DataFrame:
    """(combination, brier, skill): the score of every choice of sizes[branch] seeds of each branch. A route's prediction is the sum of its
    branches' weights times the mean of their chosen seeds.

    branches: branch to seed to column; routes: value of `route` to branch to weight. A squared error is a quadratic form in the seeds'
    products summed over a route's rows, so one aggregate gives all scores. Rows without a listed route, or with a null, are left out."""
    names = sorted(branches)
    for b in names:
        if not 0 < sizes[b] <= len(branches[b]):
            raise ValueError(f"{b} has {len(branches[b])} seeds")
    count = math.prod(math.comb(len(branches[b]), sizes[b]) for b in names)
    if count > COMBINATIONS:
        raise ValueError(f"{count} combinations")
    members = [(b, s) for b in names for s in sorted(branches[b])]
    m = {k: v for k, v in moments(df, [*[branches[b][s] for b, s in members], y], route).items() if k in routes}
    chosen = [dict(zip(names, c)) for c in itertools.product(*[list(itertools.combinations(sorted(branches[b]), sizes[b])) for b in names])]
    part = np.array([[1.0 / sizes[b] if s in c[b] else 0.0 for b, s in members] for c in chosen]).reshape(len(chosen), len(members))
    error, n, s = np.zeros(len(chosen)), 0.0, 0.0
    for k, g in m.items():
        v = np.concatenate([np.zeros((len(chosen), 1)), part * [routes[k].get(b, 0.0) for b, _ in members], np.full((len(chosen), 1), -1.0)], 1)
        error += np.einsum("ci,ij,cj->c", v, g, v)
        n, s = n + g[0, 0], s + g[0, -1]
    spread = s / n * (1 - s / n) if n else 0.0
    rows = [(" ".join(f"{b}:{'+'.join(c[b])}" for b in names), float(e / n), float(100000 * (1 - e / n / spread)) if spread else None) for c, e in zip(chosen, error)] if n else []
    return df.sparkSession.createDataFrame(rows, "combination string, brier double, skill double")


def seed_extrapolation(df: DataFrame, seeds: Sequence[str], y: str, counts: Sequence[int]) -> DataFrame:
    """(seeds, skill, per_seed, variance): the skill that the mean of so many seeds is expected to have (0: without end). The seeds differ by
    noise whose variance is half that of two seeds' difference; a mean of k loses per_seed / k of the skill without noise, which
    is that of the mean of the given seeds plus what they lose. Two seeds at least; rows with a null are left out."""
    g = moments(df, [*seeds, y], F.lit(0)).get(0)
    if g is None or len(seeds) < 2:
        raise ValueError("two seeds and a row at least")
    n, k = g[0, 0], len(seeds)
    pairs = [(i, j) for i in range(1, k + 1) for j in range(i + 1, k + 1)]
    noise = float(np.mean([(g[i, i] - 2 * g[i, j] + g[j, j]) / n - ((g[0, i] - g[0, j]) / n) ** 2 for i, j in pairs])) / 2
    v = np.array([0.0, *[1 / k] * k, -1.0])
    rate = g[0, -1] / n
    per_seed = 100000 * noise / (rate * (1 - rate))
    top = 100000 * (1 - v @ g @ v / n / (rate * (1 - rate))) + per_seed / k
    rows = [(int(c), float(top - (per_seed / c if c else 0.0)), float(per_seed), noise) for c in counts]
    return df.sparkSession.createDataFrame(rows, "seeds int, skill double, per_seed double, variance double")


def bootstrap_weights(first: np.ndarray, second: np.ndarray, i: int) -> np.ndarray:
    """Poisson weights of rows in round i from two 32-bit numbers of their keys."""
    mask, factor = np.uint64(MASK), np.uint64(0x45D9F3B)
    x = (first + np.uint64(i) * (np.uint64(2) * second + np.uint64(1))) & mask
    for _ in range(2):
        x = ((x ^ (x >> np.uint64(16))) * factor) & mask
    return np.searchsorted(np.array(POISSON, np.uint64), x ^ (x >> np.uint64(16)), side="right")


def bootstrap_sums(df: DataFrame, key: str, y: str, candidates: Mapping[str, str | Column], rounds: int) -> DataFrame:
    """(round, w, s, e0, e1, ..): for each round the rows' weights, weighted labels and weighted squared errors of each candidate. Sums of two
    tables add up to those of their rows together. A row's weights follow from its key alone. Rows with a null are left out."""
    number = lambda at: F.conv(F.substring(F.md5(F.col(key).cast("string")), at, 8), 16, 10).cast("long")
    k = len(candidates)
    d = df.select(number(1).alias("h1"), number(9).alias("h2"), col(y).cast("double").alias("y"), *[F.pow(col(c).cast("double") - col(y), F.lit(2)).alias(f"e{i}") for i, c in enumerate(candidates.values())]).dropna()

    def partial(it):
        total = np.zeros((rounds, k + 2))
        for batch in it:
            h1, h2 = (batch.column(c).to_numpy().astype(np.uint64) for c in ("h1", "h2"))
            values = np.stack([np.ones(batch.num_rows), *[batch.column(i).to_numpy() for i in range(2, k + 3)]], 1)
            for i in range(rounds):
                total[i] += bootstrap_weights(h1, h2, i) @ values
        yield pa.RecordBatch.from_arrays([pa.array(range(rounds), pa.int32()), *[pa.array(total[:, j]) for j in range(k + 2)]], ["round", "w", "s", *[f"e{i}" for i in range(k)]])

    names = ["w", "s", *[f"e{i}" for i in range(k)]]
    return d.mapInArrow(partial, "round int, " + ", ".join(f"{c} double" for c in names)).groupBy("round").agg(*[F.sum(c).alias(c) for c in names])


def bootstrap_skill(df: DataFrame, key: str, y: str, candidates: Mapping[str, str | Column], rounds: int = 1000, low: float = 0.025, high: float = 0.975) -> DataFrame:
    """(candidate, skill_low, skill_mean, skill_high, wins, diff_low, diff_mean, diff_high, first_ahead): for each candidate the percentile interval
    and mean of its skill over the rounds, the rounds that it wins (of equals the first listed), and the same of the first candidate's skill less
    its own, with the rounds where that is positive. Skills are compared at 6 places. Rounds in which all labels are equal have no skill and are left out."""
    sums = bootstrap_sums(df, key, y, candidates, rounds)
    rate = F.col("s") / F.col("w")
    scores = F.array(*[F.round(100000 * (1 - F.col(f"e{i}") / F.col("w") / (rate * (1 - rate))), 6) for i in range(len(candidates))])
    each = sums.where("w > 0 and s > 0 and s < w").select(scores.alias("_s")).withColumn("_best", F.array_position("_s", F.array_max("_s")))
    names = F.array(*[F.lit(c) for c in candidates])
    rows = each.select("_best", F.col("_s")[0].alias("_first"), F.posexplode("_s").alias("_i", "_score")).withColumn("_d", F.col("_first") - F.col("_score"))
    at = lambda c, q: F.percentile(c, F.lit(q))
    g = rows.groupBy("_i").agg(
        at("_score", low).alias("skill_low"), F.avg("_score").alias("skill_mean"), at("_score", high).alias("skill_high"), F.count_if(F.col("_best") == F.col("_i") + 1).alias("wins"),
        at("_d", low).alias("diff_low"), F.avg("_d").alias("diff_mean"), at("_d", high).alias("diff_high"), F.count_if(F.col("_d") > 0).alias("first_ahead"),
    )
    return g.select(names[F.col("_i")].alias("candidate"), *g.columns[1:])
