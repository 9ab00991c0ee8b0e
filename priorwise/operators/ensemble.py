"""Row-wise ensembles and correction chains over frozen tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import col, logit, row_max, row_mean, row_median, row_spread, row_trimmed_mean, sigmoid


def route(segment: Column, all_rows: str, branch: str, w: float = 0.6) -> Column:
    """w of the model of all rows and the rest of the segment's own model where the segment has one."""
    return F.when(segment, w * F.col(all_rows) + (1 - w) * F.col(branch)).otherwise(F.col(all_rows))


def warm_mix(df: DataFrame, warm: DataFrame, entity: str, warm_weights: dict[str, float], cold_weights: dict[str, float], name: str) -> DataFrame:
    """Adds is_warm and a weighted mean of members, with other weights for entities without history."""
    out = df.join(warm.select(entity).distinct().withColumn("is_warm", F.lit(True)), entity, "left").withColumn("is_warm", F.coalesce("is_warm", F.lit(False)))
    mix = lambda w: sum(F.col(c) * v for c, v in w.items())
    return out.withColumn(name, F.when(F.col("is_warm"), mix(warm_weights)).otherwise(mix(cold_weights)))


def add_corrections(df: DataFrame, p: str, corrections: Sequence[tuple[DataFrame, Sequence[str], str, float]]) -> DataFrame:
    """p moved by weight * value on the logit scale for each frozen table (table, keys, value, weight); unknown keys move nothing."""
    z = logit(p)
    for i, (t, keys, value, weight) in enumerate(corrections):
        df = df.join(t.select(*keys, F.col(value).alias(f"_c{i}")), list(keys), "left")
        z = z + weight * F.coalesce(f"_c{i}", F.lit(0.0))
    return df.withColumn(p, sigmoid(z)).drop(*[f"_c{i}" for i in range(len(corrections))])


def sharpen(p: str, members: Sequence[str], strength: float, spread: float) -> Column:
    """p away from one half on the logit scale where the members agree: by strength * (1 - spread found / spread), not below none."""
    found = row_spread(members, row_median(members))
    return sigmoid(logit(p) * (1 + strength * F.greatest(1 - found / spread, F.lit(0.0))))


def temper(p: str | Column, temperature: float = 1.0, shift: float = 0.0) -> Column:
    return sigmoid(logit(p) / temperature + shift)


def level(p: str, target: float, mean: float) -> Column:
    """p moved on the logit scale from a frozen mean level to a target."""
    return sigmoid(logit(p) + logit(F.lit(target)) - logit(F.lit(mean)))


def aggregated(members: Sequence[str]) -> dict[str, Column]:
    """mean, mean_logit (as a probability), median, trimmed, highest, spread of the members."""
    z = [logit(c) for c in members]
    return {"mean": row_mean(members), "mean_logit": sigmoid(row_mean(z)), "median": row_median(members), "trimmed": row_trimmed_mean(members), "highest": row_max(members), "spread": row_spread(members, row_mean(members))}


def attenuated(p: str, spread: Column, k: float) -> Column:
    """p drawn to one half on the logit scale as members disagree."""
    return sigmoid(logit(p) / (1 + k * col(spread)))


def form_correction(p: str, current_rate: Column, current_n: Column, expected: Column, weight: float, k: float) -> Column:
    """p moved by the difference of logits of the current period's rate and the expected one, weighted by its reliability n / (n + k)."""
    move = weight * current_n / (current_n + k) * (logit(current_rate, 0.01) - logit(expected, 0.01))
    return sigmoid(logit(p) + F.when(current_n > 0, move).otherwise(0.0))
