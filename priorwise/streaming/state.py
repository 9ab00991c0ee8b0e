"""Streaming forms of the history features: windowed rates, sessions by gap, and an entity's state before each event.

The batch operators are the reference semantics; these need a watermark, and rows later than it are dropped by Spark."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def windowed_rates(stream: DataFrame, ts: str, keys: list[str], label: Column, length: str = "1 hour", slide: str | None = None, late: str = "10 minutes") -> DataFrame:
    """(keys, start, end, n, rate) by tumbling or sliding windows."""
    w = F.window(ts, length, slide) if slide else F.window(ts, length)
    out = stream.withWatermark(ts, late).groupBy(*keys, w.alias("_w")).agg(F.count(F.lit(1)).alias("n"), F.avg(label.cast("double")).alias("rate"))
    return out.select(*keys, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n", "rate")


def gap_sessions(stream: DataFrame, ts: str, entity: str, gap: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """(entity, start, end, n): sessions that end after a gap without events."""
    out = stream.withWatermark(ts, late).groupBy(entity, F.session_window(ts, gap).alias("_w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(entity, F.col("_w.start").alias("start"), F.col("_w.end").alias("end"), "n")


def running_state(stream: DataFrame, entity: str, order: list[str], key: str, label: str, prior: float = 0.5, k: float = 50.0) -> DataFrame:
    """(entity, key, n_before, rate): each event with its entity's shrunk rate before it. Within a micro-batch rows follow `order`;
    events must arrive in order across batches."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = stream.schema

    def step(name: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n, s = state.get if state.exists else (0, 0.0)
        pdf = pd.concat(list(frames)).sort_values(order)
        y = pdf[label].astype(float)
        before_n = n + pd.Series(range(len(pdf)), index=pdf.index)
        before_s = s + y.cumsum() - y
        state.update((int(n + len(pdf)), float(s + y.sum())))
        yield pd.DataFrame({entity: name[0], key: pdf[key], "n_before": before_n, "rate": (before_s + prior * k) / (before_n + k)})

    out = f"{entity} {kind[entity].dataType.simpleString()}, {key} {kind[key].dataType.simpleString()}, n_before long, rate double"
    return stream.groupBy(entity).applyInPandasWithState(step, out, "n long, s double", "append", GroupStateTimeout.NoTimeout)
