"""Connected components of a table of links, by alternating star contractions in Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, saved


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Large: each larger neighbour of a node is linked to the least of the node and its neighbours. Small: the node and its
    smaller neighbours are. Minima are combined before the shuffle, so a node with many links is no bottleneck."""
    if large:
        both = links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        met = both.where("v > u").join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b"))
    else:
        down = links.select(F.col("b").alias("u"), F.col("a").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"))
        met = down.join(least, "u").select(F.col("m").alias("a"), F.col("v").alias("b")).unionByName(least.select(F.col("m").alias("a"), F.col("u").alias("b")))
    return met.where("a < b").distinct()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, label): for each node of links (a, b) the least node that it reaches. Null ends are ignored; no links give no rows.
    Each round is written to the shared folder; the rounds end when the links stay the same."""
    now = saved(links.dropna().where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    mark = lambda df: tuple(df.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
    state = mark(now)
    for _ in range(rounds):
        if not state[0]:
            break
        new = saved(_star(_star(now, True), False))
        discard(now)
        now, before, state = new, state, mark(new)
        if state == before:
            break
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    return now.select(F.col("b").alias("node"), F.col("a").alias("label")).unionByName(now.select(F.col("a").alias("node"), F.col("a").alias("label")).distinct())
