"""Identity maps that can be trusted: greedy one-to-one assignment, maps checked by an attribute that took no part, growth of two maps
through each other, and pairing in stages.

Votes are aggregated once; each round is a few joins and minima that combine before the shuffle, and is settled in the shared folder."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import col
from ..session import settled

#: Edges that one task finishes.
LOCAL = 200_000


def greedy_assignment(votes: DataFrame, a: str, b: str, n: str = "n", local: int = LOCAL) -> DataFrame:
    """(a, b, n): what taking edges one by one gives, the most votes first (ties to the smaller a, then b), each end once.

    Each round takes the edges that are the first at both their ends, all at once, and drops the edges of the ends taken: an edge that comes
    first at both ends can't be displaced by any other. The last `local` edges are taken one by one in a task, so a long
    chain of ever smaller edges doesn't need a round each. Edges with a null are left out; of repeated edges the most votes count."""
    edges = settled(votes.dropna(subset=[a, b, n]).groupBy(a, b).agg(F.max(n).alias(n)))
    first = F.min(F.struct((-F.col(n)).alias("k"), F.col(a).alias("a"), F.col(b).alias("b"))).alias("_m")
    out = edges.limit(0)
    while (left := edges.limit(local + 1).count()) > local:
        at_a, at_b = edges.groupBy(a).agg(first).select("_m.*"), edges.groupBy(b).agg(first).select("_m.*")
        taken = settled(at_a.join(at_b, ["k", "a", "b"]).select(F.col("a").alias(a), F.col("b").alias(b), (-F.col("k")).alias(n)))
        out = out.unionByName(taken)
        edges = settled(edges.join(taken.select(a), a, "left_anti").join(taken.select(b), b, "left_anti"))
    if not left:
        return out
    kinds = edges.schema

    def one_by_one(it):
        t = pd.concat(list(it), ignore_index=True)
        used_a, used_b, keep = set(), set(), []
        for i, x, y in t.sort_values([n, a, b], ascending=[False, True, True])[[a, b]].itertuples():
            if x not in used_a and y not in used_b:
                used_a.add(x), used_b.add(y), keep.append(i)
        yield t.loc[keep]

    return out.unionByName(settled(edges.repartition(1).mapInPandas(one_by_one, kinds)))


def checked_votes(pairs: DataFrame, a: str, b: str, check: Column, *context: str) -> DataFrame:
    """(a, b, context, n, agree): how often ids meet, and how often the check holds then (a null check doesn't)."""
    return pairs.dropna(subset=[a, b, *context]).groupBy(a, b, *context).agg(F.count(F.lit(1)).alias("n"), F.count_if(check).alias("agree"))


def checked_map(votes: DataFrame, a: str, b: str, least: int = 30, share: float = 0.85, agreement: float = 0.95) -> DataFrame:
    """(a, b, n_top, n_total, share, agreement): each a's most frequent b (ties to the smaller) with enough votes, share and agreement of the
    check; of several a with one b the one of the most votes stays (ties to the smaller). votes: (a, b, n, agree), an edge may repeat."""
    v = votes.groupBy(a, b).agg(F.sum("n").alias("n"), F.sum("agree").alias("agree"))
    g = v.groupBy(a).agg(F.sum("n").alias("n_total"), F.min(F.struct((-F.col("n")).alias("k"), F.col(b).alias("b"), "agree")).alias("_m"))
    top = g.select(a, F.col("_m.b").alias(b), (-F.col("_m.k")).alias("n_top"), "n_total", F.col("_m.agree").alias("_agree"))
    top = top.withColumns({"share": F.col("n_top") / F.col("n_total"), "agreement": F.col("_agree") / F.col("n_top")}).drop("_agree")
    top = top.where((F.col("n_total") >= least) & (F.col("share") >= share) & (F.col("agreement") >= agreement))
    rest = [c for c in top.columns if c not in (a, b)]
    one = top.groupBy(b).agg(F.min(F.struct((-F.col("n_top")).alias("k"), F.col(a).alias("a"), *rest)).alias("_m"))
    return one.select(F.col("_m.a").alias(a), b, *[f"_m.{c}" for c in rest])


def grow_both(pairs: DataFrame, known_ab: DataFrame, known_cd: DataFrame, a: str, b: str, c: str, d: str, check_ab: Column, check_cd: Column, rounds: int = 20, **limits) -> tuple[DataFrame, DataFrame]:
    """Two maps that grow through each other: ((a, b, round), (c, d, round)), given edges in round 0.

    In each round pairs of rows whose (c, d) the second map holds vote for edges of the first among ids that it doesn't use yet, then pairs
    whose (a, b) the first map holds, new edges included, for the second. It ends when a round adds nothing; more than `rounds` raise.
    limits are those of checked_map. Pairs are counted by all four ids once."""
    g = settled(pairs.dropna(subset=[a, b, c, d]).groupBy(a, b, c, d).agg(F.count(F.lit(1)).alias("n"), F.count_if(check_ab).alias("_ab"), F.count_if(check_cd).alias("_cd")))
    ab, cd = known_ab.select(a, b, F.lit(0).alias("round")), known_cd.select(c, d, F.lit(0).alias("round"))

    def added(mine: DataFrame, other: DataFrame, x: str, y: str, context: list[str], agree: str, i: int) -> DataFrame:
        votes = g.join(other.select(*context), context, "left_semi").join(mine.select(x), x, "left_anti").join(mine.select(y), y, "left_anti")
        return settled(checked_map(votes.select(x, y, "n", F.col(agree).alias("agree")), x, y, **limits).select(x, y, F.lit(i).alias("round")))

    for i in range(1, rounds + 2):
        new_ab = added(ab, cd, a, b, [c, d], "_ab", i)
        ab = ab.unionByName(new_ab)
        new_cd = added(cd, ab, c, d, [a, b], "_cd", i)
        cd = cd.unionByName(new_cd)
        if not new_ab.limit(1).count() and not new_cd.limit(1).count():
            return ab, cd
    raise RuntimeError(f"maps still grow after {rounds} rounds")


def staged_pairing(left: DataFrame, right: DataFrame, stages: Sequence[Sequence[str]], left_id: str, right_id: str, left_order: Sequence[str], right_order: Sequence[str]) -> DataFrame:
    """(left_id, right_id, stage, occurrence): for each list of keys first the rows whose key both sides have once, then, where both sides have
    as many rows of a key, the i-th with the i-th in their orders. Stages are numbered 1, 2, .., two for each list; later ones see only
    rows that earlier ones left. Null key parts are equal to each other. Ids must be unique on their side.

    Rows of a key are counted on both sides in one aggregate, and only rows of keys with equal counts are moved."""
    out = None
    for i, keys in enumerate(stages):
        key = F.struct(*keys).alias("_key")  # structs compare with nulls as equal
        one = left.select(key, F.lit(1).alias("l"), F.lit(0).alias("r")).unionByName(right.select(key, F.lit(0).alias("l"), F.lit(1).alias("r")))
        even = settled(one.groupBy("_key").agg(F.sum("l").alias("_n"), F.sum("r").alias("_r")).where("_n = _r").select("_key", "_n"))
        sides = []
        for df, name, order in ((left, left_id, left_order), (right, right_id, right_order)):
            met = df.select(key, F.col(name).alias(f"_id_{name}"), *[col(c).alias(f"_o{j}") for j, c in enumerate(order)]).join(even, "_key")
            w = Window.partitionBy("_key").orderBy(*[f"_o{j}" for j in range(len(order))], f"_id_{name}")
            many = met.where("_n > 1").withColumn("occurrence", F.row_number().over(w))
            sides.append(met.where("_n = 1").withColumn("occurrence", F.lit(1)).unionByName(many).select("_key", "_n", "occurrence", F.col(f"_id_{name}").alias(name)))
        stage = F.when(F.col("_n") == 1, 2 * i + 1).otherwise(2 * i + 2).alias("stage")
        found = settled(sides[0].join(sides[1].drop("_n"), ["_key", "occurrence"]).select(left_id, right_id, stage, "occurrence"))
        out = found if out is None else out.unionByName(found)
        if i + 1 < len(stages):
            left, right = settled(left.join(found.select(left_id), left_id, "left_anti")), settled(right.join(found.select(right_id), right_id, "left_anti"))
    return out
