"""Chat formatting: logged snapshots that are prefixes of longer conversations are dropped, the rest are rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, saved


def _text_ranks(turns: DataFrame, digests: DataFrame) -> DataFrame:
    """digests (_conv, _turn, _role, _d1, _d2) with _rank, the order of a turn's text among different texts of the same conversation, turn
    and role. Only texts of such ties are moved; elsewhere the rank is 0."""
    least = [f(c).alias(f"_{n}{c}") for c in ("_d1", "_d2") for n, f in (("min", F.min), ("max", F.max))]
    tied = saved(digests.groupBy("_conv", "_turn", "_role").agg(*least).where("_min_d1 < _max_d1 or _min_d2 < _max_d2").select("_conv", "_turn", "_role"))
    few = tied.limit(BROADCAST_ROWS + 1).count()
    if not few:
        return digests.withColumn("_rank", F.lit(0))
    same = lambda x, y: x["_conv"].eqNullSafe(y["_conv"]) & x["_turn"].eqNullSafe(y["_turn"]) & x["_role"].eqNullSafe(y["_role"])
    texts = turns.join(F.broadcast(tied) if few <= BROADCAST_ROWS else tied, same(turns, tied), "left_semi")
    order = F.dense_rank().over(Window.partitionBy("_conv", "_turn", "_role").orderBy(F.col("_text").asc_nulls_first()))
    ranks = saved(texts.withColumn("_rank", order).select("_conv", "_turn", "_role", "_d1", "_d2", "_rank").distinct())
    met = digests.join(ranks, same(digests, ranks) & (digests["_d1"] == ranks["_d1"]) & (digests["_d2"] == ranks["_d2"]), "left")
    return met.select(*[digests[c] for c in digests.columns], F.coalesce(ranks["_rank"], F.lit(0)).alias("_rank"))


def turn_prefixes(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, at, n_turns, prefix): for each turn, numbered from 1 by (turn, role, text), two rolling hashes of the turns up to it.

    Rows without conv are ignored; a null role or text differs from an empty one; null turns come first.
    Texts are hashed where they lie and stay there. A turn's hash covers its number, role and text's hashes, and the prefix is the running
    exclusive or, so no turn list is held in memory."""
    hashed = lambda salt: F.xxhash64(F.lit(salt), F.col("_text").isNull(), "_text")
    turns = turns.where(F.col(conv).isNotNull()).select(F.col(conv).alias("_conv"), F.col(turn).alias("_turn"), F.col(role).alias("_role"), F.col(text).alias("_text"))
    turns = turns.withColumns({"_d1": hashed(1), "_d2": hashed(2)})
    at = _text_ranks(turns, saved(turns.drop("_text")))
    w = Window.partitionBy("_conv").orderBy(F.col("_turn").asc_nulls_first(), F.col("_role").asc_nulls_first(), "_rank")
    at = at.withColumn("at", F.row_number().over(w))
    one = lambda salt: F.xxhash64(F.lit(salt), "at", F.col("_role").isNull(), "_role", "_d1", "_d2")
    up = Window.partitionBy("_conv").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        at.withColumns({"_h1": one(1), "_h2": one(2)})
        .select("_conv", "at", F.bit_xor("_h1").over(up).alias("h1"), F.bit_xor("_h2").over(up).alias("h2"), F.count("*").over(Window.partitionBy("_conv")).alias("n_turns"))
    )


def maximal_conversations(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, n_snapshots): conversations whose turns are no proper prefix of another's; of equal ones the smallest id.
    n_snapshots: logged conversations with exactly these turns."""
    p = turn_prefixes(turns, conv, turn, role, text)
    proper = p.where("at < n_turns").select("h1", "h2", "at").distinct()
    whole = p.where("at = n_turns").groupBy("h1", "h2", "at").agg(F.min("_conv").alias(conv), F.count("*").alias("n_snapshots"))
    return whole.join(proper, ["h1", "h2", "at"], "left_anti").select(conv, F.col("at").cast("long").alias("n_turns"), "n_snapshots")


def rendered(role: Column, text: Column, opening: str = "<|im_start|>", closing: str = "<|im_end|>") -> Column:
    """One turn: opening, role, line break, text, closing, line break. Markers within a text lose their bars, so a text can't end its turn."""
    inert = F.coalesce(text, F.lit(""))
    for mark in (opening, closing):
        inert = F.replace(inert, F.lit(mark), F.lit(mark.replace("|", "")))
    return F.concat(F.lit(opening), F.coalesce(role, F.lit("user")), F.lit("\n"), inert, F.lit(closing + "\n"))


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, n_turns, n_snapshots, rendered): each maximal conversation as one training text, turns in order.
    Empty input gives no rows. A single conversation's rendered text must fit in a row."""
    turns = turns.select(conv, turn, role, text)
    kept = maximal_conversations(turns, conv, turn, role, text)
    order = F.struct(F.col(turn).isNotNull(), F.col(turn), F.col(role).isNotNull(), F.col(role), F.col(text).isNotNull(), F.col(text), rendered(F.col(role), F.col(text)).alias("_r"))
    texts = (
        turns.where(F.col(conv).isNotNull()).join(kept, conv).groupBy(conv, "n_turns", "n_snapshots").agg(F.sort_array(F.collect_list(order)).alias("_t"))
    )
    return texts.select(conv, "n_turns", "n_snapshots", F.array_join(F.transform("_t", lambda x: x["_r"]), "").alias("rendered"))
