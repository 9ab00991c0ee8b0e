"""The trie of conversation prefixes, by most-significant-digit radix partitioning over dictionary-encoded turns.

Conversations with equal turns are one row. All rows are the root's bucket; a bucket too large for one task is split by its next turn,
after the turns that all its rows share, in Spark jobs that emit the nodes passed; a small one is finished by multikey quicksort in a task,
whose recursion emits the nodes below. Sums over subtrees are then carried up through the few large buckets, last round first."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, deal_join, discard, lookup_join, saved

#: Turns left in a bucket up to which one task finishes it.
LOCAL = 8192
EMPTY = hashlib.sha256(b"").hexdigest()
#: Bits of a conversation's id within a block; ids of equal conversations are gathered by block.
BLOCK_BITS = 12
NODE = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"


def sequences(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, ids, sizes): for each conversation the numbers of its turns' (role, text) in a dictionary of all turns, and their texts'
    UTF-8 bytes, ordered by turn, null first; equal turns by a digest of role and text. A null role or text is empty; rows without
    conv are ignored. Texts stay where they lie, digests travel; a conversation's numbers must fit in a row."""
    said = F.coalesce(F.col(text), F.lit(""))
    who = F.coalesce(F.col(role), F.lit(""))
    digest = F.unhex(F.sha2(F.concat(F.length(who).cast("string"), F.lit(":"), who, said), 256))
    at = saved(turns.where(F.col(conv).isNotNull()).select(F.col(conv).cast("long").alias("conv_id"), F.col(turn).alias("_turn"), digest.alias("_digest"), F.octet_length(said).alias("_size")))
    words = saved(at.groupBy("_digest").agg(F.count(F.lit(1)).alias("_n")).withColumn("_id", F.monotonically_increasing_id()))
    coded = deal_join(at, words, "_digest", "_n", at.count())
    one = F.struct(F.col("_turn").isNotNull(), F.col("_turn"), F.col("_digest"), F.col("_id"), F.col("_size"))
    rows = coded.groupBy("conv_id").agg(F.sort_array(F.collect_list(one)).alias("_t"))
    out = saved(rows.select("conv_id", F.transform("_t", lambda x: x["_id"]).alias("ids"), F.transform("_t", lambda x: x["_size"]).alias("sizes")))
    discard(at, words)
    return out


def spliced(seqs: DataFrame, every: int = 5, most: int = 9) -> DataFrame:
    """seqs rebuilt: conversation c starts with the first h turns of conversation c - c % every (all if fewer, none if absent), h being the
    CRC-32 of c in decimal modulo most; its own turns after its first h follow."""
    base = seqs.where(F.col("conv_id") % every == 0).select(F.col("conv_id").alias("_base"), *[F.slice(c, 1, most - 1).alias(f"_{c}") for c in ("ids", "sizes")])
    h = F.pmod(F.crc32(F.col("conv_id").cast("string")), F.lit(most)).cast("int")
    met = seqs.withColumns({"_base": F.col("conv_id") - F.col("conv_id") % every, "_h": h}).join(base, "_base", "left")
    whole = lambda c, kind: F.concat(F.slice(F.coalesce(f"_{c}", F.array().cast(kind)), F.lit(1), F.col("_h")), F.slice(c, F.col("_h") + 1, F.size(c)))
    return met.select("conv_id", whole("ids", "array<long>").alias("ids"), whole("sizes", "array<int>").alias("sizes"))


def _digest_ends(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From blocks sorted by (key, block): key, least id, number of ids and the SHA-256 of them all, one block in memory at a time."""
    key = None
    for batch in batches(it):
        done = []
        for k, least, n, text in zip(*(batch.column(c).to_pylist() for c in ("key", "least", "n", "text"))):
            if k != key:
                if key is not None:
                    done.append((rep, total, h.hexdigest()))
                key, rep, total, h = k, least, 0, hashlib.sha256()
            h.update((b"," if total else b"") + text.encode())
            total += n
        if done:
            yield _columns(done, ["rep", "n", "ends"])
    if key is not None:
        yield _columns([(rep, total, h.hexdigest())], ["rep", "n", "ends"])


def _columns(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], names)


def equal_classes(seqs: DataFrame) -> DataFrame:
    """(rep, n, ends, ids, sizes): a row for each distinct sequence: the least conv_id, how many, the SHA-256 of all of them in order.
    Ids are sorted and joined by blocks of neighbouring numbers, so a sequence that many conversations share is sorted by many tasks;
    the hash itself runs over its blocks one after the other."""
    keyed = seqs.withColumn("key", F.unhex(F.sha2(F.array_join("ids", ","), 256)))
    held = keyed.groupBy("key", F.shiftright("conv_id", BLOCK_BITS).alias("block")).agg(F.sort_array(F.collect_list("conv_id")).alias("c"))
    blocks = held.select("key", "block", F.col("c")[0].alias("least"), F.size("c").cast("long").alias("n"), F.array_join("c", ",").alias("text"))
    ends = blocks.repartition("key").sortWithinPartitions("key", "block").mapInArrow(_digest_ends, "rep long, n long, ends string")
    return ends.join(seqs.withColumnRenamed("conv_id", "rep"), "rep")


def whole_groups(it: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by integer keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches(it):
        cols = [batch.column(k).to_numpy() for k in keys]
        new = np.r_[True, np.any([c[1:] != c[:-1] for c in cols], axis=0)]
        if held:
            last = held[-1]
            new[0] = any(c[0] != last.column(k)[last.num_rows - 1].as_py() for k, c in zip(keys, cols))
        if not new.any():
            held.append(batch)
            continue
        cut = int(len(new) - 1 - new[::-1].argmax())
        if held or cut:
            yield pa.Table.from_batches([*held, *([batch.slice(0, cut)] if cut else [])])
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held)


def grow(tops: list[tuple[int, int, int, list[int]]], ids: list[list[int]], sizes: list[list[int]], rep: list[int], n: list[int], ends: list[str]) -> list[tuple]:
    """Nodes (NODE's columns and whether it is a top) of subtrees. tops: (parent, depth, bytes of the node's text, its rows); ids and sizes are a row's
    turns below its top; rows of one top are distinct. Rows are sorted by their next turn around a pivot's into less, equal and more;
    the equal ones are a node, sorted by the turn after it."""
    up, depth, size, own, least, end, outer = [], [], [], [], [], [], []

    def node(above: int, at: int, text: int, parent) -> int:
        up.append(above), depth.append(at), size.append(text), own.append(0), least.append(None), end.append(EMPTY), outer.append(parent)
        return len(up) - 1

    def arrive(rows: list[int], at: int, here: int) -> list[int]:
        """Marks the row that ends here; returns those that go on."""
        on = [r for r in rows if len(ids[r]) > at]
        for r in rows:
            if len(ids[r]) == at:
                own[here], least[here], end[here] = n[r], rep[r], ends[r]
        return on

    for parent, at_depth, text, rows in tops:
        top = node(-1, at_depth, text, parent)
        stack = [(arrive(rows, 0, top), 0, top)]
        while stack:
            some, at, above = stack.pop()
            if not some:
                continue
            if len(some) == 1:  # the rest of one row is a path
                r = some[0]
                for i in range(at, len(ids[r])):
                    above = node(above, at_depth + i + 1, sizes[r][i], None)
                own[above], least[above], end[above] = n[r], rep[r], ends[r]
                continue
            pivot = sorted(ids[some[i]][at] for i in (0, len(some) // 2, -1))[1]
            less, equal, more = [], [], []
            for r in some:
                d = ids[r][at]
                (equal if d == pivot else less if d < pivot else more).append(r)
            here = node(above, at_depth + at + 1, sizes[equal[0]][at], None)
            stack += [(less, at, above), (more, at, above), (arrive(equal, at + 1, here), at + 1, here)]
    kids, leaves, saving = [0] * len(up), [0] * len(up), [0] * len(up)
    for i in range(len(up) - 1, -1, -1):
        leaves[i] = leaves[i] or 1
        saving[i] += (own[i] - 1) * size[i]
        if (p := up[i]) >= 0:
            kids[p] += 1
            leaves[p] += leaves[i]
            saving[p] += saving[i]
            own[p] += own[i]
            least[p] = least[i] if least[p] is None else min(least[p], least[i])
    return [(least[i], depth[i], outer[i] if up[i] < 0 else least[up[i]], own[i], kids[i], leaves[i], saving[i], end[i], up[i] < 0) for i in range(len(up))]


def _finish(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256", "top"]
    for t in whole_groups(it, ["parent", "depth", "digit"]):
        parent, depth, digit, last, *row = (t.column(c).to_pylist() for c in ("parent", "depth", "digit", "last", "ids", "sizes", "rep", "n", "ends"))
        tops: list[tuple] = []
        for i, key in enumerate(zip(parent, depth, digit)):
            if not i or key != before:
                before = key
                tops.append((parent[i], depth[i], last[i], []))
            tops[-1][3].append(i)
        nodes = grow(tops, *row)
        for a in range(0, len(nodes), 20_000):
            yield _columns(nodes[a : a + 20_000], names)


def prefix_trie(seqs: DataFrame, local: int = LOCAL) -> DataFrame:
    """A row for each distinct prefix of the sequences (conv_id, ids, sizes), conv_id unique: conv_id (the smallest member), depth,
    parent_conv_id (null for the root, depth 0), n_convs, n_children, n_leaves, saved_tokens (over its subtree, each node's members less one times
    the size of its last turn), ends_sha256 (of the decimal conv_ids, ascending and comma-joined, of members with no further turn).
    A sequence without turns is a member of the root. No sequences give no nodes.

    A bucket with more than `local` turns left is split; a bucket's members share their parent, depth and last turn."""
    rows = saved(equal_classes(seqs).select(F.lit(0).cast("long").alias("bucket"), F.lit(None).cast("long").alias("parent"), F.lit(0).cast("long").alias("depth"), F.lit(0).alias("last"), "rep", "n", "ends", "ids", "sizes"))
    rounds, small = [], []
    while True:
        of = rows.groupBy("bucket").agg(
            F.min("rep").alias("conv_id"), F.min("parent").alias("parent"), F.min("depth").alias("depth"), F.min("last").alias("last"), F.sum("n").alias("n_convs"),
            F.min(F.struct("ids", "sizes")).alias("_lo"), F.max("ids").alias("_hi"),
        )
        # Turns that all share are those that the least and the greatest sequence share.
        differs = F.array_position(F.zip_with("_lo.ids", "_hi", lambda x, y: x.eqNullSafe(y)), False)
        of = of.withColumn("shared", F.when(differs > 0, differs - 1).otherwise(F.size("_lo.ids")).cast("int"))
        of = saved(of.select("bucket", "conv_id", "parent", "depth", "n_convs", "shared", F.concat(F.array("last"), F.slice("_lo.sizes", F.lit(1), F.col("shared"))).alias("chain")))
        met = lookup_join(rows.drop("parent"), of.select("bucket", "shared", F.col("conv_id").alias("parent")), ["bucket"], "inner", F.col("rep"))
        ended = saved(met.where("size(ids) = shared").select(F.col("parent").alias("conv_id"), (F.col("depth") + F.col("shared")).alias("depth"), "ends"))
        on = met.where("size(ids) > shared").select(
            "bucket", "parent", (F.col("depth") + F.col("shared") + 1).alias("depth"), F.expr("sizes[shared]").alias("last"), F.expr("ids[shared]").alias("digit"), "rep", "n", "ends",
            *[F.slice(c, F.col("shared") + 2, F.size(c)).alias(c) for c in ("ids", "sizes")],
        )
        on = saved(on)
        sizes = on.groupBy("bucket", "digit").agg(F.sum(F.size("ids")).alias("left"), F.count(F.lit(1)).alias("rows"))
        large = saved(sizes.where((F.col("left") > local) & (F.col("rows") > 1)).select("bucket", "digit", F.monotonically_increasing_id().alias("_next")))
        rounds.append((of, ended))
        more = large.limit(1).count() > 0
        discard(rows)
        if not more:
            small.append(on)
            break
        split = lookup_join(on, large, ["bucket", "digit"], "left", F.col("rep"))
        small.append(saved(split.where("_next is null").drop("_next")))
        rows = saved(split.where("_next is not null").drop("bucket", "digit").withColumnRenamed("_next", "bucket"))
        discard(on, large)
    rest = small[0]
    for s in small[1:]:
        rest = rest.unionByName(s)
    dealt = rest.drop("bucket").repartition("parent", "depth", "digit").sortWithinPartitions("parent", "depth", "digit")
    nodes = saved(dealt.mapInArrow(_finish, NODE + ", top boolean"))
    discard(*small)
    tops = nodes.where("top").groupBy(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("_stop"))
    finished = saved(tops.agg(F.count(F.lit(1)).alias("_kids"), F.sum("n_leaves").alias("_leaves"), F.sum("saved_tokens").alias("_saved")))
    out, kids = nodes.drop("top"), finished
    for of, ended in reversed(rounds):
        met = of.withColumn("_stop", F.col("depth") + F.col("shared")).join(kids, ["conv_id", "_stop"], "left")
        path = met.select("conv_id", "parent", "depth", "n_convs", "_stop", "_kids", "_leaves", "_saved", F.posexplode("chain").alias("_at", "_size"))
        after = Window.partitionBy("conv_id", "depth").orderBy(F.col("_at").desc())
        path = path.withColumns({"_own": F.sum((F.col("n_convs") - 1) * F.col("_size")).over(after), "_depth": F.col("depth") + F.col("_at")})
        path = path.join(ended.select("conv_id", F.col("depth").alias("_depth"), "ends"), ["conv_id", "_depth"], "left")
        upper = path.select(
            "conv_id", F.col("_depth").alias("depth"), F.when(F.col("_at") == 0, F.col("parent")).otherwise(F.col("conv_id")).alias("parent_conv_id"), "n_convs",
            F.when(F.col("_depth") < F.col("_stop"), 1).otherwise(F.coalesce("_kids", F.lit(0))).cast("long").alias("n_children"), F.coalesce("_leaves", F.lit(1)).cast("long").alias("n_leaves"),
            (F.coalesce("_saved", F.lit(0)) + F.col("_own")).alias("saved_tokens"), F.coalesce("ends", F.lit(EMPTY)).alias("ends_sha256"), (F.col("_at") == 0).alias("top"),
        )
        upper = saved(upper)
        out = out.unionByName(upper.drop("top"))
        split = upper.where("top").select(F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("_stop"), F.lit(1).alias("_kids"), F.col("n_leaves").alias("_leaves"), F.col("saved_tokens").alias("_saved"))
        kids = finished.unionByName(split).groupBy("conv_id", "_stop").agg(*[F.sum(c).alias(c) for c in ("_kids", "_leaves", "_saved")])
        discard(of, ended)
    discard(finished)
    return out
