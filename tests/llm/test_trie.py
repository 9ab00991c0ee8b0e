"""The prefix trie against a plain dictionary of prefixes, with buckets split by Spark and finished in tasks."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from priorwise.llm import queries, trie

NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(convs):
    """convs: {conv_id: [(role, text), ...]}"""
    nodes = {}
    for c in sorted(convs):
        for d in range(len(convs[c]) + 1):
            nodes.setdefault(tuple(convs[c][:d]), []).append(c)
    out = []
    for path, members in nodes.items():
        below = {p: m for p, m in nodes.items() if p[: len(path)] == path}
        kids = lambda p: sum(len(q) == len(p) + 1 and q[: len(p)] == p for q in nodes)
        ends = ",".join(str(c) for c in members if len(convs[c]) == len(path))
        out.append((
            members[0], len(path), nodes[path[:-1]][0] if path else None, len(members), kids(path), sum(not kids(p) for p in below),
            sum((len(m) - 1) * len(p[-1][1].encode()) for p, m in below.items() if p), hashlib.sha256(ends.encode()).hexdigest(),
        ))
    return sorted(out, key=str)


def ordered(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(ts, key=lambda t: t[:2])] for c, ts in turns.items()}


def as_rows(df):
    return sorted([tuple(r[c] for c in NAMES) for r in df.collect()], key=str)


def talks(seed, n=120, words=3, longest=9):
    r = random.Random(seed)
    out = []
    for c in r.sample(range(4 * n), n):
        turns = [(f"r{r.randrange(2)}", "é" * r.randrange(words)) for _ in range(r.randrange(1, longest))]
        if r.random() < 0.4:
            turns = [("r0", "same"), ("r1", "start"), ("r0", "always"), *turns[:2]]
        out += [(c, i if i or r.random() < 0.5 else None, role, text or r.choice([None, ""])) for i, (role, text) in enumerate(turns)]
    r.shuffle(out)
    return out


@pytest.mark.parametrize("local", [1, 12, 60, trie.LOCAL])
def test_like_a_dictionary(spark, local):
    rows = talks(local)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("Conv", F.lit(1))
    assert as_rows(trie.prefix_trie(trie.sequences(df), local)) == plain_trie(ordered(rows))


def test_rebuilt(spark):
    rows = talks(9, 60)
    convs = ordered(rows)
    made = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        made[c] = convs.get(c - c % 5, [])[:h] + own[h:]
    assert any(not t for t in made.values())  # a conversation without turns is a member of the root
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert as_rows(trie.prefix_trie(trie.spliced(trie.sequences(df)), 20)) == plain_trie(made)


def test_many_equal_and_long(spark, monkeypatch):
    """Half of all conversations are equal, across several blocks of ids; one goes on for 3,000 turns; repeated turns stay in order."""
    monkeypatch.setattr(trie, "BLOCK_BITS", 4)
    rows = [(c, t, "user", "hello") for c in range(100) for t in range(3)] + [(200, t, "user", "hello") for t in range(3000)] + [(300 + c, 0, "user", str(c)) for c in range(90)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {(r.conv_id, r.depth): r for r in trie.prefix_trie(trie.sequences(df), 50).collect()}
    assert len(got) == 1 + 3000 + 90
    assert got[0, 3].ends_sha256 == hashlib.sha256(",".join(map(str, range(100))).encode()).hexdigest() and got[0, 3].n_convs == 101
    assert got[0, 0].n_leaves == 91 and got[0, 0].n_children == 91 and got[0, 0].saved_tokens == 3 * 100 * 5 and got[200, 4].parent_conv_id == 0 and got[200, 3000].n_children == 0


def test_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert trie.prefix_trie(trie.sequences(spark.createDataFrame([], schema))).count() == 0
    assert trie.prefix_trie(trie.sequences(spark.createDataFrame([(None, 0, "user", "x")], schema))).count() == 0
    one = trie.prefix_trie(trie.sequences(spark.createDataFrame([(7, None, None, None)], schema)))
    assert as_rows(one) == plain_trie({7: [("", "")]})
    twice = [(1, 0, "user", "b"), (1, 0, "user", "a"), (2, 0, "user", "a"), (2, 0, "user", "b")]  # equal turns stand in one order, whatever the rows' order
    assert trie.prefix_trie(trie.sequences(spark.createDataFrame(twice, schema))).count() == 3


def test_groups_across_batches():
    import pyarrow as pa

    keys = [1, 1, 2, 2, 2, 2, 3, 4, 4]
    for step in (1, 2, 3, 9):
        cuts = [pa.RecordBatch.from_arrays([pa.array(keys[i : i + step])], ["k"]) for i in range(0, len(keys), step)]
        seen = [set(t.column("k").to_pylist()) for t in trie.whole_groups(cuts, ["k"])]
        assert sum(len(t) for t in seen) == len(set().union(*seen)) == 4


def test_query_is_whole(spark):
    got = queries.op11_prefix_trie(spark, "/root/testdata/sf0.001")
    convs = ordered([tuple(r) for r in spark.read.parquet("/root/testdata/sf0.001/conversations.parquet").select("conv_id", "turn", "role", "text").collect()])
    made = {c: (b := convs.get(c - c % 5, [])[: (h := zlib.crc32(str(c).encode()) % 9)]) + own[h:] for c, own in convs.items()}  # noqa: F841
    assert as_rows(got) == plain_trie(made)
