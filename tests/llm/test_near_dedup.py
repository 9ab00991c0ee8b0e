import random

import numpy as np
import pytest

from priorwise.llm import near_dedup
from priorwise.llm.components import components


def shingles(text, k=5):
    w = bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode()).split()
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(docs, percent=80):
    sets = {d: shingles(t) for d, t in docs if d is not None}
    least = {d: d for d in sets}
    linked = [(a, b) for a in sets for b in sets if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    while True:
        before = dict(least)
        for a, b in linked:
            least[a] = least[b] = min(least[a], least[b])
        if before == least:
            break
    return sorted([(d, len(shingles(t)), least.get(d), d is None or least[d] == d) for d, t in docs], key=str)


def corpus(seed):
    r = random.Random(seed)
    words = [f"w{i}" for i in range(300)] + ["Über", "THE", "a,"]
    out = []
    for g in range(14):
        base = [r.choice(words) for _ in range(r.choice([3, 4, 5, 20, 60, 120, 300]))]
        for _ in range(r.choice([1, 2, 3, 12])):
            w = list(base)
            for _ in range(r.choice([0, 0, 1, 1, 2, 4])):
                w[r.randrange(len(w))] = r.choice(words)
            out.append((len(out) * 7 % 1009, "  ".join(w) if g % 2 else "\n".join(w).upper(), g))
    return [*out, (None, out[0][1], 1), (3000, None, 1), (3001, " \n", 1), (3002, None, 1), (3003, "ß " * 30, 2)]


CONTRACT = {"percent": 85, "slots": 256, "band": 8}


@pytest.mark.parametrize("seed,how", [(1, {}), (2, {"block": 2}), (3, {"block": 3, **CONTRACT}), (4, {"block": 4, "pivots": 1, **CONTRACT})])
def test_like_brute_force(spark, seed, how):
    docs = corpus(seed)
    docs += docs[:2]
    df = spark.createDataFrame(docs, "doc_id long, text string, n long").repartition(3)
    got = near_dedup.find_near_duplicates(df, **how).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute([d[:2] for d in docs], how.get("percent", 80))


def test_one_of_each_group_stays(spark):
    docs = corpus(5)
    df = spark.createDataFrame(docs, "doc_id long, text string, COMPONENT_ID long")
    kept = near_dedup.drop_near_duplicates(df)
    assert kept.columns == df.columns
    assert sorted([r.doc_id for r in kept.collect()], key=str) == sorted([d for d, _, _, k in brute([d[:2] for d in docs]) if k], key=str)


def test_empty_table(spark):
    assert near_dedup.find_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_signatures_estimate_likeness():
    r = np.random.default_rng(1)
    for n, common in ((1, 1), (7, 5), (200, 170), (3000, 2400)):
        v = r.integers(0, 1 << 52, 2 * n - common, dtype=np.uint64)
        a, b = np.sort(v[:n]), np.sort(v[n - common :])
        s = near_dedup.super_minhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]))
        assert abs((s[0] == s[1]).mean() - common / len(v)) < 0.11
        assert (s < np.iinfo(np.uint64).max).all()


@pytest.mark.parametrize("n", [1, 2, 40])
def test_components_of_a_path_and_a_star(spark, n):
    order = list(range(n + 1))
    random.Random(n).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(n)] + [(1000, 1000 + i) for i in range(1, n)] + [(None, 5), (7000, 7000)]
    got = {r.node: r.label for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[i] == 0 for i in range(n + 1)) and all(got[1000 + i] == 1000 for i in range(1, n))


def test_pair_whose_digests_collide_in_an_earlier_band():
    import pyarrow as pa

    slots = 256  # all 8-bit digests agree, so those of band 0 too, while the only bucket shared is one of a later band
    cols = {c: pa.array([v, v], pa.int64()) for c, v in (("key", 7), ("pa", 0), ("pb", 0), ("side", 2), ("n", 50), ("band", 1))}
    cols |= {"rep": pa.array([1, 2]), "label": pa.array([1, 2]), "sig": pa.array([b"x" * slots] * 2), "keys": pa.array([[1, 7, *range(10, 40)], [2, 7, *range(50, 80)]], pa.list_(pa.int64()))}
    out = [b.to_pydict() for b in near_dedup._across(slots, percent=85)(iter([pa.RecordBatch.from_pydict(cols)]))]
    assert out == [{"a": [1], "b": [2]}]
    cols["keys"] = pa.array([[5, 7, *range(32, 62)]] * 2, pa.list_(pa.int64()))  # band 0 is shared, so the pair is that bucket's
    assert not list(near_dedup._across(slots, percent=85)(iter([pa.RecordBatch.from_pydict(cols)])))


def test_repeated_ids_are_decided_row_by_row(spark):
    words = [f"w{i}" for i in range(100)]
    base, like, other = " ".join(words), " ".join([*words[:-1], "end"]), " ".join(reversed(words))
    sole = " ".join(f"z{i}" for i in range(100))
    rows = [(1, base, "a"), (1, base, "a"), (2, like, "b"), (2, other, "c"), (3, base, "d"), (3, like, "e"), (None, base, "f"), (None, base, "f"), (5, None, "g"), (5, None, "g"), (6, sole + " z", "h"), (6, sole + " y", "i")]
    kept = near_dedup.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string, n string").repartition(3))
    assert sorted(map(tuple, kept.collect()), key=str) == sorted([rows[i] for i in (0, 3, 6, 7, 8, 11)], key=str)


def test_defaults_are_five_words_and_four_fifths():
    assert (near_dedup.SHINGLE, near_dedup.PERCENT) == (5, 80) and near_dedup.SLOTS % near_dedup.BAND == 0


@pytest.mark.parametrize("pivots", [1, 8])
def test_large_bucket_whose_least_member_is_a_stranger(spark, pivots):
    """One header of 40 words makes buckets; the least id's text is like no other, the rest are a chain of likes and a few strangers."""
    r = random.Random(7)
    header = [f"h{i}" for i in range(60)]
    body = [f"b{i}" for i in range(60)]
    texts = [header + [r.choice("xyz") + str(r.randrange(99)) for _ in range(60)] for _ in range(4)]
    for _ in range(90):
        w = list(body)
        w[r.randrange(60)] = "other" + str(r.randrange(9))
        texts.append(header + w)
    docs = [(i, " ".join(t)) for i, t in enumerate(texts)]
    got = near_dedup.find_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), block=16, pivots=pivots, band=3).collect()
    assert sorted([tuple(x) for x in got], key=str) == brute(docs)


def test_recall_of_the_block_stage_near_the_threshold():
    """Pairs of likeness 0.85 and a little more, all in one bucket of their own: signatures leave out fewer than one in a thousand."""
    import pyarrow as pa

    r, n, lost = np.random.default_rng(3), 200, 0
    common, pairs = 186, 1500  # 186 of 2 * 200 - 186 = 214: 0.869
    sets, first = [], [0]
    for _ in range(pairs):
        v = r.integers(0, 1 << 52, 2 * n - common, dtype=np.uint64)
        sets += [np.sort(v[:n]), np.sort(v[n - common :])]
        first += [first[-1] + n, first[-1] + 2 * n]
    s = near_dedup.by_size(np.concatenate(sets), np.array(first), 256)
    sig = (near_dedup.mix(s) & np.uint64(255)).astype(np.uint8)
    ids = np.arange(2 * pairs)
    cols = {"key": ids // 2, "pa": ids * 0, "pb": ids * 0, "side": ids * 0 + 2, "rep": ids, "label": ids, "n": ids * 0 + n, "band": ids * 0}
    batch = pa.RecordBatch.from_pydict({**{c: pa.array(v) for c, v in cols.items()}, "sig": pa.array([x.tobytes() for x in sig]), "keys": pa.array([[int(i // 2), 1] for i in ids], pa.list_(pa.int64()))})
    found = {(a, b) for out in near_dedup._across(256, 85)(iter([batch])) for a, b in zip(out.column(0).to_pylist(), out.column(1).to_pylist())}
    assert found <= {(2 * i, 2 * i + 1) for i in range(pairs)} and len(found) > pairs - 2


def test_very_long_text_and_signature_groups(spark):
    long = " ".join(f"w{i % 50_000}" for i in range(120_000))
    docs = [(1, long), (2, long + " end"), (3, "a b c d e f"), (4, "a b c d e f"), (5, "a")]
    got = near_dedup.find_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {x.doc_id: x.component_id for x in got} == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}
    r = np.random.default_rng(0)
    n = np.array([0, 3, 40_000, 1, 7, 0])
    first = np.concatenate([[0], np.cumsum(n)])
    v = r.integers(0, 1 << 52, first[-1], dtype=np.uint64)
    assert (near_dedup.by_size(v, first, 64) == near_dedup.super_minhash(v, first, 64)).all()


@pytest.mark.parametrize("union", [20, 60, 300])
def test_variance_of_the_estimate(union):
    r, common = np.random.default_rng(union), union * 4 // 5
    side, sets, first = (union - common) // 2, [], [0]
    for _ in range(1000):
        v = r.integers(0, 1 << 52, common + 2 * side, dtype=np.uint64)
        sets += [np.sort(v[: common + side]), np.sort(np.r_[v[:common], v[common + side :]])]
        first += [first[-1] + common + side, first[-1] + 2 * (common + side)]
    s = near_dedup.by_size(np.concatenate(sets), np.array(first), 252)
    agree, j = (s[0::2] == s[1::2]).sum(axis=1), common / (common + 2 * side)
    assert 0.85 < agree.var() / (252 * j * (1 - j)) / near_dedup.variance_factor(252, [union])[0] < 1.15
