"""Fits, variants, identity maps and networks against plain loops."""

import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorwise.operators import calibrate, history, identity, linkage, models, variants
from priorwise.sources import io


def predictions(n=3000, seed=1):
    r = np.random.default_rng(seed)
    z = r.normal(-0.5, 1.2, n)
    y = (r.random(n) < 1 / (1 + np.exp(-(0.6 * z + 0.4)))).astype(int)
    p = np.clip(1 / (1 + np.exp(-z)), 1e-6, 1 - 1e-6)
    return p, y


def frame(spark, p, y, groups=1):
    rows = [(i, float(a), int(b), i % groups) for i, (a, b) in enumerate(zip(p, y))]
    return spark.createDataFrame([*rows, (-1, None, 1, 0), (-2, 0.5, None, 0)], "id long, p double, y int, g int").repartition(3)


def newton(z, y, scale, passes=10):
    b = 0.0
    for _ in range(passes):
        q = 1 / (1 + np.exp(-(scale * z + b)))
        d = q * (1 - q)
        b -= np.clip(2 * np.mean((q - y) * d) / (2 * np.mean(d * d + (q - y) * d * (1 - 2 * q))), -0.1, 0.1)
    return b, np.mean((1 / (1 + np.exp(-(scale * z + b))) - y) ** 2)


def test_intercepts(spark):
    p, y = predictions()
    z, scales = np.log(p / (1 - p)), [0.3, 0.6, 1.0, 1.4]
    d = frame(spark, p, y, 2)
    got = {(r.g, r.scale): r for r in calibrate.fit_intercepts(d, "p", "y", scales, "g").collect()}
    for g, s in itertools.product((0, 1), scales):
        b, e = newton(z[g::2], y[g::2], s)
        assert abs(got[g, s].intercept - b) < 1e-6 and abs(got[g, s].brier - e) < 1e-12 and got[g, s].n == 1500
    best = calibrate.best_temperature(d, "p", "y", scales, "g").orderBy("g").collect()
    assert [r.scale for r in best] == [min(scales, key=lambda s: newton(z[g::2], y[g::2], s)[1]) for g in (0, 1)]
    assert dict(calibrate.best_temperature(d, "p", "y", scales).dtypes) == {"scale": "double", "intercept": "double", "n": "bigint", "brier": "double", "skill": "double"}


def test_temperature(spark, monkeypatch):
    p, y = predictions(seed=2)
    z, passes = np.log(p / (1 - p)), []
    made = calibrate._sums
    monkeypatch.setattr(calibrate, "_sums", lambda *a: passes.append(1) or made(*a))
    got = calibrate.fit_temperature(frame(spark, p, y), "p", "y").first()
    assert len(passes) <= 10
    v = np.array([1.0, 0.0])
    for _ in range(60):  # Newton without bounds, from near the optimum
        q = 1 / (1 + np.exp(-(v[0] * z + v[1])))
        d, x = q * (1 - q), np.stack([z, np.ones(len(z))])
        h = (d * d + (q - y) * d * (1 - 2 * q)) * x[:, None, :] * x[None, :, :]
        v = v - np.clip(np.linalg.solve(h.mean(axis=2), (x * ((q - y) * d)).mean(axis=1)), -0.3, 0.3)
    assert abs(got.scale - v[0]) < 1e-6 and abs(got.intercept - v[1]) < 1e-6
    assert abs(got.brier - np.mean((1 / (1 + np.exp(-(v[0] * z + v[1]))) - y) ** 2)) < 1e-12
    for a, b in itertools.product((-0.01, 0.0, 0.01), repeat=2):  # no better point beside it
        assert np.mean((1 / (1 + np.exp(-((got.scale + a) * z + got.intercept + b))) - y) ** 2) >= got.brier - 1e-12


def test_fits_of_odd_tables(spark, monkeypatch):
    p, y = predictions(200)
    d = frame(spark, p, y, 3)
    assert calibrate.fit_intercepts(d.limit(0), "p", "y", [1.0]).count() == calibrate.fit_temperature(d.limit(0), "p", "y", "g").count() == calibrate.best_temperature(d.limit(0), "p", "y", [1.0]).count() == 0
    same = calibrate.fit_temperature(d.withColumn("y", F.lit(1)), "p", "y").first()  # all labels equal: no skill, and an end
    assert same.skill is None and same.brier < 0.1
    monkeypatch.setattr(calibrate, "GROUPS", 2)
    with pytest.raises(ValueError, match="groups"):
        calibrate.fit_intercepts(d, "p", "y", [1.0], "g")


def seeded(spark, n=400):
    r = np.random.default_rng(5)
    base, y = r.random(n), r.integers(0, 2, n)
    cols = {c: np.clip(base + r.normal(0, 0.1, n), 0, 1) for c in ("a1", "a2", "a3", "b1", "b2")}
    rows = [(int(i % 3), int(y[i]), *[float(cols[c][i]) for c in cols]) for i in range(n)]
    return spark.createDataFrame([*rows, (0, None, *[0.5] * 5)], "r int, y int, " + ", ".join(f"{c} double" for c in cols)), cols, y


def test_seed_combinations(spark):
    d, cols, y = seeded(spark)
    branches, routes = {"a": {"1": "a1", "2": "a2", "3": "a3"}, "b": {"1": "b1", "2": "b2"}}, {0: {"a": 1.0}, 1: {"a": 0.25, "b": 0.75}}
    route = np.arange(len(y)) % 3
    got = {r.combination: r for r in variants.seed_combinations(d, branches, routes, "r", "y", {"a": 2, "b": 1}).collect()}
    assert len(got) == 6
    for some, other in itertools.product(itertools.combinations("123", 2), "12"):
        a = (cols["a" + some[0]] + cols["a" + some[1]]) / 2
        e = np.where(route == 0, a, 0.25 * a + 0.75 * cols["b" + other]) - y
        one, known = got[f"a:{some[0]}+{some[1]} b:{other}"], route < 2
        rate = y[known].mean()
        assert abs(one.brier - (e[known] ** 2).mean()) < 1e-12 and abs(one.skill - 100000 * (1 - (e[known] ** 2).mean() / (rate * (1 - rate)))) < 1e-6
    with pytest.raises(ValueError, match="seeds"):
        variants.seed_combinations(d, branches, routes, "r", "y", {"a": 4, "b": 1})
    assert variants.seed_combinations(d.limit(0), branches, routes, "r", "y", {"a": 1, "b": 1}).count() == 0


def test_seed_extrapolation(spark):
    d, cols, y = seeded(spark)
    got = {r.seeds: r for r in variants.seed_extrapolation(d, ["a1", "a2", "a3"], "y", [1, 3, 8, 0]).collect()}
    noise = np.mean([np.var(cols[i] - cols[j]) for i, j in itertools.combinations(["a1", "a2", "a3"], 2)]) / 2
    rate = y.mean()
    c = 100000 * noise / (rate * (1 - rate))
    three = 100000 * (1 - np.mean((np.mean([cols[k] for k in ("a1", "a2", "a3")], 0) - y) ** 2) / (rate * (1 - rate)))
    for k, r in got.items():
        assert abs(r.skill - (three + c / 3 - (c / k if k else 0))) < 1e-6 and abs(r.per_seed - c) < 1e-6


def test_bootstrap_of_skills(spark):
    import hashlib

    p, y = predictions(300, 7)
    cands = {"p": p, "flat": np.full(300, 0.4), "sure": np.where(p > 0.5, 0.95, 0.05), "again": p}
    d = spark.createDataFrame([(i, int(y[i]), *[float(v[i]) for v in cands.values()]) for i in range(300)], "id long, y int, p double, flat double, sure double, again double")
    rounds, h = 50, [hashlib.md5(str(i).encode()).hexdigest() for i in range(300)]
    scores = []
    for i in range(rounds):
        w = np.zeros(300)
        for j in range(300):
            x = (int(h[j][:8], 16) + i * (2 * int(h[j][8:16], 16) + 1)) % 2**32
            for _ in range(2):
                x = ((x ^ (x >> 16)) * 0x45D9F3B) % 2**32
            w[j] = sum((x ^ (x >> 16)) >= cut for cut in variants.POISSON)
        rate = (w * y).sum() / w.sum()
        scores.append([100000 * (1 - (w * (v - y) ** 2).sum() / w.sum() / (rate * (1 - rate))) for v in cands.values()])
    s = np.array(scores)
    got = {r.candidate: r for r in variants.bootstrap_skill(d, "id", "y", {c: c for c in cands}, rounds).collect()}
    for k, name in enumerate(cands):
        want = [np.percentile(s[:, k], 2.5), s[:, k].mean(), np.percentile(s[:, k], 97.5), np.percentile(s[:, 0] - s[:, k], 2.5), np.percentile(s[:, 0] - s[:, k], 97.5)]
        r = got[name]
        assert np.allclose([r.skill_low, r.skill_mean, r.skill_high, r.diff_low, r.diff_high], want, atol=1e-6)
        assert r.wins == (np.isclose(s, s.max(axis=1, keepdims=True), rtol=0, atol=1e-6).argmax(axis=1) == k).sum() and r.first_ahead == (s[:, 0] - s[:, k] > 1e-6).sum()
    parts = [variants.bootstrap_sums(x, "id", "y", {"p": "p"}, 5) for x in (d.where("id < 100"), d.where("id >= 100"), d)]
    add = parts[0].unionByName(parts[1]).groupBy("round").agg(F.sum("w").alias("w"), F.sum("e0").alias("e0")).orderBy("round").collect()
    assert np.allclose([tuple(r) for r in add], [(r["round"], r["w"], r["e0"]) for r in parts[2].orderBy("round").collect()])


def test_poisson_weights():
    r = np.random.default_rng(3)
    h = r.integers(0, 2**32, (2, 200_000)).astype(np.uint64)
    w = variants.bootstrap_weights(*h, 17)
    other = variants.bootstrap_weights(*h, 18)
    assert abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03 and abs(np.corrcoef(w, other)[0, 1]) < 0.02


def plain_greedy(rows):
    used_a, used_b, out = set(), set(), []
    for a, b, n in sorted(rows, key=lambda r: (-r[2], r[0], r[1])):
        if a not in used_a and b not in used_b:
            used_a.add(a), used_b.add(b), out.append((a, b, n))
    return sorted(out)


@pytest.mark.parametrize("local", [0, 5, identity.LOCAL])
def test_greedy(spark, local):
    r = random.Random(local)
    rows = [(a, f"b{b}", r.randrange(1, 4)) for a in range(25) for b in r.sample(range(20), 6)]
    rows += [(100 + i, f"c{i // 2 + i % 2}", 50 - i) for i in range(9)]  # a chain, each edge less than the one before
    df = spark.createDataFrame([*rows, (None, "b1", 99), (1, None, 99)], "a long, b string, n long")
    got = sorted(tuple(x) for x in identity.greedy_assignment(df, "a", "b", local=local).collect())
    assert got == plain_greedy(rows)
    best = {(x.a, x.b) for x in linkage.mutual_best(df.dropna(), "a", "b", 1, 0.0).collect()}
    assert best < {(a, b) for a, b, _ in got}  # greedy goes on where mutual best ends
    assert identity.greedy_assignment(df.limit(0), "a", "b", local=local).count() == 0


def test_checked_map(spark):
    pairs = [("a1", 1, "L", "L")] * 9 + [("a1", 2, "L", "L")] + [("a2", 1, "R", "R")] * 8 + [("a3", 3, "L", "R")] * 9 + [("a4", 4, "L", None)] * 9 + [("a5", 5, "L", "L")] * 5 + [("a5", 6, "L", "L")] * 5 + [(None, 7, "L", "L")] * 9 + [("a6", 8, "L", "L")] * 2
    df = spark.createDataFrame(pairs, "a string, b int, l string, r string")
    v = identity.checked_votes(df, "a", "b", F.col("l") == F.col("r"))
    got = {r.a: (r.b, r.n_top, r.n_total, r.agreement) for r in identity.checked_map(v, "a", "b", 5, 0.85, 0.95).collect()}
    assert got == {"a1": (1, 9, 10, 1.0)}  # a2 loses 1 to a1, a3 and a4 fail the check, a5 the share, a6 the votes
    loose = {r.a: r.b for r in identity.checked_map(v, "a", "b", 1, 0.0, 0.0).collect()}
    assert loose == {"a1": 1, "a3": 3, "a4": 4, "a5": 5, "a6": 8}


def test_maps_grow_in_rounds(spark):
    """Each edge of one map lets one of the other be found: 1-x, then p-10, then 2-y, then q-20."""
    rows = [(1, "x", 5, "p")] * 3 + [(1, "x", 10, "q")] * 3 + [(2, "y", 10, "q")] * 3 + [(2, "y", 20, "s")] * 3 + [(3, "z", 99, "w")] * 3 + [(4, "x", 5, "p")] * 2
    df = spark.createDataFrame(rows, "a int, b string, c int, d string")
    known = spark.createDataFrame([(5, "p")], "c int, d string")
    always = F.lit(True)
    ab, cd = identity.grow_both(df, df.select("a", "b").limit(0), known, "a", "b", "c", "d", always, always, least=2, share=0.5, agreement=0.5)
    assert sorted(tuple(r) for r in ab.collect()) == [(1, "x", 1), (2, "y", 2)] and sorted(tuple(r) for r in cd.collect()) == [(5, "p", 0), (10, "q", 1), (20, "s", 2)]
    with pytest.raises(RuntimeError, match="grow"):
        identity.grow_both(df, df.select("a", "b").limit(0), known, "a", "b", "c", "d", always, always, rounds=1, least=2, share=0.5, agreement=0.5)


def test_query_maps_decide(spark):
    """In the registered queries' tables the check, the uniqueness, later rounds and both kinds of stages each make a difference."""
    from priorwise.plans import identity_queries as q

    sf = "/root/testdata/sf0.01"
    v = q.part_votes(spark, sf)
    top, loose = q.checked_map(spark, sf).count(), identity.checked_map(v, "part", "lane", 3, 0.034, 0.0).count()
    checked = v.groupBy("part").agg(F.max(F.struct("n", -F.col("lane"), "agree")).alias("m"), F.sum("n").alias("all")).where("m.agree >= 0.64 * m.n and m.n >= 0.034 * all").count()
    assert 0 < top < checked < v.select("part").distinct().count() and loose > 0  # uniqueness and the check each drop edges
    rounds = {r["round"]: r["count"] for r in q.grow_both(spark, sf).groupBy("round").count().collect()}
    assert len(rounds) > 2 and max(rounds) < q.GROWN
    stages = {r["stage"]: r["count"] for r in q.staged_pairing(spark, sf).groupBy("stage").count().collect()}
    assert set(stages) == {1, 2, 3, 4} or len(stages) >= 3


def test_staged_pairing(spark):
    left = spark.createDataFrame([(1, "a", None, 5), (2, "a", "x", 1), (3, "a", "x", 2), (4, "b", "x", 1), (5, None, None, 1), (6, "c", "u", 1), (7, "c", "v", 2)], "i int, k string, m string, o int")
    right = spark.createDataFrame([(11, "a", None, 9), (12, "a", "x", 2), (13, "a", "x", 1), (14, None, None, 7), (15, "c", "w", 1), (16, "c", "t", 0), (17, "b", "x", 1), (18, "b", "x", 2)], "j int, k string, m string, o int")
    got = sorted(tuple(r) for r in identity.staged_pairing(left, right, [["k", "m"], ["k"]], "i", "j", ["o"], ["o"]).collect())
    assert got == [(1, 11, 1, 1), (2, 13, 2, 1), (3, 12, 2, 2), (5, 14, 1, 1), (6, 16, 4, 1), (7, 15, 4, 2)]
    assert identity.staged_pairing(left.limit(0), right, [["k"]], "i", "j", ["o"], ["o"]).count() == 0


def test_linked_triple_sees_no_future(spark):
    sensor = spark.createDataFrame([(i % 7, "c" + str(i % 2), 2000 + i % 4, i % 3 == 0) for i in range(300)], "s int, cell string, period int, hit boolean").withColumn("hit", F.col("hit").cast("int"))
    link = spark.createDataFrame([(i, f"e{i % 3}") for i in range(6)] + [(6, None)], "s int, entity string")
    wanted = spark.createDataFrame([("e0", "c0", 2002), ("e1", "c1", 2002), ("new", "c0", 2002), ("e0", "c0", 2000)], "entity string, cell string, period int")
    make = lambda s: sorted((r.entity, r.cell, r.period, round(r.rate, 9), round(r.dev, 9), round(r.conf, 9)) for r in history.linked_triple(s, link, "s", wanted, "entity", "cell", "period", "hit", 10.0).collect())
    got = make(sensor)
    assert got == make(sensor.withColumn("hit", F.when(F.col("period") >= 2002, 1 - F.col("hit")).otherwise(F.col("hit")))) and len(got) == 4
    rows = [(f"e{s % 3}", c, h) for s, c, p, h in (tuple(r) for r in sensor.collect()) if s < 6 and p < 2002]
    g, cell = np.mean([h for *_, h in rows]), np.mean([h for _, c, h in rows if c == "c0"])
    mine, here = [h for e, _, h in rows if e == "e0"], [h for e, c, h in rows if e == "e0" and c == "c0"]
    rate, base = (sum(here) + 10 * cell) / (len(here) + 10), (sum(mine) + 10 * g) / (len(mine) + 10)
    assert got[1] == ("e0", "c0", 2002, round(rate, 9), round(rate - base, 9), round(math.log1p(len(here)), 9))
    assert got[0][:2] == ("e0", "c0") and got[0][3:] == (0.5, 0.0, 0.0)


def some_trees(r, n=6, features=3):
    """Random trees of depth 3 whose borders repeat."""
    out = []
    for _ in range(n):
        t = {"feature": [], "threshold": [], "left": [], "right": [], "missing_left": [], "value": []}
        for i in range(15):
            leaf = i >= 7
            for k, v in (("feature", -1 if leaf else r.randrange(features)), ("threshold", 0.0 if leaf else r.choice([0.25, 0.5, 0.75])), ("left", i if leaf else 2 * i + 1), ("right", i if leaf else 2 * i + 2), ("missing_left", r.random() < 0.5), ("value", r.random())):
                t[k].append(v)
        out.append({k: np.array(v) for k, v in t.items()})
    return out


def test_shared_splits(spark):
    r = random.Random(4)
    trees = some_trees(r)
    features, borders, codes = models.shared_splits(trees)
    assert len(features) <= 9 < sum((t["feature"] >= 0).sum() for t in trees)  # compared once each, not once a node
    assert all((features[c[t["feature"] >= 0]] == t["feature"][t["feature"] >= 0]).all() and (borders[c[t["feature"] >= 0]] == t["threshold"][t["feature"] >= 0]).all() for t, c in zip(trees, codes))
    df = spark.createDataFrame([tuple(None if r.random() < 0.1 else r.choice([r.random(), 0.25, 0.5]) for _ in range(3)) for _ in range(300)], "x double, y double, z double")
    cols = [F.col(c) for c in "xyz"]
    got = df.select(models.tree_scores(cols, trees, 0.3).alias("a"), models.shared_tree_scores(cols, trees, 0.3, cells=100).alias("b")).collect()
    assert all(abs(x.a - x.b) < 1e-12 for x in got) and len({round(x.b, 6) for x in got}) > 20
    only_leaf = [{"feature": np.array([-1]), "threshold": np.array([0.0]), "left": np.array([0]), "right": np.array([0]), "missing_left": np.array([True]), "value": np.array([2.0])}]
    assert df.select(models.shared_tree_scores(cols, only_leaf).alias("b")).distinct().collect()[0].b == 2.0


def test_forest(spark):
    r = random.Random(6)
    df = spark.createDataFrame([(r.random(), r.random()) for _ in range(500)], "x double, z double").withColumn("y", (F.col("x") + 0.2 * F.col("z") > 0.6).cast("int"))
    model, trees = models.random_forest(df, ["x", "z"], "y", trees=5, depth=4)
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    scored = model.transform(VectorAssembler(inputCols=["x", "z"], outputCol="_f").transform(df))
    got = scored.select(vector_to_array("probability")[1].alias("a"), models.tree_scores([F.col("x"), F.col("z")], trees).alias("b"), models.shared_tree_scores([F.col("x"), F.col("z")], trees).alias("c"), "y").collect()
    assert all(abs(g.a - g.b) < 1e-9 and abs(g.a - g.c) < 1e-9 for g in got) and np.mean([(g.a > 0.5) == g.y for g in got]) > 0.95


def test_attention_network(spark):
    r = np.random.default_rng(8)
    net = {"table0": r.normal(size=(4, 3)), "seq0": r.normal(size=(5, 2)), "seq1": r.normal(size=(6, 3)), "query": r.normal(size=(4, 2)), "att0_w": r.normal(size=(12, 4)), "att0_b": r.normal(size=4), "att1_w": r.normal(size=4), "att1_b": 0.2, "dense0_w": r.normal(size=(10, 6)), "dense0_b": r.normal(size=6), "dense1_w": r.normal(size=(6, 1)), "dense1_b": np.zeros(1)}
    rows = []
    for i in range(60):
        n = [0, 1, 3, 40][i % 4]
        s0, s1 = [int(v) for v in r.integers(0, 5, n)], [int(v) for v in r.integers(0, 6, n)]
        if n == 3:
            s0[1] = None
        rows.append((float(r.normal()), None if i == 7 else float(r.normal()), int(r.integers(-1, 6)), None if i == 8 else s0, None if i == 8 else s1, None if i == 9 else int(r.integers(0, 4))))

    def plain(x, x2, c, s0, s1, q):
        ask = net["query"][q or 0]
        pairs = [(a, b) for a, b in zip(s0 or [], s1 or []) if a is not None and b is not None] or [(0, 0)]
        states = [np.concatenate([net["seq0"][a], net["seq1"][b]]) for a, b in pairs]
        logits = []
        for s in states:
            wide = np.array([ask[j % 2] for j in range(5)])
            logits.append(np.maximum(np.concatenate([s, ask, s * wide]) @ net["att0_w"] + net["att0_b"], 0) @ net["att1_w"] + net["att1_b"])
        w = np.exp(np.array(logits) - max(logits))
        h = np.concatenate([[x, x2 or 0.0], net["table0"][c if 0 <= c < 4 else 0], (w / w.sum()) @ np.array(states)])
        h = np.maximum(h @ net["dense0_w"] + net["dense0_b"], 0) @ net["dense1_w"] + net["dense1_b"]
        return 1 / (1 + math.exp(-h[0]))

    df = spark.createDataFrame(rows, "x double, x2 double, c int, s0 array<int>, s1 array<int>, q int").coalesce(1)
    for cells in (1, 2000, 1 << 20):
        got = df.select(models.attention_network([F.col("x"), F.col("x2")], [F.col("c")], [F.col("s0"), F.col("s1")], F.col("q"), net, cells).alias("p"), "*").collect()
        assert all(abs(g.p - plain(*g[1:])) < 1e-9 for g in got)


def test_history_is_state(spark, tmp_path):
    path = str(tmp_path / "h")
    d = spark.createDataFrame([(k, 2000 + p, 1, float(p)) for k in "ab" for p in range(4)], "k string, period int, n int, s double")
    io.save_history(d.where("period < 2003"), path, "period")
    io.save_history(d.where("period >= 2002").withColumn("s", F.col("s") * 10), path, "period")  # 2002 anew, 2003 added
    got = lambda **how: sorted(tuple(r) for r in io.load_history(spark, path, ["k"], "period", **how).collect())
    assert got() == [("a", 4, 0 + 1 + 20 + 30), ("b", 4, 51)] and got(before=2003) == [("a", 3, 21), ("b", 3, 21)] and got(before=2003, last=1) == [("a", 1, 20), ("b", 1, 20)]
    plan = io.load_history(spark, path, ["k"], "period", before=2002)._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*period[^\]]*< 2002", plan)


def test_sources_that_check(spark, tmp_path):
    a = spark.createDataFrame([(1, "t"), (2, "u"), (3, "v")], "k int, x string")
    p = spark.createDataFrame([(1, 0.5), (3, 0.25), (2, 0.75)], "k int, p double")
    assert sorted(tuple(r) for r in io.checked_template(a, p, "k", "p").collect()) == [(1, "t", 0.5), (2, "u", 0.75), (3, "v", 0.25)]
    more = spark.createDataFrame([(1, 0.1), (9, 0.1)], "k int, p double")
    for bad in (p.where("k < 3"), p.unionByName(more.where("k = 9")), p.unionByName(more.where("k = 1")), p.withColumn("p", F.when(F.col("k") != 2, F.col("p"))), p.withColumn("p", F.lit(float("nan")))):
        with pytest.raises(ValueError):
            io.checked_template(a, bad, "k", "p")
    (tmp_path / "m.csv").write_text("\ufeffid,name,z\n1,a,0\n1,a,1\n2,b,2\n3,,3\n", encoding="utf-8")
    assert sorted(tuple(r) for r in io.lookup_csv(spark, str(tmp_path / "m.csv"), "id", "name", "id int, name string, z int").collect()) == [(1, "a"), (2, "b")]
    (tmp_path / "n.csv").write_text("id,name\n1,a\n1,b\n")
    with pytest.raises(ValueError, match="several"):
        io.lookup_csv(spark, str(tmp_path / "n.csv"), "id", "name")
    rows = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "c"), ("", "c"), ("a", "bc")], "x string, y string")
    assert rows.select(io.row_digest(["x", "y"])).distinct().count() == 4
    assert io.config_digest({"a": 1, "b": [2, "é"]}) == io.config_digest({"b": [2, "é"], "a": 1}) != io.config_digest({"a": 2})


def test_hash_sample(spark):
    d = spark.range(20_000)
    small, large = ({r.id for r in io.hash_sample(d.repartition(n), "id", share, 3).collect()} for n, share in ((2, 0.1), (5, 0.3)))
    assert small < large and abs(len(small) - 2000) < 200 and abs(len(large) - 6000) < 300 and not io.hash_sample(d, "id", 0.0).count()


def test_out_of_fold(spark):
    """The general form and the form for rates agree; a key's own fold never counts."""
    r = random.Random(2)
    d = spark.createDataFrame([(i, r.choice(["a", "b", None]), i % 3, r.randrange(2)) for i in range(120)] + [(500, "once", 0, 1)], "id int, k string, f int, y int")

    def fit(train):
        rate = train.groupBy(F.struct("k").alias("_s")).agg(F.avg("y").alias("p"))
        return lambda rows: rows.withColumn("_s", F.struct("k")).join(rate, "_s", "left").drop("_s")

    want = {x.id: x.p for x in models.out_of_fold(d, "f", range(3), fit).collect()}
    got = {x.id: x.p for x in models.out_of_fold_rates(d, ["k"], "f", "y").collect()}
    assert got.keys() == want.keys() and all((got[i] is None) == (want[i] is None) and (got[i] is None or abs(got[i] - want[i]) < 1e-12) for i in want) and got[500] is None


def scans(df):
    return df._jdf.queryExecution().optimizedPlan().toString().count("Relation [")


def test_plans_read_once(spark):
    """Rates by origin and by fold read the rows once (and once more for the first period), whatever the number of periods and folds."""
    from priorwise.operators import evaluate

    d = io.table(spark, "/root/testdata/sf0.001", "lineitem").withColumns({"period": F.year("l_shipdate"), "y": (F.col("l_returnflag") == "R").cast("int"), "fold": F.col("l_orderkey") % 50})
    assert scans(evaluate.rolling_rates(d, ["l_linestatus"], "period", "y", 3)) == 2
    assert scans(models.out_of_fold_rates(d, ["l_suppkey"], "fold", "y")) == 2
    two, ten = (evaluate.backfit(d.withColumn("p", F.lit(0.25)), "p", "y", "l_linestatus", "fold", n) for n in (2, 10))
    size = lambda df: len(df._jdf.queryExecution().optimizedPlan().toString().splitlines())
    assert size(two) == size(ten) and scans(ten) == 0


def test_rolling_origins(spark):
    from priorwise.operators import evaluate

    d = spark.createDataFrame([(k, p, int((p * 7 + i) % 3 == 0)) for k in "ab" for p in (2000, 2001, 2003, 2004) for i in range(5)], "k string, period int, y int")
    got = {(r.k, r.period): r.rate for r in evaluate.rolling_rates(d, ["k"], "period", "y", 2).collect()}
    seen = {}
    for t, train, test in evaluate.rolling_origin(d, "period", 2):
        for r in test.select("k").distinct().join(train.groupBy("k").agg(F.avg("y").alias("p")), "k", "left").collect():
            seen[r.k, t] = r.p
    assert got.keys() == seen.keys() == {(k, p) for k in "ab" for p in (2003, 2004)} and all(abs(got[x] - seen[x]) < 1e-12 for x in got)


def test_next_rows_with_equal_firsts(spark):
    """Rows of one first value are dealt out over several ranges."""
    from priorwise.operators import sequence

    d = spark.createDataFrame([(7, i) for i in range(300)] + [(8, 0)], "a int, b int").repartition(4)
    got = {(r.a, r.b): r["_following"] and tuple(r["_following"]) for r in sequence.global_next(d, ["a", "b"], 5).collect()}
    assert got == {**{(7, i): (7, i + 1) for i in range(299)}, (7, 299): (8, 0), (8, 0): None}
    assert sequence.global_next(d.limit(0), ["a", "b"]).count() == 0
