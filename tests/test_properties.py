"""Metamorphic tests: no feature looks ahead, scoring rows don't see each other, partitioning changes nothing; and small fixtures of known traps."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorwise.functions import expr as x
from priorwise.operators import ensemble, evaluate, history, linkage, models, sequence
from priorwise.sources import io


def game(spark, periods=(1, 2, 3, 4), seed=1, n=240):
    r = random.Random(seed)
    rows = [(i, r.randrange(4), r.choice("ab"), 1 + i * 4 // n, r.randrange(2), r.random()) for i in range(n)]
    return spark.createDataFrame([t for t in rows if t[3] in periods], "id long, entity long, cell string, period int, y int, v double")


def as_map(df, *keys):
    return {tuple(r[k] for k in keys): tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()}


@pytest.mark.parametrize("build", [
    lambda d: history.prior_period_triple(d, ["entity"], ["cell"], "period", "y"),
    lambda d: history.backoff_rate(d, ["entity"], ["cell"], "period", F.col("y")),
    lambda d: history.league_deviation(d.withColumn("league", F.col("entity") % 2), "entity", "cell", "league", "period", F.col("y")),
    lambda d: history.long_form_priors(d.withColumn("league", F.col("entity") % 2), "entity", "cell", "league", "period", F.col("y")),
    lambda d: sequence.last_k(d, "entity", "period", ["id"], "cell", 5),
    lambda d: history.modulation(d, "entity", "period", "v", F.col("y") == 1, 3),
])
def test_later_periods_change_nothing_before(spark, build):
    short, full = build(game(spark, (1, 2, 3))), build(game(spark))
    keys = [c for c in ("entity", "cell", "league", "period") if c in short.columns]
    a, b = as_map(short, *keys), as_map(full, *keys)
    assert a and all(b[k] == v for k, v in a.items())


def test_a_leaky_prior_is_caught(spark):
    build = lambda d: history.prior_period_triple(d, ["entity"], ["cell"], "period", "y", prior="all")
    a, b = as_map(build(game(spark, (1, 2, 3))), "entity", "cell", "period"), as_map(build(game(spark)), "entity", "cell", "period")
    assert any(b[k] != v for k, v in a.items())


def test_later_rows_change_nothing_before(spark):
    d = game(spark).withColumn("day", F.floor(F.col("id") / 20))
    for build in (
        lambda d: history.asof_deviation(d, "entity", "cell", ["id"], F.col("y")), lambda d: history.asof_cell_slope(d, "cell", "day", ["id"], "v", "y"),
        lambda d: sequence.change_features(d, "entity", ["id"], "cell"),
    ):
        a, b = as_map(build(d.where("id < 130")), "id"), as_map(build(d), "id")
        assert all(b[k] == v for k, v in a.items())


def test_bucketed_sums_equal_plain_ones(spark):
    d = game(spark).withColumn("day", F.floor(F.col("id") / 20))
    v = {"n": F.lit(1), "s": F.col("y")}
    a = as_map(history.asof_sums(d, ["cell"], ["id"], v).select("id", "n", "s"), "id")
    assert a == as_map(history.asof_sums_in_buckets(d, ["cell"], "day", ["id"], v).select("id", "n", "s"), "id")


def test_scored_rows_are_independent(spark):
    d = game(spark)
    frozen = history.frozen_triple(d, ["entity"], ["cell"], "period", 3, "y")

    def score(rows):
        out = history.apply_frozen(rows, frozen, ["entity", "cell"], {"rate": 0.5, "dev": 0.0})
        return as_map(out.select("id", "rate", "dev"), "id")

    rows = d.where("period = 4").unionByName(d.where("id = 200").withColumns({"id": F.lit(9999).cast("long"), "entity": F.lit(77).cast("long")}))
    full, some = score(rows), score(rows.where("id % 5 = 0 or id = 9999").orderBy(F.desc("id")).repartition(3))
    assert full[9999,] == (9999, 0.5, 0.0) and all(full[k] == v for k, v in some.items())
    plan = history.apply_frozen(rows, io.table(spark, "/root/testdata/sf0.001", "orders").select(F.col("o_orderkey").alias("entity"), F.col("o_orderstatus").alias("cell"), F.lit(0.1).alias("rate")), ["entity", "cell"], {"rate": 0.5})._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "Aggregate" not in plan


def test_history_survives_a_period_without_the_cell(spark):
    rows = [(1, "a", 1, 1), (1, "a", 1, 1), (1, "b", 2, 0), (1, "a", 3, 0), (2, "a", 3, 1)]
    d = spark.createDataFrame(rows, "entity long, cell string, period int, y int")
    got = as_map(history.prior_period_triple(d, ["entity"], ["cell"], "period", "y", prior=0.5).select("entity", "cell", "period", "n_prior", "s_prior"), "entity", "cell", "period")
    assert got[1, "a", 3][3:] == (2, 2.0) and got[2, "a", 3][3:] == (0, 0.0)


def test_adjacent_lead_differs_from_entity_lead(spark):
    rows = [(1, 1, 0.0, 0), (2, 2, 0.0, 0), (3, 1, 1.0, 1), (4, 2, 0.0, 1), (5, 2, 0.5, 2), (6, 1, 1.0, 3)]
    d = spark.createDataFrame(rows, "id long, entity long, rate double, n long")
    label = lambda **k: {r.id: r.label for r in sequence.reconstruct_label(d, "entity", ["id"], "rate", "n", **k).collect()}
    assert label() == {1: 1, 2: 0, 3: None, 4: 1, 5: None, 6: None}  # row 3 jumps by two
    assert label(adjacent=True) == {1: None, 2: None, 3: None, 4: 1, 5: None, 6: None}


def test_global_next_over_partitions(spark):
    d = spark.range(50).withColumn("id", F.col("id") * 3 % 53)
    got = {r.id: r["_following"] and r["_following"].id for r in sequence.global_next(d, ["id"], 7).collect()}
    ids = sorted(got)
    assert got == dict(zip(ids, [*ids[1:], None]))


def test_bins_on_edges(spark):
    d = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (3.0,), (-1.0,), (None,), (float("nan"),)], "v double")
    right = [r[0] for r in d.select(x.bin_right("v", [0, 1, 2])).collect()]
    assert right == [None, 0, 1, 1, None, None, None, None]
    assert d.select(x.bin_right("v", [0, 1, 2], lowest=True)).first()[0] == 0
    left = [r[0] for r in d.select(x.bin_left("v", F.array(F.lit(0.0), F.lit(1.0), F.lit(2.0)))).collect()]
    assert left == [1, 2, 2, 3, 3, 0, -1, -1]
    ties = spark.createDataFrame([(float(v),) for v in [1, 1, 1, 1, 2, 3]], "v double")
    assert [r.bin for r in models.quantile_bins(ties, "v", 4).collect()] == [0, 0, 0, 0, 1, 1]


def test_half_even_and_counts(spark):
    d = spark.createDataFrame([(2.5, 1), (3.5, 1), (None, 7), (0.3333333, 3)], "r double, n long")
    assert [r[0] for r in d.select(history.recovered_counts("r", "n")).collect()] == [2, 4, 0, 1]


def test_linkage_traps(spark):
    a = spark.createDataFrame([("k1", 1), ("k2", 2), ("k2", 3), ("k3", 4), ("k3", 5), (None, 6)], "k string, a long")
    b = spark.createDataFrame([("k1", 10), ("k2", 20), ("k2", 30), ("k3", 40), (None, 60)], "k string, b long")
    assert [(r.a, r.b) for r in linkage.unique_key_match(a, b, ["k"]).collect()] == [(1, 10)]
    pairs = sorted((r.a, r.b) for r in linkage.occurrence_pairing(a, b, ["k"], ["a"], ["b"]).where("k is not null").collect())
    assert pairs == [(1, 10), (2, 20), (3, 30)]
    more = sorted((r.a, r.b) for r in linkage.occurrence_pairing(a, b, ["k"], ["a"], ["b"], min_count=True).where("k is not null").collect())
    assert more == [(1, 10), (2, 20), (3, 30), (4, 40)]
    votes = spark.createDataFrame([(1, 7, 5), (1, 8, 5), (2, 7, 9), (3, 9, 1)], "a long, b long, n long")
    assert [(r.a, r.b) for r in linkage.mutual_best(votes, "a", "b", 3, 0.5).collect()] == [(2, 7)]
    with pytest.raises(ValueError):
        io.one_to_one(a.dropna(), b.dropna(), ["k"])


def test_template_and_contract(spark, tmp_path):
    t = spark.createDataFrame([("a",), ("b",), ("b",)], "row_id string")
    p = spark.createDataFrame([("b", 0.25), ("b", 0.25), ("z", 0.9)], "row_id string, p double")
    assert sorted((r.row_id, r.p, r.matched) for r in io.merge_template(t, p, "row_id", "p").collect()) == [("a", 0.5, False), ("b", 0.25, True), ("b", 0.25, True)]
    io.write_csv(p, str(tmp_path / "x"), gzip=True)
    back = io.read_csv(spark, str(tmp_path / "x"), "row_id string, p double", ["p"])
    assert sorted(r.p for r in back.collect()) == [0.25, 0.25, 0.9] and io.header(spark, str(tmp_path / "x")) == ["row_id", "p"]
    with pytest.raises(ValueError):
        io.require(p, ["p", "row_id"], ordered=True)
    assert io.outside_domain(t, "row_id", ["a"]).collect()[0].n == 2


def test_trees_from_arrays_equal_expressions(spark):
    import numpy as np

    d = game(spark)
    cols = [F.col("v"), F.col("entity")]
    expr = models.oblivious_trees(cols, np.array([[0, 1]]), np.array([[0.4, 1.5]]), np.array([[1.0, 2.0, 3.0, 4.0]]), 0.5)
    tree = {"feature": [0, 1, 1, -1, -1, -1, -1], "threshold": [0.4, 1.5, 1.5, 0, 0, 0, 0], "left": [1, 3, 5, 0, 0, 0, 0], "right": [2, 4, 6, 0, 0, 0, 0], "missing_left": [True] * 7, "value": [0, 0, 0, 1.0, 3.0, 2.0, 4.0]}
    assert all(abs(r[0] - r[1]) < 1e-12 for r in d.select(expr, models.tree_scores(cols, [tree], 0.5)).collect())


def test_models_and_scores(spark):
    d = game(spark).withColumn("p", x.clip(F.col("v"), 0.05, 0.95))
    slope, intercept = models.platt(d, "p", "y")
    assert abs(slope) < 2 and abs(intercept) < 2
    z = [r[0] for r in spark.createDataFrame([(0.5,), (0.975,), (None,), (1.0,)], "u double").select(models.inverse_normal(F.col("u"))).collect()]
    assert z[0] == 0 and abs(z[1] - 1.959964) < 1e-5 and z[2] is None and z[3] is None
    s = models.stratified_sample(d, "id", "period", 7)
    assert sorted(r["count"] for r in s.groupBy("period").count().collect()) == [7] * 4
    assert {r.fold for r in models.folds(d, "id", 3).collect()} == {0, 1, 2}
    assert d.select(ensemble.temper("p", 1.0, 0.0).alias("q"), "p").where("abs(p - q) > 1e-9").count() == 0
    b = evaluate.bootstrap(d, "id", F.col("v"), 50).first()
    c = evaluate.bootstrap(d.repartition(5), "id", F.col("v"), 50).first()
    assert b.low < b.mean < b.high and abs(b.low - c.low) < 1e-12 and b.wins == 50


def test_range_of_years_reaches_the_scan(spark):
    d = io.period_scan(io.table(spark, "/root/testdata/sf0.001", "lineitem"), "l_shipdate", 1997, 1998)
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(l_shipdate" in plan and d.where("year(l_shipdate) not in (1997, 1998)").count() == 0


def test_streams(spark, tmp_path):
    from priorwise.streaming import state

    e = io.table(spark, "/root/testdata/sf0.001", "events").withColumn("ts", F.col("ts").cast("timestamp")).withColumn("y", (F.col("value") > 100).cast("int"))
    e.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(e.schema).parquet(str(tmp_path / "in"))

    def run(df, mode, name):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).start()
        q.processAllAvailable()
        q.stop()
        return spark.table(name)

    got = as_map(run(state.windowed_rates(stream(), "ts", ["event_type"], F.col("y"), "1 day"), "complete", "w"), "event_type", "start")
    want = as_map(e.groupBy("event_type", F.window("ts", "1 day").alias("w")).agg(F.count("*").alias("n"), F.avg("y").alias("r")).select("event_type", "w.start", "w.end", "n", "r"), "event_type", "start")
    assert got == want
    assert run(state.gap_sessions(stream(), "ts", "user_id", "1 hour"), "complete", "g").agg(F.sum("n")).first()[0] == e.count()
    before = as_map(run(state.running_state(stream(), "user_id", ["ts", "event_id"], "event_id", "y"), "append", "s").select("event_id", "n_before", F.round("rate", 9)), "event_id")
    plain = history.asof_sums(e, ["user_id"], ["ts", "event_id"], {"n": F.lit(1), "s": F.col("y")}).select("event_id", "n", F.round((F.col("s") + 25.0) / (F.col("n") + 50.0), 9))
    assert before == as_map(plain, "event_id")


def test_joint_blend_and_attention(spark):
    import numpy as np

    d = game(spark).withColumns({"a": F.col("y") * 0.8 + 0.1, "b": F.lit(0.5)})
    w = evaluate.joint_blend(d, ["a", "b"], "y", "period", [0.5, 0.5], 1e-9)
    assert abs(w[0] - 1.25) < 1e-3 and abs(w[1] + 0.25) < 1e-2
    near = evaluate.joint_blend(d, ["a", "b"], "y", "period", [0.5, 0.5], 1e6)
    assert all(abs(v - 0.5) < 1e-3 for v in near)
    rows = spark.createDataFrame([([1, 2], 1), ([], 0), (None, 2)], "s array<int>, c int")
    table, layers = np.array([[0.0, 1.0], [1.0, 0.0], [1.0, 1.0]]), [(np.ones((4, 1)), np.zeros(1))]
    got = [r[0] for r in rows.select(models.attention_scores(F.col("s"), F.col("c"), table, layers)).collect()]
    a = np.exp(np.array([1.0, 1.0]) / np.sqrt(2))
    want = [1 + ((a / a.sum()) @ table[[1, 2]]).sum(), 1.0, 2.0]
    assert np.allclose(got, 1 / (1 + np.exp(-np.array(want))))


def test_arrays_and_contracts(spark, tmp_path):
    import numpy as np

    from priorwise.sources import arrays

    a = {"w": np.arange(6.0).reshape(2, 3), "n": np.array([1, 2], np.int32)}
    np.savez(tmp_path / "m.npz", **a)
    got = arrays.load_npz(spark, str(tmp_path / "m.npz"), ["w"], ["more"])
    assert got["more"] is None and np.array_equal(got["w"], a["w"])
    with pytest.raises(ValueError):
        arrays.load_npz(spark, str(tmp_path / "m.npz"), ["x"])
    arrays.save_arrays(spark, str(tmp_path / "p"), a)
    back = arrays.load_arrays(spark, str(tmp_path / "p"))
    assert all(np.array_equal(back[k], v) and back[k].dtype == v.dtype for k, v in a.items())
    d = game(spark)
    assert io.contract_digest(d) == io.contract_digest(d.limit(1)) != io.contract_digest(d.select("y", "id"))


@pytest.mark.parametrize("most", [10**6, 4])
def test_exact_quantiles(spark, most):
    from priorwise.functions.quantiles import exact_quantiles

    r = random.Random(2)
    data = [(r.choice([None, r.gauss(0, 1), 5.0, 5.0]), float(r.randrange(3)), None) for _ in range(3000)]
    df = spark.createDataFrame(data, "a double, b double, c double").repartition(5)
    ps = [0.0, 0.1, 0.333, 0.5, 0.9, 1.0]
    got = exact_quantiles(df, {"a": ps, "b": ps, "c": ps}, most=most, accuracy=50)
    want = df.agg(*[F.percentile(c, ps).alias(c) for c in "ab"]).first()
    assert all(abs(x - y) < 1e-12 for c in "ab" for x, y in zip(got[c], want[c])) and got["c"] == [None] * 6
    assert exact_quantiles(df.limit(0), {"a": [0.5]}) == {"a": [None]}


def test_inverse_normal(spark):
    from statistics import NormalDist

    from priorwise.operators import models

    ps = [1e-12, 1e-7, 0.001, 0.07, 0.075, 0.3, 0.5, 0.7, 0.925, 0.93, 0.999999]
    got = spark.createDataFrame([(p,) for p in [*ps, 0.0, 1.0, None]], "p double").select(models.inverse_normal(F.col("p"))).collect()
    assert all(abs(g[0] - NormalDist().inv_cdf(p)) < 1e-8 for g, p in zip(got, ps)) and all(g[0] is None for g in got[len(ps) :])


def test_bundle_and_cached_features(spark, tmp_path):
    from priorwise.sources import io

    io.save_bundle(spark, str(tmp_path / "b"), {"w": np.arange(6.0).reshape(2, 3)}, ["x", "y"], 0.4, season=2024)
    arrays, meta = io.load_bundle(spark, str(tmp_path / "b"))
    assert arrays["w"].shape == (2, 3) and meta == {"features": ["x", "y"], "prior": 0.4, "season": 2024}
    df = spark.createDataFrame([(1, 2.0)], "k long, v double")
    at = str(tmp_path / "c")
    assert [tuple(r) for r in io.cached_features(df, at, "1").collect()] == [(1, 2.0)]
    assert [tuple(r) for r in io.cached_features(df.withColumn("v", F.lit(9.0)), at, "1").collect()] == [(1, 2.0)]
    assert [tuple(r) for r in io.cached_features(df.withColumn("v", F.lit(9.0)), at, "2").collect()] == [(1, 9.0)]


def test_majority_map_of_texts(spark):
    from priorwise.operators import linkage

    votes = spark.createDataFrame([("x", "b", 2), ("x", "a", 2), ("y", "c", 1)], "a string, b string, n long")
    assert sorted(tuple(r)[:2] for r in linkage.majority_map(votes, "a", "b", 1, 0.0).collect()) == [("x", "a"), ("y", "c")]


def test_quantile_normal_finds_a_place_once(spark):
    d = spark.createDataFrame([(0.3,)], "v double")
    assert d.select(models.quantile_normal(F.col("v"), [0.0, 0.5, 1.0])).columns[0].count("filter(") == 2
