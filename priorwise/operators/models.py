"""Fitted transforms and models: fold statistics, quantile bins, clusters, binned logistic regression, tree scoring from arrays."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import bin_array, bin_left
from ..functions.quantiles import exact_quantiles


def quantile_edges(df: DataFrame, column: str, k: int) -> list[float]:
    """Edges of k bins with equal counts (linear interpolation), equal edges once: k + 1 numbers at most."""
    return sorted(set(exact_quantiles(df, {column: [i / k for i in range(k + 1)]})[column]) - {None})


def quantile_bins(df: DataFrame, column: str, k: int, name: str = "bin") -> DataFrame:
    """Right-closed quantile bins, the first with its left edge; null stays null."""
    edges = quantile_edges(df, column, k)
    return df.withColumn(name, bin_array(column, F.array(*[F.lit(float(e)) for e in edges])) if len(edges) > 1 else F.when(F.col(column).isNotNull(), 0))


def fit_standard(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float, float]]:
    """Median, mean and population deviation (1 if 0) after the median has filled nulls, of each column: exact medians by
    brackets and one aggregate."""
    med = {c: v[0] if v[0] is not None else 0.0 for c, v in exact_quantiles(df, {c: [0.5] for c in columns}).items()}
    filled = [F.coalesce(F.col(c).cast("double"), F.lit(float(med[c]))) for c in columns]
    row = df.agg(*[F.avg(f).alias(f"m{i}") for i, f in enumerate(filled)], *[F.stddev_pop(f).alias(f"s{i}") for i, f in enumerate(filled)]).first()
    return {c: (float(med[c]), row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i, c in enumerate(columns)}


def standardise(df: DataFrame, fitted: dict[str, tuple[float, float, float]]) -> DataFrame:
    """Columns filled and standardised, with <column>_missing flags."""
    out = {f"{c}_missing": F.col(c).isNull().cast("int") for c in fitted}
    return df.withColumns(out).withColumns({c: (F.coalesce(F.col(c).cast("double"), F.lit(m)) - mean) / sd for c, (m, mean, sd) in fitted.items()})


def kmeans(df: DataFrame, features: str, k: int = 8, seed: int = 7, sample: float | None = None, name: str = "cluster") -> DataFrame:
    """Clusters of an array column; fitted on a hash sample of the rows if given, predicted on all."""
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    d = df.withColumn("_v", array_to_vector(F.col(features).cast("array<double>")))
    fit = d if sample is None else d.where(F.pmod(F.xxhash64(features), F.lit(10_000)) < int(sample * 10_000))
    model = KMeans(k=k, seed=seed, featuresCol="_v", predictionCol=name).fit(fit)
    return model.transform(d).drop("_v")


def bin_logit(df: DataFrame, numeric: Sequence[str], label: str, k: int = 8, reg: float = 1e-3, weight: str | None = None, name: str = "p") -> DataFrame:
    """A logistic regression on one-hot quantile bins (left-closed, null its own): an additive model of step functions."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import OneHotEncoder, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    d = df
    for c in numeric:
        edges = quantile_edges(df, c, k)[1:-1]
        d = d.withColumn(f"_b_{c}", (bin_left(c, F.array(*[F.lit(float(e)) for e in edges])) + 1).cast("double"))
    lr = LogisticRegression(featuresCol="_f", labelCol=label, regParam=reg, maxIter=50, **({"weightCol": weight} if weight else {}))
    stages = [OneHotEncoder(inputCols=[f"_b_{c}" for c in numeric], outputCols=[f"_o_{c}" for c in numeric], handleInvalid="keep", dropLast=False), VectorAssembler(inputCols=[f"_o_{c}" for c in numeric], outputCol="_f"), lr]
    out = Pipeline(stages=stages).fit(d).transform(d)
    return out.withColumn(name, vector_to_array("probability")[1]).select(*df.columns, name)


def platt(df: DataFrame, p: str, label: str) -> tuple[float, float]:
    """(slope, intercept) of a logistic regression of the label on logit(p)."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    from ..functions.expr import logit

    m = LogisticRegression(featuresCol="_f", labelCol="_y").fit(df.select(array_to_vector(F.array(logit(p))).alias("_f"), F.col(label).cast("double").alias("_y")))
    return float(m.coefficients[0]), float(m.intercept)


def oblivious_trees(columns: Sequence[Column], features: np.ndarray, borders: np.ndarray, leaves: np.ndarray, bias: float = 0.0) -> Column:
    """Sum of oblivious trees (trees by depth: feature numbers and borders; trees by 2 ** depth: leaf values; bit j is x > border of level j)
    as expressions of the JVM; a null goes left."""
    total = F.lit(float(bias))
    for f, b, v in zip(features, borders, leaves):
        leaf = F.lit(0)
        for j, (i, x) in enumerate(zip(f, b)):
            leaf = leaf + F.when(columns[int(i)] > float(x), 1 << j).otherwise(0)
        total = total + F.element_at(F.array(*[F.lit(float(y)) for y in v]), leaf + 1)
    return total


def tree_scores(columns: Sequence[Column], trees: Sequence[dict], bias: float = 0.0) -> Column:
    """Sum of generic binary trees as arrays (feature, threshold, left, right, missing_left, value; feature < 0 is a leaf), scored batch by
    batch: for ensembles too large for expressions."""

    @F.pandas_udf("double")
    def score(*xs: pd.Series) -> pd.Series:
        m = np.stack([x.to_numpy(float) for x in xs], 1)
        out = np.full(len(m), bias)
        for t in trees:
            f, th, left, right, ml, v = (np.asarray(t[k]) for k in ("feature", "threshold", "left", "right", "missing_left", "value"))
            at = np.zeros(len(m), int)
            while (live := f[at] >= 0).any():
                i = at[live]
                x = m[live, f[i]]
                go_left = np.where(np.isnan(x), ml[i], x <= th[i])
                at[live] = np.where(go_left, left[i], right[i])
            out += v[at]
        return pd.Series(out)

    return score(*columns)


# Coefficients of algorithm AS 241 (normal quantiles to 16 digits), centre, middle and tail.
AS241 = {
    "centre": ([3.3871328727963666080e0, 1.3314166789178437745e2, 1.9715909503065514427e3, 1.3731693765509461125e4, 4.5921953931549871457e4, 6.7265770927008700853e4, 3.3430575583588128105e4, 2.5090809287301226727e3], [1.0, 4.2313330701600911252e1, 6.8718700749205790830e2, 5.3941960214247511077e3, 2.1213794301586595867e4, 3.9307895800092710610e4, 2.8729085735721942674e4, 5.2264952788528545610e3]),
    "middle": ([1.42343711074968357734e0, 4.63033784615654529590e0, 5.76949722146069140550e0, 3.64784832476320460504e0, 1.27045825245236838258e0, 2.41780725177450611770e-1, 2.27238449892691845833e-2, 7.74545014278341407640e-4], [1.0, 2.05319162663775882187e0, 1.67638483018380384940e0, 6.89767334985100004550e-1, 1.48103976427480074590e-1, 1.51986665636164571966e-2, 5.47593808499534494600e-4, 1.05075007164441684324e-9]),
    "tail": ([6.65790464350110377720e0, 5.46378491116411436990e0, 1.78482653991729133580e0, 2.96560571828504891230e-1, 2.65321895265761230930e-2, 1.24266094738807843860e-3, 2.71155556874348757815e-5, 2.01033439929228813265e-7], [1.0, 5.99832206555887937690e-1, 1.36929880922735805310e-1, 1.48753612908506148525e-2, 7.86869131145613259100e-4, 1.84631831751005468180e-5, 1.42151175831644588870e-7, 2.04426310338993978564e-15]),
}


def _once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is computed once a row, however often f names it."""
    return F.element_at(F.transform(F.array(value), f), 1)


def inverse_normal(c: Column) -> Column:
    """Standard normal quantiles of probabilities in (0, 1), null outside: rational approximations as expressions of the JVM."""

    def ratio(name: str, x: Column) -> Column:
        up, down = [reduce(lambda s, k: s * x + k, reversed(k[:-1]), F.lit(k[-1])) for k in AS241[name]]
        return up / down

    def at(p: Column) -> Column:
        q = p - 0.5
        near = q * _once(0.180625 - q * q, lambda s: ratio("centre", s))
        far = _once(F.sqrt(-F.log(F.least(p, 1 - p))), lambda r: F.when(r <= 5, ratio("middle", r - 1.6)).otherwise(ratio("tail", r - 5)))
        return F.when((p > 0) & (p < 1), F.when(F.abs(q) <= 0.425, near).otherwise(F.signum(q) * far))

    return _once(c, at)


def fit_quantile_normal(df: DataFrame, column: str, n: int = 100) -> list[float]:
    """n quantiles of a column, from its least to its largest value."""
    return exact_quantiles(df, {column: [i / (n - 1) for i in range(n)]})[column]


def quantile_normal(c: Column, quantiles: Sequence[float], clip: float = 1e-7) -> Column:
    """A value's place among fitted quantiles (linear between them; of equal ones the middle), as a standard normal quantile; null stays null."""
    q, k = F.array(*[F.lit(float(v)) for v in quantiles]), len(quantiles)

    def place(below: Column, upto: Column) -> Column:
        a, b = F.element_at(q, F.greatest(below, F.lit(1))), F.element_at(q, F.least(below + 1, F.lit(k)))
        between = (below - 1) + (c - a) / (b - a)
        return F.when(c <= q[0], 0).when(c >= q[k - 1], k - 1).when(upto > below, (below + upto - 1) / 2).otherwise(between)

    found = _once(F.size(F.filter(q, lambda v: v < c)), lambda below: _once(F.size(F.filter(q, lambda v: v <= c)), lambda upto: place(below, upto)))
    return F.when(c.isNotNull(), inverse_normal(F.greatest(F.lit(clip), F.least(F.lit(1 - clip), found / max(k - 1, 1)))))


def fit_codes(df: DataFrame, column: str, most: int = 10_000) -> list:
    """The sorted different values of a column of few (counted: more than `most` raises)."""
    got = [r[0] for r in df.select(column).dropna().distinct().limit(most + 1).collect()]
    if len(got) > most:
        raise ValueError(f"{column} has more than {most} values")
    return sorted(got)


def ordinal_codes(c: Column, levels: Sequence) -> Column:
    """0 to N - 1 in the order of fitted levels, -1 for unknown values and null."""
    return F.coalesce(F.array_position(F.array(*[F.lit(v) for v in levels]), c).cast("int") - 1, F.lit(-1)) if levels else F.lit(-1)


def batch_ensemble(numbers: Sequence[Column], codes: Sequence[Column], net: dict[str, np.ndarray], rows: int = 2048) -> Column:
    """A batch-ensemble network's mean probability from its arrays. Numbers are embedded as relu(x w + b) each, codes are one-hot. Each block
    has one weight matrix for all k members, which differ by scales of its inputs (r) and outputs (s) and a bias; heads are the members' own.

    net: embed_w, embed_b (numbers by d), cards (levels of each code), and for each block i: block{i}_w (out by in), block{i}_r (k by in),
    block{i}_s and block{i}_b (k by out); head_w (k by in), head_b (k). A code outside its levels counts for nothing; NaN and null as 0."""
    cards, n = [int(v) for v in net["cards"]], len(numbers)
    n_blocks = sum(1 for k in net if k.startswith("block") and k.endswith("_w"))

    def forward(x: np.ndarray, z: np.ndarray) -> np.ndarray:
        e = np.maximum(x[:, :, None] * net["embed_w"] + net["embed_b"], 0).reshape(len(x), -1)
        hot = [(z[:, [j]] == np.arange(c)).astype(float) for j, c in enumerate(cards)]
        h = np.concatenate([e, *hot], 1)[:, None, :]
        for i in range(n_blocks):
            h = np.maximum((h * net[f"block{i}_r"]) @ net[f"block{i}_w"].T * net[f"block{i}_s"] + net[f"block{i}_b"], 0)
        out = (h * net["head_w"]).sum(axis=2) + net["head_b"]
        return (1 / (1 + np.exp(-out))).mean(axis=1)

    return _in_slices([*numbers, *codes], lambda m: forward(m[:, :n], m[:, n:]), rows)


def periodic_network(numbers: Sequence[Column], codes: Sequence[Column], net: dict[str, np.ndarray], rows: int = 8192) -> Column:
    """A network on periodic embeddings: each number x becomes relu([cos 2 pi f x, sin 2 pi f x] w + b) with its own f (m), w (2 m by d) and b,
    codes take rows of their tables, and dense layers with ReLU between give a logit.

    net: freq (numbers by m), embed_w (numbers by 2 m by d), embed_b (numbers by d), table{j} for each code, dense{i}_w (in by out), dense{i}_b."""
    n_dense, n = sum(1 for k in net if k.startswith("dense") and k.endswith("_w")), len(numbers)

    def forward(m: np.ndarray) -> np.ndarray:
        x, z = m[:, :n], m[:, n:].astype(int)
        angle = 2 * np.pi * x[:, :, None] * net["freq"]
        waves = np.concatenate([np.cos(angle), np.sin(angle)], 2)
        e = np.maximum(np.einsum("rfi,fid->rfd", waves, net["embed_w"]) + net["embed_b"], 0).reshape(len(m), -1)
        h = np.concatenate([e, *[net[f"table{j}"][z[:, j]] for j in range(z.shape[1])]], 1)
        for i in range(n_dense):
            h = h @ net[f"dense{i}_w"] + net[f"dense{i}_b"]
            h = np.maximum(h, 0) if i < n_dense - 1 else h
        return 1 / (1 + np.exp(-h[:, 0]))

    return _in_slices([*numbers, *codes], forward, rows)


def _in_slices(columns: Sequence[Column], forward, rows: int) -> Column:
    """forward over the stacked columns, some rows at a time: wide layers of a whole batch would not fit."""

    @F.pandas_udf("double")
    def score(*xs: pd.Series) -> pd.Series:
        m = np.nan_to_num(np.stack([x.to_numpy(float) for x in xs], 1))
        return pd.Series(np.concatenate([forward(m[a : a + rows]) for a in range(0, len(m), rows)]) if len(m) else np.zeros(0))

    return score(*columns)


def boosted_trees(df: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 4, rate: float = 0.1, seed: int = 7, weight: str | None = None):
    """Gradient-boosted trees fitted by pyspark.ml on feature columns without nulls: (model, trees as arrays for tree_scores).
    The logistic of twice the sum of the arrays' scores is the model's probability."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    more = {"weightCol": weight} if weight else {}
    model = GBTClassifier(featuresCol="_f", labelCol=label, maxIter=trees, maxDepth=depth, stepSize=rate, seed=seed, **more).fit(VectorAssembler(inputCols=list(features), outputCol="_f").transform(df))
    return model, [exported(t, w) for t, w in zip(model.trees, model.treeWeights)]


def exported(tree, weight: float = 1.0, leaf=None) -> dict[str, np.ndarray]:
    """One fitted tree with numeric splits as arrays (feature, threshold, left, right, missing_left, value); bounded by its depth.
    A node's value is its prediction times weight, or what `leaf` makes of it."""
    rows: list[list] = []

    def add(node) -> int:
        at = len(rows)
        rows.append([-1, 0.0, at, at, True, leaf(node) if leaf else node.prediction() * weight])
        if node.subtreeDepth():
            rows[at][:2] = [node.split().featureIndex(), node.split().threshold()]
            rows[at][2], rows[at][3] = add(node.leftChild()), add(node.rightChild())
        return at

    add(tree._java_obj.rootNode())
    return {k: np.array(v) for k, v in zip(("feature", "threshold", "left", "right", "missing_left", "value"), zip(*rows))}


def out_of_fold(df: DataFrame, fold: str, folds: Sequence, fit) -> DataFrame:
    """Each row scored by a model that was fitted without its fold: fit(training rows) returns a function of rows that adds columns.
    A pass for each of a few folds; rows whose fold isn't listed are left out."""
    parts = [fit(df.where(F.col(fold) != f))(df.where(F.col(fold) == f)) for f in folds]
    return reduce(DataFrame.unionByName, parts)


def out_of_fold_rates(df: DataFrame, keys: Sequence[str], fold: str, y: str, name: str = "p") -> DataFrame:
    """Adds each row's rate over its keys' rows in the other folds, null without any: sums by (keys, fold) once, totals less the fold's own.
    Null keys are equal to each other."""
    k = F.struct(*keys)
    own = df.groupBy(k.alias("_k"), F.col(fold).alias("_f")).agg(F.count(F.lit(1)).alias("_n"), F.sum(F.col(y).cast("double")).alias("_s"))
    w = Window.partitionBy("_k")
    rest = own.select(F.struct("_k", "_f").alias("_k"), ((F.sum("_s").over(w) - F.col("_s")) / F.nullif(F.sum("_n").over(w) - F.col("_n"), F.lit(0))).alias(name))
    return df.withColumn("_k", F.struct(k.alias("_k"), F.col(fold).alias("_f"))).join(rest, "_k").drop("_k")


def folds(df: DataFrame, key: str, k: int, seed: int = 0, name: str = "fold") -> DataFrame:
    """Adds a fold by hash: the same for a key in every run and partitioning."""
    return df.withColumn(name, F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(k)).cast("int"))


def stratified_sample(df: DataFrame, key: str, stratum: str, n: int, seed: int = 0) -> DataFrame:
    """At most n rows of each stratum in hash order. A hash threshold from the stratum's size (twice what n needs) goes before the exact
    cut, so the window sorts about 2 n rows of a stratum."""
    h = F.pmod(F.xxhash64(F.col(key), F.lit(seed)), F.lit(1 << 40))
    size = df.groupBy(stratum).agg(F.count(F.lit(1)).alias("_n"))
    d = df.withColumn("_h", h).join(size, stratum).where(F.col("_h") < F.lit(float(1 << 40)) * F.least(F.lit(1.0), (2.0 * n + 100) / F.col("_n")))
    w = Window.partitionBy(stratum).orderBy("_h", key)
    return d.withColumn("_i", F.row_number().over(w)).where(F.col("_i") <= n).drop("_h", "_i", "_n")


def softmax_neighbours(columns: Sequence[Column], centres: np.ndarray, values: np.ndarray, temperature: float = 1.0) -> Column:
    """The mean of a fixed set of candidates' values weighted by exp(-squared distance / temperature): a small set of constants, scored in batches."""
    centres, values = np.asarray(centres, float), np.asarray(values, float)

    @F.pandas_udf("double")
    def score(*xs: pd.Series) -> pd.Series:
        m = np.stack([x.to_numpy(float) for x in xs], 1)
        d = -((m[:, None, :] - centres) ** 2).sum(axis=2) / temperature
        w = np.exp(d - d.max(axis=1, keepdims=True))
        return pd.Series(w @ values / w.sum(axis=1))

    return score(*columns)


def attention_scores(sequence: Column, candidate: Column, table: np.ndarray, layers: Sequence[tuple[np.ndarray, np.ndarray]], cells: int = 1 << 20) -> Column:
    """A sequence model's forward pass from its arrays: codes of a sequence and of a candidate row take vectors from `table`, the sequence
    is pooled by softmax attention to the candidate (an empty one: zeros), and a dense network scores both. Rows of a block are padded to
    its longest sequence and masked."""

    @F.pandas_udf("double")
    def score(seq: pd.Series, cand: pd.Series) -> pd.Series:
        lists = [[] if s is None else list(s) for s in seq]
        size, q = np.array([len(s) for s in lists], int), table[cand.to_numpy(int)]
        out, step = np.empty(len(lists)), max(1, cells // (max(1, size.max(initial=1)) * table.shape[1]))
        for a in range(0, len(lists), step):
            n, ask = size[a : a + step], q[a : a + step]
            mask = np.arange(max(1, n.max())) < n[:, None]
            codes = np.zeros(mask.shape, int)
            codes[mask] = [c for s in lists[a : a + step] for c in s]
            keys = table[codes]
            s = np.where(mask, (keys * ask[:, None, :]).sum(axis=2) / np.sqrt(ask.shape[1]), -np.inf)
            top = s.max(axis=1, keepdims=True)
            w = np.exp(s - np.where(np.isfinite(top), top, 0.0))
            pooled = (w[:, :, None] * keys).sum(axis=1) / np.maximum(w.sum(axis=1), 1e-300)[:, None]
            h = np.concatenate([ask, pooled], 1)
            for j, (weight, b) in enumerate(layers):
                h = h @ weight + b
                h = np.maximum(h, 0) if j < len(layers) - 1 else h
            out[a : a + step] = 1 / (1 + np.exp(-h[:, 0]))
        return pd.Series(out)

    return score(sequence, candidate)


def shared_splits(trees: Sequence[dict]) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """(features, borders, codes): the distinct (feature, border) pairs of all trees' inner nodes, by feature and border, and for each tree the
    number of each node's pair (leaves: 0)."""
    inner = [np.asarray(t["feature"]) >= 0 for t in trees]
    every = [np.stack([np.asarray(t["feature"], float)[i], np.asarray(t["threshold"], float)[i]], 1) for t, i in zip(trees, inner)]
    pairs, at = np.unique(np.concatenate([*every, np.zeros((0, 2))]), axis=0, return_inverse=True)
    codes, begin = [], 0
    for i in inner:
        c = np.zeros(len(i), int)
        c[i] = at.ravel()[begin : begin + i.sum()]
        begin += int(i.sum())
        codes.append(c)
    return pairs[:, 0].astype(int), pairs[:, 1], codes


def shared_tree_scores(columns: Sequence[Column], trees: Sequence[dict], bias: float = 0.0, cells: int = 1 << 22) -> Column:
    """tree_scores by a shared split table: each distinct (feature, border) is compared once for a row, whatever trees and nodes use it, and nodes
    refer to the outcome's bit. Rows go in blocks whose bits fill `cells` places at most."""
    features, borders, codes = shared_splits(trees)
    step = max(1, cells // max(1, len(features)))

    @F.pandas_udf("double")
    def score(*xs: pd.Series) -> pd.Series:
        m = np.stack([x.to_numpy(float) for x in xs], 1)
        out = np.full(len(m), float(bias))
        for a in range(0, len(m), step):
            x = m[a : a + step]
            left, missing = x[:, features] <= borders, np.isnan(x)
            for t, code in zip(trees, codes):
                f, to_left, to_right, ml, v = (np.asarray(t[k]) for k in ("feature", "left", "right", "missing_left", "value"))
                at = np.zeros(len(x), int)
                while (live := f[at] >= 0).any():
                    i, r = at[live], np.flatnonzero(live)
                    go = np.where(missing[r, f[i]], ml[i], left[r, code[i]])
                    at[live] = np.where(go, to_left[i], to_right[i])
                out[a : a + step] += v[at]
        return pd.Series(out)

    return score(*columns)


def random_forest(df: DataFrame, features: Sequence[str], label: str, trees: int = 20, depth: int = 5, seed: int = 7):
    """A random forest fitted by pyspark.ml on feature columns without nulls: (model, trees as arrays). The sum of the arrays' scores is the
    mean of the trees' label shares, the model's probability of label 1."""
    from pyspark.ml.classification import RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    model = RandomForestClassifier(featuresCol="_f", labelCol=label, numTrees=trees, maxDepth=depth, seed=seed).fit(VectorAssembler(inputCols=list(features), outputCol="_f").transform(df))
    share = lambda node: (s := list(node.impurityStats().stats()))[1] / sum(s) / trees
    return model, [exported(t, leaf=share) for t in model.trees]


def attention_network(numbers: Sequence[Column], codes: Sequence[Column], sequences: Sequence[Column], query: Column, net: dict[str, np.ndarray], cells: int = 1 << 20) -> Column:
    """The probability of a network that pools a sequence by attention to a query, from its arrays.

    The sequences (arrays of codes, equal in length) give each place a state, their vectors side by side. An attention network scores a place
    from its state, the query's vector and their product, the query's vector repeated up to the state's width; a softmax over the places of
    the row weighs their states. Dense layers with ReLU between then give a logit from the numbers, the vectors of the codes and the pooled
    state.

    net: table{j} for each code and seq{j} for each sequence (rows are codes; 0 stands for unknown), query, att0_w (in by out), att0_b, att1_w
    (in), att1_b, dense{i}_w (in by out), dense{i}_b. Ragged rows are padded to a tensor of a block's longest and masked. A row
    without places (empty, null) attends to code 0 alone; a null place is masked; codes that a table lacks or null count as 0, null numbers as 0.
    Blocks hold `cells` places by state width at most."""
    n_dense = sum(1 for k in net if k.startswith("dense") and k.endswith("_w"))
    known = lambda z, t: np.where((z >= 0) & (z < len(t)), z, 0)

    def forward(x: np.ndarray, z: np.ndarray, q: np.ndarray, places: list[list]) -> np.ndarray:
        size = np.array([len(p) for p in places[0]])
        mask = np.arange(max(1, size.max(initial=0))) < size[:, None]
        padded = []
        for one in places:
            full = np.full(mask.shape, np.nan)
            full[mask] = [np.nan if v is None else v for p in one for v in p]
            padded.append(full)
        mask &= ~np.isnan(padded).any(axis=0)
        none = ~mask.any(axis=1)
        mask[none, 0] = True
        state = np.concatenate([net[f"seq{j}"][known(np.where(mask & ~none[:, None], np.nan_to_num(p), 0).astype(int), net[f"seq{j}"])] for j, p in enumerate(padded)], 2)
        ask = np.broadcast_to(net["query"][known(q, net["query"])][:, None, :], (*mask.shape, net["query"].shape[1]))
        wide = np.tile(ask, (1, 1, -(-state.shape[2] // ask.shape[2])))[:, :, : state.shape[2]]
        h = np.maximum(np.concatenate([state, ask, state * wide], 2) @ net["att0_w"] + net["att0_b"], 0)
        s = np.where(mask, h @ net["att1_w"] + net["att1_b"], -np.inf)
        w = np.exp(s - s.max(axis=1, keepdims=True))
        pooled = ((w / w.sum(axis=1, keepdims=True))[:, :, None] * state).sum(axis=1)
        h = np.concatenate([x, *[net[f"table{j}"][known(z[:, j], net[f"table{j}"])] for j in range(z.shape[1])], pooled], 1)
        for i in range(n_dense):
            h = h @ net[f"dense{i}_w"] + net[f"dense{i}_b"]
            h = np.maximum(h, 0) if i < n_dense - 1 else h
        return 1 / (1 + np.exp(-np.clip(h[:, 0], -60, 60)))

    n, k = len(numbers), len(codes)
    width = sum(net[f"seq{j}"].shape[1] for j in range(len(sequences))) * 3

    @F.pandas_udf("double")
    def score(*xs: pd.Series) -> pd.Series:
        rows = len(xs[0])
        x = np.nan_to_num(np.stack([c.to_numpy(float) for c in xs[:n]], 1)) if n else np.zeros((rows, 0))
        z = [np.nan_to_num(c.to_numpy(float)).astype(int) for c in xs[n : n + k + 1]]
        seq = [[[] if v is None else list(v) for v in c] for c in xs[n + k + 1 :]]
        out, a = np.zeros(rows), 0
        longest = np.array([len(v) for v in seq[0]])
        while a < rows:  # a block ends where its padded tensor would be too large
            most = np.maximum.accumulate(np.maximum(longest[a : a + 8192], 1))
            b = a + max(1, int(np.searchsorted(most * np.arange(1, len(most) + 1) * width, cells, side="right")))
            out[a:b] = forward(x[a:b], np.stack([c[a:b] for c in z[:k]], 1) if k else np.zeros((len(x[a:b]), 0), int), z[k][a:b], [s[a:b] for s in seq])
            a = b
        return pd.Series(out)

    return score(*numbers, *codes, query, *sequences)
