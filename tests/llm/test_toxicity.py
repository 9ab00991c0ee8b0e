import zlib

import numpy as np
import pytest

from priorwise.llm import toxicity as t

SF = "/root/testdata/sf0.1"


def plain_grams(text):
    s = "".join(" " if c in " \t\n\r\x0b\x0c" else c for c in f" {(text or '').lower()} ")
    return {s[i : i + n] for n in t.ORDERS for i in range(len(s) - n + 1) if " " not in s[i + 1 : i + n - 1]}


def test_grams_like_a_plain_loop():
    texts = ["The IDIOT, été", "", None, "a", "word word\nword", "日本 語", "x" * 50]
    got = []
    for limit in (5, 10**6):
        sets = [set() for _ in texts]
        lo = 0
        for n, row, f in t.grams(texts, limit=limit):
            for r, x in zip(row, f):
                sets[lo + r].add(int(x))
            lo += n
        got.append(sets)
    assert got[0] == got[1]
    assert [len(s) for s in got[0]] == [len(plain_grams(x)) for x in texts]
    assert got[0][1] == got[0][2] and len(got[0][4]) < 3 * len("word word word")


def test_ratios_and_regression():
    r = t.log_count_ratios(np.array([9.0, 0.0]), np.array([0.0, 9.0]))
    assert r[0] > 0 > r[1] and abs(r[0] + r[1]) < 1e-12
    rng = np.random.default_rng(0)
    y = rng.integers(0, 2, 400).astype(float)
    row, col = np.repeat(np.arange(400), 2), np.stack([y, 2 + rng.integers(0, 2, 400)], 1).ravel().astype(int)
    w, b = t.fit_logistic(row, col, np.ones(800), y, 4, 1e-4, 400)
    assert w[1] > 1 > -1 > w[0] and abs(w[2] - w[3]) < 0.5


@pytest.fixture(scope="module")
def scored(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    small = docs.join(labels.select("doc_id"), "doc_id", "left_semi")
    model = t.fit(small, labels, rows=3000)
    rows = t.score_toxicity(small, model).join(labels, "doc_id").select("doc_id", "score", "predicted", "toxic").collect()
    return model, rows


def test_held_out_accuracy(scored):
    held = [r for r in scored[1] if zlib.crc32(str(r.doc_id).encode()) % 5 == 0]
    y, s = np.array([r.toxic for r in held]), np.array([r.score for r in held])
    rank = np.empty(len(s))
    rank[np.argsort(s)] = np.arange(len(s))
    auc = (rank[y == 1].mean() - (y.sum() - 1) / 2) / (len(y) - y.sum())
    hit = s >= 0.5
    assert auc > 0.95 and (y[hit] == 1).mean() > 0.9 and hit[y == 1].mean() > 0.7
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in scored[1])


def test_bound_fold_and_repeats(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(100)] + [(3, 1), (3, 0), (None, 1), (5, None)], "doc_id long, toxic int")
    rows = t.training_rows(labels, rows=30).collect()
    assert len(rows) == 30 and len({r.doc_id for r in rows}) == 30
    every = t.training_rows(labels).collect()
    assert {r.doc_id for r in every} == {i for i in range(100) if zlib.crc32(str(i).encode()) % 5}
    assert [r.y for r in every if r.doc_id == 3] in ([1], [])


def test_no_labels_and_odd_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (None, None), (2, ""), (2, "x" * 100_000)], "doc_id long, text string").selectExpr("*", "'q' as SCORE")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    out = t.score_toxicity(docs, t.fit(docs, none))
    assert out.columns == ["doc_id", "text", "score", "predicted"] and [r.score for r in out.collect()] == [0.0] * 4
    assert t.score_toxicity(docs.limit(0), t.fit(docs, none)).count() == 0
    few = spark.createDataFrame([(i, "you idiot scum" if i % 2 else "a fine day") for i in range(60)], "doc_id long, text string")
    model = t.fit(few, spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int"))
    got = t.score_toxicity(few.unionByName(docs.select("doc_id", "text")), model).collect()
    assert all((r.score > 0.5) == ("idiot" in r.text) for r in got if r.text and len(r.text) < 100 and r.text != "a b")


def plain_hash(gram):
    h = 0
    for i, c in enumerate(gram):
        h = (h + ord(c) * int(t._STEP[i])) % 2**64
    return int(t.mix(np.array([h], np.uint64))[0]) >> (64 - t.BITS)


def plain_scores(train, texts, n_features=40, l2=1e-3, steps=50):
    """The same model in plain loops: presence counts by class, features that differ most, log-count ratios, gradient steps."""
    sets = [({plain_hash(g) for g in plain_grams(x)}, y) for x, y in train]
    n = [sum(y == k for _, y in sets) for k in (0, 1)]
    every = sorted(set().union(*[s for s, _ in sets]))
    count = {f: [sum(f in s for s, y in sets if y == k) for k in (0, 1)] for f in every}

    def apart(f):
        a, b = count[f]
        share = (a + b) / (n[0] + n[1])
        return abs(b / n[1] - a / n[0]) / (share * (1 - share) * (1 / n[0] + 1 / n[1]) + 1e-12) ** 0.5 if a + b >= min(t.LEAST_ROWS, n[1]) else 0

    chosen = sorted(sorted((f for f in every if apart(f) > 0), key=lambda f: (-apart(f), f))[:n_features])
    size = 1 << t.BITS
    total = [sum(c[k] for c in count.values()) + size for k in (0, 1)]
    ratio = {f: np.log((count[f][1] + 1) / total[1]) - np.log((count[f][0] + 1) / total[0]) for f in chosen}
    rows = [(sorted(s & set(chosen)), y) for s, y in sets]
    x = np.zeros((len(rows), len(chosen)))
    for i, (s, _) in enumerate(rows):
        for f in s:
            x[i, chosen.index(f)] = ratio[f] / np.sqrt(len(s))
    y = np.array([float(k) for _, k in rows])
    w, b, tt = np.zeros(len(chosen)), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)), 1.0
    vw, vb, rate = w.copy(), b, 1 / (0.25 * ((x**2).sum(axis=1).max() + 1) + l2)
    for _ in range(steps):
        g = 1 / (1 + np.exp(-(x @ vw + vb))) - y
        nw, nb, nt = vw - rate * (x.T @ g / len(y) + l2 * vw), vb - rate * g.mean(), (1 + (1 + 4 * tt * tt) ** 0.5) / 2
        vw, vb, w, b, tt = nw + (tt - 1) / nt * (nw - w), nb + (tt - 1) / nt * (nb - b), nw, nb, nt
    out = []
    for text in texts:
        s = {plain_hash(g) for g in plain_grams(text)} & set(chosen)
        z = sum(w[chosen.index(f)] * ratio[f] for f in s) / max(len(s), 1) ** 0.5 + b
        out.append(1 / (1 + np.exp(-z)))
    return out


def test_scores_like_plain_loops(spark):
    bad, good = ["you idiot", "total scum", "stupid scum and idiots", "an idiot"], ["a fine day", "we met the band", "tea and cake", "stay and read"]
    train = [(i, (bad if i % 2 else good)[i // 2 % 4] + f" {i % 7}", i % 2) for i in range(60)]
    docs = spark.createDataFrame([x[:2] for x in train], "doc_id long, text string").repartition(3)
    model = t.fit(docs, spark.createDataFrame([(i, y) for i, _, y in train], "doc_id long, toxic int"), n_features=40, l2=1e-3, steps=50)
    texts = ["what an idiot", "fine tea", "", None, "zzz", "scum " * 50, "une journ\u00e9e"]
    got = t.score_toxicity(spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string"), model).orderBy("doc_id").collect()
    want = plain_scores([(x, y) for i, x, y in train if zlib.crc32(str(i).encode()) % 5], texts)
    assert np.allclose([r.score for r in got], want, atol=1e-9)


def test_long_text_in_pieces_has_the_same_features():
    text = "".join(chr(97 + i * i % 23) + (" " if i % 9 == 0 else "") for i in range(3000))
    (n, _, f), = t.grams([text], limit=100)
    (m, _, g), = t.grams([text], limit=10**6)
    assert n == m == 1 and (f == g).all()
