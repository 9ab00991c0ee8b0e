import hashlib
import random

import pytest

from priorwise.llm import substrings


def brute(docs, k):
    words = [(d, (t or "").encode().split()) for d, t in docs]
    first = {}
    for d, w in words:
        if d is not None:
            for i in range(len(w) - k + 1):
                x = tuple(w[i : i + k])
                first[x] = min(first.get(x, d), d)
    out = []
    for d, w in words:
        gone = set()
        for i in range(len(w) - k + 1):
            if d is not None and first[tuple(w[i : i + k])] < d:
                gone |= set(range(i, i + k))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    r = random.Random(seed)
    vocabulary = ["the", "of", "Ärger", "a", "x,", "Y.", "zz", "q", "über"] + [f"w{i}" for i in range(40)]
    text = lambda n: [r.choice(vocabulary) for _ in range(n)]
    shared = [text(30) for _ in range(4)]
    out = []
    for i in range(n):
        w = text(r.randrange(0, 60))
        for _ in range(r.randrange(3)):
            s, at = r.choice(shared), r.randrange(len(w) + 1)
            lo = r.randrange(15)
            w[at:at] = s[lo : lo + r.randrange(5, 30)]
        if i % 7 == 0:
            w = text(3) * 9
        if i % 11 == 5 and out:
            w = (r.choice(out)[1] or "").split()
        out.append((r.randrange(1000) if i % 13 else i, (" " if i % 3 else "\n\t").join(w) + " " * (i % 2), i))
    return [*{d: (d, t, n) for d, t, n in out}.values(), (None, " ".join(shared[0] * 2), 1), (2000, None, 2), (2001, "", 3), (2002, " ".join(shared[1] * 400), 4)]


@pytest.mark.parametrize("seed,parts,chunk", [(1, 3, 50), (2, 1, 10**6), (3, 8, 200)])
def test_like_brute_force(spark, seed, parts, chunk, monkeypatch):
    monkeypatch.setattr(substrings, "CHUNK_WORDS", chunk)
    docs = corpus(seed)
    docs += docs[:3]  # repeated rows
    df = spark.createDataFrame(docs, "doc_id long, text string, n_words int").repartition(parts)
    got = substrings.remove_repeats(df, 13, 5).collect()
    assert sorted([tuple(r) for r in got], key=str) == brute([d[:2] for d in docs], 13)


def test_paths_have_true_sources(spark):
    docs = {d: (t or "").split() for d, t, _ in corpus(4) if d is not None}
    df = spark.createDataFrame([(d, " ".join(w)) for d, w in docs.items()], "doc_id long, text string").repartition(5)
    _, spans, _ = substrings.repeated_spans(df, 13, 5)
    rows = spans.collect()
    assert rows
    for p in rows:
        n = p.n_windows + 12
        assert p.src < p.doc and docs[p.doc][p.start : p.start + n] == docs[p.src][p.src_start : p.src_start + n]


def test_no_rows_and_one_id_with_two_texts(spark):
    assert substrings.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    a, b = " ".join(f"a{i}" for i in range(20)), " ".join(f"b{i}" for i in range(20))
    rows = [(1, a), (5, b), (5, "x y " + a + " z")]
    got = substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_removed, r.kept) for r in got) == [(1, 0, a), (5, 0, b), (5, 20, "x y z")]


def test_branching_nodes_end_paths(spark, monkeypatch):
    """k = 3 words. x = m1..m6 follows a in two texts and b in two; y leaves it in two and z in two: five paths, joined at no branching node."""
    middle = "m1 m2 m3 m4 m5 m6"
    texts = [f"a1 a2 a3 {middle} y1 y2 y3", f"b1 b2 b3 {middle} z1 z2 z3", f"q a1 a2 a3 {middle} z1 z2 z3 r", f"s b1 b2 b3 {middle} y1 y2 y3 t"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(4)
    _, spans, _ = substrings.repeated_spans(df, 3, 2)
    words = [t.split() for t in texts]
    by_path = {}
    for r in spans.collect():
        assert words[r.doc][r.start : r.start + r.n_windows + 2] == words[r.src][r.src_start : r.src_start + r.n_windows + 2]
        by_path.setdefault(r.path, set()).add(" ".join(words[r.doc][r.start : r.start + r.n_windows + 2]))
    assert sorted(map(sorted, by_path.values())) == sorted([["a1 a2 a3 m1 m2"], ["b1 b2 b3 m1 m2"], ["m1 m2 m3 m4 m5 m6"], ["m5 m6 y1 y2 y3"], ["m5 m6 z1 z2 z3"]])


def test_parts_from_several_sources_are_one_path(spark):
    """Nonbranching windows whose sources lie in two documents: node joins close the parts to one path."""
    w = [f"w{i}" for i in range(12)]
    rows = [(1, w[4:12]), (2, w[:8]), (3, w)]
    _, spans, _ = substrings.repeated_spans(spark.createDataFrame([(d, " ".join(x)) for d, x in rows], "doc_id long, text string"), 3, 2)
    got = [r for r in spans.collect() if r.doc == 3]
    assert {r.src for r in got} == {1, 2} and len({r.path for r in got}) == 1 and sum(r.n_windows for r in got) == 10


def test_collided_windows_are_not_cut(spark, monkeypatch):
    """All nodes get one hash, so windows of different words count as equal; the words of the source refuse them."""
    real = substrings.window_hashes
    monkeypatch.setattr(substrings, "window_hashes", lambda h, k, *a: real(h, k, *a) * 0 if k == 12 else real(h, k, *a))
    shared = " ".join(f"s{i}" for i in range(20))
    rows = [(1, shared + " a b c"), (2, "x y z " + shared), (3, "only this " + " ".join(f"o{i}" for i in range(20)))]
    got = {r.doc_id: r.kept for r in substrings.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got[1] == rows[0][1] and got[3] == rows[2][1]


def test_sources_in_other_tasks(spark):
    """Documents of one task quote each other, and the least of them quotes a document of another task: all lose the passage, as by brute force."""
    docs = [(d, t) for d, t, _ in corpus(5, 80)]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = substrings.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 13, 5).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sorted([tuple(r) for r in got], key=str) == brute(docs, 13)
