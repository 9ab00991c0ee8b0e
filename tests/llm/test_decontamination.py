import random
import re

import pytest

from priorwise.llm import decontamination as d


def words(t):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", (t or "").lower())


def brute(text, item, k):
    """Greedy tiling by trying every pair of places for the longest unmarked match."""
    a, b = words(text), words(item)
    k = min(k, len(b))
    used_a, used_b, tiles = set(), set(), []
    while True:
        best = (0,)
        for j in range(len(b)):
            for i in range(len(a)):
                n = 0
                while i + n < len(a) and j + n < len(b) and a[i + n] == b[j + n] and i + n not in used_a and j + n not in used_b:
                    n += 1
                best = max(best, (n, -j, -i))
        n = best[0]
        if n < k:
            return tiles, len(used_b) / len(b)
        j, i = -best[1], -best[2]
        tiles.append((i, j, n))
        used_a |= set(range(i, i + n))
        used_b |= set(range(j, j + n))


@pytest.mark.parametrize("seed,chars", [(0, d.PART_CHARS), (1, d.PART_CHARS), (2, 0), (3, 0)])
def test_like_brute_force(spark, seed, chars):
    r = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(9)] + ["Épée"]
    items = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([2, 6, 14, 25]))), "x") for i in range(6)] + [(90, None, "x"), (91, "...", "x"), (None, "w1", "x")]
    docs = []
    for n in range(25):
        w = [r.choice(vocabulary) for _ in range(r.randrange(30))]
        parts = words(r.choice(items[:6])[1])
        c = r.randrange(len(parts) + 1)
        w[len(w) // 2 : len(w) // 2] = parts[c:] + ["zz"] * r.randrange(2) + parts[:c]
        docs.append((n, ", ".join(w).upper() if n % 2 else " ".join(w), 1))
    docs += [(100, None, 1), (101, "", 1), docs[0]]
    df = spark.createDataFrame(docs, "doc_id long, text string, item_id long").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string, doc_id string")
    got = sorted((x.doc_id, x.item_id, round(x.coverage, 9), x.n_tiles) for x in d.find_leaks(df, bench, part_chars=chars).collect())
    want = []
    for n, t, _ in docs:
        for i, s, _ in items:
            if i is not None and words(s):
                tiles, covered = brute(t, s, 5)
                if covered >= 0.8:
                    want.append((n, i, round(covered, 9), len(tiles)))
    assert got == sorted(want) and want
    kept = d.drop_leaks(df, bench, part_chars=chars)
    assert kept.columns == df.columns
    assert sorted(x.doc_id for x in kept.collect()) == sorted(n for n, _, _ in docs if n not in {w[0] for w in want})


def test_empty_tables_and_parts(spark, monkeypatch):
    none = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([(i, f"alpha{i} beta gamma delta{i} epsilon zeta") for i in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(i, f"x alpha{i} beta gamma delta{i} epsilon zeta y") for i in range(25)], "doc_id long, text string")
    assert d.find_leaks(none, bench).count() == 0
    assert d.find_leaks(docs, bench.limit(0)).count() == 0 and d.drop_leaks(docs, bench.limit(0)).count() == 25
    assert len(d.indexes(bench, part_chars=200)) > 2
    assert sorted((r.doc_id, r.item_id) for r in d.find_leaks(docs, bench).collect()) == [(i, i) for i in range(20)]


@pytest.mark.parametrize("chars", [d.PART_CHARS, 0])
def test_common_passage_in_many_items_and_a_very_long_text(spark, chars):
    shared = "in the middle of the"
    items = [(i, f"{shared} tale number{i} was told twice") for i in range(300)]
    docs = [(1, (shared + " night ") * 20_000), (2, "so " + items[7][1]), (3, shared), (4, " ".join(t for _, t in items[:3])), (None, items[9][1]), (2, "so " + items[7][1])]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = sorted((str(r.doc_id), r.item_id) for r in d.find_leaks(df, bench, part_chars=chars).collect())
    assert got == [("2", 7), ("2", 7), ("4", 0), ("4", 1), ("4", 2), ("None", 9)]
    assert sorted(r.doc_id for r in d.drop_leaks(df, bench, part_chars=chars).collect()) == [1, 3]
    assert d.find_leaks(df.limit(0), bench, part_chars=chars).count() == 0


def test_the_rarest_windows_find_every_cover():
    import numpy as np

    r = np.random.default_rng(1)
    for _ in range(200):
        m, k = int(r.integers(1, 40)), 5
        words = r.integers(0, 6, m).astype(np.uint64)
        k = min(k, m)
        seeds = d.window_hashes(words, k)
        keep = d.rarest(seeds, r.integers(1, 5, len(seeds)), m, k, 0.8)
        left = np.isin(seeds, seeds[keep], invert=True)
        reach = np.zeros(m, bool)
        for i in np.flatnonzero(left):
            reach[i : i + k] = True
        assert reach.sum() < 0.8 * m


def test_tiles_on_few_words():
    """Texts and items of two or three different words, where almost every place meets almost every other."""
    import numpy as np

    r = random.Random(11)
    for trial in range(250):
        letters = "ab" if trial % 2 else "abc"
        text, item = ["".join(r.choice(letters) for _ in range(r.randrange(1, n))) for n in (60, 25)]
        if trial % 5 == 0:
            text = item[len(item) // 2 :] + "z" + text + item[: len(item) // 2]
        h = {c: np.uint64(ord(c) * 0x9E3779B97F4A7C15 % 2**64) for c in "abcz"}
        a, b = np.array([h[c] for c in text]), np.array([h[c] for c in item])
        for k in (1, 2, 5):
            tiles, covered = brute(" ".join(text), " ".join(item), k)
            assert d.tile(a, b, min(k, len(b))) == tiles
            for share in (0.0001, 0.8):
                got = d.covering(a, b, k, share)
                assert (got is not None) == (covered >= share), (text, item, k)
                assert got is None or (abs(got[0] - covered) < 1e-12 and got[1] == sorted(tiles))


def test_one_word_a_million_times():
    """A text of a million equal words and an item of 200: the process grows by far less than 500 MB."""
    import subprocess
    import sys

    code = """
import resource, time, numpy as np
from priorwise.llm import decontamination as d
w = np.full(1_000_000, 12345, np.uint64)
before, t = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss, time.time()
got = d.covering(w, w[:200], 5, 0.8)
odd = d.covering(w, np.r_[w[:100], np.uint64(7), w[:99]], 5, 0.8)
print(got[0], len(got[1]), round(odd[0], 3), (resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024, time.time() - t)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=str(__import__("pathlib").Path(d.__file__).parents[2])).stdout.split()
    assert out[:3] == ["1.0", "1", "0.995"] and int(out[3]) < 500, out
