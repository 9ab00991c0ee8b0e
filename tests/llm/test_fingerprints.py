import hashlib
import random

import numpy as np
import pytest

from priorwise.llm import fingerprints as f


def plain_walk(text):
    c, at, out = f.codes(text), 0, {}
    for j in range(1, 3 * len(c) + 1):
        if at >= len(c):
            break
        out[j] = "0123456789abcdef"[f.NIBBLE[c[at]]]
        at += int(f.MOVES[j % f.PERIOD][c[at]])
    return "".join(out.get(int(s), "-") for s in f.STEPS if s <= 3 * len(c)).rstrip("-")


def test_walks_like_a_plain_loop():
    r = random.Random(3)
    texts = ["", "a", "日本語 text é", *["".join(r.choice("abc d\nß") for _ in range(n)) for n in (2, 63, 64, 65, 300, 1500, 1501)]]
    assert f.written(f.walk([f.codes(t) for t in texts])) == [plain_walk(t) for t in texts]


@pytest.mark.parametrize("parts,rows,flush", [(3, 4, 300), (1, 1000, 10**6), (5, 1, 1)])
def test_like_brute_force(spark, parts, rows, flush):
    r = random.Random(parts)
    docs = [(i * 37 % 101, "".join(r.choice("abcdefg é\n") for _ in range(r.choice([0, 1, 2, 9, 80, 200]))), 1) for i in range(40)] + [(None, "null id", 1), (500, None, 1), docs0 := (7, "repeated", 1), docs0]
    df = spark.createDataFrame(docs, "doc_id long, text string, FINGERPRINT int").repartition(parts)
    got = f.fingerprint_pairs(df, flush, rows).collect()
    ordered = sorted(((d if d is not None else -(2**63), t or "", d) for d, t, _ in docs), key=lambda x: (x[0], x[1].encode()))
    want = []
    for i, (_, t, d) in enumerate(ordered):
        edited = f.edited_text(t, ordered[i - 1][1])
        want.append((d, len(t), hashlib.sha256(edited.encode()).hexdigest(), plain_walk(t), plain_walk(edited)))
    assert sorted([tuple(x)[:5] for x in got], key=str) == sorted(want, key=str)
    for x in got:
        s = f.symbols_of([x.fingerprint, x.edited_fingerprint])
        assert abs(f.likeness(s[:1], s[1:])[0] - x.near_edited) < 1e-12 and 0 <= x.near_next <= 1


def test_edits_cost_likeness_and_equal_texts_are_equal():
    r = random.Random(1)
    text = "".join(r.choice("abcdefghij klmn") for _ in range(4000))
    few = text[:3900] + "x" + text[3901:]
    half = text[:2000] + "".join(r.choice("abcdefghij klmn") for _ in range(2000))
    other = "".join(r.choice("abcdefghij klmn") for _ in range(4000))
    s = f.walk([f.codes(t) for t in (text, text, few, half, other)])
    near = f.likeness(np.repeat(s[:1], 5, axis=0), s)
    assert near[0] == near[1] == 1 and near[2] > 0.9 > 0.7 > near[3] > 0.4 > 0.2 > near[4]


def test_empty_and_single(spark):
    assert f.fingerprint_pairs(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    (row,) = f.fingerprint_pairs(spark.createDataFrame([(3, "abcd")], "doc_id long, text string")).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abab").hexdigest() and row.near_next == 1


def test_near_texts(spark):
    r = random.Random(2)
    base = ["".join(r.choice("abcdefghij klmn") for _ in range(900)) for _ in range(6)]
    docs = [(i, b) for i, b in enumerate(base)] + [(10 + i, b[:880] + "q" + b[881:]) for i, b in enumerate(base[:3])] + [(20, base[0]), (30, None), (31, "")]
    got = {x.doc_id: x.component_id for x in f.near_texts(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == {**{i: i for i in range(6)}, 10: 0, 11: 1, 12: 2, 20: 0}


def classes(pairs, ids):
    up = {i: i for i in ids}

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in pairs:
        up[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i in ids}


def links_of(texts, least):
    """All pairs of alike fingerprints, by comparing each with each."""
    s = f.walk([f.codes(t) for t in texts])
    return [(i, j) for i in range(len(texts)) for j in np.flatnonzero(f.likeness(np.repeat(s[i : i + 1], len(s), axis=0), s) >= least) if i < j]


def varied(r, n, sizes):
    """Texts of families: bases, and copies with changes at the start, the end or anywhere, cut or extended."""
    word = lambda k: "".join(r.choice("abcdefghij klmn") for _ in range(k))
    out = []
    for _ in range(n):
        base = word(r.choice(sizes))
        out.append(base)
        for _ in range(r.choice([0, 1, 2, 4])):
            k = int(len(base) * r.random() * 0.2)
            at = r.choice([0, len(base) - k, r.randrange(len(base) - k + 1)])
            out.append(r.choice([base[:at] + word(k) + base[at + k :], base[: len(base) - k], base + word(k)]))
    return out


def test_bands_find_alike_texts_of_every_length():
    r = random.Random(8)
    texts = varied(r, 250, [12, 30, 200, 900, 3000, 12_000])
    pairs = links_of(texts, 0.8)
    k = [set(x) for x in f.band_keys(f.written(f.walk([f.codes(t) for t in texts])), 64, 8)]
    met = sum(bool(k[a] & k[b]) for a, b in pairs)
    assert len(pairs) > 200 and met >= 0.98 * len(pairs), (met, len(pairs))


@pytest.mark.parametrize("block", [3, 1024])
def test_near_texts_like_brute_force(spark, block):
    r = random.Random(4)
    texts = list(dict.fromkeys(varied(r, 40, [30, 400, 1500])))
    got = {x.doc_id: x.component_id for x in f.near_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), block=block).collect()}
    want = classes(links_of(texts, 0.8), range(len(texts)))
    assert len(set(want.values())) < len(texts) - 20
    assert sum(got[i] == want[i] for i in want) >= 0.98 * len(want)


def test_members_unlike_the_least_one_are_joined():
    rows = [(0, "0" * 60), (1, "1" * 60), (2, "1" * 59 + "2"), (3, "1" * 58 + "22"), (4, "3" * 60)]
    frame = f.pd.DataFrame([(k, k, p, 2) for k, p in rows], columns=["rep", "label", "fingerprint", "side"])
    found = f._links_between(0.8)(frame)
    assert set(classes(found.itertuples(index=False, name=None), range(5)).values()) == {0, 1, 4} and len(found) == 2
    assert f._links_between(0.8)(frame.head(0)).empty


def test_near_texts_of_nothing_repeated_rows_and_other_columns(spark):
    kind = "doc_id long, text string, COMPONENT_ID string, rep int"
    assert f.near_texts(spark.createDataFrame([], kind)).collect() == []
    long = "a very long text, " * 20_000
    rows = [(9, long, "x", 1), (9, long, "x", 1), (4, long + "!", None, 2), (4, "quite another text of some words", None, 2), (None, long, "x", 1), (5, None, "x", 1), (6, "", "x", 1)]
    got = sorted(tuple(x) for x in f.near_texts(spark.createDataFrame(rows, kind)).collect())
    assert got == [(4, 4), (4, 4), (9, 4), (9, 4)]


def test_packed_prints():
    prints = ["", "0", "8", "08", "1f0", "00ff", "abcde"]
    assert f.unpacked_prints([f.packed_print(p) for p in prints]) == prints


@pytest.mark.parametrize("parts", [1, 5])
def test_components_of_the_query(spark, parts):
    """component_id against all pairs, with copies, one id with several texts, null ids and empty texts; the other columns don't change."""
    r = random.Random(parts + 10)
    texts = list(dict.fromkeys(varied(r, 40, [60, 400, 1500])))
    near = [t[: len(t) // 2] + "#" + t[len(t) // 2 + 1 :] for t in texts[::4]]
    texts = list(dict.fromkeys(texts + near))
    docs = [(i * 31 % 997, t) for i, t in enumerate(texts)] + [(2000 + i, t) for i, t in enumerate(texts[:9])]
    docs += [(3000, texts[1]), (3000, texts[2]), (3000, "one id, another text " * 9), (None, texts[0]), (3001, None), (3002, ""), docs[5], docs[5]]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(parts)
    got = f.fingerprint_components(df).collect()
    plain = f.fingerprint_pairs(df).collect()
    assert sorted([tuple(x)[:-1] for x in got], key=str) == sorted([tuple(x) for x in plain], key=str)
    rows = [(d, t) for d, t in docs if d is not None and t]
    kinds = sorted({t for _, t in rows})
    number = {t: i for i, t in enumerate(kinds)}
    group = classes(links_of(kinds, 0.9), range(len(kinds)))
    least = {}
    for d, t in rows:
        g = group[number[t]]
        least[g] = min(least.get(g, d), d)
    print_ = dict(zip(kinds, f.written(f.walk([f.codes(t) for t in kinds]))))
    want = sorted([(d, print_[t], least[group[number[t]]]) for d, t in rows] + [(None, print_[texts[0]], None), (3001, "", 3001), (3002, "", 3002)], key=str)
    have = sorted([(x.doc_id, x.fingerprint, x.component_id) for x in got], key=str)
    assert len({w[2] for w in want}) < len(want) - 20
    assert sum(a == b for a, b in zip(have, want)) >= 0.99 * len(want) and len(have) == len(want)
