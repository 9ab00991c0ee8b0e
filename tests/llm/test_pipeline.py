import re

import pytest
from test_decontamination import brute, words

import corpus_pipeline
from priorwise.llm.near_dedup import find_near_duplicates

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, docs, SF).cache()
        out.append((name, docs, made))
        docs = made
    return out


def test_stages_in_order_and_columns(spark, steps):
    assert [n for n, _, _ in steps] == ["toxicity", "near_dedup", "decontamination", "pii", "packing"]
    for _, docs, made in steps[:-1]:
        assert made.columns == ["doc_id", "text", "lang", "source", "n_chars"] == docs.columns


def test_toxic_go_and_clean_stay(spark, steps):
    _, docs, made = steps[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r.doc_id for r in made.collect()}
    rows = docs.join(labels, "doc_id").collect()
    clean = [r.doc_id in kept for r in rows if r.toxic == 0]
    assert sum(clean) > 0.97 * len(clean)


def test_one_of_each_group_stays(spark, steps):
    _, docs, made = steps[1]
    want = {r.component_id for r in find_near_duplicates(docs).collect()}
    got = [r.doc_id for r in made.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_near_duplicates_by_all_pairs(steps):
    """The whole result of the stage: sets of five-word shingles, all pairs at 0.8, the least id of each component."""
    _, docs, made = steps[1]
    sets = {}
    for r in docs.collect():
        w = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in r.text or ""))
        sets[r.doc_id] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()
    up = {d: d for d in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a in sorted(sets):
        for b in sorted(sets):
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]) > 0:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    assert {r.doc_id for r in made.collect()} == {d for d in sets if root(d) == d} and any(root(d) != d for d in sets)


def test_leaks_go(spark, steps):
    """The whole result of the stage: greedy tiling by trying all places, for documents and items that share enough five-word windows to
    cover 0.8 of the item at all."""
    _, docs, made = steps[2]
    items = [words(r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    texts, gone, whole = {r.doc_id: r.text for r in docs.collect()}, set(), set()
    for d, text in texts.items():
        w = words(text)
        for item in items:
            k = min(5, len(item))
            here = {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
            may = {i + j for i in range(len(item) - k + 1) if tuple(item[i : i + k]) in here for j in range(k)}
            if k and len(may) >= 0.8 * len(item) and brute(text, " ".join(item), 5)[1] >= 0.8:
                gone.add(d)
            if f" {' '.join(item)} " in f" {' '.join(w)} ":
                whole.add(d)
    assert {r.doc_id for r in made.collect()} == texts.keys() - gone and whole <= gone and whole


def test_personal_data_goes_and_the_rest_stays(steps):
    _, docs, made = steps[3]
    before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: (r.text, r.n_chars) for r in made.collect()}
    private = re.compile(r"\S+@\S+\.com|\(\d{3}\) 555-\d{4}|\b\d{16}\b|\b\d+\.\d+\.\d+\.\d+\b")
    assert before.keys() == after.keys() and any(private.search(t) for t in before.values())
    for d, t in before.items():
        new, n = after[d]
        assert n == len(new)
        if found := private.findall(t):
            assert not any(re.search(re.escape(x) + r"(?!\w)", new) for x in found)
        elif "token" not in t:
            assert new == t


def test_every_document_is_packed(steps):
    _, docs, made = steps[4]
    total = {}
    for p in made.collect():
        total.setdefault(p.doc_id, [0, p.doc_tokens])[0] += p.length
    assert total.keys() == {r.doc_id for r in docs.collect()} and all(a == b for a, b in total.values())


def test_run(spark, steps):
    assert corpus_pipeline.run(spark, SF).count() > 0


def odd_rows(spark, sf=SF):
    """Rows with nulls, repeats, a very long text and further columns named like those that operators add."""
    text = spark.read.parquet(f"{sf}/documents.parquet").where("doc_id = 1").first().text
    rows = [(None, "a text without an id, which stays as it is", "en", None), (900001, None, None, "x"), (900002, "", "en", "x"), (900003, text, "en", "x"), (900003, text, "en", "x"), (900004, "Mail ann.lee@some-mail.com now " + "word " * 200_000, "en", "x"), (900005, "\n \t", "en", None)]
    extra = [(i, *r, len(r[1]) if r[1] is not None else None, 7, 0.25, 3, "k", "c", "s", 5, False, 1) for i, r in enumerate(rows)]
    names = "row long, doc_id long, text string, lang string, source string, n_chars long, predicted int, score double, n_entities int, _kind string, _canon string, _surrogate string, _k1 long, kept boolean, N int"
    return spark.createDataFrame(extra, names)


@pytest.mark.parametrize("i", range(5))
def test_odd_rows(spark, i):
    name, stage = corpus_pipeline.STAGES[i]
    docs = odd_rows(spark)
    out = stage(spark, docs, SF)
    rows = out.collect()
    assert stage(spark, docs.limit(0), SF).count() == 0
    if name == "packing":
        ids = [r.doc_id for r in rows if r.start == 0]
        assert sorted(ids, key=str) == sorted([r.doc_id for r in docs.collect()], key=str)
        assert [r.length for r in rows if r.doc_id in (900001, 900002)] == [1, 1]
        return
    assert out.columns == docs.columns
    want = {r.row: r for r in docs.collect()}
    got = {r.row: r for r in rows}
    assert len(got) == len(rows)
    if name == "near_dedup":
        assert len(got.keys() & {3, 4}) == 1 and got.keys() | {3, 4} == want.keys()
    else:
        assert got.keys() == want.keys()
    for k, r in got.items():
        if name == "pii" and k == 5:
            assert "ann.lee" not in r.text and r.n_chars == len(r.text) and r[5:][1:] == want[k][5:][1:] and r.text.count("word") == 200_000
        else:
            assert r == want[k]
