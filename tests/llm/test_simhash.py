"""SimHash against a loop over shingles, and links against all pairs of fingerprints."""

import random
import re

import pytest
import xxhash
from pyspark.sql import functions as F

from priorwise.llm import queries, simhash

SF = "/root/testdata/sf0.001"


def plain_print(text, k=3):
    words = re.findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    grams = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))] if words else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints, radius):
    """{doc_id: least id reached} of (doc_id, fingerprint) pairs."""
    up = {d: d for d, _ in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (a, f) in enumerate(prints):
        for b, g in prints[:i]:
            if (f ^ g).bit_count() <= radius:
                x, y = root(a), root(b)
                up[max(x, y)] = min(x, y)
    return {d: root(d) for d in up}


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    prints = [(d, plain_print(t)) for d, t in docs]
    want = plain_components(prints, 2)
    got = queries.op13_simhash(spark, SF).collect()
    assert sorted((r.doc_id, r.fingerprint, r.component_id) for r in got) == sorted((d, f"{f:016x}", want[d]) for d, f in prints)
    assert sum(not r.kept for r in got) == sum(d != c for d, c in want.items()) > 0


@pytest.mark.parametrize("radius", [0, 1, 2, 3])
def test_links(spark, radius):
    """Chains, balls around a word that is no fingerprint, and pairs just beyond the radius, the sign bit included."""
    r = random.Random(radius)
    found = {0, 1 << 63}
    for _ in range(12):
        f = r.getrandbits(64)
        found.add(f)
        for _ in range(6):
            g = f
            for b in r.sample(range(64), r.randrange(1, 5)):
                g ^= 1 << b
            found.add(g)
            f = r.choice([f, g])
    prints = [(d, f) for d, f in zip(r.sample(range(1000), len(found)), sorted(found))]
    classes = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f, d) for d, f in prints], "fp long, rep long")
    links = {tuple(x) for x in simhash.links_within(classes, radius).collect()}
    by = dict(prints)
    assert all((by[a] ^ by[b]).bit_count() <= radius for a, b in links)
    up = {d: d for d in by}
    for a, b in links:
        up = {d: min(up[a], up[b]) if c in (up[a], up[b]) else c for d, c in up.items()}
    assert up == plain_components(prints, radius)


def test_odd_rows(spark):
    long_ = "one two three four five six seven " * 30_000
    docs = [(1, None), (2, ""), (3, " \n"), (4, "Two words"), (5, "two  WORDS"), (None, "two words"), (6, long_), (6, long_), (7, long_ + "end"), (8, "a b c"), (9, "É a b c d")]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("FP", F.lit(1)).withColumn("rep", F.lit(2))
    got = sorted((r.doc_id or 0, r.fingerprint, r.component_id, r.kept) for r in simhash.find_near_duplicates(df).collect())
    want = sorted((d or 0, f"{plain_print(t) if t is not long_ and t != long_ + 'end' else 0:016x}") for d, t in docs)
    assert [x[:2] for x in got if x[0] not in (6, 7)] == [x for x in want if x[0] not in (6, 7)]
    assert [x[2:] for x in got] == [(None, True), (1, True), (1, False), (1, False), (4, True), (4, False), (6, True), (6, True), (6, False), (8, True), (9, True)]
    assert simhash.find_near_duplicates(df.limit(0)).count() == 0
    with pytest.raises(ValueError, match="radius"):
        simhash.find_near_duplicates(df, radius=5)


def test_blocks_of_shingles(spark, monkeypatch):
    text = " ".join(f"w{i * i % 97}" for i in range(500))
    monkeypatch.setattr(simhash, "STEP", 7)
    import pyarrow as pa

    column = pa.array([text, None, "a b", text + " x"])
    got = [f for _, _, fp in simhash.simhashes(column) for f in fp.tolist()]
    assert got == [plain_print(t) for t in column.to_pylist()]


def test_frequent_keys_apart(spark):
    """A fingerprint of most rows is joined by broadcast, the others by key; no row is lost or doubled."""
    docs = [(i, "the same text everywhere") for i in range(300)] + [(1000 + i, f"text number {i} of many " * 3) for i in range(40)]
    got = simhash.find_near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert len(got) == 340 and {r.component_id for r in got if r.doc_id < 300} == {0}
