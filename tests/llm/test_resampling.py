"""Importance resampling against plain loops over words, CRC-32 and logarithms."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from priorwise.llm import resampling

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def grams(text, n):
    words = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(words), [" ".join(words[i : i + k]) for k in range(1, n + 1) for i in range(len(words) - k + 1)]


def plain(docs, target, n, buckets, percent, least, seed):
    code = lambda f: zlib.crc32(f.encode()) % buckets
    s, t = [0] * buckets, [0] * buckets
    for counts, texts in ((s, [d[1] for d in docs]), (t, target)):
        for text in texts:
            for f in grams(text, n)[1]:
                counts[code(f)] += 1
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1.0) * (all_s + buckets) / ((s[b] + 1.0) * (all_t + buckets)))) for b in range(buckets)]
    out = []
    for doc, text in docs:
        words, found = grams(text, n)
        weight = sum(gain[code(f)] for f in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        out.append([doc, words, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    fit = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is None, r[0], r[2], r[3]))
    rank = {id(r): i + 1 for i, r in enumerate(fit[: percent * len(fit) // 100])}
    return sorted(((*r, rank.get(id(r))) for r in out), key=str)


def texts(seed, n):
    r = random.Random(seed)
    pool = ["Ab", "c9", "dé", "日本", "x" * 70, "E", "the", "THE", "ß"]
    some = [r.choice([" ", "-", "\n\t", "[", "~ "]).join(r.choice(pool) for _ in range(r.choice([0, 1, 3, 25, 60, 400]))) for _ in range(n)]
    return some + [None, "", "...", some[0]]


@pytest.mark.parametrize(("n", "buckets", "chunk"), [(1, 10_000, 1 << 16), (2, 97, 64), (3, 70_000, 30)])
def test_like_loops(spark, n, buckets, chunk):
    docs = list(enumerate(texts(n, 60))) + [(3, "again an id"), (None, "no id " * 30), (0, texts(n, 60)[0])]
    target = texts(99, 9)
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("Row", F.lit("kept")).repartition(5)
    got = resampling.resample(df, spark.createDataFrame([(t,) for t in target], "text string"), n, buckets, 30, 20, 7, chunk)
    want = plain(docs, target, n, buckets, 30, 20, 7)
    assert sorted((tuple(r[c] for c in ("doc_id", "n_words", "n_features", "weight", "score", "rank")) for r in got.collect()), key=str) == want
    assert any(r[5] for r in want)


def test_chunks_own_their_words():
    text = ("aa " * 50 + "b" * 500 + " cc-dd\n" * 40 + "end").encode()
    words = [w.encode() for w in WORD.findall(text.decode())]
    for n in (1, 2, 4):
        for size in (1, 7, 100, 10_000):
            at = 0
            for own, piece in resampling.chunks(text, n, size):
                held = [w.encode() for w in WORD.findall(piece.decode())]
                assert held == words[at : at + own + n - 1]
                at += own
            assert at == len(words)
    assert list(resampling.chunks(b"... ", 2, 1)) == [(0, b"")]


def test_checksums():
    r = random.Random(1)
    spans = [bytes(r.randrange(256) for _ in range(r.choice([0, 1, 5, 63, 64, 65, 300]))) for _ in range(200)]
    data, ends = np.frombuffer(b"".join(spans), np.uint8), np.cumsum([len(s) for s in spans])
    starts = ends - np.array([len(s) for s in spans])
    assert resampling.crc32_spans(data, starts, ends).tolist() == [zlib.crc32(s) for s in spans]
    assert len(resampling.crc32_spans(data, starts[:0], ends[:0])) == 0


def test_odd_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    aim = spark.createDataFrame([("a b",)], "text string")
    assert resampling.resample(none, aim).count() == 0
    df = spark.createDataFrame([(1, "word " * 30), (2, "other " * 30), (3, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in resampling.resample(df, aim.limit(0), percent=50).collect()}
    assert got[3].weight == 0 and got[3].rank is None and sorted(got[i].rank or 0 for i in (1, 2)) == [0, 1]


def test_a_long_text_is_many_tasks_work(spark):
    """A text of 2 million characters: its chunks stand in several partitions and give one row."""
    df = spark.createDataFrame([(1, "word and more " * 140_000)], "doc_id long, text string")
    found = resampling.features(df)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # which would join such small parts
    try:
        assert found.where("n_features > 0").select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    total = found.agg(F.sum("n_words"), F.sum("n_features"), F.countDistinct("row")).first()
    assert tuple(total) == (420_000, 420_000, 1)


def test_more_like_the_target(spark):
    """A tenth of the documents share the target's words; their weights are higher, and far more than a tenth of those drawn are of them."""
    r = random.Random(3)
    near = [f"t{i}" for i in range(50)]
    docs = [(i, " ".join(r.choice(near) if i % 10 == 0 else f"w{r.randrange(500)}" for _ in range(40))) for i in range(400)]
    target = [(" ".join(r.choice(near) for _ in range(40)),) for _ in range(20)]
    got = resampling.resample(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(target, "text string"))
    rows = got.collect()
    picked = [x.doc_id for x in rows if x["rank"]]
    assert min(x.weight for x in rows if x.doc_id % 10 == 0) > max(x.weight for x in rows if x.doc_id % 10)
    assert len(picked) == 40 and sum(i % 10 == 0 for i in picked) > 16
