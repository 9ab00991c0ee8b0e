"""Near-duplicates by SimHash, found by meeting in the middle: every fingerprint is sent to all words within half the radius of it,
so fingerprints within the radius, and no others, meet on a word."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, deal_join, discard, joined_words, saved, text_chunks, word_spans
from .components import components

SHINGLE = 3
RADIUS = 2
SEED = 42
#: Shingles whose bits are counted at a time.
STEP = 1 << 16


def simhashes(column: pa.Array, k: int = SHINGLE):
    """(first row, end row, fingerprints): a bit is 1 if more than half of the row's k-word shingles, repeats included, have it in their
    XXH64. Words in lower case (A-Z), joined by one space; fewer than k words are one shingle, no words give 0."""
    for lo, hi, data, offs in text_chunks(column):
        starts, ends, bounds = word_spans(data, offs)
        flat, s, e = joined_words(data, starts, ends)
        words = np.diff(bounds)
        n = np.where(words >= k, words - k + 1, np.minimum(words, 1))
        row = np.repeat(np.arange(hi - lo), n)
        first = np.arange(len(row)) + np.repeat(bounds[:-1] - (np.cumsum(n) - n), n)
        last = np.minimum(first + k, bounds[1:][row]) - 1
        raw, ones = flat.tobytes(), np.zeros((hi - lo, 64), np.int64)
        for a in range(0, len(row), STEP):
            some = slice(a, a + STEP)
            h = np.fromiter((xxhash.xxh64_intdigest(raw[x:y], SEED) for x, y in zip(s[first[some]].tolist(), e[last[some]].tolist())), np.uint64)
            new = np.flatnonzero(np.r_[True, row[some][1:] != row[some][:-1]])
            bits = np.unpackbits(h.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones[row[some][new]] += np.add.reduceat(bits, new, axis=0, dtype=np.int64)
        yield lo, hi, (2 * ones > n[:, None]) @ (np.uint64(1) << np.arange(64, dtype=np.uint64))


def fingerprints(docs: DataFrame, k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of docs (doc_id, text)."""

    def run(it):
        for batch in batches(it):
            for lo, hi, fp in simhashes(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(fp.view(np.int64))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def ball(radius: int) -> list[int]:
    """Differences of up to radius bits, as signed 64-bit numbers."""
    flips = [sum(1 << b for b in some) for r in range(radius + 1) for some in combinations(range(64), r)]
    return [m - (1 << 64) if m >> 63 else m for m in flips]


def links_within(classes: DataFrame, radius: int) -> DataFrame:
    """Links (a, b) of classes (fp, rep), each fp once: they join the rep that all meet on a word to the others there.

    Of a word's visitors those within half the radius (rounded down) and those within the rest of it differ in at most `radius` bits, so
    the least near one is linked to all, and no link needs a pair of its own. A word has no more visitors than the ball has words."""
    if not 0 <= radius <= 4:
        raise ValueError("radius must be 0 to 4: a fingerprint is sent to every word within half of it")
    near, far = radius // 2, radius - radius // 2
    sent = classes.select("rep", "fp", F.explode(F.lit(ball(far))).alias("mask")).select("rep", "fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("word"), (F.bit_count("mask") <= near).alias("near"))
    least = F.min(F.when(F.col("near"), F.struct("rep", "fp"))).over(Window.partitionBy("word"))
    met = sent.withColumn("least", least).where(F.col("least").isNotNull() & (F.col("least.rep") != F.col("rep")))
    exact = met.where(F.bit_count(F.col("fp").bitwiseXOR(F.col("least.fp"))) <= radius)
    return exact.select(F.least("rep", "least.rep").alias("a"), F.greatest("rep", "least.rep").alias("b")).distinct()


def find_near_duplicates(docs: DataFrame, radius: int = RADIUS, k: int = SHINGLE) -> DataFrame:
    """For each row: doc_id, fingerprint (16 hex digits), component_id, kept. Fingerprints within `radius` bits are linked; component_id is
    the least id reached, kept marks it.

    Texts without words have fingerprint 0 and are linked with each other. A row with a null id links nothing: component_id null, kept.
    Repeated rows get equal results, no rows give none; further columns are ignored. Equal fingerprints are one class, sent out once
    and joined back with the frequent ones apart."""
    prints = saved(fingerprints(docs, k))
    named = prints.where("doc_id is not null")
    classes = saved(named.groupBy("fp").agg(F.min("doc_id").alias("rep"), F.count(F.lit(1)).alias("n")))
    # A row with a repeated id and another text has a fingerprint of its own: its class may share its least id, which links them.
    links = saved(links_within(classes, radius))
    labels = saved(components(links))
    of = saved(classes.join(labels.withColumnRenamed("node", "rep"), "rep", "left").select("fp", "n", F.coalesce("label", "rep").alias("component_id")))
    discard(links, labels, classes)
    total = named.count()
    out = deal_join(named, of, "fp", "n", total).unionByName(prints.where("doc_id is null").withColumn("component_id", F.lit(None).cast("long")))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return out.select("doc_id", hexed.alias("fingerprint"), "component_id", F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"))
