"""Importance resampling towards a target: hashed n-gram counts of corpus and target give each bucket a gain, a document's weight is
its mean gain, and the highest weights with Gumbel noise are drawn.

Long texts are cut at word boundaries into chunks that go to different tasks. A chunk owns the n-grams that start in its words and
carries the n-1 words after them, so each n-gram is counted once; counts and gains of chunks are summed by document."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, batches, discard, joined_words, packed, saved, text_chunks, word_spans

N = 1
BUCKETS = 10_000
#: Characters above which a text is cut, and bytes after which a chunk ends at the next word boundary.
CHUNK = 1 << 16
MIN_WORDS = 20
#: Words: runs of digits, letters and all that is not ASCII.
GAP = SPACE.copy()
GAP[:128] = True
GAP[48:58] = GAP[65:91] = GAP[97:123] = False


def _crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0xEDB88320), t >> 1)
    return t


TABLE = _crc_table()


def crc32_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step_bytes: int = 64) -> np.ndarray:
    """Unsigned CRC-32 of each data[s:e]: a byte of all spans at a time; spans of more than step_bytes one by one."""
    size = np.minimum(ends - starts, step_bytes + 1)
    order = np.argsort(size.astype(np.uint8 if step_bytes < 255 else np.int64), kind="stable")[::-1]
    at, longest = starts[order], size[order]
    crc = np.full(len(at), 0xFFFFFFFF, np.uint32)
    more = len(at) - np.searchsorted(longest[::-1], np.arange(step_bytes), side="right")
    for j, m in enumerate(more):
        if not m:
            break
        c = crc[:m]
        crc[:m] = TABLE[(c ^ data[at[:m] + j]) & 255] ^ (c >> 8)
    out = np.empty(len(at), np.uint32)
    out[order] = ~crc
    for i in np.flatnonzero(size > step_bytes):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def chunks(text: bytes, n: int, size: int = CHUNK) -> Iterator[tuple[int, bytes]]:
    """(own words, bytes) of each chunk: whole words of about `size` bytes, then the n-1 words that follow. No words: one empty chunk."""
    data, lo = np.frombuffer(text, np.uint8), 0

    def boundary(at: int) -> int:
        """The first place from `at` on that no word covers."""
        while at < len(data):
            gap = GAP[data[at : at + 4096]]
            if gap.any():
                return at + int(gap.argmax())
            at += len(gap)
        return len(data)

    some = False
    while lo < len(data):
        cut = boundary(min(lo + size, len(data)))
        end = cut
        for _ in range(n - 1):
            while end < len(data) and GAP[data[end]]:
                end += 1
            end = boundary(end)
        own = len(word_spans(data[lo:cut], np.array([0, cut - lo]), GAP)[0])
        if own:
            some = True
            yield own, text[lo:end]
        lo = cut
    if not some:
        yield 0, b""


def _cut(n: int, size: int):
    def run(it):
        for batch in batches(it):
            for i, (doc, row, text) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)))):
                for nth, (own, piece) in enumerate(chunks(text.encode(), n, size)):
                    yield pa.RecordBatch.from_arrays([pa.array([doc], pa.int64()), pa.array([row], pa.int64()), pa.array([nth], pa.int32()), pa.array([own], pa.int32()), pa.array([piece.decode()], pa.string())], ["doc_id", "row", "nth", "own", "text"])

    return run


def buckets_of(column: pa.Array, own: np.ndarray, n: int, buckets: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(first row, end row, words of the rows, features of the rows, their buckets): runs of 1 to n words that start in a text's first
    own words (negative: all)."""
    for lo, hi, data, offs in text_chunks(column):
        starts, ends, bounds = word_spans(data, offs, GAP)
        flat, s, e = joined_words(data, starts, ends)
        words = np.diff(bounds)
        mine = np.where(own[lo:hi] < 0, words, np.minimum(words, own[lo:hi]))
        row, place = np.repeat(np.arange(hi - lo), words), np.arange(len(s)) - np.repeat(bounds[:-1], words)
        found, of = [], []
        for k in range(n):
            at = np.flatnonzero((place < mine[row]) & (place + k < words[row]))
            found.append(crc32_spans(flat, s[at], e[at + k]) % np.uint32(buckets))
            of.append(row[at])
        rows = np.concatenate(of)
        order = np.argsort(rows, kind="stable")
        yield lo, hi, mine, np.bincount(rows, minlength=hi - lo), np.concatenate(found)[order]


def features(texts: DataFrame, n: int = N, buckets: int = BUCKETS, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, row, n_words, n_features, buckets) of texts (doc_id, text): a row for a text of up to `chunk` characters (row null), a
    row for each chunk of a longer one, whose row number they share. Chunks are dealt out, so a long text is the work of many tasks."""
    kind = np.dtype(np.uint16 if buckets <= 1 << 16 else np.uint32)

    def run(it):
        for batch in batches(it):
            own = batch.column("own").to_numpy(zero_copy_only=False)
            for lo, hi, words, count, found in buckets_of(batch.column("text"), own, n, buckets):
                ids = [batch.column(c).slice(lo, hi - lo) for c in ("doc_id", "row")]
                yield pa.RecordBatch.from_arrays([*ids, pa.array(words.astype(np.int64)), pa.array(count.astype(np.int64)), packed(found.astype(kind), count).cast(pa.binary())], ["doc_id", "row", "n_words", "n_features", "buckets"])

    texts = texts.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    short = texts.where(F.coalesce(F.length("text"), F.lit(0)) <= chunk).select("doc_id", F.lit(None).cast("long").alias("row"), F.lit(-1).alias("own"), "text")
    long_ = texts.where(F.length("text") > chunk).select("doc_id", F.monotonically_increasing_id().alias("row"), "text")
    parts = long_.mapInArrow(_cut(n, chunk), "doc_id long, row long, nth int, own int, text string").repartition("row", "nth")
    return short.unionByName(parts.drop("nth")).mapInArrow(run, "doc_id long, row long, n_words long, n_features long, buckets binary")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket; a task sends a row for each bucket that it met, the driver gets one for each bucket."""
    kind = np.dtype(np.uint16 if buckets <= 1 << 16 else np.uint32)

    def run(it):
        total = np.zeros(buckets, np.int64)
        for batch in it:
            raw = pc.binary_join(pa.array([batch.column(0).to_pylist()], pa.list_(pa.binary())), b"")[0].as_buffer() if batch.num_rows else b""
            total += np.bincount(np.frombuffer(raw, kind), minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    rows = found.select("buckets").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = np.zeros(buckets, np.int64)
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of a bucket's smoothed shares in target and corpus, rounded down."""
    k, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.floor(1000 * np.log((target + 1.0) * (s + k) / ((corpus + 1.0) * (t + k)))).astype(np.int64)


def weights(found: DataFrame, gain: np.ndarray) -> DataFrame:
    """(doc_id, n_words, n_features, weight): the mean gain of each document's features, rounded down (none: 0). Chunks of a long text are summed."""
    kind = np.dtype(np.uint16 if len(gain) <= 1 << 16 else np.uint32)

    def run(it):
        for batch in batches(it):
            n = batch.column("n_features").to_numpy()
            raw = b"".join(batch.column("buckets").to_pylist())
            total = np.concatenate([[0], np.cumsum(gain[np.frombuffer(raw, kind)])])
            ends = np.cumsum(n)
            sums = total[ends] - total[ends - n]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("doc_id", "row", "n_words", "n_features")], pa.array(sums)], ["doc_id", "row", "n_words", "n_features", "gain"])

    each = found.mapInArrow(run, "doc_id long, row long, n_words long, n_features long, gain long")
    sums = [F.sum(c).alias(c) for c in ("n_words", "n_features", "gain")]
    long_ = each.where("row is not null").groupBy("doc_id", "row").agg(*sums)
    mean = F.expr("case when n_features > 0 then (gain - pmod(gain, n_features)) div n_features else 0L end")
    return each.where("row is null").unionByName(long_).select("doc_id", "n_words", "n_features", mean.alias("weight"))


def noise(doc_id: Column, seed: int) -> Column:
    """Thousandths of a standard Gumbel value from a hash of the id, rounded down; a null id counts as an empty one."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def drawn(scored: DataFrame, fit: Column, draw: int) -> DataFrame:
    """scored (a saved table with integer scores) with rank: 1, 2, .. for the `draw` highest scores of the fit rows, ties to the smaller doc_id; else null.

    Rows with a higher score are counted by score, in a table of the distinct scores (they are whole thousandths of logarithms, so some ten
    thousands at any size); a window runs within each score that can be drawn."""
    scored = scored.withColumn("_fit", fit)
    above = Window.orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, -1)
    by_score = scored.where("_fit").groupBy("score").agg(F.count(F.lit(1)).alias("_n")).withColumn("_above", F.coalesce(F.sum("_n").over(above), F.lit(0)))
    open_ = saved(by_score.where(F.col("_above") < draw).select("score", "_above"))
    met = scored.join(F.broadcast(open_), "score", "left")
    nth = F.col("_above") + F.row_number().over(Window.partitionBy("score").orderBy(F.col("doc_id").asc_nulls_last(), "n_features", "weight"))
    ranked = met.where("_fit and _above is not null").withColumn("rank", nth.cast("long")).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    rest = met.where("not (_fit and _above is not null)").withColumn("rank", F.lit(None).cast("long"))
    return ranked.unionByName(rest).drop("_fit", "_above")


def resample(docs: DataFrame, target: DataFrame, n: int = N, buckets: int = BUCKETS, percent: int = 10, min_words: int = MIN_WORDS, seed: int = 2024, chunk: int = CHUNK) -> DataFrame:
    """For each document (doc_id, text): doc_id, n_words, n_features, weight, score, rank. target: a table with a text column.

    Of the N documents with min_words words at least, floor(percent * N / 100) are drawn: those of the highest score, weight plus Gumbel
    noise, so the draw is one without replacement in proportion to the exponential of the weight. Null or wordless text: no features,
    weight 0. A null id has the noise of an empty one and comes last in ties. Repeated rows each count and are ranked apart.
    An empty target gives every bucket the smoothed share; no documents give no rows. Further columns are ignored."""
    found = saved(features(docs, n, buckets, chunk))
    aim = features(target.select(F.lit(0).alias("doc_id"), "text"), n, buckets, chunk)
    gain = gains(bucket_counts(found, buckets), bucket_counts(aim, buckets))
    scored = saved(weights(found, gain).withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)))
    discard(found)
    fit = F.col("n_words") >= min_words
    return drawn(scored, fit, percent * scored.where(fit).count() // 100)
