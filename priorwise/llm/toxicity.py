"""Toxicity scores: a linear classifier over character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, discard, list_column, mix, saved, trim

ORDERS = (3, 4, 5, 6)
BITS = 20
FEATURES = 4096
#: Bound on the labelled rows that a model is fitted on: those of the smallest hashes of doc_id.
SAMPLE_ROWS = 10_000
SAMPLE_PARTS = 8
LEAST_ROWS = 4
_STEP = [np.uint64(int(x) | 1) for x in mix(np.arange(3, 3 + max(ORDERS), dtype=np.uint64))]
SPACES = np.array([0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D], np.uint32)


def _ngrams(text: str, first: np.ndarray, keep: np.ndarray | None) -> np.ndarray:
    """Distinct (row << BITS | feature) of the n-grams of a lower-case text whose rows begin at the places `first`, order by order."""
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    space = np.isin(chars, SPACES)
    code = np.where(space, np.uint64(0x20), chars.astype(np.uint64))
    found = []
    h, inner = code * _STEP[0], np.zeros(len(chars), bool)
    for n in range(2, max(ORDERS) + 1):  # h and inner: of the n-gram that begins at each place; inner: a space within
        m = len(chars) - n + 1
        if m <= 0:
            break
        if n > 2:
            inner = inner[:m] | space[n - 2 : n - 2 + m]
        h = h[:m] + code[n - 1 :] * _STEP[n - 1]
        if n in ORDERS:
            f = (mix(h) >> np.uint64(64 - BITS)).astype(np.int64)
            at = np.flatnonzero(~inner if keep is None else keep[f] & ~inner)
            found.append(np.unique((np.searchsorted(first, at, side="right") - 1) << BITS | f[at]))
    return np.unique(np.concatenate([np.zeros(0, np.int64), *found]))


def grams(texts: list[str | None], keep: np.ndarray | None = None, limit: int = 1 << 17) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(number of rows, row, feature): the distinct n-grams of each lower-case text, hashed to BITS bits, white space as one kind of mark
    that only begins or ends an n-gram. keep: only features where it is true. In runs of about `limit` characters; a longer text
    is read in overlapping pieces, so memory is bounded whatever its length."""
    lo = 0
    while lo < len(texts):
        hi, size = lo, 0
        while hi < len(texts) and (hi == lo or size + len(texts[hi] or "") < limit):
            size += len(texts[hi] or "") + 1
            hi += 1
        if size > limit + 1:
            text, seen = f" {texts[lo].lower()} ", np.zeros(1 << BITS, bool)
            for a in range(0, len(text), limit):
                seen[_ngrams(text[a : a + limit + max(ORDERS) - 1], np.zeros(1, np.int64), keep)] = True
            f = np.flatnonzero(seen)
            yield 1, np.zeros(len(f), np.int64), f
        else:
            run = [" " + (t or "").lower() for t in texts[lo:hi]]
            both = _ngrams(" ".join(run) + " ", np.cumsum([0, *[len(t) + 1 for t in run]]), keep)
            yield hi - lo, both >> BITS, both & ((1 << BITS) - 1)
        lo = hi


@dataclass
class Model:
    """features and their weights; bias -inf: nothing was learnt, and every score is 0."""

    features: np.ndarray
    values: np.ndarray
    bias: float

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """Probabilities: the logistic of bias plus the mean-scaled sum of the weights of the features present."""
        if self.bias == -np.inf:
            return np.zeros(len(texts))
        weights = np.zeros(1 << BITS)
        weights[self.features] = self.values
        out, keep = [], weights != 0
        for n, row, f in grams(texts, keep):
            total = np.bincount(row, weights[f], n)
            out.append(total / np.sqrt(np.maximum(np.bincount(row, minlength=n), 1)))
        z = np.concatenate(out) if out else np.zeros(0)
        return 1 / (1 + np.exp(-np.clip(z + self.bias, -30, 30)))


def log_count_ratios(positive: np.ndarray, negative: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """log((positive + alpha) / |.|) - log((negative + alpha) / |.|) by feature."""
    p, q = positive + alpha, negative + alpha
    return np.log(p / p.sum()) - np.log(q / q.sum())


def fit_logistic(row: np.ndarray, col: np.ndarray, value: np.ndarray, y: np.ndarray, n_cols: int, l2: float, steps: int) -> tuple[np.ndarray, float]:
    """L2-regularised logistic regression on sparse triples in the order of their rows, by accelerated gradient steps."""
    n = len(y)
    counts = np.bincount(row, minlength=n)
    ends = np.concatenate([[0], np.cumsum(counts)])
    totals = np.zeros(len(col) + 1)
    w, b, t = np.zeros(n_cols), float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))), 1.0
    vw, vb = w.copy(), b
    np.cumsum(value**2, out=totals[1:])
    rate = 1 / (0.25 * max(float(np.diff(totals[ends]).max(initial=0)) + 1, 1e-9) + l2)
    for _ in range(steps):
        np.cumsum(value * vw[col], out=totals[1:])
        g = 1 / (1 + np.exp(-np.clip(np.diff(totals[ends]) + vb, -30, 30))) - y
        nw = vw - rate * (np.bincount(col, value * np.repeat(g, counts), n_cols) / n + l2 * vw)
        nb = vb - rate * g.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


def training_rows(labels: DataFrame, folds: int = 5, held: int = 0, rows: int = SAMPLE_ROWS) -> DataFrame:
    """(doc_id, y): at most `rows` labelled documents outside the held-out fold (crc32 of doc_id as text, modulo folds).
    Null ids and labels are ignored; of repeated ids the larger label counts."""
    fold = F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(folds))
    some = labels.dropna(subset=["doc_id", "toxic"]).where(fold != held).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y"))
    return some.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def fit(docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, rows: int = SAMPLE_ROWS, n_features: int = FEATURES, l2: float = 1e-5, steps: int = 600) -> Model:
    """A model from a bounded sample of labelled documents; it never sees anything but texts and labels.

    Tasks count features by class and send compressed counts (2 ** BITS places) of SAMPLE_PARTS parts; the features that differ
    most between the classes are kept, and the sample's rows of these features are fitted on the driver."""
    sample = saved(docs.select("doc_id", "text").join(F.broadcast(training_rows(labels, folds, held, rows)), "doc_id").select("text", "y").repartition(SAMPLE_PARTS))

    def count(it):
        total, n = np.zeros((2, 1 << BITS), np.int32), np.zeros(2, np.int64)
        for batch in batches(it):
            y, lo = np.array(batch.column(1)), 0
            n += np.bincount(y, minlength=2)[:2]
            for size, row, f in grams(batch.column(0).to_pylist()):
                of = y[lo : lo + size][row]
                for k in (0, 1):
                    total[k] += np.bincount(f[of == k], minlength=1 << BITS).astype(np.int32)
                lo += size
        yield pa.RecordBatch.from_pydict({"n0": [int(n[0])], "n1": [int(n[1])], "counts": [zlib.compress(total.tobytes(), 1)]})

    parts = sample.mapInArrow(count, "n0 long, n1 long, counts binary").collect()
    n0, n1 = sum(r[0] for r in parts), sum(r[1] for r in parts)
    if not n0 or not n1:
        discard(sample)
        return Model(np.zeros(0, np.int64), np.zeros(0), -np.inf)
    total = np.zeros((2, 1 << BITS), np.int32)
    for r in parts:
        total += np.frombuffer(zlib.decompress(r[2]), np.int32).reshape(2, -1)
    negative, positive = total.astype(float)
    share = (positive + negative) / (n0 + n1)
    apart = np.abs(positive / n1 - negative / n0) / np.sqrt(share * (1 - share) * (1 / n0 + 1 / n1) + 1e-12)
    apart[positive + negative < min(LEAST_ROWS, n1)] = 0
    chosen = np.argsort(-apart, kind="stable")[:n_features]
    chosen = np.sort(chosen[apart[chosen] > 0])
    ratio = log_count_ratios(positive, negative)[chosen]

    def features(it):
        place = np.full(1 << BITS, -1, np.int32)
        place[chosen] = np.arange(len(chosen))
        for batch in batches(it):
            rows_of, cols, lo = [], [], 0
            for size, row, f in grams(batch.column(0).to_pylist(), place >= 0):
                rows_of.append(row + lo)
                cols.append(place[f])
                lo += size
            counts = np.bincount(np.concatenate(rows_of), minlength=batch.num_rows)
            yield pa.RecordBatch.from_arrays([list_column(np.concatenate(cols), counts, pa.int32()), batch.column(1)], ["f", "y"])

    got = sample.mapInArrow(features, "f array<int>, y int").toArrow()
    discard(sample)
    lists = got.column("f").combine_chunks()
    counts = np.asarray(pc.list_value_length(lists))
    row, col = np.repeat(np.arange(len(lists), dtype=np.int32), counts), np.asarray(lists.flatten()).astype(np.int64)
    value = ratio[col] / np.sqrt(np.repeat(counts, counts))
    w, b = fit_logistic(row, col, value, np.asarray(got.column("y")).astype(float), len(chosen), l2, steps)
    return Model(chosen, w * ratio, float(b))


def scorer(model: Model):
    """A column function: the score of a text (0 to 1; a null text like an empty one)."""

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        out = pd.Series(model.scores(texts.tolist()))
        trim()
        return out

    return score


def score_toxicity(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """docs with score (0 to 1; a null text like an empty one) and predicted (1 if score >= 0.5), which replace columns of these names.
    Repeated rows get equal scores; no rows give no rows."""
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("score", "predicted")])
    return docs.withColumn("score", scorer(model)(F.col(text))).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """The rows of docs with a score below 0.5, all their columns as they are, whatever their names."""
    return docs.where(scorer(model)(F.col(text)) < 0.5)
