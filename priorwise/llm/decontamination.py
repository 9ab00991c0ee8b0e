"""Benchmark decontamination by greedy string tiling: seeds of shared words, then the longest unmarked matches first,
until the tiles cover enough of a test item, in whatever order its parts stand."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, batches, discard, list_column, packed, ranges, saved, text_chunks, window_hashes, word_hashes, word_spans

MIN_MATCH = 5
COVERAGE = 0.8
#: Characters of benchmark items that may travel to the tasks; a larger benchmark meets the documents in joins.
PART_CHARS = 8_000_000
_GAP = SPACE.copy()
_GAP[:128] = True
_GAP[48:58] = _GAP[65:91] = _GAP[97:123] = False


def tokens(column: pa.Array):
    """(first row, end row, hashes of the words, number of the first of each row and the total): runs of letters and digits in lower case."""
    for lo, hi, data, offs in text_chunks(pc.utf8_lower(pc.fill_null(column, ""))):
        starts, ends, bounds = word_spans(data, offs, _GAP)
        yield lo, hi, word_hashes(data, starts, ends), bounds


def _windows(h: np.ndarray, used: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the windows of n words without a used one."""
    total = np.concatenate([[0], np.cumsum(used)])
    at = np.flatnonzero(total[n:] == total[: len(total) - n])
    return at, window_hashes(h, n)[at]


def _met(text: np.ndarray, used: np.ndarray, item: np.ndarray, in_item: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Unmarked windows of n words that both sides have: their starts and hashes in the text and in the item, both by start."""
    at, h = _windows(text, used, n)
    to, g = _windows(item, in_item, n)
    keys = np.unique(g)
    if not len(keys):
        return at[:0], h[:0], to[:0], g[:0]
    same = keys[np.minimum(np.searchsorted(keys, h), len(keys) - 1)] == h
    at, h = at[same], h[same]
    both = np.isin(g, h)
    return at, h, to[both], g[both]


def tile(text: np.ndarray, item: np.ndarray, k: int, used: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """Tiles (place in the text, place in the item, length) of two sequences of word hashes: the longest match of unmarked words first, of
    equals the first in the item, then in the text; matches shorter than k don't count. `used` marks words of the text from the start.

    Pairs of places are never listed. The greatest length at which both sides share an unmarked window is found by bisection over window
    hashes, all matches of that length are marked, and the next length is less; memory is that of a few arrays as long as the text."""
    used = np.zeros(len(text), bool) if used is None else used.copy()
    in_item = np.zeros(len(item), bool)
    out: list[tuple[int, int, int]] = []
    top = min(len(item), len(text))
    while top >= k and not in_item.all():
        if not len((found := _met(text, used, item, in_item, top))[0]):
            low, high, found = k - 1, top, None  # both share a window of `low` words (or low < k) and none of `high`
            while high - low > 1:
                n = (low + high) // 2
                if len((tried := _met(text, used, item, in_item, n))[0]):
                    low, found = n, tried
                else:
                    high = n
            if found is None:
                break
            top = low
        at, h, to, g = found
        order = np.argsort(h, kind="stable")
        keys, places = h[order], at[order]
        begin, end = np.searchsorted(keys, g).tolist(), np.searchsorted(keys, g, side="right").tolist()
        next_: dict[int, int] = {}
        for b, lo, hi in zip(to.tolist(), begin, end):
            if in_item[b] or in_item[b + top - 1]:  # tiles made at this length are as long, so an end lies in any that overlaps
                continue
            i = next_.get(lo, lo)
            while i < hi and (used[places[i]] or used[places[i] + top - 1]):
                i += 1
            next_[lo] = i
            if i < hi:
                a = int(places[i])
                out.append((a, b, top))
                used[a : a + top] = True
                in_item[b : b + top] = True
        top -= 1
    return out


def rarest(seeds: np.ndarray, count: np.ndarray, m: int, k: int, coverage: float) -> np.ndarray:
    """Which of an item's windows (seeds, by place; count: items that have them) must be looked up. The most frequent are left out as long as
    all windows left out cover too few words to make a match by themselves: a text that covers the item then has one of the others."""
    keep, marked, covered = np.ones(len(seeds), bool), np.zeros(m, bool), 0
    for i in np.argsort(-count, kind="stable"):
        if count[i] < 2:
            break
        more = int((~marked[i : i + k]).sum())
        if covered + more >= coverage * m:
            break
        marked[i : i + k] = True
        covered += more
        keep[i] = False
    return keep


def covering(text: np.ndarray, words: np.ndarray, k: int, coverage: float) -> tuple[float, list] | None:
    """(covered share, tiles) of an item in a text, both as word hashes, if enough is covered. Only the text's runs of words that
    stand in a window of the item are tiled, with a marked word between runs."""
    m, k = len(words), min(k, len(words))
    seeds, mine = window_hashes(text, k), window_hashes(words, k)
    keys = np.unique(mine)
    if not len(seeds) or not len(keys):
        return None
    hits = np.flatnonzero(keys[np.minimum(np.searchsorted(keys, seeds), len(keys) - 1)] == seeds)
    here = np.flatnonzero(np.isin(mine, seeds[hits]))
    edge = np.zeros(m + 1, int)
    np.add.at(edge, here, 1)
    np.add.at(edge, here + k, -1)
    if (np.cumsum(edge)[:m] > 0).sum() < coverage * m:
        return None  # all hits together cover too little
    new = np.flatnonzero(np.r_[True, np.diff(hits) > k])  # runs that a word or more lies between
    starts, ends = hits[new], hits[np.append(new[1:], len(hits)) - 1] + k
    places = ranges(starts, np.minimum(ends + 1, len(text)) - starts)
    used = np.zeros(len(places), bool)
    used[np.cumsum(np.minimum(ends + 1, len(text)) - starts)[ends < len(text)] - 1] = True
    tiles = tile(text[places], words, k, used)
    covered = sum(n for _, _, n in tiles) / m
    return (covered, sorted((int(places[a]), b, n) for a, b, n in tiles)) if covered >= coverage else None


@dataclass
class Index:
    """Words and the rarest Karp-Rabin windows of test items; an item of fewer than k words is matched as a whole."""

    items: list
    words: list[np.ndarray]
    k: int
    coverage: float = COVERAGE

    def __post_init__(self):
        self.by_size = {}
        for k in sorted({min(self.k, len(w)) for w in self.words}):
            mine = [i for i, w in enumerate(self.words) if min(self.k, len(w)) == k]
            h = [window_hashes(self.words[i], k) for i in mine]
            found, count = np.unique(np.concatenate([np.unique(x) for x in h]), return_counts=True)
            h = [np.unique(x[rarest(x, count[np.searchsorted(found, x)], len(self.words[i]), k, self.coverage)]) for i, x in zip(mine, h)]
            keys, item = np.concatenate(h), np.repeat(mine, [len(x) for x in h])
            order = np.argsort(keys, kind="stable")
            seen = np.zeros(1 << 20, bool)
            seen[(keys >> np.uint64(44)).astype(np.int64)] = True
            self.by_size[k] = keys[order], item[order], seen

    def candidates(self, words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Distinct rows (row, item's number) that share a looked-up window."""
        found = [np.zeros((0, 2), np.int64)]
        for k, (keys, item, seen) in self.by_size.items():
            h = window_hashes(words, k)
            at = np.flatnonzero(seen[(h >> np.uint64(44)).astype(np.int64)])
            row = np.searchsorted(bounds, at, side="right") - 1
            ok = at + k <= bounds[np.minimum(row + 1, len(bounds) - 1)]
            met = np.unique(np.stack([row[ok].astype(np.uint64), h[at[ok]]], 1), axis=0) if ok.any() else np.zeros((0, 2), np.uint64)
            lo, hi = np.searchsorted(keys, met[:, 1]), np.searchsorted(keys, met[:, 1], side="right")
            found.append(np.stack([np.repeat(met[:, 0].astype(np.int64), hi - lo), item[ranges(lo, hi - lo)]], 1))
        return np.unique(np.concatenate(found), axis=0)

    def matches(self, words: np.ndarray, bounds: np.ndarray, coverage: float) -> dict[int, list]:
        """By row: (item's number, covered share, tiles) of the items covered enough."""
        out: dict[int, list] = {}
        for r, i in self.candidates(words, bounds).tolist():
            if found := covering(words[bounds[r] : bounds[r + 1]], self.words[i], self.k, coverage):
                out.setdefault(r, []).append((i, *found))
        return out


def indexes(benchmark: DataFrame, k: int = MIN_MATCH, part_chars: int = PART_CHARS, coverage: float = COVERAGE) -> list[Index]:
    """The benchmark (item_id, text) in parts of about part_chars characters (counted first). Items without words or id are left out."""
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    parts = -(-total // part_chars)
    out = []
    for part in range(parts):
        t = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(parts)) == part).orderBy("item_id", "text").toArrow().combine_chunks()
        words = [h[b[i] : b[i + 1]] for lo, hi, h, b in (tokens(t.column("text").combine_chunks()) if t.num_rows else ()) for i in range(hi - lo)]
        ids = t.column("item_id").to_pylist()
        some = [i for i, w in enumerate(words) if len(w)]
        if some:
            out.append(Index([ids[i] for i in some], [words[i] for i in some], k, coverage))
    return out


TILES = "array<struct<doc_start:int,item_start:int,length:int>>"
LEAK = f"doc_id long, item_id long, coverage double, n_tiles int, tiles {TILES}"
KEYED = LEAK.replace("doc_id long,", "doc_id long, k1 long, k2 long,")
KIND = pa.list_(pa.struct([("doc_start", pa.int32()), ("item_start", pa.int32()), ("length", pa.int32())]))


def _leak_batch(rows: list[tuple]) -> pa.RecordBatch:
    """rows: doc_id, k1, k2, item_id, covered share, tiles."""
    cols = list(zip(*rows)) if rows else [()] * 6
    tiles = [[{"doc_start": a, "item_start": b, "length": n} for a, b, n in t] for t in cols[5]]
    made = [*[pa.array(c, pa.int64()) for c in cols[:4]], pa.array(cols[4], pa.float64()), pa.array([len(t) for t in tiles], pa.int32()), pa.array(tiles, KIND)]
    return pa.RecordBatch.from_arrays(made, ["doc_id", "k1", "k2", "item_id", "coverage", "n_tiles", "tiles"])


def _by_index(docs: DataFrame, index: Index, coverage: float) -> DataFrame:
    """Leaks of docs (doc_id, text, k1, k2) against items that travel to the tasks: for a benchmark of a checked size."""

    def run(it):
        for batch in batches(it):
            named = [batch.column(i).to_pylist() for i in (0, 2, 3)]
            for lo, _, words, bounds in tokens(batch.column(1)):
                if rows := [(*[c[lo + r] for c in named], index.items[i], *found) for r, several in index.matches(words, bounds, coverage).items() for i, *found in several]:
                    yield _leak_batch(rows)

    return docs.mapInArrow(run, KEYED)


def _by_joins(docs: DataFrame, benchmark: DataFrame, k: int, coverage: float) -> DataFrame:
    """The same for a benchmark of any size: items and candidate texts meet in joins on the items' rarest windows; the driver only
    gets a bit set of them (16 bits a window, 2 ** 20 to 2 ** 30), by which tasks leave out texts without any."""

    def item_words(it):
        for batch in batches(it):
            for lo, hi, words, bounds in tokens(batch.column(1)):
                ids = batch.column(0).slice(lo, hi - lo)
                sizes = np.diff(bounds)
                seeds = [window_hashes(words[a:b], min(k, b - a)) if b > a else words[:0] for a, b in zip(bounds, bounds[1:])]
                lists = list_column(np.concatenate(seeds).view(np.int64), np.array([len(x) for x in seeds]), pa.int64())
                yield pa.RecordBatch.from_arrays([ids, packed(words, sizes).cast(pa.binary()), pa.array(sizes.astype(np.int32)), lists], ["item_id", "words", "m", "seeds"])

    source = benchmark.select(F.col("item_id").cast("long").alias("item_id"), "text").dropna()
    items = saved(source.mapInArrow(item_words, "item_id long, words binary, m int, seeds array<long>").where("m > 0").withColumn("item", F.monotonically_increasing_id()))
    places = items.select("item", "m", F.posexplode("seeds").alias("at", "seed"))
    counts = places.select("item", "seed").distinct().groupBy("seed").agg(F.count(F.lit(1)).alias("n"))

    def probes_of(it):
        for frame in it:
            out = [np.unique(s[rarest(s, c, m, min(k, m), coverage)]) for m, s, c in ((m, *np.array([[x["seed"], x["n"]] for x in sorted(p, key=lambda x: x["at"])], np.int64).T) for m, p in zip(frame["m"], frame["p"]))]
            yield pd.DataFrame({"item": frame["item"], "seed": out}).explode("seed").dropna().astype("int64")

    each = places.join(counts, "seed").groupBy("item", "m").agg(F.collect_list(F.struct("at", "seed", "n")).alias("p"))
    probes = saved(each.mapInPandas(probes_of, "item long, seed long"))
    n = probes.select("seed").distinct().count()
    bits = min(30, max(20, (16 * n).bit_length()))
    cell = F.shiftrightunsigned("seed", 64 - bits)
    filled = probes.select(cell.alias("c")).select(F.shiftright("c", 6).alias("at"), F.expr("shiftleft(1L, cast(c & 63 as int))").alias("b")).groupBy("at").agg(F.bit_or("b").alias("word"))
    got = filled.toArrow()
    held = np.zeros(1 << (bits - 6), np.int64)
    held[np.asarray(got.column("at"))] = np.asarray(got.column("word"))
    seen = docs.sparkSession.sparkContext.broadcast(held)
    sizes = [r[0] for r in items.select(F.least("m", F.lit(k)).alias("k")).distinct().collect()]

    def scan(it):
        bitset = seen.value.view(np.uint64)
        for batch in batches(it):
            for lo, hi, words, bounds in tokens(batch.column(1)):
                met = [[] for _ in range(hi - lo)]
                for size in sizes:
                    h = window_hashes(words, size)
                    c = h >> np.uint64(64 - bits)
                    at = np.flatnonzero((bitset[(c >> np.uint64(6)).astype(np.int64)] >> (c & np.uint64(63))) & np.uint64(1))
                    row = np.searchsorted(bounds, at, side="right") - 1
                    ok = at + size <= bounds[np.minimum(row + 1, len(bounds) - 1)]
                    for r, x in zip(row[ok].tolist(), h[at[ok]]):
                        met[r].append(x)
                some = [r for r, x in enumerate(met) if x]
                if some:
                    hits = [np.unique(np.array(met[r], np.uint64)).view(np.int64) for r in some]
                    mine = pa.array([lo + r for r in some])
                    text = [words[bounds[r] : bounds[r + 1]].tobytes() for r in some]
                    lists = list_column(np.concatenate(hits), np.array([len(x) for x in hits]), pa.int64())
                    yield pa.RecordBatch.from_arrays([*[batch.column(i).take(mine) for i in (0, 2, 3)], pa.array(text, pa.binary()), lists], ["doc_id", "k1", "k2", "text_words", "seeds"])

    texts = saved(docs.mapInArrow(scan, "doc_id long, k1 long, k2 long, text_words binary, seeds array<long>").withColumn("doc", F.monotonically_increasing_id()))
    pairs = texts.select("doc", F.explode("seeds").alias("seed")).join(probes, "seed").select("doc", "item").distinct()
    met = pairs.join(items.select("item", "item_id", "words"), "item").join(texts.drop("seeds"), "doc").select("doc_id", "k1", "k2", "item_id", "words", "text_words")

    def tiled(it):
        for batch in batches(it):
            named = [batch.column(i).to_pylist() for i in range(4)]
            rows = []
            for i, (item, text) in enumerate(zip(batch.column(4), batch.column(5))):
                if found := covering(np.frombuffer(text.as_buffer(), np.uint64), np.frombuffer(item.as_buffer(), np.uint64), k, coverage):
                    rows.append((*[c[i] for c in named], *found))
            if rows:
                yield _leak_batch(rows)

    out = saved(met.mapInArrow(tiled, KEYED))
    discard(items, probes, texts)
    return out


def _leaks(docs: DataFrame, benchmark: DataFrame, k: int, coverage: float, part_chars: int) -> DataFrame:
    docs = docs.select("doc_id", "text", F.xxhash64("text").alias("k1"), F.xxhash64(F.lit(7), "text").alias("k2"))
    total = benchmark.dropna(subset=["item_id", "text"]).agg(F.sum(F.length("text"))).first()[0] or 0
    if total > part_chars:
        return _by_joins(docs, benchmark, k, coverage)
    found = indexes(benchmark, k, max(part_chars, 1), coverage)
    return _by_index(docs, found[0], coverage) if found else docs.sparkSession.createDataFrame([], KEYED)


def find_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, part_chars: int = PART_CHARS) -> DataFrame:
    """A row for each document and item that it covers to `coverage` at least: doc_id, item_id, coverage, n_tiles, tiles.

    Words are runs of letters and digits in lower case; a null text has none. Repeated rows of either side each give rows.
    A benchmark of up to part_chars characters (counted) travels to the tasks, a larger one meets candidate texts in joins.
    Empty tables give no rows; other columns are ignored."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return _leaks(docs, benchmark, min_match, coverage, part_chars).drop("k1", "k2")


def drop_leaks(docs: DataFrame, benchmark: DataFrame, min_match: int = MIN_MATCH, coverage: float = COVERAGE, text: str = "text", part_chars: int = PART_CHARS) -> DataFrame:
    """docs without the rows whose text covers an item. Rows are judged by their text alone, so repeated rows go or stay together and ids may be
    null; null and empty texts stay, all other columns are kept, and an empty benchmark drops nothing."""
    gone = saved(_leaks(docs.select(F.lit(0).cast("long").alias("doc_id"), F.col(text).alias("text")), benchmark, min_match, coverage, part_chars).select(F.col("k1").alias("_k1"), F.col("k2").alias("_k2")).distinct())
    short = gone.limit(200_001).count() <= 200_000
    return docs.join(F.broadcast(gone) if short else gone, (F.xxhash64(docs[text]) == gone["_k1"]) & (F.xxhash64(F.lit(7), docs[text]) == gone["_k2"]), "left_anti")
