"""Near-duplicates by SuperMinHash: signatures, bands, exact verification on full shingle sets, connected components."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, discard, free_name, mix, packed, ranges, saved, span_hashes, text_chunks, window_hashes, word_hashes, word_spans
from .components import components

SHINGLE = 5
PERCENT = 80
SLOTS = 252
BAND = 6  # slots a band; 42 bands miss a pair of likeness 0.8 once in 340,000
BLOCK = 2048
PIVOTS = 8
#: Shingles whose signatures are made together, and how many a task gathers before.
ELEMENTS, GATHERED = 1 << 15, 1 << 18
U = np.uint64
_DOC_BITS = U(12)
_STEP = U(0x9E3779B97F4A7C15)


def shingle_sets(column: pa.Array, k: int = SHINGLE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, sorted distinct shingles of the rows as 52-bit hashes, number of the first of each row and the total).
    Words in lower case (A-Z); fewer than k words are one shingle, no words none."""
    for lo, hi, data, offs in text_chunks(column):
        starts, ends, bounds = word_spans(data, offs)
        h = word_hashes(data, starts, ends, lower=True)
        full, whole = window_hashes(h, k), span_hashes(h, bounds)
        step = 1 << int(_DOC_BITS)
        for a in range(0, hi - lo, step):
            b = min(hi - lo, a + step)
            words = np.diff(bounds[a : b + 1])
            n = np.where(words >= k, words - k + 1, np.minimum(words, 1))
            doc = np.repeat(np.arange(b - a, dtype=np.uint64), n)
            at = np.arange(int(n.sum())) + np.repeat(bounds[a:b] - np.concatenate([[0], np.cumsum(n)[:-1]]), n)
            short = np.repeat(words < k, n)
            v = np.empty(len(at), np.uint64)
            v[~short] = full[at[~short]]
            v[short] = whole[a:b][doc[short].astype(np.int64)]
            v = np.unique((doc << (U(64) - _DOC_BITS)) | (v >> _DOC_BITS))
            first = np.searchsorted(v >> (U(64) - _DOC_BITS), np.arange(b - a + 1, dtype=np.uint64))
            yield lo + a, lo + b, v & U((1 << 52) - 1), first


def super_minhash(v: np.ndarray, first: np.ndarray, slots: int = SLOTS) -> np.ndarray:
    """Signatures (rows by slots). An element has a random permutation of the slots; its j-th slot gets j plus a fraction, and each
    slot keeps the least value. A set is done once all its slots are below the next rank, so large sets need a rank or two."""
    n = len(first) - 1
    out = np.full(n * slots, np.iinfo(np.uint64).max, np.uint64)
    owner = np.repeat(np.arange(n), np.diff(first))
    perm = None
    for j in range(slots):
        if not len(v):
            break
        r = mix(v * U(2 * j + 3) + U((0x9E3779B97F4A7C15 * (j + 1)) & 0xFFFFFFFFFFFFFFFF))
        k = j + (((r & U(0xFFFFFFFF)) * U(slots - j)) >> U(32)).astype(np.int64)
        if perm is None:
            slot = k
        else:
            rows = np.arange(len(v))
            slot = perm[rows, k].astype(np.int64)
            perm[rows, k] = perm[:, j]
        np.minimum.at(out, owner * slots + slot, U(j << 32) | (r >> U(32)))
        open_ = out.reshape(n, slots).max(axis=1) >= U((j + 1) << 32)
        stay = open_[owner]
        if perm is None:
            v, owner, k = v[stay], owner[stay], k[stay]
            perm = np.tile(np.arange(slots, dtype=np.uint8 if slots <= 256 else np.uint16), (len(v), 1))
            perm[np.arange(len(v)), k] = perm[:, 0]
        elif stay.sum() < 0.8 * len(v):
            v, owner, perm = v[stay], owner[stay], perm[stay]
    return out.reshape(n, slots)


def _gathered(column: pa.Array, k: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """shingle_sets with neighbouring chunks joined up to GATHERED shingles."""
    held, size = [], 0
    for part in shingle_sets(column, k):
        held.append(part)
        size += len(part[2])
        if size >= GATHERED:
            yield _joined(held)
            held, size = [], 0
    if held:
        yield _joined(held)


def _joined(parts: list) -> tuple[int, int, np.ndarray, np.ndarray]:
    n = np.concatenate([np.diff(p[3]) for p in parts])
    return parts[0][0], parts[-1][1], np.concatenate([p[2] for p in parts]), np.concatenate([[0], np.cumsum(n)])


def by_size(v: np.ndarray, first: np.ndarray, slots: int) -> np.ndarray:
    """super_minhash in groups of about ELEMENTS shingles, small sets together: they need many ranks and large ones few."""
    n = np.diff(first)
    order = np.argsort(n, kind="stable")
    out = np.empty((len(n), slots), np.uint64)
    group = (np.cumsum(n[order]) - 1) // ELEMENTS
    cuts = np.flatnonzero(np.diff(group, prepend=-2, append=-2))
    for a, b in zip(cuts[:-1], cuts[1:]):
        some = order[a:b]
        out[some] = super_minhash(v[ranges(first[some], n[some])], np.concatenate([[0], np.cumsum(n[some])]), slots)
    return out


def _signatures(slots: int, band: int, k: int):
    def run(it):
        for batch in batches(it):
            for lo, hi, v, first in _gathered(batch.column(1), k):
                sums = [np.concatenate([[U(0)], np.cumsum(mix(v * U(c)))]) for c in (0x9E6C63D0876A9A35, 0xB5026F5AA96619E9)]
                s = by_size(v, first, slots)
                wide = s.reshape(hi - lo, slots // band, band) * (U(2) * np.arange(band, dtype=np.uint64) + U(0x632BE59BD9B4E019))
                keys = mix(wide.sum(axis=2, dtype=np.uint64) + np.arange(slots // band, dtype=np.uint64) * _STEP)
                sig = np.ascontiguousarray((mix(s) & U(255)).astype(np.uint8))
                lists = pa.FixedSizeListArray.from_arrays(pa.array(keys.view(np.int64).ravel()), keys.shape[1]).cast(pa.list_(pa.int64()))
                digests = [pa.array((x[first[1:]] - x[first[:-1]]).view(np.int64)) for x in sums]
                rows = pa.Array.from_buffers(pa.binary(slots), hi - lo, [None, pa.py_buffer(sig)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), pa.array(np.diff(first).astype(np.int64)), *digests, lists, rows], ["doc_id", "n", "d1", "d2", "keys", "sig"])

    return run


def _full_sets(k: int):
    def run(it):
        for batch in batches(it):
            for lo, hi, v, first in shingle_sets(batch.column(1), k):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(lo, hi - lo), packed(v, np.diff(first)).cast(pa.binary())], ["doc_id", "words"])

    return run


def _confirm(percent: int):
    """Pairs with both full sets: those with 100 * common >= percent * union."""

    def run(it):
        for batch in batches(it):
            keep, last, left = [], None, None
            for i, (a, x, y) in enumerate(zip(batch.column("a").to_pylist(), batch.column("set_a"), batch.column("set_b"))):
                if a != last:
                    last, left = a, np.frombuffer(x.as_buffer(), np.uint64)
                right = np.frombuffer(y.as_buffer(), np.uint64)
                small, large = (left, right) if len(left) < len(right) else (right, left)
                if len(small) * 100 < percent * len(large):
                    continue
                at = np.searchsorted(large, small)
                at[at == len(large)] = 0
                common = int((large[at] == small).sum())
                if 100 * common >= percent * (len(left) + len(right) - common):
                    keep.append(i)
            if keep:
                yield pa.RecordBatch.from_arrays([batch.column("a").take(pa.array(keep)), batch.column("b").take(pa.array(keep))], ["a", "b"])

    return run


def confirmed(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """pairs (a, b) of ids whose sets (doc_id, words) are alike enough. Both sides grow with the corpus, so both are dealt out by id at any size."""
    of_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("words").alias("set_b")).hint("merge"), "b")
    return of_b.join(sets.select(F.col("doc_id").alias("a"), F.col("words").alias("set_a")).hint("merge"), "a").select("a", "b", "set_a", "set_b").mapInArrow(_confirm(percent), "a long, b long")


def variance_factor(slots: int, union: np.ndarray) -> np.ndarray:
    """The variance of a SuperMinHash estimate relative to independent slots, by the size of the union of the sets (the method's published formula)."""
    u, k = np.atleast_1d(np.asarray(union, float))[:, None], np.arange(1, slots, dtype=float)
    u = np.maximum(u, 2)
    term = lambda a, b: (a / (slots - 1)) ** u * (b / slots) ** u
    total = (term(k, k + 1) + term(k, k - 1) - 2 * term(k, k)).sum(axis=1)
    return np.clip(1 - total * (slots - 1) / (u[:, 0] - 1), 0.05, 1.0)


def _across(slots: int, percent: int, margin: float = 4.5):
    """From rows sorted by (key, part_a, part_b): pairs of one bucket with different labels whose sizes allow the likeness and whose
    signatures agree in as many slots as it leaves likely (margin deviations below, for sets of their size). Each pair only in the first band
    whose key it shares."""
    p = percent / 100
    unions = np.unique(np.round(2 ** np.arange(0, 16, 0.125)).astype(int))
    spread = margin * np.sqrt(slots * p * (1 - p) * variance_factor(slots, unions)) + 1

    def pairs_of(rows: dict, lo: int, hi: int):
        side_a, side_b = np.flatnonzero(rows["side"][lo:hi] != 1) + lo, np.flatnonzero(rows["side"][lo:hi] != 0) + lo
        step = max(1, 60_000 // max(1, len(side_b)))
        for s in range(0, len(side_a), step):
            x, y = np.meshgrid(side_a[s : s + step], side_b, indexing="ij")
            x, y = x.ravel(), y.ravel()
            n_x, n_y = rows["n"][x], rows["n"][y]
            ok = (rows["label"][x] != rows["label"][y]) & (np.minimum(n_x, n_y) * 100 >= percent * np.maximum(n_x, n_y))
            ok &= (rows["rep"][x] < rows["rep"][y]) | (rows["side"][x] == 0) & (rows["side"][y] == 1)
            x, y = x[ok], y[ok]
            for t in range(0, len(x), 60_000):
                a, b = x[t : t + 60_000], y[t : t + 60_000]
                same = rows["sig"][a] == rows["sig"][b]
                of = np.minimum(np.searchsorted(unions, (rows["n"][a] + rows["n"][b]) / (1 + p)), len(unions) - 1)
                near = same.sum(axis=1) >= np.floor(slots * p - spread[of])
                a, b = a[near], b[near]
                shared = rows["keys"][a] == rows["keys"][b]
                mine = (shared.argmax(axis=1) == rows["band"][a]) | ~shared.any(axis=1)
                yield rows["rep"][a[mine]], rows["rep"][b[mine]]

    def run(it):
        held: list[pa.RecordBatch] = []

        def work(t: pa.Table):
            t = t.combine_chunks()
            rows = {c: np.asarray(t.column(c)) for c in ("key", "pa", "pb", "side", "rep", "label", "n", "band")}
            rows["sig"] = np.frombuffer(b"".join(t.column("sig").to_pylist()), np.uint8).reshape(-1, slots)
            rows["keys"] = np.asarray(t.column("keys").combine_chunks().flatten()).reshape(len(rows["rep"]), -1)
            new = np.flatnonzero(np.r_[True, (rows["key"][1:] != rows["key"][:-1]) | (rows["pa"][1:] != rows["pa"][:-1]) | (rows["pb"][1:] != rows["pb"][:-1])])
            for lo, hi in zip(new, np.append(new[1:], len(rows["key"]))):
                for a, b in pairs_of(rows, lo, hi):
                    if len(a):
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

        for batch in batches(it):
            last = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in ("key", "pa", "pb"))
            begin = tuple(batch.column(c)[0].as_py() for c in ("key", "pa", "pb"))
            if last == begin and held and tuple(held[-1].column(c)[0].as_py() for c in ("key", "pa", "pb")) == begin:
                held.append(batch)
                continue
            same = np.ones(batch.num_rows, bool)
            for c, v in zip(("key", "pa", "pb"), last):
                same &= np.asarray(batch.column(c)) == v
            cut = int(np.argmax(same))
            if held or cut:
                yield from work(pa.Table.from_batches([*held, batch.slice(0, cut)]))
            held = [batch.slice(cut)]
        if held:
            yield from work(pa.Table.from_batches(held))

    return run


def find_near_duplicates(docs: DataFrame, percent: int = PERCENT, k: int = SHINGLE, slots: int = SLOTS, band: int = BAND, block: int = BLOCK, pivots: int = PIVOTS) -> DataFrame:
    """For each row: doc_id, n_shingles, component_id, kept. Links join sets of distinct lower-case k-word shingles with
    100 * common >= percent * union; component_id is the least id reached, kept marks it.

    Texts with equal sets are one class, which its least id stands for. Each bucket's members are first confirmed against its
    least member, in large buckets with several components then against `pivots` members drawn by hash; where that leaves several
    components in a bucket, members of different ones are compared in blocks.
    Null or wordless text: no shingles, linked with nothing. A row with a null id: component_id null, kept. Repeated rows get equal
    results. No rows give no rows."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    all_rows = saved(docs.mapInArrow(_signatures(slots, band, k), "doc_id long, n long, d1 long, d2 long, keys array<long>, sig binary"))
    named = all_rows.where("doc_id is not null and n > 0")
    classes = named.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"))
    reps = named.join(classes.withColumnRenamed("rep", "doc_id"), ["d1", "d2", "n", "doc_id"], "left_semi")
    keyed = reps.select("doc_id", "n", F.posexplode("keys").alias("band", "key"))
    buckets = keyed.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo < hi")
    members = saved(keyed.join(buckets, "key").select("key", "band", F.col("doc_id").alias("rep"), "n", "lo", "size"))
    wanted = members.select(F.col("rep").alias("doc_id")).distinct()
    sets = saved(docs.join(wanted.hint("merge"), "doc_id", "left_semi").mapInArrow(_full_sets(k), "doc_id long, words binary").dropDuplicates(["doc_id"]))
    sizes = members.where("rep = lo").groupBy("lo").agg(F.min("n").alias("n_lo"))
    star = members.where("rep > lo").select("lo", "rep", "n").distinct().join(sizes, "lo").where(F.least("n", "n_lo") * 100 >= percent * F.greatest("n", "n_lo"))
    star = saved(star.select("lo", "rep"))
    # A member meets the least of all its buckets' least members first; the others only where that leaves them in another component.
    first = star.groupBy("rep").agg(F.min("lo").alias("lo"))
    links = saved(confirmed(first.select(F.col("lo").alias("a"), F.col("rep").alias("b")), sets, percent))
    found = [links]
    labels = components(links)
    other = star.join(first.withColumnRenamed("lo", "_first"), "rep").where("lo > _first")
    for end in ("lo", "rep"):
        other = other.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"_{end}")), end, "left").withColumn(f"_{end}", F.coalesce(f"_{end}", end))
    later = saved(confirmed(other.where("_lo <> _rep").select(F.col("lo").alias("a"), F.col("rep").alias("b")), sets, percent))
    found.append(later)
    if later.limit(1).count():
        links = links.unionByName(later)
        labels = components(links)
    looks = reps.select(F.col("doc_id").alias("rep"), "sig", "keys").dropDuplicates(["rep"])
    compared = ["key", "pa", "pb", "side", "rep", "label", "n", "band", "sig", "keys"]

    def mixed(labels: DataFrame, least: int) -> DataFrame:
        """Members of the buckets of `least` members or more that hold several components."""
        split = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
        some = split.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count(F.lit(1)).alias("_n")).where(f"_lo < _hi and _n >= {least}")
        return split.join(some.select("key", "_n"), "key").withColumn("_parts", F.ceil(F.col("_n") / block).cast("int")).withColumn("_part", F.pmod(F.xxhash64("rep"), F.col("_parts")).cast("int"))

    def alike(rows: DataFrame) -> DataFrame:
        near = rows.join(looks, "rep").select(*compared).repartition("key", "pa", "pb").sortWithinPartitions("key", "pa", "pb").mapInArrow(_across(slots, percent), "a long, b long")
        return saved(confirmed(near.distinct(), sets, percent))

    # Large mixed buckets: members meet a few pivots drawn by hash, so a large group whose bucket's least member is a stranger is joined without all its pairs.
    large = mixed(labels, 8 * pivots)
    drawn = large.groupBy("key").agg(*[F.min(F.struct(F.xxhash64(F.lit(i), "rep").alias("h"), "rep", "label", "n", "band", "_parts")).alias(f"_p{i}") for i in range(pivots)])
    drawn = drawn.select("key", F.explode(F.array_distinct(F.transform(F.array(*[f"_p{i}" for i in range(pivots)]), lambda x: x.dropFields("h")))).alias("p")).select("key", "p.*")
    drawn = drawn.withColumn("pa", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumns({"pb": F.lit(0), "side": F.lit(0)}).drop("_parts")
    against = alike(large.select("key", "rep", "label", "n", "band", F.col("_part").alias("pa"), F.lit(0).alias("pb"), F.lit(1).alias("side")).unionByName(drawn))
    found.append(against)
    if against.limit(1).count():
        links = links.unionByName(against)
        labels = components(links)
    # What still stands apart in a bucket is compared in blocks.
    rest = mixed(labels, 3).withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1)))
    side = F.when(F.col("_part") == F.col("_with"), 2).when(F.col("_part") < F.col("_with"), 0).otherwise(1)
    more = alike(rest.withColumns({"pa": F.least("_part", "_with"), "pb": F.greatest("_part", "_with"), "side": side}))
    final = components(links.unionByName(more)) if more.limit(1).count() else labels
    discard(members, sets, star, *found, more)  # what follows reads all_rows and the labels only
    of_class = classes.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("d1", "d2", "n", F.coalesce("label", "rep").alias("component_id"))
    out = all_rows.select("doc_id", "n", "d1", "d2").join(of_class, ["d1", "d2", "n"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce(F.when(F.col("n") > 0, F.col("component_id")), F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, **how) -> DataFrame:
    """docs without the rows that find_near_duplicates does not keep. Rows that repeat an id are decided one by one: of equal ones
    (id and text) one stays, of like ones the first by text; texts unlike all others stay. Rows with a null id stay."""
    ids = docs.where("doc_id is not null").groupBy("doc_id").count()
    if ids.where("count > 1").limit(1).count():
        return _drop_rows(docs, **how)
    gone = find_near_duplicates(docs, **how).where("not kept").select(F.col("doc_id").alias("_gone")).distinct()
    gone = saved(gone)
    if gone.limit(200_001).count() <= 200_000:
        gone = F.broadcast(gone)
    return docs.join(gone, docs["doc_id"] == gone["_gone"], "left_anti")


def _drop_rows(docs: DataFrame, **how) -> DataFrame:
    """drop_near_duplicates where ids repeat: the different rows (id and text) are numbered in their order, and numbers serve as ids."""
    mark, number = free_name(docs, "_mark"), free_name(docs, "_number")
    texts = docs.where("doc_id is not null").select(F.col("doc_id").alias("_id"), "text").distinct()
    parts = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = saved(texts.repartitionByRange(parts, "_id", "text").sortWithinPartitions("_id", "text").select(F.monotonically_increasing_id().alias("doc_id"), "_id", "text"))
    kept = find_near_duplicates(rows.select("doc_id", "text"), **how).where("kept").select("doc_id")
    digest = lambda c: F.sha2(F.coalesce(F.concat(F.lit("t"), c), F.lit("")), 256)
    stay = saved(rows.join(kept, "doc_id", "left_semi").select("_id", digest(F.col("text")).alias("_digest")))
    named = docs.where("doc_id is not null").withColumn(mark, digest(F.col("text")))
    named = named.join(stay.hint("merge"), (named["doc_id"] == stay["_id"]) & (named[mark] == stay["_digest"]), "left_semi")
    one = named.withColumn(number, F.row_number().over(Window.partitionBy("doc_id", mark).orderBy(mark))).where(F.col(number) == 1)
    return one.select(*docs.columns).unionByName(docs.where("doc_id is null"))
