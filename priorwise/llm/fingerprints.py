"""Document fingerprints by a randomised edit embedding: shared random walks over characters, sampled bits, bands, verification."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import batches, deal_join, discard, lookup_join, mix, saved, trim
from .components import components

SAMPLES = 64  # sampled steps of each octave of the walk
OCTAVES = 40
PERIOD = 4096
FLUSH_CHARS = 24_000_000
RUN_CHARS = 4_000_000
RUN_ROWS = 1_000  # fingerprints that are compared, or get their keys, at a time
BUCKET_ROWS = 5_000
BUCKETS = 20_000
LEVEL = SAMPLES // 2  # samples between the levels up to which bands read
BLOCK = 1024
#: For each step (modulo PERIOD) and character class: does the walk go on to the next character?
MOVES = (mix(np.arange(PERIOD * 256, dtype=np.uint64) + np.uint64(0x5DEECE66D)) >> np.uint64(63)).astype(np.int64).reshape(PERIOD, 256)
MOVES[:, 0] = 0  # the end of a text
NIBBLE = (mix(np.arange(256, dtype=np.uint64)) >> np.uint64(60)).astype(np.uint8)
HEX = np.frombuffer(b"0123456789abcdef" + b"-" * 240, np.uint8)


def _sampled() -> tuple[np.ndarray, np.ndarray]:
    """Steps that fingerprints keep, ascending, and how many steps of the walk each stands for."""
    steps, weights = [np.arange(1, SAMPLES)], [np.ones(SAMPLES - 1)]
    for o in range(SAMPLES.bit_length() - 1, OCTAVES):
        width = 1 << o
        part = np.arange(SAMPLES, dtype=np.uint64)
        jitter = (mix(part + np.uint64(o << 20)) % np.uint64(width // SAMPLES)).astype(np.int64)
        steps.append(width + part.astype(np.int64) * (width // SAMPLES) + jitter)
        weights.append(np.full(SAMPLES, width / SAMPLES))
    return np.concatenate(steps), np.concatenate(weights)


STEPS, WEIGHTS = _sampled()


def codes(text: str) -> np.ndarray:
    """A class from 1 to 255 for each code point."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return (c % np.uint32(255) + np.uint32(1)).astype(np.uint8)


def walk(texts: list[np.ndarray]) -> np.ndarray:
    """Symbols at the sampled steps (rows by samples; 255 after the end). At each step the walk writes the character that it stands on,
    then stays or moves on by a random bit of (step, character), the same for all texts; it ends with the text or after three times its length."""
    sizes = np.array([len(t) for t in texts], np.int64)
    n_samples = int(np.searchsorted(STEPS, 3 * int(sizes.max(initial=0)), side="right"))
    out = np.full((len(texts), n_samples), 255, np.uint8)
    if not n_samples:
        return out
    end = np.zeros(1, np.uint8)
    flat = np.concatenate([x for t in texts for x in (t, end)])
    at = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    row, last = np.arange(len(texts)), 3 * sizes
    sample, goal = 0, int(STEPS[0])
    for j in range(1, int(last.max()) + 1):
        c = flat.take(at)
        if j == goal:
            live = (c != 0) & (j <= last[row])
            out[row[live], sample] = NIBBLE[c[live]]
            sample += 1
            if sample == n_samples:
                break
            goal = int(STEPS[sample])
        at += MOVES[j % PERIOD].take(c)
        if j % 256 == 0 or j == 64:
            live = (flat.take(at) != 0) & (j < last[row])
            if not live.all():
                at, row = at[live], row[live]
                if not len(row):
                    break
    return out


def written(symbols: np.ndarray) -> list[str]:
    """Fingerprints as text: a hexadecimal digit for each sampled step, up to the end of the walk."""
    return [r.tobytes().decode().rstrip("-") for r in HEX[symbols]]


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """By row: the share of the steps of the longer walk at which both fingerprints agree; of two empty texts 1."""
    w = WEIGHTS[: a.shape[1]]
    either = ((a != 255) | (b != 255)) @ w
    same = ((a == b) & (a != 255)) @ w
    return np.where(either > 0, same / np.where(either > 0, either, 1), 1.0)


def symbols_of(prints: list[str]) -> np.ndarray:
    """The symbols of written fingerprints."""
    width = max(map(len, prints), default=0)
    raw = np.frombuffer("".join(p.ljust(width, "-") for p in prints).encode(), np.uint8).reshape(len(prints), width).astype(np.int16)
    return np.where(raw == 45, 255, np.where(raw < 58, raw - 48, raw - 87)).astype(np.uint8)


def edited_text(text: str, following: str) -> str:
    """text with its last half (of code points, rounded down) replaced by as many from the start of following, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def digest_of(print_: str) -> bytes:
    """What tells written fingerprints apart in joins: 128 bits."""
    return hashlib.md5(print_.encode()).digest()


def _dealt(bucket, also):
    """Rows (doc_id, _o, _tie, text) as those that the ranges get: texts as zstd frames, which take less room in a shuffle than under its
    own codec, in their own range and, as own = false, in those above it of which they are the text before."""

    def run(it):
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches(it):
            order = batch.column(1).to_numpy()
            z = [pack(t.encode("utf-8", "surrogatepass")) for t in batch.column(3).to_pylist()]
            rows = [(int(b), i) for i, b in enumerate(bucket(order))]
            more = [(b, i) for i, o in enumerate(order.tolist()) for b in also(o)]
            at, own = pa.array([i for _, i in rows + more], pa.int64()), [True] * len(rows) + [False] * len(more)
            yield pa.RecordBatch.from_arrays([
                pa.array([b for b, _ in rows + more], pa.int32()), pa.array(own), batch.column(1).take(at), pa.array([True] * len(own)), batch.column(2).take(at),
                batch.column(0).take(at), pa.array(z, pa.binary()).take(at), pa.nulls(len(own), pa.int64()),
            ], ["b", "own", "_o", "is_text", "_tie", "doc_id", "z", "component_id"])

    return run


def fingerprint_pairs(docs: DataFrame, flush_chars: int = FLUSH_CHARS, bucket_rows: int = BUCKET_ROWS, classes: DataFrame | None = None) -> DataFrame:
    """For each row: doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next, where the next document
    is the one of the next smaller id (rows with a null id are the smallest, of equal ids the texts decide), after the last the first.
    With classes (as near_classes gives them) also component_id: that of the row's id and fingerprint, or its own id where they have none.

    Documents are dealt out once by ranges of ids; the largest id of each range also goes to the range above it, and a row of
    classes to the range of its id, before the texts of that id. A null text is empty. Repeated rows follow one another. No rows give no rows."""
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    kind += ", component_id long" * (classes is not None)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    order = F.coalesce("doc_id", F.lit(-(1 << 63)))
    ids = docs.select(order.alias("o"))
    rows = ids.count()
    if not rows:
        return docs.sparkSession.createDataFrame([], kind)
    parts = max(1, min(BUCKETS, -(-rows // bucket_rows)))
    cuts = ids.agg(F.percentile_approx("o", [i / parts for i in range(1, parts)], 20 * parts)).first()[0] if parts > 1 else []
    cuts = np.unique(np.array(cuts, np.int64))
    ranged = lambda o: np.searchsorted(cuts, o, side="left").astype(np.int32)
    bucket = F.pandas_udf(lambda o: pd.Series(ranged(o.to_numpy())), "int")
    tops = sorted((r[0], r[1]) for r in ids.groupBy(bucket("o").alias("b")).agg(F.max("o")).collect())
    carried = {tops[i - 1][1]: tops[i][0] for i in range(1, len(tops))}  # the largest id of a range -> the range above it
    wrap = tops[-1][1]  # the first of all follows the last

    lowest = tops[0][0]
    also = lambda x: ([carried[x]] if x in carried else []) + ([lowest] if x == wrap else [])

    # only the texts of repeated ids (and of the null id) are needed to put rows in order
    several = saved(ids.groupBy("o").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(F.col("o").alias("_o"), F.lit(True).alias("_several")))
    tied = lookup_join(docs.withColumn("_o", order), several, ["_o"], spread=F.xxhash64("text"))
    tied = tied.select("doc_id", "_o", F.when(F.col("_several"), F.col("text")).alias("_tie"), "text")
    dealt = tied.mapInArrow(_dealt(ranged, also), "b int, own boolean, _o long, is_text boolean, _tie string, doc_id long, z binary, component_id long")
    grouped = classes is not None
    if grouped:
        joined = classes.where("component_id <> doc_id").distinct()
        dealt = dealt.unionByName(joined.select(bucket("doc_id").alias("b"), F.lit(True).alias("own"), F.col("doc_id").alias("_o"), F.lit(False).alias("is_text"), F.lit(None).cast("string").alias("_tie"), "doc_id", F.col("digest").alias("z"), "component_id"))
    dealt = dealt.repartitionById(parts, "b").sortWithinPartitions("b", "own", "_o", "is_text", "_tie")

    def run(it):
        unpack = zstandard.ZstdDecompressor().decompress
        last = {"text": "", "codes": None}
        named: tuple = (None, {})  # an id with its components by fingerprint
        block: list[tuple] = []
        size = 0

        def flush():
            walks = walk([x for _, text, c, following, f, _ in block for x in (c, np.concatenate([c[: len(c) - len(c) // 2], f[: len(c) // 2]]), f)])
            own, edit, nxt = walks[0::3], walks[1::3], walks[2::3]
            out = {
                "doc_id": pa.array([x[0] for x in block], pa.int64()), "n_chars": pa.array([len(x[1]) for x in block], pa.int64()),
                "edited_sha256": [hashlib.sha256(edited_text(x[1], x[3]).encode("utf-8", "surrogatepass")).hexdigest() for x in block],
                "fingerprint": written(own), "edited_fingerprint": written(edit), "near_edited": likeness(own, edit), "near_next": likeness(own, nxt),
            }
            if grouped:
                out["component_id"] = pa.array([x[5].get(digest_of(p), x[0]) if x[5] else x[0] for x, p in zip(block, out["fingerprint"])], pa.int64())
            return pa.RecordBatch.from_pydict(out)

        for batch in batches(it):
            for own, is_text, doc, z, component in zip(*[batch.column(i).to_pylist() for i in (1, 3, 5, 6, 7)]):
                if not is_text:
                    if named[0] != doc:
                        named = (doc, {})
                    named[1][z] = component
                    continue
                text = unpack(z).decode("utf-8", "surrogatepass")
                c = codes(text)
                if own:
                    block.append((doc, text, c, last["text"], last["codes"], named[1] if named[0] == doc else None))
                    size += 3 * len(c) + 50
                last = {"text": text, "codes": c}
                if size > flush_chars:
                    yield flush()
                    block, size = [], 0
        if block:
            yield flush()

    return dealt.mapInArrow(run, kind)


def fingerprints(docs: DataFrame) -> DataFrame:
    """docs with fingerprint (of text; null like empty), which replaces a column of this name."""

    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(written(walk([codes(t or "") for t in texts])))

    return docs.drop(*[c for c in docs.columns if c.lower() == "fingerprint"]).withColumn("fingerprint", of(F.col("text")))


def band_keys(prints: list[str], bands: int, bits: int) -> np.ndarray:
    """Bucket keys (rows by 2 * bands) of written fingerprints. A band reads `bits` sampled steps, drawn in proportion to the steps that
    each stands for, from the start of the walk up to a level. Levels lie half an octave apart and each text has the last two that it
    passes, so that texts of which the shorter walk has 0.8 of the longer one's steps share a level."""
    draws = (mix(np.arange(bands * bits, dtype=np.uint64) + np.uint64(0xA24BAED4)) >> np.uint64(11)).astype(float) / (1 << 53)
    factor = np.uint64(2) * np.arange(bits, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    number = np.arange(bands, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)
    out, places = np.empty((len(prints), 2 * bands), np.uint64), {}
    for i, print_ in enumerate(prints):
        top = max(len(print_) // LEVEL, 1)
        row = symbols_of([print_.ljust(top * LEVEL, "-")])[0].astype(np.uint64)
        for half, level in enumerate((top, max(top - 1, 1))):
            if level not in places:
                share = np.cumsum(WEIGHTS[: level * LEVEL])
                places[level] = np.searchsorted(share, draws * share[-1], side="right").reshape(bands, bits)
            read = mix((row[places[level]] + np.uint64(1)) * factor).sum(axis=1, dtype=np.uint64)
            out[i, half * bands : (half + 1) * bands] = mix(read + number + np.uint64(level << 40))
    return out


def _links_between(least: float):
    """Of two blocks (side 0 and 1) or one (side 2) of a bucket: a link for each pair of labels that alike members join. Labels joined
    before in the same blocks are one from then on, so a block gives fewer links than it has members."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        symbols, rep, side = symbols_of(list(rows["fingerprint"])), rows["rep"].to_numpy(), rows["side"].to_numpy()
        label, found = rows["label"].to_numpy().copy(), []
        for i in np.flatnonzero(side != 1):
            other = np.flatnonzero((side != 0) & (label != label[i]))
            alike = other[likeness(np.broadcast_to(symbols[i], (len(other), symbols.shape[1])), symbols[other]) >= least]
            if len(alike):
                met, one = np.unique(label[alike], return_index=True)
                found += [(rep[i], rep[j]) for j in alike[one]]
                label[np.isin(label, met)] = label[i]
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["a", "b"])

    return run


def packed_print(print_: str) -> bytes:
    """A written fingerprint at two digits a byte; the first digit tells whether one or two stand before it."""
    return bytes.fromhex(("1" if len(print_) % 2 else "00") + print_)


def _packed_prints(it):
    """(doc_id, digest, print) of rows (doc_id, text), walked by runs of up to RUN_CHARS characters or one longer text."""
    for batch in batches(it):
        ids, texts, lo = batch.column(0), batch.column(1).to_pylist(), 0
        while lo < len(texts):
            hi, size = lo + 1, len(texts[lo])
            while hi < len(texts) and size + len(texts[hi]) <= RUN_CHARS:
                size += len(texts[hi])
                hi += 1
            prints = written(walk([codes(t) for t in texts[lo:hi]]))
            yield pa.RecordBatch.from_arrays([ids.slice(lo, hi - lo), pa.array(map(digest_of, prints), pa.binary()), pa.array(map(packed_print, prints), pa.binary())], ["doc_id", "digest", "print"])
            lo = hi


def unpacked_prints(packed: list[bytes]) -> list[str]:
    return [h[1:] if h[0] == "1" else h[2:] for h in map(bytes.hex, packed)]


def near_classes(docs: DataFrame, least: float = 0.8, bands: int = 64, bits: int = 8, block: int = BLOCK) -> DataFrame:
    """For each row with an id and a text that is not empty: doc_id, digest (of its fingerprint) and component_id, the least id reached over
    fingerprints alike to `least`.

    Bands of `bits` sampled symbols make buckets. Each bucket's members are verified against its least one; where that leaves several
    components in a bucket, members of different ones are compared in blocks of about `block`, so all alike members of a bucket are joined.
    Equal fingerprints are one class. Repeated rows get equal results; an id with several texts has a row for each. Rows without id or
    text are left out. No rows give no rows. Other columns are ignored."""
    runs = lambda n: range(0, n, RUN_ROWS)

    @F.pandas_udf("array<long>")
    def keys(p: pd.Series) -> pd.Series:
        return pd.Series([k for lo in runs(len(p)) for k in band_keys(unpacked_prints(list(p[lo : lo + RUN_ROWS])), bands, bits).view(np.int64)])

    @F.pandas_udf("double")
    def near(a: pd.Series, b: pd.Series) -> pd.Series:
        out = [np.zeros(0)]
        for lo in runs(len(a)):
            some = unpacked_prints([*a[lo : lo + RUN_ROWS], *b[lo : lo + RUN_ROWS]])
            s = symbols_of(some)
            out.append(likeness(s[: len(some) // 2], s[len(some) // 2 :]))
        trim()
        return pd.Series(np.concatenate(out))

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").dropna().where("text <> ''")
    made = saved(texts.mapInArrow(_packed_prints, "doc_id long, digest binary, print binary"))
    # An id may have several texts, so classes have numbers of their own.
    firsts = made.groupBy("digest").agg(F.min("doc_id").alias("doc_id"), F.first("print").alias("print"), F.count(F.lit(1)).alias("n_rows"))
    firsts = saved(firsts.withColumn("rep", F.monotonically_increasing_id()))
    ids = saved(made.select("doc_id", "digest"))
    discard(made)
    keyed = firsts.select("rep", F.explode(F.array_distinct(keys("print"))).alias("key"))
    low = saved(keyed.groupBy("key").agg(F.min("rep").alias("lo"), F.max("rep").alias("_z")).where("lo < _z").select("key", "lo"))
    members = saved(keyed.join(low, "key"))
    discard(low)
    pairs = saved(members.where("rep > lo").select(F.col("lo").alias("a"), F.col("rep").alias("b")).distinct())
    with_a = pairs.join(firsts.select(F.col("rep").alias("a"), F.col("print").alias("pa")), "a")
    links = saved(with_a.join(firsts.select(F.col("rep").alias("b"), F.col("print").alias("pb")), "b").where(near("pa", "pb") >= least).select("a", "b"))
    discard(pairs)
    labels = components(links)
    split = members.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    # Members that share a bucket with its least one alone have been verified already.
    some = split.groupBy("key").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.count(F.lit(1)).alias("_n")).where("_lo < _hi and _n > 2")
    rest = split.join(some.select("key", "_n"), "key").withColumn("_parts", F.ceil(F.col("_n") / block).cast("int")).withColumn("_part", F.pmod(F.xxhash64("rep"), F.col("_parts")).cast("int"))
    rest = rest.withColumn("_with", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).withColumns({"pa": F.least("_part", "_with"), "pb": F.greatest("_part", "_with")})
    side = F.when(F.col("_part") == F.col("_with"), 2).when(F.col("_part") < F.col("_with"), 0).otherwise(1).alias("side")
    # _part = _with is the block within itself; in a block of two parts each row is on the side of its own part.
    rest = rest.select("key", "pa", "pb", side, "rep", "label").join(firsts.select("rep", "print"), "rep")
    found = _links_between(least)
    compared = rest.groupBy("key", "pa", "pb").applyInPandas(lambda rows: found(rows.assign(fingerprint=unpacked_prints(list(rows["print"])))), "a long, b long")
    more = saved(compared.distinct())
    final = components(links.unionByName(more))
    named = firsts.drop("print").join(final.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    least_id = named.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = saved(named.join(least_id, "label").select("digest", "n_rows", "component_id"))
    discard(members, links, more, firsts)
    return deal_join(ids, named, "digest", "n_rows", ids.count()).select("doc_id", "digest", "component_id")


def near_texts(docs: DataFrame, least: float = 0.8, bands: int = 64, bits: int = 8, block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) of near_classes, for the same rows and by the same rules."""
    return near_classes(docs, least, bands, bits, block).select("doc_id", "component_id")


def fingerprint_components(docs: DataFrame, least: float = 0.9, bands: int = 24, bits: int = 14) -> DataFrame:
    """fingerprint_pairs with component_id, the least id reached over fingerprints alike to `least`; null ids have none, empty texts their own.

    Two fingerprints of likeness 0.9 share none of 24 bands of 14 symbols with probability 0.002 where both texts have a level in
    common; unlike texts agree in about an eighth of their symbols, so that chance fills no buckets of 14 at any size of the corpus."""
    return fingerprint_pairs(docs, classes=near_classes(docs, least, bands, bits))
