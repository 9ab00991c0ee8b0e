"""Removal of repeated word windows: k-word windows that several documents share are the edges of a de Bruijn graph whose nodes are
their first and last k - 1 words; nonbranching paths are compacted in Spark joins, and source coordinates verify the spans that are cut."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, discard, packed, ranges, saved, span_hashes, text_chunks, trim, window_hashes, word_hashes, word_spans
from .components import components

K = 13
#: Long enough that seeds of frequent words rarely meet by chance, also in large corpora.
SEED_WORDS = 7
#: Words that a task gathers before it looks for windows that its own documents share.
CHUNK_WORDS = 400_000
#: Rows of a batch whose texts a task holds at a time.
SLICE_ROWS = 1_000
#: Places of a source document that share a key when spans meet paths.
BLOCK = 256
#: Bits of a seed that move between tasks; seeds only choose candidates, so two that agree by chance cost time and no result.
SEED_BITS = 40
EMPTY = hashlib.sha256(b"").hexdigest()
I64 = np.int64


def _inventory(it):
    """(doc_id, n_words, digest of the words joined by one space) of each row."""
    for batch in batches(it):
        n, digests = [], []
        for t in batch.column(1).to_pylist():
            words = (t or "").encode("utf-8", "surrogatepass").split()
            n.append(len(words))
            digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(digests)], ["doc_id", "n_words", "digest"])


class Chunk:
    """Documents of one task with their word hashes, up to CHUNK_WORDS words: of texts with the same words only the one of the smallest id."""

    def __init__(self):
        self.docs: list[int] = []
        self.keys: list[int] = []
        self.words: list[list[np.ndarray]] = []
        self.extra: list = []
        self.at: dict[int, int] = {}
        self.size = 0

    def add(self, doc: int, key: int, words: list[np.ndarray], extra=None) -> None:
        if (i := self.at.get(key)) is not None:
            self.docs[i], self.extra[i] = min((self.docs[i], self.extra[i]), (doc, extra), key=lambda x: x[0])
            return
        self.at[key] = len(self.docs)
        self.docs.append(doc)
        self.keys.append(key)
        self.words.append(words)
        self.extra.append(extra)
        self.size += len(words[0])

    def flat(self, k: int):
        """Word hashes of all, and the places where a window of k words begins, with the number of its document."""
        counts = np.array([len(w[0]) for w in self.words], I64)
        first = np.concatenate([[0], np.cumsum(counts)[:-1]])
        windows = np.maximum(counts - k + 1, 0)
        return [np.concatenate([w[j] for w in self.words]) for j in range(len(self.words[0]))], ranges(first, windows), np.repeat(np.arange(len(counts)), windows), first


def _nth(batch: pa.RecordBatch, i: int) -> int:
    """0, or where several texts have the id, the place of this one in the order of their digests."""
    several = batch.column(3)[i].as_py()
    return several.index(_digest(batch.column(1)[i].as_py())) if several else 0


def _chunks(it, k: int, families: int, size: int, extra: bool = False):
    chunk = Chunk()
    for batch in _expanded(it) if extra else batches(it):
        ids = batch.column(0).to_pylist()
        more = batch.column(2) if extra else None
        for lo, hi, data, offs in text_chunks(batch.column(1)):
            starts, ends, bounds = word_spans(data, offs)
            h = [word_hashes(data, starts, ends, seed=100 * j) for j in range(families)]
            keys = span_hashes(h[0], bounds).view(I64)
            for i in range(lo, hi):
                a, b = bounds[i - lo], bounds[i - lo + 1]
                if ids[i] is not None and b - a >= k:
                    chunk.add(ids[i], int(keys[i - lo]), [x[a:b].copy() for x in h], (more[i].as_py(), _nth(batch, i)) if extra else None)
                    if chunk.size >= size:
                        yield chunk
                        chunk = Chunk()
    if chunk.docs:
        yield chunk


def _minimizers(h: np.ndarray, at: np.ndarray, k: int, seed_words: int) -> np.ndarray:
    """For each window that begins at `at`: the least hash of its spans of seed_words words. Equal windows have equal ones."""
    low = window_hashes(h, seed_words, 3)
    need = k - seed_words + 1
    width, best = 1, low
    while 2 * width <= need:  # minima over spans of 1, 2, 4 ... seeds
        best = np.minimum(best[:-width], best[width:])
        width *= 2
    return np.minimum(best[at], best[at + need - width]).view(I64) & I64((1 << SEED_BITS) - 1)


def _seeds(k: int, seed_words: int):
    size = CHUNK_WORDS  # tasks get the driver's setting

    def run(it):
        for chunk in _chunks(it, k, 1, size):
            (h,), at, doc, _ = chunk.flat(k)
            m = _minimizers(h, at, k, seed_words)
            change = np.r_[True, (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])]
            m, doc = m[change], doc[change]
            order = np.lexsort((doc, m))
            m, doc = m[order], doc[order]
            new = np.r_[True, (m[1:] != m[:-1]) | (doc[1:] != doc[:-1])]
            m, doc = m[new], doc[new]
            first = np.r_[True, m[1:] != m[:-1]]
            group = np.cumsum(first) - 1
            shared = (np.bincount(group) > 1)[group]
            ids = np.array(chunk.docs, I64)[doc]
            alone, mark = np.flatnonzero(~shared), shared & first
            alone = alone[np.argsort(ids[alone], kind="stable")]  # rows of one document side by side take less room in a shuffle
            # alone: (seed, doc); shared here: one row for the others to see, and (doc, seed) of its own, which need no check
            g = np.concatenate([m[alone], m[mark], ids[shared]])
            x = np.concatenate([ids[alone], np.zeros(mark.sum(), I64), m[shared]])
            kind = np.repeat(np.array([0, 2, 1], np.int8), [len(alone), mark.sum(), shared.sum()])
            for lo in range(0, len(g), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(g[lo : lo + 100_000]), pa.array(x[lo : lo + 100_000]), pa.array(kind[lo : lo + 100_000])], ["g", "x", "kind"])

    return run


def _compressed(it):
    """Texts as zstd frames: what moves between tasks shrinks by a third more than under the shuffle's own codec."""
    pack = zstandard.ZstdCompressor(level=1).compress
    for batch in batches(it):
        z = [pack((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], ["doc_id", "z"])


def _expanded(it):
    """Slices of batches whose second column is compressed, with texts there."""
    unpack = zstandard.ZstdDecompressor().decompress
    for batch in batches(it):
        for lo in range(0, batch.num_rows, SLICE_ROWS):
            some = batch.slice(lo, SLICE_ROWS)
            text = pa.array([unpack(z) for z in some.column(1).to_pylist()], pa.binary()).cast(pa.string())
            yield pa.RecordBatch.from_arrays([some.column(0), text, *some.columns[2:]], ["doc_id", "text", *some.schema.names[2:]])
            trim()


def _digest(text: str) -> str:
    return hashlib.sha256(b" ".join(text.encode("utf-8", "surrogatepass").split())).hexdigest()


#: A window (u, v: hashes of its first and last k - 1 words) at a place of a document. multi: other documents of the task have it too.
#: n > 0: a run of n windows of which the task knows a source, in a document with a smaller id or earlier in this one.
#: What differs from row to row stands together, which takes less room in a shuffle.
EDGE = "u long, v long, pos int, doc long, nth int, multi boolean, n int, src long, src_nth int, src_pos int"


def _edges(k: int, seed_words: int):
    size = CHUNK_WORDS

    def run(it):
        for chunk in _chunks(it, k, 1, size, True):
            (h,), at, doc, first = chunk.flat(k)
            m = _minimizers(h, at, k, seed_words)
            sets = [np.frombuffer(x, I64) for x, _ in chunk.extra]
            tag = lambda seed, d: seed ^ (d.astype(I64) * I64(0x1E3779B97F4A7C15))
            with np.errstate(over="ignore"):
                near = np.isin(tag(m, doc), tag(np.concatenate(sets), np.repeat(np.arange(len(sets)), [len(s) for s in sets])))
            at, doc = at[near], doc[near]
            if not len(at):
                continue
            nodes = window_hashes(h, k - 1).view(I64)
            ids, nth, pos = np.array(chunk.docs, I64)[doc], np.array([n for _, n in chunk.extra], np.int32)[doc], (at - first[doc]).astype(np.int32)
            order = np.lexsort((pos, nth, ids, nodes[at + 1], nodes[at]))
            u, v, ids, nth, pos = nodes[at[order]], nodes[at[order] + 1], ids[order], nth[order], pos[order]
            new = np.r_[True, (u[1:] != u[:-1]) | (v[1:] != v[:-1])]
            own = np.r_[True, new[1:] | (ids[1:] != ids[:-1]) | (nth[1:] != nth[:-1])]  # the first place in its document
            head, mine = np.flatnonzero(new)[np.cumsum(new) - 1], np.flatnonzero(own)[np.cumsum(own) - 1]
            least = ids == ids[head]
            several = np.maximum.reduceat(~least, np.flatnonzero(new))[np.cumsum(new) - 1]
            # the least id of this task still has to meet the other tasks'; all else has a source already and leaves in runs
            rest = np.flatnonzero(~least | ~own)
            source = np.where(least, mine, head)[rest]
            d, y, p, s, sy, sp = ids[rest], nth[rest], pos[rest], ids[source], nth[source], pos[source]
            o = np.lexsort((p, y, d))
            d, y, p, s, sy, sp = d[o], y[o], p[o], s[o], sy[o], sp[o]
            cut = np.r_[True, (d[1:] != d[:-1]) | (y[1:] != y[:-1]) | (p[1:] != p[:-1] + 1) | (s[1:] != s[:-1]) | (sy[1:] != sy[:-1]) | (sp[1:] != sp[:-1] + 1)][: len(d)]
            begin = np.flatnonzero(cut)
            runs = np.diff(np.append(begin, len(d))).astype(np.int32)
            a = np.flatnonzero(least & own)
            a = a[np.lexsort((pos[a], ids[a]))]  # rows of one document side by side take less room in a shuffle
            none, r = np.zeros(len(a), np.int32), begin
            cols = [
                np.concatenate([u[a], d[r] ^ (p[r].astype(I64) << 20)]), np.concatenate([v[a], p[r].astype(I64)]), np.concatenate([pos[a], p[r]]), np.concatenate([ids[a], d[r]]),
                np.concatenate([nth[a], y[r]]), np.concatenate([several[a], np.zeros(len(r), bool)]), np.concatenate([none, runs]), np.concatenate([none.astype(I64), s[r]]),
                np.concatenate([none, sy[r]]), np.concatenate([none, sp[r]]),
            ]
            for lo in range(0, len(cols[0]), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(c[lo : lo + 100_000]) for c in cols], [c.split()[0] for c in EDGE.split(", ")])

    return run


def shared_edges(docs: DataFrame, inventory: DataFrame, k: int, seed_words: int) -> DataFrame:
    """Windows that several documents have. first: the row of a window's source (least id, then place), with its nodes u, v and branches
    (do other such windows begin at u?). Else an occurrence: n windows from pos on that stand from src_pos on in src; within one document, in itself.
    known: src is the least document of the task only, so its own places may be occurrences of a source; otherwise src is a source."""
    # seeds: which least spans of windows do several documents share? A task sends a seed once, so a group has a row per task at most.
    seeds = docs.mapInArrow(_seeds(k, seed_words), "g long, x long, kind byte")
    w = Window.partitionBy("g", F.col("kind") == 1)
    met = seeds.withColumn("_n", F.count(F.lit(1)).over(w)).where("kind = 1 or kind = 0 and _n > 1")
    met = met.select(F.when(F.col("kind") == 1, F.col("g")).otherwise(F.col("x")).alias("doc_id"), F.when(F.col("kind") == 1, F.col("x")).otherwise(F.col("g")).alias("seed"))
    firsts = inventory.dropna(subset=["doc_id"]).groupBy("digest").agg(F.min("doc_id").alias("doc_id")).select("doc_id").distinct()
    lists = met.groupBy("doc_id").agg(F.collect_set("seed").alias("seeds")).join(firsts, "doc_id", "left_semi")

    def bytes_of(it):
        for batch in batches(it):
            c = batch.column(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), packed(np.asarray(c.flatten()), np.asarray(c.value_lengths())).cast(pa.binary())], ["doc_id", "seeds"])

    lists = lists.mapInArrow(bytes_of, "doc_id long, seeds binary").join(several_texts(inventory), "doc_id", "left")
    candidates = compressed(docs).join(lists, "doc_id").select("doc_id", "z", "seeds", "several")
    # windows with such seeds meet those of other tasks; a task sends a window once, so a frequent one has a row per task at most
    edges = candidates.mapInArrow(_edges(k, seed_words), EDGE).repartition("u")
    known = F.col("n") > 0
    each, ordered = Window.partitionBy("u", "v"), Window.partitionBy("u", "v").orderBy("doc", "nth", "pos")
    edges = edges.withColumns({"_nth": F.row_number().over(ordered), "_least": F.first(F.struct("doc", "nth", "pos")).over(ordered)})
    edges = edges.withColumn("_shared", F.max("multi").over(each) | (F.min("doc").over(each) < F.max("doc").over(each)))
    edges = edges.withColumn("first", ~known & (F.col("_nth") == 1) & F.col("_shared"))
    edges = edges.withColumn("branches", F.sum(F.col("first").cast("int")).over(Window.partitionBy("u")) > 1)
    other = lambda c, least: F.when(known, F.col(c)).when(~F.col("first"), F.col(f"_least.{least}"))
    rows = edges.where(known | F.col("first") | (F.col("doc") > F.col("_least.doc")))
    return rows.select(
        "first", known.alias("known"), *[F.when(F.col("first"), F.col(c)).alias(c) for c in ("u", "v", "branches")], "doc", "nth", "pos", F.greatest("n", F.lit(1)).alias("n"),
        other("src", "doc").alias("src"), other("src_nth", "nth").alias("src_nth"), other("src_pos", "pos").alias("src_pos"),
    )


def compacted(edges: DataFrame) -> DataFrame:
    """(path, src, src_nth, start, n): the nonbranching paths of the graph of distinct shared windows, by parts with consecutive places in one source.

    A node is passed if one window ends and one begins there. Windows that follow each other in their source join by their coordinates;
    parts whose ends meet at such a node join by node, and label contraction in joins closes chains of parts to paths."""
    # do other windows end at v? Marks of those places go along, before their windows
    marks = edges.select("v", "src", "src_nth", "pos").withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy("v"))).where("_n > 1")
    both = edges.unionByName(marks.select("src", "src_nth", "pos"), allowMissingColumns=True)
    w = Window.partitionBy("src", "src_nth").orderBy("pos")
    marked = Window.partitionBy("src", "src_nth").orderBy("pos", F.col("v").isNotNull())
    ends = both.withColumn("joins", F.coalesce((F.lag("pos").over(marked) == F.col("pos")), F.lit(False))).where("v is not null")
    goes_on = (F.lag("pos").over(w) + 1 == F.col("pos")) & ~F.lag("joins").over(w) & ~F.col("branches")
    parts = ends.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("_part", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    parts = parts.groupBy("src", "src_nth", "_part").agg(
        F.min("pos").alias("start"), F.count(F.lit(1)).cast("int").alias("n"), F.min_by("u", "pos").alias("from"), F.max_by("v", "pos").alias("to"),
        F.min_by("branches", "pos").alias("branches"), F.max_by("joins", "pos").alias("joins"),
    )
    parts = saved(parts.drop("_part").withColumn("part", F.monotonically_increasing_id()))
    links = parts.where("not joins").select(F.col("to").alias("node"), F.col("part").alias("a")).join(parts.where("not branches").select(F.col("from").alias("node"), F.col("part").alias("b")), "node")
    labels = components(links.select("a", "b"))
    return parts.join(labels, parts["part"] == labels["node"], "left").select(F.coalesce("label", "part").alias("path"), "src", "src_nth", "start", "n")


def _through(runs: DataFrame, others: DataFrame) -> DataFrame:
    """The parts of runs (doc, nth, start, n, src, src_nth, src_start) whose places in src lie in others (doc, nth, start, n and more columns), with
    those columns; _at is where the other begins. They meet by blocks of places, and each pair counts in the block where its part begins."""
    blocks = lambda start: F.explode(F.sequence(F.floor(F.col(start) / BLOCK), F.floor((F.col(start) + F.col("n") - 1) / BLOCK)))
    more = [c for c in others.columns if c not in ("doc", "nth", "start", "n")]
    others = others.withColumn("block", blocks("start")).select(F.col("doc").alias("src"), F.col("nth").alias("src_nth"), "block", F.col("start").alias("_at"), (F.col("start") + F.col("n")).alias("_to"), *more)
    low, high = F.greatest("src_start", "_at"), F.least(F.col("src_start") + F.col("n"), F.col("_to"))
    met = runs.withColumn("block", blocks("src_start")).join(others, ["src", "src_nth", "block"]).where((low < high) & (F.floor(low / BLOCK) == F.col("block")))
    return met.select("doc", "nth", (F.col("start") + low - F.col("src_start")).alias("start"), (high - low).alias("n"), "src", "src_nth", low.alias("src_start"), "_at", *more)


def repeated_spans(docs: DataFrame, k: int = K, seed_words: int = SEED_WORDS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(inventory, spans, again). inventory: doc_id, n_words, digest for each row of docs. spans: path, doc, nth, start, n_windows, src, src_nth,
    src_start: windows of a document (of those with equal words: the least id) on one path, which stand, window by window, from src_start on in
    src, a document with a smaller id. again: doc, nth, start, n_windows, own_start: windows that repeat earlier ones of their own document,
    which spans have. nth tells the texts of one id apart. Rows with a null id have no spans and are no source."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    inventory = saved(docs.mapInArrow(_inventory, "doc_id long, n_words long, digest string"))
    edges = saved(shared_edges(docs, inventory, k, seed_words))
    paths = compacted(edges.where("first").select("u", "v", "branches", F.col("doc").alias("src"), F.col("nth").alias("src_nth"), "pos"))
    # an occurrence joins the one before it in its document if their sources are neighbours too
    found = edges.where("not first").select("known", "doc", "nth", "pos", "n", "src", "src_nth", "src_pos")
    w = Window.partitionBy("doc", "nth").orderBy("pos", "src", "src_nth", "src_pos", "known")
    before = lambda c: F.lag(c).over(w)
    goes_on = (before(F.col("pos") + F.col("n")) == F.col("pos")) & (before(F.col("src_pos") + F.col("n")) == F.col("src_pos"))
    for c in ("src", "src_nth", "known"):
        goes_on &= before(c) == F.col(c)
    islands = found.withColumn("_new", (~F.coalesce(goes_on, F.lit(False))).cast("int")).withColumn("_run", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    runs = islands.groupBy("doc", "nth", "_run").agg(F.min("pos").alias("start"), F.sum("n").cast("int").alias("n"), *[F.min(c).alias(c) for c in ("known", "src", "src_nth")], F.min("src_pos").alias("src_start"))
    runs = saved(runs.drop("_run"))
    discard(edges)
    again = runs.where("src = doc").select("doc", "nth", "start", F.col("n").alias("n_windows"), F.col("src_start").alias("own_start"))
    # what a task knew from its least document leads on, where that is an occurrence, to the source of that
    runs, place = runs.where("src < doc"), ["doc", "nth", "start", "n"]
    far = _through(runs.where("known"), runs.where("not known").select(*place, F.col("src").alias("_src"), F.col("src_nth").alias("_nth"), F.col("src_start").alias("_start")))
    far = far.select(*place, F.col("_src").alias("src"), F.col("_nth").alias("src_nth"), (F.col("_start") + F.col("src_start") - F.col("_at")).alias("src_start"))
    spans = _through(runs.select(*place, "src", "src_nth", "src_start").unionByName(far), paths.select("path", F.col("src").alias("doc"), F.col("src_nth").alias("nth"), "start", "n"))
    spans = spans.select("path", "doc", "nth", "start", F.col("n").alias("n_windows"), "src", "src_nth", "src_start")
    return inventory, saved(spans), again


def compressed(docs: DataFrame) -> DataFrame:
    """(doc_id, z), written alike by every caller so that one shuffle can serve all joins by doc_id."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_compressed, "doc_id long, z binary")


def several_texts(inventory: DataFrame) -> DataFrame:
    """(doc_id, several): sorted digests of the ids with more than one."""
    return inventory.groupBy("doc_id").agg(F.min("digest").alias("_a"), F.max("digest").alias("_b"), F.sort_array(F.collect_set("digest")).alias("several")).where("_a < _b").select("doc_id", "several")


def _span(words: list[bytes], start: int, n: int, k: int) -> bytes:
    return hashlib.blake2b(b" ".join(words[start : start + n + k - 1]), digest_size=16).digest()


def _of_sources(k: int):
    """(src, src_nth, src_start, n_windows, digest of the words) of the wanted spans of each text."""

    def run(it):
        for batch in _expanded(it):
            out = []
            for row, (doc, text, owners, starts, ns) in enumerate(zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5)])):
                words, nth = text.encode("utf-8", "surrogatepass").split(), _nth(batch, row)
                out += [(doc, nth, a, n, _span(words, a, n, k)) for own, a, n in zip(owners, starts, ns) if own == nth]
            cols = list(zip(*out)) if out else [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary()))], ["src", "src_nth", "src_start", "n_windows", "source"])

    return run


def _cut(k: int):
    """Texts without the words under spans whose words are those of their source."""

    def run(it):
        for batch in _expanded(it):
            out = {"doc_id": [], "digest": [], "n_removed": [], "kept": []}
            for row, (doc, text, owners, starts, ns, sources, earlier) in enumerate(zip(*[batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5, 6, 7)])):
                words, nth = text.encode("utf-8", "surrogatepass").split(), _nth(batch, row)
                windows = np.zeros(max(len(words) - k + 1, 0), bool)
                for own, start, n, source in zip(owners, starts, ns, sources):
                    if own == nth and source is not None and _span(words, start, n, k) == source:
                        windows[start : start + n] = True
                for own, start, n, first in zip(owners, starts, ns, earlier):
                    if own == nth and first is not None:
                        windows[start : start + n] |= windows[first : first + n]
                edge = np.zeros(len(words) + 1, I64)
                np.add.at(edge, np.flatnonzero(windows), 1)
                np.add.at(edge, np.flatnonzero(windows) + k, -1)
                gone = np.cumsum(edge)[:-1] > 0
                out["doc_id"].append(doc)
                out["digest"].append(hashlib.sha256(b" ".join(words)).hexdigest())
                out["n_removed"].append(int(gone.sum()))
                out["kept"].append(b" ".join([x for x, g in zip(words, gone.tolist()) if not g]))
            yield pa.RecordBatch.from_arrays([pa.array(out["doc_id"], pa.int64()), pa.array(out["digest"]), pa.array(out["n_removed"], pa.int64()), pa.array(out["kept"]).cast(pa.string())], list(out))

    return run


def _lists(rows: DataFrame, by: str, fields: list[str]) -> DataFrame:
    """(doc_id, and a list of each field). A document's list is bounded by its own length."""
    got = rows.groupBy(F.col(by).alias("doc_id")).agg(F.collect_list(F.struct(*fields)).alias("_s"))
    return got.select("doc_id", *[F.col("_s").getField(f).alias(f) for f in fields])


def remove_repeats(docs: DataFrame, k: int = K, seed_words: int = SEED_WORDS, keep_text: bool = True) -> DataFrame:
    """For each row: doc_id, n_words, n_removed, kept_sha256 and, with keep_text, kept (the words that stay, joined by one space).

    A word goes if a window of k words over it also begins in a document with a smaller id; all windows are judged on
    the input. Null text: no words. Rows with a null id stay whole. Repeated rows get equal results; of rows with one id and
    several texts each is judged by itself. No rows give no rows."""
    inventory, spans, again = repeated_spans(docs, k, seed_words)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    several, place = several_texts(inventory), ["src", "src_nth", "src_start", "n_windows"]
    wanted = _lists(spans.select(*place).distinct(), "src", place[1:]).join(several, "doc_id", "left")
    sources = compressed(docs).join(wanted, "doc_id").select("doc_id", "z", "src_nth", "several", "src_start", "n_windows").mapInArrow(_of_sources(k), "src long, src_nth int, src_start int, n_windows int, source binary").distinct()
    known = spans.join(sources, place).select("doc", "nth", "start", "n_windows", "source", F.lit(None).cast("int").alias("own_start"))
    known = known.unionByName(again.join(spans.select("doc").distinct(), "doc", "left_semi").withColumn("source", F.lit(None).cast("binary")))
    lists = _lists(known, "doc", ["nth", "start", "n_windows", "source", "own_start"]).join(several, "doc_id", "left")
    cut = compressed(docs).join(lists, "doc_id").select("doc_id", "z", "nth", "several", "start", "n_windows", "source", "own_start").mapInArrow(_cut(k), "doc_id long, digest string, n_removed long, kept string")
    cut = cut.withColumn("kept_sha256", F.sha2("kept", 256))
    cut = cut.groupBy("doc_id", "digest").agg(*[F.first(c).alias(c) for c in ("n_removed", "kept_sha256", *["kept"] * keep_text)])
    firsts = inventory.dropna(subset=["doc_id"]).groupBy("digest").agg(F.min("doc_id").alias("_first"))
    rows = inventory.join(firsts, "digest", "left").join(cut, ["doc_id", "digest"], "left")
    copy = (F.col("doc_id") > F.col("_first")) & (F.col("n_words") >= k)
    out = rows.select(
        "doc_id", "n_words", F.when(copy, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"), *[F.when(copy, F.lit("")).otherwise(F.col("kept")).alias("kept"), "digest"] * keep_text,
    )
    if not keep_text:
        return out
    whole = texts.select("doc_id", F.array_join(F.split(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+", " ")), " "), " ").alias("_whole")).withColumn("digest", F.sha2("_whole", 256)).dropDuplicates(["digest"]).select("digest", "_whole")
    return out.join(whole, "digest", "left").select("doc_id", "n_words", "n_removed", "kept_sha256", F.coalesce("kept", "_whole").alias("kept"))
