"""What several operators share: saved tables, bounded joins, and words of Arrow text columns as arrays of hashes."""

from __future__ import annotations

import contextlib
import ctypes
import sys
import tempfile
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a side of a join is broadcast; it is counted first.
BROADCAST_ROWS = 200_000


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see. Where it is unset: a temporary one in local mode (tests), an error on a cluster."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def saved(df: DataFrame) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts the lineage and survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._saved_at = path
    return out


def discard(*dfs: DataFrame) -> None:
    """Deletes tables that saved() wrote and that nothing reads any more."""
    for df in dfs:
        if path := getattr(df, "_saved_at", None):
            jvm, sc = df.sparkSession._jvm, df.sparkSession.sparkContext
            p = jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def lookup_join(big: DataFrame, small: DataFrame, on: list[str], how: str = "left", spread: Column | None = None, rows: int = BROADCAST_ROWS, salts: int = 16) -> DataFrame:
    """Joins a list to a large table. The list is broadcast if it has at most `rows` rows (counted here);
    a longer one is dealt out by key, with each key of the large side split over `salts` parts by `spread`."""
    if small.limit(rows + 1).count() <= rows:
        return big.join(F.broadcast(small), on, how)
    salt = F.pmod(F.xxhash64(spread if spread is not None else F.monotonically_increasing_id()), F.lit(salts)).cast("int")
    copies = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return big.withColumn("_salt", salt).join(copies, [*on, "_salt"], how).drop("_salt")


# Words as arrays

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))
_tables: dict = {}


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX[0]
    x ^= x >> np.uint64(27)
    x *= _MIX[1]
    return x ^ (x >> np.uint64(31))


def _powers(seed: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd base modulo 2**64 and their inverses, for n positions at least. Tables of up to 2 ** 19 places are kept in the
    process; those for longer single texts are made for the call."""
    if len(_tables.get(("pow", seed), [[]])[0]) < n:
        base = int(mix(np.array([seed + 77], np.uint64))[0]) | 1
        size = -(-n // (1 << 16)) << 16
        step = lambda b: np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(size - 1, b, np.uint64))])
        made = step(base), step(pow(base, -1, 1 << 64))
        if size > 1 << 19:
            return made
        _tables["pow", seed] = made
    return _tables["pow", seed]


def _letters(seed: int, lower: bool) -> np.ndarray:
    """A 64-bit number for each byte; with lower, A-Z have those of a-z."""
    if ("let", seed, lower) not in _tables:
        t = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        if lower:
            t[65:91] = t[97:123]
        _tables["let", seed, lower] = t
    return _tables["let", seed, lower]


def text_chunks(column: pa.Array, limit: int = 1 << 18) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, UTF-8 bytes, offsets of the rows in them), each of about `limit` bytes or one longer row. Null: empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    if not n:
        return
    _, offs, data = column.buffers()
    offs = np.frombuffer(offs, np.int64, n + 1 + column.offset)[column.offset :]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + limit, side="right")) - 1)
        hi = min(hi, n)
        yield lo, hi, data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo]
        lo = hi


def word_spans(data: np.ndarray, offs: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of the words [^\\x20\\x09-\\x0D]+ (or of bytes that space doesn't mark), and for each row the number of its first word (and the total)."""
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    letter = ~space[data]
    first = letter.copy()
    first[1:] &= ~letter[:-1] | edge[1:n]
    last = letter.copy()
    last[:-1] &= ~letter[1:] | edge[1:n]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False, seed: int = 0) -> np.ndarray:
    up, down = _powers(seed, len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_letters(seed, lower)[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def window_hashes(h: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """The hash of h[i : i + k] at i, for every i where it fits."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    up, down = _powers(seed, len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[k:] - total[:n]) * down[:n] + np.uint64(k))


def span_hashes(h: np.ndarray, bounds: np.ndarray, seed: int = 2) -> np.ndarray:
    """The hash of each row's whole sequence of words, h[bounds[i] : bounds[i + 1]]."""
    up, down = _powers(seed, len(h) + 1)
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(h * up[: len(h)], out=total[1:])
    return mix((total[bounds[1:]] - total[bounds[:-1]]) * down[bounds[:-1]] + np.diff(bounds).astype(np.uint64))


def ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """np.arange(s, s + n) for each s and n, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    shift = np.repeat(starts - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths)
    return np.arange(total) + shift


def list_column(values: np.ndarray, counts: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offs = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offs), pa.array(values, kind))


def packed(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """Each row's part of values as bytes."""
    raw = np.ascontiguousarray(values).view(np.uint8) if len(values) else np.zeros(0, np.uint8)
    offs = np.concatenate([[0], np.cumsum(counts * values.dtype.itemsize)]).astype(np.int64)
    return pa.Array.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(offs), pa.py_buffer(raw)])


def trim() -> None:
    """Gives memory that a Python worker no longer uses back to the machine: several workers share an executor's limit."""
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        with contextlib.suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)


def batches(it: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with rows; memory is given back between them."""
    for b in it:
        if b.num_rows:
            yield b
            del b
            trim()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """name, with underscores before it if df has a column of that name (as Spark compares names)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def joined_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends): the words data[s:e] one after the other with a space after each, A-Z in lower case; a run of words of
    one row is then one span of bytes."""
    size = ends - starts + 1
    last = np.cumsum(size)
    out = np.append(data, np.uint8(0))[ranges(starts, size)]
    out[(out >= 65) & (out <= 90)] += 32
    out[last - 1] = 0x20
    return out, last - size, last - 1


def deal_join(big: DataFrame, small: DataFrame, on: str, count: str, total: int, share: int = 1000) -> DataFrame:
    """Inner join of big to small, which has a row for each key and how many of big's `total` rows have it (column `count`, dropped).
    Keys with more than one row in `share` of big are broadcast: there are at most `share` of them. The others are dealt out by key."""
    hot = small.where(F.col(count) * share > total).drop(count)
    cold = big.join(F.broadcast(hot.select(on)), on, "left_anti").join(small.where(F.col(count) * share <= total).drop(count), on)
    return big.join(F.broadcast(hot), on).unionByName(cold)
