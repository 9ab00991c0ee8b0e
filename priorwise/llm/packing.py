"""Bounded-space online packing of tokenised documents into training sequences."""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, ranges, saved, text_chunks, word_hashes

WINDOW = 2048
OPEN_WINDOWS = 64
MIN_CUT = 16
FAN_IN = 32
END_ID = 1

KINDS = pa.schema([*[(k, pa.int64()) for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")], ("ids", pa.binary()), ("left_of", pa.int64())])
PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: Fixed value: the pattern of this vocabulary that parts texts before merging.
PRE_TOKENS = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The file writes a byte as a character: printable ones as themselves, the others from U+0100 on.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_OF = {b: b for b in _PLAIN} | {256 + i: b for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}
_encoders: dict = {}


class BpeEncoder:
    """Ids of texts by a byte-level BPE file, as encode_batch(texts, add_special_tokens=False) gives them.

    Texts are cut where a pre-token of this vocabulary always begins: at a single space between two visible characters,
    at , . ; : ! ? after a letter, and around a single line break between visible characters. Each different cut is encoded once,
    and a bounded memory of cuts is kept between batches."""

    ASCII_LETTER, STOP = np.zeros(256, bool), np.zeros(256, bool)
    ASCII_LETTER[65:91] = ASCII_LETTER[97:123] = True
    STOP[list(b",.;:!?")] = True

    def __init__(self, path: str, remember: int = 200_000):
        import tiktoken

        with open(path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        ranks = {bytes(BYTE_OF[ord(c)] for c in token): i for token, i in vocabulary.items() if all(ord(c) in BYTE_OF for c in token) and token != "<|endoftext|>"}
        # the file's merges make its tokens in the order of their ids, so ids are ranks
        self.bpe = tiktoken.Encoding("file", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})
        self.lengths = np.zeros(max(ranks.values()) + 1, np.int64)
        self.lengths[list(ranks.values())] = [len(token) for token in ranks]
        self.known: dict[int, bytes] = {}
        self.remember = remember

    @classmethod
    def of(cls, path: str) -> BpeEncoder:
        """The encoder of this process."""
        if path not in _encoders:
            _encoders[path] = cls(path)
        return _encoders[path]

    def __call__(self, column: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
        """(first row, end row, ids as uint16, number of the first id of each row and the total)."""
        for lo, hi, data, offs in text_chunks(column, 1 << 20):
            starts, ends = self.cuts(data, offs)
            rows = np.searchsorted(starts, offs)
            if not len(starts):
                yield lo, hi, np.zeros(0, np.uint16), np.zeros(hi - lo + 1, np.int64)
                continue
            keys, at, back = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
            parts = self.parts(data, keys, starts[at], ends[at])
            sizes = np.fromiter(map(len, parts), np.int64, len(parts)) // 2
            flat, first = np.frombuffer(b"".join(parts), np.uint16), np.concatenate([[0], np.cumsum(sizes)[:-1]])
            counts = sizes[back]
            total = np.concatenate([[0], np.cumsum(counts)])
            yield lo, hi, flat[ranges(first[back], counts)], total[rows]

    @staticmethod
    def cuts(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        n = len(data)
        cut = np.zeros(n + 1, bool)
        if n > 2:
            a, b, c = data[:-2], data[1:-1], data[2:]
            cut[1 : n - 1] = (b == 0x20) & (a > 0x20) & (c > 0x20) & ((a < 0x80) | (c < 0x80))
            letter = BpeEncoder.ASCII_LETTER[data]
            letter[1:] |= (data[:-1] == 0xC3) & (data[1:] != 0x97) & (data[1:] != 0xB7)  # U+00C0 to U+00FF without the two signs
            cut[1:n] |= letter[:-1] & BpeEncoder.STOP[data[1:]]
            visible = (data > 0x20) & (data < 0x7F)
            alone = (b == 0x0A) & visible[:-2] & visible[2:]  # in a run of white space the last sign is a pre-token of its own
            cut[1 : n - 1] |= alone
            cut[2:n] |= alone
        cut[offs] = True
        starts = np.flatnonzero(cut[:n])
        return starts, np.append(starts[1:], n) if len(starts) else starts

    def parts(self, data: np.ndarray, keys: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[bytes]:
        known, keys = self.known, keys.tolist()
        new = [i for i, k in enumerate(keys) if k not in known]
        if len(known) + len(new) > self.remember:
            self.known = known = {}
            new = range(len(keys))
        raw, starts, ends = data.tobytes(), starts.tolist(), ends.tolist()
        joined, alone = [], []
        for i in new:
            t = raw[starts[i] : ends[i]].decode("utf-8", "replace")
            if len(t) > 1 and t[0] == " " and not t[1].isspace() and not t[-1].isspace():
                joined.append((i, t))
            elif "!" <= t[0] <= "~" and "!" <= t[-1] <= "~":
                joined += [(None, "\n"), (i, t)]
            else:
                alone.append((i, t))
        for i, t in alone:
            known[keys[i]] = np.array(self.bpe.encode_ordinary(t), np.uint16).tobytes()
        for lo in range(0, len(joined), 4096):  # such cuts side by side are encoded in one go and parted by their lengths
            some = joined[lo : lo + 4096]
            ids = np.array(self.bpe.encode_ordinary("".join(t for _, t in some)), np.uint16)
            upto = np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([1 if i is None else ends[i] - starts[i] for i, _ in some]), side="left") + 1
            flat, at = ids.tobytes(), 0
            for (i, _), end in zip(some, (2 * upto).tolist()):
                if i is not None:
                    known[keys[i]] = flat[at:end]
                at = end
        return [known[k] for k in keys]


class Windows:
    """A fixed number of open windows. A piece goes where it leaves least room; where none has room,
    the fullest window is filled by a cut of the piece (if its gap is worth one) and emitted."""

    def __init__(self, size: int, count: int, min_cut: int, emit: Callable[[list], None]):
        self.size, self.count, self.min_cut, self.emit = size, count, min_cut, emit
        self.room: list[tuple[int, int]] = []  # (free places, window), sorted
        self.held: dict[int, list] = {}
        self.made = 0

    def add(self, doc, start: int, ids: np.ndarray, total: int) -> None:
        while len(ids):
            at = bisect_left(self.room, (len(ids), -1))
            if at < len(self.room):
                free, w = self.room.pop(at)
                take = len(ids)
            elif len(self.room) < self.count:
                free, w, take = self.size, self.made, min(len(ids), self.size)
                self.made += 1
                self.held[w] = []
            else:
                free, w = self.room.pop(0)
                take = free if free >= self.min_cut else 0
            if take:
                self.held[w].append((doc, start, ids[:take], total))
                start, ids, free = start + take, ids[take:], free - take
            if free == 0 or not take:
                self.emit(self.held.pop(w))
            else:
                insort(self.room, (free, w))


def _rows(pieces: list, sequence: int, keep_ids: bool, group: int | None = None) -> dict:
    out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids", "left_of")}
    offset = 0
    for doc, start, ids, total in pieces:
        wide = ids.astype("<u4")
        for k, v in zip(out, (doc, start, len(ids), zlib.crc32(wide.tobytes()), total, sequence, offset, wide.tobytes() if keep_ids or group is not None else None, group)):
            out[k].append(v)
        offset += len(ids)
    return out


def _merger(level: int, last: bool, window: int, fan_in: int, keep_ids: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """What fan_in partitions left, packed without gaps; the last sequence, not full, goes on to the next level."""
        group, done = int(pdf["left_of"].iloc[0]) // fan_in, []
        state = Windows(window, 1, 1, done.append)
        pdf = pdf.sort_values(["sequence_id", "offset"])
        for doc, start, ids, total in zip(pdf["doc_id"], pdf["start"], pdf["ids"], pdf["doc_tokens"]):
            state.add(None if pd.isna(doc) else int(doc), int(start), np.frombuffer(ids, "<u4"), int(total))
        made = [_rows(p, level << 56 | group << 32 | i, keep_ids) for i, p in enumerate(done)]
        made += [_rows(p, level << 56 | group << 32 | len(done), keep_ids, None if last else group) for p in state.held.values()]
        cols = {k: [v for m in made for v in m[k]] for k in KINDS.names}
        return pd.DataFrame({k: pd.array(v, "Int64") if KINDS.field(k).type == pa.int64() else v for k, v in cols.items()})

    return merge


def pack_documents(docs: DataFrame, vocabulary: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, min_cut: int = MIN_CUT, fan_in: int = FAN_IN, end_id: int = END_ID, keep_ids: bool = True) -> DataFrame:
    """A row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset and, with keep_ids, ids (little-endian unsigned 32-bit).

    Each partition packs its own documents in one pass with open_windows windows in memory; a document is text's ids (null: none) and end_id.
    What is left open at the end of a partition is merged in groups of fan_in partitions, the rest of those again, until one
    sequence is left. Every id lies in exactly one piece; repeated rows and null ids are packed like others. No rows: no pieces.
    Only doc_id and text are read."""
    schema = PIECE + ", ids binary, left_of long"

    def pack(it):
        part = TaskContext.get().partitionId()
        encode, done = BpeEncoder.of(vocabulary), []
        state = Windows(window, open_windows, min_cut, done.append)
        n = 0

        def flush(pieces_lists, group=None):
            nonlocal n
            cols: dict[str, list] = {k: [] for k in KINDS.names}
            for pieces in pieces_lists:
                for k, v in _rows(pieces, part << 32 | n, keep_ids, group).items():
                    cols[k] += v
                n += 1
            return pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in KINDS], schema=KINDS)

        for batch in batches(it):
            names = batch.column(0).to_pylist()
            for lo, hi, ids, bounds in encode(batch.column(1)):
                for i in range(lo, hi):
                    own = np.append(ids[bounds[i - lo] : bounds[i - lo + 1]], np.uint16(end_id))
                    state.add(names[i], 0, own, len(own))
                if done:
                    yield flush(done)
                    done.clear()
        if state.held:
            yield flush(state.held.values(), part)

    made = saved(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(pack, schema))
    out = made.where("left_of is null")
    left = made.where("left_of is not null")
    top = left.agg(F.max("left_of")).first()[0]
    level = 1
    while top is not None:
        last = top < fan_in

        merged = left.groupBy(F.floor(F.col("left_of") / fan_in).alias("_group")).applyInPandas(_merger(level, last, window, fan_in, keep_ids), schema)
        if not last:
            merged = saved(merged)
        out = out.unionByName(merged.where("left_of is null"))
        left, top, level = merged.where("left_of is not null"), None if last else top // fan_in, level + 1
    return out.drop("left_of", *[] if keep_ids else ["ids"])
