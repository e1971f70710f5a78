"""Best-fit decreasing packing of whole documents into sequences.

Documents longer than a sequence are cut into full pieces and a rest; nothing
else is cut. Only lengths decide a packing and there are at most CAPACITY of
them, so the driver packs a histogram: lengths from long to short, every piece
into the open sequence with the least room that still holds it, found by a
segment tree over remaining capacities. Equal pieces that meet equally full
sequences are placed in one move; a move is an interval of ranks and sequences.
The plan has as many rows as there are moves, which lengths and capacities
bound, not documents. Executors then place each piece by its length and its
rank among pieces of that length: a rank inside its partition plus the count of
such pieces in earlier partitions, so no group of rows ever meets in a task.

Null texts are empty documents: one end id. Repeated and null document ids are
packed row by row. An empty table gives no sequence.
"""

from __future__ import annotations

import os
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared
from .piece_cache import PieceCache
from .words import finer, hashes, pieces, split, stops

CAPACITY, END_ID = 2048, 0


class FitTree:
    """Which capacities have open bins; finds the least one of at least a size."""

    def __init__(self, top: int):
        self.width = 1 << top.bit_length()
        self.live = [False] * (2 * self.width)

    def set(self, capacity: int, live: bool) -> None:
        i = capacity + self.width
        self.live[i] = live
        while i > 1:
            i //= 2
            self.live[i] = self.live[2 * i] or self.live[2 * i + 1]

    def tightest(self, size: int) -> int | None:
        i = size + self.width
        while not self.live[i]:
            while i & 1:  # the right child: go up until there is a sibling to the right
                i //= 2
                if i == 0:
                    return None
            if i == 0:
                return None
            i += 1
        while i < self.width:
            i = 2 * i if self.live[2 * i] else 2 * i + 1
        return i - self.width


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Moves (length, first rank, pieces a sequence, first sequence, offset): the piece
    of rank first + i * pieces + j goes to sequence + i, at offset + j * length."""
    tree, open_, moves, bins = FitTree(capacity), [[] for _ in range(capacity + 1)], [], 0

    def leave(room: int, first: int, n: int) -> None:
        if n:
            open_[room].append((first, n))
            if room:
                tree.set(room, True)

    for length in sorted(histogram, reverse=True):
        rank, left = 0, histogram[length]
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, n = bins, -(-left // each)
                bins += n
            else:
                each = room // length
                first, n = open_[room].pop()
                if not open_[room]:
                    tree.set(room, False)
            full = min(n, left // each)
            offset = capacity - room
            if full:
                moves.append((length, rank, each, first, offset))
                leave(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < n and left:  # the last pieces fill part of one more sequence
                moves.append((length, rank, left, first + full, offset))
                leave(room - left * length, first + full, 1)
                rank, left, full = rank + left, 0, full + 1
            leave(room, first + full, n - full)
    return np.array(sorted(moves), np.int64).reshape(-1, 5)


@lru_cache
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)

    last = np.zeros(1 + max(t.get_vocab().values()), bool)  # ids that end a pretoken
    last[[i for x, i in t.get_vocab().items() if x.endswith("</w>")]] = True
    run = lambda x: [y.ids for y in t.encode_batch_fast(x, add_special_tokens=False)]

    def encode(found: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces that are one pretoken are encoded many at a time, joined by spaces."""
        texts = [x.decode() for x in found]
        single = np.array([x.isalpha() and unicodedata.normalize("NFC", x).lower().isalpha() for x in texts], bool)
        joint = [x for x, s in zip(texts, single, strict=True) if s]
        ids = np.fromiter((y for x in run([" ".join(joint[i : i + 200]) for i in range(0, len(joint), 200)]) for y in x), np.int32)
        ends = np.flatnonzero(last[ids]) + 1
        if len(ends) != len(joint):  # every piece has an end at least, so one is several pretokens by other Unicode tables
            single[:], ids, ends = False, ids[:0], ends[:0]
        sizes, parts = np.zeros(len(texts), np.int64), [None] * len(texts)
        alone = np.flatnonzero(~single).tolist()
        for i, one in zip(alone, run([texts[i] for i in alone]), strict=True):
            parts[i], sizes[i] = one, len(one)
        sizes[single] = np.diff(ends, prepend=0)
        flat = np.zeros(int(sizes.sum()), np.int32)
        own = np.repeat(single, sizes)
        flat[own] = ids
        flat[~own] = np.fromiter((y for i in alone for y in parts[i]), np.int32)
        return sizes, flat

    return PieceCache(encode)


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z lower-cased, as the vocabulary does itself, so that fewer pieces differ; not
    before other letters or marks, which may combine, nor beside a special token's string."""
    if b"<|" in data.tobytes():
        return data
    change = (data >= 65) & (data <= 90)
    change[:-1] &= data[1:] < 128
    return np.where(change, data + np.uint8(32), data)


def token_ids(texts: pa.Array, path: str, end: int = END_ID) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each document's ids, and all ids, each document's end id included.
    For vocabularies that lower-case and drop white space: runs without it are encoded by themselves."""
    words = split(texts)
    words = finer(words._replace(data=lowered(words.data)), stops(words.data))
    n, ids = tokenizer(path).ids(hashes(words), words.data, words.offsets) if len(words.offsets) > 1 else (np.zeros(0, np.int64), np.zeros(0, np.int32))
    ends = np.concatenate([[0], np.cumsum(n)])[words.docs]
    d = np.arange(len(ends) - 1)
    out = np.full(len(ids) + len(d), end, np.int32)
    out[np.arange(len(ids)) + np.repeat(d, np.diff(ends))] = ids
    return ends + np.arange(len(ends)), out


def cut(df: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, piece, start, length, ids_crc32 of every piece, with its partition and its rank there among pieces of its length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for b in pieces(batches, text):
            ends, ids = token_ids(b.column(text), path)
            count = -(-np.diff(ends) // capacity)
            doc = np.repeat(np.arange(len(count)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = piece * capacity
            length = np.minimum(capacity, np.diff(ends)[doc] - start)
            view = memoryview(ids.astype("<u4")).cast("B")
            at = (ends[doc] + start) * 4
            crc = [zlib.crc32(view[a:z]) for a, z in zip(at.tolist(), (at + length * 4).tolist(), strict=True)]
            order = np.argsort(length, kind="stable")
            kinds, first, n = np.unique(length[order], return_index=True, return_counts=True)
            rank = np.empty(len(length), np.int64)
            rank[order] = np.arange(len(length)) - np.repeat(first, n) + np.repeat(seen[kinds], n)
            seen[kinds] += n
            yield pa.RecordBatch.from_arrays([b.column(key).take(pa.array(doc)), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64()), pa.array(np.full(len(doc), part), pa.int32()), pa.array(rank)], [key, "piece", "start", "length", "ids_crc32", "part", "rank"])

    kind = df.schema[key].dataType.simpleString()
    return df.select(key, text).mapInArrow(run, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, part int, rank long")


def pack(df: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row a piece: key, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = df.sparkSession
    made = shared.table(cut(df, path, capacity, key, text), "pieces")  # ranks hold only for one run of the scan
    counts = made.groupBy("part", "length").count()
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("count").alias("n")).collect()}
    moves = spark.sparkContext.broadcast(plan(histogram, capacity))
    before = F.sum("count").over(Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    ranked = made.join(counts.select("part", "length", F.coalesce(before, F.lit(0)).alias("before")), ["part", "length"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = moves.value
        keys = m[:, 0] << 44 | m[:, 1]
        for b in batches:
            length, rank = b.column("length").to_numpy(), b.column("rank").to_numpy() + b.column("before").to_numpy()
            row = m[np.searchsorted(keys, length << 44 | rank, "right") - 1]
            i, j = np.divmod(rank - row[:, 1], row[:, 2])
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in (key, "piece", "start", "length", "ids_crc32")), pa.array(row[:, 3] + i), pa.array(row[:, 4] + j * length)], [key, "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    kind = df.schema[key].dataType.simpleString()
    return ranked.select(key, "piece", "start", "length", "ids_crc32", "rank", "before").mapInArrow(place, f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
