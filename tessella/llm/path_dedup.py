"""Substring dedup by compaction of the de Bruijn graph of repeated word windows.

The windows of 20 words are the edges of a graph whose nodes are runs of 19.
1. Local compaction: a window's anchor is its least 6-word run by hash, so equal
   windows have equal anchors at equal places, and consecutive windows with one
   anchor are a path that stays together as one row, about an eighth as many
   rows as windows. Paths meet by anchor, and those that occur again are kept.
   Paths of an anchor with several contents are also taken apart into windows,
   which meet by window. Edges that occur once leave here.
2. Compaction by joins: an edge of the repeated graph (a path or a window) and
   its successor are linked where the node between them does not branch: every
   occurrence of the first is followed by the second, and every one of the
   second follows the first. Edges are joined with their successors for that, and
   the links with all occurrences of their edges. As a link holds wherever its edges
   occur, each occurrence of a compacted path is a run of linked places in its
   document, and its head is the last place before that is not linked.
3. The source coordinates of all occurrences of a compacted path verify it: what
   lies end to end in its document is one span, and all but the earliest
   occurrence are removed.
Spans are put together by document and applied to the text.

Earlier is a smaller id, or a smaller start in the same document. A task sends
two occurrences of an edge to where it meets; further ones, which are surely
later, are sent on under keys of their own, so a passage that a third of all
documents share is a few rows a task when edges meet. All windows of all
documents take part; nothing is collected.

Null texts have no words. Rows without an id lose nothing and count for nobody.
Rows that share an id and a text are one document, and lose the same words; unlike
texts of one id are documents of their own, one behind the other by a hash of their texts.
Texts of any length and columns of any name are fine. Empty tables give empty
results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared, sketches
from .merkle import numbered
from .words import U64, Words, hashes, inside, pieces, runs, split, splitmix

WINDOW, ANCHOR = 20, 6
CELLS = 24
_PLACE = U64((1 << 26) - 1)
PART = 1 << 25  # words that are handled together: their places fit those bits


def least_runs(g: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` values the place of its least one (by the upper bits), the first of equals."""
    if len(g) > PART + width:
        return np.concatenate([least_runs(g[i : i + PART + width - 1], width) + i for i in range(0, len(g) - width + 1, PART)])
    key = g & ~_PLACE | np.arange(len(g), dtype=U64)
    size = 1
    while 2 * size <= width:
        key = np.minimum(key[: len(key) - size], key[size:])
        size *= 2
    if size < width:
        more = width - size
        key = np.minimum(key[: len(key) - more], key[more:])
    return (key & _PLACE).astype(np.int64)


class Paths:
    """The paths of a batch of texts: anchor and content hashes, document, first window, number of windows."""

    def __init__(self, words: Words, window: int = WINDOW, anchor: int = ANCHOR):
        h = hashes(words)
        keep, _ = inside(words.docs, window)
        at = np.flatnonzero(keep)
        self.windows = runs(h, window)
        g = runs(h, anchor)
        if not len(at):
            self.anchor = self.content = np.zeros(0, U64)
            self.doc = self.start = self.count = self.flat = np.zeros(0, np.int64)
            return
        place = least_runs(g, window - anchor + 1)[at]
        new = np.ones(len(at), bool)
        new[1:] = (place[1:] != place[:-1]) | (at[1:] != at[:-1] + 1)
        first = np.flatnonzero(new)
        self.flat = at[first]
        self.count = np.diff(first, append=len(at))
        odd = splitmix(np.arange(int(self.count.max()), dtype=U64) + U64(1 << 43)) | U64(1)
        step = np.arange(len(at)) - np.repeat(first, self.count)
        self.content = splitmix(np.add.reduceat(self.windows[at] * odd[step], first) + self.count.astype(U64))
        self.anchor = g[place[first]]
        self.doc = np.searchsorted(words.docs, self.flat, "right") - 1
        self.start = self.flat - words.docs[self.doc]


class Sent:
    """How many places of each edge (up to `most`) a task has sent, in a table of fixed size that newer edges overwrite."""

    def __init__(self, most: int = 2, slots: int = 1 << 18):
        self.most = most
        self.key, self.rows = np.zeros(slots, U64), np.zeros(slots, np.int64)
        self.id, self.start = np.zeros(slots, np.int64), np.zeros(slots, np.int64)

    def places(self, key: np.ndarray, content: np.ndarray, ids: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows, one for each place of an edge, and which of them have `most` places before them that were sent."""
        mixed = splitmix(content ^ splitmix(key))
        order = np.lexsort((start, ids, mixed))
        k, i, s = mixed[order], ids[order].astype(np.int64), start[order].astype(np.int64)
        same = np.zeros(len(k), bool)
        same[1:] = k[1:] == k[:-1]
        once = ~same
        once[1:] |= (i[1:] != i[:-1]) | (s[1:] != s[:-1])
        order, k, i, s, new = order[once], k[once], i[once], s[once], ~same[once]
        head = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        slot = (k & U64(len(self.key) - 1)).astype(np.int64)
        held = np.where(self.key[slot] == k, self.rows[slot], 0)
        above = (i > self.id[slot]) | (i == self.id[slot]) & (s > self.start[slot])
        sure = np.arange(len(k)) - head[group] + np.where(above, held, 0) >= self.most
        sent = np.add.reduceat(~sure, head) if len(head) else head
        last = head + np.maximum(sent, 1) - 1  # sure rows come last
        low = held[head] < self.most
        at = slot[head]
        up = low & (sent > 0) & ((held[head] == 0) | above[last])
        self.id[at[up]], self.start[at[up]] = i[last[up]], s[last[up]]
        self.key[at[low]], self.rows[at[low]] = k[head[low]], np.minimum(self.most, held[head[low]] + sent[low])
        return order, sure

    def batch(self, key: np.ndarray, content: np.ndarray, ids: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        """A row for each place of an edge. One with two places before it that were sent is surely
        later and needs no meeting; it goes under a key of its own."""
        order, sure = self.places(key, content, ids, start)
        key, content, i, s, n = key[order], content[order], ids[order].astype(np.int64), start[order].astype(np.int64), n[order]
        key = np.where(sure, splitmix(splitmix(i.view(U64)) + s.astype(U64)), key)
        return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(content.view(np.int64)), pa.array(i), pa.array(s, pa.int32()), pa.array(n, pa.int32()), pa.array(sure)], ["key", "content", "id", "start", "n", "sure"])


ROWS = "key long, content long, id long, start int, n int, sure boolean"


def repeated(docs: DataFrame, window: int, anchor: int) -> DataFrame:
    """layer, content, id, start, n, late: all places of paths (layer 0) that occur again, and of
    windows (layer 1) of anchors with several contents that do. docs: id, text."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, Paths]]:
        for b in pieces(batches, "text"):
            yield b.column("id").to_numpy(), Paths(split(b.column("text")), window, anchor)

    def paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = Sent()
        for ids, p in cut(batches):
            yield sent.batch(p.anchor, p.content, ids[p.doc], p.start, p.count)

    place = F.struct("id", "start")
    same, met = Window.partitionBy("key", "content"), Window.partitionBy("key")
    ends = {"first": F.min(place).over(same), "last": F.max(place).over(same)}
    late, again = F.col("sure") | (F.col("first") < place), F.col("sure") | (F.col("first") < F.col("last"))
    rows = docs.mapInArrow(paths, ROWS).withColumns(ends).withColumns({"c0": F.min("content").over(met), "c1": F.max("content").over(met)})
    rows = rows.select("key", "content", "id", "start", "n", late.alias("late"), again.alias("again"), (F.col("c0") != F.col("c1")).alias("branching"))
    rows = shared.table(rows.where("again or branching"), "paths")

    # every path of an anchor with several contents, and of anchors that share its cell
    branching = rows.where("branching").select("key").distinct()
    cells = docs.sparkSession.sparkContext.broadcast(sketches.gather(branching, lambda b: iter([b.column("key").to_numpy().view(U64)]), bits=CELLS))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken, sent = Sent(most=1), Sent()
        for ids, p in cut(batches):
            on = np.flatnonzero(cells.value[sketches.cells(p.anchor, CELLS)] > 0)
            own = ids[p.doc]
            order, later = taken.places(p.anchor[on], p.content[on], own[on], p.start[on])
            on = on[order[~later]]  # later copies are paths that occur again
            n = p.count[on]
            step = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
            h = p.windows[np.repeat(p.flat[on], n) + step]
            yield sent.batch(h, h, np.repeat(own[on], n), np.repeat(p.start[on], n) + step, np.ones(len(h), np.int32))

    columns = ["content", "id", "start", "n"]
    single = shared.table(docs.mapInArrow(windows, ROWS).withColumns(ends).where(again).select(F.lit(1).alias("layer"), *columns, late.alias("late")), "windows")
    both = rows.where("again").select(F.lit(0).alias("layer"), *columns, "late").unionByName(single)
    # rows that are repeated in several tasks have one place
    out = shared.table(both.repartition("layer", "id").dropDuplicates(["layer", "id", "start", "content"]), "places")
    shared.drop(rows)
    shared.drop(single)
    return out


def compacted(places: DataFrame) -> DataFrame:
    """places with origin: where the compacted path that a place is part of starts in its document."""
    w = Window.partitionBy("layer", "id").orderBy("start", "content")
    step = lambda f, c: f(c).over(w)
    beside = places.withColumns({
        "next": F.when(step(F.lead, "start") == F.col("start") + F.col("n"), step(F.lead, "content")),
        "prev": F.when(step(F.lag, "start") + step(F.lag, "n") == F.col("start"), step(F.lag, "content")),
    })
    only = lambda c: F.when((F.count(c) == F.count("*")) & (F.min(c) == F.max(c)), F.min(c)).alias(c)
    edges = shared.table(beside.groupBy("content").agg(only("next"), only("prev")).where("next IS NOT NULL OR prev IS NOT NULL"), "edges")
    before = edges.select(F.col("content").alias("prev"), F.col("next").alias("content"))
    # the node between prev and content has one edge in and one out, and no occurrence begins or ends there
    linked = shared.table(edges.select("content", "prev").join(before, ["content", "prev"]).select("content", F.lit(True).alias("linked")), "linked")
    shared.drop(edges)
    head = F.last(F.when(F.col("linked").isNull(), F.col("start")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return places.join(linked, "content", "left").withColumn("origin", head).drop("linked")


def spans(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR) -> DataFrame:
    """id, start, n: windows start .. start + n - 1 of the document also start earlier."""
    docs = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    places = repeated(docs, window, anchor)
    of = compacted(places).where("late").groupBy("layer", "id", "origin")
    of = of.agg(F.min("start").alias("start"), F.max(F.col("start") + F.col("n")).alias("end"), F.sum("n").alias("sum"), F.collect_list(F.struct("start", "n")).alias("parts"))
    one = F.array(F.struct("start", F.col("sum").cast("int").alias("n")))
    found = of.select("id", F.explode(F.when(F.col("end") - F.col("start") == F.col("sum"), one).otherwise(F.col("parts"))).alias("s")).select("id", "s.start", "s.n")
    out = shared.table(found, "spans")
    shared.drop(places)
    return out


def free(docs: DataFrame, name: str) -> str:
    """A name that no column begins with."""
    while any(c.startswith(name) for c in docs.columns):
        name += "_"
    return name


def apart(docs: DataFrame, key: str, text: str) -> DataFrame | None:
    """_id, _hash, _place: the order of all distinct (id, text) where unlike texts share an id; None where none do."""
    own = docs.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("_id"), F.xxhash64(text).alias("_hash"))
    texts = shared.table(own.groupBy("_id").agg(F.min("_hash").alias("_hash"), F.max("_hash").alias("_last")), "texts")
    if texts.where("_hash < _last").isEmpty():
        shared.drop(texts)
        return None
    found = shared.table(own.distinct().withColumn("grp", F.lit("")), "texts")
    return numbered(found, ["_id", "_hash"]).select("_id", "_hash", F.col("idx").alias("_place"))


def without(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> tuple[DataFrame, str]:
    """docs with one more column, and its name: [start, n, ...] of the removed windows, or null."""
    name = free(docs, "_spans")
    gathered = F.flatten(F.collect_list(F.array("start", "n"))).alias(name)
    of = apart(docs, key, text)
    if of is None:
        found = spans(docs, key, text, window).groupBy(F.col("id").alias(f"{name}_id")).agg(gathered)
        return docs.join(found, F.col(key).cast("long") == F.col(f"{name}_id"), "left").drop(f"{name}_id"), name
    of = shared.table(of.select(F.col("_id").alias(f"{name}_id"), F.col("_hash").alias(f"{name}_hash"), F.col("_place").alias(f"{name}_place")), "places")
    its = (F.col(key).cast("long") == F.col(f"{name}_id")) & (F.xxhash64(text) == F.col(f"{name}_hash"))
    rows = shared.table(docs.join(of, its, "left").drop(f"{name}_id", f"{name}_hash"), "rows")
    found = spans(rows, f"{name}_place", text, window).groupBy(F.col("id").alias(f"{name}_id")).agg(gathered)
    return rows.join(found, F.col(f"{name}_place") == F.col(f"{name}_id"), "left").drop(f"{name}_id", f"{name}_place"), name


def kept(texts: pa.Array, removed: pa.Array, window: int = WINDOW) -> Iterator[tuple[int, int, bytes]]:
    """Of each text: its number of words, of removed words, and the kept ones joined by spaces."""
    words = split(texts)
    for d, gone in enumerate(removed):
        a, z = int(words.docs[d]), int(words.docs[d + 1])
        n, at = z - a, words.offsets[a : z + 1]
        mark = np.zeros(n + 1, np.int32)
        if gone.is_valid:
            pair = np.asarray(gone.values, np.int64).reshape(-1, 2)
            pair = pair[pair[:, 0] < n]
            np.add.at(mark, pair[:, 0], 1)
            np.add.at(mark, np.minimum(pair.sum(1) + window - 1, n), -1)
        keep = np.cumsum(mark[:n]) == 0
        sizes = np.diff(at)
        # each kept word and a space after it
        out = np.full(int(sizes[keep].sum() + keep.sum()), 0x20, np.uint8)
        ends = np.cumsum(sizes[keep] + 1)
        body = np.ones(len(out), bool)
        body[ends - 1] = False
        out[body] = words.data[at[0] : at[-1]][np.repeat(keep, sizes)]
        yield n, int(n - keep.sum()), out[:-1].tobytes()


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """key, n_words, n_removed, kept_sha256 of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            got = [(n, m, hashlib.sha256(x).hexdigest()) for n, m, x in kept(b.column(text), b.column(name), window)]
            yield pa.RecordBatch.from_arrays([b.column(key), pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64()), pa.array([g[2] for g in got], pa.string())], [key, "n_words", "n_removed", "kept_sha256"])

    rows, name = without(docs.select(key, text), key, text, window)
    return rows.mapInArrow(run, f"`{key}` {docs.schema[key].dataType.simpleString()}, n_words long, n_removed long, kept_sha256 string")


def clean(docs: DataFrame, key: str = "doc_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """docs whose texts have lost their removed words; texts that lose nothing stay as they are."""
    columns, schema = docs.columns, docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, text):
            old = b.column(text)
            new = [x.decode() if m else y.as_py() for (_, m, x), y in zip(kept(old, b.column(name), window), old, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(new, old.type) if c == text else b.column(c) for c in columns], columns)

    rows, name = without(docs, key, text, window)
    return rows.select(*columns, name).mapInArrow(run, schema)
