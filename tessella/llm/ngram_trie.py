"""Language-model scores from an Elias-Fano n-gram trie.

Tokens are words (runs without white space, A-Z lower-cased) and one end token a
text, which also stands before the first word as context. Counts of all training
rows are gathered level by level: words, then word pairs, then triples both of
whose pairs were kept. N-grams above words are kept from `least` occurrences on,
all of them with 1;
an n-gram's probability is discounted and interpolated with that of its shorter
context, words with add-one smoothing, so the probabilities of all words and of
an unknown one sum to 1 in every context.

A level is a list of nodes in the order (parent, word). Files of a level hold a
range of that order: pointers from parents to their first nodes, the nodes' words
relative to the context as an Elias-Fano list, and probabilities and back-off
weights in 16 bits. Tasks map the files of the shared folder and look
up distinct n-grams of a batch. Ranges are dealt by counts, so that a context
that follows everywhere is split by the word after it.

Null texts are empty: one end token. Rows without an id are learned from and
scored. An empty table gives an empty result; without training rows every token
has probability 1 in base and score.
"""

from __future__ import annotations

import glob
import os
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import elias_fano, shared
from .elias_fano import EliasFano
from .words import U64, distinct, hashes, pieces, rising, split, splitmix

SLICE = 2 << 20  # bytes of text handled together: n-grams of larger pieces repeat more
ORDER, LEAST, DISCOUNT = 3, 1, 0.5
STEP = 4096  # quantisation: 1 / STEP of a decimal logarithm
END = splitmix(np.array([1 << 44], U64))[0]
HELD, MARKS, FILE_TOKENS = 1_500_000, 64, 4_000_000
FILE_BYTES = 128 << 20  # of input for a vocabulary file


def tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each text's tokens and all token hashes; each text begins with the end token as context."""
    words = split(texts, lower=True)
    n = np.diff(words.docs)
    bounds = np.concatenate([[0], np.cumsum(n + 2)])
    out = np.full(bounds[-1], END, U64)
    out[np.arange(len(words.offsets) - 1) + np.repeat(2 * np.arange(len(n)) + 1, n)] = hashes(words)
    return bounds, out


def quantise(p: np.ndarray) -> np.ndarray:
    return np.minimum(np.rint(-np.log10(np.maximum(p, 1e-300)) * STEP), 65535).astype(np.uint16)


class Level(NamedTuple):
    """Of each file: the first node, and the first (parent, word) after the first file's."""

    first: np.ndarray
    cuts: np.ndarray
    parents: int
    back: dict[int, int]  # back-off weights of parents that several files share


class Model(NamedTuple):
    path: str
    files: int
    words: np.ndarray  # first word of each vocabulary file
    n: int
    v: int
    levels: tuple[Level, ...]

    @property
    def base(self) -> int:
        """Of keys parent * base + word; word v stands for an unknown one."""
        return self.v + 1

    def keys(self, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
        return parent.astype(U64) * U64(self.base) + word.astype(U64)

    def parts(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        parent = keys // U64(self.base)
        return parent.astype(np.int64), (keys - parent * U64(self.base)).astype(np.int64)

    def room_for(self, parents: int) -> None:
        if parents * self.base >= 1 << 63:
            raise OverflowError(f"{parents} contexts of {self.v} words do not fit 63 bits")


@lru_cache(4096)
def opened(path: str) -> dict[str, np.ndarray]:
    return elias_fano.load(path)


def narrow(counts: np.ndarray) -> np.ndarray:
    """The counts in as few bytes each as the largest needs."""
    return counts.astype(np.min_scalar_type(int(counts.max(initial=0))))


def word_file(h: np.ndarray, files: int) -> np.ndarray:
    return ((h >> U64(32)) * U64(files) >> U64(32)).astype(np.int64)


def ranges(which: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The runs of a sorted list of file numbers."""
    if len(which):
        new = np.flatnonzero(np.diff(which, prepend=which[0] - 1))
        for a, b in zip(new, [*new[1:], len(which)], strict=True):
            yield int(which[a]), slice(int(a), int(b))


def word_ids(m: Model, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(id or -1, count) of sorted word hashes."""
    ids, counts = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
    for f, at in ranges(word_file(h, m.files)):
        held = opened(f"{m.path}/words-{f}")
        if len(held["hash"]):
            i = np.minimum(np.searchsorted(held["hash"], h[at]), len(held["hash"]) - 1)
            hit = held["hash"][i] == h[at]
            ids[at] = np.where(hit, m.words[f] + i, -1)
            counts[at] = np.where(hit, held["count"][i], 0)
    return ids, counts


def word_counts(m: Model, ids: np.ndarray) -> np.ndarray:
    """Counts of sorted word ids."""
    out = np.zeros(len(ids), np.int64)
    for f, at in ranges(np.searchsorted(m.words, ids, "right") - 1):
        out[at] = opened(f"{m.path}/words-{f}")["count"][ids[at] - m.words[f]]
    return out


def look_up(m: Model, n: int, parent: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """At level n: node or -1, its quantised probability, and the parent's back-off weight.
    Negative parents or words have no node, and negative parents weigh nothing."""
    node, prob, back = np.full(len(parent), -1, np.int64), np.zeros(len(parent), np.int64), np.zeros(len(parent), np.int64)
    some = np.flatnonzero(parent >= 0)
    keys, where = distinct(m.keys(parent[some], np.where(word[some] >= 0, word[some], m.v)))
    level, (own, last) = m.levels[n - 2], m.parts(keys)
    k_node, k_prob, k_back = np.full(len(keys), -1, np.int64), np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
    for f, at in ranges(np.searchsorted(level.cuts, keys, "right")):
        held, weights = opened(f"{m.path}/nodes{n}-{f}"), opened(f"{m.path}/weights{n}-{f}")
        start, words = held["start"], EliasFano(held, "words")
        low = int(held["low"][0])
        first = np.flatnonzero(np.diff(own[at], prepend=-1))  # keys are sorted, so parents are
        many = np.diff(first, append=at.stop - at.start)
        new = own[at][first] - low
        begin, end = (np.repeat(start[new + j].astype(np.int64), many) for j in (0, 1))
        k_back[at] = np.repeat(weights["back"][new], many)
        known = np.flatnonzero((begin < end) & (last[at] < m.v))
        i = words.find(keys[at][known] - U64(low * m.base), begin[known], end[known])
        hit = i >= 0
        to = at.start + known[hit]
        k_node[to], k_prob[to] = level.first[f] + i[hit], weights["prob"][i[hit]]
    for p, b in level.back.items():
        k_back[own == p] = b
    node[some], prob[some], back[some] = k_node[where], k_prob[where], k_back[where]
    return node, prob, back


def planes(x: np.ndarray) -> bytes:
    """The bytes of integers by significance, which compress well where the upper ones are alike."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), -1).T).tobytes()


def unplanes(x: bytes, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(x, np.uint8).reshape(size, -1).T).view(kind).ravel()


def summed(keys: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in rising order and the sums of their counts (without counts: how often they occur)."""
    if counts is None:
        keys = np.sort(keys)
    else:
        order = rising(keys)
        keys, counts = keys[order], counts[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    return keys[first], np.diff(first, append=len(keys)) if counts is None or not len(keys) else np.add.reduceat(counts, first)


def tally(found: Iterator[np.ndarray], file_of, schema=("file", "keys", "counts")) -> Iterator[pa.RecordBatch]:
    """Distinct keys and their counts, a row for each file. At most about HELD keys are held at a time."""
    keys, counts, waiting, size = np.zeros(0, U64), np.zeros(0, np.int64), [], 0

    def merge() -> None:
        nonlocal keys, counts, waiting, size
        more, times = summed(np.concatenate([keys[:0], *waiting]))
        keys, counts = summed(np.concatenate([keys, more]), np.concatenate([counts, times])) if len(keys) else (more, times)
        waiting, size = [], 0

    def flush() -> pa.RecordBatch:
        rows = [(f, planes(np.diff(keys[at], prepend=U64(0))), planes(counts[at].astype(np.uint32))) for f, at in ranges(file_of(keys))]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], list(schema))

    for x in found:
        waiting.append(x)
        size += len(x)
        if size > HELD:
            merge()
            if len(keys) > HELD:
                yield flush()
                keys, counts = keys[:0], counts[:0]
    merge()
    if len(keys):
        yield flush()


def gathered(part: pa.Table) -> tuple[int, np.ndarray, np.ndarray]:
    keys = [np.cumsum(unplanes(x.as_py(), U64), dtype=U64) for x in part.column("keys")]
    counts = [unplanes(x.as_py(), np.uint32) for x in part.column("counts")]
    return part.column("file")[0].as_py(), *summed(np.concatenate(keys), np.concatenate(counts).astype(np.int64))


STATS = "file int, nodes long, mass long, marks array<long>, edges array<long>"


def stats(file: int, counts: np.ndarray, edges: list[int]) -> pa.Table:
    """marks: the nodes at equal steps of the counts."""
    mass = np.cumsum(counts)
    total = int(mass[-1]) if len(mass) else 0
    marks = np.searchsorted(mass, np.arange(MARKS) * total / MARKS, "right") if total else np.zeros(0, int)
    return pa.table([pa.array([file], pa.int32()), pa.array([len(counts)], pa.int64()), pa.array([total], pa.int64()), pa.array([marks.tolist()], pa.list_(pa.int64())), pa.array([edges], pa.list_(pa.int64()))], ["file", "nodes", "mass", "marks", "edges"])


def dealt(rows: list, first: np.ndarray, files: int, words: np.ndarray, base: int) -> np.ndarray:
    """Cuts of the order (parent, word) into files of about equal counts. rows: the parents'
    stats; words: word ids at equal steps of their counts. A parent that fills several files is cut by words."""
    at = np.concatenate([[0], *[first[r["file"]] + np.array(r["marks"], np.int64) for r in rows if r["marks"]]]).astype(np.int64)
    mass = np.concatenate([[0], *[np.full(len(r["marks"]), r["mass"] / MARKS) for r in rows if r["marks"]]])
    total = np.cumsum(mass)
    i = np.searchsorted(total, np.arange(1, files) * total[-1] / files)
    parents, n = np.unique(at[np.minimum(i, len(at) - 1)], return_counts=True)
    cuts = []
    for p, k in zip(parents.tolist(), n.tolist(), strict=True):
        cuts.append(p * base)
        cuts += [p * base + int(words[len(words) * j // k]) for j in range(1, k)]
    return np.unique(np.array(cuts, U64))


def learn(docs: DataFrame, text: str = "text", order: int = ORDER, least: int = LEAST) -> Model:
    spark = docs.sparkSession
    folder = shared.local(shared.folder(spark, "ngrams"))
    docs = docs.select(text)
    size = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = max(shared.partitions(spark), min(1 << 16, -(-size // FILE_BYTES)))

    def count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[np.ndarray]:
            for b in pieces(batches, text, SLICE):
                bounds, h = tokens(b.column(text))
                yield np.delete(h, bounds[:-1])

        return tally(found(), lambda k: word_file(k, files))

    def keep_words(part: pa.Table) -> pa.Table:
        f, keys, counts = gathered(part)
        elias_fano.save(f"{folder}/words-{f}", {"hash": keys, "count": narrow(counts)})
        return stats(f, counts, [])

    rows = collected(docs, count_words, keep_words)
    for f in set(range(files)) - {r["file"] for r in rows}:
        elias_fano.save(f"{folder}/words-{f}", {"hash": np.zeros(0, U64), "count": np.zeros(0, np.uint32)})
    first = starts(rows, files)
    m = Model(folder, files, first, sum(r["mass"] for r in rows), sum(r["nodes"] for r in rows), ())
    words = np.concatenate([[0], *[first[r["file"]] + np.array(r["marks"], np.int64) for r in rows]]).astype(np.int64)
    parents = m.v
    for n in range(2, order + 1):
        files = max(shared.partitions(spark), -(-m.n // FILE_TOKENS))
        m.room_for(parents)
        cuts = dealt(rows, first, files, words, m.base)
        rows, first, level = grow(docs, m, n, cuts, parents, text, least)
        m = m._replace(levels=(*m.levels, level))
        parents = int(sum(r["nodes"] for r in rows))
    for path in glob.glob(f"{folder}/counts*"):
        os.remove(path)
    return m


def collected(docs: DataFrame, count: Callable, keep: Callable) -> list:
    """A row of stats for each file, once what count makes of all documents has met there."""
    with shared.settings(docs.sparkSession, shared.TIDY):
        rows = docs.mapInArrow(count, "file int, keys binary, counts binary").groupBy("file").applyInArrow(keep, STATS).collect()
    return sorted(rows, key=lambda r: r["file"])


def starts(rows: list, files: int) -> np.ndarray:
    n = np.zeros(files + 1, np.int64)
    for r in rows:
        n[r["file"] + 1] = r["nodes"]
    return np.cumsum(n)[:-1]


def grow(docs: DataFrame, m: Model, n: int, cuts: np.ndarray, parents: int, text: str, least: int) -> tuple[list, np.ndarray, Level]:
    """Count level n, keep its nodes, and write its files."""
    spark: SparkSession = docs.sparkSession
    folder = m.path

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def found() -> Iterator[np.ndarray]:
            for b in pieces(batches, text, SLICE):
                bounds, h = tokens(b.column(text))
                ids = known_ids(m, h)[0]
                parent = np.full(len(ids), -1, np.int64)
                parent[1:] = ids[:-1]
                parent[bounds[:-1]] = -1
                node, word = parent, ids
                for level in range(2, n):  # the node of the context, one word longer each time
                    here, _, _ = look_up(m, level, node, word)
                    node = np.full(len(ids), -1, np.int64)
                    node[1:] = here[:-1]
                    node[bounds[:-1]] = -1
                    node[here < 0] = -1  # a kept n-gram has a kept end
                ok = node >= 0
                yield m.keys(node[ok], word[ok])

        return tally(found(), lambda k: np.searchsorted(cuts, k, "right"))

    def span_of(f: int) -> tuple[int, int]:
        """The parents that a file may have nodes of."""
        low = int(cuts[f - 1]) // m.base if f else 0
        return low, min(parents, int(cuts[f]) // m.base + 1) if f < len(cuts) else parents

    def put_nodes(f: int, keys: np.ndarray, counts: np.ndarray) -> None:
        low, high = span_of(f)
        size = np.bincount(m.parts(keys)[0] - low, minlength=high - low)
        start = narrow(np.concatenate([[0], np.cumsum(size)]))
        words = elias_fano.encode(keys - U64(low * m.base), max(1, high - low) * m.base)
        elias_fano.save(f"{folder}/nodes{n}-{f}", {"start": start, "low": np.array([low])} | {f"words.{a}": v for a, v in words.items()})
        elias_fano.save(f"{folder}/counts{n}-{f}", {"count": narrow(counts)})

    def keep(part: pa.Table) -> pa.Table:
        f, keys, counts = gathered(part)
        keys, counts = keys[counts >= least], counts[counts >= least]
        put_nodes(f, keys, counts)
        own, edges = m.parts(keys)[0], []
        for p in {int(own[0]), int(own[-1])} if len(own) else ():
            edges += [p, int((own == p).sum()), int(counts[own == p].sum())]
        return stats(f, counts, edges)

    rows = collected(docs, count, keep)
    files = len(cuts) + 1
    first = starts(rows, files)
    have = {r["file"] for r in rows}
    # a parent that a cut goes through: what its files kept, together
    shares: dict[int, list[int]] = {int(c) // m.base: [0, 0] for c in cuts if int(c) % m.base}
    for r in rows:
        for p, k, c in zip(*[iter(r["edges"])] * 3, strict=True):
            if p in shares:
                shares[p][0] += k
                shares[p][1] += c
    split_total = {p: int(parent_counts(m, n, np.array([p]))[0]) for p in shares}
    weight = {p: (split_total[p] - c + DISCOUNT * k) / max(1, split_total[p]) for p, (k, c) in shares.items()}

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for f in b.column("id").to_pylist():
                low, high = span_of(f)
                if f not in have:
                    put_nodes(f, np.zeros(0, U64), np.zeros(0, np.int64))
                own, word = m.parts(node_keys(folder, n, f, m.base))
                counts = elias_fano.load(f"{folder}/counts{n}-{f}")["count"].astype(np.int64)
                total = np.maximum(parent_counts(m, n, np.arange(low, high)), 1)
                k, c = np.bincount(own - low, minlength=high - low), np.bincount(own - low, counts, high - low)
                lam = (total - c + DISCOUNT * k) / total
                for p, w in weight.items():
                    if low <= p < high:
                        lam[p - low] = w
                prob = (counts - DISCOUNT) / total[own - low] + lam[own - low] * lower(m, n, own, word)
                elias_fano.save(f"{folder}/weights{n}-{f}", {"prob": quantise(prob), "back": quantise(lam)})
            yield b

    spark.range(0, files, 1, min(files, 4 * shared.partitions(spark))).mapInArrow(write, "id long").count()
    return rows, first, Level(first, cuts, parents, {p: int(quantise(np.array([w]))[0]) for p, w in weight.items()})


def parent_counts(m: Model, n: int, parents: np.ndarray) -> np.ndarray:
    """How often the parents of level n occur (sorted ids of words, or of nodes of level n - 1)."""
    return word_counts(m, parents) if n == 2 else node_values(m, n - 1, parents, "count")


def node_keys(path: str, n: int, f: int, base: int, at: np.ndarray | None = None) -> np.ndarray:
    """parent * base + word of nodes of a file, by their places in it, or of all."""
    held = elias_fano.load(f"{path}/nodes{n}-{f}")
    words = EliasFano(held, "words")
    return words.get(np.arange(words.n) if at is None else at) + U64(int(held["low"][0]) * base)


def node_values(m: Model, n: int, nodes: np.ndarray, name: str) -> np.ndarray:
    """Counts, or last words, of sorted nodes."""
    out, first = np.zeros(len(nodes), np.int64), m.levels[n - 2].first
    for f, at in ranges(np.searchsorted(first, nodes, "right") - 1):
        here = nodes[at] - first[f]
        out[at] = elias_fano.load(f"{m.path}/counts{n}-{f}")["count"][here] if name == "count" else m.parts(node_keys(m.path, n, f, m.base, here))[1]
    return out


def lower(m: Model, n: int, parent: np.ndarray, word: np.ndarray) -> np.ndarray:
    """The probability of the words in the contexts without their first word."""
    if n == 2:
        ids, back = distinct_ids(word)
        return ((word_counts(m, ids) + 1) / (m.n + m.v + 1))[back]
    ids, back = distinct_ids(parent)
    shorter = node_values(m, n - 1, ids, "word")[back]  # of (a, b): b
    if n > 3:
        raise ValueError("at most three words")
    return 10 ** (-score_from(m, 2, [shorter], word) / STEP)


def distinct_ids(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids (none negative) in rising order, and of each its place among them."""
    keys, back = distinct(ids.astype(U64))
    return keys.astype(np.int64), back


def known_ids(m: Model, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    keys, back = distinct(h)
    ids, counts = word_ids(m, keys)
    return ids[back], counts[back]


def score_from(m: Model, n: int, contexts: list[np.ndarray], word: np.ndarray, counts: np.ndarray | None = None) -> np.ndarray:
    """Quantised minus log10 probability of words after contexts[k] (the node of their last k + 1 words, or -1)."""
    if counts is None:
        ids, back = distinct_ids(word)
        counts = word_counts(m, ids)[back]
    out = quantise((counts + 1) / (m.n + m.v + 1)).astype(np.int64)
    for k in range(min(n - 1, len(contexts))):
        node, prob, weight = look_up(m, k + 2, contexts[k], word)
        out = np.where(node >= 0, prob, out + weight)
    return out


def score(docs: DataFrame, m: Model, text: str = "text") -> DataFrame:
    """docs with n_tokens, n_known, base_score, score; columns of those names are replaced."""
    new = ["n_tokens", "n_known", "base_score", "score"]
    keep = [c for c in docs.columns if c not in new]
    sent = docs.sparkSession.sparkContext.broadcast(m)  # a few numbers a file

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for b in pieces(batches, text, SLICE):
            bounds, h = tokens(b.column(text))
            ids, counts = known_ids(m, h)
            out = quantise((counts + 1) / (m.n + m.v + 1)).astype(np.int64)
            context = np.full(len(ids), -1, np.int64)
            context[1:] = ids[:-1]
            context[bounds[:-1]] = -1
            for level in range(2, len(m.levels) + 2):
                node, prob, weight = look_up(m, level, context, ids)
                out = np.where(node >= 0, prob, out + weight)
                context = np.full(len(ids), -1, np.int64)
                context[1:] = node[:-1]
                context[bounds[:-1]] = -1
            scored = np.ones(len(ids), bool)
            scored[bounds[:-1]] = False
            n = np.diff(bounds) - 1
            ends = np.concatenate([[0], np.cumsum(n)])
            base = np.add.reduceat(np.log10((counts[scored] + 1) / (m.n + m.v + 1)), ends[:-1])
            known, sums = (np.add.reduceat(x, ends[:-1]) for x in ((counts[scored] > 0).astype(np.int64), out[scored]))
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64()), pa.array(known), pa.array(base), pa.array(-sums / STEP)], [*keep, *new])

    schema = docs.select(*keep).withColumns({"n_tokens": F.lit(0).cast("long"), "n_known": F.lit(0).cast("long"), "base_score": F.lit(0.0), "score": F.lit(0.0)}).schema
    return docs.select(*keep).mapInArrow(run, schema)


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", folds: int = 7, held: int = 2, least: int = LEAST) -> DataFrame:
    """key, held_out, n_tokens, n_known, train_tokens, base_score, score of every row; rows
    whose crc32 of the id as text mod folds is `held` are not learned from."""
    out = F.coalesce(F.crc32(F.col(key).cast("string")) % folds == held, F.lit(False))
    m = learn(docs.where(~out), text, least=least)
    return score(docs.select(key, text), m, text).select(key, out.alias("held_out"), "n_tokens", "n_known", F.lit(m.n).cast("long").alias("train_tokens"), "base_score", "score")
