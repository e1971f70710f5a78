"""MinHash near-dedup by HyperMinHash: documents whose 2-word shingle sets are 80 % alike.

Words are lower-cased (A-Z) runs without white space; a document of fewer words has its whole
sequence as one shingle, one without words none. Two documents link when
100 * common >= 80 * all shingles of both.

A shingle's hash names one of REGISTERS buckets by its upper bits; of the least rest in a bucket
a register keeps the number of leading zeros (4 bits, at most 15) and the next MANTISSA bits: a byte.
An empty register borrows from the first filled one in an order of its own, fixed by hashes,
so two registers agree as often as the sets are alike, in small sets too.

1. Documents of one set are one class, aggregated before anything meets.
2. Each BAND registers in a row make a key, KEYS of them in all, so linked classes share none of the
   keys with a chance of (1 - 0.8^BAND)^KEYS at most, 8e-6.
3. Of the first classes of its buckets each class meets the one it shares most keys with. The share of
   agreeing registers, corrected for registers that agree by accident, estimates the Jaccard coefficient;
   where it is within SIGMAS deviations of the threshold, and parity maps of PARITY bits a shingle do not rule a
   link out (they differ in no more bits than the sets in shingles), the full sets are compared. That gives components.
4. In buckets of more than SPLIT rows and several components, classes meet one other of their bucket, again
   and again as long as that links a MERGE-th of them.
5. Registers of the classes in buckets of several components go to these buckets, where classes of
   different components and of like size are estimated, each pair at the first key it shares; the sets of
   those within SIGMAS deviations are compared (true links are missed with a chance of 3e-5 at the very
   threshold). Buckets that still have more than SPLIT rows are split by further keys in common, again and again until
   they are small; there, two linked classes need several of their keys in common.
Pairs that never meet are in one component already, so components are those of all links found.

A bucket's first row, size and components are aggregates that are joined to its rows, a join whose
large keys Spark deals out; no bucket is brought together. Hashes have 64 bits. Rows without an id
link with nothing, have a null component and are kept; rows that share an id are one node. Equal texts link
unless they have no words. Texts of any length and other columns of any name are fine. Empty
tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared
from .links import components
from .shingle_join import blobs, differing, parity_maps, shingle_sets, verified
from .words import U64, pieces, release, splitmix

WORDS, SHARE = 2, 80
REGISTERS, MANTISSA, BAND, KEYS, SIGMAS = 1024, 4, 8, 64, 4
MERGE = 5  # while at least one of so many classes in large buckets finds a link, they meet again
SPLIT = 4096  # rows of a bucket of several components from which on it is split by further keys
PARITY = 4
FEW = 32  # filled registers up to which all of them are looked at for each empty one
_REST = 64 - REGISTERS.bit_length() + 1  # bits of a hash below the bucket's
_ORDER = np.argsort(splitmix(np.arange(REGISTERS * REGISTERS, dtype=U64) + U64(1 << 44)).reshape(REGISTERS, REGISTERS), axis=1).astype(np.int16)
_PLACE = np.argsort(_ORDER, axis=1).astype(np.int16)


def zeros_and_mantissa(rest: np.ndarray) -> np.ndarray:
    """Leading zeros of the lower bits of a hash, and the bits behind its leading one."""
    bits = min(_REST, 53)
    part, length = np.frexp((rest >> U64(_REST - bits)).astype(np.float64))
    return (np.minimum(bits - length, 15).astype(np.uint8) << np.uint8(MANTISSA)) | ((2 * part - 1).clip(0) * (1 << MANTISSA)).astype(np.uint8)


def lenders(filled: np.ndarray) -> np.ndarray:
    """For each empty register the filled one that comes first in its order."""
    own, none = np.flatnonzero(filled), np.flatnonzero(~filled)
    if len(own) <= FEW:
        return own[_PLACE[none[:, None], own].argmin(1)]
    out, left, step = np.empty(len(none), np.int64), np.arange(len(none)), 0
    while len(left):
        at = _ORDER[none[left], step]
        hit = filled[at]
        out[left[hit]] = at[hit]
        left, step = left[~hit], step + 1
    return out


def registers(ends: np.ndarray, found: np.ndarray) -> np.ndarray:
    """A row of registers for each set, given as bounds and hashes in rising order."""
    n = len(ends) - 1
    cell = np.repeat(np.arange(n, dtype=np.int64) * REGISTERS, np.diff(ends)) + (found >> U64(_REST)).astype(np.int64)
    new = np.ones(len(cell), bool)
    new[1:] = cell[1:] != cell[:-1]  # the least hash of a bucket comes first
    out, filled = np.zeros(n * REGISTERS, np.uint8), np.zeros(n * REGISTERS, bool)
    out[cell[new]] = zeros_and_mantissa(found[new] & U64((1 << _REST) - 1))
    filled[cell[new]] = True
    out, filled = out.reshape(n, REGISTERS), filled.reshape(n, REGISTERS)
    for d in np.flatnonzero(filled.any(1) & ~filled.all(1)):
        out[d, ~filled[d]] = out[d, lenders(filled[d])]
    return out


def accidental(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The chance that a register of two sets of n and m shingles without a common one agrees. In a cell of width w
    at x the least of n is with density n e^(-nx) w; cells of one count of zeros are summed as an integral."""
    n, m = (np.maximum(1.0, v / REGISTERS) for v in (n, m))
    level = np.arange(16)[:, None]
    low = np.where(level < 15, np.exp2(-(level + 1.0)), 0)  # the last count stands for all further ones
    width = np.exp2(-(level + 1.0 + MANTISSA))
    return (n * m * width / (n + m) * (np.exp(-(n + m) * low) - np.exp(-(n + m) * np.exp2(-1.0 * level)))).sum(0)


def estimated(agree: np.ndarray, n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """The Jaccard coefficient that a share of agreeing registers stands for."""
    chance = accidental(n, m)
    return (agree - chance) / (1 - chance)


def signatures(docs: DataFrame) -> DataFrame:
    """id, n, a, b (hashes of the set), regs, map of docs (id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            for at in range(0, batch.num_rows, 1024):
                part = batch.slice(at, 1024)
                ends, found = shingle_sets(part.column("text"), WORDS)
                total = lambda x: pa.array(splitmix(np.diff(np.concatenate([np.zeros(1, U64), np.cumsum(x, dtype=U64)])[ends])).view(np.int64))  # noqa: B023, E731
                regs = registers(ends, found)
                yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(np.diff(ends), pa.int64()), total(splitmix(found)), total(splitmix(found ^ U64(1 << 42))), blobs(regs.ravel(), np.arange(len(regs) + 1) * REGISTERS), parity_maps(ends, found, PARITY)], ["id", "n", "a", "b", "regs", "map"])

    return docs.mapInArrow(run, f"id {docs.schema['id'].dataType.simpleString()}, n long, a long, b long, regs binary, map binary")


def rows_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, REGISTERS)


def bands(regs: np.ndarray) -> np.ndarray:
    """The registers of each band, as a number."""
    return np.ascontiguousarray(regs[:, : KEYS * BAND]).view(np.dtype(f"u{BAND}"))


def keys(regs: np.ndarray) -> np.ndarray:
    """A key for each band."""
    return splitmix(bands(regs) ^ splitmix(np.arange(KEYS, dtype=U64) + U64(1 << 45)))


def banded(members: DataFrame) -> DataFrame:
    """tok, at (the band), rep, n: a row for each key of members (rep, n, regs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "regs", 1 << 20):
            row = pa.array(np.repeat(np.arange(b.num_rows), KEYS))
            yield pa.RecordBatch.from_arrays([pa.array(keys(rows_of(b.column("regs"))).view(np.int64).ravel()), pa.array(np.tile(np.arange(KEYS, dtype=np.int32), b.num_rows)), b.column("rep").take(row), b.column("n").take(row)], ["tok", "at", "rep", "n"])
        release()

    return members.select("rep", "n", "regs").mapInArrow(run, "tok long, at int, rep long, n long")


def like(nx: Column, ny: Column, share: int) -> Column:
    return (100 * nx >= share * ny) & (100 * ny >= share * nx)


def within(share: int) -> float:
    """The least estimate of two sets that may link."""
    j = share / 100
    return j - SIGMAS * (j * (1 - j) / REGISTERS) ** 0.5


def may_link(a: pa.Array, b: pa.Array, n: np.ndarray, m: np.ndarray, share: int) -> np.ndarray:
    """Whether parity maps allow that sets of n and m shingles link: true of all that do."""
    return (100 + share) * differing(a, b) <= (100 - share) * (n + m)


def near(pairs: DataFrame, members: DataFrame, share: int) -> DataFrame:
    """Those of the distinct pairs x, y (few of each y) whose registers allow a link."""
    x, y = (members.select(F.col("rep").alias(s), *[F.col(c).alias(f"{c}{s}") for c in ("n", "regs", "map")]) for s in "xy")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "regsx", 1 << 20):
            same = (rows_of(b.column("regsx")) == rows_of(b.column("regsy"))).mean(1)
            nx, ny = b.column("nx").to_numpy(), b.column("ny").to_numpy()
            hit = pa.array((estimated(same, nx, ny) >= within(share)) & may_link(b.column("mapx"), b.column("mapy"), nx, ny, share))
            yield pa.RecordBatch.from_arrays([b.column("x").filter(hit), b.column("y").filter(hit)], ["x", "y"])

    met = pairs.join(x, "x").join(y, "y").where(like(F.col("nx"), F.col("ny"), share))
    return met.select("x", "y", "nx", "ny", "regsx", "regsy", "mapx", "mapy").mapInArrow(measure, "x long, y long")


def met(rows: DataFrame, members: DataFrame, share: int) -> DataFrame:
    """x, y of different components and of like size in one bucket whose registers allow a link. rows: tok, at, deep, rep, n, c of
    buckets of bounded size; deep: whether the bucket is one of several keys. Registers go to the buckets, and pairs
    are made where they are compared; a pair is made at the first key that it shares."""

    def pairs(rep: np.ndarray, n: np.ndarray, c: np.ndarray, regs: np.ndarray, maps: pa.Array, at: int, deep: bool) -> Iterator[tuple]:
        band = bands(regs)
        for i in range(len(rep) - 1):
            j = i + 1 + np.flatnonzero((c[i + 1 :] != c[i]) & (100 * n[i + 1 :] >= share * n[i]) & (100 * n[i] >= share * n[i + 1 :]))
            if not deep and len(j):
                j = j[(band[j] == band[i]).argmax(1) == at]
            if len(j):
                j = j[estimated((regs[j] == regs[i]).mean(1), np.full(len(j), n[i]), n[j]) >= within(share)]
            if len(j):
                j = j[may_link(maps.take(pa.array(np.full(len(j), i))), maps.take(pa.array(j)), n[i], n[j], share)]
            for k in j.tolist():
                yield (int(rep[i]), int(rep[k])) if rep[i] < rep[k] else (int(rep[k]), int(rep[i]))

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in pieces(batches, "regs", 1 << 20):
            both = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            tok = both.column("tok").to_numpy()
            ends = np.flatnonzero(tok[1:] != tok[:-1]) + 1  # the last bucket may go on in the next batch
            last = int(ends[-1]) if len(ends) else 0
            yield found(both.slice(0, last), np.concatenate([[0], ends]))
            held = both.slice(last).combine_chunks().to_batches()[0]
        if held is not None:
            yield found(pa.Table.from_batches([held]), np.array([0, held.num_rows]))

    def found(table: pa.Table, ends: np.ndarray) -> pa.RecordBatch:
        out: list[tuple] = []
        rep, n, c, at, deep = (table.column(x).to_numpy() for x in ("rep", "n", "c", "at", "deep"))
        for a, z in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            out += pairs(rep[a:z], n[a:z], c[a:z], rows_of(table.column("regs").slice(a, z - a)), table.column("map").slice(a, z - a).combine_chunks(), int(at[a]), bool(deep[a]))
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["x", "y"])

    dealt = rows.join(members.select("rep", "n", "regs", "map"), ["rep", "n"]).select("tok", "at", "deep", "rep", "n", "c", "regs", "map")
    dealt = dealt.repartition(shared.partitions(rows.sparkSession), "tok").sortWithinPartitions("tok", "rep")
    return dealt.mapInArrow(compare, "x long, y long").distinct()


def mixed(rows: DataFrame, split: int) -> DataFrame:
    """Of rows (tok, at, rep, n, c) those of buckets with several components, with hot: whether the bucket has more than `split` rows."""
    per = rows.groupBy("tok").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("size")).where("c0 < c1")
    return shared.table(rows.join(per.select("tok", (F.col("size") > split).alias("hot")), "tok"), "mixed")


def alike(docs: DataFrame, key: str = "doc_id", text: str = "text", share: int = SHARE, split: int = SPLIT) -> DataFrame:
    """key, n_shingles, component_id (the smallest id that links reach), kept (key = component_id) of every row."""
    with shared.temporary(docs.sparkSession) as keep:
        return keep(shared.table(_alike(docs.select(key, text), key, text, share, split), "components"))


def _alike(docs: DataFrame, key: str, text: str, share: int, split: int) -> DataFrame:
    rows = shared.table(signatures(docs.select(F.col(key).alias("id"), F.col(text).alias("text"))), "signatures")
    linked = F.col("id").isNotNull() & (F.col("n") > 0)
    some = rows.where(linked)
    members = shared.table(some.groupBy("n", "a", "b").agg(F.min("id").cast("long").alias("rep"), F.first("regs").alias("regs"), F.first("map").alias("map")), "members")
    whole, rows = rows, shared.table(rows.select("id", "n", "a", "b"), "rows")
    shared.drop(whole)
    index = shared.table(banded(members), "index")
    first = index.groupBy("tok").agg(F.count("*").alias("m"), F.min(F.struct("rep", "n")).alias("first")).where("m > 1")
    buckets = index.join(first.select("tok", F.col("first.rep").alias("first"), F.col("first.n").alias("first_n")), "tok")
    last, buckets = index, shared.table(buckets, "buckets")
    shared.drop(last)

    star = buckets.where((F.col("rep") != F.col("first")) & like(F.col("n"), F.col("first_n"), share)).groupBy(F.col("first").alias("x"), F.col("rep").alias("y")).count()
    nearest = star.groupBy("y").agg(F.min_by("x", F.struct(-F.col("count"), F.col("x"))).alias("x"))
    links = verified(docs, near(nearest, members, share).select("x", "y"), key, text, share, WORDS)
    # rows that share an id are one node
    own = rows.where(linked).join(members.select("n", "a", "b", "rep"), ["n", "a", "b"])
    twice = own.groupBy("id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y")
    links = links.unionByName(own.join(twice.select("id", "x"), "id").select("x", F.col("rep").alias("y")).where("x <> y"))
    known = components(links)

    def several(known: DataFrame) -> DataFrame:
        placed = buckets.select("tok", "at", "rep", "n").join(known.withColumnRenamed("node", "rep"), "rep", "left")
        return mixed(placed.select("tok", "at", "rep", "n", F.coalesce("component", "rep").alias("c")), split)

    at, turn = several(known), 0
    while (many := at.where("hot").select("rep").distinct().count()) > 0:  # large buckets: all meet another one of their bucket each time, while that links many
        hot = at.where("hot")
        lead = hot.groupBy("tok").agg(F.min_by(F.struct("rep", "n", "c"), F.xxhash64("rep", F.lit(turn))).alias("lead"))
        star = hot.join(lead, "tok").where((F.col("c") != F.col("lead.c")) & like(F.col("n"), F.col("lead.n"), share))
        star = star.groupBy(F.col("lead.rep").alias("x"), F.col("rep").alias("y")).count()
        nearest = star.groupBy("y").agg(F.min_by("x", F.struct(-F.col("count"), F.col("x"))).alias("x"))
        new = verified(docs, near(nearest, members, share).select("x", "y"), key, text, share, WORDS)
        if (found := new.count()) > 0:
            known = components(known.select(F.col("component").alias("x"), F.col("node").alias("y")).unionByName(new))
            shared.drop(at)
            at = several(known)
        if found * MERGE < many:
            break
        turn += 1
    cold = at.where("NOT hot").withColumn("deep", F.lit(False))
    while not (hot := at.where("hot")).isEmpty():
        further = banded(members.join(hot.select("rep").distinct(), "rep", "left_semi")).select(F.col("tok").alias("_tok"), F.col("at").alias("_at"), F.col("rep").alias("_rep"))
        deeper = hot.join(further, (F.col("rep") == F.col("_rep")) & (F.col("at") < F.col("_at")))
        at = mixed(deeper.select(F.xxhash64("tok", "_tok").alias("tok"), F.col("_at").alias("at"), "rep", "n", "c"), split)
        cold = cold.unionByName(at.where("NOT hot").withColumn("deep", F.lit(True)))
    met_ = shared.table(met(cold, members, share), "met")
    more = verified(docs, met_, key, text, share, WORDS)
    final = known if more.isEmpty() else components(known.select(F.col("component").alias("x"), F.col("node").alias("y")).unionByName(more))
    final = members.select("n", "a", "b", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("n", "a", "b", F.coalesce("component", "rep").alias("component_id"))
    found = rows.where(linked).join(final, ["n", "a", "b"]).select("id", "n", "component_id")
    alone = rows.where(~linked).select("id", "n", F.col("id").cast("long").alias("component_id"))
    out = found.unionByName(alone).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")
    return out.withColumn("kept", F.col(key).eqNullSafe(F.col("component_id")))
