"""N-gram Jaccard join: documents whose 5-word shingle sets are 80 % alike.

Words are lower-cased (A-Z) runs without white space; a document of fewer words
has its whole sequence as one shingle, one without words none. Two documents
link when 100 * common >= 80 * all shingles of both.

Grouped prefix join. Shingles are ordered by how common they are (counts over
all documents, in a table of bounded size) and then by hash; two sets that link
share a shingle among the first n - ceil(0.8 n) + 1 of each, and if they are not
the same set a second one among one more. Documents with the same set are one
class; classes with the same prefix and size are one group, and only groups
enter the index. Links are then found in two rounds, so that large groups of
near copies never meet pair by pair:
1. in each bucket of the index every group is paired with the bucket's first
   one, and every class with its group's first. Of the pairs that the filters
   leave, each group takes its nearest; what the sets verify gives components;
2. buckets are expanded to classes, those of one component drop out, and only
   pairs of different components and of like size remain. Buckets of more than
   SPLIT rows are split by the second shingle that linked sets have in common.
Pairs that are never compared are in one component already, so the components
are those of all links.

Before sets are compared, pairs pass an exact filter: a set's parity map has
about a bit a shingle, and the maps of two sets differ in at most as many bits
as the sets in shingles, which linked sets do in a ninth of all at most. Maps
are an eightieth of the sets. Sets are compared exactly, by 64-bit hashes.

Copies are one class, so a hot class is aggregated before any shuffle. Where the
table of counts says that a shingle may be in more than HOT rows of the index, they
are counted, and one that is in more is dealt under several keys; what all of them
need is aggregated and sent to each. Rows
without an id link with nothing and have a null component; rows that share an
id are one node of the graph. Empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared, sketches
from .links import components
from .words import U64, hashes, inside, pieces, release, runs, split, splitmix

WORDS, SHARE = 5, 80
PAIRS = 256  # of one x that meet in one place; an x of more is compared in several
HOT = 256  # rows of a bucket from which on it is dealt under several keys
SPLIT = 1024  # rows of a bucket of several components from which on it is split by a second shingle


def shingle_sets(texts: pa.Array, k: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Bounds of each text's set, and all sets' hashes, each set in rising order."""
    words = split(texts, lower=True)
    h, n = hashes(words), np.diff(words.docs)
    keep, count = inside(words.docs, k)
    found, doc = [runs(h, k)[keep]], [np.repeat(np.arange(len(n)), count)]
    for few in range(1, k):
        own = np.flatnonzero(n == few)
        if len(own):
            found.append(runs(h[(words.docs[own][:, None] + np.arange(few)).ravel()], few)[::few])
            doc.append(own)
    found, doc = np.concatenate(found), np.concatenate(doc)
    order = np.argsort(found)
    order = order[np.argsort(doc[order].astype(np.uint32), kind="stable")]
    found, doc = found[order], doc[order]
    new = np.ones(len(found), bool)
    new[1:] = (found[1:] != found[:-1]) | (doc[1:] != doc[:-1])
    return np.searchsorted(doc[new], np.arange(len(n) + 1)), found[new]


def blobs(values: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Consecutive ranges of 64-bit values (or bytes) as binaries."""
    return pa.Array.from_buffers(pa.large_binary(), len(ends) - 1, [None, pa.py_buffer((ends * values.itemsize).astype(np.int64)), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def parity_maps(ends: np.ndarray, found: np.ndarray, per: int = 1) -> pa.Array:
    """Of each set: bit i tells whether an odd number of its shingles falls on i, by their low
    bits. A map has the least power of two of bits that holds `per` bits a shingle, 64 at least."""
    n = np.diff(ends)
    size = np.left_shift(1, np.maximum(6, np.ceil(np.log2(np.maximum(per * n, 1))).astype(np.int64)))
    begin = np.concatenate([[0], np.cumsum(size)])
    at = (splitmix(found) & (np.repeat(size, n) - 1).astype(U64)).astype(np.int64) + np.repeat(begin[:-1], n)
    odd = (np.bincount(at, minlength=int(begin[-1])) & 1).astype(np.uint8)
    return blobs(np.packbits(odd, bitorder="little"), begin // 8)


def differing(a: pa.Array, b: pa.Array) -> np.ndarray:
    """In how many bits the parity maps of each row differ; the longer map is folded."""
    out = np.empty(len(a), np.int64)
    for i, (x, y) in enumerate(zip(a, b, strict=True)):
        x, y = (np.frombuffer(v.as_buffer(), U64) for v in (x, y))
        while len(x) != len(y):
            if len(x) > len(y):
                x = x[: len(x) // 2] ^ x[len(x) // 2 :]
            else:
                y = y[: len(y) // 2] ^ y[len(y) // 2 :]
        out[i] = int(np.bitwise_count(x ^ y).sum())
    return out


def signatures(docs: DataFrame, common: np.ndarray, bits: int, key: str, text: str, share: int = SHARE) -> DataFrame:
    """id, n, a, b (hashes of the set), p (hash of the prefix), prefix (with one shingle more, in
    which a second one in common has to be), map of every document."""
    counts = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, "text"):
            ends, found = shingle_sets(batch.column("text"))
            n = np.diff(ends)
            doc = np.repeat(np.arange(len(n), dtype=np.uint32), n)
            rank = counts.value[sketches.cells(found, bits)].astype(U64) << U64(48) | found & U64((1 << 48) - 1)
            order = np.argsort(rank, kind="stable")
            order = order[np.argsort(doc[order], kind="stable")]
            length = np.where(n > 0, np.minimum(n, n - (share * n + 99) // 100 + 2), 0)
            front = found[order][np.arange(len(found)) - np.repeat(ends[:-1], n) < np.repeat(length, n)]
            cuts = np.concatenate([[0], np.cumsum(length)])

            def total(x: np.ndarray, at: np.ndarray) -> pa.Array:
                sums = np.concatenate([np.zeros(1, U64), np.cumsum(x, dtype=U64)])
                return pa.array(splitmix(sums[at[1:]] - sums[at[:-1]]).view(np.int64))

            made = [batch.column("id"), pa.array(n, pa.int64()), total(splitmix(found), ends), total(splitmix(found ^ U64(1 << 42)), ends), total(splitmix(front), cuts), blobs(front, cuts), parity_maps(ends, found)]
            yield pa.RecordBatch.from_arrays(made, ["id", "n", "a", "b", "p", "prefix", "map"])

    return docs.select(F.col(key).alias("id"), F.col(text).alias("text")).mapInArrow(run, f"id {docs.schema[key].dataType.simpleString()}, n long, a long, b long, p long, prefix binary, map binary")


def near(pairs: DataFrame, maps: DataFrame, share: int = SHARE) -> DataFrame:
    """x, y, far of the distinct pairs x, y whose parity maps allow a link. maps: rep, n, map."""
    left, right = (maps.select(F.col("rep").alias(s), F.col("n").alias(f"n{s}"), F.col("map").alias(f"map{s}")) for s in "xy")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            far = differing(b.column("mapx"), b.column("mapy"))
            # linked sets have at least share / (100 + share) of all their members in common
            hit = pa.array((100 + share) * far <= (100 - share) * (b.column("nx").to_numpy() + b.column("ny").to_numpy()))
            yield pa.RecordBatch.from_arrays([b.column("x").filter(hit), b.column("y").filter(hit), pa.array(far).filter(hit)], ["x", "y", "far"])

    sized = pairs.join(left, "x").join(right, "y").where((100 * F.col("nx") >= share * F.col("ny")) & (100 * F.col("ny") >= share * F.col("nx")))
    return sized.select("x", "y", "nx", "ny", "mapx", "mapy").mapInArrow(measure, "x long, y long, far long")


def verified(docs: DataFrame, pairs: DataFrame, key: str, text: str, share: int = SHARE, k: int = WORDS) -> DataFrame:
    """Those of the distinct pairs x, y whose sets (of k-word shingles) are alike. Texts go to their pairs, and sets are
    made where they are compared. The end of more pairs is x, so that no y has many; an x of many
    pairs is sent to as many places as they need, so one that a third of all rows are compared with
    is no hot task. Filters of fixed size keep out documents without pairs; what they let through
    besides meets nothing."""
    one = lambda s: pairs.groupBy(F.col(s).alias("e")).count()
    ends = one("x").unionByName(one("y")).groupBy("e").agg(F.sum("count").alias("count"))
    x_n, y_n = (ends.select(F.col("e").alias(s), F.col("count").alias(f"of_{s}")) for s in "xy")
    turn = F.struct("of_x", "x") < F.struct("of_y", "y")
    pick = lambda s, t: F.when(turn, F.col(t)).otherwise(F.col(s))
    pairs = pairs.join(x_n, "x").join(y_n, "y").select(pick("x", "y").alias("x"), pick("y", "x").alias("y"), F.ceil(pick("of_x", "of_y") / PAIRS).cast("int").alias("parts"))
    pairs = shared.table(pairs.distinct(), "pairs")
    named = lambda ids: splitmix(ids.to_numpy().astype(np.int64).view(U64))

    def among(end: str) -> Broadcast:
        return docs.sparkSession.sparkContext.broadcast(sketches.gather(pairs.select(end).distinct(), lambda b: iter([named(b.column(end))])))

    def chosen(end: str, wanted: Broadcast) -> DataFrame:  # only ids go to Python
        hit = F.arrow_udf(lambda ids: pa.array(wanted.value[sketches.cells(named(ids))] > 0), "boolean")
        return texts.where(hit(F.col(key).cast("long"))).select(F.col(key).cast("long").alias(end), F.col(text).alias("text"))

    texts = docs.where(F.col(key).isNotNull())
    in_x, in_y = among("x"), among("y")
    first = chosen("x", in_x).join(pairs.select("x", "parts").distinct(), "x").select("x", F.lit(None).cast("long").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "text")
    other = pairs.select("x", "y", F.pmod(F.xxhash64("y"), "parts").cast("int").alias("part")).join(chosen("y", in_y), "y").select("x", "y", "part", "text")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, own = None, []
        for b in pieces(batches, "text"):
            texts, hit = b.column("text"), []
            new = np.ones(len(texts), bool)  # a text of several rows together is split once
            new[1:] = pc.fill_null(pc.not_equal(texts[1:], texts[:-1]), True).to_numpy(zero_copy_only=False)
            bounds, found = shingle_sets(texts.filter(pa.array(new)), k)
            for x, y, part, i in zip(*(b.column(c).to_pylist() for c in ("x", "y", "part")), (np.cumsum(new) - 1).tolist(), strict=True):
                one = found[bounds[i] : bounds[i + 1]]
                if y is None:
                    at, own = (at, [*own, one]) if (x, part) == at else ((x, part), [one])
                    continue
                for s in own:
                    same = len(np.intersect1d(s, one, assume_unique=True))
                    if len(s) and 100 * same >= share * (len(s) + len(one) - same):
                        hit.append((x, y))
                        break
            yield pa.RecordBatch.from_arrays([pa.array([h[0] for h in hit], pa.int64()), pa.array([h[1] for h in hit], pa.int64())], ["x", "y"])

    # a pair's first text arrives before all that are compared with it
    dealt = first.unionByName(other).repartition(shared.partitions(docs.sparkSession), "x", "part").sortWithinPartitions("x", "part", F.col("y").asc_nulls_first())
    out = shared.table(dealt.mapInArrow(compare, "x long, y long").distinct(), "verified")
    shared.drop(pairs)
    return out


def real_parts(rows: DataFrame) -> DataFrame:
    """rows whose `parts` (above 1 where a token may be in more than HOT rows) come from the token's own number of rows.
    Only rows of such tokens are counted, and no row is copied for a count that was too high."""
    maybe = rows.where("parts > 1")
    hot = maybe.groupBy("tok").count().where(F.col("count") > HOT).select("tok", F.ceil(F.col("count") / HOT).cast("int").alias("real"))
    met = maybe.join(shared.table(hot, "hot"), "tok", "left").withColumn("parts", F.coalesce("real", F.lit(1))).select(*rows.columns)
    return rows.where("parts <= 1").unionByName(met)


def by_token(rows: DataFrame, made: dict[str, Column]) -> DataFrame:
    """rows (tok, parts, ...) with aggregates over all rows of their token. Tokens of one part
    meet in a window; those of more are aggregated and the result is sent to each of their parts."""
    cold = rows.where("parts <= 1").withColumns({k: c.over(Window.partitionBy("tok")) for k, c in made.items()})
    hot = rows.where("parts > 1").withColumn("part", F.pmod(F.xxhash64(*[c for c in rows.columns if c not in ("tok", "parts")]), "parts").cast("int"))
    sums = hot.groupBy("tok", "parts").agg(*[c.alias(k) for k, c in made.items()])
    sums = sums.select("tok", *made, F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    return cold.unionByName(hot.join(sums, ["tok", "part"]).select(*cold.columns))


def alike(docs: DataFrame, key: str = "doc_id", text: str = "text", share: int = SHARE) -> DataFrame:
    """key, n_shingles, component_id (the smallest id that links reach) of every row."""
    with shared.temporary(docs.sparkSession) as keep:
        return keep(shared.table(_alike(docs.select(key, text), key, text, share), "components"))


def _alike(docs: DataFrame, key: str, text: str, share: int) -> DataFrame:
    bits = sketches.bits_for(docs)
    common = sketches.gather(docs.select(F.col(text).alias("text")), lambda b: (shingle_sets(x.column("text"))[1] for x in pieces(iter([b]), "text")), bits)
    rows = shared.table(signatures(docs, common, bits, key, text, share), "signatures")
    linked = F.col("id").isNotNull() & (F.col("n") > 0)
    some = rows.where(linked)
    classes = some.groupBy("n", "a", "b").agg(F.min("id").alias("rep"), F.min("p").alias("p"), F.first("map").alias("map"))
    several = (F.min("a") < F.max("a")) | (F.min("b") < F.max("b"))  # classes
    groups = shared.table(some.groupBy("n", "p").agg(F.min("id").alias("gid"), F.first("prefix").alias("prefix"), several.alias("several")), "groups")
    members = shared.table(classes.join(groups.select("n", "p", "gid"), ["n", "p"]).select("gid", "rep", "n", "a", "b", "map"), "members")
    whole, rows = rows, shared.table(rows.select("id", "n", "a", "b"), "rows")
    shared.drop(whole)
    maps = members.select("rep", "n", "map")
    parts_of = np.maximum(1, np.ceil(sketches.count_of(np.arange(256, dtype=np.uint8)) / HOT)).clip(max=1 << 20).astype(np.int32)
    counts = docs.sparkSession.sparkContext.broadcast(common)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "prefix", 4 << 20):
            tok = np.frombuffer(b"".join(x.as_py() for x in b.column("prefix")), np.int64)
            size = np.array([len(x.as_buffer()) // 8 for x in b.column("prefix")], np.int64)
            row = np.repeat(np.arange(len(size)), size)
            pos = np.arange(len(tok)) - np.repeat(np.cumsum(size) - size, size)
            own = np.flatnonzero(pos < np.repeat((lambda n: n - (share * n + 99) // 100 + 1)(b.column("n").to_numpy()), size))
            tok, row, pos = tok[own], pa.array(row[own]), pos[own]
            parts = parts_of[counts.value[sketches.cells(tok.view(U64), bits)]]
            yield pa.RecordBatch.from_arrays([pa.array(tok), *(b.column(c).take(row) for c in ("gid", "n")), pa.array(pos, pa.int32()), b.column("several").take(row), pa.array(parts)], ["tok", "gid", "n", "pos", "several", "parts"])

    index = groups.select("gid", "n", "prefix", "several").mapInArrow(unpack, "tok long, gid long, n long, pos int, several boolean, parts int")
    full = parts_of[common.max()] > 1  # else no token can be in more than HOT rows
    index = by_token(real_parts(index) if full else index, {"m": F.count("*"), "leader": F.min(F.struct("gid", "n", "pos"))}).where("m > 1 or several and pos = 0")  # members of one group meet at its first shingle
    buckets = shared.table(index.select("tok", "gid", "n", "pos", F.col("leader.gid").alias("leader"), F.col("leader.n").alias("leader_n"), F.col("leader.pos").alias("leader_pos")), "buckets")

    # Before the first shingle that two sets have in common there is none, so what is left
    # of both has to hold all common ones. Other common shingles may fail this; the first may not.
    enough = lambda nx, px, ny, py: (100 + share) * F.least(nx - px, ny - py) >= share * (nx + ny)
    star = buckets.where((F.col("gid") != F.col("leader")) & enough(F.col("n"), F.col("pos"), F.col("leader_n"), F.col("leader_pos"))).select(F.col("leader").alias("x"), F.col("gid").alias("y")).distinct()
    nearest = near(star, maps, share).groupBy("y").agg(F.min_by("x", F.struct("far", "x")).alias("x"))
    inner = near(members.where("gid <> rep").select(F.col("gid").alias("x"), F.col("rep").alias("y")), maps, share)
    # verified reads its pairs several times: they are a table, so that they are measured once and its plans stay small
    pairs = shared.table(nearest.select("x", "y").unionByName(inner.select("x", "y")).distinct(), "near")
    links = verified(docs, pairs, key, text, share)
    shared.drop(pairs)
    # rows that share an id are one node
    own = rows.where(linked).join(members.select("n", "a", "b", "rep"), ["n", "a", "b"])
    twice = own.groupBy("id").agg(F.min("rep").alias("x"), F.max("rep").alias("y")).where("x < y")
    links = links.unionByName(own.join(twice.select("id", "x"), "id").select("x", F.col("rep").alias("y")).where("x <> y"))
    known = components(links)

    placed = members.join(known.withColumnRenamed("node", "rep"), "rep", "left").select("gid", "n", "rep", F.coalesce("component", "rep").alias("c"))
    at = buckets.select("tok", "gid", "n", "pos").join(placed, ["gid", "n"])
    per = at.groupBy("tok").agg(F.min("c").alias("c0"), F.max("c").alias("c1"), F.count("*").alias("size")).where("c0 < c1")
    at = at.join(shared.table(per.select("tok", "size"), "several"), "tok")
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(100 / share)) + 1e-9).cast("int")  # of linked sets these differ by 1 at most
    at = shared.table(at.select("tok", "gid", "rep", "n", "pos", "c", band.alias("band"), (F.col("size") > SPLIT).alias("hot")), "mixed")

    def seconds(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches, "prefix", 1 << 20):
            after = [np.frombuffer(x.as_buffer(), np.int64)[p + 1 :] for x, p in zip(b.column("prefix"), b.column("pos").to_pylist(), strict=True)]
            row = pa.array(np.repeat(np.arange(len(after)), [len(x) for x in after]))
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(row) for c in ("tok", "rep", "n", "pos", "c", "band")), pa.array(np.concatenate([*after, np.zeros(0, np.int64)]))], ["tok", "rep", "n", "pos", "c", "band", "tok2"])

    hot = at.where("hot").join(groups.select("gid", "n", "prefix"), ["gid", "n"]).select("tok", "rep", "n", "pos", "c", "band", "prefix")
    hot = hot.mapInArrow(seconds, "tok long, rep long, n long, pos int, c long, band int, tok2 long")
    cold = at.where("not hot").select("tok", "rep", "n", "pos", "c", "band", F.lit(0).cast("long").alias("tok2"))
    at = cold.unionByName(hot)
    x, y = (at.select("tok", "tok2", F.col("band").alias(f"band{s}"), *[F.col(c).alias(f"{c}{s}") for c in ("rep", "n", "pos", "c")]) for s in "xy")
    like = (100 * F.col("nx") >= share * F.col("ny")) & (100 * F.col("ny") >= share * F.col("nx"))
    apart = (F.col("cx") != F.col("cy")) & like & enough(F.col("nx"), F.col("posx"), F.col("ny"), F.col("posy"))
    same = ["tok", "tok2"]
    met = x.withColumn("band", F.col("bandx")).join(y.withColumn("band", F.col("bandy")), [*same, "band"]).where(apart & (F.col("repx") < F.col("repy")))
    met = met.unionByName(x.withColumn("band", F.col("bandx") + 1).join(y.withColumn("band", F.col("bandy")), [*same, "band"]).where(apart))
    met = near(met.select(F.least("repx", "repy").alias("x"), F.greatest("repx", "repy").alias("y")).distinct(), maps, share)
    pairs = shared.table(met.select("x", "y"), "near")
    more = verified(docs, pairs, key, text, share)
    shared.drop(pairs)
    if more.isEmpty():
        final = known
    else:
        final = components(known.select(F.col("component").alias("x"), F.col("node").alias("y")).unionByName(more))
    final = members.select("n", "a", "b", "rep").join(final.withColumnRenamed("node", "rep"), "rep", "left").select("n", "a", "b", F.coalesce("component", "rep").alias("component_id"))
    found = rows.where(linked).join(final, ["n", "a", "b"])
    alone = rows.where(~linked).select("id", "n", F.col("id").alias("component_id"))
    return found.select("id", "n", "component_id").unionByName(alone).select(F.col("id").alias(key), F.col("n").alias("n_shingles"), "component_id")


def keep_first(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one row of each component: that of its smallest id and, among rows that share
    this id, of the least text by hash. Rows without an id or without words stay."""
    found = alike(docs, key, text).where(F.col(key).isNotNull() & (F.col("n_shingles") > 0)).select(key, "component_id")
    gone = found.where(F.col(key) != F.col("component_id")).select(key).distinct()
    linked = F.col(key).isNotNull() & F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    left = docs.where(linked).join(gone, key, "left_anti")
    twice = shared.table(found.where(F.col(key) == F.col("component_id")).groupBy(key).count().where("count > 1").select(key), "twice")
    if not twice.isEmpty():
        one = left.join(twice, key, "left_semi").groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*docs.columns), F.xxhash64(text)).alias("_row"))
        left = left.join(twice, key, "left_anti").unionByName(one.select("_row.*"))
    return left.select(*docs.columns).unionByName(docs.where(~linked))


def keep_unlike(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """keep_first where no id repeats. Where ids do, components are those of texts, not of ids: rows
    that share an id are judged each by its own text, so unlike ones stay. A component's row is that
    of its smallest id, among those the least text by hash, among those the least row. Rows without
    an id or without words stay."""
    linked = F.col(key).isNotNull() & F.coalesce(F.col(text).rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    some = docs.where(linked)
    if some.groupBy(key).count().where("count > 1").isEmpty():
        return keep_first(docs, key, text)
    node = F.xxhash64(key, text)
    own = some.select(F.col(key).alias("id"), node.alias("node")).distinct()
    found = alike(some.select(node.alias("node"), F.col(text).alias("text")), "node", "text").select("node", "component_id").distinct()
    first = found.join(own, "node").groupBy("component_id").agg(F.min(F.struct("id", "node"))["node"].alias("node"))
    first = shared.table(first.select(F.col("node").alias("_first")), "first")
    twice = some.groupBy(node.alias("_first")).count().where("count > 1").join(first, "_first", "left_semi")
    twice = shared.table(twice.select(F.col("_first").alias("_twice")), "twice")
    left = some.join(first, node == first["_first"], "left_semi")
    least = left.join(twice, node == twice["_twice"], "left_semi").groupBy(node.alias("_node")).agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("_row"))
    return left.join(twice, node == twice["_twice"], "left_anti").unionByName(least.select("_row.*")).unionByName(docs.where(~linked))
