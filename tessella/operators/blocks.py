"""Exact top-k over packed blocks of rows that skips blocks which cannot hold a result.

Rows are packed into blocks of at most SIZE neighbours: each row goes to its nearest pivot (PIVOTS
rows, chosen by hash), rows are dealt by range of (pivot, distance, id), so a pivot of most rows
is many partitions, and what follows each other with one pivot is a block. A block holds its ids, its
vectors packed row by row, their mean and the radius around it.

Seen from the centroid all rows of a block lie within asin(radius / distance) of the direction of
its mean, so the triangle inequality for angles bounds their scores. A task takes the blocks of a
batch best bound first; its k-th best so far skips every block whose bound is lower. Bounds and
scores follow from raw products with the query and the centroid, which may be of any later
version: rows are centred anew only where they come into the result. Rows that may be in it are
scored by sums of a fixed order, so equal rows tie, to the smaller id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from . import kernel

SIZE, PIVOTS = 256, 512
PIVOT_BYTES = 8 << 20
TILE = 32 << 20  # bytes of vectors in a group of queries or of blocks, where the queries are too many to go to all tasks
SLACK = 1e-9  # of bounds and of products, beyond their rounding


def pack(rows: DataFrame, dim: int, size: int = SIZE, pivots: int = PIVOTS) -> DataFrame:
    """block, ids, v (the vectors as little-endian doubles), centre, radius of rows (id, v), whose vectors all have dim finite components."""
    spark = rows.sparkSession
    first = rows.orderBy(F.xxhash64("id"), "id").limit(max(1, min(pivots, PIVOT_BYTES // (8 * max(dim, 1))))).toArrow()
    at = kernel.matrix(first.column("v")) if first.num_rows else np.zeros((1, dim))
    square = (at * at).sum(1)

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = kernel.matrix(b.column("v"))
                far = square - 2 * (x @ at.T)
                best = far.argmin(1)
                away = np.maximum(0, far[np.arange(len(x)), best] + (x * x).sum(1))
                yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(best.astype(np.int32)), pa.array(away)], ["id", "v", "pivot", "away"])

    kind = kernel.kind(rows, "id")
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.select("id", "v").mapInArrow(near, f"id {kind}, v array<double>, pivot int, away double")
    dealt = dealt.repartitionByRange(n, "pivot", "away", "id").sortWithinPartitions("pivot", "away", "id")
    ids = pa.list_(to_arrow_type(rows.schema["id"].dataType))

    def block(part: pa.RecordBatch) -> tuple:
        x = kernel.matrix(part.column("v"))
        centre = x.mean(0)
        return part.column("id").to_pylist(), x.astype("<f8").tobytes(), centre.tolist(), float(np.sqrt(((x - centre) ** 2).sum(1).max()))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made, pivot, at = [], b.column("pivot").to_numpy(), 0
            while at < b.num_rows:
                end = min(at + size, int(np.searchsorted(pivot, pivot[at], "right")))
                made.append(block(b.slice(at, end - at)))
                at = end
            of = lambda i, t: pa.array([m[i] for m in made], t)  # noqa: B023, E731
            yield pa.RecordBatch.from_arrays([of(0, ids), of(1, pa.binary()), of(2, pa.list_(pa.float64())), of(3, pa.float64())], ["ids", "v", "centre", "radius"])

    return dealt.mapInArrow(cut, f"ids array<{kind}>, v binary, centre array<double>, radius double").select(F.monotonically_increasing_id().alias("block"), "ids", "v", "centre", "radius")


def bounds(queries: np.ndarray, centres: np.ndarray, radius: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """No row of a block scores more (queries x blocks); queries are of length one or zero."""
    z = centres - centroid
    away = np.sqrt((z * z).sum(1))
    inside = away - radius < 1e-6 * np.maximum(1, away)  # the centroid may be within the block
    safe = np.where(inside, 1.0, away)
    angle = np.arccos(np.clip(queries @ z.T / safe, -1, 1)) - np.arcsin(np.minimum(1, np.where(inside, 0, radius) / safe))
    found = np.where(inside, 1.0, np.cos(np.maximum(0, angle)))
    return np.where((queries == 0).all(1)[:, None], 0.0, found) + SLACK


@dataclass
class Found:
    """query_id, id, raw_score, rank; share() tells, once rows were read, which share of the blocks was skipped for all queries."""

    rows: DataFrame
    seen: Observation

    def share(self) -> float:
        got = self.seen.get
        return (got["skipped"] or 0) / max(1, got["blocks"] or 0)


def top(blocks: DataFrame, queries: DataFrame, k: int, centre: list[float] | None, dim: int, without: list | None = None) -> Found:
    """The k best rows of each query (query_id, v), never the query's own id nor those of `without`. As few queries as
    kernel.SENT bytes go to all tasks. More of them are dealt into groups, as are the blocks, and a task has one group of each."""
    if k < 0:
        raise ValueError("k must not be negative")
    queries = queries.select("query_id", "v")
    n, sent = kernel.asked(queries, dim)
    origin = np.zeros(dim) if centre is None else np.asarray(centre)
    id_type = blocks.schema["ids"].dataType.elementType
    kinds = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(id_type)
    out = np.array(sorted(without)) if without else None
    result = f"query_id {kernel.kind(queries, 'query_id')}, id {id_type.simpleString()}, raw_score double, blocks long, skipped long"

    def named(asked: pa.Table) -> tuple[np.ndarray, np.ndarray]:
        return kernel.named(asked.column("query_id").combine_chunks()), kernel.unit(kernel.matrix(asked.column("v")), centre, 0) if len(asked) else np.zeros((0, dim))

    def search(wanted: tuple[np.ndarray, np.ndarray], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """kernel.QUERIES of the queries at a time meet a batch of blocks."""
        best = [kernel.Best(*(x[at : at + kernel.QUERIES] for x in wanted), k) for at in range(0, len(wanted[0]), kernel.QUERIES)]
        seen = skipped = 0
        for b in batches:
            if not b.num_rows or not best or not k:
                continue
            centres, radius, used = kernel.matrix(b.column("centre")), b.column("radius").to_numpy(), np.zeros(b.num_rows, bool)
            for own in best:
                asked = own.queries
                bound = bounds(asked, centres, radius, origin)
                for i in np.argsort(-bound.max(0), kind="stable").tolist():
                    may = bound[:, i] >= own.floor
                    if not may.any():
                        continue
                    used[i] = True
                    ids = kernel.named(b.column("ids")[i].values)
                    x = np.frombuffer(b.column("v")[i].as_buffer(), "<f8").reshape(len(ids), dim)
                    if out is not None:
                        stay = ~np.isin(ids, out)
                        ids, x = ids[stay], x[stay]
                    if len(ids):
                        own.take(ids, products(x, asked, origin, may), lambda q, j, x=x, asked=asked: (asked[q] * kernel.unit(x[j], centre)).sum(1))
            seen += b.num_rows
            skipped += b.num_rows - int(used.sum())
        names = ["query_id", "id", "raw_score", "blocks", "skipped"]
        for own in best:
            found = own.table(kinds)
            yield pa.RecordBatch.from_arrays([*found.columns, *[pa.nulls(found.num_rows, pa.int64())] * 2], names)
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds[0]), pa.nulls(1, kinds[1]), pa.nulls(1, pa.float64()), pa.array([seen], pa.int64()), pa.array([skipped], pa.int64())], names)

    held = blocks.select("ids", "v", "centre", "radius")
    if sent is not None:
        wanted = named(sent)
        rows = held.mapInArrow(lambda batches: search(wanted, batches), result)
    else:
        number = lambda c, of: F.pmod(F.xxhash64(c), F.lit(of)).cast("int")
        every = lambda of: F.explode(F.sequence(F.lit(0), F.lit(of - 1)))
        q_parts, b_parts = -(-n * 8 * dim // TILE), max(1, -(-(blocks.agg(F.sum(F.size("ids"))).first()[0] or 0) * 8 * dim // TILE))
        left = queries.select("query_id", "v", number("query_id", q_parts).alias("q"), every(b_parts).alias("b"))
        right = held.select("*", number("ids", b_parts).alias("b"), every(q_parts).alias("q"))

        def meet(asked: pa.Table, met: pa.Table) -> pa.Table:
            return pa.Table.from_batches(search(named(asked), iter(met.combine_chunks().to_batches())))

        rows = left.groupBy("q", "b").cogroup(right.groupBy("q", "b")).applyInArrow(meet, result)
    watch = Observation()
    rows = rows.observe(watch, F.sum("blocks").alias("blocks"), F.sum("skipped").alias("skipped")).where(F.col("raw_score").isNotNull()).drop("blocks", "skipped")
    order = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "id")
    return Found(rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), watch)


def products(x: np.ndarray, queries: np.ndarray, origin: np.ndarray, may: np.ndarray) -> np.ndarray:
    """Scores (queries x rows) from raw products, -inf for queries that may not; rows near the centroid, where
    products cancel, are centred."""
    asked = queries[may]
    shift, square = asked @ origin, origin @ origin
    own = (x * x).sum(1)
    norm = own - 2 * (x @ origin) + square
    close = norm <= 1e-6 * (own + square)
    part = (asked @ x.T - shift[:, None]) / np.maximum(np.sqrt(np.where(close, 1, norm)), kernel.FLOOR)
    if close.any():
        part[:, close] = asked @ kernel.unit(x[close], origin.tolist()).T
    out = np.full((len(queries), len(x)), -np.inf)
    out[may] = part
    return out
