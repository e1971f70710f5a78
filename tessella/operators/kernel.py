"""Scoring by blocks: centred unit rows times queries, in numpy.

Queries go to all tasks while they are few (SENT bytes); a task keeps each
query's k best over its batches, so k rows a query and task leave it. Larger
query sets meet the rows block by block, by an equi-join on block numbers, so a
task holds ROWS and QUERIES vectors at most. A ranked window merges.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..functions import vectors as V

ROWS, QUERIES, SENT = 16_384, 1024, 64 << 20
FLOOR = 1e-8  # the least norm a centred row is divided by
SLACK = 1e-9  # of products that are summed in any order


def kind(df: DataFrame, column: str) -> str:
    return df.schema[column].dataType.simpleString()


def named(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Ids as numbers, or as text in the order of code points."""
    ids = column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()
    return ids.astype(str) if ids.dtype == object else ids


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def unit(x: np.ndarray, centre: list[float] | None, floor: float = FLOOR) -> np.ndarray:
    x = x - np.asarray(centre) if centre else x
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return x / (np.maximum(n, floor) if floor else np.where(n > 0, n, 1))


def centred(rows: DataFrame, centre: list[float] | None) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                u = unit(matrix(b.column("v")), centre)
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.ListArray.from_arrays(np.arange(len(u) + 1, dtype=np.int32) * u.shape[1], u.ravel())], ["id", "v"])

    return rows.select("id", "v").mapInArrow(run, f"id {kind(rows, 'id')}, v array<double>")


def scores(rows: DataFrame, centre: list[float] | None, query: np.ndarray) -> DataFrame:
    """id, raw_score of one centred unit query."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(unit(matrix(b.column("v")), centre) @ query)], ["id", "raw_score"])

    return rows.select("id", "v").mapInArrow(run, f"id {kind(rows, 'id')}, raw_score double")


class Best:
    """The k best of each query so far, ties to the smaller id."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.q, self.id, self.score = np.zeros(0, np.int64), ids[:0], np.zeros(0)
        self.floor = np.full(len(ids), -np.inf)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        if not len(ids) or not self.k:
            return
        self.take(ids, self.queries @ x.T, lambda q, j: (self.queries[q] * x[j]).sum(1))

    def take(self, ids: np.ndarray, score: np.ndarray, exact: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> None:
        """Takes further rows with their scores (queries x ids), which may be off by SLACK. What may be among the best is
        scored by `exact` (places of queries and of ids), whose sums have one order, so equal rows score the same."""
        if self.ids.dtype.kind == ids.dtype.kind:
            score[self.ids[:, None] == ids] = -np.inf
        floor = self.floor
        many = np.flatnonzero((score >= floor[:, None]).sum(1) > self.k)
        if len(many):
            floor = floor.copy()
            floor[many] = np.maximum(floor[many], np.partition(score[many], -self.k, axis=1)[:, -self.k])
        q, j = np.nonzero((score >= floor[:, None] - SLACK) & (score > -np.inf))
        q, i, s = np.concatenate([self.q, q]), np.concatenate([self.id, ids[j]]) if len(self.id) else ids[j], np.concatenate([self.score, exact(q, j)])
        order = np.lexsort((i, -s, q))
        q, i, s = q[order], i[order], s[order]
        rank = np.arange(len(q)) - np.searchsorted(q, q)
        self.q, self.id, self.score = (v[rank < self.k] for v in (q, i, s))
        last = rank == self.k - 1
        self.floor[q[last]] = s[last]

    def table(self, kinds: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
        """query_id, id, raw_score; kinds: the types of the ids."""
        return pa.RecordBatch.from_arrays([pa.array(self.ids[self.q].tolist(), kinds[0]), pa.array(self.id.tolist(), kinds[1]), pa.array(self.score)], ["query_id", "id", "raw_score"])


def asked(queries: DataFrame, dim: int | None) -> tuple[int, pa.Table | None]:
    """How many queries there are, and the queries themselves while they are few. Queries without an id, whose vector is
    null, not finite, or of another width than `dim` (or than the others), and ids that are there twice fail."""
    few = queries.limit(SENT // (8 * (dim or 1024)) + 1).toArrow()
    if few.num_rows * 8 * (dim or 1024) <= SENT:
        sizes = pc.list_value_length(few.column("v"))
        n, ids, low, high = few.num_rows, len(pc.unique(few.column("query_id"))), pc.min(sizes).as_py(), pc.max(sizes).as_py()
        wrong = few.column("query_id").null_count + sizes.null_count + (0 if sizes.null_count else int((~np.isfinite(few.column("v").combine_chunks().flatten().to_numpy(zero_copy_only=False))).sum()))
    else:
        few = None
        bad = F.count_if(F.col("query_id").isNull() | V.problem(F.col("v"), F.size("v")).isNotNull())
        n, wrong, ids, low, high = queries.agg(F.count("*"), bad, F.count_distinct("query_id"), F.min(F.size("v")), F.max(F.size("v"))).first()
    if wrong:
        raise ValueError("a query has no id, no vector, or components that are not finite")
    if n and (low != high or dim is not None and low != dim):
        raise ValueError(f"queries have {low} to {high} components, the index {dim if dim is not None else low}")
    if ids != n:
        raise ValueError(f"{n} queries have {ids} different ids")
    return n, few


def top(rows: DataFrame, queries: DataFrame, k: int, centre: list[float] | None = None, dim: int | None = None) -> DataFrame:
    """query_id, id, raw_score, rank. rows: id, v; queries: query_id, v (array<double>), raw both. What `asked` refuses fails,
    and so does a negative k."""
    if k < 0:
        raise ValueError("k must not be negative")
    queries = queries.select("query_id", "v")
    n_q, sent = asked(queries, dim)
    found = f"query_id {kind(queries, 'query_id')}, id {kind(rows, 'id')}, raw_score double"
    kinds = to_arrow_type(queries.schema["query_id"].dataType), to_arrow_type(rows.schema["id"].dataType)
    order = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "id")
    rank = lambda df: df.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if sent is not None:
        wanted = named(sent.column("query_id").combine_chunks()), unit(matrix(sent.column("v")), centre, 0) if n_q else np.zeros((0, 0))

        def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = Best(*wanted, k)
            for b in batches:
                for at in range(0, b.num_rows if n_q else 0, QUERIES):
                    part = b.slice(at, QUERIES)
                    best.add(named(part.column("id")), unit(matrix(part.column("v")), centre))
            yield best.table(kinds)

        return rank(rows.select("id", "v").mapInArrow(near, found))
    cb, qb = max(1, -(-rows.count() // ROWS)), max(1, -(-n_q // QUERIES))
    number = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = queries.select("query_id", "v", number("query_id", qb).alias("q"), every(cb).alias("c"))
    right = rows.select("id", "v", number("id", cb).alias("c"), every(qb).alias("q"))

    def best(a: pa.Table, b: pa.Table) -> pa.Table:
        held = Best(named(a.column("query_id").combine_chunks()), unit(matrix(a.column("v")), centre, 0) if len(a) else np.zeros((0, 1)), k)
        if len(a) and len(b):
            held.add(named(b.column("id").combine_chunks()), unit(matrix(b.column("v")), centre))
        return pa.Table.from_batches([held.table(kinds)])

    return rank(left.groupBy("q", "c").cogroup(right.groupBy("q", "c")).applyInArrow(best, found))
