"""Nearest neighbours by inner product: a block matrix join with int8 tiles.

Vectors are quantised to int8 with one scale each. A tile is the product of a
block of queries with a block of candidates in int8 (held as float32 and summed over at
most EXACT components at a time, so every integer is exact); with the norms of what quantisation left out it bounds
every inner product from both sides. Pairs whose upper bound reaches the query's
k-th best lower bound survive, as do those whose bound is not finite (very small
or large components), and are recomputed in double precision, components added in
order. Each query keeps a heap of its k best over the tiles of a block;
the k best of all blocks then meet in a ranked window, at most k rows a block.

Blocks are made by row counts, so a task's memory is bounded whatever the table:
BLOCK_QUERIES and BLOCK_ROWS vectors. Vectors that are null, zero or hold null or
non-finite components take no part; vectors of different lengths never meet.
Repeated candidates stay, a repeated query is asked once, ties go to the smaller id. Rows with a null id take no part.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BLOCK_QUERIES, BLOCK_ROWS, TILE = 4096, 16384, 256
EXACT = (1 << 24) // 127**2  # int8 products whose sum float32 holds exactly


def usable(df: DataFrame, key: str, vector: str) -> DataFrame:
    """id, v: the vectors that take part, as they are stored; products are in double precision."""
    v = F.col("v")
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    return df.select(F.col(key).cast("long").alias("id"), F.col(vector).alias("v")).where(F.col("id").isNotNull() & F.col("v").isNotNull() & fine)


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    flat = column.combine_chunks()
    return flat.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(flat), -1)


def quantise(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """int8 codes as float32, each row's scale, and the norm of what is left out."""
    scale = np.abs(x).max(1) / 127
    codes = np.rint(x / scale[:, None])  # without a scale (subnormal vectors) not finite, like their bounds
    return codes.astype(np.float32), scale, np.linalg.norm(x - codes * scale[:, None], axis=1)


def ordered_dot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row inner products, components added from the first to the last."""
    out = np.zeros(len(a))
    for d in range(a.shape[1]):
        out += a[:, d] * b[:, d]
    return out


def code_products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of int8 codes, exact in any width."""
    out = np.zeros((len(a), len(b)))
    for d in range(0, a.shape[1], EXACT):
        out += a[:, d : d + EXACT] @ b[:, d : d + EXACT].T
    return out


@np.errstate(all="ignore")
def block_best(qid: np.ndarray, q: np.ndarray, cid: np.ndarray, c: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query id, id, score) of the k nearest candidates of each query in this block, by tiles."""
    qc, qs, qe = quantise(q)
    cc, cs, ce = quantise(c)
    qn, cn = np.linalg.norm(q, axis=1), np.linalg.norm(c, axis=1)
    heaps: list[list[tuple[float, int]]] = [[] for _ in qid]
    slack = 1e-9 * (1 + qn[:, None] * cn.max(initial=0))
    for at in range(0, len(qid), TILE):
        rows = slice(at, at + TILE)
        for left in range(0, len(cid), BLOCK_QUERIES):
            cols = slice(left, left + BLOCK_QUERIES)
            near = code_products(qc[rows], cc[cols]) * qs[rows, None] * cs[cols]
            # q.c = q'.c' + q'.(c - c') + (q - q').c, with |q'| <= |q| + |q - q'|
            off = (qn[rows, None] + qe[rows, None]) * ce[cols] + qe[rows, None] * cn[cols] + slack[rows]
            low = near - off
            low[~np.isfinite(low)] = -np.inf
            low[qid[rows, None] == cid[cols]] = -np.inf
            floor = np.array([h[0][0] if len(h) == k else -np.inf for h in heaps[rows]])
            if low.shape[1] >= k:
                floor = np.maximum(floor, np.partition(low, low.shape[1] - k, axis=1)[:, low.shape[1] - k])
            i, j = np.nonzero(~(near + off < floor[:, None]) & (qid[rows, None] != cid[cols]))
            score = ordered_dot(q[rows][i], c[cols][j])
            order = np.lexsort((cid[cols][j], -score, i))  # no more than k of a tile reach a heap, whatever ties
            i, j, score = i[order], j[order], score[order]
            first = np.arange(len(i)) - np.searchsorted(i, i) < k
            i, j, score = i[first], j[first], score[first]
            for a, s, x in zip((i + at).tolist(), score.tolist(), (-cid[cols][j]).tolist(), strict=True):
                h = heaps[a]
                if len(h) < k:
                    heapq.heappush(h, (s, x))
                elif (s, x) > h[0]:
                    heapq.heapreplace(h, (s, x))
    found = [(int(qid[a]), -x, s) for a, h in enumerate(heaps) for s, x in h]
    got = list(zip(*found, strict=True)) or [(), (), ()]
    return np.array(got[0], np.int64), np.array(got[1], np.int64), np.array(got[2], np.float64)


def nearest(df: DataFrame, queries: DataFrame, k: int, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of df nearest to each row of
    queries, never the row of the query's own id; all of them where fewer exist."""
    if k <= 0:
        return df.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    c, q = usable(df, key, vector), usable(queries, key, vector).dropDuplicates()
    n_c, n_q = c.count(), q.count()
    c_blocks, q_blocks = max(1, -(-n_c // BLOCK_ROWS)), max(1, -(-n_q // BLOCK_QUERIES))
    dim = F.size("v").alias("dim")
    # every block of one side meets every block of the other, by an equi-join on the pair of block numbers
    right = c.select("id", "v", dim, F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(c_blocks)).alias("cb"), F.explode(F.sequence(F.lit(0), F.lit(q_blocks - 1))).alias("qb"))
    left = q.select("id", "v", dim, F.pmod(F.xxhash64("id"), F.lit(q_blocks)).cast("int").alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(c_blocks - 1).cast("long"))).alias("cb"))
    keys = ["dim", "qb", "cb"]

    def tiles(a: pa.Table, b: pa.Table) -> pa.Table:
        if not len(a) or not len(b):
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], ["query_id", "vec_id", "score"])
        found = block_best(a.column("id").to_numpy(), matrix(a.column("v")), b.column("id").to_numpy(), matrix(b.column("v")), k)
        return pa.table([pa.array(x) for x in found], ["query_id", "vec_id", "score"])

    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(tiles, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.select("query_id", F.row_number().over(order).alias("rank"), "vec_id", "score").where(F.col("rank") <= k)
