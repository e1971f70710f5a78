"""Counts of 64-bit keys in a table of bounded size, gathered from all rows.

A key's cell is its top bits. Counts are kept as a byte on a logarithmic scale
(STEP codes a doubling), so they go on rising at any number of keys. The size
follows the input up to TOP bits. Tasks send their cells in compressed parts; a
part's rows are summed as they stream in, so memory does not grow with the
number of tasks, and the driver puts one byte a cell together to broadcast.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import shared
from .words import release

BITS, TOP, PARTS, STEP = 22, 24, 256, 8


def cells(keys: np.ndarray, bits: int = BITS) -> np.ndarray:
    return (keys >> np.uint64(64 - bits)).astype(np.int64)


def bits_for(df: DataFrame, bytes_a_key: int = 4) -> int:
    """Bits for a table over df, by the planner's estimate of its size."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return min(TOP, max(BITS, (size // bytes_a_key).bit_length()))


def coded(counts: np.ndarray) -> np.ndarray:
    """0 stays 0 and 1 becomes 1; larger counts rise by STEP codes a doubling."""
    return np.minimum(255, np.rint(STEP * np.log2(np.maximum(counts, 1))) + (counts > 0)).astype(np.uint8)


def count_of(codes: np.ndarray) -> np.ndarray:
    """About the counts behind codes."""
    return np.where(codes > 0, np.exp2((codes.astype(np.float64) - 1) / STEP), 0)


def gather(df: DataFrame, keys: Callable[[pa.RecordBatch], Iterator[np.ndarray]], bits: int = BITS) -> np.ndarray:
    """Codes by cell of all keys of all rows."""
    size = (1 << bits) // PARTS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = np.zeros(1 << bits, np.uint32)
        for b in batches:
            for k in keys(b):
                np.add.at(table, cells(k, bits), np.uint32(1))
        release()
        for i, p in enumerate(np.split(table, PARTS)):
            if p.any():
                yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([pa.compress(p.tobytes(), "zstd", asbytes=True)], pa.binary())], ["part", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        for b in batches:
            for part, x in zip(b.column("part").to_pylist(), b.column("counts"), strict=True):
                total.setdefault(part, np.zeros(size, np.uint64))[:] += np.frombuffer(pa.decompress(x.as_buffer(), 4 * size, "zstd"), np.uint32)
        for part, x in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([pa.compress(coded(x).tobytes(), "zstd", asbytes=True)], pa.binary())], ["part", "counts"])

    out = np.zeros((PARTS, size), np.uint8)
    schema, spark = "part int, counts binary", df.sparkSession
    with shared.settings(spark, {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}):
        for row in df.mapInArrow(count, schema).repartition(min(PARTS, shared.partitions(spark)), "part").mapInArrow(add, schema).collect():
            out[row["part"]] = np.frombuffer(pa.decompress(bytes(row["counts"]), size, "zstd", asbytes=True), np.uint8)
    return out.ravel()
