"""Moments of vectors in one pass: states that merge, and sums that also take rows back.

`segmented` gives the mean and the sum of squared deviations of each component by group. A task
keeps one state (n, mean, M2) a group and merges its batches into it by the parallel form of the
variance, so nothing cancels when values lie far from zero; states of a group meet in two steps,
first under `parts` keys each, so a group of most rows is no hot task. No row is taken apart into
its components.

`Sums` is the state behind a centroid: the number of rows and compensated sums (a high and a low
part each). It is merged, and rows that leave are taken out of it, without another pass over the rest.

Null vectors take no part, so a group of them alone has no row. A null group is a group of its own. Vectors of another width than the
first of their group fail the query. Components that are not finite make their group's component
not finite.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .kernel import matrix

HELD = 4096  # groups that a task holds before it passes their states on
PARTS = 32


def merge(a: tuple, b: tuple) -> tuple:
    """The state of two disjoint sets of rows; a state is n, mean, M2."""
    (na, ma, sa), (nb, mb, sb) = a, b
    if len(ma) != len(mb):
        raise ValueError(f"vectors of {len(ma)} and of {len(mb)} components are in one group")
    d, n = mb - ma, na + nb
    return n, ma + d * (nb / n), sa + sb + d * d * (na * nb / n)


def state(x: np.ndarray) -> tuple:
    mean = x.mean(0)
    return len(x), mean, ((x - mean) ** 2).sum(0)


def _rows(states: dict, names: Sequence[str], types: Sequence[pa.DataType]) -> pa.RecordBatch:
    lists = lambda i: pa.array([s[i].tolist() for s in states.values()], pa.list_(pa.float64()))
    keys = [pa.array([k[i] for k in states], t) for i, t in enumerate(types)]
    return pa.RecordBatch.from_arrays([*keys, pa.array([s[0] for s in states.values()], pa.int64()), lists(1), lists(2)], [*names, "n", "mean", "m2"])


def segmented(df: DataFrame, groups: Sequence[str], vector: str, parts: int = PARTS) -> DataFrame:
    """groups, n, mean, m2 (sums of squared deviations; both array<double>) of the vectors of each group."""
    own = [f"g{i}" for i in range(len(groups))]

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        types = []
        for b in batches:
            b = b.filter(b.column("v").is_valid())
            if not b.num_rows:
                continue
            types = [b.schema.field(c).type for c in own]
            sizes = pc.list_value_length(b.column("v"))
            table = pa.Table.from_arrays([*(b.column(c) for c in own), sizes, pa.array(np.arange(b.num_rows))], [*own, "width", "row"])
            for key in table.group_by([*own, "width"], use_threads=False).aggregate([("row", "list")]).to_pylist():
                at = tuple(key[c] for c in own)
                one = state(matrix(b.column("v").take(pa.array(key["row_list"]))))
                held[at] = merge(held[at], one) if at in held else one
            if len(held) > HELD:
                yield _rows(held, own, types)
                held = {}
        if held:
            yield _rows(held, own, types)

    def together(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        sums = (rows[0]["n"], np.array(rows[0]["mean"]), np.array(rows[0]["m2"]))
        for r in rows[1:]:
            sums = merge(sums, (r["n"], np.array(r["mean"]), np.array(r["m2"])))
        key = {tuple(rows[0][c] for c in own): sums}
        return pa.Table.from_batches([_rows(key, own, [table.schema.field(c).type for c in own])])

    kinds = ", ".join([*(f"{o} {df.schema[g].dataType.simpleString()}" for o, g in zip(own, groups, strict=True)), "n long, mean array<double>, m2 array<double>"])
    states = df.select(*[F.col(g).alias(o) for o, g in zip(own, groups, strict=True)], V.doubles(F.col(vector)).alias("v")).mapInArrow(partial, kinds)
    dealt = states.withColumn("part", F.pmod(F.xxhash64("n", "mean"), F.lit(parts)).cast("int"))
    first = dealt.groupBy(*own, "part").applyInArrow(lambda t: together(t), kinds)
    out = first.groupBy(*own).applyInArrow(lambda t: together(t), kinds)
    return out.withColumnsRenamed(dict(zip(own, groups, strict=True)))


def pooled(df: DataFrame, groups: Sequence[str], vector: str) -> DataFrame:
    """groups, n, mean, std: population deviations."""
    return segmented(df, groups, vector).select(*groups, "n", "mean", F.transform("m2", lambda x: F.sqrt(x / F.col("n"))).alias("std"))


def standardised(df: DataFrame, vector: str, floor: float = 1e-6) -> DataFrame:
    """df with each vector less its own mean, over its own deviation and `floor`; null and empty ones stay."""
    names = df.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = b.column(vector).to_pylist()
            for i, x in enumerate(out):
                if x:
                    x = np.array(x, np.float64)
                    out[i] = ((x - x.mean()) / (x.std() + floor)).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.float64())) if c == vector else b.column(c) for c in names], names)

    made = df.withColumn(vector, V.doubles(F.col(vector)))
    return made.mapInArrow(run, made.schema)


def two_sum(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rounded sum, and what rounding has left out."""
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


@dataclass(frozen=True)
class Sums:
    """n rows, and the sums of their components as high + low."""

    n: int
    high: np.ndarray
    low: np.ndarray

    @classmethod
    def none(cls, dim: int) -> Sums:
        return cls(0, np.zeros(dim), np.zeros(dim))

    @classmethod
    def of(cls, x: np.ndarray) -> Sums:
        s = cls.none(x.shape[1])
        while len(x) > 1:  # pairwise, and what each sum leaves out is kept
            if len(x) % 2:
                s, x = s.plus(cls(0, x[-1], np.zeros(x.shape[1]))), x[:-1]
            high, low = two_sum(x[0::2], x[1::2])
            s = cls(0, s.high, s.low + low.sum(0))
            x = high
        return s.plus(cls(0, x[0], np.zeros(x.shape[1]))) if len(x) else s

    def counted(self, n: int) -> Sums:
        return Sums(n, self.high, self.low)

    def plus(self, other: Sums, sign: int = 1) -> Sums:
        high, left = two_sum(self.high, sign * other.high)
        return Sums(self.n + sign * other.n, high, self.low + sign * other.low + left)

    def minus(self, other: Sums) -> Sums:
        return self.plus(other, -1)

    def mean(self) -> list[float] | None:
        return ((self.high + self.low) / self.n).tolist() if self.n else None

    def to_json(self) -> dict:
        return {"n": self.n, "high": self.high.tolist(), "low": self.low.tolist()}

    @classmethod
    def from_json(cls, d: dict) -> Sums:
        return cls(d["n"], np.array(d["high"], np.float64), np.array(d["low"], np.float64))


def sums(rows: DataFrame, dim: int, vector: str = "v", signs: str | None = None) -> Sums:
    """The state of all rows, in one job; with signs (a column of 1 and -1) rows of -1 are taken out.
    A task sends one state, and at most PARTS come to the driver."""
    column = F.lit(1) if signs is None else F.col(signs)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = Sums.none(dim)
        for b in batches:
            b = b.filter(b.column("v").is_valid())
            if b.num_rows:
                sign = b.column("sign").to_numpy()
                total = total.plus(Sums.of(matrix(b.column("v")) * sign[:, None]).counted(int(sign.sum())))
        yield packed(total)

    def packed(s: Sums) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([s.n], pa.int64()), pa.array([s.high.tolist()], pa.list_(pa.float64())), pa.array([s.low.tolist()], pa.list_(pa.float64()))], ["n", "high", "low"])

    def add(states) -> Sums:
        total = Sums.none(dim)
        for r in states:
            total = total.plus(Sums(r["n"], np.array(r["high"], np.float64), np.array(r["low"], np.float64)))
        return total

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed(add(r for b in batches for r in b.to_pylist()))

    kinds = "n long, high array<double>, low array<double>"
    states = rows.select(V.doubles(F.col(vector)).alias("v"), column.cast("int").alias("sign")).mapInArrow(partial, kinds)
    states = states if few_tasks(rows) else states.repartition(PARTS).mapInArrow(together, kinds)
    return add(r.asDict() for r in states.collect())


def few_tasks(rows: DataFrame) -> bool:
    """Whether, by the planner's estimate of its bytes, a row a task of this may come to the driver as it is."""
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return size <= PARTS * (64 << 20)
