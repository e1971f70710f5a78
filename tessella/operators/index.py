"""A vector index as DataFrames: raw vectors are the truth, the rest is derived.

Because stored vectors stay raw, centring is a function of the table: builds in
steps, upserts and removals give what a full build gives.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..functions import vectors as V
from . import kernel, rejects
from .moments import PARTS, Sums, few_tasks, sums


class DimensionError(ValueError):
    pass


class MissingError(KeyError):
    pass


def partial_sums(raw: DataFrame, vector: str = "v") -> DataFrame:
    """n, sums: the vectors of each task added up, one row a task and width."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for b in batches:
            if b.num_rows:
                part = kernel.matrix(b.column(0)).sum(0)
                n, sums = n + b.num_rows, part if sums is None else sums + part
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([sums.tolist()], pa.list_(pa.float64()))], ["n", "sums"])

    return raw.select(V.doubles(F.col(vector)).alias("v")).mapInArrow(add, "n long, sums array<double>")


def centroid_rows(raw: DataFrame, vector: str = "v") -> DataFrame:
    """i, m: the mean of each component, from a row a task."""
    return partial_sums(raw, vector).select("n", F.posexplode("sums").alias("i", "x")).groupBy("i").agg((F.sum("x") / F.sum("n")).alias("m"))


def centroid(raw: DataFrame, vector: str = "v") -> DataFrame:
    """One row with the mean vector c."""
    return centroid_rows(raw, vector).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"]).alias("c"))


def centre_and_row(rows: DataFrame, dim: int, key: int | str) -> tuple[list[float] | None, list[float] | None]:
    """The mean vector of rows (id, v) and the vector of one of them, in one job: tasks send their sums, and the row where they meet it."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = Sums.none(dim), None
        for b in batches:
            if b.num_rows:
                x = kernel.matrix(b.column("v"))
                total = total.plus(Sums.of(x).counted(len(x)))
                at = np.flatnonzero(b.column("hit").to_numpy(zero_copy_only=False))
                found = x[at[0]].tolist() if len(at) else found
        yield pa.RecordBatch.from_arrays([pa.array([total.n], pa.int64()), *(pa.array([x], pa.list_(pa.float64())) for x in (total.high.tolist(), total.low.tolist(), found))], ["n", "high", "low", "v"])

    def together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, found = Sums.none(dim), None
        for r in (r for b in batches for r in b.to_pylist()):
            total, found = total.plus(Sums.from_json(r)), r["v"] or found
        yield pa.RecordBatch.from_arrays([pa.array([total.n], pa.int64()), *(pa.array([x], pa.list_(pa.float64())) for x in (total.high.tolist(), total.low.tolist(), found))], ["n", "high", "low", "v"])

    kinds = "n long, high array<double>, low array<double>, v array<double>"
    parts = rows.select("v", F.coalesce(F.col("id") == key, F.lit(False)).alias("hit")).mapInArrow(add, kinds)
    if not few_tasks(rows):
        parts = parts.repartition(PARTS).mapInArrow(together, kinds)
    total, found = Sums.none(dim), None
    for r in parts.collect():
        total, found = total.plus(Sums.from_json(r.asDict())), r["v"] or found
    return total.mean(), found


def ranked(scored: DataFrame, k: int, least: float = -1.0) -> DataFrame:
    """The k best of id, raw_score with rank and shown score: ties by id, NaN never."""
    if k < 0:
        raise ValueError("k must not be negative")
    best = scored.where(~F.isnan("raw_score")).orderBy(F.desc("raw_score"), "id").limit(k)
    order = Window.orderBy(F.desc("raw_score"), "id")  # over at most k rows
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("raw_score") >= least).withColumn("score", V.shown(F.col("raw_score")))


def key_of(df: DataFrame, key: str) -> Column:
    """Numbers as longs, texts as they are."""
    return F.col(key) if isinstance(df.schema[key].dataType, StringType) else F.col(key).cast("long")


@dataclass
class VectorIndex:
    """rows: id (long or string), v array<double>. known: what is known of the sums behind the centroid, as a stored
    index keeps them; without it they are found by one pass."""

    rows: DataFrame
    dim: int
    known: Sums | None = field(default=None, compare=False)

    @classmethod
    def of(cls, df: DataFrame, dim: int, key: str = "id", vector: str = "v", strict: bool = False, extra: Sequence[str] = (), seen: Observation | None = None) -> VectorIndex:
        """Rows whose vector fits; with strict any other one fails the query. seen is told of the others when the rows are
        read (operators/rejects.py)."""
        why = V.problem(F.col(vector), dim)
        if seen is not None:
            df = rejects.watched(df, rejects.reason(key, vector, dim), seen)
        if strict:
            df = df.where(F.when(why.isNotNull(), F.raise_error(F.concat(F.lit("bad vector: "), why)).cast("boolean")).otherwise(True))
        return cls(df.where(why.isNull()).select(key_of(df, key).alias("id"), V.doubles(F.col(vector)).alias("v"), *extra), dim)

    def upsert(self, new: DataFrame, order: str | None = None, strict: bool = True) -> VectorIndex:
        """New rows replace those of their ids. A bad vector fails the query, or with strict off
        stays out. Of a repeated id the highest `order` counts, without one the greatest vector."""
        last = F.max_by("v", order) if order else F.max("v")
        fit = VectorIndex.of(new, self.dim, strict=strict, extra=[order] if order else []).rows.groupBy("id").agg(last.alias("v"))
        return VectorIndex(self.rows.join(fit.select("id"), "id", "left_anti").unionByName(fit), self.dim)

    def remove(self, ids: DataFrame, strict: bool = True) -> VectorIndex:
        if strict and not ids.join(self.rows, "id", "left_anti").isEmpty():
            raise MissingError("an id to remove is not in the index")
        return VectorIndex(self.rows.join(ids, "id", "left_anti"), self.dim)

    @cached_property
    def centre(self) -> list[float] | None:
        """The mean vector, dim numbers; None of an empty index. Found once for an index, or known."""
        return (self.known or sums(self.rows, self.dim)).mean()

    def unit(self) -> DataFrame:
        """id, v: centred rows of length one; a row at the centroid is zero."""
        return kernel.centred(self.rows, self.centre)

    def centred_query(self, query: Sequence[float]) -> np.ndarray:
        if len(query) != self.dim:
            raise DimensionError(f"query has {len(query)} components, the index {self.dim}")
        q = np.asarray(query, np.float64)
        if not np.isfinite(q).all():
            raise ValueError("the query holds components that are not finite")
        q = q - np.asarray(self.centre) if self.centre else q
        n = np.linalg.norm(q)
        return q / n if n > 0 else q  # a zero query scores 0 everywhere

    def scored(self, query: Sequence[float], exclude: list[int] | list[str] | None = None) -> DataFrame:
        """id, raw_score of every row; excluded ids are left out, unknown ones ignored."""
        rows = self.rows.where(~F.col("id").isin(exclude)) if exclude else self.rows
        return kernel.scores(rows, self.centre, self.centred_query(query))

    def search(self, query: Sequence[float], k: int = 10, least: float = -1.0, exclude: list[int] | list[str] | None = None) -> DataFrame:
        """id, raw_score, rank, score for one query vector."""
        return ranked(self.scored(query, exclude), k, least)

    def row(self, key: int | str) -> list[float] | None:
        """A row's vector; the job that looks for it also finds the centroid, unless that is known."""
        if self.known or "centre" in self.__dict__:
            one = self.get(key).first()
            return one["v"] if one else None
        self.__dict__["centre"], found = centre_and_row(self.rows, self.dim, key)
        return found

    def like(self, key: int | str, k: int = 10, least: float = -1.0) -> DataFrame:
        """What is most like a stored row, without it and without embedding it again; nothing for an unknown id."""
        one = self.row(key)
        return self.search(one or [0.0] * self.dim, k if one else 0, least, [key])

    def search_batch(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """query_id, id, raw_score, rank for many queries (query_id, v), never the query's own id."""
        return kernel.top(self.rows, queries, k, self.centre, self.dim)

    def get(self, key: int | str, centred: bool = False) -> DataFrame:
        return (self.unit() if centred else self.rows).where(F.col("id") == key)

    def stats(self) -> DataFrame:
        return self.rows.agg(F.count("*").alias("total"), F.max(F.size("v")).alias("dim"))
