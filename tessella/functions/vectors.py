"""Vector arithmetic as column expressions over array<double>; sums run left to right."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

FLOOR = 1e-8  # the least norm a centred row is divided by


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x * x))


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def over(v: Column, n: Column) -> Column:
    return F.transform(v, lambda x: x / n)


def unit_query(v: Column) -> Column:
    """A zero query stays zero, so that it scores 0 everywhere."""
    n = norm(v)
    return F.when(n > 0, over(v, n)).otherwise(v)


def unit_row(v: Column) -> Column:
    return over(v, F.greatest(norm(v), F.lit(FLOOR)))


def finite(v: Column) -> Column:
    return F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def problem(v: Column, dim: int) -> Column:
    """Why a vector may not enter an index of this width, or null."""
    return F.when(v.isNull(), "null").when(F.size(v) != dim, "dimension").when(~finite(doubles(v)), "not finite")


def shown(score: Column) -> Column:
    return F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0))


def band(score: Column) -> Column:
    return F.when(score >= 0.70, "similar").when(score >= 0.50, "somewhat similar").otherwise("low")


def percent(score: Column) -> Column:
    return F.floor(score * 100 + 0.5).cast("int")
