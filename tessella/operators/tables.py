"""Catalog and build steps: which row of a key stays, what a build has to do, enrichment.

Which row stays is an aggregate, so the rows of a hot key shrink to one a task
before they meet. Columns of any name pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .moments import pooled


def _one(df: DataFrame, key: str, pick: Column) -> DataFrame:
    return df.groupBy(F.col(key).alias("key")).agg(pick.alias("row")).select("row.*")


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    return _one(df, key, F.min_by(F.struct(*df.columns), F.struct(*order)))


def keep_last(df: DataFrame, key: str, *order: str) -> DataFrame:
    return _one(df, key, F.max_by(F.struct(*df.columns), F.struct(*order)))


def incremental(found: DataFrame, stored: DataFrame, key: str = "id", stamp: str = "mtime") -> DataFrame:
    """found with status: skipped where the same key and time are stored, else index."""
    known = stored.select(F.struct(F.col(key), F.col(stamp)).alias("it")).distinct()
    rows = found.select(F.struct(*found.columns).alias("row"), F.struct(F.col(key), F.col(stamp)).alias("at"))
    out = rows.join(known, (F.col(f"at.{key}") == F.col(f"it.{key}")) & (F.col(f"at.{stamp}") == F.col(f"it.{stamp}")), "left")
    keep = [c for c in found.columns if c != "status"]
    return out.select(*[F.col(f"row.{c}") for c in keep], F.when(F.col("it").isNotNull(), "skipped").otherwise("index").alias("status"))


def counters(plan: DataFrame) -> DataFrame:
    """indexed, skipped, failed: rows of each status."""
    return plan.agg(*[F.count_if(F.col("status") == was).alias(name) for was, name in (("index", "indexed"), ("skipped", "skipped"), ("failed", "failed"))])


def failures(plan: DataFrame, path: str = "path", shown: int = 10) -> DataFrame:
    """One row: the first failed paths in order, and how many more there are."""
    bad = plan.where(F.col("status") == "failed")
    first = bad.orderBy(path).limit(shown).agg(F.array_sort(F.collect_list(path)).alias("first"))
    return first.join(bad.agg(F.greatest(F.count("*") - shown, F.lit(0)).alias("more")))  # two single rows


def enrich(tracks: DataFrame, sidecar: DataFrame, on: str, text: list[str], replace: list[str], order: str | None = None) -> DataFrame:
    """Texts are filled where missing, `replace` columns taken over where the sidecar has them. Of a
    key that the sidecar repeats, the row of highest `order` counts (without one, the greatest row)."""
    side = F.struct(*text, *replace)
    s = sidecar.groupBy(F.col(on).alias("key")).agg((F.max_by(side, order) if order else F.max(side)).alias("side"))
    out = tracks.select(F.struct(*tracks.columns).alias("row")).join(s, F.col(f"row.{on}") == F.col("key"), "left")
    of = {c: F.coalesce(F.nullif(F.col(f"row.{c}"), F.lit("")), F.col(f"side.{c}")) for c in text} | {c: F.coalesce(F.col(f"side.{c}"), F.col(f"row.{c}")) for c in replace}
    return out.select(*[of.get(c, F.col(f"row.{c}")).alias(c) for c in tracks.columns])


def artists(df: DataFrame, key: str, name: str, order: str, sep: str = ", ") -> DataFrame:
    """key, names: the non-empty names of each key joined in order, null without any."""
    said = F.array_sort(F.collect_list(F.when(F.col(name) != "", F.struct(F.col(order).alias("o"), F.col(name).alias("n")))))
    return df.groupBy(key).agg(F.nullif(F.array_join(F.transform(said, lambda t: t["n"]), sep), F.lit("")).alias("names"))


def largest(df: DataFrame, group: str, what: str, *size: Column) -> DataFrame:
    """group, what: that of the largest size."""
    return df.groupBy(group).agg(F.max_by(what, F.struct(*size)).alias(what))


def pending(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet."""
    return wanted.join(there.select(key), key, "left_anti")


def in_order(df: DataFrame, n: int, *order: str) -> DataFrame:
    return df.orderBy(*order).limit(n)


def feature_stats(df: DataFrame, group: str, feature: str) -> DataFrame:
    """group, mean, std: mean and population deviation of a feature over its frames."""
    return df.groupBy(group).agg(F.avg(feature).alias("mean"), F.stddev_pop(feature).alias("std"))


def mean_pool(df: DataFrame, group: str, vector: str) -> DataFrame:
    """group, i, x: the mean of each component over the vectors of a group; only means are taken apart into components."""
    return pooled(df, [group], vector).select(group, F.posexplode("mean").alias("i", "x"))
