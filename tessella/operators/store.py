"""Libraries as versions of keyed tables: whole versions are saved here, changes go by operators/delta.py.

A version is published by a file that only one writer can create (see there for which file systems
this holds). A writer that based its work on an older number fails and changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .delta import Log, Moved
from .files import at as _fs
from .files import remove

__all__ = ["ConcurrentWrite", "EmbedderMismatch", "SCHEMA_VERSION", "SchemaError", "checked", "current", "disk_usage", "load", "remove", "save"]
SCHEMA_VERSION = 1


class SchemaError(ValueError):
    pass


class EmbedderMismatch(ValueError):
    pass


class ConcurrentWrite(RuntimeError):
    pass


def save(root: str, tables: dict[str, DataFrame], embedder: str, dim: int, after: int | None = None, library: str = "", facts: dict | None = None) -> int:
    """Publishes whole tables, each with a row an id, behind number `after` (the current one, if not given); gives the version's number."""
    spark = next(iter(tables.values())).sparkSession
    log = Log(spark, root)
    based = log.version()["number"] if after is None else after
    head = {"schema_version": SCHEMA_VERSION, "embedder": embedder, "dim": dim, "library": library}
    try:
        return log.replace({name: (df, "id") for name, df in tables.items()}, (facts or {}) | head, based)
    except Moved as e:
        raise ConcurrentWrite(f"another writer published a version after {based}") from e


def current(spark: SparkSession, root: str) -> dict | None:
    """number, built_at, schema_version, embedder, dim, library and further facts of the current version."""
    head = Log(spark, root).version()
    return head["facts"] | {"number": head["number"], "built_at": head["built_at"]} if head["number"] else None


def checked(spark: SparkSession, root: str, embedder: str | None = None) -> dict:
    """What `current` gives, of a store that can be read with this embedder."""
    at = current(spark, root)
    if at is None:
        raise FileNotFoundError(f"no index at {root}")
    if at["schema_version"] != SCHEMA_VERSION:
        raise SchemaError(f"version {at['schema_version']} is not {SCHEMA_VERSION}")
    if embedder and at["embedder"] != embedder:
        raise EmbedderMismatch(f"the index was built with {at['embedder']}, not {embedder}")
    return at


def load(spark: SparkSession, root: str, name: str, embedder: str | None = None) -> DataFrame:
    """A table of the current version; vectors of another width than the store's fail the query."""
    at = checked(spark, root, embedder)
    out = Log(spark, root).read(name, at["number"])
    if name == "vectors":
        wrong = F.raise_error(F.lit(f"a vector is not of width {at['dim']}")).cast("boolean")
        out = out.where(F.when(F.size("v") == at["dim"], True).otherwise(wrong))
    return out


def disk_usage(spark: SparkSession, path: str) -> DataFrame:
    """One row: files, bytes and megabytes directly in a folder."""
    sizes = [(s.getLen(),) for s in _fs(spark, path)[0].listStatus(_fs(spark, path)[1]) if s.isFile()]
    rows = spark.createDataFrame(sizes, "size long")
    return rows.agg(F.count("*").alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), (F.coalesce(F.sum("size"), F.lit(0)) / 1_048_576).alias("megabytes"))
