"""The catalog of a library: one row a track, upserted by id; and its JSON form."""

from __future__ import annotations

import warnings
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .index import MissingError
from .store import SCHEMA_VERSION, SchemaError
from .tables import keep_last

TRACK = "id string, path string, title string, artist string, album string, duration_seconds double, mtime double, extra map<string,string>"
FIELDS = [f.split(" ")[0] for f in TRACK.split(", ")]


def tracks(df: DataFrame) -> DataFrame:
    """df brought to the columns of a catalog; what it lacks is null, extra an empty map. Id and path are required."""
    have = {f.split(" ")[0]: f.split(" ")[1] for f in TRACK.split(", ")}
    for need in ("id", "path"):
        if need not in df.columns:
            raise SchemaError(f"a track needs {need}")
    of = {c: (F.col(c) if c in df.columns else F.lit(None)).cast(t) for c, t in have.items()}
    of["path"] = F.replace(of["path"], F.lit("\\"), F.lit("/"))
    of["extra"] = F.coalesce(of["extra"], F.create_map().cast("map<string,string>"))
    return df.select(*[c.alias(n) for n, c in of.items()])


def put(extra: Column, values: dict[str, Column]) -> Column:
    """The map with these keys set, null values aside; later ones win."""
    new = F.map_filter(F.create_map(*[x for k, v in values.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return F.map_concat(F.map_filter(extra, lambda k, v: ~F.map_contains_key(new, k)), new)


@dataclass
class Catalog:
    rows: DataFrame
    library: str = ""

    @classmethod
    def of(cls, df: DataFrame, library: str = "", order: str | None = None) -> Catalog:
        """Of an id that occurs again the row of highest `order` counts, without one that of the last path."""
        if order:
            df = keep_last(df, "id", order, "path")
            return cls(tracks(df), library)
        return cls(keep_last(tracks(df), "id", "path"), library)

    def add(self, new: DataFrame) -> Catalog:
        new = Catalog.of(new).rows
        return Catalog(self.rows.join(new.select("id"), "id", "left_anti").select(*FIELDS).unionByName(new), self.library)

    def remove(self, ids: DataFrame) -> Catalog:
        if not ids.join(self.rows, "id", "left_anti").isEmpty():
            raise MissingError("an id to remove is not in the catalog")
        return Catalog(self.rows.join(ids, "id", "left_anti").select(*FIELDS), self.library)

    def get(self, key: str) -> DataFrame:
        return self.rows.where(F.col("id") == key)

    def contains(self, df: DataFrame, key: str = "id") -> DataFrame:
        """df with `known`: whether its key is a track's id."""
        ids = self.rows.select(F.struct(F.col("id")).alias("there")).distinct()
        rows = df.select(F.struct(*df.columns).alias("row"))
        met = rows.join(ids, F.col("row")[key] == F.col("there.id"), "left")
        return met.select(*[F.col("row")[c].alias(c) for c in df.columns if c != "known"], F.col("there").isNotNull().alias("known"))

    def ids(self) -> DataFrame:
        return self.rows.select("id")

    def enrich(self, side: DataFrame, by: Column, key: str, keys: list[str]) -> Catalog:
        """Tracks whose `by` is a key of side get its columns `keys` in extra; others stay."""
        side = side.groupBy(F.col(key).alias("key")).agg(F.max(F.struct(*keys)).alias("side"))
        met = self.rows.select(F.struct(*FIELDS).alias("row"), by.alias("by")).join(side, F.col("by") == F.col("key"), "left")
        extra = F.when(F.col("key").isNull(), F.col("row.extra")).otherwise(put(F.col("row.extra"), {k: F.col("side")[k].cast("string") for k in keys}))
        return Catalog(met.select(*[extra.alias(c) if c == "extra" else F.col(f"row.{c}").alias(c) for c in FIELDS]), self.library)

    def lines(self) -> DataFrame:
        """One JSON object a track."""
        return self.rows.select(F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"}).alias("value"))

    @classmethod
    def read_json(cls, spark: SparkSession, path: str, library: str = "") -> Catalog:
        """A catalog file {schema_version, library_id, tracks}; of a repeated id the later one counts."""
        schema = f"schema_version int, library_id string, tracks array<struct<{', '.join(f.replace(' ', ': ', 1) for f in TRACK.split(', '))}>>"
        whole = spark.read.schema(schema).option("multiLine", True).json(path)
        head = whole.select("schema_version", "library_id").first()
        if head is None or head["schema_version"] != SCHEMA_VERSION:
            raise SchemaError(f"catalog version {head and head['schema_version']} is not {SCHEMA_VERSION}")
        if library and head["library_id"] != library:
            warnings.warn(f"the catalog is of {head['library_id']}, not {library}", stacklevel=2)
        rows = whole.select(F.posexplode("tracks").alias("_at", "t")).select("_at", "t.*")
        return cls.of(rows, library or head["library_id"], "_at")
