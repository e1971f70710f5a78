"""Builds of a library: scan, skip what is stored, embed the rest, upsert, commit one version.

Vectors stay raw, so an incremental build gives what a full one gives. A file
that fails keeps its own path and reason and does not stop the build. Versions
are changes to a log (operators/delta.py), so a build writes what it has embedded.
"""

from __future__ import annotations

import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import embed as E
from ..functions import vectors as V
from ..sources import library
from . import changes, store
from .catalog import tracks
from .index import VectorIndex
from .stored import StoredIndex
from .tables import counters, failures, incremental


@dataclass
class BuildResult:
    indexed: int
    skipped: int
    failed: int
    first_failed: list[str]
    more_failed: int
    seconds: float


def vectors_of(df: DataFrame, embedder: str) -> DataFrame:
    """df with v and status; a vector that may not enter the index is a failure."""
    dim = E.find(embedder)[1]
    made = E.embed(df, embedder)
    bad = F.col("embed_error").isNotNull() | V.problem(F.col("embedding"), dim).isNotNull()
    return made.withColumn("v", V.doubles(F.col("embedding"))).withColumn("status", F.when(bad, "failed").otherwise("index"))


def _embedded(spark: SparkSession, root: str, plan: DataFrame, embedder: str) -> tuple[DataFrame, str]:
    """vectors_of, written: embedding is the dear step and happens once. Gives the folder too."""
    made = vectors_of(plan, embedder)
    work = f"{root}/work-{time.time_ns()}"
    made.write.parquet(work)
    return spark.read.schema(made.schema).parquet(work), work


def _result(rows: DataFrame, start: float) -> BuildResult:
    n, bad = counters(rows).first(), failures(rows).first()
    return BuildResult(n["indexed"], n["skipped"], n["failed"], bad["first"], bad["more"], time.monotonic() - start)


def build(spark: SparkSession, root: str, files: DataFrame | str, embedder: str, full: bool = False, max_depth: int = 20) -> BuildResult:
    """files: a folder, or rows of library.scan. What is stored with the same id and time is skipped,
    all is embedded again with full. A store of another embedder fails unless full. Only what is new is
    written; tracks whose files have changed or gone stay (`sync` ends them)."""
    start, dim = time.monotonic(), E.find(embedder)[1]
    found = library.scan(spark, files, max_depth) if isinstance(files, str) else files
    # identical files are one track: the last path in order counts
    unread = found.where("error IS NOT NULL").select("path", F.lit("failed").alias("status"))
    found = found.where("error IS NULL").groupBy("id").agg(F.max_by(F.struct(*found.columns), "path").alias("f")).select("f.*")
    at = store.current(spark, root)
    fresh = full or at is None
    held = None if fresh else StoredIndex.open(spark, root, embedder)
    plan = found.withColumn("status", F.lit("index")) if fresh else incremental(found, held.log.read("catalog"))
    made, work = _embedded(spark, root, plan.where("status = 'index'").drop("status"), embedder)
    good = made.where("status = 'index'")
    if fresh:
        StoredIndex.create(VectorIndex(good.select("id", "v"), dim), root, embedder, tracks(good), at["number"] if at else 0, audio=E.audio_config(embedder))
    else:
        held.change(good.select("id", "v"), catalog=tracks(good))
        held.compact()
    all_ = plan.where("status = 'skipped'").select("path", "status").unionByName(made.select("path", "status")).unionByName(unread)
    result = _result(all_, start)
    store.remove(spark, work)
    return result


def sync(spark: SparkSession, root: str, files: DataFrame | str, embedder: str, max_depth: int = 20, partial: bool = False) -> tuple[BuildResult, dict[str, int]]:
    """Brings a library to what a scan found, in one version, and tells how many files of each kind of operators/changes.py there were.
    Added and changed content is embedded; tracks that end leave the index and the catalog, and their rows go to the table `history`
    with the version that ended them; moved ones get their new path. partial: files are some of the library, so what is not among
    them is not deleted. Files whose content cannot be embedded are failures and end nothing."""
    start, dim = time.monotonic(), E.find(embedder)[1]
    found = library.scan(spark, files, max_depth) if isinstance(files, str) else files
    if store.current(spark, root) is None:
        nothing = found.where("false")
        StoredIndex.create(VectorIndex(nothing.select("id", F.lit(None).cast("array<double>").alias("v")), dim), root, embedder, tracks(nothing), 0, audio=E.audio_config(embedder))
    held = StoredIndex.open(spark, root, embedder)
    known = held.log.read("catalog")
    if partial:
        there = found.select("path").distinct().join(known.select("path", "id"), "path").select("id").unionByName(found.select("id")).distinct()
        known = known.join(there, "id", "left_semi")
    diff = changes.feed(found, known)
    rows = diff.join(found.dropDuplicates(["path"]).select("path", *[F.col(c).alias(f"f_{c}") for c in found.columns if c != "path"]), "path", "left")
    fields = [c for c in found.columns if c not in ("path", "id", "error")]
    rows = rows.select("status", "path", "id", "old_path", "old_id", *[F.col(f"f_{c}").alias(c) for c in fields])
    made, work = _embedded(spark, root, rows.where("status IN ('added', 'changed')").withColumnRenamed("status", "kind"), embedder)
    step = f"{work}-feed"
    rows.where("status NOT IN ('added', 'changed')").write.parquet(step)
    rest = spark.read.schema(rows.schema).parquet(step)
    good = made.where("status = 'index'")
    old = rest.where("status = 'deleted'").select(F.col("old_id").alias("id")).unionByName(good.where("old_id IS NOT NULL").select(F.col("old_id").alias("id"))).distinct()
    # a track that stays or moves keeps what its row holds besides path and time
    stay = rest.where("status IN ('same', 'moved')").select("id", F.col("path").alias("_path"), F.col("mtime").alias("_mtime"))

    def upserts(version: int) -> tuple[dict, dict]:
        now = held.log.read("catalog", version)
        moved = now.join(stay, "id").where("NOT (path <=> _path AND mtime <=> _mtime)").select(*[F.col({"path": "_path", "mtime": "_mtime"}.get(c, c)).alias(c) for c in now.columns])
        ended = changes.close(now, old, version + 1)
        if "history" not in held.log.version(version)["tables"]:
            return {"catalog": tracks(good).unionByName(moved)}, {}
        return {"catalog": tracks(good).unionByName(moved), "history": ended}, {}

    head = held.log.version()
    if "history" not in head["tables"]:
        held.log.put({"history": (changes.close(held.log.read("catalog"), old.where("false"), 0), "row")}, {}, head["number"])
    held.change(good.select("id", "v"), old, more=upserts)
    held.compact()
    kinds = changes.counts(made.select(F.col("kind").alias("status")).unionByName(rest.select("status"))).first().asDict()
    unread = found.where("error IS NOT NULL").select("path", F.lit("failed").alias("status"))
    skipped = rest.where("status IN ('same', 'moved', 'duplicate')").select("path", F.lit("skipped").alias("status"))
    result = _result(made.select("path", "status").unionByName(skipped).unionByName(unread), start)
    store.remove(spark, work)
    store.remove(spark, step)
    return result, kinds


def add_file(spark: SparkSession, root: str, path: str, embedder: str) -> BuildResult:
    """One file, brought in as `sync` does: skipped if its content is there, the track that its path had before is replaced."""
    library.check_file(path)
    return sync(spark, root, library.rows_of(spark, [path]), embedder, partial=True)[0]
