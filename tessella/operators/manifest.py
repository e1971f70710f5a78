"""A manifest of packaged files: a Merkle tree over chunks, built by aggregates.

Files are cut into ranges of CHUNK bytes that tasks read by themselves, so no file is whole in one
process. The digests of a file's chunks are hashed in runs of FAN, level by level, to the digest
of the file; files, in the order of their paths, are hashed in the same way to the root. Each
level is an aggregate whose groups hold FAN digests at most. A node's digest is the SHA-256 of the
hex digests below it, a file's that of its path, size and top node, so renaming shows as well.

Two manifests are compared from the top: only files whose digests differ, and below them only nodes
that do, are looked at, so one changed chunk is found by one path down the tree.

An empty file has one empty chunk. Paths are relative to the folder; a folder without files has the
digest of nothing as its root. Files must be mounted on all executors.
"""

from __future__ import annotations

import hashlib
import os
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .files import scratch

CHUNK, FAN = 1 << 20, 256


def ranges(files: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """path, size, idx of the chunks of files (path, size): one a CHUNK, one for an empty file."""
    n = F.greatest(F.ceil(F.col("size") / chunk), F.lit(1)).cast("long")
    return files.select("path", "size", F.explode(F.sequence(F.lit(0).cast("long"), n - 1)).alias("idx"))


def chunks(files: DataFrame, root: str, chunk: int = CHUNK) -> DataFrame:
    """path, size, idx, h: the digest of each chunk. A file that is shorter than it was listed fails."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = []
            for path, size, idx in zip(*(b.column(c).to_pylist() for c in ("path", "size", "idx")), strict=True):
                with open(os.path.join(root, path), "rb") as f:
                    f.seek(idx * chunk)
                    data = f.read(min(chunk, size - idx * chunk))
                if len(data) != min(chunk, size - idx * chunk):
                    raise OSError(f"{path} has changed while it was read")
                found.append(hashlib.sha256(data).hexdigest())
            yield pa.RecordBatch.from_arrays([b.column("path"), b.column("size"), b.column("idx"), pa.array(found, pa.string())], ["path", "size", "idx", "h"])

    cut = ranges(files, chunk)
    return cut.repartition(F.xxhash64("path", "idx")).mapInArrow(read, "path string, size long, idx long, h string")


def run() -> Column:
    """The digest of a group's digests, in the order of idx."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("idx", "h"))), lambda s: s["h"]), ""), 256)


@dataclass
class Manifest:
    """nodes: path, size, level (0: chunks), idx, h; files: path, size, idx (place by path), h; root: their digest."""

    nodes: DataFrame
    files: DataFrame
    root: str

    def changed(self, old: Manifest, fan: int = FAN) -> DataFrame:
        """path, idx, kind of the chunks that are not as they were: added, removed, changed. Files that are gone or new
        are one row without idx."""
        if self.root == old.root:
            return self.nodes.sparkSession.createDataFrame([], "path string, idx long, kind string")
        a, b = (m.files.select("path", F.col("h").alias(h)) for m, h in ((old, "was"), (self, "now")))
        differ = a.join(b, "path", "full").where("NOT (was <=> now)")
        whole = differ.where("was IS NULL OR now IS NULL").select("path", F.lit(None).cast("long").alias("idx"), F.when(F.col("was").isNull(), "added").otherwise("removed").alias("kind"))
        open_ = differ.where("was IS NOT NULL AND now IS NOT NULL").select("path")
        was, now = (m.nodes.join(open_, "path", "left_semi") for m in (old, self))
        height = was.select("path", "level").unionByName(now.select("path", "level")).groupBy("path").agg(F.max("level").alias("height"))
        at = height.where("false").select("path", F.lit(0).cast("long").alias("up"))  # the nodes below which to look
        both = None
        for level in range(height.agg(F.max("height")).first()[0] or 0, -1, -1):
            at = at.unionByName(height.where(F.col("height") == level).select("path", F.lit(0).cast("long").alias("up")))
            x, y = (d.where(F.col("level") == level).select("path", "idx", F.col("h").alias(h)) for d, h in ((was, "was"), (now, "now")))
            both = x.join(y, ["path", "idx"], "full").where("NOT (was <=> now)").withColumn("up", F.floor(F.col("idx") / fan)).join(at, ["path", "up"], "left_semi")
            at = both.select("path", F.col("idx").alias("up"))
        kind = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").otherwise("changed")
        return whole.unionByName(both.select("path", "idx", kind.alias("kind")))


def build(spark: SparkSession, files: DataFrame, root: str, chunk: int = CHUNK, fan: int = FAN) -> Manifest:
    """The manifest of files (path relative to root, size)."""
    folder = scratch(spark, "manifest")
    kinds = "path string, size long, level int, idx long, h string"

    def kept(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    level = kept(chunks(files, root, chunk).select("path", "size", F.lit(0).alias("level"), "idx", "h"), "level-0")
    tops, depth = level.where("false"), 0
    while True:
        one = level.groupBy("path").agg(F.count("*").alias("n"))
        tops = tops.unionByName(level.join(one.where("n = 1").select("path"), "path", "left_semi"))
        more = level.join(one.where("n > 1").select("path"), "path", "left_semi")
        if more.isEmpty():
            break
        depth += 1
        up = more.groupBy("path", "size", F.floor(F.col("idx") / fan).alias("up")).agg(run().alias("h"))
        level = kept(up.select("path", "size", F.lit(depth).alias("level"), F.col("up").alias("idx"), "h"), f"level-{depth}")
    named = tops.select("path", "size", F.sha2(F.concat_ws("\n", "path", F.col("size").cast("string"), "h"), 256).alias("h"))
    files = kept(placed(kept(named.repartitionByRange("path").sortWithinPartitions("path").withColumn("at", F.monotonically_increasing_id()), "sorted")), "files")
    level = files.select("idx", "h")
    while (n := level.count()) > 1:
        level = kept(level.groupBy(F.floor(F.col("idx") / fan).alias("up")).agg(run().alias("h")).select(F.col("up").alias("idx"), "h"), f"root-{n}")
    top = level.first()
    return Manifest(spark.read.schema(kinds).parquet(*[f"{folder}/level-{i}" for i in range(depth + 1)]), files, top["h"] if top else hashlib.sha256(b"").hexdigest())


def placed(rows: DataFrame) -> DataFrame:
    """Sorted rows (at: partition and place) with idx, the place among all: partitions are counted, rows stay where they are."""
    part = F.shiftrightunsigned("at", 33)
    counts = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # a row a partition
    shift = counts.select("part", (before - F.col("first")).alias("shift"))
    return rows.withColumn("part", part).join(shift, "part").select("path", "size", (F.col("at") + F.col("shift")).alias("idx"), "h")
