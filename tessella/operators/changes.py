"""What a scan of a library means for its catalog: a feed of added, changed, moved, deleted, duplicate and same files.

A track is a content (id) and has one path; files are joined with tracks by id and by path, both sides whole:
same       the track's file, at its path
moved      the track's content at another path, and none at its own; the greatest path of several
duplicate  a further file of a content that is there
changed    content that no track has, at the path of a track whose content is nowhere any more
added      content that no track has, at any other path
deleted    a track whose content is nowhere, and whose path has no new content of its own
Rows of files: path, id, stamp, and old_path (moved) or old_id (changed). Rows of deleted tracks: old_path, old_id.

`close` keeps what was: rows that end go to a history with the times between which they held.
Files without an id (they could not be read) say nothing about their path: a track there is
neither changed nor deleted. A path that is listed twice counts once, by its last stamp.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KINDS = ("added", "changed", "moved", "deleted", "duplicate", "same")


def feed(found: DataFrame, known: DataFrame) -> DataFrame:
    """status, path, id, stamp, old_path, old_id. found: path, id, mtime of files; known: id, path of open tracks, one row an id."""
    files = found.where("path IS NOT NULL").groupBy("path").agg(F.max_by(F.struct("id", "mtime"), F.struct("mtime", "id")).alias("f")).select("path", F.col("f.id").alias("id"), F.col("f.mtime").alias("stamp"))
    unread = files.where("id IS NULL").select(F.col("path").alias("u_path"))
    files = files.where("id IS NOT NULL")
    tracks = known.select(F.col("id").alias("k_id"), F.col("path").alias("k_path"))

    # by content: each file with its track, each track with whether its content is there
    own = files.join(tracks, F.col("id") == F.col("k_id"), "full")
    one = own.where("id IS NOT NULL").groupBy("id").agg(F.max("path").alias("last"), F.coalesce(F.bool_or(F.col("path") == F.col("k_path")), F.lit(False)).alias("stays"))
    there = own.where("id IS NOT NULL").join(one.withColumnRenamed("id", "o_id"), F.col("id") == F.col("o_id"))
    role = (
        F.when(F.col("path") == F.col("k_path"), "same").when(F.col("stays") | (F.col("path") != F.col("last")), "duplicate")
        .when(F.col("k_id").isNotNull(), "moved").otherwise("added")
    )
    there = there.select(role.alias("status"), "path", "id", "stamp", F.when(role == "moved", F.col("k_path")).alias("old_path"))
    lost = own.where("id IS NULL").select("k_id", "k_path").join(unread, F.col("k_path") == F.col("u_path"), "left_anti")

    # by path: new content where the lost content was
    kept = there.where("status <> 'added'").withColumn("old_id", F.lit(None).cast(known.schema["id"].dataType))
    met = there.where("status = 'added'").drop("old_path").join(lost, F.col("path") == F.col("k_path"), "full")
    status = F.when(F.col("k_id").isNull(), "added").when(F.col("id").isNull(), "deleted").otherwise("changed")
    rest = met.select(status.alias("status"), "path", "id", "stamp", F.when(status == "deleted", F.col("k_path")).alias("old_path"), F.col("k_id").alias("old_id"))
    return kept.unionByName(rest)


def ended(changes: DataFrame) -> DataFrame:
    """id of the tracks that the feed ends: changed and deleted ones."""
    return changes.where("status IN ('changed', 'deleted')").select(F.col("old_id").alias("id"))


def counts(changes: DataFrame) -> DataFrame:
    """One row: how many of each kind."""
    return changes.agg(*[F.count_if(F.col("status") == k).alias(k) for k in KINDS])


def close(catalog: DataFrame, ids: DataFrame, version: int) -> DataFrame:
    """The history of tracks that end behind this version: their rows with valid_to, under a key of their own."""
    rows = catalog.join(ids.select("id"), "id", "left_semi")
    return rows.select(F.concat_ws("@", "id", F.lit(str(version))).alias("row"), *catalog.columns, F.lit(version).cast("long").alias("valid_to"))
