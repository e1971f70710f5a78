"""Catalogs of remote libraries: JSON of their APIs to track rows, paged reads, downloads, packages.

What an API returned is a table of JSON; parsing it is relational. Fetching goes
through a function that is handed in, so a network is a matter of the caller.
"""

from __future__ import annotations

import hashlib
import io
import json
import os
import posixpath
import tarfile
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.tables import keep_first

Get = Callable[[str], tuple[int, dict[str, str], bytes]]  # url to status, headers, body


class ChecksumError(ValueError):
    pass


class UnsafeArchive(ValueError):
    pass


def get_with_backoff(get: Get, url: str, attempts: int = 4, sleep: Callable[[float], None] = time.sleep) -> bytes:
    """The body, tried again after 1, 2, 4 ... seconds on transport errors and after Retry-After
    and one second more on 429. Other statuses above 399 are errors at once."""
    for n in range(attempts):
        try:
            status, headers, body = get(url)
        except OSError:
            if n + 1 == attempts:
                raise
            sleep(2.0**n)
            continue
        if status == 429 and n + 1 < attempts:
            sleep(float(headers.get("Retry-After", 1)) + 1)
        elif status >= 400:
            raise OSError(f"{url}: status {status}")
        else:
            return body
    raise OSError(f"{url}: no answer after {attempts} attempts")


def pages(read: Callable[[int], list[dict]], size: int = 200, limit: int = 0) -> Iterator[dict]:
    """Rows of a paged API, page after page, up to an empty or short page or the limit."""
    at, given = 0, 0
    while found := read(at):
        for row in found:
            yield row
            given += 1
            if limit and given == limit:
                return
        if len(found) < size:
            return
        at += size


# Fields of the JSON that these services answer with, and columns of track files.
SPOTIFY = "id string, name string, preview_url string, duration_ms string, artists array<struct<name: string>>, album struct<name: string, images: array<struct<url: string>>>"
ALBUM = "id string, title string, cover_medium string, cover_big string, cover string"
DEEZER = f"id string, title string, preview string, duration string, artist struct<name: string>, album struct<{ALBUM}>"
TRACK_COLUMNS = ["track_id", "title", "artist", "album", "album_art_url", "preview_url"]


def blank(x: Column) -> Column:
    return F.coalesce(x, F.lit(""))


def spotify_tracks(df: DataFrame, line: str = "value", order: str = "seq") -> DataFrame:
    """Tracks of JSON objects in their order: those without an id or preview are left out, the
    first of an id stays, artists without a name are skipped."""
    t = df.select(F.col(order).alias("seq"), F.from_json(line, SPOTIFY).alias("t"))
    named = F.filter(F.coalesce(F.col("t.artists"), F.array()), lambda a: T.present(a["name"]).isNotNull())
    rows = t.where(T.present(F.col("t.id")).isNotNull() & T.present(F.col("t.preview_url")).isNotNull()).select(
        "seq", F.col("t.id").alias("track_id"), blank(F.col("t.name")).alias("title"), F.array_join(F.transform(named, lambda a: a["name"]), ", ").alias("artist"),
        blank(F.col("t.album.name")).alias("album"), blank(F.get(F.col("t.album.images"), F.lit(0))["url"]).alias("album_art_url"), F.col("t.preview_url").alias("preview_url"),
        blank(F.col("t.duration_ms")).alias("duration_ms"),
    )
    return keep_first(rows, "track_id", "seq")


def deezer_tracks(df: DataFrame, line: str = "value", order: str = "seq", album: str | None = None) -> DataFrame:
    """As above; `album` names a column with the JSON of the album that a listing belongs to, for tracks that carry none."""
    parent = F.from_json(F.col(album) if album else F.lit(None).cast("string"), ALBUM)
    t = df.select(F.col(order).alias("seq"), F.from_json(line, DEEZER).alias("t"), parent.alias("p"))
    a = lambda f: F.coalesce(F.col(f"t.album.{f}"), F.when(F.col("t.album").isNull(), F.col(f"p.{f}")))
    rows = t.where(T.present(F.col("t.id")).isNotNull() & T.present(F.col("t.preview")).isNotNull()).select(
        "seq", F.col("t.id").alias("track_id"), blank(F.col("t.title")).alias("title"), blank(F.col("t.artist.name")).alias("artist"), blank(a("title")).alias("album"),
        blank(T.first_present(a("cover_medium"), a("cover_big"), a("cover"))).alias("album_art_url"), F.col("t.preview").alias("preview_url"), blank(F.col("t.duration")).alias("duration_sec"),
    )
    return keep_first(rows, "track_id", "seq")


def downloadable(tracks: DataFrame, url: str, seconds: str, more_than: float = 10.0) -> DataFrame:
    """Tracks with a url that are longer than `more_than`."""
    return tracks.where(T.present(F.col(url)).isNotNull() & (F.col(seconds) > more_than))


def download(wanted: DataFrame, folder: str, get: Get, cap: int = 6 << 20, key: str = "track_id", url: str = "preview_url") -> DataFrame:
    """key, path, size, error: each file fetched on an executor into the shared folder, cut at cap bytes
    and put in place whole. What is there already is not fetched."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for k, u in zip(frame[key], frame[url], strict=True):
                path = posixpath.join(folder, f"{k}.mp3")
                try:
                    if not os.path.exists(path):
                        body = get_with_backoff(get, u)[:cap]
                        with open(f"{path}.part", "wb") as f:
                            f.write(body)
                        os.replace(f"{path}.part", path)
                    rows.append((k, path, os.path.getsize(path), None))
                except OSError as e:
                    rows.append((k, None, None, str(e)))
            yield pd.DataFrame(rows, columns=[key, "path", "size", "error"])

    kind = wanted.schema[key].dataType.simpleString()
    return wanted.select(key, url).mapInPandas(run, f"`{key}` {kind}, path string, size long, error string")


def write_tsv(df: DataFrame, path: str, columns: list[str]) -> None:
    """One TSV file in a folder, with a header; other columns are left out, nulls are empty."""
    df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in columns]).coalesce(1).write.csv(path, sep="\t", header=True, escape='"', emptyValue="")


def write_sidecar(df: DataFrame, path: str, key: str = "id") -> None:
    """JSON lines {key, track}: a track's fields under its id as text."""
    df.select(F.col(key).cast("string").alias("key"), F.struct(*df.columns).alias("track")).write.json(path)


def read_sidecar(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(f"key string, track struct<{schema}>").json(path).select("key", "track.*")


def checksum_matches(content: Column, expected: Column) -> Column:
    return F.sha2(content, 256) == F.lower(expected)


def package(folder: str, target: str) -> dict:
    """A flat tar.gz of a folder's files in order, and its manifest: name, sha256, size_bytes."""
    with open(target, "wb") as out, tarfile.open(fileobj=out, mode="w:gz", compresslevel=6) as tar:
        for name in sorted(n for n in os.listdir(folder) if os.path.isfile(os.path.join(folder, n))):
            tar.add(os.path.join(folder, name), name)
    with open(target, "rb") as f:
        digest = hashlib.file_digest(f, "sha256").hexdigest()
    return {"name": os.path.basename(target), "sha256": digest, "size_bytes": os.path.getsize(target)}


def unsafe_name(name: str) -> bool:
    return name.startswith("/") or ".." in name.split("/")


def unpack(archive: bytes, expected: str, folder: str) -> list[str]:
    """The names written, once the checksum fits and every member stays below the folder."""
    if hashlib.sha256(archive).hexdigest() != expected.lower():
        raise ChecksumError("the archive is not the one that was announced")
    with tarfile.open(fileobj=io.BytesIO(archive), mode="r:gz") as tar:
        members = tar.getmembers()
        for m in members:
            if unsafe_name(m.name) or not (m.isfile() or m.isdir()):
                raise UnsafeArchive(f"{m.name} is not written")
        for m in members:
            tar.extract(m, folder, filter="data")
        return sorted(m.name for m in members if m.isfile())


def registry_entries(get: Get, url: str, bundled: str) -> list[dict]:
    """The entries of a remote registry, or of the bundled file if it cannot be had or read."""
    try:
        found = json.loads(get_with_backoff(get, url))
    except (OSError, ValueError):
        with open(bundled, encoding="utf-8") as f:
            found = json.load(f)
    if not isinstance(found, dict) or "indexes" not in found:
        raise ValueError("a registry has indexes")
    return found["indexes"]


def fetch_index(entries: DataFrame, name: str, get: Get, folder: str) -> list[str]:
    """The first entry of this name: downloaded, checked and unpacked."""
    one = entries.where(F.col("name") == name).orderBy("at").first()
    if one is None:
        raise KeyError(f"no index {name}")
    return unpack(get_with_backoff(get, one["url"]), one["sha256"], folder)
