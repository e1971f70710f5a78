"""Files of a media library: listing, content ids, WAV tags and clips, TSV and registry readers."""

from __future__ import annotations

import hashlib
import io
import itertools
import os
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators.files import scratch


def listing(root: str, max_depth: int = 20) -> list[str]:
    """Audio files below root, sorted, by this process alone (`walk` asks the executors). Linked directories are not entered; a directory
    at max_depth or deeper gives nothing; hidden names count like others."""
    found, todo = [], [(root, 0)]
    while todo:
        at, depth = todo.pop()
        if depth >= max_depth:
            continue
        with os.scandir(at) as entries:
            for e in entries:
                if e.is_dir(follow_symlinks=False):
                    todo.append((e.path, depth + 1))
                elif e.is_file() and os.path.splitext(e.name)[1].lower() in T.EXTENSIONS:
                    found.append(e.path)
    return sorted(found)


def _id3(data: bytes) -> dict[str, str]:
    """Text frames of an ID3v2.3 or 2.4 header: the first value of each."""
    if data[:3] != b"ID3":
        return {}
    found, at, safe = {}, 10, lambda b: b[0] << 21 | b[1] << 14 | b[2] << 7 | b[3]
    end = 10 + safe(data[6:10])
    while at + 10 <= min(end, len(data)) and data[at] != 0:
        name, raw = data[at : at + 4].decode("latin-1"), data[at + 4 : at + 8]
        size = safe(raw) if data[3] == 4 else int.from_bytes(raw, "big")
        body = data[at + 10 : at + 10 + size]
        if name[0] == "T" and body:
            text = body[1:].decode(("latin-1", "utf-16", "utf-16-be", "utf-8")[body[0] % 4], "replace")
            found.setdefault(name, text.split("\0")[0])
        at += 10 + size
    return found


def _riff(f: io.BufferedReader) -> dict[str, str]:
    """The INFO texts and the ID3 chunk of a WAV."""
    found = {}
    if f.read(4) != b"RIFF" or len(f.read(8)) < 8:
        return found
    while len(head := f.read(8)) == 8:
        size = int.from_bytes(head[4:], "little")
        if head[:4] == b"LIST":
            body, at = f.read(min(size, 1 << 20)), 4
            while body[:4] == b"INFO" and at + 8 <= len(body):
                n = int.from_bytes(body[at + 4 : at + 8], "little")
                found.setdefault(body[at : at + 4].decode("latin-1"), body[at + 8 : at + 8 + n].rstrip(b"\0").decode("utf-8", "replace"))
                at += 8 + n + n % 2
            f.seek(size + size % 2 - len(body), 1)
        elif head[:4].lower() == b"id3 ":
            found |= _id3(f.read(size))
            f.seek(size % 2, 1)
        else:
            f.seek(size + size % 2, 1)
    return found


def _flac(f: io.BufferedReader) -> tuple[dict[str, str], float | None]:
    """The Vorbis comments and length of a FLAC."""
    found, seconds, last = {}, None, f.read(4) != b"fLaC"
    while not last and len(head := f.read(4)) == 4:
        last, kind, body = bool(head[0] & 128), head[0] & 127, f.read(int.from_bytes(head[1:], "big"))
        if kind == 0:
            bits = int.from_bytes(body[10:18], "big")
            seconds = (bits & (1 << 36) - 1) / (bits >> 44) if bits >> 44 else None
        elif kind == 4:
            word = lambda at: int.from_bytes(body[at : at + 4], "little")
            at = 4 + word(0)
            n, at = word(at), at + 4
            for _ in range(n):
                name, _, value = body[at + 4 : at + 4 + word(at)].decode("utf-8", "replace").partition("=")
                found.setdefault(name.upper(), value)
                at += 4 + word(at)
    return found, seconds


# Names of title, artist and album in ID3, WAV INFO and Vorbis comments.
TAGS = {"title": ("TIT2", "INAM", "TITLE"), "artist": ("TPE1", "IART", "ARTIST"), "album": ("TALB", "IPRD", "ALBUM")}


def tags(path: str) -> tuple[str | None, str | None, str | None, float | None]:
    """(title, artist, album, seconds): the first value of each; nulls for what cannot be read, never an error."""
    found, seconds = {}, None
    try:
        with open(path, "rb") as f:
            start = f.read(10)
            if start[:3] == b"ID3":
                f.seek(0)
                found = _id3(f.read(1 << 20))
            f.seek(0)
            if start[:4] == b"fLaC":
                found, seconds = _flac(f)
            elif start[:4] == b"RIFF":
                found = _riff(f)
                with wave.open(path) as w:
                    seconds = w.getnframes() / w.getframerate()
    except Exception:  # files of any kind come here; a broken one has no tags
        pass
    first = [next((found[k] for k in keys if found.get(k)), None) for keys in TAGS.values()]
    return first[0], first[1], first[2], seconds


SCHEMA = "path string, id string, mtime double, title string, artist string, album string, duration_seconds double, error string"


def check_file(path: str) -> None:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if not os.path.isfile(path):
        raise IsADirectoryError(f"{path} is no file")


def check_folder(path: str) -> None:
    if not os.path.exists(path):
        raise FileNotFoundError(path)
    if not os.path.isdir(path):
        raise NotADirectoryError(f"{path} is no folder")


def measured(paths: DataFrame) -> DataFrame:
    """A row a file (path). Only the first bytes of each are read, on the executors."""

    def measure(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for p in frame["path"]:
                try:
                    with open(p, "rb") as f:
                        key = hashlib.sha256(f.read(T.SAMPLE_BYTES)).hexdigest()[: T.ID_LETTERS]
                    rows.append((p, key, os.path.getmtime(p), *tags(p), None))
                except OSError as e:
                    rows.append((p, None, None, None, None, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["path", "id", "mtime", "title", "artist", "album", "duration_seconds", "error"])

    return paths.select("path").mapInPandas(measure, SCHEMA)


def rows_of(spark: SparkSession, paths: list[str]) -> DataFrame:
    """A row a file of a few that are named."""
    n = max(1, min(len(paths), spark.sparkContext.defaultParallelism))
    return measured(spark.createDataFrame([(p,) for p in paths], "path string").repartitionByRange(n, "path"))


def walk(spark: SparkSession, root: str, max_depth: int = 20) -> DataFrame:
    """path of the files that `listing` gives, in its order, found on the executors: each level of directories is dealt by range
    of paths, listed and written to the shared folder, and the directories it holds are the next level. Only whether
    there are any comes to the driver. Folders must be mounted on all executors."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in b.column("path").to_pylist():
                with os.scandir(at) as entries:
                    found = ((e.path, e.is_dir(follow_symlinks=False)) for e in entries if e.is_dir(follow_symlinks=False) or e.is_file() and os.path.splitext(e.name)[1].lower() in T.EXTENSIONS)
                    while some := list(itertools.islice(found, 10_000)):
                        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in some]), pa.array([d for _, d in some])], ["path", "folder"])

    folder, schema = scratch(spark, "walk"), "path string, folder boolean"
    level = spark.createDataFrame([(root,)], "path string")
    found = spark.createDataFrame([], schema)
    for depth in range(max_depth):
        level.repartitionByRange(spark.sparkContext.defaultParallelism, "path").mapInArrow(look, schema).write.parquet(f"{folder}/depth={depth}")
        there = spark.read.schema(schema).parquet(f"{folder}/depth={depth}")
        found, level = found.unionByName(there), there.where("folder").select("path")
        if level.isEmpty():
            break
    return found.where("NOT folder").select("path").orderBy("path")


def scan(spark: SparkSession, root: str, max_depth: int = 20) -> DataFrame:
    """A row a file of a library, partitions in the order of paths."""
    check_folder(root)
    return measured(walk(spark, root, max_depth))


def resampled(x: np.ndarray, own: int, rate: int, half: int = 16) -> np.ndarray:
    """Windowed-sinc interpolation, low-passed at the lower of both Nyquist rates."""
    if own == rate or not len(x):
        return x
    low = min(1.0, rate / own)
    reach = int(np.ceil(half / low))
    out = np.empty(int(len(x) * rate / own))
    wide = np.pad(x.astype(np.float64), reach + 1)
    for at in range(0, len(out), 1 << 14):
        t = np.arange(at, min(at + (1 << 14), len(out))) * own / rate
        first = np.floor(t).astype(np.int64) - reach + 1
        d = t[:, None] - (first[:, None] + np.arange(2 * reach))
        w = np.sinc(d * low) * low * np.where(np.abs(d) < reach, 0.5 + 0.5 * np.cos(np.pi * d / reach), 0)
        out[at : at + len(t)] = (wide[first[:, None] + np.arange(2 * reach) + reach + 1] * w).sum(1)
    return out


def clip(content: bytes, rate: int = 22_050, seconds: float = 180.0, start: float = 0.10) -> np.ndarray:
    """Mono float32 of a PCM WAV (8, 16, 24 or 32 bits), from start of its length on, at most `seconds`."""
    with wave.open(io.BytesIO(content)) as w:
        own, n, width, channels = w.getframerate(), w.getnframes(), w.getsampwidth(), w.getnchannels()
        offset = int(n * start)
        w.setpos(offset)
        data = w.readframes(min(n - offset, int(seconds * own)))
    if width == 1:
        x = (np.frombuffer(data, np.uint8).astype(np.float32) - 128) / 128
    else:
        raw = np.zeros((len(data) // width, 4), np.uint8)
        raw[:, 4 - width :] = np.frombuffer(data, np.uint8).reshape(-1, width)  # the upper bytes of 32 bits
        x = raw.view("<i4")[:, 0] / np.float64(1 << 31)
    return resampled(x.reshape(-1, channels).mean(1), own, rate).astype(np.float32)


def tsv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.csv(path, sep="\t", header=True, escape='"', multiLine=True)


def dataset_tsv(lines: DataFrame, line: str = "value", shortest: float = 10.0) -> DataFrame:
    """track_id, path, duration, tags of dataset lines: blank lines, headers, lines with
    fewer than five fields, and durations that are no number or below `shortest` are dropped."""
    f = F.split(F.col(line), "\t")
    rows = lines.where((F.trim(line) != "") & ~F.col(line).startswith("TRACK_ID") & (F.size(f) >= 5))
    return rows.select(T.numeric_id(f[0]).alias("track_id"), f[3].alias("path"), f[4].try_cast("double").alias("duration"), T.tag_names(F.get(f, F.lit(5))).alias("tags")).where(F.col("duration") >= shortest)


REGISTRY = "schema_version int, indexes array<struct<name string, description string, embedder string, tracks long, url string, sha256 string, size_bytes long>>"


def registry_rows(entries: DataFrame) -> DataFrame:
    """Entries (`at` their place, and the fields) with size_mb; one that lacks a field fails."""
    fields = [c for c in entries.columns if c != "at"]
    bad = F.greatest(*[F.col(c).isNull().cast("int") for c in fields]) == 1
    return entries.where(F.when(bad, F.raise_error(F.lit("a registry entry lacks a field")).cast("boolean")).otherwise(True)).withColumn("size_mb", T.megabytes(F.col("size_bytes")))


def registry(spark: SparkSession, path: str) -> DataFrame:
    """Index entries of a registry file; extra keys are dropped, missing ones fail."""
    return registry_rows(spark.read.schema(REGISTRY).option("multiLine", True).json(path).select(F.posexplode("indexes").alias("at", "e")).select("at", "e.*"))
