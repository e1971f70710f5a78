"""Tables and files that outlive an executor, in the folder spark.checkpoint.dir."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from urllib.parse import urlparse
from urllib.request import url2pathname

from pyspark.sql import DataFrame, SparkSession


# TIDY: shuffle files go with the query. While a table is written besides: rows of long values come to Python in small batches
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}
WRITING = TIDY | {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000"}
_made: ContextVar[list[str] | None] = ContextVar("made", default=None)


def root(spark: SparkSession) -> str:
    """The shared folder of this cluster. Where the session names none, a temporary folder is
    set for a session on a single machine (tests); a cluster has to name one."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("tessella.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        found = tempfile.mkdtemp(prefix="tessella-")
        spark.conf.set("tessella.checkpoint.dir", found)
    return found.rstrip("/")


def folder(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{root(spark)}/tessella/{name}-{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, wanted: dict[str, str]) -> Iterator[None]:
    """The session with these settings, which are put back at the end."""
    was = {k: spark.conf.get(k) for k in wanted}
    try:
        for k, v in wanted.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def table(df: DataFrame, name: str) -> DataFrame:
    """df written to the shared folder and read again: its lineage ends there. The shuffle
    files behind it go when it is written."""
    spark, path = df.sparkSession, folder(df.sparkSession, name)
    if (made := _made.get()) is not None:
        made.append(path)
    with settings(spark, WRITING):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._shared_path = path
    return out


def remove(spark: SparkSession, path: str) -> None:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def drop(df: DataFrame) -> None:
    """A table that nothing reads any more goes."""
    if (made := _made.get()) is not None and df._shared_path in made:
        made.remove(df._shared_path)
    remove(df.sparkSession, df._shared_path)


@contextmanager
def temporary(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Tables made inside go at the end, but for those handed to the function it gives."""
    own, kept = [], []
    mark = _made.set(own)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(df._shared_path)
        return df

    try:
        yield keep
    finally:
        _made.reset(mark)
        for path in own:
            if path not in kept:
                remove(spark, path)
        if (outer := _made.get()) is not None:
            outer.extend(kept)


def local(path: str) -> str:
    """The path by which Python opens a file of the shared folder. Executors map
    model files into memory, so the folder has to be mounted (file: or no scheme)."""
    parts = urlparse(path)
    if parts.scheme not in ("", "file"):
        raise ValueError(f"model files are memory-mapped: spark.checkpoint.dir must be a mounted folder, not {path}")
    return url2pathname(parts.path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
