"""Files of a store by Hadoop's file systems."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def at(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def remove(spark: SparkSession, path: str) -> None:
    fs, where = at(spark, path)
    fs.delete(where, True)


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh path in the folder that the driver and all executors share (spark.checkpoint.dir). Where the
    session names none, a temporary folder on a single machine; a cluster has to name one."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        shared = tempfile.mkdtemp(prefix="tessella-")
    return f"{shared.rstrip('/')}/tessella/{name}-{uuid.uuid4().hex}"
