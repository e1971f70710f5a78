"""Continuous indexing: a stream of vectors is a log of changes, a folder of its own rows a batch.

A batch costs what its rows cost: it writes them, and reads the old vectors of its ids for the sums
behind the centroid. The version that it publishes names the stream and the batch, so a batch that
is repeated after a failure changes nothing. Folders of changes are put together by size as
they come.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import vectors as V
from ..operators import store
from ..operators.index import VectorIndex
from ..operators.stored import StoredIndex


def index_stream(spark: SparkSession, rows: DataFrame, root: str, checkpoint: str, embedder: str, dim: int, name: str = "vectors") -> StreamingQuery:
    """rows: a stream of id, v, seq and, if it removes rows too, gone (boolean). Of one id the highest seq of a batch wins,
    a later batch over an earlier one; where that one is gone, the id is removed. Bad vectors stay out. name: the stream's
    in the store, of which each has its own."""
    gone = F.coalesce(F.col("gone"), F.lit(False)) if "gone" in rows.columns else F.lit(False)

    def merge(batch: DataFrame, number: int) -> None:
        its = batch.sparkSession
        fit = batch.select("id", V.doubles(F.col("v")).alias("v"), "seq", gone.alias("gone")).where(F.col("gone") | V.problem(F.col("v"), dim).isNull())
        last = fit.groupBy("id").agg(F.max_by(F.struct("v", "gone"), "seq").alias("row")).select("id", "row.v", "row.gone")
        if store.current(its, root) is None:
            nothing = VectorIndex(its.createDataFrame([], last.select("id", "v").schema), dim)
            StoredIndex.create(nothing, root, embedder, after=0)
        held = StoredIndex.open(its, root, embedder)
        held.change(last.where("NOT gone").select("id", "v"), last.where("gone").select("id"), writer=(name, number))
        held.compact()

    return rows.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
