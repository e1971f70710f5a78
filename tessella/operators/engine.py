"""Search over a library: routes a source, embeds it, ranks, and joins the catalog.

A file is found by its content, so a query that is in the library, from whatever
path, leaves itself out; urls and texts never do. Ranks are given before the
catalog join, so ids that the catalog lacks leave gaps.
"""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import embed as E
from ..functions import resolve, text as T
from . import store
from .catalog import Catalog, FIELDS
from .index import VectorIndex
from .stored import StoredIndex

TOP, SCORES = (1, 100), (-1.0, 1.0)


class BadRequest(ValueError):
    pass


class NoIndex(RuntimeError):
    pass


def check_request(source: str, top_k: int, min_score: float) -> None:
    """What an API must refuse before it searches."""
    if not source or not source.strip():
        raise BadRequest("source is empty")
    if source.startswith("file://"):
        raise BadRequest("file:// sources are not served")
    if not TOP[0] <= top_k <= TOP[1]:
        raise BadRequest(f"top_k is not within {TOP[0]} to {TOP[1]}")
    if not SCORES[0] <= min_score <= SCORES[1]:
        raise BadRequest(f"min_score is not within {SCORES[0]} to {SCORES[1]}")


def status_of(error: Exception) -> int:
    """The HTTP status of an error; the narrower classes first."""
    if isinstance(error, NoIndex):
        return 503
    if isinstance(error, BadRequest | resolve.UnsupportedSource | resolve.PreviewUnavailable | E.TextUnsupported):
        return 422
    return 502 if isinstance(error, resolve.ResolverError) else 500


def api_rows(found: DataFrame, files: DataFrame | None = None) -> DataFrame:
    """The ten fields of an API result; has_audio where the path is in files (path)."""
    if files is None:
        found = found.withColumn("has_audio", F.lit(False))
    else:
        there = files.select(F.col("path").alias("_there")).distinct()
        found = found.join(there, F.col("path") == F.col("_there"), "left").withColumn("has_audio", F.col("_there").isNotNull())
    return found.select("rank", F.round("score", 6).alias("score"), F.round("raw_score", 6).alias("raw_score"), F.col("id").alias("track_id"), "title", "artist", "album", F.col("duration_seconds").alias("duration"), "has_audio", "extra")


def json_rows(found: DataFrame) -> DataFrame:
    """rank and line: the JSON objects that a command line prints."""
    line = F.to_json(F.struct("rank", F.round("score", 6).alias("score"), F.round("raw_score", 6).alias("raw_score"), "title", "artist", "path"), {"ignoreNullFields": "false"})
    return found.select("rank", line.alias("line"))


@dataclass
class Engine:
    """ids: which track id each id of the index stands for (id, track string); None where they are the same."""

    index: VectorIndex
    catalog: Catalog
    ids: DataFrame | None
    embedder: str
    chain: resolve.Chain = field(default_factory=resolve.Chain)

    @classmethod
    def load(cls, spark, root: str, embedder: str | None = None) -> Engine:
        if store.current(spark, root) is None:
            raise NoIndex(f"no index at {root}")
        held = StoredIndex.open(spark, root, embedder)
        return cls(held.index(), Catalog(held.log.read("catalog")), None, held.embedder)

    def _embed_file(self, path: str) -> list[float]:
        make, dim = E.find(self.embedder)
        with open(path, "rb") as f:
            content = f.read()
        return E.checked(make()(path, content), dim).astype(float).tolist()

    def search(self, source: str, k: int = 10, least: float = -1.0) -> DataFrame:
        """rank, score, raw_score and the track of each result."""
        exclude = None
        if "://" in source:
            with self.chain.open(source) as found:
                query = self._embed_file(found.path)
        elif os.path.exists(path := os.path.expanduser(source)):
            with open(path, "rb") as f:
                key = hashlib.sha256(f.read(T.SAMPLE_BYTES)).hexdigest()[: T.ID_LETTERS]
            query = self._embed_file(path)
            if not self.catalog.get(key).isEmpty():
                exclude = [key] if self.ids is None else [r["id"] for r in self.ids.where(F.col("track") == key).collect()]  # one track
        else:
            query = E.embed_text(self.embedder, source).astype(float).tolist()
        return self.results(self.index.search(query, k, least, exclude))

    def like(self, track: str, k: int = 10, least: float = -1.0) -> DataFrame:
        if self.ids is None:
            return self.results(self.index.like(track, k, least))
        one = self.ids.where(F.col("track") == track).first()
        return self.results(self.index.like(one["id"] if one else -1, k, least))

    def results(self, ranked: DataFrame) -> DataFrame:
        tracks = self.catalog.rows.select(*FIELDS)
        named = ranked.withColumnRenamed("id", "track") if self.ids is None else ranked.join(self.ids, "id").drop("id")
        return named.join(tracks, F.col("track") == F.col("id")).select("rank", "score", "raw_score", *FIELDS).orderBy("rank")
