"""A stored index: vectors and catalog in one log of changes, with the sums behind the centroid.

Each version keeps the number of its vectors and their compensated component sums. A change reads
the old vectors of its own keys, takes them out of the sums and adds the new ones, so the centroid
of any version is known without a pass over the rows. If another writer publishes first, the
change is worked out anew from that version.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import blocks, kernel, store
from .catalog import Catalog
from .delta import Conflict, Log, Moved
from .index import VectorIndex
from .moments import Sums, sums

ATTEMPTS = 20
CHANGED = 10_000  # ids that a search leaves out of the blocks by itself


@dataclass
class StoredIndex:
    log: Log
    embedder: str
    dim: int

    @classmethod
    def create(cls, index: VectorIndex, root: str, embedder: str, catalog: DataFrame | None = None, after: int | None = None, library: str = "", audio: dict | None = None) -> StoredIndex:
        """A whole version from an index of one row an id. audio: how its embedder loads sound."""
        spark = index.rows.sparkSession
        tables = {"vectors": index.rows} | ({"catalog": catalog} if catalog is not None else {})
        store.save(root, tables, embedder, index.dim, after, library, {"sums": sums(index.rows, index.dim).to_json(), "audio": audio or {}})
        return cls(Log(spark, root), embedder, index.dim)

    @classmethod
    def open(cls, spark: SparkSession, root: str, embedder: str | None = None) -> StoredIndex:
        at = store.checked(spark, root, embedder)
        return cls(Log(spark, root), at["embedder"], at["dim"])

    def index(self, number: int | None = None) -> VectorIndex:
        """The vectors of a version with what is known of their sums; of a version that was saved without, they are found by a pass."""
        head = self.log.version(number)
        found = head["facts"].get("sums")
        return VectorIndex(self.log.read("vectors", head["number"]), self.dim, Sums.from_json(found) if found else None)

    def change(self, upserts: DataFrame | None = None, removed: DataFrame | None = None, catalog: DataFrame | None = None, order: str | None = None, strict: bool = True, writer: tuple[str, int] | None = None, more: Callable[[int], tuple[dict, dict]] | None = None) -> int:
        """One version: vectors (id, v) upserted as VectorIndex.upsert does, ids removed from the vectors and the catalog,
        catalog rows upserted. more: from the number of the version it is based on, further upserts and removed keys by table."""
        new = None
        if upserts is not None:
            last = F.max_by("v", order) if order else F.max("v")
            new = VectorIndex.of(upserts, self.dim, strict=strict, extra=[order] if order else []).rows.groupBy("id").agg(last.alias("v"))
        gone = None if removed is None else removed.select("id").distinct()
        if gone is not None and new is not None:
            gone = gone.join(new.select("id"), "id", "left_anti")
        for _ in range(ATTEMPTS):
            head = self.log.version()
            if writer and head["facts"].get("writers", {}).get(writer[0], -1) >= writer[1]:
                return head["number"]
            keys = None
            for part in (new, gone):
                if part is not None:
                    keys = part.select("id") if keys is None else keys.unionByName(part.select("id"))
            facts = None
            if keys is not None:
                old = self.log.rows_of("vectors", keys).select("v", F.lit(-1).alias("sign"))
                both = old if new is None else old.unionByName(new.select("v", F.lit(1).alias("sign")))
                start = Sums.from_json(head["facts"]["sums"]) if "sums" in head["facts"] else sums(self.log.read("vectors", head["number"]), self.dim)
                then = start.plus(sums(both, self.dim, signs="sign")).to_json()
                facts = lambda f, then=then: f | {"sums": then}
            up, out = more(head["number"]) if more else ({}, {})
            up |= ({"vectors": new} if new is not None else {}) | ({"catalog": catalog} if catalog is not None else {})
            if gone is not None:
                out |= {"vectors": gone} | ({"catalog": gone} if "catalog" in head["tables"] else {})
            try:
                return self.log.change(up, out, facts, writer, head["number"])
            except Moved:
                continue
        raise Conflict(f"other writers were first {ATTEMPTS} times")

    def pack(self) -> int:
        """Packs the vectors into blocks (operators/blocks.py) that searches skip; changes that come later are searched beside them."""
        self.log.compact("vectors", whole=True)
        head = self.log.version()
        made = blocks.pack(self.log.read("vectors", head["number"]), self.dim)
        return self.log.put({"blocks": (made, "block")}, {"packed": head["tables"]["vectors"]["base"]["folder"]}, head["number"])

    def search(self, queries: DataFrame, k: int = 10) -> tuple[DataFrame, blocks.Found | None]:
        """query_id, id, raw_score, rank of the k best rows of each query (query_id, v), never the query's own id; and what the blocks
        tell, where the vectors are packed and at most CHANGED of them have changed since."""
        head = self.log.version()
        table, index = head["tables"]["vectors"], self.index(head["number"])
        if "blocks" not in head["tables"] or head["facts"].get("packed") != table["base"]["folder"]:
            return index.search_batch(queries, k), None
        packed = self.log.read("blocks", head["number"])
        if not table["deltas"]:
            found = blocks.top(packed, queries, k, index.centre, self.dim)
            return found.rows, found
        last = self.log.changed("vectors", head["number"])
        ids = [r[0] for r in last.select("id").limit(CHANGED + 1).collect()]
        if len(ids) > CHANGED:
            return index.search_batch(queries, k), None
        found = blocks.top(packed, queries, k, index.centre, self.dim, ids)
        other = kernel.top(last.where("NOT _gone").select("id", "v"), queries, k, index.centre, self.dim)
        order = Window.partitionBy("query_id").orderBy(F.desc("raw_score"), "id")
        both = found.rows.drop("rank").unionByName(other.drop("rank"))
        return both.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k), found

    def catalog(self) -> Catalog:
        return Catalog(self.log.read("catalog"))

    def compact(self, whole: bool = False) -> None:
        for name in self.log.version()["tables"]:
            self.log.compact(name, whole)
