"""Keyed tables as a bucketed base and a log of changes that are merged when they are read.

A change writes its own rows only: a folder of upserted and removed keys, and one small file in
root/log that names everything the version consists of. That file is created by one writer alone
(on HDFS, local disks and stores with conditional puts; a store that overwrites silently needs
a lock); a writer that comes second puts its folder behind the other's and tries again.

Reading joins the base with the keys that changed. The base is written in buckets of the key, so
only the changes are dealt anew, never the base; its bucket files are registered as a table under
a name of their own in the session's catalog. Of a key the last change counts.

Folders of changes are put together by size: the newest ones that weigh as much as what lies
before them become one folder, and when all weigh `REWRITE` of the base a new base is written, so
a row is rewritten a number of times that grows with the logarithm of the table. Versions before
the last `keep` are expired with the folders that only they name.

Values of `facts` (small JSON) go with each version: the embedder of an index, the sums behind
its centroid, the last batch of each stream. Empty changes are commits too. Keys are never null
(rows without one fail the write). Columns beside the key have any name but _gone and _at.
"""

from __future__ import annotations

import datetime
import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .files import at as _fs
from .files import remove

BUCKETS = 16
REWRITE = 0.5  # of the base's bytes, from which on changes become part of it
FAN = 4  # folders that are put together at least


class Conflict(RuntimeError):
    pass


class Moved(Conflict):
    """Another version came after the one that a change is based on."""


class Unknown(KeyError):
    pass


class Log:
    """The tables of one root."""

    def __init__(self, spark: SparkSession, root: str, buckets: int = BUCKETS):
        self.spark, self.root, self.buckets = spark, root.rstrip("/"), buckets

    # versions
    def numbers(self) -> list[int]:
        fs, at = _fs(self.spark, f"{self.root}/log")
        names = [s.getPath().getName() for s in fs.listStatus(at)] if fs.exists(at) else []
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def version(self, number: int | None = None) -> dict:
        """What a version consists of; the last one, if no number is given. Before the first: no tables."""
        known = self.numbers()
        if number is not None and number not in known:
            raise Unknown(f"no version {number}")
        if not known:
            return {"number": 0, "tables": {}, "facts": {}}
        fs, at = _fs(self.spark, f"{self.root}/log/{number or known[-1]:012d}.json")
        stream = fs.open(at)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def _publish(self, head: dict) -> bool:
        """Whether this version is the one of its number."""
        fs, at = _fs(self.spark, f"{self.root}/log/{head['number']:012d}.json")
        head["built_at"] = datetime.datetime.now(datetime.timezone.utc).isoformat()
        try:
            out = fs.create(at, False)
        except Py4JJavaError:
            if fs.exists(at):
                return False
            raise
        out.write(bytearray(json.dumps(head).encode()))
        out.close()
        return True

    def commit(self, change: Callable[[dict], dict | None], attempts: int = 20) -> int:
        """Publishes what `change` makes of the last version, again if another writer was first; None: nothing to do."""
        for _ in range(attempts):
            head = self.version()
            made = change(json.loads(json.dumps(head)))
            if made is None:
                return head["number"]
            if self._publish(made | {"number": head["number"] + 1}):
                return head["number"] + 1
        raise Conflict(f"other writers were first {attempts} times")

    # folders
    def _weight(self, folder: str) -> int:
        fs, at = _fs(self.spark, f"{self.root}/data/{folder}")
        return int(fs.getContentSummary(at).getLength()) if fs.exists(at) else 0

    def _table(self, name: str) -> str:
        return f"tessella_{name.replace('-', '_')}"

    def _write_base(self, df: DataFrame, name: str, key: str) -> dict:
        folder = f"{name}-{uuid.uuid4().hex}"
        self._checked(df, key).repartition(self.buckets, key).write.format("parquet").bucketBy(self.buckets, key).sortBy(key).option("path", f"{self.root}/data/{folder}").saveAsTable(self._table(folder))
        return {"folder": folder, "bytes": self._weight(folder), "buckets": self.buckets}

    def _read_base(self, table: dict) -> DataFrame:
        base, name = table["base"], self._table(table["base"]["folder"])
        kind = StructType.fromJson(table["schema"])
        if not self.spark.catalog.tableExists(name):
            columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kind)
            self.spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY (`{table['key']}`) SORTED BY (`{table['key']}`) INTO {base['buckets']} BUCKETS LOCATION '{self.root}/data/{base['folder']}'")
        return self.spark.table(name).select(*kind.names)

    def _checked(self, df: DataFrame, key: str) -> DataFrame:
        bad = F.raise_error(F.lit("a row without a key")).cast("boolean")
        return df.where(F.when(F.col(key).isNotNull(), True).otherwise(bad))

    def _write_delta(self, table: dict, name: str, rows: DataFrame) -> dict:
        folder = f"{name}-{uuid.uuid4().hex}"
        self._checked(rows, table["key"]).write.parquet(f"{self.root}/data/{folder}")
        return {"folder": folder, "bytes": self._weight(folder)}

    def _delta_schema(self, table: dict) -> StructType:
        return StructType.fromJson(table["schema"]).add("_gone", "boolean")

    def _changed(self, table: dict, deltas: list[dict]) -> DataFrame:
        """The last change of each key in these folders, with _gone."""
        kind, key = self._delta_schema(table), table["key"]
        if not deltas:
            return self.spark.createDataFrame([], kind)
        rows = None
        for i, d in enumerate(deltas):
            one = self.spark.read.schema(kind).parquet(f"{self.root}/data/{d['folder']}").withColumn("_at", F.lit(i))
            rows = one if rows is None else rows.unionByName(one)
        if len(deltas) == 1:
            return rows.drop("_at")
        rest = [c for c in kind.names if c != key]
        last = rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_at").alias("_row"))
        return last.select(key, *[F.col(f"_row.`{c}`").alias(c) for c in rest]).select(*kind.names)

    # tables
    def read(self, name: str, number: int | None = None) -> DataFrame:
        """The rows of a table, at its last or another version that is kept."""
        head = self.version(number)
        if name not in head["tables"]:
            raise Unknown(f"no table {name} at {self.root}")
        table = head["tables"][name]
        base = self._read_base(table)
        if not table["deltas"]:
            return base
        last = self._changed(table, table["deltas"])
        stay = base.join(last.select(F.col(table["key"])), table["key"], "left_anti").select(*base.columns)
        return stay.unionByName(last.where("NOT _gone").drop("_gone"))

    def changed(self, name: str, number: int | None = None) -> DataFrame:
        """The last change of each key since the base was written; _gone where it is removed."""
        table = self.version(number)["tables"][name]
        return self._changed(table, table["deltas"])

    def rows_of(self, name: str, keys: DataFrame) -> DataFrame:
        """The rows of these keys (a column of the key's name, distinct): only they are read of the base's sorted files where they are few."""
        key = self.version()["tables"][name]["key"]
        few = [r[0] for r in keys.limit(1001).collect()]
        rows = self.read(name)
        return rows.where(F.col(key).isin(few)) if len(few) <= 1000 else rows.join(keys.select(key), key, "left_semi")

    def replace(self, tables: dict[str, tuple[DataFrame, str]], facts: dict | None = None, based: int | None = None) -> int:
        """New bases for these tables (rows and key, one row a key); tables that are not named go. based: as for change."""
        made = self._bases(tables)
        return self.commit(lambda head: self._still(head, based) and {"tables": made, "facts": facts or {}})

    def put(self, tables: dict[str, tuple[DataFrame, str]], facts: dict, based: int | None = None) -> int:
        """New bases for these tables, and these facts beside the others; other tables stay."""
        made = self._bases(tables)
        return self.commit(lambda head: self._still(head, based) and {"tables": head["tables"] | made, "facts": head["facts"] | facts})

    @staticmethod
    def _kind(df: DataFrame) -> StructType:
        """df's columns; elements may be null, as files have it."""
        return StructType.fromDDL(", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema))

    def _bases(self, tables: dict[str, tuple[DataFrame, str]]) -> dict:
        return {name: {"key": key, "schema": self._kind(df).jsonValue(), "base": self._write_base(df, name, key), "deltas": []} for name, (df, key) in tables.items()}

    @staticmethod
    def _still(head: dict, based: int | None) -> bool:
        if based is not None and head["number"] != based:
            raise Moved(f"version {head['number']} came after {based}")
        return True

    def change(self, upserts: dict[str, DataFrame] | None = None, removed: dict[str, DataFrame] | None = None, facts: Callable[[dict], dict] | None = None, writer: tuple[str, int] | None = None, based: int | None = None) -> int:
        """One version with these rows upserted (one row a key) and these keys removed; a key of both stays as upserted.
        writer: a stream and its batch; a batch that is there already changes nothing. facts: the new facts from the old ones.
        based: the version this change was worked out from; if another one came, Moved is raised and nothing changes."""
        head = self.version()
        if writer and head["facts"].get("writers", {}).get(writer[0], -1) >= writer[1]:
            return head["number"]
        made = {}
        for name in {**(upserts or {}), **(removed or {})}:
            if name not in head["tables"]:
                raise Unknown(f"no table {name} at {self.root}")
            table = head["tables"][name]
            kind, key = StructType.fromJson(table["schema"]), table["key"]
            new = (upserts or {}).get(name)
            gone = (removed or {}).get(name)
            rows = None if new is None else new.select(*[F.col(f"`{f.name}`").cast(f.dataType).alias(f.name) for f in kind], F.lit(False).alias("_gone"))
            if gone is not None:
                gone = gone.select(F.col(key).cast(kind[key].dataType)).distinct()
                gone = gone if new is None else gone.join(new.select(key), key, "left_anti")
                gone = gone.select(*[F.col(key) if f.name == key else F.lit(None).cast(f.dataType).alias(f.name) for f in kind], F.lit(True).alias("_gone"))
                rows = gone if rows is None else rows.unionByName(gone)
            made[name] = self._write_delta(table, name, rows)

        def append(head: dict) -> dict | None:
            seen = head["facts"].setdefault("writers", {})
            if writer and seen.get(writer[0], -1) >= writer[1]:
                return None
            self._still(head, based)
            for name, delta in made.items():
                head["tables"][name]["deltas"].append(delta)
            head["facts"] = facts(head["facts"]) if facts else head["facts"]
            if writer:
                head["facts"].setdefault("writers", {})[writer[0]] = writer[1]
            return head

        return self.commit(append)

    # upkeep
    def plan(self, table: dict) -> int | None:
        """From which folder of changes on to put together; -1: all of them and the base; None: nothing."""
        sizes = [d["bytes"] for d in table["deltas"]]
        if not sizes:
            return None
        if sum(sizes) >= REWRITE * table["base"]["bytes"]:
            return -1
        at, weight = len(sizes) - 1, sizes[-1]
        while at and sizes[at - 1] <= 2 * weight:
            at -= 1
            weight += sizes[at]
        return at if len(sizes) - at >= FAN else None

    def compact(self, name: str, whole: bool = False) -> int:
        """Puts folders of changes together by their size, or with whole all of them and the base. Changes that others
        publish meanwhile stay behind; if others have rewritten the same folders, nothing changes."""
        head = self.version()
        table = head["tables"][name]
        at = -1 if whole else self.plan(table)
        if at is None:
            return head["number"]
        old = table["deltas"][max(at, 0) :]
        if at < 0:
            base = self._write_base(self.read(name, head["number"] or None), name, table["key"])
        else:
            delta = self._write_delta(table, name, self._changed(table, old))

        def swap(now: dict) -> dict | None:
            its = now["tables"].get(name)
            if its is None or its["base"] != table["base"] or its["deltas"][: len(table["deltas"])] != table["deltas"]:
                return None
            later = its["deltas"][len(table["deltas"]) :]
            its |= {"base": base, "deltas": later} if at < 0 else {"deltas": [*table["deltas"][:at], delta, *later]}
            return now

        return self.commit(swap)

    def expire(self, keep: int = 2, grace: float = 86_400.0) -> list[str]:
        """Versions before the last `keep` go, and folders that no kept one names and that are older than `grace`
        seconds (a writer may be about to name younger ones). Gives the folders."""
        numbers = self.numbers()
        kept = [self.version(n) for n in numbers[-keep:]]
        named = {f["folder"] for v in kept for t in v["tables"].values() for f in (t["base"], *t["deltas"])}
        for n in numbers[:-keep]:
            remove(self.spark, f"{self.root}/log/{n:012d}.json")
        fs, at = _fs(self.spark, f"{self.root}/data")
        gone = []
        for s in fs.listStatus(at) if fs.exists(at) else []:
            folder = s.getPath().getName()
            if folder not in named and time.time() - s.getModificationTime() / 1000 >= grace:
                try:
                    self.spark.sql(f"DROP TABLE IF EXISTS {self._table(folder)}")
                except AnalysisException:  # a table of this session's catalog whose folder is gone
                    pass
                remove(self.spark, f"{self.root}/data/{folder}")
                gone.append(folder)
        return sorted(gone)
