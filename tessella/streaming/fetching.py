"""Fetching a stream of urls: a queue a host in keyed state, with timers, rates and Retry-After.

Urls wait in the state of their host. A timer wakes the host when it may be asked again; it is asked
for one url after the other, never faster than its rate, for at most `hold` seconds, and
waits for the next timer. A host that answers 429 rests for Retry-After and a second more; transport
errors are tried again after 1, 2, 4 ... seconds, at most `attempts` times; other statuses above 399 are
errors at once. When the host may be asked again is state too, so a restart keeps to the rate.

A file is put in place whole, and one that is there is not fetched, so what a lost task had fetched
is not fetched again and what it had not is still in the queue. The result of a key may come again after
a restart, with the same path. One host is one task at a time: its rate is the limit, not its task.
Rows without key or url are dropped; keys that are no file names, and urls without a host, are errors.
"""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..sources.remote import Get

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FOUND = "key string, path string, size long, error string"


def ready(spark: SparkSession) -> None:
    """Timers need this state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Fetcher(StatefulProcessor):
    def __init__(self, folder: str, get: Get, per_second: float, attempts: int, cap: int, hold: float, suffix: str, now: Callable[[], float] = time.time, sleep: Callable[[float], None] = time.sleep):
        self.folder, self.get, self.gap, self.attempts = folder, get, 1 / per_second, attempts
        self.cap, self.hold, self.suffix, self.now, self.sleep = cap, hold, suffix, now, sleep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.queue = handle.getListState("queue", "key string, url string, tries int")
        self.next = handle.getValueState("next", "at double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        found = []
        for frame in rows:
            found += [(k, u, 0) for k, u in zip(frame["key"], frame["url"], strict=True) if k is not None]
        if found:
            self.queue.appendList(found)
            if not list(self.handle.listTimers()):
                self._wake(timerValues)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        waiting = list(self.queue.get()) if self.queue.exists() else []
        at, end, out = self._at(), self.now() + self.hold, []
        while waiting and (at <= self.now() or at <= end):
            self.sleep(max(0.0, at - self.now()))
            one, waiting = waiting[0], waiting[1:]
            row, rest = self._fetch(one[0], one[1])
            at = self.now() + (self.gap if rest is None else max(self.gap, rest))
            if row is not None:
                out.append(row)
            elif one[2] + 1 >= self.attempts:
                out.append((one[0], None, None, f"no answer after {self.attempts} attempts"))
            else:
                waiting.append((one[0], one[1], one[2] + 1))
            if self.now() >= end:
                break
        self.next.update((at,))
        if waiting:
            self.queue.put(waiting)
            self._wake(timerValues)
        else:
            self.queue.clear()
        if out:
            yield pd.DataFrame(out, columns=["key", "path", "size", "error"]).astype({"size": "Int64"})

    def _at(self) -> float:
        return self.next.get()[0] if self.next.exists() else 0.0

    def _wake(self, timer_values) -> None:
        self.handle.registerTimer(max(int(self._at() * 1000), timer_values.getCurrentProcessingTimeInMs() + 1))

    def _fetch(self, key: str, url: str) -> tuple[tuple | None, float | None]:
        """The result of a key, or none if it is to be tried again; and how long the host rests."""
        if "/" in key or key in ("", ".", ".."):
            return (key, None, None, "the key is no file name"), 0.0
        path = os.path.join(self.folder, f"{key}{self.suffix}")
        try:
            if os.path.exists(path):
                return (key, path, os.path.getsize(path), None), 0.0
            status, headers, body = self.get(url)
            if status == 429:
                return None, float(headers.get("Retry-After", 1)) + 1
            if status >= 400:
                return (key, None, None, f"status {status}"), None
            part = f"{path}.{os.getpid()}.part"
            with open(part, "wb") as f:
                f.write(body[: self.cap])
            os.replace(part, path)
            return (key, path, len(body[: self.cap]), None), None
        except OSError:
            return None, 1.0

    def close(self) -> None:
        pass


def fetched(urls: DataFrame, folder: str, get: Get, per_second: float = 1.0, attempts: int = 4, cap: int = 6 << 20, hold: float = 2.0, key: str = "track_id", url: str = "preview_url", suffix: str = ".mp3") -> DataFrame:
    """key, path, size, error of a stream of urls, as they come; each host is asked at most `per_second` times a second.
    folder: shared by all executors. The stream's trigger has to go on by itself (processingTime), for the timers."""
    ready(urls.sparkSession)
    rows = urls.select(F.col(key).cast("string").alias("key"), F.col(url).alias("url")).where("key IS NOT NULL AND url IS NOT NULL")
    rows = rows.withColumn("host", F.lower(F.regexp_extract("url", r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)))
    # a row a second of no host: without it a restarted stream would sleep until urls come, whatever timers it has
    beat = urls.sparkSession.readStream.format("rate").load().select(*[F.lit(None).cast("string").alias(c) for c in ("key", "url")], F.lit("").alias("host"))
    return rows.unionByName(beat).groupBy("host").transformWithStateInPandas(Fetcher(folder, get, per_second, attempts, cap, hold, suffix), FOUND, "Update", "ProcessingTime")
