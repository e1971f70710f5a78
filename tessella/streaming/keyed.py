"""One row a key of a stream: the first or the last by event time, with state that expires.

keep_first gives each key's earliest row once, when the watermark has passed it, so none can come
before it. keep_last gives a key's latest row in every batch that brings a later one; whoever
takes the last of what it gives has what the batch operator gives. Ties of time go to the smaller
`order` for the first, to the greater one for the last.

A key's state goes when the watermark is `expiry` behind its time (that of the row it gave, or the
latest); a row that comes after that is a new key. With an expiry longer than a key lives,
the results are those of operators/tables.py. Rows behind the watermark (later than `delay`
after the latest event seen) are late: Spark drops them before state. Rows without key or time are dropped.
Times without a zone are the session's.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.types import StructType
WHOLE = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}  # times to the microsecond


def _keyed(rows: DataFrame, key: str, time: str, order: str, delay: str, run: Callable) -> DataFrame:
    shape = StructType.fromJson(rows.schema.jsonValue())
    body = F.to_json(F.struct(*rows.columns), WHOLE)
    at = F.col(time).cast("timestamp")
    # the state is the place of the row in its order, and the row
    thin = rows.where(F.col(key).isNotNull() & at.isNotNull()).select(F.col(key).alias("key"), at.alias("at"), F.unix_micros(at).alias("micros"), F.col(order).cast("long").alias("place"), body.alias("row"))
    thin = thin.withWatermark("at", delay)
    out = thin.groupBy("key").applyInPandasWithState(run, "row string", "micros long, place long, row string, given boolean", "update", GroupStateTimeout.EventTimeTimeout)
    return out.select(F.from_json("row", shape, WHOLE).alias("r")).select("r.*")


def _wait(state: GroupState, at: int) -> None:
    """Wakes the key when the watermark has passed a time (in milliseconds)."""
    state.setTimeoutTimestamp(max(at, state.getCurrentWatermarkMs() + 1))


def keep_first(rows: DataFrame, key: str, time: str, order: str, delay: str, expiry: str) -> DataFrame:
    """The rows of a stream, one a key: the first by time and order (a whole number)."""
    life = pd.Timedelta(expiry) // pd.Timedelta(milliseconds=1)

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else None
        if state.hasTimedOut:
            if held[3]:
                state.remove()
                return
            state.update((*held[:3], True))
            _wait(state, held[0] // 1000 + life)
            yield pd.DataFrame({"row": [held[2]]})
            return
        if held and held[3]:
            _wait(state, held[0] // 1000 + life)
            return
        for f in frames:
            best = f.sort_values(["micros", "place", "row"]).iloc[0]
            one = (int(best["micros"]), int(best["place"]), best["row"], False)
            held = one if held is None or one[:3] < tuple(held[:3]) else held
        state.update(tuple(held))
        _wait(state, held[0] // 1000 + 1)

    return _keyed(rows, key, time, order, delay, run)


def keep_last(rows: DataFrame, key: str, time: str, order: str, delay: str, expiry: str) -> DataFrame:
    """The rows of a stream: a key's last by time and order (a whole number), again for each batch that brings a later one."""
    life = pd.Timedelta(expiry) // pd.Timedelta(milliseconds=1)

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = was = state.get if state.exists else None
        for f in frames:
            best = f.sort_values(["micros", "place", "row"]).iloc[-1]
            one = (int(best["micros"]), int(best["place"]), best["row"], True)
            held = one if held is None or one[:3] > tuple(held[:3]) else held
        state.update(tuple(held))
        _wait(state, held[0] // 1000 + life)
        if held is not was:
            yield pd.DataFrame({"row": [held[2]]})

    return _keyed(rows, key, time, order, delay, run)
