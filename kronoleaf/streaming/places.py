"""Sessions by gap and distance over a stream, with state and timers."""

from __future__ import annotations

import json
from collections.abc import Iterator
from datetime import UTC, datetime

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.timeutil import micros
from ..operators.sessions import PlaceFold

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _Sessions(StatefulProcessor):
    """Holds a key's items until the watermark has passed them, then folds them in order of time and id.

    State is the items that may still be overtaken and one unfinished session; a timer
    stands at the earliest held item.
    """

    def __init__(self, gap_minutes: int, far_metres: float):
        self.rule = gap_minutes, far_metres

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getListState("held", "at long, id string, lat double, lon double")
        self.fold = handle.getValueState("fold", "kept string")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        for pdf in rows:
            for r in pdf.itertuples(index=False):
                self.held.appendValue((int(r.at), r.id, *(None if pd.isna(x) else float(x) for x in (r.lat, r.lon))))
        yield self._release(key, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        yield self._release(key, timerValues.getCurrentWatermarkInMs())

    def _release(self, key: tuple, watermark: int) -> pd.DataFrame:
        held = sorted(self.held.get(), key=lambda r: (r[0], r[1]))
        ready = [r for r in held if r[0] <= watermark * 1000]
        rest = held[len(ready) :]
        out = []
        if ready:
            kept = json.loads(self.fold.get()[0]) if self.fold.exists() else []
            one = PlaceFold(*self.rule, *kept)
            for at, i, lat, lon in ready:
                day = datetime.fromtimestamp(at // 1_000_000, UTC).strftime("%Y-%m-%d")
                out.append((key[0], day, i, one.add(day, at, lat, lon)))
            self.fold.update((json.dumps([one.day, one.session, one.last, one.located]),))
            self.held.put(rest) if rest else self.held.clear()
        if rest:
            self.handle.registerTimer(-(-rest[0][0] // 1000))
        return pd.DataFrame(out, columns=["key", "day", "id", "session"])

    def close(self) -> None:
        pass


def place_sessions(stream: DataFrame, key: str, ts: str, order: str, late: str, gap_minutes: int = 90, far_metres: float = 500) -> DataFrame:
    """(key, day, id, session) of a stream, each row once it can be overtaken no more: what `operators.sessions.place_sessions` gives
    for the same rows, in whatever order they come within the watermark `late`; rows later than that are dropped.

    `key` and `order` come out as strings, and order counts as text. The session's state store must be RocksDB
    (spark.sql.streaming.stateStore.providerClass).
    """
    rows = stream.select(F.col(key).cast("string").alias("key"), F.col(order).cast("string").alias("id"), F.col(ts).cast("timestamp").alias("ts"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))
    rows = rows.where("key is not null and id is not null and ts is not null").withColumn("at", micros(F.col("ts"))).withWatermark("ts", late)
    return rows.groupBy("key").transformWithStateInPandas(_Sessions(gap_minutes, far_metres), "key string, day string, id string, session long", "Append", "EventTime")
