"""Gap sessions, order-dependent sessions and cross-kind merges."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import asin, cos, radians, sin, sqrt

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..functions.timeutil import day, micros


def gap_sessions(facts: DataFrame, keys: list[str], ts: str, order: str, gap_minutes: int) -> DataFrame:
    """Adds day and session (from 1): a new one after `gap_minutes` or more within the keys and day."""
    w = Window.partitionBy(*keys, "day").orderBy(ts, order)
    gap = micros(F.col(ts)) - micros(F.lag(ts).over(w))
    new = F.coalesce((gap >= gap_minutes * 60_000_000).cast("int"), F.lit(1))
    return facts.withColumn("day", day(ts)).withColumn("__new", new).withColumn("session", F.sum("__new").over(w)).drop("__new")


def session_rows(sessions: DataFrame, keys: list[str], ts: str) -> DataFrame:
    return sessions.groupBy(*keys, "day", "session").agg(F.count("*").alias("n"), F.min(ts).alias("start_at"), F.max(ts).alias("end_at"))


def metres(a_lat: float, a_lon: float, b_lat: float, b_lon: float) -> float:
    """Great-circle distance on a sphere of radius 6,371,000 m."""
    p, q = radians(a_lat), radians(b_lat)
    h = sin((q - p) / 2) ** 2 + cos(p) * cos(q) * sin(radians(b_lon - a_lon) / 2) ** 2
    return 2 * 6_371_000 * asin(min(1.0, sqrt(h)))


class PlaceFold:
    """Sessions of one key, item by item in order: broken by gap, by day, and by distance from all located items of the session."""

    def __init__(self, gap_minutes: int, far_metres: float, day: str = "", session: int = 0, last: int | None = None, located: list | None = None):
        self.gap, self.far = gap_minutes * 60_000_000, far_metres
        self.day, self.session, self.last, self.located = day, session, last, [tuple(x) for x in located or ()]

    def add(self, day: str, micros: int, lat: float | None, lon: float | None) -> int:
        """The item's session of its day, from 1; items without a position never break one."""
        if day != self.day:
            self.day, self.session, self.last = day, 0, None
        here = None if lat is None or lon is None or lat != lat or lon != lon else (lat, lon)
        # A place that the session already has is near; only others are measured.
        away = bool(here and self.located) and here not in self.located and all(metres(*here, *x) > self.far for x in self.located)
        if self.last is None or micros - self.last >= self.gap or away:
            self.session, self.located = self.session + 1, []
        if here and here not in self.located:
            self.located.append(here)
        self.last = micros
        return self.session


def folded(rows: DataFrame, by: list[str], order: list[Column], step: Callable[[], Callable[..., int]], inputs: list[str], name: str) -> DataFrame:
    """`rows` with a number `name` each, which a fold of each group gives in order: `step()` makes a group's fold, a function of `inputs`.

    Groups stream through a task one after the other, whatever their number and size; only the fold's own state is held.
    """
    start = F.row_number().over(Window.partitionBy(*by).orderBy(*order)) == 1
    schema = StructType([*rows.schema.fields, StructField(name, LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fold = None
        for batch in batches:
            out = []
            for new, *x in zip(batch.column("__start").to_pylist(), *[batch.column(c).to_pylist() for c in inputs], strict=True):
                if new:
                    fold = step()
                out.append(fold(*x))
            kept = [i for i, c in enumerate(batch.schema.names) if c != "__start"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in kept], pa.array(out, pa.int64())], [*[batch.schema.names[i] for i in kept], name])

    return rows.withColumn("__start", start).mapInArrow(run, schema)


def place_sessions(facts: DataFrame, key: str, ts: str, order: str, gap_minutes: int = 90, far_metres: float = 500) -> DataFrame:
    """(key, day, order, session): also broken where an item lies far from all located items of its session.

    The rule depends on all earlier members, so each key and day is folded in order of
    time; lat and lon may be null, which never breaks a session. Key and order may be of any type.
    """
    at = F.coalesce(micros(F.col(ts)), F.lit(0))
    rows = facts.withColumn("day", day(ts)).select(key, "day", order, at.alias("at"), F.col("lat").cast("double").alias("lat"), F.col("lon").cast("double").alias("lon"))

    def step() -> Callable[..., int]:
        one = PlaceFold(gap_minutes, far_metres)
        return lambda at, lat, lon: one.add("", at, lat, lon)

    got = folded(rows, [key, "day"], [F.col("at"), F.asc_nulls_last(order)], step, ["at", "lat", "lon"], "session")
    return got.select(key, "day", order, "session")


def merge_kinds(clusters: DataFrame, key: str, window_minutes: int = 90) -> DataFrame:
    """(key, day, merged, kinds, n, start_at, end_at) from (key, day, kind, n, start_at, end_at).

    In order of start and end, a cluster joins the last merged one if their kinds
    differ (or the last is mixed) and they overlap or lie at most the window apart.
    """
    ends = {"__start_at": "start_at", "__end_at": "end_at"}
    rows = clusters.select(key, "day", "kind", "n", "start_at", "end_at", *[F.coalesce(micros(F.col(c)), F.lit(0)).alias(a) for a, c in ends.items()])
    order = [F.asc_nulls_last(c) for c in ("start_at", "end_at", "kind")]
    got = folded(rows, [key, "day"], order, lambda: MergeFold(window_minutes), ["kind", *ends], "merged")
    kinds = F.array_join(F.array_sort(F.collect_set("kind")), ",")
    return got.groupBy(key, "day", "merged").agg(kinds.alias("kinds"), F.sum("n").cast("long").alias("n"), F.min("start_at").alias("start_at"), F.max("end_at").alias("end_at"))


class MergeFold:
    """Numbers, from 1, of the merged clusters that clusters in order of start join; called with a cluster's kind, start and end."""

    def __init__(self, window_minutes: int):
        self.window, self.number, self.kinds, self.end = window_minutes * 60_000_000, 0, set(), 0

    def __call__(self, kind: str, start: int, end: int) -> int:
        if self.number and start - self.end <= self.window and (len(self.kinds) > 1 or kind not in self.kinds):
            self.kinds.add(kind)
            self.end = max(self.end, end)
        else:
            self.number, self.kinds, self.end = self.number + 1, {kind}, end
        return self.number
