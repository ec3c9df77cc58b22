"""Structured Streaming forms of the day, hour and gap roll-ups."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery


def tumbling(stream: DataFrame, ts: str, length: str, late: str, kinds: dict[str, Column]) -> DataFrame:
    """Counts by window; state older than the watermark is dropped."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, length)).agg(F.count("*").alias("n_all"), *[F.count_if(c).alias(k) for k, c in kinds.items()])


def sessions(stream: DataFrame, ts: str, keys: list[str], gap_minutes: int, late: str) -> DataFrame:
    """Gap sessions; an item exactly `gap_minutes` after the last one starts a new session."""
    gap = f"{gap_minutes * 60_000_000 - 1} microseconds"
    return stream.withWatermark(ts, late).groupBy(*keys, F.session_window(ts, gap)).agg(F.count("*").alias("n"))


def first_seen(stream: DataFrame, ts: str, key: str, late: str) -> DataFrame:
    """Insert-or-ignore by key within the watermark."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key])


def sliding(stream: DataFrame, ts: str, length: str, step: str, late: str, kinds: dict[str, Column]) -> DataFrame:
    """Counts by windows of `length` that start every `step`."""
    return stream.withWatermark(ts, late).groupBy(F.window(ts, length, step)).agg(F.count("*").alias("n_all"), *[F.count_if(c).alias(k) for k, c in kinds.items()])


def rebuild_dates(stream: DataFrame, ts: str, rebuild: Callable[[DataFrame], DataFrame], path: str, checkpoint: str) -> StreamingQuery:
    """Late data rebuild their dates: for each batch, `rebuild` gets its dates (date) and gives those dates' rows anew, which
    replace the partitions of these dates and no other. A batch that runs again writes the same."""

    def write(batch: DataFrame, _: int) -> None:
        dates = batch.select(F.date_format(ts, "yyyy-MM-dd").alias("date")).distinct()
        rebuild(dates).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("date").parquet(path)

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
