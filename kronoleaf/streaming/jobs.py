"""Jobs over streams of items that can be killed and started again.

Each batch writes the outcome of its items under a key of its own in a progress log, replacing what an earlier
attempt at the same batch may have left. The stream's checkpoint runs a batch again until it is committed,
so the log has each batch once. Retries read the log, take the failed items and write under the number of their attempt.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

LOG = "item_id string, status string, error string, attempt int"
#: What an item can end as.
STATES = ["success", "failed", "skipped", "engine_unavailable"]
Work = Callable[[DataFrame], DataFrame]


def _write(done: DataFrame, attempt: int, log: str, key: str) -> None:
    status = F.when(F.col("status").isin(STATES), F.col("status")).otherwise("failed")
    rows = done.select(F.col("item_id").cast("string").alias("item_id"), status.alias("status"), F.col("error").cast("string").alias("error"), F.lit(attempt).alias("attempt"))
    rows.write.mode("overwrite").parquet(f"{log}/batch={key}")


def run(items: DataFrame, work: Work, log: str, checkpoint: str) -> StreamingQuery:
    """Work through a stream of (item_id, ...); `work` gives (item_id, status, error) for a batch and may run again for one."""

    def each(batch: DataFrame, number: int) -> None:
        _write(work(batch.dropDuplicates(["item_id"])), 1, log, f"new-{number:012d}")

    return items.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def states(spark: SparkSession, log: str) -> DataFrame:
    """(item_id, status, error, attempts): how each item ended last, and how often it was worked on.

    An item that came in several batches counts by its last attempt, of equal ones by the last batch.
    """
    rows = spark.read.schema(f"{LOG}, batch string").parquet(log)
    return rows.groupBy("item_id").agg(F.max_by(F.struct("status", "error"), F.struct("attempt", "batch")).alias("x"), F.max("attempt").alias("attempts")).select("item_id", "x.status", "x.error", "attempts")


def retry_failed(spark: SparkSession, items: DataFrame, work: Work, log: str, limit: int = 3, statuses: tuple[str, ...] = ("failed",)) -> int:
    """Work once more on items that ended in one of `statuses` after fewer than `limit` attempts; how many attempts were gone through.

    Attempt n + 1 is written only when all of attempt n is in the log, so a retry that is killed starts at the same attempt again.
    """
    done = 0
    for attempt in range(2, limit + 1):
        again = states(spark, log).where(F.col("status").isin(*statuses) & (F.col("attempts") == attempt - 1)).select("item_id")
        if again.isEmpty():
            continue
        _write(work(items.withColumn("item_id", F.col("item_id").cast("string")).join(again, "item_id", "left_semi").dropDuplicates(["item_id"])), attempt, log, f"retry-{attempt:04d}")
        done += 1
    return done


def summary(items: DataFrame, log_states: DataFrame) -> DataFrame:
    """(total, success, failed, skipped, pending, status) of a job: completed, partial, failed, or running while items are pending."""
    rows = items.select(F.col("item_id").cast("string").alias("item_id")).distinct().join(log_states, "item_id", "left")
    n = lambda *s: F.count_if(F.col("status").isin(*s))
    got = rows.agg(F.count("*").alias("total"), n("success").alias("success"), n("failed", "engine_unavailable").alias("failed"), n("skipped").alias("skipped"), F.count_if(F.col("status").isNull()).alias("pending"))
    status = F.when(F.col("pending") > 0, "running").when(F.col("failed") == 0, "completed").when(F.col("success") == 0, "failed").otherwise("partial")
    return got.withColumn("status", status)
