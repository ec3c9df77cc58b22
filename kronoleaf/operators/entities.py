"""Entity resolution and entity-period summaries."""

from functools import reduce

from pyspark.sql import DataFrame, functions as F


def resolve(terms: DataFrame, term: str, lookups: list[tuple[DataFrame, str, str, str]]) -> DataFrame:
    """Each term's status (none, resolved, ambiguous), count and least id (-1: none) over exact lookups.

    A lookup is (table, id column, name column, source label).
    """
    names = reduce(DataFrame.unionByName, [t.select(F.col(i).alias("id"), F.lower(F.trim(n)).alias("name"), F.lit(s).alias("source")) for t, i, n, s in lookups])
    hits = terms.select(term, F.lower(F.trim(term)).alias("name")).join(names, "name", "left")
    got = hits.groupBy(term).agg(F.count_distinct("id").alias("n_ids"), F.coalesce(F.min("id"), F.lit(-1)).cast("long").alias("least_id"), F.concat_ws(",", F.sort_array(F.collect_set("source"))).alias("sources"))
    return got.withColumn("status", F.when(F.col("n_ids") == 0, "none").when(F.col("n_ids") == 1, "resolved").otherwise("ambiguous"))


def period_summary(links: DataFrame, entity: list[str], event: str, low, high, when: str) -> DataFrame:
    """Distinct events of each entity in a range."""
    return links.where(F.col(when).between(low, high)).groupBy(*entity).agg(F.count_distinct(event).alias("n_events"))


def combined(a: DataFrame, b: DataFrame, keys: list[str], count: str) -> DataFrame:
    """Links found on both paths, evidence summed."""
    return a.join(b.withColumnRenamed(count, "__b"), keys).select(*keys, (F.col(count) + F.col("__b")).alias(count))


def speakers(messages: DataFrame, chat: str, sender: str, order: str) -> DataFrame:
    """One row a chat and sender, aggregated before any link is joined, so links cannot multiply counts."""
    return messages.groupBy(chat, sender).agg(F.count("*").alias("n"), F.min(order).alias("first_at"), F.max(order).alias("last_at"))


def days_of(a: DataFrame, b: DataFrame, keys: list[str], names: tuple[str, str]) -> DataFrame:
    """Counts of two sources by keys, outer-joined with zeros."""
    left, right = (x.groupBy(*keys).agg(F.count("*").alias(n)) for x, n in zip((a, b), names, strict=True))
    return left.join(right, keys, "full").fillna(0, list(names))
