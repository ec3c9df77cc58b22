"""Integrity checks as rules; each gives one row (metric, n), all in one union."""

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def metric(rows: DataFrame, name: str, condition: Column | None = None) -> DataFrame:
    n = F.count("*") if condition is None else F.count_if(condition)
    return rows.agg(n.alias("n")).select(F.lit(name).alias("metric"), "n")


def orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str, name: str) -> DataFrame:
    """Child rows without a parent, by an anti join."""
    return metric(child.join(parent, F.col(child_key) == F.col(parent_key), "left_anti"), name)


def duplicates(rows: DataFrame, keys: list[str], name: str) -> DataFrame:
    return metric(rows.groupBy(*keys).count().where("count > 1"), name)


def outside(rows: DataFrame, column: str, domain: list, name: str) -> DataFrame:
    return metric(rows, name, ~F.col(column).isin(domain) | F.col(column).isNull())


def out_of_range(rows: DataFrame, column: str, low, high, name: str) -> DataFrame:
    return metric(rows, name, ~F.col(column).between(low, high))


def bad_json(rows: DataFrame, column: str, name: str) -> DataFrame:
    return metric(rows, name, F.col(column).isNotNull() & F.try_parse_json(column).isNull())


def report(metrics: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, metrics)


def verdict(checked: DataFrame, severe: list[str]) -> DataFrame:
    """One row: the number of severe metrics above 0, and ok."""
    bad = F.count_if(F.col("metric").isin(severe) & (F.col("n") > 0))
    return checked.agg(bad.alias("n_severe")).withColumn("ok", F.col("n_severe") == 0)


def diff(before: DataFrame, after: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """Counts of added, removed, changed and same rows, by a full outer join."""
    a = before.select(F.col(key).alias("ka"), F.struct(*columns).alias("va"))
    b = after.select(F.col(key).alias("kb"), F.struct(*columns).alias("vb"))
    kind = F.when(F.col("ka").isNull(), "added").when(F.col("kb").isNull(), "removed").when(F.col("va") != F.col("vb"), "changed").otherwise("same")
    return a.join(b, F.col("ka") == F.col("kb"), "full").groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))
