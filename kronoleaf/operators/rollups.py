"""Daily, monthly and hourly roll-ups, fixed-domain counts and representative days."""

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.timeutil import day, month


def counts_by_day(facts: DataFrame, ts: str, kinds: dict[str, Column]) -> DataFrame:
    """One row a day with a count for each named condition; one shuffle of partial counts."""
    return facts.groupBy(day(ts).alias("day")).agg(F.count("*").alias("n_all"), *[F.count_if(c).alias(k) for k, c in kinds.items()])


def representative_days(daily: DataFrame, weights: dict[str, tuple[int, int | None]], most: int) -> DataFrame:
    """The `most` days of greatest score: sums of weight * min(count, cap); later days first on ties."""
    score = sum((F.least(F.col(c), F.lit(cap)) if cap else F.col(c)) * w for c, (w, cap) in weights.items())
    return daily.withColumn("score", score.cast("long")).orderBy(F.desc("score"), F.desc("day")).limit(most)


def counts_by_month(facts: DataFrame, ts: str, keys: list[str]) -> DataFrame:
    return facts.groupBy(month(ts).alias("month"), *keys).agg(F.count("*").alias("n"))


def hourly_histogram(facts: DataFrame, ts: str) -> DataFrame:
    """24 bins, empty ones as 0."""
    hours = facts.sparkSession.range(24).select(F.col("id").cast("int").alias("hour"))
    return hours.join(facts.groupBy(F.hour(ts).alias("hour")).agg(F.count("*").alias("n")), "hour", "left").select("hour", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def domain_counts(facts: DataFrame, status: str, domain: list[str], measure: Column) -> DataFrame:
    """Count, total and longest of each status in a fixed domain, zeros kept."""
    domain_df = facts.sparkSession.createDataFrame([(d,) for d in domain], f"{status} string")
    got = facts.groupBy(status).agg(F.count("*").alias("n"), F.sum(measure).alias("total"), F.max(measure).alias("longest"))
    return domain_df.join(got, status, "left").select(status, F.coalesce("n", F.lit(0)).cast("long").alias("n"), F.coalesce("total", F.lit(0)).cast("long").alias("total"), F.coalesce("longest", F.lit(0)).cast("long").alias("longest"))


def top(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    return rows.orderBy(*order).limit(most)


def buckets(rows: DataFrame, value: Column, edges: list[float], names: list[str]) -> DataFrame:
    """Counts of values by half-open buckets; edges are the upper ends of all but the last."""
    label = F.lit(names[-1])
    for edge, name in reversed(list(zip(edges, names, strict=False))):
        label = F.when(value < edge, name).otherwise(label)
    return rows.groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))


def tag_counts(rows: DataFrame, json: str, key: str, most: int) -> DataFrame:
    """The most frequent values of a JSON key; ties in ascending order."""
    value = F.get_json_object(json, f"$.{key}")
    return rows.where(value.isNotNull()).groupBy(value.alias("tag")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "tag").limit(most)
