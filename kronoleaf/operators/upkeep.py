"""Changes of tables as new tables: overrides, cleanups with cascades, people and places, jobs, and the checks of evaluations.

Every change that removes rows has a `plan` of counts beside it; what is returned
is the table to be written, nothing is written here.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .search import flag, truthy, untrusted


def patched(existing: DataFrame, patch: DataFrame, key: str) -> DataFrame:
    """Existing rows with every field of the patch that is not null; keys that are new are added. The last of
    several patches of a key, by `order`, wins field by field."""
    fields = [c for c in existing.columns if c != key]
    last = patch.groupBy(key).agg(*[F.max_by(c, F.when(F.col(c).isNotNull(), F.col("order"))).alias(f"new_{c}") for c in fields if c in patch.columns])
    rows = existing.join(last, key, "full")
    return rows.select(key, *[(F.coalesce(f"new_{c}", c) if c in patch.columns else F.col(c)).alias(c) for c in fields])


def cleared(existing: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    return existing.join(keys.select(key).distinct(), key, "left_anti")


def relocated(events: DataFrame, allowed: DataFrame, labels: DataFrame) -> DataFrame:
    """Events with the location of `labels` (id, label) where `allowed` (id) lets a rule set it."""
    new = labels.join(allowed.select("id"), "id", "left_semi").groupBy("id").agg(F.min("label").alias("label"))
    return events.join(new, "id", "left").withColumn("location_name", F.coalesce("label", "location_name")).drop("label")


def without_bad_results(results: DataFrame, evidence: DataFrame, kind: str) -> tuple[DataFrame, DataFrame]:
    """(results, evidence) without rows of fake engines or failed runs, nor the evidence of that kind that rests on them."""
    bad = results.where(untrusted()).select(F.col("media_id").alias("evidence_id")).distinct()
    gone = evidence.where(F.col("evidence_type") == kind).join(bad, "evidence_id", "left_semi").select("event_id", "evidence_type", "evidence_id").distinct()
    return results.where(~untrusted()), evidence.join(gone, ["event_id", "evidence_type", "evidence_id"], "left_anti")


def plan(before: DataFrame, after: DataFrame) -> DataFrame:
    """(before, after, removed): what a change would remove, without doing it."""
    return before.agg(F.count("*").alias("before")).crossJoin(after.agg(F.count("*").alias("after"))).withColumn("removed", F.col("before") - F.col("after"))


def detached(person_ids: DataFrame, tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Tables without the rows of some people, and an audit (table, removed) of them."""
    ids = person_ids.select("person_id").distinct()
    kept = {name: df.join(ids, "person_id", "left_anti") for name, df in tables.items()}
    audit = reduce(DataFrame.unionByName, [df.join(ids, "person_id", "left_semi").agg(F.count("*").alias("removed")).select(F.lit(name).alias("table"), "removed") for name, df in tables.items()])
    return kept, audit


def soft_deleted(persons: DataFrame, ids: DataFrame) -> DataFrame:
    """People of `ids` (id) marked deleted, hidden and not searchable; their rows stay."""
    gone = ids.select("id").distinct().withColumn("gone", F.lit(True))
    rows = persons.join(gone, "id", "left")
    is_gone = F.coalesce("gone", F.lit(False))
    return rows.withColumns({"is_deleted": F.when(is_gone, 1).otherwise(F.col("is_deleted")), "is_hidden": F.when(is_gone, 1).otherwise(F.col("is_hidden")), "searchable": F.when(is_gone, 0).otherwise(F.col("searchable"))}).drop("gone")


def privacy_audit(persons: DataFrame, places: DataFrame) -> DataFrame:
    """(kind, level, n, hidden): people and places by privacy level."""
    part = lambda df, kind, hidden: df.groupBy(F.lit(kind).alias("kind"), F.col("privacy_level").alias("level")).agg(F.count("*").alias("n"), F.count_if(flag(hidden)).alias("hidden"))
    return part(persons, "person", "is_hidden").unionByName(part(places, "place", "hidden"))


def person_export(persons: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """One JSON document a person: names, level and the number of rows in each table."""
    from .people import link_counts

    return link_counts(persons, tables).select("id", F.to_json(F.struct("display_name", "privacy_level", *tables)).alias("document"))


def flagged(overrides: DataFrame, ids: DataFrame, tags: list[str], **flags: int) -> DataFrame:
    """Overrides after flags and tags were set on `ids` (event_id): tags are added to those there, in order and once."""
    new = ids.select("event_id").distinct().withColumn("touched", F.lit(True))
    rows = overrides.join(new, "event_id", "full")
    touched = F.coalesce("touched", F.lit(False))
    old = F.coalesce(F.from_json("tags_json", "array<string>"), F.array().cast("array<string>"))
    merged = F.to_json(F.array_distinct(F.concat(old, F.array(*map(F.lit, tags)).cast("array<string>"))))
    changes = {c: F.when(touched, v).otherwise(F.coalesce(F.col(c), F.lit(0))) for c, v in flags.items()}
    return rows.withColumns(changes | {"tags_json": F.when(touched, merged).otherwise(F.col("tags_json"))}).drop("touched")


def relinked(links: DataFrame, source: str, target: str) -> DataFrame:
    """A cluster's links replaced by its target's one person; refused unless the target has exactly one."""
    people = [r.person_id for r in links.where(F.col("cluster_id") == target).select("person_id").distinct().limit(2).collect()]
    if len(people) != 1:
        raise ValueError("the target must be linked with exactly one person")
    moved = links.where(F.col("cluster_id") == target).limit(1).withColumn("cluster_id", F.lit(source))
    return links.where(F.col("cluster_id") != source).unionByName(moved)


def latest(log: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The last row of each key of an append-only log."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order))
    return log.withColumn("r", F.row_number().over(w)).where("r = 1").drop("r")


def synced(plan: DataFrame, report: DataFrame) -> DataFrame:
    """Items of a job after a run: their reported status, skipped where nothing was reported."""
    return plan.select("job_id", "item_id").join(report.select("item_id", F.col("status").alias("reported")), "item_id", "left").select("job_id", "item_id", F.coalesce("reported", F.lit("skipped")).alias("status"))


def to_retry(items: DataFrame, status: str = "failed") -> DataFrame:
    return items.where(F.col("status") == status).select("job_id", "item_id", F.lit("pending").alias("status"))


def stale(jobs: DataFrame, now: Column, hours: float) -> DataFrame:
    """Running jobs whose last sign of life is older than so many hours."""
    age = (F.unix_timestamp(now) - F.unix_timestamp(F.to_timestamp("updated_at"))) / 3600
    return jobs.where((F.col("status") == "running") & (age > hours))


def recommended(months: DataFrame, done: str, most: int) -> DataFrame:
    """How many photos of each month to take next: those left, up to a limit."""
    left = F.greatest(F.col("photos") - F.col(done), F.lit(0))
    return months.select("month", left.alias("remaining"), F.least(left, F.lit(most)).alias("next"))


def first_error(rows: DataFrame, rules: list[tuple[str, Column]], key: str) -> DataFrame:
    """(key, error): the first rule that a record breaks, in the rules' order; an id used twice is the last rule."""
    count = F.count("*").over(Window.partitionBy(key))
    error = F.lit(None).cast("string")
    for name, bad in reversed([*rules, ("duplicate id", count > 1)]):
        error = F.when(F.coalesce(bad, F.lit(False)), name).otherwise(error)
    return rows.select(key, error.alias("error")).where("error is not null")


def event_quality(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Counts that an evaluation bounds: events, messages alone below 0.5, both kinds, images alone from 0.8, and evidence of none."""
    kinds = evidence.groupBy("event_id").agg(F.collect_set("evidence_type").alias("kinds"))
    rows = events.select("id", "confidence").join(kinds, F.col("id") == F.col("event_id"), "left").withColumn("kinds", F.coalesce("kinds", F.array().cast("array<string>")))
    only = lambda k: F.col("kinds") == F.array(F.lit(k))
    got = rows.agg(F.count("*").alias("events"), F.count_if(only("line") & (F.col("confidence") < 0.5)).alias("line_only_low"), F.count_if(F.array_contains("kinds", "line") & F.array_contains("kinds", "photo")).alias("photo_and_line"), F.count_if(only("vlm") & (F.col("confidence") >= 0.8)).alias("vlm_only_high"))
    orphans = evidence.join(events.select(F.col("id").alias("event_id")), "event_id", "left_anti").agg(F.count("*").alias("orphans"))
    return got.crossJoin(orphans)


def period_checks(expected: DataFrame, events: DataFrame) -> DataFrame:
    """(case_id, n, passed) of cases (case_id, date_from, date_to, at_least, at_most) over the events of their dates."""
    by_day = events.groupBy("date").agg(F.count("*").alias("n"))
    hit = expected.join(by_day, F.col("date").between(F.col("date_from"), F.col("date_to")), "left")
    got = hit.groupBy("case_id", "at_least", "at_most").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"))
    return got.select("case_id", "n", F.col("n").between(F.col("at_least"), F.col("at_most")).alias("passed"))


def by_type(results: DataFrame) -> DataFrame:
    """Cases of each type: all, passed, failed and skipped."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return results.groupBy("type").agg(F.count("*").alias("total"), n("passed"), n("failed"), n("skipped"))


def unexpected(rows: DataFrame, column: str, allowed: list[str]) -> DataFrame:
    """Values of a JSON list that are not allowed, with their number."""
    values = F.array_except(F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>")), F.array(*map(F.lit, allowed)))
    return rows.select(F.explode(values).alias("value")).groupBy("value").agg(F.count("*").alias("n"))


def rank_bounds(results: DataFrame, expected: DataFrame, most: int) -> DataFrame:
    """(case_id, rank, passed): whether a case's expected date is ranked among the first `most` of its results (case_id, date, score)."""
    w = Window.partitionBy("case_id").orderBy(F.desc("score"), "date")
    placed = results.withColumn("rank", F.row_number().over(w)).select("case_id", "date", "rank")
    hit = expected.join(placed, ["case_id", "date"], "left").groupBy("case_id").agg(F.min("rank").alias("rank"))
    return hit.withColumn("passed", F.coalesce(F.col("rank") <= most, F.lit(False)))


def named_or_hidden(name: str, level: str, n: Column, kind: str) -> Column:
    """A public label: the public name, else a number of the kind; none where it is private."""
    return F.when(F.col(level) == "hidden", F.lit(None).cast("string")).otherwise(F.coalesce(truthy(name), F.concat(F.lit(f"{kind} "), n.cast("string"))))
