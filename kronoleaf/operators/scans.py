"""Scans of activity tables with their filters, lookups by id, and ingestion with a report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F


def _after(day: str) -> str:
    """The least text above all that begin with `day`."""
    return day[:-1] + chr(ord(day[-1]) + 1)


def scan(rows: DataFrame, when: Column, *, date_from: str | None = None, date_to: str | None = None, order: list | None = None, most: int | None = None, **values: list | str | int) -> DataFrame:
    """Rows of a range of dates (both ends included, by the first ten characters of `when`, a text) whose columns have given values or
    one of given lists. The column itself is compared, so that the filters reach the files: a text
    of a day comes before the day with a character after the last that a date can have."""
    tests = [when >= date_from] if date_from else []
    tests += [when < _after(date_to)] if date_to else []
    tests += [F.col(c).isin(v) if isinstance(v, list) else F.col(c) == v for c, v in values.items()]
    out = rows.where(reduce(lambda a, b: a & b, tests)) if tests else rows
    out = out.orderBy(*order) if order else out
    return out if most is None else out.limit(most)


def by_ids(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of many ids at once, by a semi join."""
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def without_results(media: DataFrame, *results: DataFrame) -> DataFrame:
    """Media that lack a successful result in any of the tables."""
    done = [r.where("status = 'success'").select(F.col("media_id").alias("id")).distinct() for r in results]
    have = reduce(lambda a, b: a.join(b, "id", "left_semi"), done)
    return media.join(have, "id", "left_anti")


def ingested(existing: DataFrame, incoming: DataFrame, key: str, content: str) -> tuple[DataFrame, DataFrame]:
    """(table, report): incoming rows whose content is new are added, each content once; the report counts scanned, added and skipped."""
    fresh = incoming.groupBy(content).agg(F.min_by(F.struct(*incoming.columns), key).alias("r")).select("r.*").join(existing.select(content).distinct(), content, "left_anti")
    n = lambda df, name: df.agg(F.count("*").alias(name))
    report = n(incoming, "scanned").crossJoin(n(fresh, "added")).withColumn("skipped", F.col("scanned") - F.col("added"))
    return existing.unionByName(fresh.select(*existing.columns)), report


def tag_list(json: Column) -> Column:
    """A JSON list of strings; a text that is none is split at commas, null is empty."""
    none = F.array().cast("array<string>")
    parts = F.filter(F.transform(F.split(json, ","), F.trim), lambda x: x != "")
    return F.when(json.isNull(), none).otherwise(F.coalesce(F.from_json(json, "array<string>"), parts))


def one_or_list(json: Column) -> Column:
    """A JSON list of strings; a text that is none is the one value."""
    none = F.array().cast("array<string>")
    return F.when(json.isNull() | (json == ""), none).otherwise(F.coalesce(F.from_json(json, "array<string>"), F.array(json)))
