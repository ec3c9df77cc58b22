"""Whole summaries of any number of date ranges at once.

Every source is counted once, by date, section and name; a range adds the counts of its dates. So the sources are read once however
many ranges are asked for, and what meets the ranges has the size of the counts. A source's rows belong to one date each, so the counts of
dates add up to those of a range, distinct events and media of a place or person included.
"""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..checkpoints import written
from .ranking import level
from .search import flag, truthy
from .statistics import CATEGORIES, day_score

#: How many titles, places before they are folded, folded names, people, days and events a day a summary shows.
TITLES, PLACES, FOLDED, PEOPLE, DAYS, EVENTS = 10, 20, 8, 10, 5, 5
EVENT_TEXT = ["title", "summary", "location_name"]
MODEL_TEXT = ["caption", "short_caption", "scene_tags_json", "activity_tags_json", "food_cues_json", "location_cues_json"]
KINDS = ["person_events", "person_media", "person_messages", "person_calls"]
#: Names of the totals as `statistics.day_score` reads them.
COUNTERS = {"events": "events_count", "photos": "photos", "gps_photos": "gps_photos", "vlm_photos": "vlm_photos", "ocr_photos": "ocr_photos", "messages": "line_messages", "calls": "call_events"}


def _counted(rows: DataFrame, by: dict[str, Column] | None = None, fixed: dict[tuple[str, str], Column] | None = None) -> DataFrame:
    """(date, section, name, value): rows of each date by the names that the columns of `by` give for their sections, and by the
    (section, name) of each condition of `fixed` that they meet.

    The fixed names are conditional counts of one grouping by date and `by`, so a row is not copied for each name that it counts under.
    """
    by, fixed = by or {}, fixed or {}
    own = rows.where("date <> ''").select("date", *[c.cast("string").alias(f"by_{s}") for s, c in by.items()], *[c.alias(f"is_{i}") for i, c in enumerate(fixed.values())])
    sums = own.groupBy("date", *[f"by_{s}" for s in by]).agg(F.count("*").alias("n"), *[F.count_if(f"is_{i}").alias(f"n_{i}") for i in range(len(fixed))])
    entry = lambda section, name, n: F.struct(F.lit(section).alias("section"), name.alias("name"), F.col(n).cast("double").alias("value"))
    entries = [entry(s, F.col(f"by_{s}"), "n") for s in by] + [entry(s, F.lit(name), f"n_{i}") for i, (s, name) in enumerate(fixed)]
    return sums.select("date", F.inline(F.array(*entries))).where("value > 0")


def _summed(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts).groupBy("date", "section", "name").agg(F.sum("value").alias("value"))


def _lowered(rows: DataFrame, columns: list[str]) -> DataFrame:
    """`rows` with its texts in lower case as `low`, a column of its own, so that it is made once for all terms."""
    return rows.withColumn("low", F.lower(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in columns])))


def _categories(of: tuple[str, ...]) -> dict[tuple[str, str], Column]:
    # One pattern a category: a test of each term apart makes a method that is too long to be compiled.
    return {("category", k): F.rlike("low", F.lit("|".join(re.escape(w.lower()) for w in CATEGORIES[k]))) for k in of}


def _captured(media: DataFrame) -> DataFrame:
    return media.withColumn("date", F.substring(F.coalesce("captured_at", "fallback_captured_at"), 1, 10))


def _own_dates(media: DataFrame) -> DataFrame:
    return _captured(media).select(F.col("id").alias("media_id"), "date")


def _sent(rows: DataFrame) -> DataFrame:
    return rows.withColumn("date", F.substring("sent_at", 1, 10))


def _totals(*, events: DataFrame, media: DataFrame, vlm: DataFrame, ocr: DataFrame, messages: DataFrame, calls: DataFrame, named: bool) -> list[DataFrame]:
    """The totals of dates; where `named`, titles, confidence, categories and states of calls too, in the same passes."""
    every, c = F.lit(True), F.col
    own = _own_dates(media)
    at, title, sure, call_state = {("total", "events"): every}, {}, {}, {}
    seen, called = {("total", "vlm_photos"): every}, {("total", "calls"): every}
    models = vlm.join(own, "media_id")
    if named:
        title, call_state = {"title": F.coalesce(truthy("title"), F.lit("untitled"))}, {"call": F.coalesce(truthy("call_status"), F.lit("unknown"))}
        sure = {("confidence", x): c("confidence").isNotNull() & (level(c("confidence")) == x) for x in ("高", "中", "低")}
        events, models = _lowered(events, EVENT_TEXT), _lowered(models, MODEL_TEXT)
        at, seen, called = at | sure | _categories(tuple(CATEGORIES)), seen | _categories(("food_cafe", "performance_stage")), called | {("category", "call"): every}
    return [
        _counted(events, title, at),
        _counted(_captured(media), fixed={("total", "photos"): every, ("total", "gps_photos"): c("gps_lat").isNotNull() & c("gps_lon").isNotNull()}),
        _counted(models, fixed=seen), _counted(ocr.where("status = 'success'").join(own, "media_id"), fixed={("total", "ocr_photos"): every}),
        _counted(_sent(messages), fixed={("total", "messages"): every}), _counted(_sent(calls), call_state, called),
    ]


def daily_totals(*, events: DataFrame, media: DataFrame, vlm: DataFrame, ocr: DataFrame, messages: DataFrame, calls: DataFrame) -> DataFrame:
    """(date, section, name, value) of the totals that `best_days` needs: no evidence, place or person is read."""
    return _summed(*_totals(events=events, media=media, vlm=vlm, ocr=ocr, messages=messages, calls=calls, named=False))


def daily_counts(*, events, all_events, evidence, media, vlm, ocr, messages, calls, event_places) -> DataFrame:
    """(date, section, name, value) of all sections but those of people."""
    shown = events.select(F.col("id").alias("event_id"), "date")
    dated = all_events.select(F.col("id").alias("event_id"), "date")
    parts = _totals(events=events, media=media, vlm=vlm, ocr=ocr, messages=messages, calls=calls, named=True)
    parts.append(_counted(evidence.join(shown, "event_id"), {"evidence": F.coalesce(truthy("evidence_type"), F.lit("unknown"))}, {("total", "evidence"): F.lit(True)}))
    at = _linked(event_places, "place_id", dated, "event_id").groupBy("date", F.lit("place").alias("section"), F.col("place_id").cast("string").alias("name"))
    parts.append(at.agg(F.sum("n").cast("double").alias("value")))
    return _summed(*parts)


def _linked(rows: DataFrame, key: str, dated: DataFrame, to: str) -> DataFrame:
    """(date, key, n) of different links (key, to) with the dated rows of `to`. Links without one are gone before they are told
    apart, which needs no further exchange."""
    days = dated.where("date <> ''").repartition(to).groupBy(to, "date").agg(F.count("*").alias("n"))
    return rows.select(key, to).join(days, to).distinct().select("date", key, "n")


def daily_people(*, all_events, media, messages, calls, event_people, media_people, speaker_links) -> DataFrame:
    """(date, section, name, value) of people: events, media, messages and calls of each."""
    dated = all_events.select(F.col("id").alias("event_id"), "date")
    speakers = speaker_links.where(flag("is_verified")).select("chat_id", F.col("speaker_name").alias("sender"), "person_id")

    def spoken(rows: DataFrame) -> DataFrame:
        # Counted by speaker before people are joined, so a busy chat is a few rows a day.
        n = _sent(rows).where("date <> ''").groupBy("date", "chat_id", "sender").agg(F.count("*").alias("n"))
        return n.join(speakers, ["chat_id", "sender"])

    visible = lambda links, dates, to: _linked(links.where(~flag("is_hidden")), "person_id", dates, to)
    rows = {
        "person_events": visible(event_people, dated, "event_id"),
        "person_media": visible(media_people, _own_dates(media), "media_id"),
        "person_messages": spoken(messages), "person_calls": spoken(calls),
    }
    return _summed(*[df.select("date", F.lit(section).alias("section"), F.col("person_id").cast("string").alias("name"), F.col("n").cast("double").alias("value")) for section, df in rows.items()])


def daily_facts(*, events, all_events, evidence, media, vlm, ocr, messages, calls, event_places, event_people, media_people, speaker_links) -> DataFrame:
    """(date, section, name, value) of all sources.

    `events` are those that may be shown, `all_events` those whose places and people count; `vlm` has the rows usable in summaries.
    Links that occur more than once count once. Rows without a date count nowhere, titles and states that are empty as untitled and unknown.
    """
    counts = daily_counts(events=events, all_events=all_events, evidence=evidence, media=media, vlm=vlm, ocr=ocr, messages=messages, calls=calls, event_places=event_places)
    return counts.unionByName(daily_people(all_events=all_events, media=media, messages=messages, calls=calls, event_people=event_people, media_people=media_people, speaker_links=speaker_links))


def _days(ranges: DataFrame) -> DataFrame:
    """(range_id, date) of each range with a valid start and end."""
    start, end = F.try_to_date("date_from"), F.try_to_date("date_to")
    return ranges.where(start <= end).select("range_id", F.explode(F.transform(F.sequence(start, end), lambda d: d.cast("string"))).alias("date")).distinct()


def range_facts(ranges: DataFrame, daily: DataFrame) -> DataFrame:
    """(range_id, date, section, name, value): what the dates of each range (range_id, date_from, date_to) hold. Ranges that are
    the same row count once; those without a valid start and end, or that end before they start, hold nothing.

    The counts are written first: each section of a summary filters them by itself, and would have its own pass of the sources.
    """
    return _days(ranges).join(written(daily), "date").select("range_id", "date", "section", "name", "value")


def range_people(ranges: DataFrame, daily: DataFrame, persons: DataFrame) -> DataFrame:
    """(range_id, section, name, value) of `daily_people`: the people of most of each range, as `summary` takes them.

    A person's counts are dealt by name, a few a date, and only there meet the ranges, so the copies of overlapping ranges are
    neither written nor exchanged. The tenth best of a date bounds the tenth best of each range that holds the date from below; who has
    less than that on all dates together is left out of the range.
    """
    alone = Window.partitionBy("name")
    own = daily.join(_visible(persons), "name").repartition("name").groupBy("name", "label", "date").agg(*[F.coalesce(F.sum(F.when(F.col("section") == k, F.col("value"))), F.lit(0.0)).alias(k) for k in KINDS])
    own = written(own.withColumn("total", reduce(lambda a, b: a + b, map(F.col, KINDS))).withColumn("ever", F.sum("total").over(alone)))
    tenth = _first(own, PEOPLE, F.desc("total"), by="date").where(F.col("rank") == PEOPLE).select("date", F.col("total").alias("tenth"))
    days = _days(ranges)
    least = days.join(tenth, "date").groupBy("range_id").agg(F.max("tenth").alias("least"))
    held = own.alias("o").join(F.broadcast(days.join(least, "range_id", "left").fillna(0.0, ["least"]).alias("d")), (F.col("o.date") == F.col("d.date")) & (F.col("ever") >= F.col("least")))
    best = _best_people(held.groupBy("range_id", "name", "label").agg(*[F.sum(c).alias(c) for c in [*KINDS, "total"]]))
    return best.select("range_id", "name", F.inline(F.array(*[F.struct(F.lit(k).alias("section"), F.col(k).alias("value")) for k in KINDS]))).where("value > 0").select("range_id", "section", "name", "value")


def _first(rows: DataFrame, n: int, *order: Column, by: str | list[str] = "range_id") -> DataFrame:
    keys = [by] if isinstance(by, str) else by
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("rank") <= n)


def summary(held: DataFrame, places: DataFrame, persons: DataFrame, public: bool = False, people: DataFrame | None = None) -> DataFrame:
    """(range_id, section, name, value) of `range_facts`: totals, titles, calls, categories, confidence, evidence, places by category and
    label, people by each kind, and the score in hundredths of the best days.

    In public, places have their public name or category only, and no people are given. `people` are those of `range_people`
    where `held` has none.
    """
    sums = held.groupBy("range_id", "section", "name").agg(F.sum("value").alias("value"))
    columns = ["range_id", "section", "name", "value"]
    best_first = (F.desc("value"), F.col("name"))
    plain = sums.where(F.col("section").isin("total", "call", "category", "confidence", "evidence"))
    titles = _first(sums.where("section = 'title'"), TITLES, *best_first)
    label = F.coalesce(truthy("public_name"), "category") if public else F.coalesce(truthy("display_name"), truthy("public_name"), "category")
    other = F.lit("other")
    known = places.select(F.col("id").alias("name"), "category", label.alias("label"))
    top = _first(sums.where("section = 'place'").join(known, "name"), PLACES, F.desc("value"), F.col("category"), F.col("name"))
    folds = top.select("range_id", "value", F.inline(F.array(*[F.struct(F.lit(s).alias("section"), F.coalesce(c, other).alias("name")) for s, c in (("place_category", F.col("category")), ("place_label", F.col("label")))])))
    folds = _first(folds.groupBy("range_id", "section", "name").agg(F.sum("value").alias("value")), FOLDED, *best_first, by=["range_id", "section"])
    days = best_days(held).select("range_id", F.lit("day").alias("section"), F.col("date").alias("name"), F.col("score").cast("double").alias("value"))
    parts = [plain, titles, folds, days]
    if not public:
        parts.append(_people(sums, persons) if people is None else people)
    return reduce(DataFrame.unionByName, [p.select(*columns) for p in parts])


def _visible(persons: DataFrame) -> DataFrame:
    label = F.coalesce(truthy("display_name"), truthy("public_name"), "id")
    return persons.where(~flag("is_hidden") & ~flag("is_deleted")).select(F.col("id").alias("name"), label.alias("label"))


def _best_people(totals: DataFrame) -> DataFrame:
    return _first(totals, PEOPLE, F.desc("total"), F.col("label"), F.col("name"))


def _people(sums: DataFrame, persons: DataFrame) -> DataFrame:
    """Counts by kind of each range's people of most, by label and id on ties; hidden and deleted ones are left out."""
    wide = sums.where(F.col("section").isin(KINDS)).groupBy("range_id", "name").agg(F.sum("value").alias("total"), F.collect_list(F.struct("section", "value")).alias("kinds"))
    top = _best_people(wide.join(_visible(persons), "name"))
    return top.select("range_id", "name", F.inline("kinds")).select("range_id", "section", "name", "value")


def best_days(held: DataFrame, days: int = DAYS) -> DataFrame:
    """(range_id, date, rank, score, counters): the days of each range with the best score, later ones first on ties."""
    count = lambda name: F.coalesce(F.sum(F.when(F.col("name") == name, F.col("value"))), F.lit(0.0)).cast("long")
    wide = held.where("section = 'total'").groupBy("range_id", "date").agg(*[count(name).alias(c) for name, c in COUNTERS.items()])
    busy = wide.where(reduce(lambda a, b: a + b, map(F.col, COUNTERS.values())) > 0).withColumn("score", day_score().cast("long"))
    return _first(busy, days, F.desc("score"), F.desc("date")).select("range_id", "date", "rank", "score", *COUNTERS.values())


def day_events(best: DataFrame, events: DataFrame, evidence: DataFrame, each: int = EVENTS) -> DataFrame:
    """(range_id, date, rank, position, id, title, confidence, n_line, n_photo, n_ocr, n_vlm): the surest events of the best days.

    Only dates that are best somewhere are ranked, each once, and only evidence of the events shown is counted.
    """
    wanted = events.join(best.select("date").distinct(), "date", "left_semi")
    top = _first(wanted, each, F.desc(F.coalesce("confidence", F.lit(0.0))), F.coalesce("start_time", F.lit("")), F.col("id"), by="date").withColumnRenamed("rank", "position")
    top = top.select("date", "position", "id", "title", "confidence")
    kinds = ["line", "photo", "ocr", "vlm"]
    counts = evidence.join(top.select(F.col("id").alias("event_id")), "event_id", "left_semi").groupBy(F.col("event_id").alias("id")).agg(*[F.count_if(F.col("evidence_type") == k).alias(f"n_{k}") for k in kinds])
    shown = top.join(counts, "id", "left").fillna(0, [f"n_{k}" for k in kinds])
    return best.select("range_id", "date", "rank").join(shown, "date").select("range_id", "date", "rank", "position", "id", "title", "confidence", *[f"n_{k}" for k in kinds])
