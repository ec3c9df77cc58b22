"""Statistics of events, calls, texts, places and people; monthly summaries; comparisons of snapshots."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.text import any_term
from .search import flag, truthy

#: Upper ends of confidence buckets, and the words of each category of a summary.
CONFIDENCE_EDGES = ((0.3, "0.0-0.3"), (0.6, "0.3-0.6"), (0.8, "0.6-0.8"))
CATEGORIES = {
    "food_cafe": ("食事", "カフェ", "ご飯", "料理", "meal", "food", "rice", "cafe", "restaurant", "ramen"),
    "performance_stage": ("パフォーマンス", "ステージ", "performance", "stage", "theater", "dancing", "dance"),
    "photo": ("写真", "photo", "image", "位置情報付き写真", "写真撮影"),
    "line": ("LINE", "line", "やりとり"),
    "call": ("通話", "電話", "call"),
}


def sections(parts: dict[str, DataFrame]) -> DataFrame:
    """One (section, name, value) table from the named counts of each section."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(k).alias("section"), F.col("name").cast("string").alias("name"), F.col("value").cast("double").alias("value")) for k, df in parts.items()])


def counted(rows: DataFrame, name: Column | str) -> DataFrame:
    return rows.groupBy((F.col(name) if isinstance(name, str) else name).alias("name")).agg(F.count("*").alias("value"))


def most(rows: DataFrame, n: int) -> DataFrame:
    """The `n` greatest, names ascending on ties."""
    return rows.orderBy(F.desc("value"), "name").limit(n)


def measures(rows: DataFrame, **named: Column) -> DataFrame:
    """Several aggregates of one pass as (name, value) rows."""
    one = rows.agg(*[c.cast("double").alias(k) for k, c in named.items()])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("name"), F.col(k).alias("value")) for k in named])))


def bucketed(value: Column) -> Column:
    out = F.lit("0.8-1.0")
    for edge, name in reversed(CONFIDENCE_EDGES):
        out = F.when(value < edge, name).otherwise(out)
    return F.when(value.isNotNull(), out)


def event_stats(events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Totals, months, busiest days, titles, confidence with buckets, evidence types, modality and the least confident."""
    kinds = evidence.groupBy(F.col("event_id").alias("id")).agg(F.bool_or(F.col("evidence_type") == "photo").alias("photo"), F.bool_or(F.col("evidence_type") == "line").alias("line"))
    c = F.col("confidence")
    has = lambda k: F.coalesce(k, F.lit(False))
    modality = F.when(has("photo") & has("line"), "both").when(has("photo"), "photo_only").when(has("line"), "line_only").otherwise("none")
    return sections({
        "total": measures(events, events=F.count("*")),
        "month": counted(events, F.substring("date", 1, 7)),
        "day": most(counted(events, "date"), 20),
        "title": most(counted(events, "title"), 50),
        "confidence": measures(events, minimum=F.min(c), maximum=F.max(c), average=F.round(F.avg(c), 6)),
        "bucket": counted(events.where(c.isNotNull()), bucketed(c)),
        "evidence": counted(evidence, "evidence_type"),
        "modality": counted(events.join(kinds, "id", "left"), modality),
        "low_confidence": events.orderBy(F.asc_nulls_last("confidence"), "id").limit(20).select(F.col("id").alias("name"), F.col("confidence").alias("value")),
    })


def call_stats(calls: DataFrame) -> DataFrame:
    """Statuses over their whole domain, seconds of completed calls, the longest, days, months and callers."""
    #: The domain of call statuses.
    domain = calls.sparkSession.createDataFrame([(s,) for s in ("completed", "missed", "unanswered", "canceled", "unknown")], "name string")
    done = calls.where("call_status = 'completed'")
    s = F.col("duration_sec")
    return sections({
        "status": domain.join(counted(calls, "call_status"), "name", "left").fillna(0),
        "duration": measures(done, total=F.coalesce(F.sum(s), F.lit(0)), counted=F.count(s), longest=F.coalesce(F.max(s), F.lit(0)), average=F.round(F.avg(s), 6)),
        "longest": done.where(s.isNotNull()).orderBy(F.desc(s), "sent_at", "id").limit(10).select(F.col("id").alias("name"), s.alias("value")),
        "day": counted(calls, F.substring("sent_at", 1, 10)),
        "month": counted(calls, F.substring("sent_at", 1, 7)),
        "sender": most(counted(calls, "sender"), 20),
    })


def day_calls(calls: DataFrame) -> DataFrame:
    at = lambda s: F.count_if(F.col("call_status") == s).alias(s)
    return calls.groupBy(F.substring("sent_at", 1, 10).alias("date")).agg(*map(at, ("completed", "missed", "unanswered", "canceled")), F.coalesce(F.sum("duration_sec"), F.lit(0)).cast("long").alias("total_sec"), F.coalesce(F.max("duration_sec"), F.lit(0)).cast("long").alias("max_sec"))


def ocr_stats(ocr: DataFrame, evidence: DataFrame) -> DataFrame:
    """Statuses, engines, single languages, length buckets and days of successes, and the events that they support."""
    n = F.length("ocr_text")
    good = ocr.where("status = 'success'")
    size = F.when(F.coalesce(n, F.lit(0)) == 0, "empty").when(n <= 50, "1-50").when(n <= 200, "51-200").when(n <= 1000, "201-1000").otherwise("1001+")
    return sections({
        "status": counted(ocr, "status"), "engine": counted(ocr, "ocr_engine"),
        "language": counted(ocr.select(F.explode(F.split("ocr_languages", r"\+")).alias("l")), "l"),
        "length": counted(good, size), "day": counted(good, F.substring("analyzed_at", 1, 10)),
        "events": measures(evidence.where("evidence_type = 'ocr'").join(good.select(F.col("media_id").alias("evidence_id")), "evidence_id", "left_semi"), events=F.count_distinct("event_id")),
    })


def vlm_stats(rows: DataFrame) -> DataFrame:
    """Statuses, engines, the top tags of each kind from their JSON arrays, people and days of successes."""
    good = rows.where("status = 'success'")
    tags = lambda c: most(counted(good.select(F.explode(F.from_json(c, "array<string>")).alias("x")), "x"), 20)
    return sections({
        "status": counted(rows, "status"), "engine": counted(rows, "vlm_engine"), "scene": tags("scene_tags_json"), "food": tags("food_cues_json"), "activity": tags("activity_tags_json"),
        "people": measures(good, present=F.count_if(F.col("people_count") > 0)), "day": counted(good, F.substring("analyzed_at", 1, 10)),
    })


def vector_stats(vectors: DataFrame) -> DataFrame:
    return sections({"type": counted(vectors, "embedding_type"), "model": counted(vectors, "embedding_model"), "status": counted(vectors, "status"), "dimension": counted(vectors, F.size("embedding"))})


def place_stats(events: DataFrame, evidence: DataFrame, places: DataFrame) -> DataFrame:
    """Locations of events (all and top), those without, GPS and photo evidence, and places by privacy and category."""
    named = events.withColumn("location", truthy(F.trim("location_name")))
    photos = evidence.where("evidence_type = 'photo'").select(F.col("event_id").alias("id"))
    return sections({
        "location": most(counted(named.where("location is not null"), "location"), 20),
        "events": measures(named, located=F.count("location"), unset=F.count_if(F.col("location").isNull()), distinct=F.count_distinct("location"), gps=F.count_if(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull())),
        "photo": measures(named.where("location is not null").join(photos, "id", "left_semi"), with_photo=F.count("*")),
        "privacy": counted(places, "privacy_level"), "category": counted(places, "category"),
        "places": measures(places, total=F.count("*"), hidden=F.count_if(flag("hidden")), sensitive=F.count_if(F.col("privacy_level") == "sensitive")),
    })


def people_stats(persons: DataFrame, media_people: DataFrame, event_people: DataFrame, events: DataFrame, date_from: str | None = None, date_to: str | None = None) -> DataFrame:
    """Totals, links by source and the people of most events. With a range the dates stand in the WHERE
    clause after outer joins, so that people without an event in the range drop out; without one all people count."""
    ranged = date_from is not None or date_to is not None
    dates = events.select(F.col("id").alias("event_id"), "date")
    own = event_people.where(~flag("is_hidden")).join(dates, "event_id")
    own = own.where(F.col("date").between(date_from or "", date_to or "9999")) if ranged else own
    n = own.groupBy("person_id").agg(F.count_distinct("event_id").alias("value"))
    top = persons.join(n, persons.id == n.person_id, "inner" if ranged else "left").select(F.col("id").alias("name"), F.coalesce("value", F.lit(0)).alias("value"))
    return sections({
        "persons": measures(persons, total=F.count("*"), hidden=F.count_if(flag("is_hidden")), deleted=F.count_if(flag("is_deleted"))),
        "media_source": counted(media_people, "source"), "event_source": counted(event_people, "source"), "top": most(top, 20),
    })


def face_stats(faces: DataFrame, members: DataFrame, clusters: DataFrame, media: DataFrame) -> DataFrame:
    """Face statuses, reviews and days; cluster statuses, a histogram of their sizes and the largest."""
    sizes = members.groupBy("cluster_id").agg(F.count_distinct("face_id").alias("n"))
    days = faces.join(media.select(F.col("id").alias("media_id"), F.substring(F.coalesce("captured_at", "fallback_captured_at"), 1, 10).alias("date")), "media_id")
    return sections({
        "status": counted(faces, "status"), "review": counted(faces, "review_status"), "day": most(counted(days, "date"), 10),
        "cluster_status": counted(clusters, "status"), "cluster_size": counted(sizes, "n"), "largest": most(sizes.select(F.col("cluster_id").alias("name"), F.col("n").alias("value")), 10),
    })


def summary_usable(rows: DataFrame) -> DataFrame:
    """Model rows that count in summaries. Rows that are not event-usable are kept: the rule that would drop
    them reads 0 as unset."""
    fake = F.coalesce(F.contains(F.lower("vlm_engine"), F.lit("fake")), F.lit(False))
    return rows.where((F.col("status") == "success") & ~fake & ~flag("is_hidden") & ~flag("is_wrong"))


def daily_counters(events: DataFrame, media: DataFrame, vlm: DataFrame, ocr: DataFrame, messages: DataFrame, calls: DataFrame) -> DataFrame:
    """Seven counters a day from six sources: each source is counted by itself, then the counts are added."""
    when = F.substring(F.coalesce("captured_at", "fallback_captured_at"), 1, 10).alias("date")
    own = media.select(F.col("id").alias("media_id"), when)
    names = ["events_count", "photos", "gps_photos", "vlm_photos", "ocr_photos", "line_messages", "call_events"]

    def part(df: DataFrame, **counts: Column) -> DataFrame:
        got = df.where("date <> ''").groupBy("date").agg(*[c.alias(k) for k, c in counts.items()])
        return got.select("date", *[F.col(n) if n in counts else F.lit(0).cast("long").alias(n) for n in names])

    n = F.count("*")
    parts = [
        part(events, events_count=n), part(media.withColumn("date", when), photos=n, gps_photos=F.count_if(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull())),
        part(vlm.join(own, "media_id"), vlm_photos=n), part(ocr.where("status = 'success'").join(own, "media_id"), ocr_photos=n),
        part(messages.withColumn("date", F.substring("sent_at", 1, 10)), line_messages=n), part(calls.withColumn("date", F.substring("sent_at", 1, 10)), call_events=n),
    ]
    return reduce(DataFrame.unionByName, parts).groupBy("date").agg(*[F.sum(c).alias(c) for c in names])


def day_score() -> Column:
    """Hundredths of a day's score: fixed weights, counts of photos and messages capped at 80."""
    cap = lambda c: F.least(c, F.lit(80))
    return F.col("events_count") * 500 + cap("photos") * 8 + cap("gps_photos") * 6 + cap("line_messages") * 4 + F.col("call_events") * 150 + F.col("vlm_photos") * 5


def top_days(daily: DataFrame, events: DataFrame, days: int = 5, each: int = 5) -> DataFrame:
    """The best days (later first on ties) with each one's most confident events."""
    best = daily.withColumn("score", day_score().cast("long")).orderBy(F.desc("score"), F.desc("date")).limit(days).select("date", "score")
    w = Window.partitionBy("date").orderBy(F.desc(F.coalesce("confidence", F.lit(0.0))), F.coalesce("start_time", F.lit("")), "id")
    return best.join(events, "date").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= each).select("date", "score", "rank", "id", "title", "confidence")


def category_counts(events: DataFrame, vlm: DataFrame, calls: DataFrame) -> DataFrame:
    """Rows whose text holds any word of a category; events and model texts for some, events alone for others, calls added to calls."""
    e = events.select(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("title", "summary", "location_name")]).alias("text"), F.lit(True).alias("event"))
    v = vlm.select(F.concat_ws(" ", *[F.coalesce(c, F.lit("")) for c in ("caption", "short_caption", "scene_tags_json", "activity_tags_json", "food_cues_json", "location_cues_json")]).alias("text"), F.lit(False).alias("event"))
    both = ("food_cafe", "performance_stage")
    tests = {k: any_term(["text"], list(words)) & (F.lit(True) if k in both else F.col("event")) for k, words in CATEGORIES.items()}
    texts = measures(e.union(v), **{k: F.count_if(c) for k, c in tests.items()})
    return texts.union(measures(calls, call=F.count("*"))).groupBy("name").agg(F.sum("value").alias("value"))


def place_summary(links: DataFrame, places: DataFrame, events: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(by category, by label): events of the 20 places of most events, folded."""
    n = links.join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi").groupBy("place_id").agg(F.count_distinct("event_id").alias("value"))
    rows = places.join(n, places.id == n.place_id).orderBy(F.desc("value"), "category", "id").limit(20)
    fold = lambda c: rows.groupBy(c.alias("name")).agg(F.sum("value").alias("value")).orderBy(F.desc("value"), "name").limit(8)
    return fold(F.coalesce("category", F.lit("other"))), fold(F.coalesce(truthy("display_name"), truthy("public_name"), "category"))


def person_summary(persons: DataFrame, counts: dict[str, DataFrame], most_rows: int = 10) -> DataFrame:
    """Visible people with each counter (person_id, n), by the sum of all; the first rows."""
    rows = persons.where(~flag("is_hidden") & ~flag("is_deleted")).select("id", F.coalesce(truthy("display_name"), truthy("public_name"), "id").alias("label"))
    for name, df in counts.items():
        rows = rows.join(df.select(F.col("person_id").alias("id"), F.col("n").alias(name)), "id", "left")
    rows = rows.fillna(0, list(counts))
    total = reduce(lambda a, b: a + b, [F.col(c) for c in counts])
    return rows.where(total > 0).orderBy(F.desc(total), "label").limit(most_rows)


def month_status(media: DataFrame, **done: DataFrame) -> DataFrame:
    """Photos a month and, of each kind of analysis, how many have succeeded and how many are left."""
    own = media.select(F.col("id").alias("media_id"), F.substring(F.coalesce("captured_at", "fallback_captured_at"), 1, 7).alias("month"))
    for name, df in done.items():
        own = own.join(df.where("status = 'success'").select("media_id").distinct().withColumn(name, F.lit(1)), "media_id", "left")
    counts = [c for k in done for c in (F.count(k).alias(f"{k}_success"), F.greatest(F.count("*") - F.count(k), F.lit(0)).alias(f"{k}_left"))]
    return own.groupBy("month").agg(F.count("*").alias("photos"), *counts)


def analysis_plan(media: DataFrame, results: DataFrame, seconds: float, retry_failed: bool = False) -> DataFrame:
    """(id, reason): media to analyse, with its estimated seconds: without a result, or failed where those are retried."""
    r = results.select(F.col("media_id").alias("id"), "status")
    rows = media.select("id").join(r, "id", "left")
    reason = F.when(F.col("status").isNull(), "missing")
    reason = reason.when(F.col("status") != "success", "failed") if retry_failed else reason
    return rows.select("id", reason.alias("reason"), F.lit(float(seconds)).alias("seconds")).where("reason is not null")


def job_counters(items: DataFrame) -> DataFrame:
    """Items of each job by status, and the job's status."""
    n = lambda s: F.count_if(F.col("status") == s)
    got = items.groupBy("job_id").agg(F.count("*").alias("total"), n("success").alias("success"), n("failed").alias("failed"), n("skipped").alias("skipped"), n("pending").alias("pending"))
    done = F.when(F.col("pending") > 0, "running").when(F.col("failed") == 0, "completed").when(F.col("success") == 0, "failed").otherwise("partial")
    return got.withColumn("processed", F.col("total") - F.col("pending")).withColumn("job_status", done)


def drafts(media: DataFrame, messages: DataFrame) -> DataFrame:
    """A draft title a day from the counts of photos and messages."""
    days = media.select(F.substring(F.coalesce("captured_at", "fallback_captured_at"), 1, 10).alias("date"), F.lit(1).alias("photo")).union(messages.select(F.substring("sent_at", 1, 10), F.lit(0)))
    got = days.where("date <> ''").groupBy("date").agg(F.sum("photo").alias("photos"), F.count_if(F.col("photo") == 0).alias("lines"))
    return got.withColumn("title", F.format_string("%s: photos=%d, line_messages=%d", "date", "photos", "lines"))


def photo_days(media: DataFrame, n: int) -> DataFrame:
    day = F.substring(F.coalesce("captured_at", "fallback_captured_at"), 1, 10)
    return media.groupBy(day.alias("date")).agg(F.count("*").alias("photos"), F.count_if(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull()).alias("gps_photos")).orderBy(F.desc("photos"), F.desc("gps_photos"), "date").limit(n)


def inspected_day(media: DataFrame, messages: DataFrame) -> DataFrame:
    """(kind, date, n, first, last, bounding box, 24 hourly counts) of each day and kind."""
    m = media.select(F.lit("photo").alias("kind"), F.coalesce("captured_at", "fallback_captured_at").alias("at"), "gps_lat", "gps_lon")
    rows = m.union(messages.select(F.lit("line"), "sent_at", F.lit(None).cast("double"), F.lit(None).cast("double"))).where("at <> ''")
    hour = F.substring("at", 12, 2).cast("int")
    return rows.groupBy("kind", F.substring("at", 1, 10).alias("date")).agg(
        F.count("*").alias("n"), F.min(F.substring("at", 12, 8)).alias("first_time"), F.max(F.substring("at", 12, 8)).alias("last_time"),
        *[f(c).alias(f"{n}_{c[4:]}") for c in ("gps_lat", "gps_lon") for n, f in (("min", F.min), ("max", F.max))],
        F.concat_ws(",", *[F.count_if(hour == h).cast("string") for h in range(24)]).alias("hours"),
    )


def public_titles(events: DataFrame, safe: list[str]) -> DataFrame:
    """Titles that may be shown, all others folded into one."""
    return counted(events, F.when(F.col("title").isin(safe), F.col("title")).otherwise("other"))


def ranking_metrics(results: DataFrame) -> DataFrame:
    """Top-1 accuracy and recall at 3 and 5 of (case_id, rank, relevant) rows."""
    best = results.groupBy("case_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("rank"))
    at = lambda k: F.avg(F.coalesce((F.col("rank") <= k).cast("double"), F.lit(0.0)))
    return best.agg(F.count("*").alias("cases"), at(1).alias("top1"), at(3).alias("recall3"), at(5).alias("recall5"))


def snapshot_summary(events: DataFrame, evidence: DataFrame, low: float = 0.5) -> DataFrame:
    c = F.col("confidence")
    return sections({
        "events": measures(events, total=F.count("*"), low_confidence=F.count_if(c < low), edited=F.count_if(flag("is_user_edited")), average=F.round(F.avg(c), 6)),
        "title": counted(events, "title"), "evidence": counted(evidence, "evidence_type"),
    })


def distribution_deltas(before: DataFrame, after: DataFrame, name: str) -> DataFrame:
    """(name, before, after, delta) of a column's counts in two snapshots."""
    a, b = (df.groupBy(F.col(name).alias("name")).agg(F.count("*").alias(c)) for df, c in ((before, "before"), (after, "after")))
    rows = a.join(b, "name", "full").fillna(0, ["before", "after"])
    return rows.withColumn("delta", F.col("after") - F.col("before"))


def report_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(case_id, change) of two evaluation reports of (case_id, passed): newly failed, improved, added, removed or same."""
    a, b = before.select("case_id", F.col("passed").alias("was")), after.select("case_id", F.col("passed").alias("now"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("now").isNull(), "removed").when(F.col("was") & ~F.col("now"), "newly_failed").when(~F.col("was") & F.col("now"), "improved").otherwise("same")
    return a.join(b, "case_id", "full").select("case_id", change.alias("change"))


def review_overview(events: DataFrame) -> DataFrame:
    """Overlaid events of each date: how many, and how many hidden, verified and pinned."""
    return events.groupBy("date").agg(F.count("*").alias("n"), *[F.count_if(flag(c)).alias(c) for c in ("is_hidden", "is_verified", "is_pinned")])


def place_matches(matched: DataFrame, place: str, metres: str) -> DataFrame:
    """Points and the least distance of each matched place."""
    return matched.groupBy(place).agg(F.count("*").alias("n"), F.min(metres).alias("nearest_m"))
