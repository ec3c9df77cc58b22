"""Statistics, summaries and integrity, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import geo, integrity, search, statistics as st
from .catalog import query
from .links import _CALLS, _DATE, _calls
from .searches import _EFFECTIVE, _OVERLAID


def _sections(parts: dict[str, str]) -> str:
    """One statement from a statement of (name, value) for each section."""
    return " UNION ALL ".join(f"SELECT '{k}' AS section, cast(name AS VARCHAR) AS name, cast(value AS DOUBLE) AS value FROM ({sql}) s" for k, sql in parts.items())


def _count(table: str, name: str, where: str = "true") -> str:
    return f"SELECT {name} AS name, count(*) AS value FROM {table} WHERE {where} GROUP BY 1"


def _most(sql: str, n: int) -> str:
    return f"SELECT * FROM ({sql}) ORDER BY value DESC, name NULLS FIRST LIMIT {n}"


def _one(table: str, where: str = "true", **values: str) -> str:
    return " UNION ALL ".join(f"SELECT '{k}' AS name, {v} AS value FROM {table} WHERE {where}" for k, v in values.items())


_BUCKET = "CASE WHEN confidence < 0.3 THEN '0.0-0.3' WHEN confidence < 0.6 THEN '0.3-0.6' WHEN confidence < 0.8 THEN '0.6-0.8' ELSE '0.8-1.0' END"
_MODALITY = "CASE WHEN coalesce(p,false) AND coalesce(l,false) THEN 'both' WHEN coalesce(p,false) THEN 'photo_only' WHEN coalesce(l,false) THEN 'line_only' ELSE 'none' END"


@query(_sections({
    "total": _one("life_events", events="count(*)"), "month": _count("life_events", "substr(date,1,7)"), "day": _most(_count("life_events", "date"), 20), "title": _most(_count("life_events", "title"), 50),
    "confidence": _one("life_events", minimum="min(confidence)", maximum="max(confidence)", average="round(avg(confidence),6)"), "bucket": _count("life_events", _BUCKET, "confidence IS NOT NULL"), "evidence": _count("evidence", "evidence_type"),
    "modality": _count("(SELECT e.id, k.p, k.l FROM life_events e LEFT JOIN (SELECT event_id, bool_or(evidence_type='photo') AS p, bool_or(evidence_type='line') AS l FROM evidence GROUP BY 1) k ON k.event_id = e.id)", _MODALITY),
    "low_confidence": "SELECT id AS name, confidence AS value FROM life_events ORDER BY confidence NULLS LAST, id LIMIT 20",
}))
def event_stats(t):
    return st.event_stats(t("life_events"), t("evidence"))


_C = f"({_CALLS})"


@query(_sections({
    "status": f"SELECT d.name, count(c.id) AS value FROM (SELECT unnest(['completed','missed','unanswered','canceled','unknown']) AS name) d LEFT JOIN {_C} c ON c.call_status = d.name GROUP BY 1",
    "duration": _one(_C, "call_status='completed'", total="coalesce(sum(duration_sec),0)", counted="count(duration_sec)", longest="coalesce(max(duration_sec),0)", average="round(avg(duration_sec),6)"),
    "longest": f"SELECT id AS name, duration_sec AS value FROM {_C} WHERE call_status='completed' AND duration_sec IS NOT NULL ORDER BY duration_sec DESC, sent_at, id LIMIT 10",
    "day": _count(_C, "substr(sent_at,1,10)"), "month": _count(_C, "substr(sent_at,1,7)"), "sender": _most(_count(_C, "sender"), 20),
}))
def call_stats(t):
    return st.call_stats(_calls(t))


@query(f"SELECT substr(sent_at,1,10) AS date, {', '.join(f"count(*) FILTER (WHERE call_status='{s}') AS {s}" for s in ('completed', 'missed', 'unanswered', 'canceled'))}, cast(coalesce(sum(duration_sec),0) AS bigint) AS total_sec, cast(coalesce(max(duration_sec),0) AS bigint) AS max_sec FROM {_C} GROUP BY 1")
def day_calls(t):
    return st.day_calls(_calls(t))


@query(_sections({
    "status": _count("ocr", "status"), "engine": _count("ocr", "ocr_engine"), "language": _count("(SELECT unnest(string_split(ocr_languages,'+')) AS l FROM ocr)", "l"),
    "length": _count("ocr", "CASE WHEN coalesce(length(ocr_text),0)=0 THEN 'empty' WHEN length(ocr_text)<=50 THEN '1-50' WHEN length(ocr_text)<=200 THEN '51-200' WHEN length(ocr_text)<=1000 THEN '201-1000' ELSE '1001+' END", "status='success'"),
    "day": _count("ocr", "substr(analyzed_at,1,10)", "status='success'"), "events": _one("evidence", "evidence_type='ocr' AND evidence_id IN (SELECT media_id FROM ocr WHERE status='success')", events="count(DISTINCT event_id)"),
}))
def ocr_stats(t):
    return st.ocr_stats(t("ocr"), t("evidence"))


def _tags(column: str) -> str:
    return _most(_count(f"(SELECT unnest(from_json({column}, '[\"VARCHAR\"]')) AS x FROM vlm WHERE status='success')", "x"), 20)


@query(_sections({"status": _count("vlm", "status"), "engine": _count("vlm", "vlm_engine"), "scene": _tags("scene_tags_json"), "food": _tags("food_cues_json"), "activity": _tags("activity_tags_json"), "people": _one("vlm", "status='success'", present="count(*) FILTER (WHERE people_count>0)"), "day": _count("vlm", "substr(analyzed_at,1,10)", "status='success'")}))
def vlm_stats(t):
    return st.vlm_stats(t("vlm"))


@query(_sections({"type": _count("media_vectors", "embedding_type"), "model": _count("media_vectors", "embedding_model"), "status": _count("media_vectors", "status"), "dimension": _count("media_vectors", "len(embedding)")}))
def vector_stats(t):
    return st.vector_stats(t("media_vectors"))


_LOC = "nullif(trim(location_name),'')"


@query(_sections({
    "location": _most(_count("life_events", _LOC, f"{_LOC} IS NOT NULL"), 20),
    "events": _one("life_events", located=f"count({_LOC})", unset=f"count(*) FILTER (WHERE {_LOC} IS NULL)", distinct=f"count(DISTINCT {_LOC})", gps="count(*) FILTER (WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL)"),
    "photo": _one("life_events", f"{_LOC} IS NOT NULL AND id IN (SELECT event_id FROM evidence WHERE evidence_type='photo')", with_photo="count(*)"), "privacy": _count("places", "privacy_level"), "category": _count("places", "category"),
    "places": _one("places", total="count(*)", hidden="count(*) FILTER (WHERE hidden=1)", sensitive="count(*) FILTER (WHERE privacy_level='sensitive')"),
}))
def place_stats(t):
    return st.place_stats(t("life_events"), t("evidence"), t("places"))


def _people_sql(ranged: bool) -> str:
    dates = " AND e.date BETWEEN '2024-01-10' AND '2024-01-19'" if ranged else ""
    n = f"SELECT ep.person_id, count(DISTINCT ep.event_id) AS value FROM event_people ep JOIN life_events e ON e.id = ep.event_id WHERE ep.is_hidden = 0{dates} GROUP BY 1"
    return _sections({
        "persons": _one("persons", total="count(*)", hidden="count(*) FILTER (WHERE is_hidden=1)", deleted="count(*) FILTER (WHERE is_deleted=1)"), "media_source": _count("media_people", "source"), "event_source": _count("event_people", "source"),
        "top": _most(f"SELECT p.id AS name, coalesce(n.value,0) AS value FROM persons p {'JOIN' if ranged else 'LEFT JOIN'} ({n}) n ON n.person_id = p.id", 20),
    })


@query(_people_sql(False))
def people_stats(t):
    return st.people_stats(t("persons"), t("media_people"), t("event_people"), t("life_events"))


@query(_people_sql(True))
def people_stats_of_range(t):
    return st.people_stats(t("persons"), t("media_people"), t("event_people"), t("life_events"), "2024-01-10", "2024-01-19")


_SIZES = "(SELECT cluster_id, count(DISTINCT face_id) AS n FROM face_members GROUP BY 1)"


@query(_sections({
    "status": _count("faces", "status"), "review": _count("faces", "review_status"), "day": _most(_count("faces f JOIN media m ON m.id = f.media_id", _DATE), 10),
    "cluster_status": _count("face_clusters", "status"), "cluster_size": _count(_SIZES, "n"), "largest": f"SELECT cluster_id AS name, n AS value FROM {_SIZES} ORDER BY n DESC, cluster_id LIMIT 10",
}))
def face_stats(t):
    return st.face_stats(t("faces"), t("face_members"), t("face_clusters"), t("media"))


_SUMMARY_VLM = f"(SELECT * FROM ({_EFFECTIVE}) WHERE status='success' AND NOT contains(lower(vlm_engine),'fake') AND is_hidden=0 AND is_wrong=0)"


@query(f"SELECT media_id, is_event_usable FROM {_SUMMARY_VLM}")
def summary_vlm(t):
    return st.summary_usable(search.effective_vlm(t("vlm"), t("vlm_overrides"))).select("media_id", "is_event_usable")


_NAMES = ["events_count", "photos", "gps_photos", "vlm_photos", "ocr_photos", "line_messages", "call_events"]
_DAILY = f"""SELECT date, {', '.join(f"count(*) FILTER (WHERE k='{k}') AS {k}" for k in _NAMES)} FROM (SELECT date, 'events_count' AS k FROM life_events UNION ALL SELECT {_DATE}, 'photos' FROM media UNION ALL SELECT {_DATE}, 'gps_photos' FROM media WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL
 UNION ALL SELECT {_DATE}, 'vlm_photos' FROM {_SUMMARY_VLM} v JOIN media m ON m.id = v.media_id UNION ALL SELECT {_DATE}, 'ocr_photos' FROM ocr o JOIN media m ON m.id = o.media_id WHERE o.status='success' UNION ALL SELECT substr(sent_at,1,10), 'line_messages' FROM messages UNION ALL SELECT substr(sent_at,1,10), 'call_events' FROM {_C}) GROUP BY 1"""
_SCORE = "500*events_count + 8*least(photos,80) + 6*least(gps_photos,80) + 4*least(line_messages,80) + 150*call_events + 5*vlm_photos"


def _daily(t):
    vlm = st.summary_usable(search.effective_vlm(t("vlm"), t("vlm_overrides")))
    return st.daily_counters(t("life_events"), t("media"), vlm, t("ocr"), t("messages"), _calls(t))


@query(_DAILY)
def activity_by_day(t):
    return _daily(t)


@query(f"WITH b AS (SELECT date, cast({_SCORE} AS bigint) AS score FROM ({_DAILY}) ORDER BY 2 DESC, 1 DESC LIMIT 5) SELECT * FROM (SELECT b.date, b.score, cast(row_number() OVER (PARTITION BY b.date ORDER BY coalesce(e.confidence,0) DESC, coalesce(e.start_time,''), e.id) AS integer) AS rank, e.id, e.title, e.confidence FROM b JOIN life_events e ON e.date = b.date) WHERE rank <= 5")
def best_days_with_events(t):
    return st.top_days(_daily(t), t("life_events"))


def _any(text: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains(lower({text}),'{w.lower()}')" for w in words) + ")"


_E_TEXT = "concat_ws(' ', coalesce(title,''), coalesce(summary,''), coalesce(location_name,''))"
_V_TEXT = "concat_ws(' ', coalesce(caption,''), coalesce(short_caption,''), coalesce(scene_tags_json,''), coalesce(activity_tags_json,''), coalesce(food_cues_json,''), coalesce(location_cues_json,''))"
_TEXTS = f"(SELECT {_E_TEXT} AS x, true AS e FROM life_events UNION ALL SELECT {_V_TEXT}, false FROM {_SUMMARY_VLM})"


@query("SELECT name, cast(sum(value) AS double) AS value FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS name, count(*) AS value FROM {_TEXTS} WHERE {_any('x', w)}" + ("" if k in ("food_cafe", "performance_stage") else " AND e") for k, w in st.CATEGORIES.items()) + f" UNION ALL SELECT 'call', count(*) FROM {_C}) GROUP BY 1")
def category_counts(t):
    return st.category_counts(t("life_events"), st.summary_usable(search.effective_vlm(t("vlm"), t("vlm_overrides"))), _calls(t))


_PLACE_TOP = "(SELECT p.*, n.value FROM places p JOIN (SELECT place_id, count(DISTINCT event_id) AS value FROM event_places WHERE event_id IN (SELECT id FROM life_events) GROUP BY 1) n ON n.place_id = p.id ORDER BY n.value DESC, p.category, p.id LIMIT 20)"


@query(_sections({"category": f"SELECT coalesce(category,'other') AS name, sum(value) AS value FROM {_PLACE_TOP} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8", "label": f"SELECT display_name AS name, sum(value) AS value FROM {_PLACE_TOP} GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 8"}))
def place_summary(t):
    category, label = st.place_summary(t("event_places"), t("places"), t("life_events"))
    return st.sections({"category": category, "label": label})


_PERSON_COUNTS = {
    "event_count": "SELECT person_id, count(DISTINCT event_id) AS n FROM event_people WHERE is_hidden=0 AND event_id IN (SELECT id FROM life_events) GROUP BY 1",
    "media_count": "SELECT person_id, count(DISTINCT media_id) AS n FROM media_people WHERE is_hidden=0 AND media_id IN (SELECT id FROM media) GROUP BY 1",
    "line_count": "SELECT s.person_id, count(*) AS n FROM speaker_links s JOIN messages m ON m.chat_id=s.chat_id AND m.sender=s.speaker_name WHERE s.is_verified=1 GROUP BY 1",
    "call_count": f"SELECT s.person_id, count(*) AS n FROM speaker_links s JOIN {_C} m ON m.chat_id=s.chat_id AND m.sender=s.speaker_name WHERE s.is_verified=1 GROUP BY 1",
}


@query("SELECT * FROM (SELECT p.id, coalesce(nullif(p.display_name,''),p.public_name,p.id) AS label, " + ", ".join(f"coalesce({k}.n,0) AS {k}" for k in _PERSON_COUNTS) + " FROM persons p " + " ".join(f"LEFT JOIN ({q}) {k} ON {k}.person_id = p.id" for k, q in _PERSON_COUNTS.items()) + " WHERE p.is_hidden=0 AND p.is_deleted=0) WHERE event_count+media_count+line_count+call_count > 0 ORDER BY event_count+media_count+line_count+call_count DESC, label LIMIT 10")
def person_summary(t):
    ids = lambda name, key: t(name).select(F.col("id").alias(key))
    verified = t("speaker_links").where("is_verified = 1").withColumnRenamed("speaker_name", "sender")
    n = lambda df, c="*": df.groupBy("person_id").agg((F.count(c) if c == "*" else F.count_distinct(c)).alias("n"))
    return st.person_summary(t("persons"), {
        "event_count": n(t("event_people").where("is_hidden = 0").join(ids("life_events", "event_id"), "event_id", "left_semi"), "event_id"),
        "media_count": n(t("media_people").where("is_hidden = 0").join(ids("media", "media_id"), "media_id", "left_semi"), "media_id"),
        "line_count": n(verified.join(t("messages"), ["chat_id", "sender"])), "call_count": n(verified.join(_calls(t), ["chat_id", "sender"])),
    })


@query(f"SELECT substr({_DATE},1,7) AS month, count(*) AS photos, " + ", ".join(f"count({k}.media_id) AS {k}_success, greatest(count(*)-count({k}.media_id),0) AS {k}_left" for k in ("ocr", "vlm")) + " FROM media m " + " ".join(f"LEFT JOIN (SELECT DISTINCT media_id FROM {x} WHERE status='success') {k} ON {k}.media_id = m.id" for k, x in (("ocr", "ocr"), ("vlm", "vlm"))) + " GROUP BY 1")
def month_status(t):
    return st.month_status(t("media"), ocr=t("ocr"), vlm=t("vlm"))


@query("SELECT m.id, CASE WHEN r.status IS NULL THEN 'missing' ELSE 'failed' END AS reason, cast(8 AS double) AS seconds FROM media m LEFT JOIN vlm r ON r.media_id = m.id WHERE r.status IS NULL OR r.status <> 'success'")
def analysis_plan(t):
    return st.analysis_plan(t("media"), t("vlm"), 8.0, retry_failed=True)


@query("SELECT *, total - pending AS processed, CASE WHEN pending>0 THEN 'running' WHEN failed=0 THEN 'completed' WHEN success=0 THEN 'failed' ELSE 'partial' END AS job_status FROM (SELECT job_id, count(*) AS total, " + ", ".join(f"count(*) FILTER (WHERE status='{s}') AS {s}" for s in ("success", "failed", "skipped", "pending")) + " FROM job_items GROUP BY 1)")
def job_counters(t):
    return st.job_counters(t("job_items"))


@query(f"SELECT date, cast(sum(p) AS bigint) AS photos, count(*) FILTER (WHERE p=0) AS lines, date || ': photos=' || cast(sum(p) AS bigint) || ', line_messages=' || count(*) FILTER (WHERE p=0) AS title FROM (SELECT {_DATE} AS date, 1 AS p FROM media UNION ALL SELECT substr(sent_at,1,10), 0 FROM messages) GROUP BY 1")
def daily_drafts(t):
    return st.drafts(t("media"), t("messages"))


@query(f"SELECT {_DATE} AS date, count(*) AS photos, count(*) FILTER (WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL) AS gps_photos FROM media GROUP BY 1 ORDER BY photos DESC, gps_photos DESC, date LIMIT 10")
def photo_days(t):
    return st.photo_days(t("media"), 10)


_INSPECTED = "(SELECT 'photo' AS kind, coalesce(captured_at,fallback_captured_at) AS tm, gps_lat, gps_lon FROM media UNION ALL SELECT 'line', sent_at, NULL, NULL FROM messages)"


@query(f"SELECT kind, substr(tm,1,10) AS date, count(*) AS n, min(substr(tm,12,8)) AS first_time, max(substr(tm,12,8)) AS last_time, min(gps_lat) AS min_lat, max(gps_lat) AS max_lat, min(gps_lon) AS min_lon, max(gps_lon) AS max_lon, concat_ws(',', {', '.join(f"count(*) FILTER (WHERE cast(substr(tm,12,2) AS int)={h})" for h in range(24))}) AS hours FROM {_INSPECTED} GROUP BY 1,2")
def date_inspection(t):
    return st.inspected_day(t("media"), t("messages"))


@query("SELECT CASE WHEN title IN ('食事・カフェの可能性','通話・連絡') THEN title ELSE 'other' END AS name, count(*) AS value FROM life_events GROUP BY 1")
def public_titles(t):
    return st.public_titles(t("life_events"), ["食事・カフェの可能性", "通話・連絡"])


@query("WITH r AS (SELECT event_id AS case_id, row_number() OVER (PARTITION BY event_id ORDER BY weight DESC, evidence_type, evidence_id) AS rank, evidence_type='photo' AS relevant FROM evidence), b AS (SELECT case_id, min(CASE WHEN relevant THEN rank END) AS rank FROM r GROUP BY 1) SELECT count(*) AS cases, avg(CASE WHEN rank<=1 THEN 1.0::double ELSE 0 END) AS top1, avg(CASE WHEN rank<=3 THEN 1.0::double ELSE 0 END) AS recall3, avg(CASE WHEN rank<=5 THEN 1.0::double ELSE 0 END) AS recall5 FROM b")
def ranking_metrics(t):
    from pyspark.sql import Window

    w = Window.partitionBy("event_id").orderBy(F.desc("weight"), "evidence_type", "evidence_id")
    return st.ranking_metrics(t("evidence").select(F.col("event_id").alias("case_id"), F.row_number().over(w).alias("rank"), (F.col("evidence_type") == "photo").alias("relevant")))


@query(_sections({"events": _one("life_events", total="count(*)", low_confidence="count(*) FILTER (WHERE confidence<0.5)", edited="count(*) FILTER (WHERE is_user_edited=1)", average="round(avg(confidence),6)"), "title": _count("life_events", "title"), "evidence": _count("evidence", "evidence_type")}))
def snapshot_summary(t):
    return st.snapshot_summary(t("life_events"), t("evidence"))


@query(f"WITH a AS (SELECT title AS name, count(*) AS before FROM life_events GROUP BY 1), b AS (SELECT title AS name, count(*) AS after FROM ({_OVERLAID}) GROUP BY 1) SELECT coalesce(a.name,b.name) AS name, coalesce(before,0) AS before, coalesce(after,0) AS after, coalesce(after,0)-coalesce(before,0) AS delta FROM a FULL JOIN b ON a.name = b.name")
def title_deltas(t):
    return st.distribution_deltas(t("life_events"), search.overlaid_events(t("life_events"), t("overrides")), "title")


@query("WITH a AS (SELECT id AS case_id, confidence > 0.5 AS was FROM life_events WHERE confidence IS NOT NULL), b AS (SELECT event_id AS case_id, is_verified=1 AS now FROM overrides) SELECT coalesce(a.case_id,b.case_id) AS case_id, CASE WHEN was IS NULL THEN 'added' WHEN now IS NULL THEN 'removed' WHEN was AND NOT now THEN 'newly_failed' WHEN NOT was AND now THEN 'improved' ELSE 'same' END AS change FROM a FULL JOIN b ON a.case_id = b.case_id")
def report_changes(t):
    before = t("life_events").where("confidence is not null").select(F.col("id").alias("case_id"), (F.col("confidence") > 0.5).alias("passed"))
    return st.report_changes(before, t("overrides").select(F.col("event_id").alias("case_id"), (F.col("is_verified") == 1).alias("passed")))


@query(f"SELECT date, count(*) AS n, count(*) FILTER (WHERE is_hidden=1) AS is_hidden, count(*) FILTER (WHERE is_verified=1) AS is_verified, count(*) FILTER (WHERE is_pinned=1) AS is_pinned FROM ({_OVERLAID}) GROUP BY 1")
def review_overview(t):
    return st.review_overview(search.overlaid_events(t("life_events"), t("overrides")))


_H = "pow(sin((radians(p.lat)-radians(e.gps_lat))/2),2)+cos(radians(e.gps_lat))*cos(radians(p.lat))*pow(sin(radians(p.lon-e.gps_lon)/2),2)"


@query(f"WITH d AS (SELECT e.id, p.id AS place_id, p.radius_m, {_H} AS h FROM life_events e, places p WHERE e.gps_lat IS NOT NULL), m AS (SELECT id, place_id, 2*6371000*atan2(sqrt(h),sqrt(1-h)) AS m FROM d WHERE 2*6371000*atan2(sqrt(h),sqrt(1-h)) <= radius_m), b AS (SELECT id, min((m, place_id)) AS b FROM m GROUP BY 1) SELECT b[2] AS place_id, count(*) AS n, round(min(b[1]),6) AS nearest_m FROM b GROUP BY 1")
def place_matches(t):
    points = t("life_events").where("gps_lat is not null").select("id", F.col("gps_lat").alias("lat"), F.col("gps_lon").alias("lon"))
    places = t("places").select(F.col("id").alias("place_id"), F.col("lat").alias("place_lat"), F.col("lon").alias("place_lon"), "radius_m")
    return st.place_matches(geo.nearest_within(points, "id", places, "place_id", 0.01), "place_id", "distance_m").withColumn("nearest_m", F.round("nearest_m", 6))


@query(integrity.sql(integrity.RULES))
def integrity_report(t):
    return integrity.report(t, integrity.RULES)


@query(f"WITH r AS ({integrity.sql([r for r in integrity.RULES if f'{r.table}.{r.metric}' in integrity.STRICT])}) SELECT count(*) FILTER (WHERE n>0) AS n_severe, count(*) FILTER (WHERE n>0)=0 AS ok FROM r")
def integrity_verdict(t):
    rows = integrity.report(t, [r for r in integrity.RULES if f"{r.table}.{r.metric}" in integrity.STRICT])
    return rows.agg(F.count_if(F.col("n") > 0).alias("n_severe")).withColumn("ok", F.col("n_severe") == 0)


@query("SELECT DISTINCT event_id FROM evidence e WHERE evidence_type='photo' AND NOT EXISTS (SELECT 1 FROM media m WHERE m.id = e.evidence_id) ORDER BY 1 LIMIT 10")
def integrity_sample(t):
    return integrity.sample(t, integrity.Orphan("evidence", "missing_photo_refs", "evidence_id", "media", "id", "evidence_type = 'photo'"), "event_id")
