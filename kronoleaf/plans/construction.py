"""Event construction over the activity tables, with SQL where sessions do not depend on all before."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import events as ev, search
from .catalog import query
from .links import _CALLS, _calls
from .searches import _EFFECTIVE

_USABLE = "NOT (lower(status) <> 'success' OR contains(lower(vlm_engine),'fake')) AND is_hidden=0 AND is_wrong=0 AND is_event_usable=1 AND review_status NOT IN ('rejected','wrong')"
_PHOTOS = f"""SELECT m.owner, coalesce(m.captured_at, m.fallback_captured_at) AS tm, 'photo' AS kind, m.id, o.ocr_text, CASE WHEN v.usable THEN v.cap END AS caption, CASE WHEN v.usable THEN v.ana END AS analysis, m.file_name, m.camera_model, m.gps_lat, m.gps_lon
 FROM media m LEFT JOIN (SELECT media_id, ocr_text FROM ocr WHERE status='success') o ON o.media_id = m.id LEFT JOIN (SELECT media_id, {_USABLE} AS usable, coalesce(nullif(short_caption,''), caption) AS cap, concat_ws(' ', scene_tags_json, food_cues_json, activity_tags_json) AS ana FROM ({_EFFECTIVE})) v ON v.media_id = m.id"""
_ITEMS = f"""SELECT owner, tm, kind, id, concat_ws(' ', nullif(caption,''), nullif(ocr_text,''), nullif(analysis,''), file_name, camera_model) AS text, NULL AS message_type, NULL AS call_status, NULL AS duration_sec, gps_lat, gps_lon, NULL AS sender, coalesce(trim(ocr_text)<>'',false) AS has_ocr, coalesce(trim(caption)<>'',false) OR coalesce(trim(analysis)<>'',false) AS has_vlm FROM ({_PHOTOS})
 UNION ALL SELECT m.sender, m.sent_at, 'line', m.id, coalesce(m.text,''), coalesce(m.message_type,'text'), c.call_status, c.duration_sec, NULL, NULL, m.sender, false, false FROM messages m LEFT JOIN ({_CALLS}) c ON c.id = m.id"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


_LOCATIONS = f"list_sort(list_distinct(list_filter(list_transform(list_concat(list_filter({_list(ev.PLACES)}, lambda w: contains(text,w)), regexp_extract_all(text, '{ev.PLACE_ENDING}', 1)), lambda w: trim(w)), lambda w: w <> '')))"
_ACTIVITIES = f"list_sort(list_distinct(list_concat(list_filter({_list(sorted({*ev.WAITING, *ev.FOOD, *ev.OTHER}))}, lambda w: contains(text,w)), CASE WHEN contains(text,'待って') OR contains(text,'待つ') THEN ['待ち合わせ'] ELSE [] END, CASE WHEN contains(text,'食べ') THEN ['食事'] ELSE [] END)))"
_READ = f"SELECT *, substr(tm,1,10) AS date, {_LOCATIONS} AS locs, {_ACTIVITIES} AS acts FROM ({_ITEMS})"


def _items(t):
    effective = search.effective_vlm(t("vlm"), t("vlm_overrides"))
    photos = ev.reviewed_photos(t("media"), effective, search.usable("events"))
    calls = t("messages").join(_calls(t).select("id", "call_status", "duration_sec"), "id", "left")
    return ev.photo_items(photos, t("ocr"), {"owner": F.col("owner")}).unionByName(ev.line_items(calls, {"owner": F.col("sender")}))


@query(f"SELECT owner, date, kind, id, md5(text) AS text, message_type, call_status, cast(duration_sec AS integer) AS duration_sec, gps_lat, has_ocr, has_vlm, array_to_string(locs,'|') AS locations, array_to_string(acts,'|') AS activities FROM ({_READ})")
def event_items(t):
    rows = _items(t).withColumn("locations", F.array_join(ev.locations(F.col("text")), "|")).withColumn("activities", F.array_join(ev.activities(F.col("text")), "|"))
    return rows.select("owner", "date", "kind", "id", F.md5("text").alias("text"), "message_type", "call_status", "duration_sec", "gps_lat", "has_ocr", "has_vlm", "locations", "activities")


_SPECIAL = ", ".join(f"'{s}'" for s in ev.SPECIAL)


@query(f"""WITH i AS ({_READ}), w AS (SELECT *, least(100, CASE WHEN kind='photo' THEN 60 ELSE 65 END + CASE WHEN kind='photo' AND gps_lat IS NOT NULL AND gps_lon IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN len(locs)+len(acts)>0 THEN 10 ELSE 0 END + CASE WHEN kind='photo' AND (has_ocr OR has_vlm) THEN 10 ELSE 0 END + CASE WHEN message_type IN ({_SPECIAL}) THEN 3 ELSE 0 END) AS weight FROM i)
SELECT id AS evidence_id, kind AS evidence_type, cast(weight AS bigint) AS weight FROM w UNION ALL SELECT id, 'ocr', 72 FROM w WHERE kind='photo' AND has_ocr UNION ALL SELECT id, 'vlm', 45 FROM w WHERE kind='photo' AND has_vlm""")
def evidence_weights(t):
    return ev.evidence_rows(_items(t)).select("evidence_id", "evidence_type", "weight")


def _has(words: list[str]) -> str:
    return "(" + " OR ".join(f"contains(text,'{w}')" for w in words) + ")"


_LINE_DONE = f"kind='line' AND (call_status='completed' OR contains(text,'{ev.CALL_DONE}'))"
_LINE_OPEN = f"kind='line' AND (call_status IN ('missed','unanswered','canceled') OR {_has(ev.CALL_OPEN)})"
_AGG = f"""SELECT owner, date, count(*) FILTER (WHERE kind='line') AS n_line, count(*) FILTER (WHERE kind='photo') AS n_photo, count(*) FILTER (WHERE kind='photo' AND gps_lat IS NOT NULL AND gps_lon IS NOT NULL) AS n_gps, count(*) FILTER (WHERE {_LINE_DONE}) AS n_calls, count(*) FILTER (WHERE {_LINE_OPEN}) AS n_open_calls,
 count(*) FILTER (WHERE kind='photo' AND (has_ocr OR has_vlm)) AS n_rich, count(*) FILTER (WHERE kind='photo' AND has_ocr) AS n_ocr, count(*) FILTER (WHERE kind='photo' AND has_vlm) AS n_vlm, bool_or({_has(ev.WAITING)}) AS waiting, bool_or({_has(ev.FOOD)}) AS food, cast(coalesce(sum(duration_sec) FILTER (WHERE kind='line' AND call_status='completed'),0) AS bigint) AS call_seconds,
 max(len(locs)) AS n_loc, max(len(acts)) AS n_act, arg_min(locs[1], (tm, kind, id)) FILTER (WHERE len(locs)>0) AS location_name, array_to_string(list_sort(list_distinct(flatten(list(locs)))),'|') AS locations, array_to_string(list_sort(list_distinct(flatten(list(acts)))),'|') AS activities, min(substr(tm,12,5)) AS start_at, max(substr(tm,12,5)) AS end_at, {', '.join(f"count(*) FILTER (WHERE kind='line' AND message_type='{s}') AS n_{s}" for s in ev.SPECIAL)},
 array_to_string(list(id ORDER BY tm, kind, id)[1:5], ',') AS first_ids FROM i GROUP BY 1,2"""
_TITLE = """CASE WHEN waiting THEN '移動・待ち合わせの可能性' WHEN food THEN '食事・カフェの可能性' WHEN n_calls>=2 OR (n_line>=3 AND n_calls>=greatest(1,n_line//2)) THEN '通話・連絡' WHEN n_open_calls>0 AND n_calls=0 THEN '不在着信・通話未成立' WHEN n_photo>=3 AND n_gps>0 THEN '位置情報付き写真の記録' WHEN n_photo>=3 THEN '写真撮影の記録'
 WHEN n_photo>0 AND n_line>0 THEN '写真とLINEが残る出来事' WHEN n_photo>0 THEN '写真撮影の記録' WHEN n_line>0 THEN 'LINEのやりとり' ELSE '記録された出来事' END"""
_BONUS = [("n_line+n_photo>=2", 12), ("n_line+n_photo>=5", 8), ("n_line>0 AND n_photo>0", 15), ("n_gps>0", 12), ("n_gps>=3", 4), ("n_loc>0", 6), ("n_act>0", 6), ("n_rich>0", 4), ("n_ocr>0 AND n_vlm>0 AND n_line>0", 4)]
_SUM = "35 + " + " + ".join(f"CASE WHEN {c} THEN {n} ELSE 0 END" for c, n in _BONUS)


@query(f"""WITH i AS ({_READ}), g AS ({_AGG}) SELECT owner, date, n_line, n_photo, n_gps, n_calls, n_open_calls, n_rich, call_seconds, {_TITLE} AS title, cast(least(95, CASE WHEN n_vlm>0 AND n_ocr=0 AND n_line=0 THEN least(74, {_SUM}) ELSE {_SUM} END) AS bigint) AS confidence_hundredths, location_name, locations, activities,
concat('event_', sha256(concat_ws('|', '{ev.METHOD}', date, start_at, end_at, '0', first_ids))) AS event_id FROM g""")
def event_drafts_by_day(t):
    """The drafts' rules over whole days of each person."""
    got = ev.drafts(_items(t).withColumn("cluster", F.lit(1)), ["owner"])
    sets = [F.array_join(F.array_sort(c), "|").alias(c) for c in ("locations", "activities")]
    return got.select("owner", "date", "n_line", "n_photo", "n_gps", "n_calls", "n_open_calls", "n_rich", "call_seconds", "title", "confidence_hundredths", "location_name", *sets, "event_id")


@query()
def built_events(t):
    """Events of all days of all people; the sessions depend on all before, so there is no SQL."""
    got = ev.drafts(ev.with_clusters(_items(t), ["owner"]), ["owner"])
    return got.select("owner", "event_id", "date", F.date_format("start_at", "HH:mm:ss").alias("start_time"), F.date_format("end_at", "HH:mm:ss").alias("end_time"), "title", "summary", "location_name", "gps_lat", "gps_lon", F.array_join("participants", ",").alias("participants"), (F.col("confidence_hundredths") / 100).alias("confidence"))


@query()
def built_evidence(t):
    """(event_id, evidence_type, evidence_id, weight) of the events built."""
    items = ev.with_event_ids(ev.with_clusters(_items(t), ["owner"]), ["owner"])
    return ev.evidence_rows(items).select("event_id", "evidence_type", "evidence_id", "weight")


_NEW = "SELECT DISTINCT concat('new_', date) AS id, date, 'generated' AS source, 0 AS is_user_edited, 'draft' AS title FROM life_events WHERE date BETWEEN '2024-01-05' AND '2024-01-10'"
_KEPT = "SELECT id, date, source, is_user_edited, title FROM life_events WHERE NOT (date BETWEEN '2024-01-05' AND '2024-01-10' AND source = 'generated' AND is_user_edited = 0)"


def _rebuild(t):
    old = t("life_events").select("id", "date", "source", "is_user_edited", "title")
    dates = old.where("date between '2024-01-05' and '2024-01-10'").select("date").distinct()
    drafts = dates.select(F.concat(F.lit("new_"), "date").alias("id"), "date", F.lit("generated").alias("source"), F.lit(0).alias("is_user_edited"), F.lit("draft").alias("title"))
    return old, ev.rebuilt(old, drafts, dates), drafts, dates


@query(f"SELECT id, title FROM ({_KEPT} UNION ALL {_NEW})")
def rebuilt_events(t):
    """Six dates rebuilt twice; the second time changes nothing."""
    _, once, drafts, dates = _rebuild(t)
    return ev.rebuilt(once, drafts, dates).select("id", "title")


@query(f"WITH b AS ({_KEPT} UNION ALL {_NEW}) SELECT CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'removed' WHEN a.title IS NOT DISTINCT FROM b.title THEN 'same' ELSE 'changed' END AS change, count(*) AS n FROM life_events a FULL JOIN b ON a.id = b.id GROUP BY 1")
def rebuild_report(t):
    old, new, *_ = _rebuild(t)
    return ev.rebuild_report(old, new, ["title"])
