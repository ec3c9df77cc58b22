"""Summaries of a table of date ranges, beside their SQL."""

from __future__ import annotations

from ..operators import periods, search, statistics as st
from .catalog import query
from .links import _CALLS, _DATE, _calls
from .searches import _OVERLAID
from .statistics import _E_TEXT, _SCORE, _SUMMARY_VLM, _V_TEXT, _any

_LEVEL = "CASE WHEN confidence>=0.75 THEN '高' WHEN confidence>=0.45 THEN '中' ELSE '低' END"
_WORDS = lambda text, of: " ".join(f"UNION ALL SELECT date, 'category', '{k}' FROM {{0}} WHERE {_any(text, st.CATEGORIES[k])}" for k in of)
_HELD = f"""WITH e AS (SELECT * FROM ({_OVERLAID}) WHERE is_hidden=0), md AS (SELECT id, {_DATE} AS date, gps_lat, gps_lon FROM media), vd AS (SELECT v.*, md.date FROM {_SUMMARY_VLM} v JOIN md ON md.id=v.media_id), cd AS (SELECT *, substr(sent_at,1,10) AS date FROM ({_CALLS})),
sl AS (SELECT * FROM speaker_links WHERE is_verified=1),
raw(date, section, name) AS (SELECT date, 'total', 'events' FROM e UNION ALL SELECT date, 'title', coalesce(nullif(title,''),'untitled') FROM e UNION ALL SELECT date, 'confidence', {_LEVEL} FROM e WHERE confidence IS NOT NULL {_WORDS(_E_TEXT, st.CATEGORIES).format("e")}
 UNION ALL SELECT e.date, 'total', 'evidence' FROM e JOIN evidence v ON v.event_id=e.id UNION ALL SELECT e.date, 'evidence', v.evidence_type FROM e JOIN evidence v ON v.event_id=e.id
 UNION ALL SELECT date, 'total', 'photos' FROM md UNION ALL SELECT date, 'total', 'gps_photos' FROM md WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL UNION ALL SELECT date, 'total', 'vlm_photos' FROM vd {_WORDS(_V_TEXT, ("food_cafe", "performance_stage")).format("vd")}
 UNION ALL SELECT md.date, 'total', 'ocr_photos' FROM ocr o JOIN md ON md.id=o.media_id WHERE o.status='success' UNION ALL SELECT substr(sent_at,1,10), 'total', 'messages' FROM messages
 UNION ALL SELECT date, 'total', 'calls' FROM cd UNION ALL SELECT date, 'category', 'call' FROM cd UNION ALL SELECT date, 'call', call_status FROM cd
 UNION ALL SELECT l.date, 'place', x.place_id FROM (SELECT DISTINCT place_id, event_id FROM event_places) x JOIN life_events l ON l.id=x.event_id
 UNION ALL SELECT l.date, 'person_events', x.person_id FROM (SELECT DISTINCT person_id, event_id FROM event_people WHERE is_hidden=0) x JOIN life_events l ON l.id=x.event_id
 UNION ALL SELECT md.date, 'person_media', x.person_id FROM (SELECT DISTINCT person_id, media_id FROM media_people WHERE is_hidden=0) x JOIN md ON md.id=x.media_id
 UNION ALL SELECT substr(m.sent_at,1,10), 'person_messages', sl.person_id FROM sl JOIN messages m ON m.chat_id=sl.chat_id AND m.sender=sl.speaker_name UNION ALL SELECT cd.date, 'person_calls', sl.person_id FROM sl JOIN cd ON cd.chat_id=sl.chat_id AND cd.sender=sl.speaker_name),
daily AS (SELECT date, section, name, count(*) AS value FROM raw GROUP BY 1,2,3), h AS (SELECT r.range_id, d.* FROM date_ranges r JOIN daily d ON d.date BETWEEN r.date_from AND r.date_to),
w AS (SELECT range_id, date, {', '.join(f"coalesce(sum(value) FILTER (WHERE name='{k}'),0) AS {c}" for k, c in periods.COUNTERS.items())} FROM h WHERE section='total' GROUP BY 1,2),
best AS (SELECT * FROM (SELECT range_id, date, cast(row_number() OVER (PARTITION BY range_id ORDER BY {_SCORE} DESC, date DESC) AS integer) AS rank, cast({_SCORE} AS bigint) AS score, {', '.join(f"cast({c} AS bigint) AS {c}" for c in periods.COUNTERS.values())} FROM w WHERE {'+'.join(periods.COUNTERS.values())}>0) WHERE rank<=5)"""
_TOP = "row_number() OVER (PARTITION BY {} ORDER BY {}) AS k"


def _sources(t):
    """What totals are counted from, the events as they may be shown."""
    shown = search.overlaid_events(t("life_events"), t("overrides")).where("is_hidden = 0")
    vlm = st.summary_usable(search.effective_vlm(t("vlm"), t("vlm_overrides")))
    return {"events": shown, "vlm": vlm, "calls": _calls(t), **{n: t(n) for n in ("media", "ocr", "messages")}}


def _best(t, sources):
    return periods.best_days(periods.range_facts(t("date_ranges"), periods.daily_totals(**sources)))


@query(f"""{_HELD}, s AS (SELECT range_id, section, name, sum(value) AS value FROM h GROUP BY 1,2,3),
p AS (SELECT * FROM (SELECT s.range_id, s.value, coalesce(p.category,'other') AS category, coalesce(nullif(p.display_name,''),p.public_name,p.category,'other') AS label, {_TOP.format("s.range_id", "s.value DESC, p.category NULLS FIRST, p.id")} FROM s JOIN places p ON p.id=s.name WHERE s.section='place') WHERE k<=20),
pf AS (SELECT range_id, 'place_category' AS section, category AS name, sum(value) AS value FROM p GROUP BY 1,3 UNION ALL SELECT range_id, 'place_label', label, sum(value) FROM p GROUP BY 1,3),
n AS (SELECT range_id, name FROM (SELECT s.range_id, s.name, {_TOP.format("s.range_id", "sum(s.value) DESC, any_value(coalesce(nullif(p.display_name,''),p.public_name,p.id)), s.name")} FROM s JOIN persons p ON p.id=s.name WHERE s.section LIKE 'person_%' AND p.is_hidden=0 AND p.is_deleted=0 GROUP BY s.range_id, s.name) WHERE k<=10)
SELECT range_id, section, name, cast(value AS double) AS value FROM (SELECT * FROM s WHERE section IN ('total','call','category','confidence','evidence')
UNION ALL SELECT range_id, section, name, value FROM (SELECT *, {_TOP.format("range_id", "value DESC, name")} FROM s WHERE section='title') WHERE k<=10
UNION ALL SELECT range_id, section, name, value FROM (SELECT *, {_TOP.format("range_id, section", "value DESC, name")} FROM pf) WHERE k<=8
UNION ALL SELECT s.* FROM s JOIN n ON n.range_id=s.range_id AND n.name=s.name WHERE s.section LIKE 'person_%' UNION ALL SELECT range_id, 'day', date, score FROM best)""")
def range_summaries(t):
    """All sections of the summary of each range of a table."""
    sources, every = _sources(t), t("life_events")
    held = periods.range_facts(t("date_ranges"), periods.daily_counts(**sources, all_events=every, evidence=t("evidence"), event_places=t("event_places")))
    daily = periods.daily_people(all_events=every, calls=sources["calls"], **{n: t(n) for n in ("media", "messages", "event_people", "media_people", "speaker_links")})
    return periods.summary(held, t("places"), t("persons"), people=periods.range_people(t("date_ranges"), daily, t("persons")))


@query(f"{_HELD} SELECT * FROM best")
def range_best_days(t):
    """The best days of each range with their counters."""
    return _best(t, _sources(t))


@query(f"""{_HELD}, top AS (SELECT * FROM (SELECT date, id, title, confidence, cast(row_number() OVER (PARTITION BY date ORDER BY coalesce(confidence,0) DESC, coalesce(start_time,''), id) AS integer) AS position FROM e) WHERE position<=5)
SELECT b.range_id, b.date, b.rank, t.position, t.id, t.title, t.confidence, {', '.join(f"(SELECT count(*) FROM evidence v WHERE v.event_id=t.id AND v.evidence_type='{k}') AS n_{k}" for k in ("line", "photo", "ocr", "vlm"))} FROM best b JOIN top t USING (date)""")
def range_day_events(t):
    """The surest events of each range's best days, with their evidence."""
    sources = _sources(t)
    return periods.day_events(_best(t, sources), sources["events"], t("evidence"))
