"""Search and review queries, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evidence, search
from .catalog import query

TERMS = ["ランチ", "picture", "新宿", "secret"]


def _like(columns: list[str], terms: list[str] = TERMS) -> str:
    return "(" + " OR ".join(f"coalesce(contains(lower({c}), '{t.lower()}'), false)" for c in columns for t in terms) + ")"


_PLACE = ["p.display_name", "p.public_name", "p.category", "p.aliases_json"]


def _placed(links: str, key: str, terms: list[str]) -> str:
    return f"(SELECT DISTINCT {key} FROM {links} l JOIN places p ON p.id = l.place_id WHERE p.hidden = 0 AND p.searchable = 1 AND {_like(_PLACE, terms)})"


_EVENT_TERMS = ["食事", "edited", "japan", "private"]
_EVENTS = f"SELECT e.id FROM life_events e LEFT JOIN overrides o ON o.event_id = e.id WHERE coalesce(o.is_hidden, 0) = 0 AND ({_like([*search.EVENT_FIELDS], _EVENT_TERMS)} OR e.id IN {_placed('event_places', 'event_id', _EVENT_TERMS)})"
_FAKE = "(lower(status) <> 'success' OR contains(lower(vlm_engine), 'fake'))"
_EFFECTIVE = """SELECT v.media_id, coalesce(nullif(o.caption_override,''), v.caption) AS caption, coalesce(nullif(o.short_caption_override,''), v.short_caption) AS short_caption, coalesce(nullif(o.scene_tags_override_json,''), v.scene_tags_json) AS scene_tags_json, coalesce(nullif(o.object_tags_override_json,''), v.object_tags_json) AS object_tags_json, coalesce(nullif(o.activity_tags_override_json,''), v.activity_tags_json) AS activity_tags_json, coalesce(nullif(o.food_cues_override_json,''), v.food_cues_json) AS food_cues_json, coalesce(nullif(o.location_cues_override_json,''), v.location_cues_json) AS location_cues_json, v.text_cues_json, v.safety_flags_json,
 v.status, v.vlm_engine, v.people_count, v.confidence, v.analyzed_at, coalesce(o.is_verified,0) AS is_verified, coalesce(o.is_hidden,0) AS is_hidden, coalesce(o.is_wrong,0) AS is_wrong, coalesce(o.is_searchable,1) AS is_searchable, coalesce(o.is_event_usable,1) AS is_event_usable, coalesce(nullif(o.review_status,''),'unreviewed') AS review_status
 FROM vlm v LEFT JOIN vlm_overrides o ON o.media_id = v.media_id"""
_USABLE = f"NOT {_FAKE} AND is_hidden = 0 AND is_wrong = 0 AND is_searchable = 1 AND review_status NOT IN ('rejected','wrong')"
_VLM = f"SELECT media_id FROM ({_EFFECTIVE}) WHERE {_USABLE} AND {_like(search.VLM_FIELDS, ['ramen', 'station'])}"


def _events(t, terms=_EVENT_TERMS, **more):
    return search.search_events(t("life_events"), t("overrides"), t("event_places"), t("places"), terms, **more)


@query(_EVENTS)
def event_search(t):
    return _events(t).select("id")


_MEDIA_TERMS = ["img_1", "ent", "secret", "src5", "peru"]
_MEDIA_ALL = f"SELECT id FROM media WHERE {_like(['file_name'], _MEDIA_TERMS)} OR id IN (SELECT media_id FROM ocr WHERE {_like(['ocr_text'], _MEDIA_TERMS)}) OR id IN (SELECT media_id FROM vlm WHERE NOT {_FAKE} AND {_like(['caption'], _MEDIA_TERMS)}) OR id IN {_placed('media_places', 'media_id', _MEDIA_TERMS)}"


@query(_MEDIA_ALL)
def media_search(t):
    return search.search_media(t("media"), t("ocr"), t("vlm"), t("media_places"), t("places"), _MEDIA_TERMS).select("id")


@query(f"SELECT media_id, ocr_engine FROM ocr WHERE status = 'success' AND {_like(['ocr_text', 'ocr_text_redacted'], ['secret', 'tion'])}")
def ocr_search(t):
    return search.search_ocr(t("ocr"), ["secret", "tion"]).select("media_id", "ocr_engine")


@query(_VLM)
def vlm_search(t):
    return search.search_vlm(t("vlm"), t("vlm_overrides"), ["ramen", "station"]).select("media_id")


_ALL = ["ランチ", "ramen", "secret"]


@query(
    f"SELECT 'event' AS kind, id, date FROM life_events e LEFT JOIN overrides o ON o.event_id = e.id WHERE coalesce(o.is_hidden,0) = 0 AND ({_like(search.EVENT_FIELDS, _ALL)} OR e.id IN {_placed('event_places', 'event_id', _ALL)})"
    f" UNION ALL SELECT 'line', id, substr(sent_at,1,10) FROM messages WHERE {_like(['text'], _ALL)}"
    f" UNION ALL SELECT 'media', id, substr(coalesce(captured_at, fallback_captured_at),1,10) FROM media WHERE {_like(['file_name'], _ALL)} OR id IN (SELECT media_id FROM ocr WHERE {_like(['ocr_text'], _ALL)}) OR id IN (SELECT media_id FROM vlm WHERE NOT {_FAKE} AND {_like(['caption'], _ALL)}) OR id IN {_placed('media_places', 'media_id', _ALL)}"
    f" UNION ALL SELECT 'ocr', media_id, analyzed_at FROM ocr WHERE status = 'success' AND {_like(['ocr_text', 'ocr_text_redacted'], _ALL)}"
    f" UNION ALL SELECT 'vlm', media_id, analyzed_at FROM ({_EFFECTIVE}) WHERE {_USABLE} AND {_like(search.VLM_FIELDS, _ALL)}"
)
def search_everything(t):
    from ..functions.text import any_term

    media = search.search_media(t("media"), t("ocr"), t("vlm"), t("media_places"), t("places"), _ALL)
    return search.search_all({
        "event": (_events(t, _ALL), "id", F.col("date")),
        "line": (t("messages").where(any_term(["text"], _ALL)), "id", F.substring("sent_at", 1, 10)),
        "media": (media, "id", F.substring(F.coalesce("captured_at", "fallback_captured_at"), 1, 10)),
        "ocr": (search.search_ocr(t("ocr"), _ALL), "media_id", F.col("analyzed_at")),
        "vlm": (search.search_vlm(t("vlm"), t("vlm_overrides"), _ALL), "media_id", F.col("analyzed_at")),
    })


_OVERLAID = "SELECT e.id, e.date, e.start_time, e.confidence, coalesce(nullif(o.title_override,''), e.title) AS title, coalesce(nullif(o.summary_override,''), e.summary) AS summary, coalesce(nullif(o.location_name_override,''), e.location_name) AS location_name, e.title AS original_title, e.summary AS original_summary, e.location_name AS original_location_name, coalesce(o.is_verified,0) AS is_verified, coalesce(o.is_hidden,0) AS is_hidden, coalesce(o.is_pinned,0) AS is_pinned FROM life_events e LEFT JOIN overrides o ON o.event_id = e.id"


@query(_OVERLAID)
def overlaid_events(t):
    rows = search.overlaid_events(t("life_events"), t("overrides"))
    return rows.select("id", "date", "start_time", "confidence", "title", "summary", "location_name", "original_title", "original_summary", "original_location_name", "is_verified", "is_hidden", "is_pinned")


_FLAGS = ["media_id", "caption", "short_caption", "is_verified", "is_hidden", "is_wrong", "is_searchable", "is_event_usable", "review_status"]


@query(f"SELECT {', '.join(_FLAGS)}, {_FAKE} AS untrusted, {_USABLE} AS for_search, NOT {_FAKE} AND is_hidden = 0 AND is_wrong = 0 AND is_event_usable = 1 AND review_status NOT IN ('rejected','wrong') AS for_events FROM ({_EFFECTIVE})")
def vlm_effective(t):
    rows = search.effective_vlm(t("vlm"), t("vlm_overrides"))
    return rows.select(*_FLAGS, search.untrusted().alias("untrusted"), search.usable("search").alias("for_search"), search.usable("events").alias("for_events"))


_COUNTED = f"SELECT x.*, coalesce(c.n,0) AS n_evidence, CASE WHEN c.photo > 0 AND c.line > 0 THEN 'both' WHEN c.photo > 0 THEN 'photo_only' WHEN c.line > 0 THEN 'line_only' ELSE 'none' END AS modality FROM ({_OVERLAID}) x LEFT JOIN (SELECT event_id, count(*) AS n, count(*) FILTER (WHERE evidence_type='photo') AS photo, count(*) FILTER (WHERE evidence_type='line') AS line FROM evidence GROUP BY 1) c ON c.event_id = x.id"


def _queue_rows(t):
    counts = evidence.counts(t("evidence"), "event_id", {"photo": F.col("evidence_type") == "photo", "line": F.col("evidence_type") == "line"})
    rows = search.overlaid_events(t("life_events"), t("overrides")).join(counts, F.col("id") == F.col("event_id"), "left").drop("event_id").fillna(0, ["n_evidence", "photo", "line"])
    return rows.withColumn("modality", evidence.modality(F.col("photo"), F.col("line"), ("photo", "line")))


@query(f"SELECT id, date, title, n_evidence, modality FROM ({_COUNTED}) WHERE date >= '2024-01-05' AND date <= '2024-01-25' AND confidence <= 0.6 AND contains(title,'の') AND contains(coalesce(location_name,''),'宿') AND modality IN ('both') AND n_evidence >= 2 AND n_evidence <= 6 AND is_verified = 0 AND is_hidden = 0")
def event_review_queue(t):
    rows = search.event_queue(_queue_rows(t), date_from="2024-01-05", date_to="2024-01-25", confidence_lte=0.6, title_contains="の", location_contains="宿", modality="both", verified="exclude", evidence_min=2, evidence_max=6)
    return rows.select("id", "date", "title", "n_evidence", "modality")


@query(f"SELECT id, is_pinned, date, start_time FROM ({_COUNTED}) WHERE is_hidden = 1 ORDER BY is_pinned DESC, date NULLS FIRST, start_time NULLS FIRST, id LIMIT 100")
def hidden_review_queue(t):
    return search.event_queue(_queue_rows(t), hidden="only").limit(100).select("id", "is_pinned", "date", "start_time")


@query(f"SELECT media_id, review_status, people_count FROM ({_EFFECTIVE}) x WHERE people_count > 0 AND confidence <= 0.8 AND is_hidden = 0 AND media_id IN (SELECT media_id FROM ocr WHERE status = 'success') AND media_id IN (SELECT media_id FROM media_vectors) AND media_id NOT IN (SELECT evidence_id FROM evidence WHERE evidence_type IN ('photo','vlm'))")
def vlm_review_queue(t):
    linked = t("evidence").where(F.col("evidence_type").isin("photo", "vlm")).select(F.col("evidence_id").alias("media_id"))
    rows = search.vlm_queue(search.effective_vlm(t("vlm"), t("vlm_overrides")), people_present=True, low_confidence=0.8, has_ocr=t("ocr").where("status = 'success'"), has_embedding=t("media_vectors"), without_event=linked, hidden=False)
    return rows.select("media_id", "review_status", "people_count")


@query(f"SELECT media_id FROM ({_EFFECTIVE}) WHERE review_status = 'needs_review' AND json_array_length(food_cues_json) > 0")
def vlm_review_food(t):
    return search.vlm_queue(search.effective_vlm(t("vlm"), t("vlm_overrides")), review_status="needs_review", food_cues=True).select("media_id")


@query("SELECT id, contains(lower(file_name), 'img_12') AS named FROM media")
def file_name_guard(t):
    return t("media").select("id", search.name_guard("file_name", " IMG_12 ").alias("named"))


@query("SELECT text AS query, CASE WHEN contains(text,'ラーメン') THEN 'ramen' WHEN contains(text,'カフェ') OR contains(text,'ランチ') THEN 'cafe' END AS entry, count(*) AS n FROM messages WHERE text IS NOT NULL GROUP BY 1,2")
def food_taxonomy(t):
    entry = search.first_entry(F.col("text"), [("ramen", ["ラーメン"]), ("cafe", ["カフェ", "ランチ"])])
    return t("messages").where("text is not null").groupBy(F.col("text").alias("query"), entry.alias("entry")).agg(F.count("*").alias("n"))


@query()
def search_terms_of_messages(t):
    """Terms and keywords of the distinct messages; list order and regex dialect keep it out of SQL."""
    texts = t("messages").where("text <> ''").select("text").distinct()
    return texts.select("text", F.array_join(search.search_terms(F.col("text")), "|").alias("terms"), search.keyword(F.col("text")).alias("keyword"))


@query("WITH d AS (SELECT * FROM (VALUES ('ランチ', 'ランチ,meal,food'), ('カフェ', 'カフェ,cafe,food'), ('映画', '映画,movie')) v(trigger, terms)), q AS (SELECT DISTINCT text FROM messages WHERE text <> '') SELECT q.text, text || coalesce((SELECT ',' || string_agg(t.terms, ',' ORDER BY t.trigger) FROM d t WHERE contains(q.text, t.trigger)), '') AS terms FROM q")
def visual_expansion(t):
    words = [("ランチ", 1, ["ランチ", "meal", "food"]), ("カフェ", 2, ["カフェ", "cafe", "food"]), ("映画", 3, ["映画", "movie"])]
    triggers = t("messages").sparkSession.createDataFrame(words, "trigger string, place int, terms array<string>")
    return search.expanded_terms(t("messages").where("text <> ''").select("text").distinct(), "text", triggers).select("text", F.array_join("terms", ",").alias("terms"))


_EVERY = ["sign", "table", "secret", "IMG_77"]
_FRONT = ", ".join(f"coalesce(o.{o},v.{c}) AS {c}" for c, o in search.REPLACED.items())
_WHEN = "substr(coalesce(captured_at, fallback_captured_at),1,10)"


@query(f"""SELECT x.media_id, m.date FROM (SELECT v.media_id, v.text_cues_json, {_FRONT} FROM vlm v LEFT JOIN vlm_overrides o ON o.media_id=v.media_id WHERE v.status='success' AND NOT contains(lower(v.vlm_engine),'fake')
 AND coalesce(o.is_hidden,0)=0 AND coalesce(o.is_wrong,0)=0 AND coalesce(o.is_searchable,1)=1 AND coalesce(o.review_status,'unreviewed') NOT IN ('rejected','wrong')) x JOIN (SELECT id, file_name, {_WHEN} AS date FROM media) m ON m.id=x.media_id
 WHERE m.date BETWEEN '2024-01-02' AND '2024-01-28' AND ({_like([*search.REPLACED, "text_cues_json", "file_name"], _EVERY)} OR x.media_id IN (SELECT media_id FROM ocr WHERE {_like(["ocr_text"], _EVERY)}))""")
def vlm_candidates(t):
    """Model rows of a range that hold a term in any of their ten fields."""
    return search.vlm_candidates(t("vlm"), t("vlm_overrides"), t("ocr"), t("media"), _EVERY, "2024-01-02", "2024-01-28")


@query(f"SELECT media_id, {', '.join(c for c in search.REPLACED)} FROM ({_EFFECTIVE})")
def vlm_replaced(t):
    """Every field of a model's row that a review may replace, as it holds after the review."""
    return search.effective_vlm(t("vlm"), t("vlm_overrides")).select("media_id", *search.REPLACED)


_LINKED = "SELECT evidence_id FROM evidence WHERE evidence_type IN ('photo','vlm')"


@query(f"SELECT media_id, is_searchable, is_event_usable FROM ({_EFFECTIVE}) WHERE CASE WHEN json_valid(location_cues_json) THEN json_array_length(location_cues_json) > 0 END AND is_wrong=0 AND is_searchable=1 AND is_event_usable=0 AND media_id IN ({_LINKED}) AND media_id IN (SELECT id FROM media WHERE {_WHEN} BETWEEN '2024-01-02' AND '2024-01-28')")
def vlm_review_linked(t):
    """Rows with cues of a location, good for search but not for events, of media in events and in a range of dates."""
    linked = t("evidence").where(F.col("evidence_type").isin("photo", "vlm")).select(F.col("evidence_id").alias("media_id"))
    dates = t("media").select(F.col("id").alias("media_id"), F.substring(F.coalesce("captured_at", "fallback_captured_at"), 1, 10).alias("date"))
    rows = search.vlm_queue(search.effective_vlm(t("vlm"), t("vlm_overrides")), location_cues=True, wrong=False, is_searchable=True, is_event_usable=False, with_event=linked, dates=dates, date_from="2024-01-02", date_to="2024-01-28")
    return rows.select("media_id", "is_searchable", "is_event_usable")


@query(f"SELECT media_id, review_status FROM ({_EFFECTIVE}) WHERE review_status='unreviewed' AND media_id NOT IN (SELECT media_id FROM ocr WHERE status='success' AND ocr_text<>'') AND media_id NOT IN (SELECT evidence_id FROM evidence WHERE evidence_type='vlm' AND weight=0.1)")
def vlm_review_alone(t):
    """Rows without a review that nothing but the model speaks for: no recognised text, no event with evidence of some weight."""
    linked = t("evidence").where("evidence_type = 'vlm' and weight = 0.1d").select(F.col("evidence_id").alias("media_id"))
    rows = search.vlm_queue(search.effective_vlm(t("vlm"), t("vlm_overrides")), unreviewed=True, without_ocr=t("ocr").where("status = 'success' and ocr_text <> ''"), without_event=linked)
    return rows.select("media_id", "review_status")
