"""Ranking and classification, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import people, ranking as rk, search
from .catalog import query
from .links import _CALLS, _DATE, _calls
from .searches import _EFFECTIVE, _OVERLAID, _like

_HIT_TERMS = ["ランチ", "カフェ", "食"]
_VLM_OK = "NOT (lower(status) <> 'success' OR contains(lower(vlm_engine),'fake')) AND is_hidden = 0 AND is_wrong = 0 AND is_searchable = 1 AND review_status NOT IN ('rejected','wrong')"
_HITS = f"""SELECT 'event' AS kind, id, date, confidence FROM ({_OVERLAID}) WHERE is_hidden=0 AND {_like(['title'], _HIT_TERMS)} UNION ALL SELECT 'line', id, substr(sent_at,1,10), NULL FROM messages WHERE {_like(['text'], _HIT_TERMS)}
 UNION ALL SELECT 'media', id, {_DATE}, NULL FROM media WHERE contains(file_name,'IMG_1') UNION ALL SELECT 'ocr', media_id, analyzed_at, NULL FROM ocr WHERE status='success' AND {_like(['ocr_text'], ['secret'])} UNION ALL SELECT 'vlm', media_id, analyzed_at, NULL FROM ({_EFFECTIVE}) WHERE {_VLM_OK} AND {_like(['caption'], ['src5'])}"""


def _hits(t):
    from ..functions.text import any_term

    e = search.overlaid_events(t("life_events"), t("overrides")).where((F.col("is_hidden") == 0) & any_term(["title"], _HIT_TERMS))
    day = F.substring(F.coalesce("captured_at", "fallback_captured_at"), 1, 10)
    none = F.lit(None).cast("double").alias("confidence")
    part = lambda df, kind, i, d, c=none: df.select(F.lit(kind).alias("kind"), F.col(i).alias("id"), d.alias("date"), c)
    return (
        part(e, "event", "id", F.col("date"), F.col("confidence")).union(part(t("messages").where(any_term(["text"], _HIT_TERMS)), "line", "id", F.substring("sent_at", 1, 10)))
        .union(part(t("media").where(F.contains("file_name", F.lit("IMG_1"))), "media", "id", day)).union(part(search.search_ocr(t("ocr"), ["secret"]), "ocr", "media_id", F.col("analyzed_at")))
        .union(part(search.effective_vlm(t("vlm"), t("vlm_overrides")).where(search.usable("search") & any_term(["caption"], ["src5"])), "vlm", "media_id", F.col("analyzed_at")))
    )


_DAYS = f"""SELECT date, {', '.join(f"count(*) FILTER (WHERE kind='{k}') AS {k}_count" for k in rk.KINDS)}, coalesce(max(confidence) FILTER (WHERE kind='event'),0) AS max_confidence FROM ({_HITS}) WHERE date <> '' GROUP BY 1"""
_SURE = "15*(cast(event_count>0 AS int)+cast(line_count>0 AS int)+cast(media_count>0 AS int)) + 4*least(event_count+line_count+media_count,8) + 15 + 20*least(max_confidence,0.95::double)"


@query(f"SELECT *, event_count*3 + line_count*2 + media_count + ocr_count*2 + vlm_count*2.5::double AS score, round(least({_SURE},95::double)/100,2) AS confidence FROM ({_DAYS})")
def day_results(t):
    return rk.day_results(_hits(t))


def _full_days(t, intent):
    texts = rk.words_of_days(t("messages").where("text <> ''"), F.substring("sent_at", 1, 10), F.col("text"))
    photos = t("media").groupBy(F.substring(F.coalesce("captured_at", "fallback_captured_at"), 1, 10).alias("date")).agg(F.count("*").alias("photos"), F.count("gps_lat").alias("gps"))
    calls = _calls(t).groupBy(F.substring("sent_at", 1, 10).alias("date")).agg(F.count_if(F.col("call_status") == "completed").alias("completed"), F.count_if(F.col("call_status").isin("missed", "unanswered", "canceled")).alias("incomplete"), F.max("duration_sec").alias("max_call_sec"))
    titles = search.overlaid_events(t("life_events"), t("overrides")).where("is_hidden = 0").groupBy("date").agg(F.bool_or(rk.held(F.col("title"), rk.TITLES[intent]) > 0).alias("actual_title"), F.bool_or(F.col("is_pinned") == 1).alias("pinned"), F.bool_or(F.col("is_verified") == 1).alias("verified"))
    days = rk.day_results(_hits(t)).drop("score", "confidence")
    for other in (texts, photos, calls, titles):
        days = days.join(other, "date", "left")
    return days.fillna("", ["text"]).fillna(0, ["photos", "gps", "completed", "incomplete", "max_call_sec"]).fillna(False, ["actual_title", "pinned", "verified"])


def _held(words: list[str]) -> str:
    return "(" + " + ".join(f"cast(contains(text,'{w}') AS int)" for w in words) + ")"


def _actual(words: list[str]) -> str:
    unsure = "(" + " OR ".join(f"contains(text,'{w}')" for w in rk.UNSURE) + ")"
    rule = {"着いた": "NOT contains(text,'着いたら')", "着く": "NOT contains(text,'着いたら') AND NOT contains(text,'着くなら')"} | dict.fromkeys(("いる", "来た", "待って", "待ってる", "向かってる"), f"NOT {unsure}")
    return "(" + " + ".join(f"cast(contains(text,'{w}') AND {rule.get(w, 'true')} AS int)" for w in dict.fromkeys(words)) + ")"


def _ranked_sql(intent: str) -> str:
    words = rk.ACTUAL.get(intent) or [w for k in ("place_visit", "food_activity", "call_activity") for w in rk.ACTUAL[k]]
    titles = " OR ".join(f"contains(title,'{x}')" for x in rk.TITLES[intent])
    call = intent == "call_activity"
    score = """0.12::double + least(event_count,3)*0.10::double + least(max_confidence,0.95::double)*0.20::double + least(actual,4)*0.15::double - least(plans,4)*0.12::double - least(missed,3)*0.20::double + least(photos,5)*0.035::double + least(gps,5)*0.045::double + least(media_count,3)*0.05::double + least(ocr_count,5)*0.08::double + least(vlm_count,5)*0.10::double
 + CASE WHEN seen>=3 THEN 0.12::double WHEN seen>=2 THEN 0.06::double ELSE 0 END - CASE WHEN line_count=1 AND event_count=0 AND photos=0 THEN 0.10::double ELSE 0 END + CASE WHEN actual_title THEN 0.16::double ELSE 0 END"""
    if call:
        score += """ + CASE WHEN completed>0 THEN least(completed,4)*0.18::double + least(max_call_sec/3600::double,1.0::double)*0.16::double ELSE 0 END - CASE WHEN incomplete>0 AND completed=0 THEN least(incomplete,3)*0.16::double ELSE 0 END
 + CASE WHEN actual>0 AND missed=0 THEN 0.20::double WHEN missed>0 AND actual=0 AND completed=0 THEN -0.18::double ELSE 0 END"""
    visual = "WHEN (gps>0 OR photos>=2 OR ocr_count>0 OR vlm_count>0) AND plans=0 THEN 'actual_or_likely_action'" if intent in ("place_visit", "food_activity") else ""
    first = "WHEN completed>0 THEN 'actual_or_likely_action' WHEN (incomplete>0 OR missed>0) AND NOT (actual>0 OR actual_title) THEN 'mention_only'" if call else ""
    klass = f"CASE {first} WHEN (actual>0 OR actual_title) AND plans > actual + cast(actual_title AS int) THEN 'plan_or_candidate' WHEN actual>0 OR actual_title THEN 'actual_or_likely_action' {visual} WHEN plans>0 THEN 'plan_or_candidate' WHEN line_count>0 THEN 'mention_only' ELSE 'unknown' END"
    return f"""WITH h AS ({_DAYS}), x AS (SELECT substr(sent_at,1,10) AS date, string_agg(text, chr(10) ORDER BY sent_at, id) AS text FROM messages WHERE text <> '' GROUP BY 1), p AS (SELECT {_DATE} AS date, count(*) AS photos, count(gps_lat) AS gps FROM media GROUP BY 1),
c AS (SELECT substr(sent_at,1,10) AS date, count(*) FILTER (WHERE call_status='completed') AS completed, count(*) FILTER (WHERE call_status IN ('missed','unanswered','canceled')) AS incomplete, max(duration_sec) AS max_call_sec FROM ({_CALLS}) GROUP BY 1),
e AS (SELECT date, bool_or({titles}) AS actual_title, bool_or(is_pinned=1) AS pinned, bool_or(is_verified=1) AS verified FROM ({_OVERLAID}) WHERE is_hidden=0 GROUP BY 1),
d AS (SELECT h.*, coalesce(text,'') AS text, coalesce(photos,0) AS photos, coalesce(gps,0) AS gps, coalesce(completed,0) AS completed, coalesce(incomplete,0) AS incomplete, coalesce(max_call_sec,0) AS max_call_sec, coalesce(actual_title,false) AS actual_title, coalesce(pinned,false) AS pinned, coalesce(verified,false) AS verified FROM h LEFT JOIN x USING (date) LEFT JOIN p USING (date) LEFT JOIN c USING (date) LEFT JOIN e USING (date)),
k AS (SELECT *, {_actual(words)} AS actual, {_held(rk.PLANS)} AS plans, {_held(rk.MISSED)} AS missed, cast(event_count>0 AS int)+cast(line_count>0 AS int)+cast(photos>0 OR media_count>0 OR ocr_count>0 OR vlm_count>0 AS int) AS seen FROM d),
s AS (SELECT *, {klass} AS class, {score} AS raw FROM k), r AS (SELECT *, round(greatest(0::double, least(raw + CASE class WHEN 'actual_or_likely_action' THEN 0.10::double WHEN 'plan_or_candidate' THEN -0.05::double WHEN 'mention_only' THEN -0.15::double ELSE 0 END, 0.98::double)),3) AS base FROM s),
f AS (SELECT date, class, round(least(base + CASE WHEN pinned THEN 0.12::double ELSE 0 END + CASE WHEN verified THEN 0.04::double ELSE 0 END, 0.95::double),3) AS score FROM r)
SELECT date, class, score, CASE WHEN round(score,2)>=0.75 THEN '高' WHEN round(score,2)>=0.45 THEN '中' ELSE '低' END AS label FROM f"""


def _ranked(t, intent):
    return rk.ranked(rk.classified(_full_days(t, intent), intent)).select("date", "class", "score", "label")


@query(_ranked_sql("food_activity"))
def ranked_food_days(t):
    return _ranked(t, "food_activity")


@query(_ranked_sql("call_activity"))
def ranked_call_days(t):
    return _ranked(t, "call_activity")


@query(_ranked_sql("generic"))
def ranked_days(t):
    return _ranked(t, "generic")


_TERMS = ["ramen", "meal", "src5", "ent", "食事", "新宿"]
_VLM_F, _OCR_F = ["caption", "short_caption", "scene_tags_json", "activity_tags_json", "food_cues_json", "location_cues_json"], ["ocr_text"]


def _images(t):
    """Images with all that supports them; the score of a vector is a fixed function of its id here."""
    effective = search.effective_vlm(t("vlm"), t("vlm_overrides"))
    rows = people.enriched_media(t("media"), t("ocr"), effective)
    overlaid = search.overlaid_events(t("life_events"), t("overrides"))
    first = people.first_event(t("evidence"), overlaid).withColumnRenamed("evidence_id", "id")
    about = overlaid.select(F.col("id").alias("event_id"), F.col("title").alias("event_title"), F.col("summary").alias("event_summary"), F.col("location_name").alias("event_location"), F.coalesce("confidence", F.lit(0.0)).alias("event_confidence"), F.col("is_verified").alias("event_verified"), F.col("is_pinned").alias("event_pinned"))
    lines = t("messages").where(F.contains("text", F.lit("ランチ"))).groupBy(F.substring("sent_at", 1, 10).alias("date")).agg(F.count("*").alias("line_hits"))
    rows = rows.join(first.join(about, "event_id"), "id", "left").join(lines, "date", "left").fillna(0, ["line_hits"])
    return rows.withColumns({"embedding": F.length("file_name") / 20, "sql": F.lit(0.0), "place": F.lit(None).cast("string")})


_IMAGES = f"""SELECT m.id, m.file_name, m.gps_lat, m.gps_lon, o.ocr_text, {', '.join('v.' + c for c in [*_VLM_F, 'safety_flags_json', 'is_verified', 'is_wrong', 'review_status', 'people_count', 'confidence'])}, v.media_id IS NOT NULL AS has_vlm, coalesce(l.n,0) AS line_hits, length(m.file_name)/20.0::double AS embedding,
 e.title AS event_title, e.summary AS event_summary, e.location_name AS event_location, CASE WHEN e.id IS NOT NULL THEN coalesce(e.confidence,0) END AS event_confidence, e.is_verified AS event_verified, e.is_pinned AS event_pinned
 FROM media m LEFT JOIN ocr o ON o.media_id = m.id LEFT JOIN ({_EFFECTIVE}) v ON v.media_id = m.id LEFT JOIN (SELECT substr(sent_at,1,10) AS date, count(*) AS n FROM messages WHERE contains(text,'ランチ') GROUP BY 1) l ON l.date = {_DATE}
 LEFT JOIN (SELECT evidence_id, arg_min(event_id, (-is_pinned, date, start_time, event_id)) AS event_id FROM (SELECT DISTINCT e.event_id, e.evidence_id, x.is_pinned, x.date, x.start_time FROM evidence e JOIN ({_OVERLAID}) x ON x.id = e.event_id WHERE x.is_hidden = 0) GROUP BY 1) f ON f.evidence_id = m.id LEFT JOIN ({_OVERLAID}) e ON e.id = f.event_id"""


def _field(fields: list[str], terms: list[str]) -> str:
    has = lambda f, t: f"contains(lower(coalesce({f},'')),'{t.lower()}')"
    n = " + ".join(f"cast({' OR '.join(has(f, t) for t in terms)} AS int)" for f in fields)
    k = " + ".join(f"cast({' OR '.join(has(f, t) for f in fields)} AS int)" for t in terms)
    return f"(CASE WHEN {n} > 0 THEN least(1.0::double, ({n})*0.22::double + ({k})*0.08::double) ELSE 0::double END)"


_REFUSED, _UNSAFE = "('rejected','wrong')", "(" + " OR ".join(f"coalesce(contains(safety_flags_json,'{x}'),false)" for x in rk.UNSAFE) + ")"


def _hybrid_sql(specific: list[str] | None, generic: list[str]) -> str:
    s, g = (_field([*_VLM_F, *_OCR_F], x) if specific else "0::double" for x in (specific or [], generic))
    cap = "least(vlm0, CASE WHEN generic>0 THEN 0.2::double ELSE 0::double END)"
    vlm = f"CASE WHEN specific>0 THEN vlm0 ELSE {cap} END" if specific else "vlm0"
    seen = f"specific>0 OR {' OR '.join(f"contains(lower(file_name),'{x}')" for x in specific)}" if specific else "vlm0>0 OR ocr_score>0 OR embedding_score>=0.35"
    return f"""WITH i AS ({_IMAGES}), a AS (SELECT *, {_field(_VLM_F, _TERMS)} AS vlm0, {_field(_OCR_F, _TERMS)} AS ocr_score, greatest(0::double, least(embedding,1.0::double)) AS embedding_score, {s} AS specific, {g} AS generic,
 CASE WHEN event_confidence IS NULL THEN 0::double ELSE least(1.0::double, 0.35::double + greatest(0::double, least(event_confidence,1.0::double))*0.35::double + CASE WHEN {_field(['event_title', 'event_summary'], _TERMS)}>0 THEN 0.2::double ELSE 0 END) END AS event0, least(1.0::double, line_hits*0.35::double) AS line0,
 greatest(CASE WHEN gps_lat IS NOT NULL AND gps_lon IS NOT NULL THEN 0.3::double ELSE 0 END, CASE WHEN event_location<>'' THEN 0.4::double ELSE 0 END, CASE WHEN {_field(['event_location'], _TERMS)}>0 THEN 1.0::double ELSE 0 END) AS place_score FROM i),
b AS (SELECT *, {vlm} AS vlm_score, ({seen}) AS visual_match FROM a), c AS (SELECT *, CASE WHEN visual_match THEN line0 ELSE least(line0,0.2::double) END AS line_score, CASE WHEN visual_match THEN event0 ELSE least(event0,0.2::double) END AS event_score,
 CASE WHEN coalesce(is_verified,0)=1 OR coalesce(review_status,'')='accepted' THEN 0.08::double ELSE 0 END + CASE WHEN coalesce(event_verified,0)=1 THEN 0.1::double ELSE 0 END + CASE WHEN coalesce(event_pinned,0)=1 THEN 0.12::double ELSE 0 END AS boost, CASE WHEN {_UNSAFE} THEN -0.1::double ELSE 0 END + CASE WHEN coalesce(is_wrong,0)=1 OR coalesce(review_status,'') IN {_REFUSED} THEN -0.5::double ELSE 0 END AS penalty FROM b),
d AS (SELECT *, embedding_score*0.30::double + vlm_score*0.20::double + ocr_score*0.15::double + line_score*0.15::double + event_score*0.15::double + place_score*0.05::double + boost + penalty + least(0.18::double, specific*0.18::double) AS raw, ocr_score>0 OR line_score>0 OR event_score>0 OR place_score>0 AS context FROM c),
e AS (SELECT *, CASE WHEN NOT context AND (embedding_score>0) <> (vlm_score>0) THEN least(raw,0.44::double) ELSE raw END AS capped FROM d)
SELECT id, round(vlm_score,3) AS vlm_score, round(ocr_score,3) AS ocr_score, visual_match, round(greatest(0::double, least(CASE WHEN visual_match THEN capped ELSE capped*0.5::double END, 0.95::double)),9) AS final_score FROM e"""


def _hybrid(t, specific=(), generic=()):
    rows = rk.hybrid(_images(t), _TERMS, _VLM_F, _OCR_F, ["place"], specific, generic)
    return rows.select("id", F.round("vlm_score", 3).alias("vlm_score"), F.round("ocr_score", 3).alias("ocr_score"), "visual_match", F.round("final_score", 9).alias("final_score"))


@query(_hybrid_sql(None, []))
def hybrid_scores(t):
    return _hybrid(t)


@query(_hybrid_sql(["ramen_possible"], ["meal"]))
def hybrid_scores_of_a_dish(t):
    return _hybrid(t, ["ramen_possible"], ["meal"])


@query(f"""WITH i AS ({_IMAGES}), p AS (SELECT media_id, max(CASE WHEN source='face_cluster' THEN 1.0::double ELSE 0.8::double END) AS person FROM media_people WHERE is_verified=1 GROUP BY 1), a AS (SELECT i.*, coalesce(p.person,0) AS person, {' + '.join(f"cast(contains(lower(coalesce({f},'')),'ramen') AS int)" for f in _VLM_F)} AS fields FROM i LEFT JOIN p ON p.media_id = i.id),
b AS (SELECT *, 0.2::double + fields*0.15::double + coalesce(least(confidence,1.0::double),0)*0.25::double + CASE WHEN gps_lat IS NOT NULL AND gps_lon IS NOT NULL THEN 0.1::double ELSE 0 END + CASE WHEN event_confidence IS NOT NULL THEN 0.1::double ELSE 0 END AS s FROM a), c AS (SELECT *, CASE WHEN person>0 THEN s + least(0.35::double, person*0.35::double) ELSE least(s*0.35::double, 0.24::double) END AS q FROM b)
SELECT id, round(greatest(0::double, least(q + CASE WHEN coalesce(is_verified,0)=1 OR coalesce(review_status,'')='accepted' THEN 0.08::double ELSE 0 END - CASE WHEN coalesce(is_wrong,0)=1 OR coalesce(review_status,'') IN {_REFUSED} THEN 0.5::double ELSE 0 END, 0.95::double)),3) AS score,
 CASE WHEN coalesce(is_verified,0)=1 OR coalesce(review_status,'')='accepted' THEN 'medium' WHEN person>0 AND has_vlm AND event_confidence IS NOT NULL THEN 'strong' WHEN person>0 THEN 'medium' WHEN has_vlm AND (event_confidence IS NOT NULL OR ocr_text IS NOT NULL) THEN 'medium' ELSE 'weak' END AS strength FROM c""")
def image_search(t):
    face = t("media_people").where("is_verified = 1").groupBy(F.col("media_id").alias("id")).agg(F.max(F.when(F.col("source") == "face_cluster", 1.0).otherwise(0.8)).alias("person"))
    rows = _images(t).join(face, "id", "left").fillna(0.0, ["person"])
    hit = sum((F.contains(F.lower(F.coalesce(F.col(f), F.lit(""))), F.lit("ramen")).cast("int") for f in _VLM_F), F.lit(0))
    c = F.col
    good, bad = F.coalesce((c("is_verified") == 1) | (c("review_status") == "accepted"), F.lit(False)), F.coalesce((c("is_wrong") == 1) | c("review_status").isin("rejected", "wrong"), F.lit(False))
    event, vlm = c("event_confidence").isNotNull(), c("caption").isNotNull()
    score = rk.image_score(hit, c("confidence"), c("gps_lat").isNotNull() & c("gps_lon").isNotNull(), event, good, bad, c("person"), asked=True)
    return rows.select("id", score.alias("score"), rk.image_strength(vlm, c("ocr_text").isNotNull(), event, c("person") > 0, good).alias("strength"))


@query("WITH k AS (SELECT event_id, bool_or(evidence_type='vlm') AS vlm, bool_or(evidence_type IN ('ocr','line')) AS context, max(weight)*10 AS w FROM evidence GROUP BY 1) SELECT event_id, CASE WHEN w>=0.75 THEN CASE WHEN vlm AND NOT context THEN '中' ELSE '高' END WHEN w>=0.45 THEN '中' ELSE '低' END AS label FROM k")
def capped_labels(t):
    rows = t("evidence").groupBy("event_id").agg(F.collect_set("evidence_type").alias("kinds"), (F.max("weight") * 10).alias("w"))
    return rows.select("event_id", rk.capped_label(F.col("w"), F.col("kinds"), F.array().cast("array<string>")).alias("label"))


@query(f"""WITH i AS ({_IMAGES}) SELECT id, CASE WHEN n>=3 AND confidence>=0.7 THEN 'strong' WHEN n>=1 AND confidence>=0.65 THEN 'medium' ELSE 'weak' END AS strength FROM (SELECT id, coalesce(confidence,0) AS confidence, cast(ocr_text IS NOT NULL AS int)+cast(line_hits>0 AS int)+cast(gps_lat IS NOT NULL AS int)+cast(event_confidence IS NOT NULL AS int) AS n FROM i)""")
def vlm_strengths(t):
    c = F.col
    supports = [c("ocr_text").isNotNull(), c("line_hits") > 0, c("gps_lat").isNotNull(), c("event_confidence").isNotNull()]
    return _images(t).select("id", rk.vlm_strength(supports, F.coalesce("confidence", F.lit(0.0))).alias("strength"))


def _times(w: str) -> str:
    return f"(length(x)-length(replace(x,'{w}','')))/{len(w)}"


@query(f"""WITH l AS (SELECT substr(sent_at,1,10) AS date, count(*) AS n_line, count(DISTINCT nullif(sender,'')) AS senders, string_agg(coalesce(text,''), ' ' ORDER BY sent_at, id) AS x FROM messages GROUP BY 1), p AS (SELECT {_DATE} AS date, count(*) AS photos, count(gps_lat) AS gps FROM media GROUP BY 1), e AS (SELECT date, count(*) AS events, count(nullif(location_name,'')) AS named FROM life_events GROUP BY 1),
d AS (SELECT coalesce(l.date,p.date,e.date) AS date, coalesce(n_line,0) AS n_line, coalesce(senders,0) AS senders, coalesce(x,'') AS x, coalesce(photos,0) AS photos, coalesce(gps,0) AS gps, coalesce(events,0) AS events, coalesce(named,0) AS named FROM l FULL JOIN p ON l.date=p.date FULL JOIN e ON e.date=coalesce(l.date,p.date))
SELECT date, CASE WHEN events>0 OR n_line+photos>=3 THEN 'high' WHEN n_line+photos>0 THEN 'medium' ELSE 'unknown' END AS by_date, CASE WHEN n_line=0 THEN 'unknown' WHEN senders>0 AND n_line>=2 THEN 'high' WHEN senders>0 THEN 'medium' ELSE 'low' END AS by_contact, CASE WHEN named>0 AND gps>0 THEN 'high' WHEN named>0 OR gps>0 THEN 'medium' WHEN photos>0 THEN 'low' ELSE 'unknown' END AS by_place,
 cast({' + '.join(f"cast(({' + '.join(map(_times, ws))})>0 AS int)" for ws in rk.ACTIVITY.values())} AS integer) AS categories, cast(round({' + '.join(_times(w) for ws in rk.ACTIVITY.values() for w in ws)}) AS bigint) AS occurrences FROM d""")
def answer_confidence(t):
    day = F.substring(F.coalesce("captured_at", "fallback_captured_at"), 1, 10)
    lines = t("messages").groupBy(F.substring("sent_at", 1, 10).alias("date")).agg(F.count("*").alias("n_line"), F.count_distinct(search.truthy("sender")).alias("senders"), F.array_join(F.array_sort(F.collect_list(F.struct("sent_at", "id", F.coalesce("text", F.lit("")).alias("text")))).getField("text"), " ").alias("x"))
    photos = t("media").groupBy(day.alias("date")).agg(F.count("*").alias("photos"), F.count("gps_lat").alias("gps"))
    events = t("life_events").groupBy("date").agg(F.count("*").alias("events"), F.count(search.truthy("location_name")).alias("named"))
    rows = lines.join(photos, "date", "full").join(events, "date", "full").fillna(0).fillna("", ["x"])
    c = F.col
    categories, occurrences = rk.activity_counts(c("x"))
    return rows.select("date", rk.date_confidence(c("n_line"), c("photos"), c("events")).alias("by_date"), rk.contact_confidence(c("n_line"), c("senders")).alias("by_contact"), rk.place_confidence(c("named"), c("gps"), c("photos")).alias("by_place"), categories.alias("categories"), occurrences.alias("occurrences"))


_BLOB = "lower(concat_ws(' ', caption, short_caption, scene_tags_json, food_cues_json, location_cues_json))"


@query(f"SELECT media_id, cast(CASE WHEN location_cues_json IS NOT NULL THEN 5 ELSE 0 END + CASE WHEN people_count=0 THEN 4 ELSE 0 END + {' + '.join(f"cast(contains({_BLOB},'{w}') AS int)" for w in rk.TEXT_WORDS)} AS integer) AS score FROM vlm ORDER BY 2 DESC, 1 LIMIT 50")
def ocr_priority(t):
    blob = F.concat_ws(" ", "caption", "short_caption", "scene_tags_json", "food_cues_json", "location_cues_json")
    score = rk.ocr_priority(blob, F.col("location_cues_json").isNotNull(), F.col("people_count") == 0)
    return t("vlm").select("media_id", score.alias("score")).orderBy(F.desc("score"), "media_id").limit(50)


@query(f"SELECT id, date FROM (SELECT id, {_DATE} AS date, row_number() OVER (PARTITION BY {_DATE} ORDER BY coalesce(captured_at,fallback_captured_at), id)-1 AS i, count(*) OVER (PARTITION BY {_DATE}) AS n FROM media) WHERE n<=5 OR list_contains(list_transform(range(0,5), lambda s: cast(round_even(s*(n-1)/4.0::double,0) AS int)), cast(i AS int))")
def pilot_sample(t):
    day = F.substring(F.coalesce("captured_at", "fallback_captured_at"), 1, 10)
    return rk.evenly_spaced(t("media").withColumn("date", day), ["date"], [F.coalesce("captured_at", "fallback_captured_at"), "id"], 5).select("id", "date")


@query("SELECT e.id AS event_id, 1 AS is_hidden FROM life_events e JOIN (SELECT event_id, count(*) FILTER (WHERE evidence_type='photo') AS photo, count(*) FILTER (WHERE evidence_type='line') AS line FROM evidence GROUP BY 1) k ON k.event_id=e.id WHERE e.confidence<=0.5 AND k.line>0 AND k.photo=0")
def low_confidence_hides(t):
    kinds = t("evidence").groupBy(F.col("event_id").alias("id")).agg(F.count_if(F.col("evidence_type") == "photo").alias("photo"), F.count_if(F.col("evidence_type") == "line").alias("line"))
    return rk.to_hide(t("life_events"), kinds)


@query(f"SELECT * FROM (SELECT id, {_DATE} AS date, cast(row_number() OVER (PARTITION BY {_DATE} ORDER BY coalesce(captured_at,fallback_captured_at), id) AS integer) AS place FROM media)")
def thumbnails(t):
    from pyspark.sql import Window

    when = F.coalesce("captured_at", "fallback_captured_at")
    w = Window.partitionBy(F.substring(when, 1, 10)).orderBy(when, "id")
    return t("media").select("id", F.substring(when, 1, 10).alias("date"), F.row_number().over(w).alias("place"))
