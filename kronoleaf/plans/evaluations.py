"""Summaries of months, snapshots of searches, evaluations and reports, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..checkpoints import written
from ..functions import safety, text as T
from ..functions.text import any_term
from ..operators import clusters as cl, ranking as rk, search, statistics as st, upkeep as up, vectors
from ..operators.events import rebuild_report
from . import statistics as ss
from .catalog import query
from .links import _CALLS, _DATE, _calls
from .searches import _EFFECTIVE, _OVERLAID, _like

_FROM, _TO = "2024-01-05", "2024-01-24"
_E, _M, _L = (f"(SELECT * FROM {x} WHERE {d} BETWEEN '{_FROM}' AND '{_TO}')" for x, d in ((f"({_OVERLAID})", "date"), ("media", _DATE), ("messages", "substr(sent_at,1,10)")))
_C = f"(SELECT * FROM ({_CALLS}) WHERE substr(sent_at,1,10) BETWEEN '{_FROM}' AND '{_TO}')"
_V = f"(SELECT v.* FROM {ss._SUMMARY_VLM} v WHERE v.media_id IN (SELECT id FROM {_M}))"
_HIGH = "CASE WHEN confidence>=0.75 THEN '高' WHEN confidence>=0.45 THEN '中' ELSE '低' END"
_SHOWN = f"(SELECT * FROM {_E} WHERE is_hidden=0)"


@query(ss._sections({
    "totals": " UNION ALL ".join([ss._one(_SHOWN, events="count(*)"), ss._one(_M, photos="count(*)", gps_photos="count(*) FILTER (WHERE gps_lat IS NOT NULL AND gps_lon IS NOT NULL)"), ss._one(_V, vlm_photos="count(*)"), ss._one(f"(SELECT * FROM ocr WHERE status='success' AND media_id IN (SELECT id FROM {_M}))", ocr_photos="count(*)"), ss._one(_L, messages="count(*)"), ss._one(_C, calls="count(*)")]),
    "title": ss._most(ss._count(_SHOWN, "title"), 10), "call": ss._count(_C, "call_status"), "confidence": ss._count(_SHOWN, _HIGH, "confidence IS NOT NULL"), "evidence": ss._count(f"(SELECT * FROM evidence WHERE event_id IN (SELECT id FROM {_SHOWN}))", "evidence_type"),
}))
def monthly_summary(t):
    """The sections of a summary of a range of dates; hidden events are left out."""
    day = F.substring(F.coalesce("captured_at", "fallback_captured_at"), 1, 10)
    within = lambda df, d: df.where(d.between(_FROM, _TO))
    events = written(within(search.overlaid_events(t("life_events"), t("overrides")), F.col("date")).where("is_hidden = 0"))
    media = within(t("media"), day).withColumn("media_id", F.col("id"))
    said, calls = within(t("messages"), F.substring("sent_at", 1, 10)), within(_calls(t), F.substring("sent_at", 1, 10))
    of = lambda df: df.join(media.select("media_id"), "media_id", "left_semi")
    n = lambda df, name: st.measures(df, **{name: F.count("*")})
    vlm = of(st.summary_usable(search.effective_vlm(t("vlm"), t("vlm_overrides"))))
    totals = n(events, "events").union(st.measures(media, photos=F.count("*"), gps_photos=F.count_if(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull()))).union(n(vlm, "vlm_photos")).union(n(of(t("ocr").where("status = 'success'")), "ocr_photos")).union(n(said, "messages")).union(n(calls, "calls"))
    return st.sections({
        "totals": totals, "title": st.most(st.counted(events, "title"), 10), "call": st.counted(calls, "call_status"), "confidence": st.counted(events.where("confidence is not null"), rk.level(F.col("confidence"))),
        "evidence": st.counted(t("evidence").join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi"), "evidence_type"),
    })


_QUERIES = ["ランチ", "カフェ", "新宿", "仕事"]


@query(f"""WITH q AS (SELECT unnest({_QUERIES}) AS query), h AS (SELECT q.query, 'event' AS kind, date AS d FROM q JOIN ({_OVERLAID}) e ON contains(lower(concat_ws(' ', e.title, e.summary, e.location_name)), q.query) WHERE e.is_hidden=0 UNION ALL SELECT q.query, 'line', substr(sent_at,1,10) FROM q JOIN messages m ON contains(m.text, q.query)),
c AS (SELECT query, d, count(*) FILTER (WHERE kind='event')*3 + count(*) FILTER (WHERE kind='line')*2 AS score, count(*) AS n FROM h GROUP BY 1,2) SELECT query, d AS date, cast(score AS bigint) AS score, n, cast(rank AS integer) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, d) AS rank FROM c) WHERE rank<=5""")
def search_snapshot(t):
    """The best days of a fixed list of queries, all in one pass of the texts: each text is met by every query that it holds."""
    e = search.overlaid_events(t("life_events"), t("overrides")).where("is_hidden = 0").select(F.lit("event").alias("kind"), "date", F.lower(F.concat_ws(" ", "title", "summary", "location_name")).alias("text"))
    texts = e.union(t("messages").where("text is not null").select(F.lit("line"), F.substring("sent_at", 1, 10), "text"))
    held = F.filter(F.array(*map(F.lit, _QUERIES)), lambda q: F.contains("text", q))
    hits = texts.select("kind", "date", F.explode(held).alias("query"))
    days = hits.groupBy("query", "date").agg((F.count_if(F.col("kind") == "event") * 3 + F.count_if(F.col("kind") == "line") * 2).alias("score"), F.count("*").alias("n"))
    w = Window.partitionBy("query").orderBy(F.desc("score"), "date")
    return days.withColumn("rank", F.row_number().over(w)).where("rank <= 5").select("query", "date", "score", "n", "rank")


@query(f"""WITH c AS (SELECT date, count(*) AS events, bool_or(contains(title,'食事')) AS food, max(confidence) AS confidence, count(DISTINCT v.evidence_type) AS kinds FROM ({_OVERLAID}) e LEFT JOIN evidence v ON v.event_id=e.id WHERE is_hidden=0 GROUP BY 1)
SELECT date, events>=20 AND food AND kinds>=3 AND confidence<=1 AS passed, concat_ws(',', CASE WHEN events<20 THEN 'min_events' END, CASE WHEN NOT food THEN 'keyword' END, CASE WHEN kinds<3 THEN 'evidence' END, CASE WHEN confidence>1 THEN 'confidence' END) AS failures FROM c""")
def date_answers_checked(t):
    """Answers about dates against what is expected of them: enough events, a keyword, kinds of evidence, a ceiling of confidence."""
    e = search.overlaid_events(t("life_events"), t("overrides")).where("is_hidden = 0").join(t("evidence").select("event_id", "evidence_type"), F.col("id") == F.col("event_id"), "left")
    got = e.groupBy("date").agg(F.count("*").alias("events"), F.bool_or(F.contains("title", F.lit("食事"))).alias("food"), F.max("confidence").alias("confidence"), F.count_distinct("evidence_type").alias("kinds"))
    rules = {"min_events": F.col("events") < 20, "keyword": ~F.col("food"), "evidence": F.col("kinds") < 3, "confidence": F.col("confidence") > 1}
    failures = F.concat_ws(",", *[F.when(bad, F.lit(name)) for name, bad in rules.items()])
    return got.select("date", (failures == "").alias("passed"), failures.alias("failures"))


@query(f"SELECT count(*) AS calls, bool_and(call_status IN ('completed','missed','unanswered','canceled')) AS statuses_known, count(*) FILTER (WHERE call_status='completed')>=10 AS enough, bool_or(sender='user_3') AS sender_found FROM {ss._C}")
def call_answers_checked(t):
    c = _calls(t)
    return c.agg(F.count("*").alias("calls"), F.bool_and(F.col("call_status").isin("completed", "missed", "unanswered", "canceled")).alias("statuses_known"), (F.count_if(F.col("call_status") == "completed") >= 10).alias("enough"), F.bool_or(F.col("sender") == "user_3").alias("sender_found"))


@query("SELECT count(*) FILTER (WHERE p.is_hidden=1 OR p.is_deleted=1) AS hidden_linked, count(*) FILTER (WHERE p.privacy_level='private' AND l.is_verified=0) AS private_unverified, count(*) AS links FROM speaker_links l JOIN persons p ON p.id=l.person_id")
def speaker_privacy_checked(t):
    p = t("persons").select(F.col("id").alias("person_id"), "is_hidden", "is_deleted", "privacy_level")
    rows = t("speaker_links").join(p, "person_id")
    return rows.agg(F.count_if((F.col("is_hidden") == 1) | (F.col("is_deleted") == 1)).alias("hidden_linked"), F.count_if((F.col("privacy_level") == "private") & (F.col("is_verified") == 0)).alias("private_unverified"), F.count("*").alias("links"))


@query("SELECT source AS type, min(n) AS at_least, max(n) AS at_most, min(date) AS date_from, max(date) AS date_to FROM (SELECT source, date, count(*) AS n FROM life_events GROUP BY 1,2) GROUP BY 1")
def evaluation_template(t):
    """Bounds of new cases from the data as they are."""
    days = t("life_events").groupBy("source", "date").agg(F.count("*").alias("n"))
    return days.groupBy(F.col("source").alias("type")).agg(F.min("n").alias("at_least"), F.max("n").alias("at_most"), F.min("date").alias("date_from"), F.max("date").alias("date_to"))


@query(f"SELECT 'events' AS part, count(*) AS n, count(*) FILTER (WHERE is_hidden=1) AS held_back FROM ({_OVERLAID}) UNION ALL SELECT 'vlm', count(*), count(*) FILTER (WHERE lower(status)<>'success' OR contains(lower(vlm_engine),'fake')) FROM ({_EFFECTIVE}) UNION ALL SELECT 'persons', count(*), count(*) FILTER (WHERE is_hidden=1 OR is_deleted=1) FROM persons UNION ALL SELECT 'orphans', count(*), count(*) FILTER (WHERE event_id NOT IN (SELECT id FROM life_events)) FROM evidence")
def release_manifest(t):
    """What a release would hold and hold back."""
    part = lambda df, name, bad: df.agg(F.count("*").alias("n"), F.count_if(bad).alias("held_back")).select(F.lit(name).alias("part"), "n", "held_back")
    known = t("life_events").select(F.col("id").alias("event_id"), F.lit(True).alias("known"))
    return (
        part(search.overlaid_events(t("life_events"), t("overrides")), "events", F.col("is_hidden") == 1).union(part(search.effective_vlm(t("vlm"), t("vlm_overrides")), "vlm", search.untrusted()))
        .union(part(t("persons"), "persons", (F.col("is_hidden") == 1) | (F.col("is_deleted") == 1))).union(part(t("evidence").join(known, "event_id", "left"), "orphans", F.col("known").isNull()))
    )


@query("SELECT vlm_engine, count(*) AS cases, count(*) FILTER (WHERE status='success') AS ok, count(*) FILTER (WHERE contains(food_cues_json,'ramen_possible')) AS tagged, count(*) FILTER (WHERE safety_flags_json IS NOT NULL) AS flagged, CASE WHEN count(*) FILTER (WHERE status='success')*100 >= 95*count(*) THEN 'go' WHEN count(*) FILTER (WHERE status='success')*100 >= 80*count(*) THEN 'retry' ELSE 'stop' END AS recommendation FROM vlm GROUP BY 1")
def pilot_summary(t):
    """Cases of each engine: successes, expected tags, flags and what to do next."""
    ok, n = F.count_if(F.col("status") == "success"), F.count("*")
    advice = F.when(ok * 100 >= n * 95, "go").when(ok * 100 >= n * 80, "retry").otherwise("stop")
    return t("vlm").groupBy("vlm_engine").agg(n.alias("cases"), ok.alias("ok"), F.count_if(F.contains("food_cues_json", F.lit("ramen_possible"))).alias("tagged"), F.count("safety_flags_json").alias("flagged"), advice.alias("recommendation"))


@query(f"SELECT doc_id, concat_ws(',', {', '.join(f"CASE WHEN {' OR '.join(f"contains(lower(text),'{w.lower()}')" for w in words)} THEN '{name}' END" for name, words in safety.FLAGS)}) AS flags FROM documents")
def safety_flags(t):
    own = F.filter(safety.flags(F.col("text")), lambda f: ~f.isin("sensitive_terms_removed", "forbidden_terms_removed"))
    return t("documents").select("doc_id", F.array_join(own, ",").alias("flags"))


@query()
def cleaned_captions(t):
    """Captions without what they must not say; words are removed whatever their case, which the two engines fold apart."""
    return t("vlm").select("media_id", safety.cleaned(F.concat(F.col("caption"), F.lit(" of a happy family.")), 60).alias("caption"))


@query("SELECT doc_id, CASE WHEN length(f)>120 THEN substr(f,1,120)||'...' ELSE f END AS preview FROM (SELECT doc_id, trim(regexp_replace(text,'\\s+',' ','g')) AS f FROM documents)")
def text_previews(t):
    return t("documents").select("doc_id", T.shorten(F.col("text"), 120).alias("preview"))


@query("SELECT label AS cluster, cast(i-1 AS integer) AS position, round(avg(x),9) AS value FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding,1) AS i FROM embeddings) GROUP BY 1,2")
def label_centroids(t):
    return vectors.centroids(t("embeddings").withColumnRenamed("label", "cluster"), "cluster", "embedding").withColumn("value", F.round("value", 9))


@query("SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]),9) AS dot FROM embeddings a JOIN embeddings b ON b.vec_id=a.vec_id+1")
def neighbour_dots(t):
    v = t("embeddings")
    nxt = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(nxt, "vec_id").select("vec_id", F.round(vectors.dot("embedding", "other"), 9).alias("dot"))


_HYBRID_TOP = 20


@query(f"""WITH b AS (SELECT media_id, max(greatest(0::double, least(1::double, cast(embedding[1] AS double)*4))) AS emb FROM media_vectors WHERE status='success' AND NOT contains(embedding_model,'fake') GROUP BY 1), s AS (SELECT media_id, 1 AS hit FROM ({_EFFECTIVE}) WHERE {_like(['caption'], ['src5', 'src7'])}),
u AS (SELECT coalesce(b.media_id,s.media_id) AS media_id, coalesce(emb,0) AS emb, coalesce(hit,0) AS hit FROM b FULL JOIN s ON b.media_id=s.media_id) SELECT media_id, round(emb*0.6::double + hit*0.4::double,6) AS score FROM u WHERE media_id IN (SELECT id FROM media) ORDER BY 2 DESC, 1 LIMIT {_HYBRID_TOP}""")
def merged_candidates(t):
    """Candidates of vectors and of texts in one outer join, scored together; the first twenty."""
    v = t("media_vectors").where("status = 'success' and not contains(embedding_model, 'fake')").select("media_id", "embedding_type", (F.get("embedding", F.lit(0)).cast("double") * 4).alias("s"))
    best = cl.best_of_each(v, "media_id", "embedding_type", "s").select("media_id", F.col("score").alias("emb"))
    hits = search.effective_vlm(t("vlm"), t("vlm_overrides")).where(any_term(["caption"], ["src5", "src7"])).select("media_id", F.lit(1).alias("hit"))
    both = best.join(hits, "media_id", "full").fillna(0, ["emb", "hit"]).join(t("media").select(F.col("id").alias("media_id")), "media_id", "left_semi")
    return both.select("media_id", F.round(F.col("emb") * 0.6 + F.col("hit") * 0.4, 6).alias("score")).orderBy(F.desc("score"), "media_id").limit(_HYBRID_TOP)


@query(f"SELECT kind, count(*) AS n FROM (SELECT CASE WHEN b.id IS NULL THEN 'added' WHEN a.id IS NULL THEN 'removed' WHEN b.title IS DISTINCT FROM a.title OR b.location_name IS DISTINCT FROM a.location_name THEN 'changed' ELSE 'same' END AS kind FROM life_events b FULL JOIN (SELECT * FROM ({_OVERLAID}) WHERE is_hidden=0) a ON a.id=b.id) GROUP BY 1")
def review_diff(t):
    """All events before and after their review."""
    after = search.overlaid_events(t("life_events"), t("overrides")).where("is_hidden = 0")
    return rebuild_report(t("life_events"), after, ["title", "location_name"]).withColumnRenamed("change", "kind")


@query("SELECT e.id, e.date FROM life_events e WHERE date BETWEEN '2024-01-10' AND '2024-01-12' AND NOT EXISTS (SELECT 1 FROM overrides o WHERE o.event_id=e.id AND o.is_hidden=1) ORDER BY date, start_time, id LIMIT 200")
def listed_events(t):
    """Events of a range as they are listed: hidden ones left out, by date, time and id."""
    rows = search.event_queue(search.overlaid_events(t("life_events"), t("overrides")).withColumns({"n_evidence": F.lit(0), "modality": F.lit("none"), "is_pinned": F.lit(0)}), date_from="2024-01-10", date_to="2024-01-12")
    return rows.select("id", "date").limit(200)


@query("SELECT id, status FROM (SELECT p.id, coalesce(v.status,'skipped') AS status FROM (SELECT id FROM media WHERE id NOT IN (SELECT media_id FROM ocr WHERE status='success')) p LEFT JOIN vlm v ON v.media_id=p.id)")
def analysis_run(t):
    """A plan of media without recognised text, and what a run's report says of each."""
    todo = st.analysis_plan(t("media"), t("ocr"), 1.0, retry_failed=True).select(F.lit("ocr").alias("job_id"), F.col("id").alias("item_id"))
    return up.synced(todo, t("vlm").select(F.col("media_id").alias("item_id"), "status")).select(F.col("item_id").alias("id"), "status")
