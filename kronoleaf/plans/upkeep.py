"""Changes of tables and checks of evaluations, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import Window, functions as F

from ..operators import people, upkeep as up
from .catalog import query

_PATCH = "SELECT event_id, CASE WHEN is_verified=1 THEN 'patched' END AS title_override, CASE WHEN is_hidden=1 THEN 'patched place' END AS location_name_override FROM overrides UNION ALL SELECT concat('x', event_id), 'new', NULL FROM overrides WHERE is_pinned=1"


@query(f"WITH p AS ({_PATCH}), e AS (SELECT event_id, title_override, location_name_override, is_pinned FROM overrides) SELECT coalesce(e.event_id,p.event_id) AS event_id, coalesce(p.title_override,e.title_override) AS title_override, coalesce(p.location_name_override,e.location_name_override) AS location_name_override, e.is_pinned FROM e FULL JOIN p ON e.event_id=p.event_id")
def override_upsert(t):
    o = t("overrides")
    patch = o.select("event_id", F.when(F.col("is_verified") == 1, "patched").alias("title_override"), F.when(F.col("is_hidden") == 1, "patched place").alias("location_name_override"), F.lit(1).alias("order"))
    more = o.where("is_pinned = 1").select(F.concat(F.lit("x"), "event_id").alias("event_id"), F.lit("new").alias("title_override"), F.lit(None).cast("string").alias("location_name_override"), F.lit(1).alias("order"))
    return up.patched(o.select("event_id", "title_override", "location_name_override", "is_pinned"), patch.union(more), "event_id")


@query("SELECT media_id, review_status FROM vlm_overrides WHERE media_id NOT IN (SELECT media_id FROM vlm WHERE status='failed')")
def override_clear(t):
    return up.cleared(t("vlm_overrides"), t("vlm").where("status = 'failed'"), "media_id").select("media_id", "review_status")


@query("SELECT e.id, coalesce(CASE WHEN e.is_user_edited=0 AND NOT EXISTS (SELECT 1 FROM overrides o WHERE o.event_id=e.id AND trim(o.location_name_override)<>'') THEN (SELECT min(p.display_name) FROM event_places l JOIN places p ON p.id=l.place_id WHERE l.event_id=e.id) END, e.location_name) AS location_name FROM life_events e")
def location_update(t):
    labels = t("event_places").join(t("places").select(F.col("id").alias("place_id"), "display_name"), "place_id").select(F.col("event_id").alias("id"), F.col("display_name").alias("label"))
    return up.relocated(t("life_events"), people.may_take_location(t("life_events"), t("overrides")), labels).select("id", "location_name")


_BAD = "(lower(status)<>'success' OR contains(lower(vlm_engine),'fake'))"


@query(f"SELECT 'vlm' AS name, count(*) AS before, count(*) FILTER (WHERE NOT {_BAD}) AS after, count(*) FILTER (WHERE {_BAD}) AS removed FROM vlm UNION ALL SELECT 'evidence', count(*), count(*) FILTER (WHERE NOT (evidence_type='vlm' AND evidence_id IN (SELECT media_id FROM vlm WHERE {_BAD}))), count(*) FILTER (WHERE evidence_type='vlm' AND evidence_id IN (SELECT media_id FROM vlm WHERE {_BAD})) FROM evidence")
def bad_result_cleanup(t):
    """The plan of a cleanup: model rows and the evidence that goes with them."""
    results, left = up.without_bad_results(t("vlm"), t("evidence"), "vlm")
    return up.plan(t("vlm"), results).select(F.lit("vlm").alias("name"), "before", "after", "removed").union(up.plan(t("evidence"), left).select(F.lit("evidence"), "before", "after", "removed"))


_LINKS = ("aliases", "speaker_links", "media_people", "event_people", "person_clusters")


@query(" UNION ALL ".join(f"SELECT '{x}' AS \"table\", count(*) AS removed FROM {x} WHERE person_id IN (SELECT id FROM persons WHERE is_deleted=1)" for x in _LINKS))
def person_detach_audit(t):
    gone = t("persons").where("is_deleted = 1").select(F.col("id").alias("person_id"))
    return up.detached(gone, {x: t(x) for x in _LINKS})[1]


@query("SELECT id, CASE WHEN id IN (SELECT person_id FROM aliases WHERE contains(alias,'BUILDING')) THEN 1 ELSE is_deleted END AS is_deleted, CASE WHEN id IN (SELECT person_id FROM aliases WHERE contains(alias,'BUILDING')) THEN 0 ELSE searchable END AS searchable FROM persons")
def person_soft_delete(t):
    ids = t("aliases").where("contains(alias, 'BUILDING')").select(F.col("person_id").alias("id"))
    return up.soft_deleted(t("persons"), ids).select("id", "is_deleted", "searchable")


@query("SELECT 'person' AS kind, privacy_level AS level, count(*) AS n, count(*) FILTER (WHERE is_hidden=1) AS hidden FROM persons GROUP BY 2 UNION ALL SELECT 'place', privacy_level, count(*), count(*) FILTER (WHERE hidden=1) FROM places GROUP BY 2")
def privacy_audit(t):
    return up.privacy_audit(t("persons"), t("places"))


@query("SELECT p.id, '{\"display_name\":\"'||p.display_name||'\",\"privacy_level\":\"'||p.privacy_level||'\",\"n_aliases\":'||coalesce(a.c,0)||',\"n_events\":'||coalesce(e.c,0)||'}' AS document FROM persons p LEFT JOIN (SELECT person_id, count(*) AS c FROM aliases GROUP BY 1) a ON a.person_id=p.id LEFT JOIN (SELECT person_id, count(*) AS c FROM event_people GROUP BY 1) e ON e.person_id=p.id")
def person_export(t):
    return up.person_export(t("persons"), {"n_aliases": t("aliases"), "n_events": t("event_people")})


@query("""WITH i AS (SELECT id AS event_id FROM life_events WHERE confidence < 0.1) SELECT coalesce(o.event_id,i.event_id) AS event_id, CASE WHEN i.event_id IS NOT NULL THEN 1 ELSE coalesce(o.is_hidden,0) END AS is_hidden,
CASE WHEN i.event_id IS NULL THEN o.tags_json WHEN o.tags_json='["trip","food"]' THEN '["trip","food","low"]' ELSE '["food","low"]' END AS tags_json FROM overrides o FULL JOIN i ON o.event_id=i.event_id""")
def bulk_flags(t):
    ids = t("life_events").where("confidence < 0.1").select(F.col("id").alias("event_id"))
    return up.flagged(t("overrides"), ids, ["food", "low"], is_hidden=1).select("event_id", "is_hidden", "tags_json")


@query("SELECT item_id, job_id, status FROM (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY job_id DESC, status DESC) AS r FROM job_items) WHERE r=1")
def latest_item_state(t):
    rows = t("job_items").withColumn("k", F.struct("job_id", "status"))
    return up.latest(rows, ["item_id"], "k").select("item_id", "job_id", "status")


@query("SELECT DISTINCT p.job_id, p.item_id, coalesce(v.status,'skipped') AS status FROM job_items p LEFT JOIN vlm v ON v.media_id=p.item_id")
def job_sync(t):
    plan = t("job_items").select("job_id", "item_id").distinct()
    return up.synced(plan, t("vlm").select(F.col("media_id").alias("item_id"), "status"))


@query("SELECT job_id, item_id, 'pending' AS status FROM job_items WHERE status='failed'")
def job_retry(t):
    return up.to_retry(t("job_items"))


@query("SELECT month, greatest(photos-done,0) AS remaining, least(greatest(photos-done,0),100) AS next FROM (SELECT substr(coalesce(captured_at,fallback_captured_at),1,7) AS month, count(*) AS photos, count(v.media_id) AS done FROM media m LEFT JOIN (SELECT DISTINCT media_id FROM vlm WHERE status='success') v ON v.media_id=m.id GROUP BY 1)")
def rollout_recommendation(t):
    from ..operators.statistics import month_status

    return up.recommended(month_status(t("media"), vlm=t("vlm")), "vlm_success", 100)


@query("SELECT id, CASE WHEN public_name IS NULL THEN 'missing name' WHEN lat NOT BETWEEN -90 AND 90 THEN 'bad coordinate' WHEN radius_m <= 160 THEN 'bad radius' WHEN category NOT IN ('home','station','work') THEN 'unknown category' END AS error FROM places WHERE public_name IS NULL OR lat NOT BETWEEN -90 AND 90 OR radius_m<=160 OR category NOT IN ('home','station','work')")
def place_validation(t):
    c = F.col
    rules = [("missing name", c("public_name").isNull()), ("bad coordinate", ~c("lat").between(-90, 90)), ("bad radius", c("radius_m") <= 160), ("unknown category", ~c("category").isin("home", "station", "work"))]
    return up.first_error(t("places"), rules, "id")


@query("""WITH k AS (SELECT e.id, e.confidence, list_sort(list_distinct(list(v.evidence_type) FILTER (WHERE v.evidence_type IS NOT NULL))) AS kinds FROM life_events e LEFT JOIN evidence v ON v.event_id=e.id GROUP BY 1,2) SELECT count(*) AS events, count(*) FILTER (WHERE kinds=['line'] AND confidence<0.5) AS line_only_low, count(*) FILTER (WHERE list_contains(kinds,'line') AND list_contains(kinds,'photo')) AS photo_and_line, count(*) FILTER (WHERE kinds=['vlm'] AND confidence>=0.8) AS vlm_only_high,
(SELECT count(*) FROM evidence WHERE event_id NOT IN (SELECT id FROM life_events)) AS orphans FROM k""")
def event_quality(t):
    return up.event_quality(t("life_events"), t("evidence"))


@query("WITH c AS (SELECT * FROM (VALUES ('a','2024-01-01','2024-01-10',1,1000000),('b','2024-01-11','2024-01-12',0,3),('c','2023-01-01','2023-01-02',1,5)) v(case_id,date_from,date_to,at_least,at_most)) SELECT case_id, count(e.id) AS n, count(e.id) BETWEEN at_least AND at_most AS passed FROM c LEFT JOIN life_events e ON e.date BETWEEN date_from AND date_to GROUP BY case_id, at_least, at_most")
def period_checks(t):
    cases = [("a", "2024-01-01", "2024-01-10", 1, 1_000_000), ("b", "2024-01-11", "2024-01-12", 0, 3), ("c", "2023-01-01", "2023-01-02", 1, 5)]
    expected = t("life_events").sparkSession.createDataFrame(cases, "case_id string, date_from string, date_to string, at_least int, at_most int")
    return up.period_checks(expected, t("life_events"))


@query("SELECT type, count(*) AS total, count(*) FILTER (WHERE status='passed') AS passed, count(*) FILTER (WHERE status='failed') AS failed, count(*) FILTER (WHERE status='skipped') AS skipped FROM (SELECT source AS type, CASE WHEN confidence IS NULL THEN 'skipped' WHEN confidence>=0.5 THEN 'passed' ELSE 'failed' END AS status FROM life_events) GROUP BY 1")
def results_by_type(t):
    status = F.when(F.col("confidence").isNull(), "skipped").when(F.col("confidence") >= 0.5, "passed").otherwise("failed")
    return up.by_type(t("life_events").select(F.col("source").alias("type"), status.alias("status")))


@query("SELECT value, count(*) AS n FROM (SELECT unnest(list_distinct(from_json(scene_tags_json,'[\"VARCHAR\"]'))) AS value FROM vlm) WHERE value NOT IN ('indoor','en','de') GROUP BY 1")
def unexpected_tags(t):
    return up.unexpected(t("vlm"), "scene_tags_json", ["indoor", "en", "de"])


@query("WITH r AS (SELECT source AS case_id, date, sum(cast(round(confidence*100) AS bigint)) AS score FROM life_events WHERE confidence IS NOT NULL GROUP BY 1,2), p AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, date) AS rank FROM r), e AS (SELECT DISTINCT source AS case_id, '2024-01-07' AS date FROM life_events) SELECT e.case_id, cast(min(p.rank) AS integer) AS rank, coalesce(min(p.rank)<=15,false) AS passed FROM e LEFT JOIN p USING (case_id, date) GROUP BY 1")
def rank_checks(t):
    e = t("life_events").where("confidence is not null")
    results = e.groupBy(F.col("source").alias("case_id"), "date").agg(F.sum(F.round(F.col("confidence") * 100).cast("long")).alias("score"))
    expected = t("life_events").select(F.col("source").alias("case_id"), F.lit("2024-01-07").alias("date")).distinct()
    return up.rank_bounds(results, expected, 15)


@query("SELECT id, CASE WHEN privacy_level='hidden' THEN NULL ELSE coalesce(nullif(public_name,''), 'Person '||row_number() OVER (PARTITION BY privacy_level ORDER BY created_order)) END AS label FROM persons")
def public_person_labels(t):
    n = F.row_number().over(Window.partitionBy("privacy_level").orderBy("created_order"))
    return t("persons").withColumn("n", n).select("id", up.named_or_hidden("public_name", "privacy_level", F.col("n"), "Person").alias("label"))


_ALL = ("media", "messages", "life_events", "evidence", "overrides", "ocr", "vlm", "vlm_overrides", "persons", "aliases", "speaker_links", "media_people", "event_people", "places", "event_places", "media_places", "faces", "face_members", "face_clusters", "person_clusters", "media_vectors", "job_items")


@query(" UNION ALL ".join(f"SELECT '{x}' AS name, count(*) AS n FROM {x}" for x in _ALL))
def table_counts(t):
    from functools import reduce

    return reduce(lambda a, b: a.union(b), [t(x).agg(F.count("*").alias("n")).select(F.lit(x).alias("name"), "n") for x in _ALL])
