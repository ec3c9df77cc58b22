"""Scans, lookups and ingestion, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import scans
from .catalog import query
from .links import _DATE

def _when():
    return F.coalesce("captured_at", "fallback_captured_at")


@query("SELECT id, sender, text FROM messages WHERE substr(sent_at,1,10) >= '2024-01-04' AND substr(sent_at,1,10) <= '2024-01-09' AND chat_id IN ('chat_1','chat_2') AND message_type = 'text' ORDER BY sent_at, id LIMIT 100")
def message_scan(t):
    rows = scans.scan(t("messages"), F.col("sent_at"), date_from="2024-01-04", date_to="2024-01-09", order=["sent_at", "id"], most=100, chat_id=["chat_1", "chat_2"], message_type="text")
    return rows.select("id", "sender", "text")


@query(f"SELECT id, {_DATE} AS date FROM media WHERE {_DATE} >= '2024-01-20' AND camera_model = 'Cam A'")
def media_scan(t):
    return scans.scan(t("media"), _when(), date_from="2024-01-20", camera_model="Cam A").select("id", F.substring(_when(), 1, 10).alias("date"))


@query("SELECT media_id, status FROM ocr WHERE status IN ('failed','engine_unavailable') AND substr(analyzed_at,1,10) <= '2024-01-15'")
def ocr_scan(t):
    return scans.scan(t("ocr"), F.col("analyzed_at"), date_to="2024-01-15", status=["failed", "engine_unavailable"]).select("media_id", "status")


@query("SELECT id, title FROM life_events WHERE id IN (SELECT event_id FROM evidence WHERE evidence_type = 'vlm')")
def events_by_ids(t):
    ids = t("evidence").where("evidence_type = 'vlm'").select(F.col("event_id").alias("id"))
    return scans.by_ids(t("life_events"), ids, "id").select("id", "title")


@query("SELECT id FROM media WHERE NOT (id IN (SELECT media_id FROM ocr WHERE status='success') AND id IN (SELECT media_id FROM vlm WHERE status='success'))")
def analysis_candidates(t):
    return scans.without_results(t("media"), t("ocr"), t("vlm")).select("id")


@query("WITH old AS (SELECT * FROM media WHERE camera_model='Cam A'), new AS (SELECT DISTINCT file_hash FROM media WHERE file_hash NOT IN (SELECT file_hash FROM old)) SELECT (SELECT count(*) FROM media) AS scanned, (SELECT count(*) FROM new) AS added, (SELECT count(*) FROM media) - (SELECT count(*) FROM new) AS skipped")
def ingest_report(t):
    """All media ingested into a table that holds those of one camera."""
    return scans.ingested(t("media").where("camera_model = 'Cam A'"), t("media"), "id", "file_hash")[1]


@query("""SELECT event_id, CASE WHEN tags_json IS NULL THEN '' WHEN tags_json='["trip","food"]' THEN 'trip|food' ELSE tags_json END AS tags FROM overrides""")
def lenient_tags(t):
    tags = scans.tag_list(F.col("tags_json"))
    return t("overrides").select("event_id", F.array_join(tags, "|").alias("tags"))
