"""Functions over questions, dates and labels, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates as dt, questions as qs, redaction as rd
from .catalog import query

_ASKED = """SELECT date, id, CASE substr(title,1,1) WHEN '食' THEN concat(substr(date,1,4),'年',cast(substr(date,6,2) AS int),'月',cast(substr(date,9,2) AS int),'日に何してた？') WHEN '移' THEN concat(cast(substr(date,6,2) AS int),'月',cast(substr(date,9,2) AS int),'日に新宿へ行った？')
 WHEN '通' THEN concat(substr(date,1,7),'のまとめ') WHEN 'L' THEN concat('去年の',cast(substr(date,9,2) AS int) % 12 + 1,'月の写真を探して') ELSE 'ラーメンの写真はいつ' END AS q FROM life_events"""


def _asked(t):
    return t("life_events").sparkSession.sql(_ASKED.replace("life_events", "{e}"), e=t("life_events"))


def _range(q):
    return dt.date_range(q, F.lit("2025-05-15").cast("date"), 2024)


_START = "CASE WHEN contains(q,'日に') THEN CAST(date AS DATE) WHEN contains(q,'まとめ') THEN date_trunc('month', CAST(date AS DATE)) WHEN contains(q,'去年') THEN make_date(2024, CAST(regexp_extract(q,'去年の(\\d+)月',1) AS INT), 1) END"


@query(f"SELECT id, q, CAST(s AS VARCHAR) AS start_date, CAST(CASE WHEN contains(q,'日に') THEN s ELSE last_day(s) END AS VARCHAR) AS end_date FROM (SELECT *, CAST({_START} AS DATE) AS s FROM ({_ASKED}))")
def question_dates(t):
    rows = _asked(t).withColumn("r", _range(F.col("q")))
    return rows.select("id", "q", F.col("r.start").cast("string").alias("start_date"), F.col("r.end").cast("string").alias("end_date"))


@query(f"SELECT id, CASE WHEN contains(q,'何してた') THEN 'date_qa' WHEN contains(q,'まとめ') THEN 'time_range_summary' WHEN contains(q,'ラーメン') THEN 'specific_food_search' WHEN contains(q,'写真') THEN 'multimodal_image_search' ELSE 'place_visit' END AS intent, CASE WHEN contains(q,'何してた') THEN 'ask' WHEN contains(q,'まとめ') THEN 'event_summary' WHEN contains(q,'写真') THEN 'multimodal-search' ELSE 'search' END AS route, CASE WHEN contains(q,'新宿へ') THEN '日に新宿' END AS place FROM ({_ASKED})")
def question_intents(t):
    """Intents of made-up questions; the SQL states what each form is."""
    rows = _asked(t).withColumn("r", _range(F.col("q"))).withColumn("p", qs.place(F.col("q"))).withColumn("intent", qs.intent(F.col("q"), F.col("r"), F.col("p")))
    return rows.select("id", "intent", qs.route(F.col("intent")).alias("route"), F.regexp_extract("p", "(日に新宿)$", 1).alias("place")).withColumn("place", F.nullif("place", F.lit("")))


@query()
def message_intents(t):
    """Intents, people, places and call states of the distinct messages taken as questions."""
    q = F.col("text")
    rows = t("messages").where("text is not null").groupBy("text").agg(F.count("*").alias("n")).withColumn("r", _range(q)).withColumn("p", qs.place(q))
    return rows.select("text", "n", qs.intent(q, F.col("r"), F.col("p")).alias("intent"), qs.person(q).alias("person"), F.col("p").alias("place"), qs.call_status(q).alias("call_status"), qs.dish(q).alias("dish"))


@query(f"""SELECT id, CASE WHEN contains(q,'何してた') THEN 0.92::double WHEN contains(q,'まとめ') THEN 0.86::double WHEN contains(q,'ラーメン') THEN 0.9::double WHEN contains(q,'写真') THEN 0.86::double ELSE 0.84::double END AS confidence,
CASE WHEN contains(q,'ラーメン') THEN 'ラーメン' ELSE '' END AS food_terms, CASE WHEN contains(q,'写真') THEN 'photo' WHEN contains(q,'ラーメン') THEN 'food' END AS activity FROM ({_ASKED})""")
def question_confidence(t):
    """How sure the intent of each event's question is, its food words and activity."""
    q = F.col("q")
    return _asked(t).select("id", qs.classified(q, _range(q)).confidence.alias("confidence"), F.array_join(qs.food_terms(q), ",").alias("food_terms"), qs.activity(q).alias("activity"))


@query()
def message_topics(t):
    """Topic, terms, activity and coarse intent of the distinct messages taken as questions."""
    q = F.col("text")
    rows = t("messages").where("text is not null").select("text").distinct()
    return rows.select("text", qs.topic(q).alias("topic"), F.array_join(qs.raw_terms(q), "|").alias("terms"), qs.activity(q).alias("activity"), qs.search_intent(q).alias("intent"), qs.classified(q, _range(q)).alias("c")).select("text", "topic", "terms", "activity", "intent", "c.confidence", "c.reason")


@query("WITH f AS (SELECT sender, min((sent_at, id)) AS f FROM messages WHERE trim(sender)<>'' GROUP BY 1), n AS (SELECT sender, 'SENDER_'||row_number() OVER (ORDER BY f, sender) AS label FROM f) SELECT m.id, coalesce(n.label,'') AS label, substr(m.sent_at,1,7) AS month FROM messages m LEFT JOIN n ON n.sender = trim(m.sender)")
def numbered_senders(t):
    rows = rd.numbered(t("messages").withColumn("o", F.struct("sent_at", "id")), "o", "sender", "SENDER")
    return rows.select("id", "label", rd.month_only(F.col("sent_at")).alias("month"))


@query()
def redacted_texts(t):
    """Recognised texts redacted; the rules look around, which DuckDB's expressions cannot."""
    return t("ocr").select("media_id", F.md5(rd.redact_ocr(F.col("ocr_text"))).alias("digest"), rd.redact_report(F.col("ocr_text"), 60).alias("preview"))


@query("SELECT id, strftime(last_day(CAST(date AS DATE)),'%Y-%m-%d') AS month_end, len(range(CAST(date AS DATE), last_day(CAST(date AS DATE)) + INTERVAL 1 DAY, INTERVAL 1 DAY)) AS days_left FROM life_events")
def days_to_month_end(t):
    d = F.col("date").cast("date")
    bounds = dt.month_bounds(F.year(d), F.month(d))
    return t("life_events").select("id", bounds.end.cast("string").alias("month_end"), F.size(dt.days_between(d, bounds.end)).cast("long").alias("days_left"))
