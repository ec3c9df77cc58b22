"""The registered queries over the driver's tables, each beside its SQL.

Roles: `events` are timestamped facts (event_type is a status of five values, value a
duration), `orders` and `lineitem` are events with evidence, `customer`, `supplier`
and `nation` are people and places, `labels` are sparse review overrides of
`documents`, and coordinates are fixed functions of keys.
"""

from __future__ import annotations

import importlib
import importlib.util
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import text as T
from ..functions.timeutil import day, month
from ..operators import checks, entities, evidence, geo, integrity, rollups, sessions, vectors
from . import domain

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_SQL: dict[str, str] = {}
TYPES = ["signup", "error", "click", "view", "purchase"]
TERMS = ["tion", "secret", "password"]


def query(sql: str | None = None):
    def add(f):
        def run(spark, sf_dir):
            load = lambda name: spark.read.parquet(f"{sf_dir}/{name}.parquet")
            return f(lambda name, **how: domain.table(load, name, **how) if name in domain.TABLES else load(name))

        run.module = f.__module__
        _QUERIES[f.__name__] = run
        if sql:
            _SQL[f.__name__] = domain.with_tables(sql)
        return f

    return add


def queries():
    _load()
    return dict(_QUERIES)


def oracle_sql():
    _load()
    return dict(_SQL)


def _load() -> None:
    """Register the queries of the other modules, which use `query`."""
    for name in ("searches", "links", "statistics", "construction", "rankings", "clusterings", "scalars", "upkeep", "evaluations", "scanning", "retrieval", "cases", "months"):
        if importlib.util.find_spec(f"{__package__}.{name}"):
            importlib.import_module(f"{__package__}.{name}")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _QUERIES["representative_days"](spark, sf_dir)


def _kinds():
    return {f"n_{t}": F.col("event_type") == t for t in TYPES}


_DAILY = "SELECT strftime(ts,'%Y-%m-%d') AS day, count(*) AS n_all, " + ", ".join(f"count(*) FILTER (WHERE event_type='{t}') AS n_{t}" for t in TYPES) + " FROM events GROUP BY 1"


@query(_DAILY)
def daily_rollup(t):
    return rollups.counts_by_day(t("events"), "ts", _kinds())


@query(f"SELECT *, CAST(500*n_signup + 8*least(n_view,80) + 6*least(n_click,80) + 150*n_purchase + 5*n_error AS BIGINT) AS score FROM ({_DAILY}) ORDER BY score DESC, day DESC LIMIT 5")
def representative_days(t):
    daily = rollups.counts_by_day(t("events"), "ts", _kinds())
    return rollups.representative_days(daily, {"n_signup": (500, None), "n_view": (8, 80), "n_click": (6, 80), "n_purchase": (150, None), "n_error": (5, None)}, 5)


@query("SELECT strftime(ts,'%Y-%m') AS month, event_type, count(*) AS n FROM events GROUP BY 1,2")
def monthly_counts(t):
    return rollups.counts_by_month(t("events"), "ts", ["event_type"])


@query("SELECT CAST(h AS INTEGER) AS hour, count(e.ts) AS n FROM range(24) r(h) LEFT JOIN events e ON hour(e.ts)=r.h GROUP BY 1")
def hourly_histogram(t):
    return rollups.hourly_histogram(t("events"), "ts")


@query("SELECT d.s AS event_type, count(e.event_id) AS n, CAST(coalesce(sum(CAST(floor(e.value) AS BIGINT)),0) AS BIGINT) AS total, CAST(coalesce(max(floor(e.value)),0) AS BIGINT) AS longest FROM (SELECT unnest(['signup','error','click','view','purchase','missed']) AS s) d LEFT JOIN events e ON e.event_type=d.s GROUP BY 1")
def status_stats_fixed_domain(t):
    return rollups.domain_counts(t("events"), "event_type", [*TYPES, "missed"], F.floor("value"))


@query("SELECT event_id, user_id, value FROM events WHERE event_type='view' ORDER BY value DESC, event_id LIMIT 10")
def longest_topk(t):
    return rollups.top(t("events").where("event_type = 'view'").select("event_id", "user_id", "value"), 10, F.desc("value"), "event_id")


@query("SELECT user_id, count(*) AS n FROM events GROUP BY 1 ORDER BY n DESC, user_id LIMIT 20")
def sender_topk(t):
    return rollups.top(t("events").groupBy("user_id").agg(F.count("*").alias("n")), 20, F.desc("n"), "user_id")


@query("SELECT strftime(ts,'%Y-%m-%d') AS day, count(*) FILTER (WHERE event_type='view') AS completed, count(*) FILTER (WHERE event_type='error') AS missed, max(CASE WHEN event_type='view' THEN value END) AS longest FROM events GROUP BY 1")
def per_day_status_summary(t):
    return t("events").groupBy(day("ts").alias("day")).agg(F.count_if(F.col("event_type") == "view").alias("completed"), F.count_if(F.col("event_type") == "error").alias("missed"), F.max(F.when(F.col("event_type") == "view", F.col("value"))).alias("longest"))


@query("SELECT event_id, user_id, event_type, value FROM events WHERE value >= 50 AND event_type IN ('view','click') ORDER BY value DESC, event_id LIMIT 50")
def call_search_min_duration(t):
    rows = t("events").where((F.col("value") >= 50) & F.col("event_type").isin("view", "click"))
    return rollups.top(rows.select("event_id", "user_id", "event_type", "value"), 50, F.desc("value"), "event_id")


_SESSIONS = """WITH g AS (SELECT *, strftime(ts,'%Y-%m-%d') AS day, lag(ts) OVER (PARTITION BY user_id, strftime(ts,'%Y-%m-%d') ORDER BY ts, event_id) AS prev FROM events),
s AS (SELECT *, CAST(sum(CASE WHEN prev IS NULL OR ts - prev >= INTERVAL 90 MINUTE THEN 1 ELSE 0 END) OVER (PARTITION BY user_id, day ORDER BY ts, event_id) AS BIGINT) AS session FROM g)"""


@query(_SESSIONS + " SELECT user_id, day, session, count(*) AS n, min(ts) AS start_at, max(ts) AS end_at FROM s GROUP BY 1,2,3")
def sessions_gap(t):
    return sessions.session_rows(sessions.gap_sessions(t("events"), ["user_id"], "ts", "event_id", 90), ["user_id"], "ts")


@query(_SESSIONS + ", r AS (SELECT user_id, day, session, count(*) AS n FROM s GROUP BY 1,2,3) SELECT n AS size, count(*) AS n_sessions FROM r GROUP BY 1")
def session_stats(t):
    rows = sessions.session_rows(sessions.gap_sessions(t("events"), ["user_id"], "ts", "event_id", 90), ["user_id"], "ts")
    return rows.groupBy(F.col("n").alias("size")).agg(F.count("*").alias("n_sessions"))


@query("SELECT event_id, coalesce(lag(event_id) OVER w,-1) AS previous_id, coalesce(lead(event_id) OVER w,-1) AS next_id, row_number() OVER w = 1 AS is_first FROM events WINDOW w AS (PARTITION BY user_id, strftime(ts,'%Y-%m-%d') ORDER BY ts, event_id)")
def lead_lag_neighbours(t):
    w = Window.partitionBy("user_id", day("ts")).orderBy("ts", "event_id")
    return t("events").select("event_id", F.lag("event_id", 1, -1).over(w).alias("previous_id"), F.lead("event_id", 1, -1).over(w).alias("next_id"), (F.row_number().over(w) == 1).alias("is_first"))


@query("SELECT strftime(ts,'%Y-%m-%d') AS day FROM events UNION SELECT strftime(o_orderdate,'%Y-%m-%d') FROM orders")
def record_dates_union(t):
    return t("events").select(day("ts").alias("day")).union(t("orders").select(day("o_orderdate").alias("day"))).distinct()


@query("SELECT ts AS at, 'event' AS kind, event_id AS id FROM events UNION ALL SELECT o_orderdate, 'order', o_orderkey FROM orders")
def tagged_timeline_merge(t):
    a = t("events").select(F.col("ts").alias("at"), F.lit("event").alias("kind"), F.col("event_id").alias("id"))
    return a.unionByName(t("orders").select(F.col("o_orderdate").alias("at"), F.lit("order").alias("kind"), F.col("o_orderkey").alias("id")))


@query("SELECT json_extract_string(props,'$.k') AS tag, count(*) AS n FROM events WHERE json_extract_string(props,'$.k') IS NOT NULL GROUP BY 1 ORDER BY n DESC, tag LIMIT 20")
def json_tag_counts(t):
    return rollups.tag_counts(t("events"), "props", "k", 20)


@query("SELECT doc_id, lang FROM documents WHERE contains(lower(text),'tion') OR contains(lower(text),'secret') OR contains(lower(text),'password') OR contains(lower(source),'secret')")
def keyword_search(t):
    return t("documents").where(T.any_term(["text", "source"], TERMS)).select("doc_id", "lang")


@query("SELECT doc_id, CASE WHEN contains(lower(text),'tion') OR contains(lower(text),'src1') THEN 'text' ELSE '' END || CASE WHEN (contains(lower(text),'tion') OR contains(lower(text),'src1')) AND contains(lower(source),'src1') THEN ',' ELSE '' END || CASE WHEN contains(lower(source),'src1') THEN 'source' ELSE '' END AS fields, least(100, 22*(CAST(contains(lower(text),'tion') OR contains(lower(text),'src1') AS INT)+CAST(contains(lower(source),'src1') AS INT)) + 8*(CAST(contains(lower(text),'tion') AS INT)+CAST(contains(lower(text),'src1') OR contains(lower(source),'src1') AS INT))) AS score FROM documents")
def matched_fields(t):
    terms = ["tion", "src1"]
    fields, hits = T.matched_fields(["text", "source"], terms), T.matched_terms(["text", "source"], terms)
    return t("documents").select("doc_id", F.array_join(fields, ",").alias("fields"), F.least(F.lit(100), F.size(fields) * 22 + F.size(hits) * 8).alias("score"))


@query("SELECT d.doc_id, coalesce(CASE WHEN l.quality=1 THEN 'verified' END, d.lang) AS lang, coalesce(l.toxic,0)=1 AS hidden, coalesce(l.quality,0)=1 AS verified FROM documents d LEFT JOIN labels l USING(doc_id)")
def overlay_effective(t):
    joined = t("documents").select("doc_id", "lang").join(t("labels"), "doc_id", "left")
    return joined.select("doc_id", T.overlay(F.when(F.col("quality") == 1, "verified"), F.col("lang")).alias("lang"), (F.coalesce("toxic", F.lit(0)) == 1).alias("hidden"), (F.coalesce("quality", F.lit(0)) == 1).alias("verified"))


@query("SELECT d.doc_id FROM documents d LEFT JOIN labels l USING(doc_id) WHERE coalesce(l.toxic,0)=0 AND coalesce(l.quality,1)=1 AND d.source LIKE 'src1%'")
def trusted_visible(t):
    joined = t("documents").select("doc_id", "source").join(t("labels"), "doc_id", "left")
    return joined.where((F.coalesce("toxic", F.lit(0)) == 0) & (F.coalesce("quality", F.lit(1)) == 1) & F.startswith("source", F.lit("src1"))).select("doc_id")


@query("SELECT doc_id, quality, toxic FROM labels ORDER BY toxic DESC, quality, doc_id LIMIT 100")
def review_queue(t):
    return rollups.top(t("labels").select("doc_id", "quality", "toxic"), 100, F.desc("toxic"), "quality", "doc_id")


@query("SELECT CASE WHEN length(text)<100 THEN 'short' WHEN length(text)<1000 THEN 'middle' WHEN length(text)<10000 THEN 'long' ELSE 'huge' END AS bucket, count(*) AS n FROM documents GROUP BY 1")
def text_length_buckets(t):
    return rollups.buckets(t("documents"), F.length("text"), [100, 1000, 10000], ["short", "middle", "long", "huge"])


@query("SELECT lang, source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS chars FROM documents GROUP BY 1,2")
def lang_source_counts(t):
    return t("documents").groupBy("lang", "source").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


def _redact_sql() -> str:
    out = "text"
    for pattern, label in T.REDACTIONS:
        out = f"regexp_replace({out}, '{pattern}', '{label}', 'g')"
    return out


@query(f"SELECT doc_id, md5({_redact_sql()}) AS digest FROM documents")
def redact_tokens(t):
    return t("documents").select("doc_id", F.md5(T.redact(F.col("text"))).alias("digest"))


@query("SELECT page_id, CAST(i AS INTEGER) AS line_number, kind FROM (SELECT page_id, unnest(string_split(html, chr(10))) AS line, generate_subscripts(string_split(html, chr(10)),1) AS i FROM pages), (VALUES ('url','https?://'),('email','[A-Za-z0-9._]+@[A-Za-z0-9.]+')) p(kind,pattern) WHERE regexp_matches(line, pattern)")
def leak_scan_lines(t):
    patterns = F.array(F.struct(F.lit("url").alias("kind"), F.lit("https?://").alias("pattern")), F.struct(F.lit("email").alias("kind"), F.lit("[A-Za-z0-9._]+@[A-Za-z0-9.]+").alias("pattern")))
    lines = t("pages").select("page_id", F.posexplode(F.split("html", "\n", -1)).alias("i", "line")).withColumn("p", F.explode(patterns))
    return lines.where("rlike(line, p.pattern)").select("page_id", (F.col("i") + 1).alias("line_number"), "p.kind")


def _evidence_kinds():
    return {"n_photo": F.col("l_returnflag") == "R", "n_line": F.col("l_returnflag") == "A", "n_ocr": F.col("l_linestatus") == "F"}


_EVIDENCE = "SELECT o.o_orderkey AS l_orderkey, o.o_orderdate, o.o_custkey, count(l.l_orderkey) AS n_evidence, count(*) FILTER (WHERE l_returnflag='R') AS n_photo, count(*) FILTER (WHERE l_returnflag='A') AS n_line, count(*) FILTER (WHERE l_linestatus='F') AS n_ocr FROM orders o LEFT JOIN lineitem l ON o.o_orderkey=l.l_orderkey GROUP BY 1,2,3"


def _events(t):
    orders = t("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", "o_custkey")
    return evidence.with_counts(orders, t("lineitem"), "l_orderkey", _evidence_kinds())


@query(_EVIDENCE)
def event_evidence_counts(t):
    return _events(t)


@query(f"SELECT CASE WHEN n_photo>0 AND n_line>0 THEN 'both' WHEN n_photo>0 THEN 'photo_only' WHEN n_line>0 THEN 'line_only' ELSE 'none' END AS modality, count(*) AS n FROM ({_EVIDENCE}) GROUP BY 1")
def modality_counts(t):
    return _events(t).groupBy(evidence.modality(F.col("n_photo"), F.col("n_line"), ("photo", "line")).alias("modality")).agg(F.count("*").alias("n"))


_CONFIDENCE = "least(CASE WHEN n_ocr=0 AND n_line=0 THEN 74 ELSE 95 END, 35 + CASE WHEN n_evidence>=2 THEN 12 ELSE 0 END + CASE WHEN n_evidence>=5 THEN 8 ELSE 0 END + CASE WHEN n_photo>0 AND n_line>0 THEN 15 ELSE 0 END + CASE WHEN n_photo>=1 THEN 12 ELSE 0 END + CASE WHEN n_photo>=3 THEN 4 ELSE 0 END)"


def _scored(t):
    c = F.col
    score = evidence.confidence(c("n_evidence"), (c("n_photo") > 0) & (c("n_line") > 0), c("n_photo"), F.lit(False), F.lit(False), (c("n_ocr") == 0) & (c("n_line") == 0))
    return _events(t).withColumn("confidence", score)


@query(f"SELECT CASE WHEN c<30 THEN 'under_30' WHEN c<60 THEN 'under_60' WHEN c<80 THEN 'under_80' ELSE 'from_80' END AS bucket, count(*) AS n FROM (SELECT {_CONFIDENCE} AS c FROM ({_EVIDENCE})) GROUP BY 1")
def confidence_buckets(t):
    return rollups.buckets(_scored(t), F.col("confidence"), [30, 60, 80], ["under_30", "under_60", "under_80", "from_80"])


@query(f"SELECT l_orderkey, CAST({_CONFIDENCE} AS BIGINT) AS confidence FROM ({_EVIDENCE}) ORDER BY confidence, l_orderkey LIMIT 20")
def low_confidence_topk(t):
    return rollups.top(_scored(t).select("l_orderkey", "confidence"), 20, "confidence", "l_orderkey")


@query("SELECT l_orderkey, l_returnflag, l_linenumber, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_returnflag ORDER BY l_shipdate, l_linenumber) AS rank FROM lineitem) WHERE rank<=2")
def evidence_preview(t):
    return evidence.preview(t("lineitem"), "l_orderkey", "l_returnflag", ["l_shipdate", "l_linenumber"], 2).select("l_orderkey", "l_returnflag", "l_linenumber", "rank")


@query("SELECT strength, count(*) AS n FROM (SELECT l_orderkey, CASE WHEN (list_contains(k,'event') AND list_contains(k,'photo')) OR (list_contains(k,'line') AND list_contains(k,'photo')) THEN 'medium' ELSE 'weak' END AS strength FROM (SELECT l_orderkey, list(DISTINCT CASE l_returnflag WHEN 'R' THEN 'photo' WHEN 'A' THEN 'line' ELSE 'event' END) AS k FROM lineitem GROUP BY 1)) GROUP BY 1")
def evidence_strength_sets(t):
    kind = F.when(F.col("l_returnflag") == "R", "photo").when(F.col("l_returnflag") == "A", "line").otherwise("event")
    sets = t("lineitem").groupBy("l_orderkey").agg(F.collect_set(kind).alias("kinds"))
    return sets.groupBy(evidence.strength(F.col("kinds")).alias("strength")).agg(F.count("*").alias("n"))


@query("SELECT c.c_custkey, c.c_name, count(DISTINCT o.o_orderkey) AS n_events FROM customer c JOIN orders o ON c.c_custkey=o.o_custkey WHERE o.o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' GROUP BY 1,2")
def people_period_summary(t):
    links = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey"))
    return entities.period_summary(links, ["c_custkey", "c_name"], "o_orderkey", F.lit("1995-01-01").cast("timestamp_ntz"), F.lit("1996-12-31").cast("timestamp_ntz"), "o_orderdate")


@query("WITH f AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_returnflag='R' GROUP BY 1,2), g AS (SELECT l_orderkey, l_suppkey, count(*) AS n FROM lineitem WHERE l_linestatus='F' GROUP BY 1,2) SELECT f.l_orderkey, f.l_suppkey, f.n+g.n AS n FROM f JOIN g USING(l_orderkey,l_suppkey)")
def people_combined_intersection(t):
    keys = ["l_orderkey", "l_suppkey"]
    part = lambda c: t("lineitem").where(c).groupBy(*keys).agg(F.count("*").alias("n"))
    return entities.combined(part("l_returnflag = 'R'"), part("l_linestatus = 'F'"), keys, "n")


@query("SELECT n.n_name, strftime(o.o_orderdate,'%Y-%m') AS month, count(DISTINCT o.o_orderkey) AS n_events, count(DISTINCT c.c_custkey) AS n_people FROM orders o JOIN customer c ON o.o_custkey=c.c_custkey JOIN nation n ON c.c_nationkey=n.n_nationkey GROUP BY 1,2")
def place_period_summary(t):
    joined = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).join(t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return joined.groupBy("n_name", month("o_orderdate").alias("month")).agg(F.count_distinct("o_orderkey").alias("n_events"), F.count_distinct("c_custkey").alias("n_people"))


@query("SELECT o_orderkey FROM orders o WHERE EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey=o.o_orderkey AND l.l_returnflag='R') OR o_orderpriority LIKE '1%'")
def semi_exists_or(t):
    hit = t("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")).distinct()
    joined = t("orders").join(hit, F.col("o_orderkey") == F.col("k"), "left")
    return joined.where(F.col("k").isNotNull() | F.startswith("o_orderpriority", F.lit("1"))).select("o_orderkey")


@query("SELECT o_orderkey FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey=o.o_orderkey AND l.l_returnflag='R')")
def anti_not_exists(t):
    return t("orders").join(t("lineitem").where("l_returnflag = 'R'"), F.col("o_orderkey") == F.col("l_orderkey"), "left_anti").select("o_orderkey")


@query("WITH a AS (SELECT strftime(o_orderdate,'%m-%d') AS d, count(*) AS n_orders FROM orders GROUP BY 1), b AS (SELECT strftime(ts,'%m-%d') AS d, count(*) AS n_events FROM events GROUP BY 1) SELECT coalesce(a.d,b.d) AS d, coalesce(n_orders,0) AS n_orders, coalesce(n_events,0) AS n_events FROM a FULL JOIN b ON a.d=b.d")
def person_days_full_outer(t):
    a, b = (t(n).select(F.date_format(c, "MM-dd").alias("d")) for n, c in (("orders", "o_orderdate"), ("events", "ts")))
    return entities.days_of(a, b, ["d"], ("n_orders", "n_events"))


@query("WITH n AS (SELECT r_regionkey AS id, lower(trim(r_name)) AS name, 'region' AS source FROM region UNION ALL SELECT n_nationkey, lower(trim(n_name)), 'nation' FROM nation), q AS (SELECT n_name AS term FROM nation UNION SELECT r_name FROM region UNION SELECT 'nobody') SELECT term, count(DISTINCT id) AS n_ids, CAST(coalesce(min(id),-1) AS BIGINT) AS least_id, coalesce(string_agg(DISTINCT source, ',' ORDER BY source),'') AS sources, CASE count(DISTINCT id) WHEN 0 THEN 'none' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM q LEFT JOIN n ON lower(trim(q.term))=n.name GROUP BY 1")
def entity_resolution_status(t):
    nobody = t("region").sparkSession.createDataFrame([("nobody",)], "term string")
    terms = t("nation").select(F.col("n_name").alias("term")).union(t("region").select("r_name")).union(nobody).distinct()
    return entities.resolve(terms, "term", [(t("region"), "r_regionkey", "r_name", "region"), (t("nation"), "n_nationkey", "n_name", "nation")])


@query("SELECT conv_id, role, count(*) AS n, min(turn) AS first_at, max(turn) AS last_at FROM conversations GROUP BY 1,2")
def speaker_listing(t):
    return entities.speakers(t("conversations"), "conv_id", "role", "turn")


def _checked(t):
    """Each table is read once for all its conditions; repeated texts are found by their digests, so no text is shuffled."""
    digests = lambda name: t(name).withColumn("digest", F.sha2("text", 256)) if name == "documents" else t(name)
    kinds = ", ".join(f"'{k}'" for k in TYPES)
    named = {
        "lineitem.orphan": "lineitem_without_order", "labels.orphan": "label_without_document", "lineitem.repeated": "lineitem_repeated_key", "documents.repeated": "documents_repeated_text",
        "events.type": "event_type_unknown", "lineitem.discount": "discount_out_of_range", "events.props": "props_not_json", "embeddings.size": "embedding_bad_dimension",
    }
    rules = [
        integrity.Orphan("lineitem", "orphan", "l_orderkey", "orders", "o_orderkey"), integrity.Orphan("labels", "orphan", "doc_id", "documents", "doc_id"),
        integrity.Repeat("lineitem", "repeated", ("l_orderkey", "l_linenumber")), integrity.Repeat("documents", "repeated", ("digest",)),
        integrity.Count("events", "type", f"event_type is null or event_type not in ({kinds})"), integrity.Count("lineitem", "discount", "not l_discount between 0 and 1"),
        integrity.Count("events", "props", "props is not null and try_parse_json(props) is null"), integrity.Count("embeddings", "size", "size(embedding) <> 64"),
    ]
    name = F.create_map(*[F.lit(x) for pair in named.items() for x in pair])
    return integrity.report(digests, rules).select(name[F.col("metric")].alias("metric"), "n")


_CHECKS = """SELECT 'lineitem_without_order' AS metric, count(*) AS n FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'label_without_document', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)
UNION ALL SELECT 'lineitem_repeated_key', count(*) FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*)>1)
UNION ALL SELECT 'documents_repeated_text', count(*) FROM (SELECT 1 FROM documents GROUP BY text HAVING count(*)>1)
UNION ALL SELECT 'event_type_unknown', count(*) FROM events WHERE event_type NOT IN ('signup','error','click','view','purchase') OR event_type IS NULL
UNION ALL SELECT 'discount_out_of_range', count(*) FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 1
UNION ALL SELECT 'props_not_json', count(*) FROM events WHERE props IS NOT NULL AND NOT json_valid(props)
UNION ALL SELECT 'embedding_bad_dimension', count(*) FROM embeddings WHERE len(embedding)<>64"""


@query(_CHECKS)
def integrity_checks(t):
    return _checked(t)


@query(f"SELECT count(*) FILTER (WHERE metric IN ('lineitem_without_order','props_not_json') AND n>0) AS n_severe, count(*) FILTER (WHERE metric IN ('lineitem_without_order','props_not_json') AND n>0)=0 AS ok FROM ({_CHECKS})")
def strict_verdict(t):
    return checks.verdict(_checked(t), ["lineitem_without_order", "props_not_json"])


@query("WITH a AS (SELECT o_orderkey k, o_orderstatus s FROM orders), b AS (SELECT l_orderkey k, max(l_linestatus) s FROM lineitem GROUP BY 1) SELECT CASE WHEN a.k IS NULL THEN 'added' WHEN b.k IS NULL THEN 'removed' WHEN a.s<>b.s THEN 'changed' ELSE 'same' END AS kind, count(*) AS n FROM a FULL JOIN b ON a.k=b.k GROUP BY 1")
def snapshot_diff(t):
    """All orders against their state as their lines tell it."""
    before = t("orders").select(F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"))
    after = t("lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.max("l_linestatus").alias("s"))
    return checks.diff(before, after, "k", ["s"])


@query("SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id%20=0 AND v.vec_id<>q.vec_id) WHERE rank<=5")
def cosine_topk(t):
    v = t("embeddings")
    return vectors.cosine_top(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 5).select("query_id", "vec_id", "rank")


@query("SELECT query_id, vec_id, CAST(rank AS INTEGER) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS rank FROM embeddings q, embeddings v WHERE q.vec_id%20=0 AND v.vec_id<>q.vec_id) WHERE rank<=5")
def cosine_topk_each_20th(t):
    v = t("embeddings")
    return vectors.cosine_top(v, v.where("vec_id % 20 = 0"), "vec_id", "embedding", 5).select("query_id", "vec_id", "rank")


@query("SELECT a.vec_id AS a, b.vec_id AS b FROM embeddings a JOIN embeddings b ON a.vec_id<b.vec_id WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])>=0.4")
def threshold_edges(t):
    return vectors.threshold_edges(t("embeddings"), "vec_id", "embedding", 0.4)


_POINTS = "SELECT s_suppkey, 35.0+(s_suppkey*37%1000)/1000.0 AS lat, 139.0+(s_suppkey*91%1000)/1000.0 AS lon FROM supplier"
_PLACES = "SELECT n_nationkey, 35.0+(n_nationkey*41%1000)/1000.0 AS place_lat, 139.0+(n_nationkey*43%1000)/1000.0 AS place_lon, 9000.0+n_nationkey*1000 AS radius_m FROM nation"
_METRES = "2*6371000*atan2(sqrt(h),sqrt(1-h))"


@query(f"WITH p AS ({_POINTS}), q AS ({_PLACES}), d AS (SELECT s_suppkey, n_nationkey, radius_m, pow(sin((radians(place_lat)-radians(lat))/2),2)+cos(radians(lat))*cos(radians(place_lat))*pow(sin(radians(place_lon-lon)/2),2) AS h FROM p, q) SELECT s_suppkey, arg_min(n_nationkey, {_METRES}) AS n_nationkey FROM d WHERE {_METRES}<=radius_m GROUP BY 1")
def nearest_place(t):
    at = lambda k, m, base: F.lit(base) + F.col(k) * m % 1000 / F.lit(1000.0)
    points = t("supplier").select("s_suppkey", at("s_suppkey", 37, 35.0).alias("lat"), at("s_suppkey", 91, 139.0).alias("lon"))
    places = t("nation").select("n_nationkey", at("n_nationkey", 41, 35.0).alias("place_lat"), at("n_nationkey", 43, 139.0).alias("place_lon"), (F.col("n_nationkey") * 1000 + 9000.0).alias("radius_m"))
    return geo.nearest_within(points, "s_suppkey", places, "n_nationkey", 0.1).select("s_suppkey", "n_nationkey")


@query()
def place_sessions(t):
    lat = F.when(F.col("event_id") % 3 == 0, 35.0 + F.col("event_id") % 7 / 1000.0)
    lon = F.when(F.col("event_id") % 3 == 0, 139.0 + F.col("event_id") % 5 / 1000.0)
    return sessions.place_sessions(t("events").withColumn("lat", lat).withColumn("lon", lon), "user_id", "ts", "event_id")


@query()
def cross_kind_merge(t):
    facts = t("events").withColumn("kind", F.when(F.col("event_type") == "view", "photo").otherwise("line"))
    rows = sessions.gap_sessions(facts, ["user_id", "kind"], "ts", "event_id", 90)
    return sessions.merge_kinds(sessions.session_rows(rows, ["user_id", "kind"], "ts"), "user_id")
