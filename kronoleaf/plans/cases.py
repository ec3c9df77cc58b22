"""Evaluation cases of a table against answers from the activity tables, beside their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation as ev, search, upkeep as up
from .catalog import query
from .links import _CALLS, _calls
from .searches import _EFFECTIVE, _OVERLAID, _USABLE

_SHOWN = f"SELECT * FROM ({_OVERLAID}) WHERE is_hidden = 0"
_RANK = "cast(row_number() OVER (PARTITION BY {} ORDER BY {}) AS integer)"
_NONE = "cast(NULL AS varchar), cast(NULL AS integer)"
_ANSWERS = f"""WITH e AS ({_SHOWN}), ct AS (SELECT * FROM eval_cases),
pc AS (SELECT * FROM ct WHERE type IN ('date_qa','time_range_summary')), kc AS (SELECT case_id, lower(trim(query)) AS term FROM ct WHERE type='keyword_search'), cc AS (SELECT * FROM ct WHERE type='call_search'),
lc AS (SELECT c.case_id, c.place_id, CASE WHEN p.id IS NULL THEN 'no such place' WHEN p.hidden=1 OR p.searchable<>1 THEN 'place is not searchable' END AS reason FROM ct c LEFT JOIN places p ON p.id=c.place_id WHERE c.type='place_qa'),
sure AS (SELECT person_id, event_id, source FROM event_people WHERE is_hidden=0 AND is_verified=1),
nc AS (SELECT c.case_id, c.person_id, CASE WHEN p.id IS NULL THEN 'no such person' WHEN p.is_hidden=1 OR p.is_deleted=1 OR p.searchable<>1 THEN 'person may not be searched' WHEN c.person_id NOT IN (SELECT person_id FROM sure) THEN 'no verified link' END AS reason FROM ct c LEFT JOIN persons p ON p.id=c.person_id WHERE c.type='person_qa'),
ic AS (SELECT case_id, lower(trim(query)) AS term FROM ct WHERE type='image_search'),
pe AS (SELECT c.case_id, e.* FROM pc c JOIN e ON e.date BETWEEN c.date_from AND c.date_to), pd AS (SELECT case_id, date, count(*) AS n FROM pe GROUP BY 1,2),
tx AS (SELECT 'event' AS kind, date, concat_ws(' ', title, summary, location_name) AS text, 3 AS weight FROM e UNION ALL SELECT 'line', substr(sent_at,1,10), text, 2 FROM messages),
kh AS (SELECT q.term, tx.kind, tx.date, tx.weight FROM (SELECT DISTINCT term FROM kc) q JOIN tx ON contains(lower(tx.text), q.term)), kd AS (SELECT term, date, sum(weight) AS score FROM kh GROUP BY 1,2), kr AS (SELECT term, date, score, {_RANK.format("term", "score DESC, date")} AS rank FROM kd),
cr AS (SELECT c.case_id, k.call_status, k.duration_sec FROM cc c JOIN ({_CALLS}) k ON substr(k.sent_at,1,10) BETWEEN c.date_from AND c.date_to),
ld AS (SELECT place_id, date, count(*) AS n FROM (SELECT DISTINCT place_id, event_id FROM event_places) x JOIN e ON e.id=x.event_id GROUP BY 1,2),
se AS (SELECT * FROM sure WHERE event_id IN (SELECT id FROM e)),
im AS (SELECT q.term, v.media_id, v.confidence FROM (SELECT DISTINCT term FROM ic) q JOIN (SELECT * FROM ({_EFFECTIVE}) WHERE {_USABLE}) v ON contains(lower(v.caption), q.term)),
f(case_id, subject, item, rank, value) AS (
SELECT case_id, 'events', {_NONE}, cast(count(*) AS double) FROM pe GROUP BY 1
UNION ALL SELECT case_id, 'confidence', {_NONE}, max(confidence) FROM pe GROUP BY 1
UNION ALL SELECT case_id, 'title', title, cast(NULL AS integer), count(*) FROM pe GROUP BY 1, title
UNION ALL SELECT pe.case_id, 'evidence', v.evidence_type, cast(NULL AS integer), count(*) FROM pe JOIN evidence v ON v.event_id=pe.id GROUP BY 1,3
UNION ALL SELECT case_id, 'day', date, {_RANK.format("case_id", "n DESC, date")}, n FROM pd
UNION ALL SELECT c.case_id, 'day', r.date, r.rank, r.score FROM kc c JOIN kr r USING (term)
UNION ALL SELECT c.case_id, 'score', {_NONE}, r.score FROM kc c JOIN kr r USING (term) WHERE r.rank=1
UNION ALL SELECT c.case_id, 'kind', h.kind, cast(NULL AS integer), h.n FROM kc c JOIN (SELECT term, kind, count(*) AS n FROM kh GROUP BY 1,2) h USING (term)
UNION ALL SELECT case_id, 'call_status', call_status, cast(NULL AS integer), count(*) FROM cr GROUP BY 1,3
UNION ALL SELECT case_id, 'calls', {_NONE}, count(*) FROM cr GROUP BY 1
UNION ALL SELECT case_id, 'longest', {_NONE}, max(duration_sec) FROM cr GROUP BY 1
UNION ALL SELECT case_id, 'skip', reason, cast(NULL AS integer), cast(NULL AS double) FROM (SELECT case_id, reason FROM lc UNION ALL SELECT case_id, reason FROM nc) WHERE reason IS NOT NULL
UNION ALL SELECT c.case_id, 'events', {_NONE}, sum(n) FROM lc c JOIN ld USING (place_id) WHERE reason IS NULL GROUP BY 1
UNION ALL SELECT c.case_id, 'day', date, {_RANK.format("c.case_id", "n DESC, date")}, n FROM lc c JOIN ld USING (place_id) WHERE reason IS NULL
UNION ALL SELECT c.case_id, 'events', {_NONE}, count(DISTINCT event_id) FROM nc c JOIN se USING (person_id) WHERE reason IS NULL GROUP BY 1
UNION ALL SELECT DISTINCT c.case_id, 'source', source, cast(NULL AS integer), cast(NULL AS double) FROM nc c JOIN se USING (person_id) WHERE reason IS NULL
UNION ALL SELECT c.case_id, 'photos', {_NONE}, i.n FROM ic c JOIN (SELECT term, count(*) AS n FROM im GROUP BY 1) i USING (term)
UNION ALL SELECT c.case_id, 'media', i.media_id, i.rank, i.confidence FROM ic c JOIN (SELECT *, {_RANK.format("term", "confidence DESC NULLS LAST, media_id")} AS rank FROM im) i USING (term) WHERE i.rank<=20),
x AS (SELECT case_id, rule, subject, bound, CASE WHEN rule<>'any_of' THEN wanted END AS only, list_sort(list(DISTINCT wanted) FILTER (WHERE wanted IS NOT NULL)) AS wanted FROM eval_expectations GROUP BY 1,2,3,4,5),
m AS (SELECT x.case_id, x.rule, x.subject, x.bound, x.wanted, max(f.value) AS value, count(f.case_id) AS n FROM x LEFT JOIN f ON f.case_id=x.case_id AND f.subject=x.subject AND CASE WHEN x.rule IN ('at_least','at_most') THEN f.value IS NOT NULL
 WHEN x.rule IN ('includes','excludes','any_of') THEN list_contains(x.wanted, f.item) AND (x.bound IS NULL OR coalesce(f.rank,1)<=x.bound) ELSE len(list_filter(x.wanted, lambda w: contains(f.item, w)))>0 END GROUP BY 1,2,3,4,5),
o AS (SELECT *, CASE rule WHEN 'at_least' THEN coalesce(value,0)<bound WHEN 'at_most' THEN coalesce(value,0)>bound WHEN 'excludes' THEN n>0 WHEN 'lacks' THEN n>0 ELSE n=0 END AS failed, CASE WHEN rule IN ('at_least','at_most') THEN coalesce(value,0) ELSE cast(n AS double) END AS got FROM m),
r AS (SELECT c.case_id, c.type, CASE WHEN c.type='voice_search' THEN 'unsupported case type: voice_search' ELSE (SELECT min(f.item) FROM f WHERE f.case_id=c.case_id AND f.subject='skip') END AS reason FROM ct c),
j AS (SELECT r.case_id, r.type, r.reason, count(o.rule) AS rules, count(*) FILTER (WHERE o.failed) AS bad FROM r LEFT JOIN o USING (case_id) GROUP BY 1,2,3),
z AS (SELECT case_id, type, CASE WHEN reason IS NOT NULL THEN 'skipped' WHEN bad>0 THEN 'failed' ELSE 'passed' END AS status, reason, CASE WHEN reason IS NULL THEN rules ELSE 0 END AS n_rules, CASE WHEN reason IS NULL THEN bad ELSE 0 END AS n_failed FROM j)"""


def _judged(t):
    shown = search.overlaid_events(t("life_events"), t("overrides")).where("is_hidden = 0")
    texts = shown.select(F.lit("event").alias("kind"), "date", F.concat_ws(" ", "title", "summary", "location_name").alias("text"), F.lit(3).alias("weight"))
    texts = texts.union(t("messages").select(F.lit("line"), F.substring("sent_at", 1, 10), "text", F.lit(2)))
    calls = _calls(t).withColumn("date", F.substring("sent_at", 1, 10))
    captions = search.effective_vlm(t("vlm"), t("vlm_overrides")).where(search.usable("search"))
    period = lambda cases: ev.period_answers(cases, shown, t("evidence"))
    answers = {
        "date_qa": period, "time_range_summary": period, "keyword_search": lambda cases: ev.keyword_answers(cases, texts), "call_search": lambda cases: ev.call_answers(cases, calls),
        "place_qa": lambda cases: ev.place_answers(cases, t("places"), t("event_places"), shown), "person_qa": lambda cases: ev.person_answers(cases, t("persons"), t("event_people"), shown),
        "image_search": lambda cases: ev.image_answers(cases, captions),
    }
    return ev.judged(t("eval_cases"), t("eval_expectations"), answers)


@query(f"{_ANSWERS} SELECT case_id, type, status, reason, n_rules, n_failed FROM z")
def eval_results(t):
    """Each case of the table as passed, failed or skipped, with why it was skipped."""
    return _judged(t).drop("failures")


@query(f"{_ANSWERS} SELECT z.case_id, z.type, o.rule, o.subject, array_to_string(coalesce(o.wanted, []::VARCHAR[]), ',') AS wanted, o.bound, o.got FROM z JOIN o USING (case_id) WHERE z.reason IS NULL AND o.failed")
def eval_failures(t):
    """Each expectation that a case fails, with what was found in its place."""
    return ev.failures(_judged(t))


@query(f"{_ANSWERS} SELECT type, count(*) AS total, count(*) FILTER (WHERE status='passed') AS passed, count(*) FILTER (WHERE status='failed') AS failed, count(*) FILTER (WHERE status='skipped') AS skipped FROM z GROUP BY 1")
def eval_types(t):
    """Cases of each type by their outcome."""
    return up.by_type(_judged(t))
