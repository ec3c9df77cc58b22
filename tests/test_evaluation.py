"""Cases judged from tables, against a plain version and on awkward rows."""

import random

import pytest
from pyspark.sql import functions as F

from kronoleaf.operators import evaluation as ev

EXPECTED = "case_id string, rule string, subject string, wanted string, bound double"
RULES = ["at_least", "at_most", "includes", "excludes", "any_of", "mentions", "lacks"]


def plain(expectations, facts):
    """[(case, rule, subject, wanted, bound, failed)], in order"""
    asked = {}
    for case, rule, subject, wanted, bound in expectations:
        asked.setdefault((case, rule, subject, bound, wanted if rule != "any_of" else None), set()).update({wanted} - {None})
    out = []
    for (case, rule, subject, bound, _), wanted in asked.items():
        own = [f for f in facts if f[0] == case and f[1] == subject]
        value = max([f[4] for f in own if f[4] is not None], default=0.0)
        listed = any(f[2] in wanted and (bound is None or (1 if f[3] is None else f[3]) <= bound) for f in own)
        said = any(w in f[2] for f in own if f[2] is not None for w in wanted)
        if rule in ("at_least", "at_most"):
            failed = bound is None or (value < bound if rule == "at_least" else value > bound)
        elif rule in RULES and wanted:
            failed = {"includes": not listed, "any_of": not listed, "excludes": listed, "mentions": not said, "lacks": said}[rule]
        else:
            failed = True
        out.append((case, rule, subject, ",".join(sorted(wanted)), bound, failed))
    return sorted(out, key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_outcomes_equal_plain_version(spark, seed):
    r = random.Random(seed)
    pick = lambda *xs: r.choice(xs)
    facts = [(f"c{r.randrange(6)}", pick("a", "b"), pick(None, "x", "xy", "yz", ""), pick(None, 1, 2, 5), pick(None, 0.5, 3.0, -1.0)) for _ in range(60)]
    asked = [(f"c{r.randrange(8)}", pick(*RULES, None, "other"), pick("a", "b", None), pick(None, "x", "y", "yz", ""), pick(None, 1.0, 3.0)) for _ in range(300)]
    got = ev.outcomes(spark.createDataFrame(asked, EXPECTED), spark.createDataFrame(facts, ev.FACT)).collect()
    assert sorted(((x.case_id, x.rule, x.subject, x.wanted, x.bound, x.failed) for x in got), key=repr) == plain(asked, facts)


def test_judged_cases(spark):
    cases = spark.createDataFrame([("a", "t", 1), ("b", "t", 1), ("c", "other", 1), (None, "t", 1), ("d", "t", 1), ("d", "t", 2), ("e", "t", 1), ("f", None, 1), ("g", "t", 1)], "case_id string, type string, value int")
    asked = spark.createDataFrame([("a", "at_least", "n", None, 2.0), ("a", "at_least", "n", None, 2.0), ("b", "at_most", "n", None, 2.0), ("b", "includes", "day", "2024-01-01", 1.0), ("d", "at_least", "n", None, 9.0), ("e", "at_least", "n", None, 9.0), ("g", "skip", "skip", None, None), ("nobody", "at_least", "n", None, 1.0)], EXPECTED)
    told = spark.createDataFrame([("a", "n", None, None, 2.0), ("b", "n", None, None, 3.0), ("b", "day", "2024-01-01", 2, None), ("e", "skip", "why", None, None), ("e", "skip", "also", None, None)], ev.FACT)
    rows = ev.judged(cases, asked, {"t": lambda c: told.join(c.select("case_id").distinct(), "case_id", "left_semi")})
    got = sorted((str(x.case_id), x.status, x.reason, x.n_rules, x.n_failed) for x in rows.collect())
    twice = ("d", "skipped", "id used more than once", 0, 0)
    assert got == [
        ("None", "skipped", "no id", 0, 0), ("a", "passed", None, 1, 0), ("b", "failed", None, 2, 2), ("c", "skipped", "unsupported case type: other", 0, 0), twice, twice,
        ("e", "skipped", "also", 0, 0), ("f", "skipped", "unsupported case type: none", 0, 0), ("g", "passed", None, 0, 0),
    ]
    assert sorted((x.case_id, x.rule, x.bound, x.got) for x in ev.failures(rows).collect()) == [("b", "at_most", 2.0, 3.0), ("b", "includes", 1.0, 0.0)]
    assert ev.judged(cases.limit(0), asked, {"t": lambda c: told.limit(0)}).count() == 0


def test_answers_of_periods_and_places(spark):
    events = spark.createDataFrame([("e1", "2024-01-01", "lunch", 0.5), ("e2", "2024-01-02", "walk", None), ("e3", "2024-01-02", "lunch", 0.9)], "id string, date string, title string, confidence double")
    proof = spark.createDataFrame([("e1", "line"), ("e3", "photo"), ("e3", "photo"), ("gone", "ocr")], "event_id string, evidence_type string")
    cases = spark.createDataFrame([("a", "2024-01-01", "2024-01-03"), ("back", "2024-01-03", "2024-01-01"), ("null", None, "2024-01-03"), ("odd", "soon", "2024-01-03")], "case_id string, date_from string, date_to string")
    got = {(x.case_id, x.subject, x.item, x["rank"], x.value) for x in ev.period_answers(cases, events, proof).collect()}
    assert got == {("a", "events", None, None, 3.0), ("a", "confidence", None, None, 0.9), ("a", "title", "lunch", None, 2.0), ("a", "title", "walk", None, 1.0), ("a", "evidence", "line", None, 1.0), ("a", "evidence", "photo", None, 2.0), ("a", "day", "2024-01-02", 1, 2.0), ("a", "day", "2024-01-01", 2, 1.0)}
    places = spark.createDataFrame([("p", 0, 1), ("h", 1, 1), ("s", 0, 0)], "id string, hidden int, searchable int")
    links = spark.createDataFrame([("p", "e1"), ("p", "e1"), ("p", "e3"), ("h", "e2")], "place_id string, event_id string")
    asked = spark.createDataFrame([("1", "p"), ("2", "h"), ("3", "s"), ("4", "x"), ("5", None)], "case_id string, place_id string")
    got = {(x.case_id, x.subject, x.item, x.value) for x in ev.place_answers(asked, places, links, events).collect()}
    assert got == {("1", "events", None, 2.0), ("1", "day", "2024-01-01", 1.0), ("1", "day", "2024-01-02", 1.0), ("2", "skip", "place is not searchable", None), ("3", "skip", "place is not searchable", None), ("4", "skip", "no such place", None), ("5", "skip", "no such place", None)}


def test_people_are_skipped_without_a_verified_link(spark):
    persons = spark.createDataFrame([("p", 0, 0, 1), ("q", 0, 0, 1), ("r", 0, 1, 1)], "id string, is_hidden int, is_deleted int, searchable int")
    links = spark.createDataFrame([("p", "e1", "face", 1, 0), ("p", "e1", "chat", 1, 0), ("p", "e2", "face", 1, 1), ("q", "e1", "face", 0, 0), ("r", "e1", "face", 1, 0)], "person_id string, event_id string, source string, is_verified int, is_hidden int")
    events = spark.createDataFrame([("e1",), ("e2",)], "id string")
    asked = spark.createDataFrame([(x, x) for x in "pqrs"], "case_id string, person_id string")
    got = {(x.case_id, x.subject, x.item, x.value) for x in ev.person_answers(asked, persons, links, events).collect()}
    assert got == {("p", "events", None, 1.0), ("p", "source", "face", None), ("p", "source", "chat", None), ("q", "skip", "no verified link", None), ("r", "skip", "person may not be searched", None), ("s", "skip", "no such person", None)}


def test_keywords_and_intents(spark):
    texts = spark.createDataFrame([("event", "2024-01-01", "Cafe lunch", 3), ("line", "2024-01-02", "cafe", 2), ("line", "2024-01-02", "the cafe", 2), ("line", "2024-01-03", None, 2)], "kind string, date string, text string, weight int")
    asked = spark.createDataFrame([("a", " CAFE "), ("b", "cafe"), ("c", "nothing"), ("d", None), ("e", " ")], "case_id string, query string")
    got = {(x.case_id, x.subject, x.item, x["rank"], x.value) for x in ev.keyword_answers(asked, texts).collect()}
    assert got == {(c, *f) for c in "ab" for f in (("day", "2024-01-02", 1, 4.0), ("day", "2024-01-01", 2, 3.0), ("score", None, None, 4.0), ("kind", "line", None, 2.0), ("kind", "event", None, 1.0))}
    cases = spark.createDataFrame([("1", "2024年1月5日は何をした？"), ("2", "ラーメンの写真を探して"), ("3", None)], "case_id string, question string").withColumn("type", F.lit("query_intent"))
    wanted = spark.createDataFrame([("1", "includes", "intent", "date_qa", None), ("1", "at_least", "confidence", None, 0.35), ("2", "includes", "route", "multimodal-search", None), ("3", "at_least", "confidence", None, 0.35)], EXPECTED)
    rows = ev.judged(cases, wanted, {"query_intent": lambda c: ev.intent_answers(c, "2025-05-15", 2024)})
    assert {x.case_id: x.status for x in rows.collect()} == {"1": "passed", "2": "passed", "3": "failed"}
