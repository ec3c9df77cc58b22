"""Evaluation from tables: cases, what is expected of each, and answers as facts, judged in one plan.

A case is (case_id, type, ...). An expectation is (case_id, rule, subject, wanted, bound). An answer is any number of facts
(case_id, subject, item, rank, value). Each expectation is judged by the facts of its case and subject:

| rule | holds where |
| --- | --- |
| at_least, at_most | the greatest value, 0 without one, is not below or above `bound` |
| includes, excludes | some or no fact has the item `wanted`, among the first `bound` where that is given |
| any_of | the same of one of all items wanted with the same subject and bound |
| mentions, lacks | some or no item holds the text `wanted` |

An expectation with another rule, or without what its rule needs, fails. Repeated expectations count once; those of no case count
nowhere. A fact of the subject `skip` has its case skipped for the reason in `item`.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..checkpoints import written
from . import multimatch
from .search import flag

FACT = "case_id string, subject string, item string, rank int, value double"
NUMERIC, LISTED, WORDED = ["at_least", "at_most"], ["includes", "excludes", "any_of"], ["mentions", "lacks"]
_KEY = ["case_id", "rule", "subject", "bound", "wanted"]


def facts(rows: DataFrame, subject: str | Column, item: str | None = None, rank: str | None = None, value: str | None = None) -> DataFrame:
    """Facts from the named columns of `rows`, which has a case_id."""
    get = lambda c, kind: (F.col(c) if c else F.lit(None)).cast(kind)
    return rows.select(F.col("case_id").cast("string").alias("case_id"), (F.lit(subject) if isinstance(subject, str) else subject).alias("subject"), get(item, "string").alias("item"), get(rank, "int").alias("rank"), get(value, "double").alias("value"))


def together(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def _met(x: Column) -> Column:
    """Whether a fact speaks to the expectation `x`."""
    rule, item = x["rule"], F.col("item")
    early = x["bound"].isNull() | (F.coalesce("rank", F.lit(1)) <= x["bound"])
    met = F.when(rule.isin(NUMERIC), F.col("value").isNotNull()).when(rule.isin(LISTED), F.array_contains(x["wanted"], item) & early)
    met = met.when(rule.isin(WORDED), F.exists(x["wanted"], lambda w: F.contains(item, w))).otherwise(rule == "skip")
    return F.coalesce(met, F.lit(False))


def outcomes(expectations: DataFrame, answered: DataFrame) -> DataFrame:
    """(case_id, rule, subject, wanted, bound, got, said, failed): one row an expectation.

    `got` is the number that was judged: a value, or how many facts met it; `said` the least item that did. The
    expectations of one case and subject, which people write, go to its facts as one list, so each fact is read once and
    the sums are made before they are shuffled.
    """
    one = F.when(~F.col("rule").eqNullSafe(F.lit("any_of")), F.col("wanted"))
    asked = expectations.where("case_id is not null").groupBy("case_id", "rule", "subject", "bound", one.alias("only")).agg(F.sort_array(F.collect_set("wanted")).alias("wanted")).drop("only")
    lists = asked.groupBy("case_id", "subject").agg(F.collect_list(F.struct("rule", "bound", "wanted")).alias("asked"))
    met = answered.join(lists, ["case_id", "subject"]).select("case_id", "subject", "item", "value", F.explode(F.filter("asked", _met)).alias("x"))
    sums = met.select("case_id", "subject", "item", "value", "x.*").groupBy(*_KEY).agg(F.max("value").alias("value"), F.count("*").alias("n"), F.min("item").alias("said"))
    same = reduce(lambda a, b: a & b, [F.col(f"a.{c}").eqNullSafe(F.col(f"s.{c}")) for c in _KEY])
    rows = asked.alias("a").join(sums.alias("s"), same, "left").select("a.*", "s.value", F.coalesce("s.n", F.lit(0)).alias("n"), "s.said")
    rule, value, none = F.col("rule"), F.coalesce("value", F.lit(0.0)), F.size("wanted") == 0
    failed = F.when(rule == "at_least", value < F.col("bound")).when(rule == "at_most", value > F.col("bound")).when(rule == "skip", False)
    failed = failed.when(rule.isin(LISTED + WORDED) & none, True).when(rule.isin("includes", "any_of", "mentions"), F.col("n") == 0).when(rule.isin("excludes", "lacks"), F.col("n") > 0)
    got = F.when(rule.isin(NUMERIC), value).otherwise(F.col("n").cast("double"))
    return rows.select("case_id", "rule", "subject", F.array_join("wanted", ",").alias("wanted"), "bound", got.alias("got"), "said", F.coalesce(failed, F.lit(True)).alias("failed"))


def judged(cases: DataFrame, expectations: DataFrame, answers: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """One row a case: case_id, type, status (passed, failed or skipped), reason, n_rules, n_failed and failures, an array of structs.

    `answers` has a function for each type, from all cases of that type to their facts: one plan, not one call a case. A case is
    skipped if it has no id, an id used more than once or a type without an answer, or if its answer says so. A case without
    expectations passes.
    """
    cases = cases.withColumn("case_id", F.col("case_id").cast("string"))
    known = F.coalesce(F.col("type").isin(list(answers)), F.lit(False))
    fit = cases.where(F.col("case_id").isNotNull() & known)
    answered = together(*[answer(fit.where(F.col("type") == name)) for name, answer in answers.items()])
    asked = expectations.select(F.col("case_id").cast("string"), "rule", "subject", "wanted", F.col("bound").cast("double")).where(F.coalesce(F.col("rule"), F.lit("")) != "skip")
    to_skip = fit.select("case_id", F.lit("skip"), F.lit("skip"), F.lit(None).cast("string"), F.lit(None).cast("double"))
    out = outcomes(asked.union(to_skip), answered)
    real, bad = F.col("rule").isNull() | (F.col("rule") != "skip"), F.struct("rule", "subject", "wanted", "bound", "got")
    sums = out.groupBy("case_id").agg(
        F.max(F.when(~real, F.col("said"))).alias("said"), F.count_if(real).alias("n_rules"), F.count_if(real & F.col("failed")).alias("n_failed"),
        F.array_sort(F.collect_list(F.when(real & F.col("failed"), bad))).alias("failures"),
    )
    uses = cases.groupBy("case_id").agg(F.count("*").alias("uses")).where("case_id is not null")
    unfit = F.when(F.col("case_id").isNull(), "no id").when(F.col("uses") > 1, "id used more than once").when(~known, F.concat(F.lit("unsupported case type: "), F.coalesce("type", F.lit("none"))))
    rows = cases.select("case_id", "type").join(uses, "case_id", "left").join(sums, "case_id", "left").withColumn("reason", F.coalesce(unfit, "said"))
    skipped = F.col("reason").isNotNull()
    seen = lambda c: F.when(skipped, F.lit(0)).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(c)
    status = F.when(skipped, "skipped").when(F.coalesce("n_failed", F.lit(0)) > 0, "failed").otherwise("passed")
    return rows.select("case_id", "type", status.alias("status"), "reason", seen("n_rules"), seen("n_failed"), F.when(~skipped, F.col("failures")).alias("failures"))


def failures(results: DataFrame) -> DataFrame:
    """A row for each expectation that a judged case fails."""
    return results.select("case_id", "type", F.inline("failures"))


def _ranges(cases: DataFrame) -> DataFrame:
    """(case_id, date): the days of each case's range."""
    days = F.sequence(F.try_to_date("date_from"), F.try_to_date("date_to"))
    return cases.where(F.try_to_date("date_from") <= F.try_to_date("date_to")).select("case_id", F.explode(F.transform(days, lambda d: d.cast("string"))).alias("date"))


def period_answers(cases: DataFrame, events: DataFrame, evidence: DataFrame) -> DataFrame:
    """Facts of cases (case_id, date_from, date_to): events, their greatest confidence, titles, kinds of evidence, and days by their events.

    `events` are those that may be shown. They are summed by day once; a case takes the days of its range, without a range none.
    """
    days = events.groupBy("date", "title").agg(F.count("*").alias("n"), F.max("confidence").alias("confidence"))
    kinds = evidence.join(events.select(F.col("id").alias("event_id"), "date"), "event_id").groupBy("date", "evidence_type").agg(F.count("*").alias("n"))
    fact = lambda subject, item, value: F.struct(F.lit(subject).alias("subject"), item.alias("item"), value.cast("double").alias("value"))
    none = F.lit(None).cast("string")
    by_title = days.select("date", F.inline(F.array(fact("events", none, F.col("n")), fact("confidence", none, F.col("confidence")), fact("title", F.col("title"), F.col("n")))))
    by_kind = kinds.select("date", F.inline(F.array(fact("evidence", F.col("evidence_type"), F.col("n")))))
    ranges = _ranges(cases)
    got = ranges.join(by_title.union(by_kind), "date")
    value = F.when(F.col("subject") == "confidence", F.max("value")).otherwise(F.sum("value"))
    sums = got.groupBy("case_id", "subject", "item").agg(value.alias("value"))
    busy = got.where("subject = 'events'").groupBy("case_id", "date").agg(F.sum("value").alias("value"))
    ranked = busy.withColumn("rank", F.row_number().over(Window.partitionBy("case_id").orderBy(F.desc("value"), "date")))
    return facts(sums, F.col("subject"), "item", value="value").unionByName(facts(ranked, "day", "date", "rank", "value"))


def keyword_answers(cases: DataFrame, texts: DataFrame) -> DataFrame:
    """Facts of cases (case_id, query) over texts (kind, date, text, weight): days by the weights of their hits, the best score, and kinds.

    Every different query is looked for in one pass of the texts; cases with the same query share its hits.
    """
    flat = texts.select(F.concat_ws("|", "kind", "date", "weight").alias("at"), "text")
    hits = multimatch.find_terms(flat, "at", ["text"], cases, "query").groupBy("term", "at").agg(F.count("*").alias("n"))
    hits = written(hits)
    part = F.split("at", r"\|")
    split = hits.select("term", part[0].alias("kind"), part[1].alias("date"), (part[2].cast("double") * F.col("n")).alias("score"), "n")
    days = split.groupBy("term", "date").agg(F.sum("score").alias("score"))
    ranked = days.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(F.desc("score"), "date")))
    kinds = split.groupBy("term", "kind").agg(F.sum("n").alias("n"))
    asked = cases.select("case_id", F.lower(F.trim("query")).alias("term"))
    of = lambda rows: asked.join(rows, "term")
    return together(facts(of(ranked), "day", "date", "rank", "score"), facts(of(ranked.where("rank = 1")), "score", value="score"), facts(of(kinds), "kind", "kind", value="n"))


def call_answers(cases: DataFrame, calls: DataFrame) -> DataFrame:
    """Facts of cases (case_id, date_from, date_to) over calls (date, call_status, duration_sec): calls, states, seconds and the longest."""
    by_day = calls.groupBy("date", "call_status").agg(F.count("*").alias("n"), F.sum("duration_sec").alias("seconds"), F.max("duration_sec").alias("longest"))
    ranges = _ranges(cases)
    got = ranges.join(by_day, "date").groupBy("case_id", "call_status").agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds"), F.max("longest").alias("longest"))
    whole = got.groupBy("case_id").agg(F.sum("n").alias("n"), F.sum("seconds").alias("seconds"), F.max("longest").alias("longest"))
    return together(facts(got, "call_status", "call_status", value="n"), facts(whole, "calls", value="n"), facts(whole, "seconds", value="seconds"), facts(whole, "longest", value="longest"))


def _reasons(cases: DataFrame, known: DataFrame, key: str, refused: Column, missing: str, why: str) -> tuple[DataFrame, DataFrame]:
    """Cases whose key may be answered, and skips for the others."""
    once = known.groupBy(F.col("id").alias(key)).agg(F.bool_or(F.coalesce(refused, F.lit(False))).alias("refused"))
    rows = cases.join(once, key, "left")
    reason = F.when(F.col("refused").isNull(), missing).when(F.col("refused"), why)
    rows = rows.withColumn("reason", reason)
    return rows.where("reason is null").drop("reason", "refused"), facts(rows.where("reason is not null"), "skip", "reason")


def place_answers(cases: DataFrame, places: DataFrame, event_places: DataFrame, events: DataFrame) -> DataFrame:
    """Facts of cases (case_id, place_id): events there and their days; skipped where the place is unknown, hidden or not to be searched."""
    open_, skips = _reasons(cases, places, "place_id", flag("hidden") | ~flag("searchable", 1), "no such place", "place is not searchable")
    at = event_places.select("place_id", "event_id").distinct().join(events.select(F.col("id").alias("event_id"), "date"), "event_id")
    days = at.groupBy("place_id", "date").agg(F.count("*").alias("n"))
    ranked = days.withColumn("rank", F.row_number().over(Window.partitionBy("place_id").orderBy(F.desc("n"), "date")))
    total = days.groupBy("place_id").agg(F.sum("n").alias("n"))
    return together(skips, facts(open_.join(total, "place_id"), "events", value="n"), facts(open_.join(ranked, "place_id"), "day", "date", "rank", "n"))


def person_answers(cases: DataFrame, persons: DataFrame, event_people: DataFrame, events: DataFrame) -> DataFrame:
    """Facts of cases (case_id, person_id): events with verified, visible links, and the links' sources; skipped where the person
    is unknown or withdrawn, or no link is verified."""
    links = event_people.where(~flag("is_hidden")).select("person_id", "event_id", "source", flag("is_verified").alias("sure"))
    sure = links.groupBy("person_id").agg(F.bool_or("sure").alias("sure")).where("sure").select(F.col("person_id").alias("id"), F.lit(False).alias("unsure"))
    known = persons.select("id", (flag("is_hidden") | flag("is_deleted") | ~flag("searchable", 1)).alias("withdrawn"))
    open_, withdrawn = _reasons(cases, known, "person_id", F.col("withdrawn"), "no such person", "person may not be searched")
    open_, unsure = _reasons(open_, sure, "person_id", F.col("unsure"), "no verified link", "no verified link")
    seen = links.where("sure").join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    n = seen.groupBy("person_id").agg(F.count_distinct("event_id").alias("n"))
    return together(withdrawn, unsure, facts(open_.join(n, "person_id"), "events", value="n"), facts(open_.join(seen.select("person_id", "source").distinct(), "person_id"), "source", "source"))


def image_answers(cases: DataFrame, captions: DataFrame, most: int = 20) -> DataFrame:
    """Facts of cases (case_id, query) over captions (media_id, caption, confidence) that may be shown: how many photos, and the first `most`."""
    hits = written(multimatch.find_terms(captions, "media_id", ["caption"], cases, "query").select("media_id", "term"))
    scored = hits.join(captions.select("media_id", "confidence"), "media_id")
    best = scored.withColumn("rank", F.row_number().over(Window.partitionBy("term").orderBy(F.desc_nulls_last("confidence"), "media_id"))).where(F.col("rank") <= most)
    asked = cases.select("case_id", F.lower(F.trim("query")).alias("term"))
    return together(facts(asked.join(hits.groupBy("term").agg(F.count("*").alias("n")), "term"), "photos", value="n"), facts(asked.join(best, "term"), "media", "media_id", "rank", "confidence"))


def intent_answers(cases: DataFrame, today: str, default_year: int) -> DataFrame:
    """Facts of cases (case_id, question): intent, how sure it is, route, and the person, place, topic and dish that the question names."""
    from ..functions import dates, questions

    q = F.coalesce("question", F.lit(""))
    rows = cases.select("case_id", q.alias("question")).withColumn("got", questions.classified(F.col("question"), dates.date_range(F.col("question"), F.lit(today).cast("date"), default_year)))
    named = {"person": questions.person, "place": questions.place, "topic": questions.topic, "dish": questions.dish, "call_status": questions.call_status}
    item = lambda name, of: facts(rows.withColumn("item", of).where("item is not null"), name, "item")
    return together(item("intent", F.col("got.intent")), item("route", F.col("got.route")), facts(rows.withColumn("sure", F.col("got.confidence")), "confidence", value="sure"), *[item(k, f(F.col("question"))) for k, f in named.items()])
