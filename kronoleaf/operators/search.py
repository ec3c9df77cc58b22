"""Keyword search over events, media and their texts, overlays of reviews, and review queues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import any_term

PLACE_FIELDS = ["display_name", "public_name", "category", "aliases_json"]
EVENT_FIELDS = ["title", "summary", "location_name", "title_override", "summary_override", "location_name_override", "tags_json"]
VLM_FIELDS = ["caption", "short_caption", "scene_tags_json", "activity_tags_json", "food_cues_json", "location_cues_json"]
#: Fields of a model's row that a review may replace, and the review's columns for them.
REPLACED = {"caption": "caption_override", "short_caption": "short_caption_override"} | {f"{c}_json": f"{c}_override_json" for c in ("scene_tags", "object_tags", "activity_tags", "food_cues", "location_cues")}


def flag(column: str, default: int = 0) -> Column:
    return F.coalesce(F.col(column), F.lit(default)) == 1


def truthy(column: str | Column) -> Column:
    """The text itself, or null where it is empty."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c != "", c)


def place_hits(links: DataFrame, places: DataFrame, key: str, terms: list[str]) -> DataFrame:
    """(key): those linked with a visible, searchable place that a term names."""
    named = places.where(~flag("hidden") & flag("searchable", 1) & any_term(PLACE_FIELDS, terms)).select(F.col("id").alias("place_id"))
    return links.join(named, "place_id").select(key).distinct()


def search_events(events: DataFrame, overrides: DataFrame, event_places: DataFrame, places: DataFrame, terms: list[str], with_hidden: bool = False) -> DataFrame:
    """Events that a term hits in their own or overriding fields, or through a place."""
    by_place = place_hits(event_places, places, "event_id", terms).withColumn("by_place", F.lit(True))
    rows = events.join(overrides, events.id == overrides.event_id, "left").drop("event_id").join(by_place, events.id == by_place.event_id, "left").drop("event_id")
    hit = any_term(EVENT_FIELDS, terms) | F.coalesce("by_place", F.lit(False))
    return rows.where(hit if with_hidden else hit & ~flag("is_hidden"))


def untrusted(status: str = "status", engine: str = "vlm_engine") -> Column:
    """Whether a model's row is of a failed run or of a fake engine."""
    failed = (F.coalesce(F.lower(status), F.lit("")) != "") & (F.lower(status) != "success")
    return F.coalesce(failed, F.lit(False)) | F.coalesce(F.contains(F.lower(engine), F.lit("fake")), F.lit(False))


def effective_vlm(vlm: DataFrame, overrides: DataFrame) -> DataFrame:
    """Model rows under their reviews: an override that is not empty wins in every field that has one, flags take their defaults."""
    rows = vlm.join(overrides, "media_id", "left")
    replaced = {c: o for c, o in REPLACED.items() if c in vlm.columns and o in overrides.columns}
    return (
        rows.withColumns({c: F.coalesce(truthy(o), c) for c, o in replaced.items()})
        .withColumn("review_status", F.coalesce(truthy("review_status"), F.lit("unreviewed")))
        .withColumns({c: F.coalesce(F.col(c), F.lit(d)).cast("int") for c, d in (("is_verified", 0), ("is_hidden", 0), ("is_wrong", 0), ("is_searchable", 1), ("is_event_usable", 1))})
        .drop(*REPLACED.values())
    )


def usable(purpose: str) -> Column:
    """Whether an effective row may be used for `search` or for `events`."""
    allowed = flag("is_searchable" if purpose == "search" else "is_event_usable", 1)
    return ~untrusted() & ~flag("is_hidden") & ~flag("is_wrong") & allowed & ~F.col("review_status").isin("rejected", "wrong")


def search_vlm(vlm: DataFrame, overrides: DataFrame, terms: list[str]) -> DataFrame:
    return effective_vlm(vlm, overrides).where(usable("search") & any_term(VLM_FIELDS, terms))


def vlm_candidates(vlm: DataFrame, overrides: DataFrame, ocr: DataFrame, media: DataFrame, terms: list[str], date_from: str | None = None, date_to: str | None = None, with_hidden: bool = False) -> DataFrame:
    """(media_id, date) of trusted model rows that hold a term in any of ten fields: the replaceable ones, text cues, recognised
    text and file name.

    Here any override that is there, even an empty one, stands in front of the model's own text. Recognised texts are searched where
    they are, and only their hits are joined.
    """
    when = F.substring(F.coalesce("captured_at", "fallback_captured_at"), 1, 10)
    own = media.select(F.col("id").alias("media_id"), when.alias("date"), any_term(["file_name"], terms).alias("by_name"))
    tests = [F.col("date") >= date_from] if date_from else []
    tests += [F.col("date") <= date_to] if date_to else []
    dated = reduce(DataFrame.where, tests, own)
    read = ocr.where(any_term(["ocr_text"], terms)).select("media_id", F.lit(True).alias("by_ocr")).distinct()
    rows = vlm.where((F.col("status") == "success") & ~untrusted()).join(overrides, "media_id", "left")
    rows = rows.select("media_id", *[F.col(c) for c in ("is_hidden", "is_wrong", "is_searchable", "review_status")], *[F.coalesce(o, c).alias(c) for c, o in REPLACED.items()], "text_cues_json")
    if not with_hidden:
        state = F.coalesce("review_status", F.lit("unreviewed"))
        rows = rows.where(~flag("is_hidden") & ~flag("is_wrong") & flag("is_searchable", 1) & ~state.isin("rejected", "wrong"))
    marked = rows.select("media_id", any_term([*REPLACED, "text_cues_json"], terms).alias("by_text")).join(dated, "media_id").join(read, "media_id", "left")
    return marked.where(F.col("by_text") | F.col("by_name") | F.coalesce("by_ocr", F.lit(False))).select("media_id", "date")


def search_ocr(ocr: DataFrame, terms: list[str]) -> DataFrame:
    return ocr.where((F.col("status") == "success") & any_term(["ocr_text", "ocr_text_redacted"], terms))


def search_media(media: DataFrame, ocr: DataFrame, vlm: DataFrame, media_places: DataFrame, places: DataFrame, terms: list[str]) -> DataFrame:
    """Media by file name, recognised text, trusted caption or place; one pass of each side table before the joins."""
    texts = ocr.where(any_term(["ocr_text"], terms)).select(F.col("media_id").alias("id"), F.lit(True).alias("by_ocr"))
    captions = vlm.where(~untrusted() & any_term(["caption"], terms)).select(F.col("media_id").alias("id"), F.lit(True).alias("by_caption"))
    placed = place_hits(media_places, places, "media_id", terms).select(F.col("media_id").alias("id"), F.lit(True).alias("by_place"))
    rows = reduce(lambda a, b: a.join(b, "id", "left"), (texts, captions, placed), media)
    found = reduce(lambda a, b: a | b, [F.coalesce(c, F.lit(False)) for c in ("by_ocr", "by_caption", "by_place")])
    return rows.where(any_term(["file_name"], terms) | found)


def search_all(parts: dict[str, tuple[DataFrame, str, Column]]) -> DataFrame:
    """(kind, id, date) over all kinds of rows, from each kind's hits, id column and date."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), F.col(i).alias("id"), date.alias("date")) for kind, (df, i, date) in parts.items()])


def name_guard(file_name: str, literal: str) -> Column:
    """A file name counts for the literal query only, never for expanded terms."""
    return F.coalesce(F.contains(F.lower(file_name), F.lit(literal.strip().lower())), F.lit(False)) & F.lit(bool(literal.strip()))


def overlaid_events(events: DataFrame, overrides: DataFrame) -> DataFrame:
    """Effective title, summary and location, with the originals kept beside them and flags as 0 or 1."""
    rows = events.join(overrides, events.id == overrides.event_id, "left").drop("event_id")
    for c in ("title", "summary", "location_name"):
        rows = rows.withColumn(f"original_{c}", F.col(c)).withColumn(c, F.coalesce(truthy(f"{c}_override"), c))
    return rows.withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("int") for c in ("is_verified", "is_hidden", "is_pinned")})


def tri_state(column: str, wanted: str) -> Column:
    """only, exclude or all rows with a flag set."""
    return {"only": flag(column), "exclude": ~flag(column)}.get(wanted, F.lit(True))


def event_queue(rows: DataFrame, *, date_from=None, date_to=None, confidence_lte=None, title_contains=None, location_contains=None, modality=None, verified="all", hidden="exclude", pinned="all", evidence_min=None, evidence_max=None) -> DataFrame:
    """The review queue's filters over overlaid events with counts; in order of pinned, date, time and id."""
    c = F.col
    tests = [
        (date_from, lambda v: c("date") >= v), (date_to, lambda v: c("date") <= v), (confidence_lte, lambda v: c("confidence") <= v),
        (title_contains, lambda v: F.contains(c("title"), F.lit(v))), (location_contains, lambda v: F.contains(F.coalesce("location_name", F.lit("")), F.lit(v))),
        (modality, lambda v: c("modality") == v), (evidence_min, lambda v: c("n_evidence") >= v), (evidence_max, lambda v: c("n_evidence") <= v),
    ]
    keep = [test(v) for v, test in tests if v is not None] + [tri_state("is_verified", verified), tri_state("is_hidden", hidden), tri_state("is_pinned", pinned)]
    return rows.where(reduce(lambda a, b: a & b, keep)).orderBy(F.desc("is_pinned"), "date", "start_time", "id")


def vlm_queue(
    rows: DataFrame, *, review_status=None, unreviewed=False, safety_flags=False, people_present=False, low_confidence=None, food_cues=False, location_cues=False, hidden=None, wrong=None,
    is_searchable=None, is_event_usable=None, date_from=None, date_to=None, dates: DataFrame | None = None, has_ocr: DataFrame | None = None, without_ocr: DataFrame | None = None,
    has_embedding: DataFrame | None = None, with_event: DataFrame | None = None, without_event: DataFrame | None = None,
) -> DataFrame:
    """The model review queue's filters over effective rows.

    The tables given are semi and anti joins on media_id; a row of the model alone is one without_ocr and without_event. `dates`
    (media_id, date) is asked for with date_from or date_to, between which a row's date must lie.
    """
    filled = lambda c: F.coalesce(F.size(F.from_json(c, "array<string>")), F.lit(0)) > 0
    keep = [F.lit(True)]
    keep += [F.col("review_status") == review_status] if review_status else []
    keep += [F.col("review_status") == "unreviewed"] if unreviewed else []
    keep += [filled(f"{c}_json") for c, on in (("safety_flags", safety_flags), ("food_cues", food_cues), ("location_cues", location_cues)) if on]
    keep += [F.col("people_count") > 0] if people_present else []
    keep += [F.col("confidence") <= low_confidence] if low_confidence is not None else []
    keep += [flag(c) == F.lit(wanted) for c, wanted in (("is_hidden", hidden), ("is_wrong", wrong)) if wanted is not None]
    keep += [flag(c, 1) == F.lit(wanted) for c, wanted in (("is_searchable", is_searchable), ("is_event_usable", is_event_usable)) if wanted is not None]
    out = rows.where(reduce(lambda a, b: a & b, keep))
    within = None
    if date_from or date_to:
        if dates is None:
            raise ValueError("date_from and date_to need dates")
        within = dates.where((F.col("date") >= date_from if date_from else F.lit(True)) & (F.col("date") <= date_to if date_to else F.lit(True)))
    for other, how in ((within, "left_semi"), (has_ocr, "left_semi"), (without_ocr, "left_anti"), (has_embedding, "left_semi"), (with_event, "left_semi"), (without_event, "left_anti")):
        out = out if other is None else out.join(other.select("media_id").distinct(), "media_id", how)
    return out


#: Words that are no search terms, particles, and endings of question verbs.
STOP_WORDS = ["いつ", "どこ", "だれ", "誰", "何", "なに", "行った", "行く", "した", "していた", "してた", "まとめて"]
QUESTION_MARKS, QUESTION_WORDS, PARTICLES = "[?？。!！]", "(のはいつ|はいつ|いつ|ですか|でしたか)", r"[\s,、/]+|[でにをはがと]"
VERB_ENDINGS = "(した日は|した日|したのは|したの|した|する日は|する日|するのは|するの|する|日は|日)$"


def search_terms(query: Column) -> Column:
    """The search terms of a question, in order; the whole question only where nothing else is left."""
    blanks = F.lit(" 　")
    clean = lambda v: F.btrim(F.regexp_replace(F.btrim(F.regexp_replace(v, QUESTION_MARKS, ""), blanks), VERB_ENDINGS, ""), blanks)
    text = F.trim(query)
    parts = F.split(F.regexp_replace(F.regexp_replace(text, QUESTION_MARKS, " "), QUESTION_WORDS, " "), PARTICLES, -1)
    terms = F.array_distinct(F.filter(F.transform(F.concat(F.array(text), parts), clean), lambda v: (v != "") & ~v.isin(STOP_WORDS)))
    first = F.try_element_at(terms, F.lit(1))
    rest = F.when((F.size(terms) > 1) & ((first == text) | (first == clean(text))), F.slice(terms, F.lit(2), F.size(terms))).otherwise(terms)
    return F.when(text == "", F.array().cast("array<string>")).when(F.size(rest) == 0, F.array(text)).otherwise(rest)


#: What is taken out of a timeline question before its keyword is looked for.
DATE_NOISE = r"\d{4}年\d{1,2}月\d{1,2}日|\d{4}[-/]\d{1,2}[-/]\d{1,2}|今日|昨日|去年の夏|去年"
PHRASE_NOISE = "何していた|何してた|いつ|行ったのは|まとめて|この日に|撮った写真|LINEの会話"
KEYWORD_FRAMES = ["(.+?)を食べた", "(.+?)に行った", "(.+?)さんと"]


def keyword(question: Column) -> Column:
    """The keyword of a timeline question, or null."""
    edge = F.lit(" ?？。　")
    bare = lambda v: F.btrim(F.regexp_replace(F.regexp_replace(F.btrim(v, edge), "^[はにでをのが]+", ""), "[はにでをのが]+$", ""), edge)
    cleaned = F.regexp_replace(F.trim(question), DATE_NOISE, " ")
    rest = bare(F.regexp_replace(cleaned, PHRASE_NOISE, " "))
    out = F.when(~rest.isin("は", "に", "で", "を", "の", "日"), rest)
    for frame in reversed(KEYWORD_FRAMES):
        out = F.when(F.rlike(cleaned, F.lit(frame)), bare(F.regexp_extract(cleaned, frame, 1))).otherwise(out)
    return truthy(out)


def expanded_terms(queries: DataFrame, query: str, triggers: DataFrame) -> DataFrame:
    """Each query with its own text and the synonyms of every trigger that it holds, in order and without repeats.

    `triggers` is (trigger, place, terms); the join is on containment, so it is
    meant for a dictionary, which is broadcast by Spark as far as it is small.
    """
    hit = queries.join(triggers, F.contains(F.col(query), F.col("trigger")), "left")
    in_order = F.array_sort(F.collect_list(F.when(F.col("trigger").isNotNull(), F.struct("place", "terms"))))
    return hit.groupBy(query).agg(in_order.alias("found")).select(query, F.array_distinct(F.concat(F.array(F.trim(query)), F.flatten(F.transform("found", lambda x: x.terms)))).alias("terms"))


def first_entry(query: Column, entries: list[tuple[str, list[str]]]) -> Column:
    """The first entry of a taxonomy one of whose triggers the query holds."""
    out = F.lit(None).cast("string")
    for name, triggers in reversed(entries):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(F.lower(query), F.lit(t.lower())) for t in triggers]), name).otherwise(out)
    return out
