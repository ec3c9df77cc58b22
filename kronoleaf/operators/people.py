"""Links between media, events, chats and people, and what is asked of them."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..checkpoints import written
from .multimatch import find_terms
from .search import flag, truthy

#: Confidence of links by their origin.
LINK_CONFIDENCE = {"media_face": 0.85, "event_face": 0.60, "event_chat": 0.70, "combined": 0.90, "media_place": 0.80, "event_place": 0.75}


def visible(prefix: str = "") -> Column:
    """People that may be shown: neither hidden nor deleted, and searchable."""
    return ~flag(f"{prefix}is_hidden") & ~flag(f"{prefix}is_deleted") & flag(f"{prefix}searchable", 1)


def enriched_media(media: DataFrame, ocr: DataFrame, vlm: DataFrame) -> DataFrame:
    """Each medium with its recognised text and effective model row; `vlm` is `search.effective_vlm`."""
    o = ocr.select("media_id", F.col("ocr_text"), F.col("status").alias("ocr_status"))
    v = vlm.withColumnRenamed("status", "vlm_status")
    m = media.withColumn("media_id", F.col("id"))
    return m.join(o, "media_id", "left").join(v, "media_id", "left").withColumn("date", F.substring(F.coalesce("captured_at", "fallback_captured_at"), 1, 10))


def faces_to_people(person_clusters: DataFrame, clusters: DataFrame, members: DataFrame, faces: DataFrame, persons: DataFrame) -> DataFrame:
    """(media_id, person_id, face_id, cluster_id) through reviewed clusters, each once."""
    good_clusters = clusters.where("status = 'reviewed'").select(F.col("id").alias("cluster_id"))
    good_faces = faces.where("status = 'success' and review_status <> 'rejected'").select(F.col("id").alias("face_id"), "media_id")
    known = persons.where(~flag("is_deleted")).select(F.col("id").alias("person_id"))
    links = person_clusters.where(flag("is_verified")).join(good_clusters, "cluster_id").join(known, "person_id")
    return links.join(members.select("cluster_id", "face_id"), "cluster_id").join(good_faces, "face_id").select("media_id", "person_id", "face_id", "cluster_id").distinct()


def _packed(links: DataFrame, *columns: str) -> DataFrame:
    """(media_id, who): what `links` give each medium, as lists of at most about a thousand structs of `columns`."""
    piece = F.pmod(F.xxhash64(*columns), F.ceil(F.count("*").over(Window.partitionBy("media_id")) / 1000))
    return links.where("media_id is not null").withColumn("piece", piece).groupBy("media_id", "piece").agg(F.collect_list(F.struct(*columns)).alias("who")).select("media_id", "who")


#: Rows of evidence in one partition of `_carried`, so that a task's distinct pairs do not grow with the input.
CARRIED_ROWS = 500_000


def _carried(evidence: DataFrame, links: DataFrame, column: str, more: DataFrame | None = None) -> DataFrame:
    """(event_id, `column`), each once: what `links` (media_id, `column`), each once, give to events through evidence, and the pairs `more`.

    A medium's links travel to its events in one row, and are opened and told apart where the event is.
    """
    rows = evidence.select("event_id", F.col("evidence_id").alias("media_id")).join(_packed(links, column), "media_id").select("event_id", "who")
    if more is not None:
        rows = rows.union(more.select("event_id", F.array(F.struct(column))))
    parts = max(int(evidence.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-evidence.count() // CARRIED_ROWS))
    return rows.repartition(parts, "event_id").select("event_id", F.inline("who")).distinct()


#: Rows of evidence in one partition of `_seen`; as many photos are opened there as it has people a medium.
SEEN_ROWS = 150_000
#: People that are broadcast to keep their links.
FEW = 500_000


def _known(links: DataFrame, persons: DataFrame) -> DataFrame:
    """The links whose person exists; where few people have links, these are looked up once and no link is exchanged for it."""
    real = persons.select(F.col("id").alias("person_id"))
    linked = written(links.select("person_id").distinct().join(real, "person_id", "left_semi"))
    return links.join(F.broadcast(linked) if linked.count() <= FEW else real, "person_id", "left_semi")


def _face_lists(links: DataFrame, parts: int) -> DataFrame:
    """(media_id, first, who, what): the people of each medium and their faces as JSON lists of at most about a thousand, which travel in a
    fraction of the bytes that rows or structs take. `first` is 1 for a list that names each person once, 0 for their further faces."""
    once = links.where("media_id is not null").repartition(parts, "media_id").distinct()
    first = (F.row_number().over(Window.partitionBy("media_id", "person_id").orderBy("face_id")) == 1).cast("int")
    piece = F.pmod(F.xxhash64("person_id", "face_id"), F.ceil(F.count("*").over(Window.partitionBy("media_id")) / 1000))
    rows = once.select("*", first.alias("first"), piece.alias("piece")).groupBy("media_id", "piece", "first").agg(F.array_sort(F.collect_list(F.struct("person_id", "face_id"))).alias("who"))
    return rows.select("media_id", "first", F.to_json("who.person_id").alias("who"), F.to_json("who.face_id").alias("what"))


def _seen(evidence: DataFrame, events: DataFrame, media_people: DataFrame, persons: DataFrame, said: DataFrame | None = None) -> DataFrame:
    """(event_id, person_id, media_count, face_count, line_count) over photo evidence of verified people, and lines `said` (event_id, person_id, id).

    `media_people` may have rows that repeat. Everything is dealt by event once, a medium's people in one list, and opened and counted there by
    two groupings that follow from that dealing: no row a person and event is ever exchanged or sorted.
    """
    parts = max(int(evidence.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-evidence.count() // SEEN_ROWS))
    ours = media_people.where(flag("is_verified") & F.col("source").isin("face_cluster", "manual")).select("media_id", "person_id", "face_id")
    photos = evidence.where("evidence_type = 'photo'").select("event_id", F.col("evidence_id").alias("media_id")).repartition(parts, "media_id").distinct()
    sent = photos.join(_face_lists(_known(ours, persons), parts), "media_id").select("event_id", "first", "who", "what")
    if said is not None:
        sent = sent.union(said.select("event_id", F.lit(None).cast("int"), F.to_json(F.array("person_id")), F.to_json(F.array("id"))))
    # An inner join with each event once, since a semi-join would be moved before the dealing and deal evidence once more.
    real = events.select(F.col("id").alias("event_id")).repartition(parts, "event_id").distinct().hint("shuffle_hash")
    lists = sent.repartition(parts, "event_id").join(real, "event_id").select("event_id", F.col("first").isNull().alias("line"), F.coalesce("first", F.lit(0)).alias("first"), *[F.from_json(c, "array<string>").alias(n) for c, n in (("who", "person_id"), ("what", "item"))])
    opened = lists.select("event_id", "line", "first", F.inline(F.arrays_zip("person_id", "item")))
    # A medium names a person in one list of first faces, so these lists are counted; faces and lines are told apart before they are.
    told = opened.groupBy("event_id", "person_id", "line", "item").agg(F.sum("first").alias("n"))
    return told.groupBy("event_id", "person_id").agg(F.sum("n").alias("media_count"), F.count(F.when(~F.col("line"), F.col("item"))).alias("face_count"), F.count(F.when(F.col("line"), F.col("item"))).alias("line_count"))


def events_by_faces(evidence: DataFrame, events: DataFrame, media_people: DataFrame, persons: DataFrame) -> DataFrame:
    """(event_id, person_id, media_count, face_count) over photo evidence of verified people."""
    return _seen(evidence, events, media_people, persons).drop("line_count")


def _said(evidence: DataFrame, messages: DataFrame, speakers: DataFrame, persons: DataFrame) -> DataFrame:
    """(event_id, person_id, id) of chat evidence, speakers found by chat and name together; rows may repeat."""
    known = speakers.where(flag("is_verified")).select("chat_id", F.col("speaker_name").alias("sender"), "person_id").join(persons.select(F.col("id").alias("person_id")), "person_id", "left_semi")
    lines = evidence.where("evidence_type = 'line'").select("event_id", F.col("evidence_id").alias("id"))
    return lines.join(messages.select("id", "chat_id", "sender").join(known, ["chat_id", "sender"]).select("id", "person_id"), "id").select("event_id", "person_id", "id")


def events_by_chat(evidence: DataFrame, events: DataFrame, messages: DataFrame, speakers: DataFrame, persons: DataFrame) -> DataFrame:
    """(event_id, person_id, line_count) over chat evidence, speakers found by chat and name together."""
    real = _said(evidence, messages, speakers, persons).join(events.select(F.col("id").alias("event_id")), "event_id", "left_semi")
    return real.groupBy("event_id", "person_id").agg(F.count_distinct("id").alias("line_count"))


def event_people(evidence: DataFrame, events: DataFrame, media_people: DataFrame, messages: DataFrame, speakers: DataFrame, persons: DataFrame) -> DataFrame:
    """All links of events and people: by faces, by chat, and combined where both hold, from one count of both."""
    c = LINK_CONFIDENCE
    rows = _seen(evidence, events, media_people, persons, _said(evidence, messages, speakers, persons))
    face, media, line = map(F.col, ("face_count", "media_count", "line_count"))
    kinds = {"face_cluster": ("event_face", face, media, F.lit(0)), "line_speaker": ("event_chat", line, F.lit(0), line), "combined": ("combined", face + line, media, line)}
    held = F.when((media > 0) & (line > 0), F.array(*map(F.lit, kinds))).when(media > 0, F.array(F.lit("face_cluster"))).when(line > 0, F.array(F.lit("line_speaker")))

    def of_kind(values: list[Column]) -> Column:
        return reduce(lambda rest, kind: F.when(F.col("source") == kind[0], kind[1]).otherwise(rest), zip(list(kinds)[1:], values[1:], strict=True), values[0])

    confidence, *counts = (of_kind(list(v)) for v in zip(*((F.lit(c[n]), *own) for n, *own in kinds.values()), strict=True))
    return rows.select("event_id", "person_id", F.explode(held).alias("source"), "media_count", "face_count", "line_count").select("event_id", "person_id", "source", confidence.alias("confidence"), *[n.cast("long").alias(k) for k, n in zip(("evidence_count", "media_count", "line_count"), counts, strict=True)])


def new_links(candidates: DataFrame, existing: DataFrame, keys: list[str], replace: Column | None = None) -> DataFrame:
    """The table after a build: candidates whose key is new; with `replace`, existing rows of that condition go first."""
    kept = existing if replace is None else existing.where(~F.coalesce(replace, F.lit(False)))
    return kept.unionByName(candidates.dropDuplicates(keys).join(kept.select(*keys), keys, "left_anti").select(*kept.columns))


def related_people(links: DataFrame, persons: DataFrame) -> DataFrame:
    """(event_id, people): visible people of each event, most confident first, then by name."""
    who = persons.where(visible()).select(F.col("id").alias("person_id"), "display_name")
    rows = links.where(~flag("is_hidden")).join(who, "person_id")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("order"), "display_name", "person_id", "source")))
    return rows.groupBy("event_id").agg(F.transform(listed, lambda p: p.display_name).alias("people"))


def names_of(persons: DataFrame, aliases: DataFrame, speakers: DataFrame) -> DataFrame:
    """(name, person_id, source): every exact name of every person that may be shown."""
    p = persons.where(visible())
    own = p.select("id", F.inline(F.array(F.struct(F.col("display_name").alias("name"), F.lit("display_name").alias("source")), F.struct(F.col("public_name").alias("name"), F.lit("public_name").alias("source")))))
    listed = p.select("id", F.explode(F.from_json("aliases_json", "array<string>")).alias("name"), F.lit("aliases_json").alias("source"))
    ids = p.select("id")
    tabled = aliases.select(F.col("person_id").alias("id"), F.col("alias").alias("name"), F.lit("alias").alias("source")).join(ids, "id", "left_semi")
    spoken = speakers.where(flag("is_verified")).select(F.col("person_id").alias("id"), F.col("speaker_name").alias("name"), F.lit("speaker").alias("source")).join(ids, "id", "left_semi")
    rows = own.select("id", "name", "source").unionByName(listed).unionByName(tabled).unionByName(spoken)
    return rows.where("name <> ''").select(F.lower(F.trim("name")).alias("name"), F.col("id").alias("person_id"), "source").distinct()


def place_names(places: DataFrame) -> DataFrame:
    """(name, place_id, source): names, public names, categories and aliases of places that may be shown."""
    p = places.where(~flag("hidden") & flag("searchable", 1))
    own = p.select("id", F.inline(F.array(*[F.struct(F.col(c).alias("name"), F.lit(c).alias("source")) for c in ("display_name", "public_name", "category")])))
    listed = p.select("id", F.explode(F.from_json("aliases_json", "array<string>")).alias("name"), F.lit("aliases_json").alias("source"))
    return own.select("id", "name", "source").unionByName(listed).where("name <> ''").select(F.lower(F.trim("name")).alias("name"), F.col("id").alias("place_id"), "source").distinct()


def resolve_names(terms: DataFrame, term: str, names: DataFrame, key: str) -> DataFrame:
    """(term, status, n, least id, sources): none, resolved or ambiguous by exact names."""
    hit = terms.select(term, F.lower(F.trim(term)).alias("name")).join(names, "name", "left")
    got = hit.groupBy(term).agg(F.count_distinct(key).alias("n"), F.min(key).alias(key), F.concat_ws(",", F.array_sort(F.collect_set("source"))).alias("sources"))
    return got.withColumn("status", F.when(F.col("n") == 0, "none").when(F.col("n") == 1, "resolved").otherwise("ambiguous"))


def first_mention(queries: DataFrame, query: str, terms: Column, names: DataFrame) -> DataFrame:
    """The person of each query's first term that names exactly one person."""
    rows = queries.select(query, F.posexplode(terms).alias("place", "term"))
    found = resolve_names(rows.select("term").distinct(), "term", names, "person_id").where("status = 'resolved'")
    hit = rows.join(found, "term").groupBy(query).agg(F.min(F.struct("place", "term", "person_id")).alias("m"))
    return queries.select(query).distinct().join(hit, query, "left").select(query, "m.term", "m.person_id")


def chat_days(links: DataFrame, persons: DataFrame, messages: DataFrame, calls: DataFrame) -> DataFrame:
    """Days of each visible person: messages, chats, speakers, calls and their seconds, from either source."""
    who = links.where(flag("is_verified")).join(persons.where(visible()).select(F.col("id").alias("person_id")), "person_id", "left_semi").select("person_id", "chat_id", F.col("speaker_name").alias("sender"))
    said = who.join(messages, ["chat_id", "sender"]).groupBy("person_id", F.substring("sent_at", 1, 10).alias("date")).agg(
        F.count("*").alias("message_count"), F.min("sent_at").alias("first_seen_at"), F.max("sent_at").alias("last_seen_at"), F.count_distinct("chat_id").alias("chat_count"), F.count_distinct("sender").alias("speaker_count"))
    called = who.join(calls, ["chat_id", "sender"]).groupBy("person_id", F.substring("sent_at", 1, 10).alias("date")).agg(
        F.count("*").alias("call_count"), F.count_if(F.col("call_status") == "completed").alias("completed_count"), F.coalesce(F.sum("duration_sec"), F.lit(0)).cast("long").alias("call_seconds"))
    return said.join(called, ["person_id", "date"], "full").fillna(0, ["message_count", "chat_count", "speaker_count", "call_count", "completed_count", "call_seconds"])


def top_days(days: DataFrame, most: int) -> DataFrame:
    """Each person's top days, with the order of the two steps kept: `most` days by messages (later days first on ties), then
    days of calls alone join, and of all of them those of most messages and calls, earlier days first on ties."""
    w = Window.partitionBy("person_id")
    by_message = F.row_number().over(w.orderBy(F.desc("message_count"), F.desc("date")))
    chosen = days.withColumn("r", by_message).where((F.col("r") <= most) | (F.col("message_count") == 0))
    rank = F.row_number().over(w.orderBy(F.desc(F.col("message_count") + F.col("call_count")), "date"))
    return chosen.withColumn("rank", rank).where(F.col("rank") <= most).drop("r")


def person_photos(media_people: DataFrame, media: DataFrame, persons: DataFrame) -> DataFrame:
    """(person_id, media_id, date): photos with visible people, each once."""
    who = persons.where(visible()).select(F.col("id").alias("person_id"))
    m = media.select(F.col("id").alias("media_id"), F.substring(F.coalesce("captured_at", "fallback_captured_at"), 1, 10).alias("date"))
    return media_people.where(~flag("is_hidden")).join(who, "person_id", "left_semi").join(m, "media_id").select("person_id", "media_id", "date").distinct()


def person_events(links: DataFrame, persons: DataFrame, events: DataFrame, at_places: DataFrame | None = None, activity: Column | None = None) -> DataFrame:
    """Events of visible people; only those at `at_places` (event_id) and of an activity where given. `events` are overlaid."""
    who = persons.where(visible()).select(F.col("id").alias("person_id"))
    e = events.where(~flag("is_hidden") if activity is None else ~flag("is_hidden") & activity)
    rows = links.where(~flag("is_hidden")).select("event_id", "person_id", F.col("source").alias("link_source"), F.col("confidence").alias("link_confidence")).join(who, "person_id", "left_semi").join(e.withColumnRenamed("id", "event_id"), "event_id")
    return rows if at_places is None else rows.join(at_places.select("event_id").distinct(), "event_id", "left_semi")


def place_events(links: DataFrame, places: DataFrame, events: DataFrame) -> DataFrame:
    shown = places.where(~flag("hidden") & flag("searchable", 1)).select(F.col("id").alias("place_id"), "display_name")
    return links.select("event_id", "place_id").join(shown, "place_id").join(events.where(~flag("is_hidden")).withColumnRenamed("id", "event_id"), "event_id")


def place_photos(links: DataFrame, places: DataFrame, media: DataFrame) -> DataFrame:
    shown = places.where(~flag("hidden") & flag("searchable", 1)).select(F.col("id").alias("place_id"))
    m = media.select(F.col("id").alias("media_id"), F.coalesce("captured_at", "fallback_captured_at").alias("captured_at"))
    return links.join(shown, "place_id", "left_semi").join(m, "media_id").select("place_id", "media_id", "captured_at")


def speaker_listing(messages: DataFrame, links: DataFrame, persons: DataFrame) -> DataFrame:
    """Speakers of each chat with their people. Messages are counted before links are joined,
    so a speaker with several links is not counted several times."""
    said = messages.where(F.trim("sender") != "").groupBy("chat_id", "sender").agg(F.count("*").alias("message_count"), F.min("sent_at").alias("first_seen_at"), F.max("sent_at").alias("last_seen_at"))
    who = links.select("chat_id", F.col("speaker_name").alias("sender"), "person_id").join(persons.select(F.col("id").alias("person_id"), "display_name"), "person_id")
    named = who.groupBy("chat_id", "sender").agg(F.concat_ws(",", F.array_sort(F.collect_set("person_id"))).alias("person_ids"), F.concat_ws(",", F.array_sort(F.collect_set("display_name"))).alias("names"))
    return said.join(named, ["chat_id", "sender"], "left").fillna("", ["person_ids", "names"])


#: People whose hits one task of `ranked_suggestions` puts in order.
SUGGESTED_PEOPLE = 50_000


def ranked_suggestions(speakers: DataFrame, persons: DataFrame, aliases: DataFrame, created: str, most: int = 10) -> DataFrame:
    """(speaker_name, person_id, reason, rank): as `suggestions`, and people whose display name holds the speaker's text in either case; the
    first `most` of each speaker in order of creation. All speakers are looked for in one pass over the names."""
    parts = max(int(persons.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-persons.count() // SUGGESTED_PEOPLE))
    asked = speakers.select(F.trim("speaker_name").alias("speaker_name")).where("speaker_name <> ''").repartition(parts, "speaker_name").distinct()
    # A short text is held by very many names: their first people are found in parts of a bounded number of rows, and meet by the text only then.
    people = persons.select(F.struct(F.col("id").alias("person_id"), F.col(created).alias("created")).alias("person"), "display_name")
    held = find_terms(people, "person", ["display_name"], asked, "speaker_name").select("term", "person.*")
    early = F.dense_rank().over(Window.partitionBy("term").orderBy("created", "person_id"))
    first = held.repartition(parts, "person_id").withColumn("early", early).where(F.col("early") <= most).select("term", "person_id")
    inside = asked.withColumn("term", F.lower("speaker_name")).join(first, "term").select("speaker_name", "person_id", F.lit("name contains speaker text").alias("reason"))
    reasons = F.array(*map(F.lit, ("display_name exact match", "public_name exact match", "person alias exact match", "name contains speaker text")))
    least = F.min(F.array_position(reasons, F.col("reason"))).cast("int")
    best = suggestions(asked, persons, aliases).unionByName(inside).groupBy("speaker_name", "person_id").agg(least.alias("n")).select("speaker_name", "person_id", F.element_at(reasons, F.col("n")).alias("reason"))
    order = Window.partitionBy("speaker_name").orderBy(created, "person_id")
    rows = best.join(persons.select(F.col("id").alias("person_id"), created), "person_id").withColumn("rank", F.row_number().over(order))
    return rows.where(F.col("rank") <= most).select("speaker_name", "person_id", "reason", "rank")


def suggestions(speakers: DataFrame, persons: DataFrame, aliases: DataFrame) -> DataFrame:
    """(speaker_name, person_id, reason): people whose display name, public name or alias is the speaker's, by that priority."""
    p = persons.select(F.col("id").alias("person_id"), "display_name", "public_name")
    named = lambda rows, c, n: rows.select("person_id", F.col(c).alias("name"), F.lit(n).alias("priority"))
    names = named(p, "display_name", 1).union(named(p, "public_name", 2)).union(named(aliases, "alias", 3))
    best = speakers.join(names, F.col("speaker_name") == F.col("name")).groupBy("speaker_name", "person_id").agg(F.min("priority").alias("priority"))
    reason = F.element_at(F.array(*map(F.lit, ("display_name exact match", "public_name exact match", "person alias exact match"))), F.col("priority"))
    return best.select("speaker_name", "person_id", reason.alias("reason"))


def earliest_person(terms: DataFrame, term: str, persons: DataFrame, aliases: DataFrame) -> DataFrame:
    """The person made first of those that bear a name or alias exactly."""
    p = persons.select("id", "display_name", "public_name", "created_order")
    names = p.select("id", "created_order", F.explode(F.array("display_name", "public_name")).alias("name")).union(p.join(aliases, p.id == aliases.person_id).select("id", "created_order", F.col("alias")))
    hit = terms.join(names, F.trim(term) == F.col("name"))
    return hit.groupBy(term).agg(F.min_by("id", F.struct("created_order", "id")).alias("person_id"))


def persons_of(links: DataFrame, persons: DataFrame, key: str) -> DataFrame:
    """(key, person_id, display_name), each once, of links that are not hidden."""
    return links.where(~flag("is_hidden")).select(key, "person_id").distinct().join(persons.where(~flag("is_deleted")).select(F.col("id").alias("person_id"), "display_name"), "person_id")


def link_counts(persons: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """People with the number of their rows in each table; counted before the joins."""
    out = persons.select("id", "display_name", "privacy_level")
    for name, df in tables.items():
        out = out.join(df.groupBy(F.col("person_id").alias("id")).agg(F.count("*").alias(name)), "id", "left")
    return out.fillna(0, list(tables))


def propagated_places(media_points: DataFrame, evidence: DataFrame, places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links of media and of events with places: a point's cluster names the place, evidence carries it to events."""
    own = places.select(F.col("id").alias("place_id"), "cluster_id")
    media = media_points.join(own, "cluster_id").select("media_id", "place_id").distinct()
    events = _carried(evidence.where(F.col("evidence_type").isin("photo", "ocr", "vlm")), media, "place_id")
    return media.withColumn("confidence", F.lit(LINK_CONFIDENCE["media_place"])), events.withColumn("confidence", F.lit(LINK_CONFIDENCE["event_place"]))


def may_take_location(events: DataFrame, overrides: DataFrame) -> DataFrame:
    """Events whose location may be set by a rule: neither edited nor overridden by a person."""
    fixed = overrides.where(F.trim("location_name_override") != "").select(F.col("event_id").alias("id"))
    return events.where(~flag("is_user_edited")).join(fixed, "id", "left_anti")


def first_event(evidence: DataFrame, events: DataFrame) -> DataFrame:
    """(evidence_id, event_id): each medium's first event, pinned ones first, then by date and time. `events` are overlaid.

    Repeated evidence changes no least event, so it is not made distinct before."""
    rows = evidence.select("event_id", "evidence_id").join(events.where(~flag("is_hidden")).select(F.col("id").alias("event_id"), "is_pinned", "date", "start_time"), "event_id")
    return rows.groupBy("evidence_id").agg(F.min_by("event_id", F.struct((-F.col("is_pinned")).alias("p"), "date", "start_time", "event_id")).alias("event_id"))


def day_context(media: DataFrame, messages: DataFrame, test: Column, most: int = 5) -> DataFrame:
    """(media_id, texts): the first messages of a medium's day that pass a test. Each day's messages are cut to
    `most` before they meet the media, so a busy day is not multiplied."""
    w = Window.partitionBy("date").orderBy("sent_at", "id")
    few = messages.where(test).withColumn("date", F.substring("sent_at", 1, 10)).withColumn("r", F.row_number().over(w)).where(F.col("r") <= most)
    by_day = few.groupBy("date").agg(F.array_sort(F.collect_list(F.struct("r", "text"))).alias("rows")).select("date", F.transform("rows", lambda x: x.text).alias("texts"))
    m = media.select(F.col("id").alias("media_id"), F.substring(F.coalesce("captured_at", "fallback_captured_at"), 1, 10).alias("date"))
    return m.join(by_day, "date").select("media_id", "date", "texts")


def cluster_events(cluster_media: DataFrame, evidence: DataFrame, event_places: DataFrame, places: DataFrame) -> DataFrame:
    """(cluster_id, event_id): events of a cluster by its place or by evidence, each once."""
    by_place = places.select(F.col("id").alias("place_id"), "cluster_id").join(event_places, "place_id").select("cluster_id", "event_id")
    return _carried(evidence, cluster_media.select("media_id", "cluster_id").distinct(), "cluster_id", by_place).select("cluster_id", "event_id")


def person_context(media: DataFrame, media_people: DataFrame, evidence: DataFrame, links: DataFrame, chat: DataFrame) -> DataFrame:
    """(media_id, person_id, face, event, chat, combined): how a person belongs to a medium.

    Face 1 by a cluster, else 0.8; event by its link's confidence (0.7 where it has none);
    chat a fifth a message, up to 1. Combined is the greatest of face, 0.85 event, 0.6 chat.
    """
    pair = ["media_id", "person_id"]
    own = media.select(F.col("id").alias("media_id"))
    face = media_people.where(flag("is_verified")).groupBy(*pair).agg(F.max(F.when(F.col("source") == "face_cluster", 1.0).otherwise(0.8)).alias("face"))
    through = evidence.select("event_id", F.col("evidence_id").alias("media_id")).distinct()
    event = through.join(links.where(flag("is_verified")).select("event_id", "person_id", F.coalesce("confidence", F.lit(0.7)).alias("c")), "event_id").groupBy(*pair).agg(F.max("c").alias("event"))
    said = through.join(chat.select("event_id", "person_id", "line_count"), "event_id").groupBy(*pair).agg(F.least(F.lit(1.0), F.sum("line_count") / 5).alias("chat"))
    rows = face.join(event, pair, "full").join(said, pair, "full").join(own, "media_id", "left_semi").fillna(0.0, ["face", "event", "chat"])
    return rows.withColumn("combined", F.greatest("face", F.col("event") * 0.85, F.col("chat") * 0.6))


def image_rows(media: DataFrame, media_people: DataFrame, found: DataFrame) -> DataFrame:
    """Media found by an image search, and those linked with people, flagged by where they come from."""
    linked = media_people.where(~flag("is_hidden")).select(F.col("media_id").alias("id")).distinct().withColumn("by_person", F.lit(True))
    hit = found.select(F.col("media_id").alias("id")).distinct().withColumn("by_search", F.lit(True))
    rows = media.select("id").join(linked, "id", "left").join(hit, "id", "left").fillna(False, ["by_person", "by_search"])
    return rows.where("by_person or by_search")


def label(row_name: str, public_name: str) -> Column:
    """A person's label: the display name, else the public one."""
    return F.coalesce(truthy(row_name), truthy(public_name))
