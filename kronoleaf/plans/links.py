"""Queries over links of media, events, chats, people and places, each beside its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import people, search
from .catalog import query
from .searches import _EFFECTIVE, _OVERLAID

_VISIBLE = "p.is_hidden = 0 AND p.is_deleted = 0 AND p.searchable = 1"
_DATE = "substr(coalesce(captured_at, fallback_captured_at),1,10)"


def _overlaid(t):
    return search.overlaid_events(t("life_events"), t("overrides"))


def _effective(t):
    return search.effective_vlm(t("vlm"), t("vlm_overrides"))


@query(f"SELECT m.id, m.file_name, {_DATE} AS date, o.status AS ocr_status, v.status AS vlm_status, v.caption, v.review_status FROM media m LEFT JOIN ocr o ON o.media_id = m.id LEFT JOIN ({_EFFECTIVE}) v ON v.media_id = m.id")
def enriched_media(t):
    return people.enriched_media(t("media"), t("ocr"), _effective(t)).select("id", "file_name", "date", "ocr_status", "vlm_status", "caption", "review_status")


_KINDS = ("photo", "line", "ocr", "vlm")


@query(f"SELECT x.id, x.title, x.is_pinned, coalesce(c.n,0) AS n_evidence, {', '.join(f'coalesce(c.n_{k},0) AS n_{k}' for k in _KINDS)} FROM ({_OVERLAID}) x LEFT JOIN (SELECT event_id, count(*) AS n, {', '.join(f"count(*) FILTER (WHERE evidence_type='{k}') AS n_{k}" for k in _KINDS)} FROM evidence GROUP BY 1) c ON c.event_id = x.id")
def canonical_events(t):
    from ..operators import evidence

    kinds = {f"n_{k}": F.col("evidence_type") == k for k in _KINDS}
    counted = evidence.counts(t("evidence"), "event_id", kinds).withColumnRenamed("event_id", "id")
    return _overlaid(t).join(counted, "id", "left").fillna(0, ["n_evidence", *kinds]).select("id", "title", "is_pinned", "n_evidence", *kinds)


_FACES = """SELECT DISTINCT f.media_id, pc.person_id, f.id AS face_id, fc.id AS cluster_id FROM person_clusters pc JOIN persons p ON p.id = pc.person_id JOIN face_clusters fc ON fc.id = pc.cluster_id JOIN face_members fm ON fm.cluster_id = fc.id JOIN faces f ON f.id = fm.face_id
 WHERE pc.is_verified = 1 AND p.is_deleted = 0 AND fc.status = 'reviewed' AND f.status = 'success' AND f.review_status <> 'rejected'"""


def _face_links(t):
    return people.faces_to_people(t("person_clusters"), t("face_clusters"), t("face_members"), t("faces"), t("persons"))


@query(_FACES)
def media_people_by_faces(t):
    return _face_links(t)


_BY_FACE = "SELECT e.event_id, mp.person_id, count(DISTINCT mp.media_id) AS media_count, count(DISTINCT mp.face_id) AS face_count FROM evidence e JOIN life_events le ON le.id = e.event_id JOIN media_people mp ON mp.media_id = e.evidence_id JOIN persons p ON p.id = mp.person_id WHERE e.evidence_type = 'photo' AND mp.source IN ('face_cluster','manual') AND mp.is_verified = 1 GROUP BY 1,2"
_BY_CHAT = "SELECT e.event_id, s.person_id, count(DISTINCT m.id) AS line_count FROM evidence e JOIN life_events le ON le.id = e.event_id JOIN messages m ON m.id = e.evidence_id JOIN speaker_links s ON s.chat_id = m.chat_id AND s.speaker_name = m.sender JOIN persons p ON p.id = s.person_id WHERE e.evidence_type = 'line' AND s.is_verified = 1 GROUP BY 1,2"


def _by_face(t):
    return people.events_by_faces(t("evidence"), t("life_events"), t("media_people", repeated=True), t("persons"))


def _by_chat(t):
    return people.events_by_chat(t("evidence"), t("life_events"), t("messages"), t("speaker_links"), t("persons"))


@query(_BY_FACE)
def event_people_by_faces(t):
    return _by_face(t)


@query(_BY_CHAT)
def event_people_by_chat(t):
    return _by_chat(t)


@query(f"WITH f AS ({_BY_FACE}), c AS ({_BY_CHAT}) SELECT event_id, person_id, 'face_cluster' AS source, cast(0.6 AS double) AS confidence, face_count AS evidence_count, media_count, cast(0 AS bigint) AS line_count FROM f UNION ALL SELECT event_id, person_id, 'line_speaker', cast(0.7 AS double), line_count, 0, line_count FROM c UNION ALL SELECT event_id, person_id, 'combined', cast(0.9 AS double), face_count + line_count, media_count, line_count FROM f JOIN c USING (event_id, person_id)")
def event_people_all(t):
    return people.event_people(t("evidence"), t("life_events"), t("media_people", repeated=True), t("messages"), t("speaker_links"), t("persons"))


@query(f"SELECT source, count(*) AS n, count(DISTINCT media_id) AS n_media FROM (SELECT media_id, person_id, source, face_id FROM media_people UNION SELECT media_id, person_id, 'face_cluster', face_id FROM ({_FACES})) GROUP BY 1")
def media_people_build(t):
    """The table after a build: candidates by faces that it does not hold yet are appended."""
    old = t("media_people").select("media_id", "person_id", "source", "face_id").distinct()
    new = _face_links(t).select("media_id", "person_id", F.lit("face_cluster").alias("source"), "face_id")
    return people.new_links(new, old, ["media_id", "person_id", "source", "face_id"]).groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("media_id").alias("n_media"))


@query(f"SELECT ep.event_id, string_agg(p.display_name, ',' ORDER BY ep.confidence DESC, p.display_name) AS people FROM event_people ep JOIN persons p ON p.id = ep.person_id WHERE ep.is_hidden = 0 AND {_VISIBLE} GROUP BY 1")
def related_people(t):
    return people.related_people(t("event_people"), t("persons")).select("event_id", F.array_join("people", ",").alias("people"))


_NAMES = f"""SELECT DISTINCT lower(trim(name)) AS name, id AS person_id, source FROM (SELECT p.id, p.display_name AS name, 'display_name' AS source FROM persons p WHERE {_VISIBLE} UNION ALL SELECT p.id, p.public_name, 'public_name' FROM persons p WHERE {_VISIBLE}
 UNION ALL SELECT p.id, unnest(from_json(p.aliases_json, '["VARCHAR"]')), 'aliases_json' FROM persons p WHERE {_VISIBLE} UNION ALL SELECT p.id, a.alias, 'alias' FROM aliases a JOIN persons p ON p.id = a.person_id WHERE {_VISIBLE}
 UNION ALL SELECT p.id, s.speaker_name, 'speaker' FROM speaker_links s JOIN persons p ON p.id = s.person_id WHERE s.is_verified = 1 AND {_VISIBLE}) WHERE name <> ''"""
_ASKED = "SELECT alias AS term FROM aliases UNION SELECT sender FROM messages UNION SELECT 'ali7' UNION SELECT display_name FROM persons"


def _asked(t):
    extra = t("persons").sparkSession.createDataFrame([("ali7",)], "term string")
    return t("aliases").select(F.col("alias").alias("term")).union(t("messages").select("sender")).union(extra).union(t("persons").select("display_name")).distinct()


def _names(t):
    return people.names_of(t("persons"), t("aliases"), t("speaker_links"))


@query(f"WITH n AS ({_NAMES}), q AS ({_ASKED}) SELECT term, count(DISTINCT person_id) AS n, min(person_id) AS person_id, coalesce(string_agg(DISTINCT source, ',' ORDER BY source),'') AS sources, CASE count(DISTINCT person_id) WHEN 0 THEN 'none' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM q LEFT JOIN n ON lower(trim(q.term)) = n.name GROUP BY 1")
def person_resolution(t):
    return people.resolve_names(_asked(t), "term", _names(t), "person_id")


@query("WITH n AS (SELECT DISTINCT lower(trim(name)) AS name, id, source FROM (SELECT id, display_name AS name, 'display_name' AS source FROM places WHERE hidden=0 AND searchable=1 UNION ALL SELECT id, public_name, 'public_name' FROM places WHERE hidden=0 AND searchable=1 UNION ALL SELECT id, category, 'category' FROM places WHERE hidden=0 AND searchable=1 UNION ALL SELECT id, unnest(from_json(aliases_json, '[\"VARCHAR\"]')), 'aliases_json' FROM places WHERE hidden=0 AND searchable=1) WHERE name <> ''), q AS (SELECT display_name AS term FROM places UNION SELECT category FROM places UNION SELECT 'spot3') SELECT term, count(DISTINCT id) AS n, min(id) AS place_id, coalesce(string_agg(DISTINCT source, ',' ORDER BY source),'') AS sources, CASE count(DISTINCT id) WHEN 0 THEN 'none' WHEN 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM q LEFT JOIN n ON lower(trim(q.term)) = n.name GROUP BY 1")
def place_resolution(t):
    extra = t("places").sparkSession.createDataFrame([("spot3",)], "term string")
    terms = t("places").select(F.col("display_name").alias("term")).union(t("places").select("category")).union(extra).distinct()
    return people.resolve_names(terms, "term", people.place_names(t("places")), "place_id")


@query(f"WITH n AS ({_NAMES}), one AS (SELECT name, min(person_id) AS person_id FROM n GROUP BY 1 HAVING count(DISTINCT person_id) = 1), q AS (SELECT DISTINCT chat_id || ' with ' || sender AS q FROM messages), w AS (SELECT q, unnest(string_split(q,' ')) AS term, generate_subscripts(string_split(q,' '),1) AS i FROM q), h AS (SELECT q, arg_min(w.term, i) AS term, arg_min(person_id, i) AS person_id FROM w JOIN one ON one.name = lower(w.term) GROUP BY 1) SELECT q.q AS query, h.term, h.person_id FROM q LEFT JOIN h USING (q)")
def person_mentions(t):
    asked = t("messages").select(F.concat_ws(" with ", "chat_id", "sender").alias("query")).distinct()
    return people.first_mention(asked, "query", F.split("query", " "), _names(t))


_CALLS = r"""SELECT id, chat_id, sender, sent_at, CASE WHEN regexp_matches(text, '\d{1,3}:\d{2}') THEN 'completed' WHEN contains(text,'不在着信') THEN 'missed' WHEN contains(text,'応答がありませんでした') THEN 'unanswered' WHEN contains(text,'キャンセル') THEN 'canceled' ELSE 'unknown' END AS call_status,
 CASE WHEN contains(text,'1:26:14') THEN 5174 WHEN contains(text,'10:38') THEN 638 END AS duration_sec FROM messages WHERE starts_with(text,'☎')"""


def _calls(t):
    from ..sources import chat

    return chat.calls(t("messages"), "☎", {"不在着信": "missed", "応答がありませんでした": "unanswered", "キャンセル": "canceled"})


_DAYS = f"""WITH w AS (SELECT s.person_id, s.chat_id, s.speaker_name AS sender FROM speaker_links s JOIN persons p ON p.id = s.person_id WHERE s.is_verified = 1 AND {_VISIBLE}), c AS ({_CALLS}),
a AS (SELECT person_id, substr(sent_at,1,10) AS date, count(*) AS message_count, min(sent_at) AS first_seen_at, max(sent_at) AS last_seen_at, count(DISTINCT chat_id) AS chat_count, count(DISTINCT sender) AS speaker_count FROM w JOIN messages USING (chat_id, sender) GROUP BY 1,2),
b AS (SELECT person_id, substr(sent_at,1,10) AS date, count(*) AS call_count, count(*) FILTER (WHERE call_status='completed') AS completed_count, coalesce(sum(duration_sec),0) AS call_seconds FROM w JOIN c USING (chat_id, sender) GROUP BY 1,2),
d AS (SELECT person_id, date, coalesce(message_count,0) AS message_count, first_seen_at, last_seen_at, coalesce(chat_count,0) AS chat_count, coalesce(speaker_count,0) AS speaker_count, coalesce(call_count,0) AS call_count, coalesce(completed_count,0) AS completed_count, cast(coalesce(call_seconds,0) AS bigint) AS call_seconds FROM a FULL JOIN b USING (person_id, date))"""


def _chat_days(t):
    return people.chat_days(t("speaker_links"), t("persons"), t("messages"), _calls(t))


@query(f"{_DAYS} SELECT * FROM d")
def person_chat_days(t):
    return _chat_days(t)


@query(f"{_DAYS}, r AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY message_count DESC, date DESC) AS r FROM d), k AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY message_count + call_count DESC, date) AS rank FROM r WHERE r <= 3 OR message_count = 0) SELECT person_id, date, message_count, call_count, cast(rank AS integer) AS rank FROM k WHERE rank <= 3")
def person_top_days(t):
    return people.top_days(_chat_days(t), 3).select("person_id", "date", "message_count", "call_count", "rank")


@query(f"SELECT DISTINCT mp.person_id, mp.media_id, {_DATE} AS date FROM media_people mp JOIN persons p ON p.id = mp.person_id JOIN media m ON m.id = mp.media_id WHERE mp.is_hidden = 0 AND {_VISIBLE}")
def person_photos(t):
    return people.person_photos(t("media_people"), t("media"), t("persons"))


@query(f"SELECT ep.person_id, x.id AS event_id, x.date FROM event_people ep JOIN persons p ON p.id = ep.person_id JOIN ({_OVERLAID}) x ON x.id = ep.event_id WHERE ep.is_hidden = 0 AND {_VISIBLE} AND x.is_hidden = 0 AND (contains(coalesce(x.title,''),'食事') OR contains(coalesce(x.summary,''),'食事')) AND EXISTS (SELECT 1 FROM event_places l JOIN places pl ON pl.id = l.place_id WHERE l.event_id = x.id AND pl.hidden = 0 AND pl.searchable = 1 AND pl.category = 'station')")
def person_events_at_places(t):
    from ..functions.text import any_term

    shown = t("places").where("hidden = 0 and searchable = 1 and category = 'station'").select(F.col("id").alias("place_id"))
    at = t("event_places").join(shown, "place_id", "left_semi")
    return people.person_events(t("event_people"), t("persons"), _overlaid(t), at, any_term(["title", "summary"], ["食事"])).select("person_id", "event_id", "date")


@query(f"SELECT l.place_id, pl.display_name, x.id AS event_id, x.date FROM event_places l JOIN places pl ON pl.id = l.place_id JOIN ({_OVERLAID}) x ON x.id = l.event_id WHERE pl.hidden = 0 AND pl.searchable = 1 AND x.is_hidden = 0")
def place_events(t):
    return people.place_events(t("event_places"), t("places"), _overlaid(t)).select("place_id", "display_name", "event_id", "date")


@query("SELECT l.place_id, l.media_id, coalesce(m.captured_at, m.fallback_captured_at) AS captured_at FROM media_places l JOIN places pl ON pl.id = l.place_id JOIN media m ON m.id = l.media_id WHERE pl.hidden = 0 AND pl.searchable = 1")
def place_photos(t):
    return people.place_photos(t("media_places"), t("places"), t("media"))


@query("SELECT m.*, coalesce(l.ids,'') AS person_ids, coalesce(l.names,'') AS names FROM (SELECT chat_id, sender, count(*) AS message_count, min(sent_at) AS first_seen_at, max(sent_at) AS last_seen_at FROM messages WHERE trim(sender) <> '' GROUP BY 1,2) m LEFT JOIN (SELECT s.chat_id, s.speaker_name AS sender, string_agg(DISTINCT p.id, ',' ORDER BY p.id) AS ids, string_agg(DISTINCT p.display_name, ',' ORDER BY p.display_name) AS names FROM speaker_links s JOIN persons p ON p.id = s.person_id GROUP BY 1,2) l USING (chat_id, sender)")
def chat_speakers(t):
    return people.speaker_listing(t("messages"), t("speaker_links"), t("persons"))


_SPEAKERS = "SELECT DISTINCT sender AS speaker_name FROM messages UNION SELECT alias FROM aliases UNION SELECT public_name FROM persons WHERE public_name IS NOT NULL"


@query(f"WITH s AS ({_SPEAKERS}), x AS (SELECT s.speaker_name, p.id AS person_id, 1 AS k FROM s JOIN persons p ON p.display_name = s.speaker_name UNION ALL SELECT s.speaker_name, p.id, 2 FROM s JOIN persons p ON p.public_name = s.speaker_name UNION ALL SELECT s.speaker_name, a.person_id, 3 FROM s JOIN aliases a ON a.alias = s.speaker_name) SELECT speaker_name, person_id, CASE min(k) WHEN 1 THEN 'display_name exact match' WHEN 2 THEN 'public_name exact match' ELSE 'person alias exact match' END AS reason FROM x GROUP BY 1,2")
def speaker_suggestions(t):
    speakers = t("messages").select(F.col("sender").alias("speaker_name")).union(t("aliases").select("alias")).union(t("persons").where("public_name is not null").select("public_name")).distinct()
    return people.suggestions(speakers, t("persons"), t("aliases"))


_PARTS = f"SELECT DISTINCT trim(speaker_name) AS speaker_name FROM (SELECT * FROM ({_SPEAKERS}) UNION ALL SELECT display_name FROM persons UNION ALL SELECT substr(public_name,2) FROM persons WHERE public_name IS NOT NULL) WHERE trim(speaker_name)<>''"


@query(f"WITH s AS ({_PARTS}), x AS (SELECT s.speaker_name, p.id AS person_id, 1 AS k FROM s JOIN persons p ON p.display_name = s.speaker_name UNION ALL SELECT s.speaker_name, p.id, 2 FROM s JOIN persons p ON p.public_name = s.speaker_name UNION ALL SELECT s.speaker_name, a.person_id, 3 FROM s JOIN aliases a ON a.alias = s.speaker_name UNION ALL SELECT s.speaker_name, p.id, 4 FROM s JOIN persons p ON contains(lower(p.display_name), lower(s.speaker_name))), b AS (SELECT speaker_name, person_id, min(k) AS k FROM x GROUP BY 1,2) SELECT speaker_name, person_id, reason, cast(rank AS integer) AS rank FROM (SELECT b.speaker_name, b.person_id, CASE k WHEN 1 THEN 'display_name exact match' WHEN 2 THEN 'public_name exact match' WHEN 3 THEN 'person alias exact match' ELSE 'name contains speaker text' END AS reason, row_number() OVER (PARTITION BY b.speaker_name ORDER BY p.created_order, b.person_id) AS rank FROM b JOIN persons p ON p.id = b.person_id) WHERE rank<=10")
def ranked_speaker_suggestions(t):
    """The first ten people for each speaker, name, alias and piece of a name."""
    names = t("messages").select(F.col("sender").alias("speaker_name")).union(t("aliases").select("alias")).union(t("persons").select("public_name")).union(t("persons").select("display_name")).union(t("persons").select(F.substring("public_name", 2, 100)))
    return people.ranked_suggestions(names, t("persons"), t("aliases"), "created_order")


@query("WITH n AS (SELECT id, created_order, display_name AS name FROM persons UNION ALL SELECT id, created_order, public_name FROM persons UNION ALL SELECT p.id, p.created_order, a.alias FROM persons p JOIN aliases a ON a.person_id = p.id), q AS (SELECT DISTINCT alias AS term FROM aliases) SELECT term, arg_min(id, created_order) AS person_id FROM q JOIN n ON trim(q.term) = n.name GROUP BY 1")
def earliest_person(t):
    return people.earliest_person(t("aliases").select(F.col("alias").alias("term")).distinct(), "term", t("persons"), t("aliases"))


@query("SELECT s.person_id, substr(m.sent_at,1,10) AS date, count(*) AS n, min(m.sent_at) AS first_at, string_agg(DISTINCT m.chat_id, ',' ORDER BY m.chat_id) AS chats FROM speaker_links s JOIN messages m ON m.chat_id = s.chat_id AND m.sender = s.speaker_name GROUP BY 1,2")
def speaker_link_days(t):
    said = t("speaker_links").join(t("messages").withColumnRenamed("sender", "speaker_name"), ["chat_id", "speaker_name"])
    return said.groupBy("person_id", F.substring("sent_at", 1, 10).alias("date")).agg(F.count("*").alias("n"), F.min("sent_at").alias("first_at"), F.concat_ws(",", F.array_sort(F.collect_set("chat_id"))).alias("chats"))


@query("SELECT DISTINCT mp.media_id, mp.person_id, p.display_name FROM media_people mp JOIN persons p ON p.id = mp.person_id WHERE mp.is_hidden = 0 AND p.is_deleted = 0")
def persons_of_media(t):
    return people.persons_of(t("media_people"), t("persons"), "media_id")


@query("SELECT DISTINCT ep.event_id, ep.person_id, p.display_name FROM event_people ep JOIN persons p ON p.id = ep.person_id WHERE ep.is_hidden = 0 AND p.is_deleted = 0")
def persons_of_events(t):
    return people.persons_of(t("event_people"), t("persons"), "event_id")


_TABLES = {"n_clusters": "person_clusters", "n_aliases": "aliases", "n_speakers": "speaker_links", "n_media": "media_people", "n_events": "event_people"}


@query("SELECT p.id, p.display_name, p.privacy_level, " + ", ".join(f"coalesce({n}.c,0) AS {n}" for n in _TABLES) + " FROM persons p " + " ".join(f"LEFT JOIN (SELECT person_id, count(*) AS c FROM {x} GROUP BY 1) {n} ON {n}.person_id = p.id" for n, x in _TABLES.items()))
def person_link_counts(t):
    return people.link_counts(t("persons"), {n: t(x) for n, x in _TABLES.items()})


_POINTS = "SELECT media_id, concat('pc_', substr(place_id, 7)) AS cluster_id FROM media_places"


def _points(t):
    return t("media_places").select("media_id", F.concat(F.lit("pc_"), F.substr("place_id", F.lit(7))).alias("cluster_id"))


@query(f"WITH m AS (SELECT DISTINCT x.media_id, p.id AS place_id FROM ({_POINTS}) x JOIN places p USING (cluster_id)) SELECT 'media' AS kind, media_id AS id, place_id, cast(0.8 AS double) AS confidence FROM m UNION ALL SELECT DISTINCT 'event', e.event_id, m.place_id, cast(0.75 AS double) FROM evidence e JOIN m ON m.media_id = e.evidence_id WHERE e.evidence_type IN ('photo','ocr','vlm')")
def propagated_places(t):
    media, events = people.propagated_places(_points(t), t("evidence"), t("places"))
    part = lambda df, kind, key: df.select(F.lit(kind).alias("kind"), F.col(key).alias("id"), "place_id", "confidence")
    return part(media, "media", "media_id").union(part(events, "event", "event_id"))


@query("SELECT id FROM life_events e WHERE is_user_edited = 0 AND NOT EXISTS (SELECT 1 FROM overrides o WHERE o.event_id = e.id AND trim(o.location_name_override) <> '')")
def location_updatable(t):
    return people.may_take_location(t("life_events"), t("overrides")).select("id")


@query(f"SELECT evidence_id, arg_min(event_id, (-is_pinned, date, start_time, event_id)) AS event_id FROM (SELECT DISTINCT e.event_id, e.evidence_id, x.is_pinned, x.date, x.start_time FROM evidence e JOIN ({_OVERLAID}) x ON x.id = e.event_id WHERE x.is_hidden = 0) GROUP BY 1")
def first_event_of_media(t):
    return people.first_event(t("evidence"), _overlaid(t))


@query(f"WITH f AS (SELECT substr(sent_at,1,10) AS date, text, row_number() OVER (PARTITION BY substr(sent_at,1,10) ORDER BY sent_at, id) AS r FROM messages WHERE contains(text,'ランチ') OR contains(text,'カフェ')), d AS (SELECT date, string_agg(text, '|' ORDER BY r) AS texts FROM f WHERE r <= 5 GROUP BY 1) SELECT m.id AS media_id, {_DATE} AS date, d.texts FROM media m JOIN d ON d.date = {_DATE}")
def same_day_chat(t):
    from ..functions.text import any_term

    return people.day_context(t("media"), t("messages"), any_term(["text"], ["ランチ", "カフェ"])).select("media_id", "date", F.array_join("texts", "|").alias("texts"))


@query(f"SELECT DISTINCT p.cluster_id, l.event_id FROM places p JOIN event_places l ON l.place_id = p.id UNION SELECT DISTINCT x.cluster_id, e.event_id FROM ({_POINTS}) x JOIN evidence e ON e.evidence_id = x.media_id")
def cluster_events(t):
    return people.cluster_events(_points(t), t("evidence"), t("event_places"), t("places"))


@query(f"""WITH c AS ({_BY_CHAT}), th AS (SELECT DISTINCT event_id, evidence_id AS media_id FROM evidence),
f AS (SELECT media_id, person_id, max(CASE WHEN source='face_cluster' THEN 1.0::double ELSE 0.8::double END) AS face FROM media_people WHERE is_verified=1 GROUP BY 1,2),
e AS (SELECT media_id, person_id, max(coalesce(confidence,0.7::double)) AS event FROM th JOIN event_people USING (event_id) WHERE is_verified=1 GROUP BY 1,2),
s AS (SELECT media_id, person_id, least(1.0::double, sum(line_count)::double/5) AS chat FROM th JOIN c USING (event_id) GROUP BY 1,2),
x AS (SELECT media_id, person_id, coalesce(face,0::double) AS face, coalesce(event,0::double) AS event, coalesce(chat,0::double) AS chat FROM f FULL JOIN e USING (media_id, person_id) FULL JOIN s USING (media_id, person_id))
SELECT x.*, greatest(face, event*0.85::double, chat*0.6::double) AS combined FROM x WHERE media_id IN (SELECT id FROM media)""")
def person_context_of_media(t):
    return people.person_context(t("media"), t("media_people"), t("evidence"), t("event_people"), _by_chat(t))


@query(f"SELECT m.id, m.id IN (SELECT media_id FROM media_people WHERE is_hidden=0) AS by_person, m.id IN (SELECT media_id FROM ({_EFFECTIVE}) WHERE contains(lower(caption),'ramen')) AS by_search FROM media m WHERE m.id IN (SELECT media_id FROM media_people WHERE is_hidden=0) OR m.id IN (SELECT media_id FROM ({_EFFECTIVE}) WHERE contains(lower(caption),'ramen'))")
def person_image_rows(t):
    from ..functions.text import any_term

    return people.image_rows(t("media"), t("media_people"), _effective(t).where(any_term(["caption"], ["ramen"])))


@query("SELECT seen_at, kind, id FROM (SELECT sent_at AS seen_at, 'line' AS kind, id FROM messages UNION ALL SELECT coalesce(captured_at, fallback_captured_at), 'photo', id FROM media) ORDER BY seen_at, kind, id LIMIT 500")
def timeline(t):
    """The first rows of the timeline of messages and photos, in order of time and kind."""
    a = t("messages").select(F.col("sent_at").alias("seen_at"), F.lit("line").alias("kind"), "id")
    b = t("media").select(F.coalesce("captured_at", "fallback_captured_at").alias("seen_at"), F.lit("photo").alias("kind"), "id")
    return a.unionByName(b).orderBy("seen_at", "kind", "id").limit(500)


def _export(t):
    """Messages as lines of exports, one file a chat: a date line a day, then the day's messages."""
    m = t("messages").where("text <> ''").withColumn("day", F.substring("sent_at", 1, 10))
    clock = F.concat(F.substring("sent_at", 12, 2).cast("int").cast("string"), F.substring("sent_at", 14, 3))
    said = m.select("chat_id", "day", F.lit(1).alias("k"), "sent_at", "id", F.concat_ws("\t", clock, "sender", "text").alias("line"))
    heads = m.select("chat_id", "day").distinct().select("chat_id", "day", F.lit(0).alias("k"), F.lit("").alias("sent_at"), F.lit("").alias("id"), F.concat(F.regexp_replace("day", "-", "/"), F.lit("(Day)")).alias("line"))
    from pyspark.sql import Window

    w = Window.partitionBy("chat_id").orderBy("day", "k", "sent_at", "id")
    return said.union(heads).select(F.concat(F.lit("/data/"), "chat_id", F.lit(".txt")).alias("source_file"), F.row_number().over(w).alias("line_number"), "line")


_TYPE = "CASE WHEN contains(text,'不在着信') THEN 'system' ELSE 'text' END"


@query(f"SELECT 'line_'||substr(sha256(chat_id),1,16) AS chat_id, 'line_msg_'||sha256(concat_ws(chr(31), chat_id||'.txt', replace(substr(sent_at,1,16),' ','T')||':00+09:00', sender, text)) AS id, replace(substr(sent_at,1,16),' ','T')||':00' AS sent, sender, text, {_TYPE} AS message_type FROM messages WHERE text <> ''")
def chat_export_parsed(t):
    """Messages written as exports and parsed again."""
    from ..sources import chat

    return chat.parse(_export(t)).select("chat_id", "id", F.date_format("sent_at", "yyyy-MM-dd'T'HH:mm:ss").alias("sent"), "sender", "text", "message_type")


@query(f"SELECT id AS message_id, call_status, cast(duration_sec AS integer) AS duration_sec FROM ({_CALLS}) WHERE call_status='completed' AND duration_sec>=600 AND substr(sent_at,1,10) BETWEEN '2024-01-03' AND '2024-01-28' ORDER BY duration_sec DESC, sent_at, id LIMIT 50")
def call_search(t):
    from ..sources import chat

    index = chat.call_index(t("messages"), "☎", {"不在着信": "missed", "応答がありませんでした": "unanswered", "キャンセル": "canceled"})
    return chat.search_calls(index, status="completed", least_sec=600, date_from="2024-01-03", date_to="2024-01-28").select("message_id", "call_status", "duration_sec")
