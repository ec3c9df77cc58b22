"""Integrity rules as data: one conditional aggregate a table, one grouping for all references, one a repeated key."""

from __future__ import annotations

from collections.abc import Callable
from functools import cache, reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F
from pyspark.sql.types import DataType


class Count(NamedTuple):
    """Rows of a table that meet a condition."""

    table: str
    metric: str
    condition: str


class Orphan(NamedTuple):
    """Rows whose key is not null and has no parent."""

    table: str
    metric: str
    key: str
    parent: str
    parent_key: str
    condition: str = "true"


class Repeat(NamedTuple):
    """Values of a key that several rows share."""

    table: str
    metric: str
    keys: tuple[str, ...]


class Spread(NamedTuple):
    """Rows of each value of a column, one metric a value."""

    table: str
    metric: str
    column: str


#: Rules that share a grouping with their parent's keys: each is a count in every row that is exchanged.
PLACES = 2


def _name(r) -> str:
    return f"{r.table}.{r.metric}"


def _tallies(rows: DataFrame, counts: list[Count], spreads: list[Spread]) -> DataFrame:
    """(metric, n) of conditions and spreads, from one grouping by the spread columns."""
    keys = [F.coalesce(F.col(r.column).cast("string"), F.lit("null")).alias(f"s{i}") for i, r in enumerate(spreads)]
    groups = rows.groupBy(*keys).agg(F.count("*").alias("n"), *[F.count_if(F.expr(r.condition)).alias(f"n{i}") for i, r in enumerate(counts)])
    row = lambda metric, n: F.struct(metric.alias("metric"), F.col(n).alias("n"))
    return groups.select(F.inline(F.array(*[row(F.lit(_name(r)), f"n{i}") for i, r in enumerate(counts)], *[row(F.concat(F.lit(f"{_name(r)}:"), F.col(f"s{i}")), "n") for i, r in enumerate(spreads)])))


def _repeats(rows: DataFrame, r: Repeat) -> DataFrame:
    return rows.groupBy(*r.keys).agg(F.count("*").alias("c")).agg(F.count_if(F.col("c") > 1).alias("n")).select(F.lit(_name(r)).alias("metric"), "n")


def _text(key: str, kind: DataType) -> Column:
    """A key of one type as text, equal where the keys are."""
    c = F.col(key).cast(kind)
    if kind.typeName() == "string":
        return c
    return F.when(c.isNotNull(), F.to_json(F.struct((c + F.lit(0.0) if kind.typeName() in ("float", "double") else c).alias("k"))))


def _orphans(load: Callable[[str], DataFrame], rules: list[Orphan]) -> DataFrame:
    """(metric, n) of all references, which meet the keys of their parents in one grouping by parent and key.

    A reference and a parent's key are a row (parent, key, place), the place being 0 for the parent and another for each rule,
    and are counted before they are exchanged, so a key of many references is a row a task. A table is read once for all its
    references. A parent is there once for each `PLACES` rules, and for each type of the keys that refer to it.
    """
    same, kinds = {}, {}
    for r in rules:
        child, parent = load(r.table).select(r.key), load(r.parent).select(r.parent_key)
        same.setdefault((r.parent, r.parent_key, child.schema[0].dataType.simpleString()), []).append(r)
        kinds[r] = (parent if child.schema[0].dataType == parent.schema[0].dataType else parent.union(child)).schema[0].dataType
    at = {(*k, i): own[i : i + PLACES] for k, own in same.items() for i in range(0, len(own), PLACES)}
    numbers = {r: (d, i) for d, own in enumerate(at.values()) for i, r in enumerate(own, 1)}
    entry = lambda d, key, i: F.struct(F.lit(d).alias("d"), key.alias("k"), F.lit(i).alias("place"))
    parts = [load(parent).select(F.inline(F.array(entry(d, _text(key, kinds[own[0]]), 0)))) for d, ((parent, key, *_), own) in enumerate(at.items())]
    for table in sorted({r.table for r in rules}):
        refs = [entry(numbers[r][0], F.when(F.expr(r.condition), _text(r.key, kinds[r])), numbers[r][1]) for r in rules if r.table == table]
        parts.append(load(table).select(F.inline(F.array(*refs))))
    most = max(map(len, at.values()))
    places = [F.count_if(F.col("place") == i).alias(f"n{i}") for i in range(most + 1)]
    groups = reduce(DataFrame.union, parts).where("k is not null").groupBy("d", "k").agg(*places).where("n0 = 0")
    sums = groups.groupBy("d").agg(*[F.sum(f"n{i}").alias(f"n{i}") for i in range(1, most + 1)])
    rows = [F.struct(F.when(F.col("d") == d, _name(r)).alias("metric"), F.col(f"n{i}").alias("n")) for r, (d, i) in numbers.items()]
    return sums.select(F.inline(F.array(*rows))).where("metric is not null")


def report(load: Callable[[str], DataFrame], rules: list) -> DataFrame:
    """(metric, n), by one pass of a table for its conditions and spreads, one for all its references and one for each repeated key.

    All counts are made before they are exchanged. A metric that nothing meets is there with 0, but for spreads, which have the
    values that occur.
    """
    parts, load = [], cache(load)
    for table in sorted({r.table for r in rules}):
        of = lambda kind: [r for r in rules if isinstance(r, kind) and r.table == table]  # noqa: B023, E731
        if of(Count) or of(Spread):
            parts.append(_tallies(load(table), of(Count), of(Spread)))
        parts += [_repeats(load(table), r) for r in of(Repeat)]
    if orphans := [r for r in rules if isinstance(r, Orphan)]:
        parts.append(_orphans(load, orphans))
    if fixed := [F.struct(F.lit(_name(r)).alias("metric"), F.lit(0).cast("long").alias("n")) for r in rules if not isinstance(r, Spread)]:
        parts.append(parts[0].sparkSession.range(1).select(F.inline(F.array(*fixed))))
    return reduce(DataFrame.unionByName, parts).groupBy("metric").agg(F.sum("n").alias("n"))


def sample(load: Callable[[str], DataFrame], rule: Orphan, key: str, most: int = 10) -> DataFrame:
    """The first ids of the rows without a parent."""
    child = load(rule.table).where(F.expr(rule.condition) & F.col(rule.key).isNotNull())
    parent = load(rule.parent).select(F.col(rule.parent_key).alias(rule.key)).distinct()
    return child.join(parent, rule.key, "left_anti").select(key).distinct().orderBy(key).limit(most)


def _enum(column: str, *values: str) -> str:
    return f"{column} IS NULL OR {column} NOT IN ({', '.join(repr(v) for v in values)})"


def _outside(column: str, low: float, high: float) -> str:
    return f"{column} < {low} OR {column} > {high}"


_FLAGS = "NOT IN (0, 1)"
#: What rows of each table must be, as conditions of those that are not, in the SQL that any engine shares.
RULES: list = [
    Count("media", "total", "true"), Count("media", "file_hash_null", "file_hash IS NULL"), Count("media", "captured_at_null", "captured_at IS NULL"), Count("media", "fallback_captured_at_null", "fallback_captured_at IS NULL"),
    Count("media", "gps_present", "gps_lat IS NOT NULL AND gps_lon IS NOT NULL"), Count("media", "invalid_lat_lon", f"{_outside('gps_lat', -90, 90)} OR {_outside('gps_lon', -180, 180)}"),
    Repeat("media", "duplicate_file_hash_groups", ("file_hash",)), Repeat("media", "duplicate_file_path_groups", ("file_name",)), Repeat("media", "duplicate_id_groups", ("id",)),
    Count("messages", "total", "true"), Count("messages", "sent_at_null", "sent_at IS NULL"), Count("messages", "text_null_or_empty", "text IS NULL OR trim(text) = ''"), Count("messages", "sender_empty", "sender IS NULL OR trim(sender) = ''"),
    Count("messages", "invalid_message_type", _enum("message_type", "text", "image", "video", "sticker", "file", "call", "system", "unknown")), Repeat("messages", "duplicate_id_groups", ("id",)), Spread("messages", "chat_id_counts", "chat_id"),
    Count("ocr", "total", "true"), Count("ocr", "success_count", "status = 'success'"), Count("ocr", "failed_count", "status = 'failed'"), Count("ocr", "engine_unavailable_count", "status = 'engine_unavailable'"),
    Count("ocr", "invalid_status_count", _enum("status", "success", "failed", "engine_unavailable", "skipped")), Count("ocr", "success_analyzed_at_null", "status = 'success' AND analyzed_at IS NULL"), Count("ocr", "ocr_text_too_long", "length(ocr_text) > 20000"),
    Count("ocr", "success_text_empty", "status = 'success' AND (ocr_text IS NULL OR trim(ocr_text) = '')"), Spread("ocr", "status_counts", "status"), Orphan("ocr", "orphan_media_refs", "media_id", "media", "id"), Repeat("ocr", "duplicate_media_groups", ("media_id",)),
    Count("vlm", "total", "true"), Count("vlm", "success_count", "status = 'success'"), Count("vlm", "failed_count", "status = 'failed'"), Count("vlm", "engine_unavailable_count", "status = 'engine_unavailable'"),
    Count("vlm", "invalid_status_count", _enum("status", "success", "failed", "engine_unavailable", "skipped")), Count("vlm", "success_caption_empty", "status = 'success' AND (caption IS NULL OR trim(caption) = '')"), Count("vlm", "caption_too_long", "length(caption) > 2000"),
    Count("vlm", "negative_people_count", "people_count < 0"), Count("vlm", "invalid_confidence", _outside("confidence", 0, 1)), Spread("vlm", "status_counts", "status"), Orphan("vlm", "orphan_media_refs", "media_id", "media", "id"),
    Count("vlm_overrides", "total", "true"), Count("vlm_overrides", "hidden_count", "is_hidden = 1"), Count("vlm_overrides", "wrong_count", "is_wrong = 1"), Count("vlm_overrides", "not_searchable_count", "is_searchable = 0"), Count("vlm_overrides", "not_event_usable_count", "is_event_usable = 0"),
    Count("vlm_overrides", "unknown_status_count", _enum("review_status", "unreviewed", "accepted", "rejected", "needs_fix", "wrong")), Spread("vlm_overrides", "status_counts", "review_status"), Orphan("vlm_overrides", "orphan_media_refs", "media_id", "vlm", "media_id"),
    Count("media_vectors", "total", "true"), Count("media_vectors", "invalid_status_count", _enum("status", "success", "failed")), Count("media_vectors", "success_empty_embedding", "status = 'success' AND embedding IS NULL"), Count("media_vectors", "fake_model", "embedding_model LIKE '%fake%'"),
    Spread("media_vectors", "type_counts", "embedding_type"), Spread("media_vectors", "model_counts", "embedding_model"), Spread("media_vectors", "status_counts", "status"), Orphan("media_vectors", "orphan_media_refs", "media_id", "media", "id"), Repeat("media_vectors", "duplicate_groups", ("media_id", "embedding_type")),
    Count("life_events", "total", "true"), Count("life_events", "date_null", "date IS NULL"), Count("life_events", "start_time_null", "start_time IS NULL"), Count("life_events", "end_time_null", "end_time IS NULL"), Count("life_events", "title_empty", "title IS NULL OR trim(title) = ''"),
    Count("life_events", "confidence_null", "confidence IS NULL"), Count("life_events", "confidence_invalid", _outside("confidence", 0, 1)), Count("life_events", "end_before_start", "end_time < start_time"), Count("life_events", "invalid_edited_flag", f"is_user_edited {_FLAGS}"),
    Count("life_events", "half_gps", "(gps_lat IS NULL) <> (gps_lon IS NULL)"), Spread("life_events", "date_counts", "date"), Spread("life_events", "source_counts", "source"), Repeat("life_events", "duplicate_id_groups", ("id",)), Repeat("life_events", "duplicate_slot_groups", ("date", "start_time", "title")),
    Count("evidence", "total", "true"), Count("evidence", "invalid_weight", _outside("weight", 0, 1)), Count("evidence", "invalid_type", _enum("evidence_type", "photo", "line", "ocr", "vlm")), Spread("evidence", "evidence_type_counts", "evidence_type"),
    Orphan("evidence", "missing_photo_refs", "evidence_id", "media", "id", "evidence_type = 'photo'"), Orphan("evidence", "missing_line_refs", "evidence_id", "messages", "id", "evidence_type = 'line'"), Orphan("evidence", "missing_ocr_refs", "evidence_id", "ocr", "media_id", "evidence_type = 'ocr'"),
    Orphan("evidence", "missing_vlm_refs", "evidence_id", "vlm", "media_id", "evidence_type = 'vlm'"), Orphan("evidence", "orphan_event_refs", "event_id", "life_events", "id"), Repeat("evidence", "duplicate_groups", ("event_id", "evidence_type", "evidence_id")),
    Count("overrides", "total", "true"), Count("overrides", "hidden_count", "is_hidden = 1"), Count("overrides", "pinned_count", "is_pinned = 1"), Count("overrides", "verified_count", "is_verified = 1"), Count("overrides", "invalid_flags", f"is_hidden {_FLAGS} OR is_pinned {_FLAGS} OR is_verified {_FLAGS}"),
    Count("overrides", "hidden_and_pinned", "is_hidden = 1 AND is_pinned = 1"), Count("overrides", "empty_title_override", "title_override = ''"), Orphan("overrides", "orphan_event_refs", "event_id", "life_events", "id"), Repeat("overrides", "duplicate_event_groups", ("event_id",)),
    Count("job_items", "total_items", "true"), Count("job_items", "failed_items", "status = 'failed'"), Count("job_items", "invalid_item_status_count", _enum("status", "pending", "running", "success", "failed", "skipped")), Spread("job_items", "item_status_counts", "status"), Orphan("job_items", "orphan_job_items", "item_id", "media", "id"),
    Count("places", "places_total", "true"), Count("places", "invalid_privacy_level", _enum("privacy_level", "normal", "sensitive", "exact_private", "hidden")), Count("places", "invalid_privacy_flags", f"hidden {_FLAGS} OR searchable {_FLAGS}"), Count("places", "hidden_but_searchable", "hidden = 1 AND searchable = 1"),
    Count("places", "invalid_centroid", f"lat IS NULL OR lon IS NULL OR {_outside('lat', -90, 90)} OR {_outside('lon', -180, 180)}"), Count("places", "invalid_radius", "radius_m IS NULL OR radius_m <= 0"), Count("places", "public_name_missing", "public_name IS NULL"), Spread("places", "category_counts", "category"),
    Repeat("places", "duplicate_display_name", ("display_name",)), Repeat("places", "duplicate_cluster", ("cluster_id",)),
    Count("event_places", "event_places_total", "true"), Count("event_places", "invalid_confidence", _outside("confidence", 0, 1)), Orphan("event_places", "orphan_event_refs", "event_id", "life_events", "id"), Orphan("event_places", "orphan_place_refs", "place_id", "places", "id"), Repeat("event_places", "duplicate_links", ("event_id", "place_id")),
    Count("media_places", "media_places_total", "true"), Count("media_places", "invalid_confidence", _outside("confidence", 0, 1)), Orphan("media_places", "orphan_media_refs", "media_id", "media", "id"), Orphan("media_places", "orphan_place_refs", "place_id", "places", "id"), Repeat("media_places", "duplicate_links", ("media_id", "place_id")),
    Count("faces", "total", "true"), Count("faces", "invalid_review_status", _enum("review_status", "pending", "confirmed", "rejected", "needs_review")), Count("faces", "invalid_status", _enum("status", "success", "failed")), Spread("faces", "review_status_counts", "review_status"), Orphan("faces", "orphan_media_refs", "media_id", "media", "id"),
    Count("face_clusters", "total", "true"), Count("face_clusters", "invalid_status", _enum("status", "reviewed", "rejected", "unreviewed")), Orphan("face_clusters", "empty_cluster", "id", "face_members", "cluster_id"), Spread("face_clusters", "status_counts", "status"),
    Count("face_members", "invalid_distance", "distance_to_centroid < 0 OR distance_to_centroid > 2"), Orphan("face_members", "orphan_cluster_refs", "cluster_id", "face_clusters", "id"), Orphan("face_members", "orphan_face_refs", "face_id", "faces", "id"), Repeat("face_members", "duplicate_member", ("cluster_id", "face_id")), Repeat("face_members", "face_in_clusters", ("face_id",)),
    Count("persons", "persons_total", "true"), Count("persons", "invalid_privacy_level", _enum("privacy_level", "public_alias", "private", "hidden")), Count("persons", "invalid_privacy_flags", f"is_hidden {_FLAGS} OR is_deleted {_FLAGS} OR searchable {_FLAGS}"), Count("persons", "hidden", "is_hidden = 1"), Count("persons", "deleted", "is_deleted = 1"),
    Count("persons", "public_alias_missing_public_name", "privacy_level = 'public_alias' AND public_name IS NULL"), Spread("persons", "privacy_counts", "privacy_level"), Repeat("persons", "duplicate_display_name", ("display_name",)), Repeat("persons", "duplicate_public_name", ("public_name",)),
    Count("aliases", "aliases_total", "true"), Count("aliases", "invalid_source", _enum("source", "manual", "speaker", "import")), Orphan("aliases", "orphan_person_refs", "person_id", "persons", "id"), Repeat("aliases", "duplicate_aliases", ("person_id", "alias")), Repeat("aliases", "shared_aliases", ("alias",)),
    Count("person_clusters", "links_total", "true"), Count("person_clusters", "unverified_links", "is_verified = 0"), Orphan("person_clusters", "orphan_person_refs", "person_id", "persons", "id"), Orphan("person_clusters", "orphan_cluster_refs", "cluster_id", "face_clusters", "id"), Repeat("person_clusters", "duplicate_links", ("person_id", "cluster_id")), Repeat("person_clusters", "shared_clusters", ("cluster_id",)),
    Count("speaker_links", "total", "true"), Count("speaker_links", "empty_speaker_name", "speaker_name IS NULL OR trim(speaker_name) = ''"), Count("speaker_links", "empty_chat_id", "chat_id IS NULL OR trim(chat_id) = ''"), Count("speaker_links", "invalid_confidence", _outside("confidence", 0, 1)),
    Orphan("speaker_links", "orphan_person_refs", "person_id", "persons", "id"), Repeat("speaker_links", "duplicate_links", ("chat_id", "speaker_name", "person_id")), Repeat("speaker_links", "shared_speakers", ("chat_id", "speaker_name")),
    Count("media_people", "total", "true"), Count("media_people", "invalid_source", _enum("source", "face_cluster", "manual")), Count("media_people", "invalid_confidence", _outside("confidence", 0, 1)), Count("media_people", "invalid_hidden_flag", f"is_hidden {_FLAGS}"), Spread("media_people", "source_counts", "source"),
    Orphan("media_people", "orphan_media_refs", "media_id", "media", "id"), Orphan("media_people", "orphan_person_refs", "person_id", "persons", "id"), Orphan("media_people", "orphan_face_refs", "face_id", "faces", "id"), Repeat("media_people", "duplicate_links", ("media_id", "person_id", "source", "face_id")),
    Count("event_people", "total", "true"), Count("event_people", "invalid_source", _enum("source", "face", "chat", "combined", "manual")), Count("event_people", "invalid_confidence", _outside("confidence", 0, 1)), Count("event_people", "invalid_hidden_flag", f"is_hidden {_FLAGS}"), Spread("event_people", "source_counts", "source"),
    Orphan("event_people", "orphan_event_refs", "event_id", "life_events", "id"), Orphan("event_people", "orphan_person_refs", "person_id", "persons", "id"), Repeat("event_people", "duplicate_links", ("event_id", "person_id", "source")),
]
#: Metrics that must be 0 for the strict verdict.
STRICT = tuple(
    f"{r.table}.{r.metric}" for r in RULES
    if isinstance(r, Orphan) or (isinstance(r, Repeat) and r.metric in ("duplicate_id_groups", "duplicate_links", "duplicate_member", "duplicate_groups")) or (isinstance(r, Count) and r.metric.startswith("invalid"))
)


def sql(rules: list) -> str:
    """The same metrics in SQL, each by a statement of its own."""
    out = []
    for r in rules:
        name = f"{r.table}.{r.metric}"
        if isinstance(r, Count):
            out.append(f"SELECT '{name}' AS metric, count(*) AS n FROM {r.table} WHERE {r.condition}")
        elif isinstance(r, Orphan):
            out.append(f"SELECT '{name}', count(*) FROM {r.table} c WHERE ({r.condition}) AND c.{r.key} IS NOT NULL AND NOT EXISTS (SELECT 1 FROM {r.parent} p WHERE p.{r.parent_key} = c.{r.key})")
        elif isinstance(r, Repeat):
            out.append(f"SELECT '{name}', count(*) FROM (SELECT 1 FROM {r.table} GROUP BY {', '.join(r.keys)} HAVING count(*) > 1)")
        else:
            out.append(f"SELECT concat('{name}:', coalesce(cast({r.column} AS VARCHAR),'null')), count(*) FROM {r.table} GROUP BY 1")
    return " UNION ALL ".join(out)
