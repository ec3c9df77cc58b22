"""Changes of private data: what each would touch, and doing it as one commit with its audit."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from ..sources.versioned import Versioned

#: Tables with a person_id, from which a person can be detached.
PERSON_TABLES = ["person_clusters", "aliases", "speaker_links", "media_people", "event_people"]
#: Privacy levels and categories of places.
LEVELS = ["normal", "private", "sensitive", "public_alias", "public_hidden"]
Tables = Callable[[str], DataFrame]


@dataclass
class Change:
    """Tables as they will be, and how many rows of each are touched; nothing has happened yet."""

    action: str
    target_type: str
    target_id: str
    tables: dict[str, DataFrame]
    counts: dict[str, int] = field(default_factory=dict)


def _counted(hits: dict[str, DataFrame]) -> dict[str, int]:
    """Rows of each, in one job."""
    some = reduce(DataFrame.union, [df.select(F.lit(name).alias("name")) for name, df in hits.items()])
    got = {r.name: r.n for r in some.groupBy("name").agg(F.count("*").alias("n")).collect()}
    return {name: got.get(name, 0) for name in hits}


def _required(table: DataFrame, column: str, value: str, what: str) -> None:
    if table.where(F.col(column) == value).isEmpty():
        raise ValueError(f"{what} not found: {value}")


def _set(table: DataFrame, test: Column, **values) -> DataFrame:
    """Columns that the table has, set where the test holds."""
    test = F.coalesce(test, F.lit(False))
    return table.withColumns({c: F.when(test, v if isinstance(v, Column) else F.lit(v)).otherwise(F.col(c)) for c, v in values.items() if c in table.columns})


def detach_person(tables: Tables, person_id: str, names: list[str] | None = None) -> Change:
    """Every link with a person goes; the person stays."""
    _required(tables("persons"), "id", person_id, "person")
    own = {n: tables(n) for n in names or PERSON_TABLES}
    hit = lambda df: F.coalesce(F.col("person_id") == person_id, F.lit(False))
    return Change("detach_person", "person", person_id, {n: df.where(~hit(df)) for n, df in own.items()}, _counted({n: df.where(hit(df)) for n, df in own.items()}))


def delete_person(tables: Tables, person_id: str) -> Change:
    """The person is marked deleted, hidden and of no use for searches; links with media and events are hidden."""
    _required(tables("persons"), "id", person_id, "person")
    gone = _set(tables("persons"), F.col("id") == person_id, is_deleted=1, is_hidden=1, searchable=0, event_usable=0, is_verified=0)
    links = {n: tables(n) for n in ("media_people", "event_people")}
    changed = {n: _set(df, F.col("person_id") == person_id, is_hidden=1) for n, df in links.items()}
    return Change("delete_person", "person", person_id, {"persons": gone} | changed, _counted({n: df.where(F.col("person_id") == person_id) for n, df in links.items()}))


def delete_face_data(tables: Tables, face_id: str, crop: bool = False, embedding: bool = False) -> Change:
    """A face's crop is forgotten and the face hidden, or its vectors go, or both."""
    if not crop and not embedding:
        raise ValueError("say whether the crop, the embedding or both are to go")
    _required(tables("faces"), "id", face_id, "face")
    changed, hits = {}, {}
    if crop:
        faces = tables("faces")
        changed["faces"] = _set(faces, F.col("id") == face_id, crop_path=F.lit(None).cast("string"), thumbnail_path=F.lit(None).cast("string"), is_hidden=1)
        hits["faces"] = faces.where(F.col("id") == face_id)
    if embedding:
        vectors = tables("face_vectors")
        hit = F.coalesce(F.col("face_id") == face_id, F.lit(False))
        changed["face_vectors"], hits["face_vectors"] = vectors.where(~hit), vectors.where(hit)
    return Change("delete_face_crop" if crop else "delete_face_embedding", "face", face_id, changed, _counted(hits))


def hide_place(tables: Tables, place_id: str) -> Change:
    """A place is hidden, not searchable, and of the level that is never shown."""
    _required(tables("places"), "id", place_id, "place")
    hit = F.col("id") == place_id
    return Change("hide_place", "place", place_id, {"places": _set(tables("places"), hit, hidden=1, searchable=0, privacy_level="public_hidden")}, _counted({"places": tables("places").where(hit)}))


def link_place(tables: Tables, place_id: str, cluster_id: str) -> Change:
    """A place stands for a cluster; both must be there."""
    _required(tables("places"), "id", place_id, "place")
    _required(tables("place_clusters"), "id", cluster_id, "cluster")
    hit = F.col("id") == place_id
    return Change("link_place", "place", place_id, {"places": _set(tables("places"), hit, cluster_id=cluster_id)}, _counted({"places": tables("places").where(hit)}))


def unlink_cluster(tables: Tables, cluster_id: str) -> Change:
    """No place stands for the cluster any longer; nothing is refused where none did."""
    hit = F.col("cluster_id") == cluster_id
    places = tables("places")
    return Change("unlink_cluster", "cluster", cluster_id, {"places": _set(places, hit, cluster_id=F.lit(None).cast("string"))}, _counted({"places": places.where(hit)}))


def set_privacy(tables: Tables, place_id: str, level: str) -> Change:
    """A place's level, one of the known ones."""
    if level not in LEVELS:
        raise ValueError(f"level must be one of {', '.join(LEVELS)}")
    _required(tables("places"), "id", place_id, "place")
    hit = F.col("id") == place_id
    return Change("set_privacy", "place", place_id, {"places": _set(tables("places"), hit, privacy_level=level)}, _counted({"places": tables("places").where(hit)}))


def execute(store: Versioned, make: Callable[[Tables], Change], yes: bool = False) -> tuple[Change, int | None]:
    """Make a change against the last version of a store, and commit it if `yes`: the change, and the new version or none.

    A change that another writer has overtaken raises and leaves nothing behind.
    """
    base = store.version()
    change = make(lambda name: store.read(name, base))
    if not yes:
        return change, None
    return change, store.commit(change.tables, change.action, change.target_type, change.target_id, change.counts, made_from=base)


def detach_plan(tables: dict[str, DataFrame]) -> DataFrame:
    """(person_id, table, n): what detaching each person would remove, for all people at once."""
    rows = [df.where("person_id is not null").groupBy("person_id").agg(F.count("*").alias("n")).select("person_id", F.lit(name).alias("table"), "n") for name, df in tables.items()]
    return reduce(DataFrame.union, rows)
