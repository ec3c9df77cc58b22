"""Versioned tables and private changes: one commit, one audit row, nothing in between."""

import json

import pytest

from kronoleaf.operators import actions
from kronoleaf.sources.versioned import Conflict, Versioned


@pytest.fixture
def store(spark, tmp_path):
    t = {
        "persons": ([("p1", 0, 0, 1), ("p2", 0, 0, 1)], "id string, is_deleted int, is_hidden int, searchable int"),
        "media_people": ([("m1", "p1", 0), ("m2", "p1", 0), ("m3", "p2", 0), ("m4", None, 0)], "media_id string, person_id string, is_hidden int"),
        "event_people": ([("e1", "p1", 0)], "event_id string, person_id string, is_hidden int"),
        "speaker_links": ([("c", "p2")], "chat_id string, person_id string"), "aliases": ([("p1", "x")], "person_id string, alias string"), "person_clusters": ([("p1", "f1")], "person_id string, cluster_id string"),
        "faces": ([("f1", "a.png", 0), ("f2", "b.png", 0)], "id string, crop_path string, is_hidden int"), "face_vectors": ([("f1", [1.0]), ("f1", [2.0]), ("f2", [3.0])], "face_id string, v array<double>"),
        "places": ([("a", "c1", 0, 1, "normal"), ("b", None, 0, 1, None)], "id string, cluster_id string, hidden int, searchable int, privacy_level string"), "place_clusters": ([("c1",), ("c2",)], "id string"),
    }
    s = Versioned(spark, str(tmp_path / "store"))
    assert s.version() == 0 and s.audit().count() == 0
    s.commit({n: spark.createDataFrame(rows, schema) for n, (rows, schema) in t.items()}, "load")
    return s


def rows(store, name):
    return sorted(map(tuple, store.read(name).collect()), key=repr)


def test_detach(store):
    plan, version = actions.execute(store, lambda t: actions.detach_person(t, "p1"))
    assert version is None and store.version() == 1 and len(rows(store, "media_people")) == 4
    assert plan.counts == {"person_clusters": 1, "aliases": 1, "speaker_links": 0, "media_people": 2, "event_people": 1}
    done, version = actions.execute(store, lambda t: actions.detach_person(t, "p1"), yes=True)
    assert version == 2 and rows(store, "media_people") == [("m3", "p2", 0), ("m4", None, 0)] and rows(store, "aliases") == [] and len(rows(store, "persons")) == 2
    last = store.audit().collect()[-1]
    assert (last.action, last.target_id, json.loads(last.details)) == ("detach_person", "p1", done.counts)
    assert store.read("media_people", 1).count() == 4
    with pytest.raises(ValueError, match="person not found"):
        actions.execute(store, lambda t: actions.detach_person(t, "p9"), yes=True)
    assert store.version() == 2


def test_delete_and_hide(store):
    actions.execute(store, lambda t: actions.delete_person(t, "p1"), yes=True)
    assert rows(store, "persons") == [("p1", 1, 1, 0), ("p2", 0, 0, 1)] and [r[2] for r in rows(store, "media_people")] == [1, 1, 0, 0]
    actions.execute(store, lambda t: actions.hide_place(t, "b"), yes=True)
    assert rows(store, "places")[1] == ("b", None, 1, 0, "public_hidden")
    change, _ = actions.execute(store, lambda t: actions.delete_face_data(t, "f1", crop=True, embedding=True), yes=True)
    assert change.counts == {"faces": 1, "face_vectors": 2} and rows(store, "face_vectors") == [("f2", [3.0])] and ("f1", None, 1) in rows(store, "faces")
    with pytest.raises(ValueError, match="crop"):
        actions.execute(store, lambda t: actions.delete_face_data(t, "f1"))
    assert [r.action for r in store.audit().collect()] == ["load", "delete_person", "hide_place", "delete_face_crop"]


def test_links(store):
    with pytest.raises(ValueError, match="cluster not found"):
        actions.execute(store, lambda t: actions.link_place(t, "b", "c9"), yes=True)
    actions.execute(store, lambda t: actions.link_place(t, "b", "c1"), yes=True)
    change, _ = actions.execute(store, lambda t: actions.unlink_cluster(t, "c1"), yes=True)
    assert change.counts == {"places": 2} and all(r[1] is None for r in rows(store, "places"))
    with pytest.raises(ValueError, match="level"):
        actions.execute(store, lambda t: actions.set_privacy(t, "a", "loud"))
    actions.execute(store, lambda t: actions.set_privacy(t, "a", "sensitive"), yes=True)
    assert rows(store, "places")[0][4] == "sensitive"


def test_crash_and_conflict(spark, store):
    """A writer that dies before its log entry leaves no trace; of two writers from one version one wins."""
    before = rows(store, "places")

    class Dies(Versioned):
        def _entry(self, version):
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        Dies(spark, store.path).commit({"places": store.read("places").limit(0)}, "half")
    assert rows(store, "places") == before and store.version() == 1 and store.audit().count() == 1
    base = store.version()
    store.commit({}, "first", made_from=base)
    with pytest.raises(Conflict):
        store.commit({"places": store.read("places").limit(0)}, "second", made_from=base)

    class Late(Versioned):
        def version(self):
            return 1

    with pytest.raises(Conflict):
        Late(spark, store.path).commit({"places": store.read("places").limit(0)}, "third")
    assert rows(store, "places") == before and [r.action for r in store.audit().collect()] == ["load", "first"]


def test_places_travel_to_events_in_one_row_a_medium(spark):
    from kronoleaf.operators import people

    evidence = spark.createDataFrame([("e1", "photo", "m1"), ("e1", "ocr", "m2"), ("e2", "line", "m1"), (None, "vlm", "m2"), ("e3", "photo", "m9"), ("e2", "vlm", None)], "event_id string, evidence_type string, evidence_id string")
    points = spark.createDataFrame([("m1", "c1"), ("m1", "c1"), ("m1", "c2"), ("m2", "c2"), ("m2", None), (None, "c1")] + [("m9", f"d{i}") for i in range(2500)], "media_id string, cluster_id string")
    places = spark.createDataFrame([("p1", "c1"), ("p2", "c2"), ("p3", "d7")], "id string, cluster_id string")
    at = spark.createDataFrame([("e4", "p1"), ("e1", "p2")], "event_id string, place_id string")
    got = people.cluster_events(points, evidence, at, places)
    wanted = [("c1", "e1"), ("c2", "e1"), (None, "e1"), ("c1", "e2"), ("c2", "e2"), ("c2", None), (None, None), ("c1", "e4"), *[(f"d{i}", "e3") for i in range(2500)]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(wanted, key=str)
    media, events = people.propagated_places(points, evidence, places)
    assert sorted(map(tuple, media.collect()), key=str) == sorted([("m1", "p1", 0.8), ("m1", "p2", 0.8), ("m2", "p2", 0.8), ("m9", "p3", 0.8), (None, "p1", 0.8)], key=str)
    assert sorted(map(tuple, events.collect()), key=str) == sorted([("e1", "p1", 0.75), ("e1", "p2", 0.75), (None, "p2", 0.75), ("e3", "p3", 0.75)], key=str)
    for rows, pair in ((got, "cluster_id"), (events, "place_id")):  # pairs are told apart where the event is, and not exchanged
        keys = [x.split(")")[0] for x in rows._jdf.queryExecution().executedPlan().toString().split("hashpartitioning(")[1:]]
        assert not any("event_id" in k and pair in k for k in keys)


def test_people_of_a_short_text_are_cut_before_they_meet(spark):
    from kronoleaf.operators import people

    rows = [(f"p{i}", f"Name {i}", f"alias {i}", (i * 7) % 3000) for i in range(3000)] + [("p5", "Name 5", "n", 1), ("q", None, "a", None)]
    persons = spark.createDataFrame(rows, "id string, display_name string, public_name string, made long")
    aliases = spark.createDataFrame([("p2999", "name"), ("p7", "1")], "person_id string, alias string")
    speakers = spark.createDataFrame([(x,) for x in ("name", "1", "NAME 2", "Name 77", "none", " ", None)], "speaker_name string")
    got = people.ranked_suggestions(speakers, persons, aliases, "made", 4)
    want = []
    for name in ("name", "1", "NAME 2", "Name 77"):
        best = {}
        for i, shown, public, _ in rows:
            tests = (shown == name, public == name, (i, name) in {("p2999", "name"), ("p7", "1")}, shown is not None and name.lower() in shown.lower())
            if any(tests):
                best[i] = min(best.get(i, 9), tests.index(True))
        reasons = ("display_name exact match", "public_name exact match", "person alias exact match", "name contains speaker text")
        order = sorted((made, i) for i, _, _, made in rows if i in best)
        want += [(name, i, reasons[best[i]], k) for k, (_, i) in enumerate(order[:4], 1)]
    assert sorted(map(tuple, got.collect())) == sorted(want)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert "dense_rank(created" in plan and "Partial" in "".join(x for x in plan.splitlines() if "WindowGroupLimit" in x and "dense_rank" in x)
