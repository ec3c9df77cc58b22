"""Clusters of places on dense and wrapped grids, and samples with coverage, against plain loops."""

import math
import random
import time

import pytest

from kronoleaf.operators import clusters, geo, people, ranking
from kronoleaf.plans import catalog


def metres(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def plain_leaders(points, radius):
    """Each point against all centres."""
    lat, lon, n, names, out = [], [], [], [], {}
    for i, _, y, x in sorted(points, key=lambda p: (p[1], p[0])):
        near = min(((metres((y, x), c), k) for k, c in enumerate(zip(lat, lon, strict=True))), default=(math.inf, -1))
        k = near[1]
        if near[0] > radius:
            k = len(n)
            for own, v in ((lat, y), (lon, x), (n, 1), (names, i)):
                own.append(v)
        else:
            n[k] += 1
            lat[k] += (y - lat[k]) / n[k]
            turn = (x - lon[k] + 180) % 360 - 180 if abs(x - lon[k]) > 180 else x - lon[k]
            moved = lon[k] + turn / n[k]
            lon[k] = (moved + 180) % 360 - 180 if abs(moved) > 180 else moved
        out[i] = names[k]
    return out


@pytest.mark.parametrize(("centre", "spread"), [((35.0, 139.0), 0.004), ((-16.5, 180.0), 0.004), ((78.0, -179.999), 0.01), ((89.95, 10.0), 0.05)])
def test_leaders(spark, centre, spread):
    random.seed(4)
    wrap = lambda x: (x + 180) % 360 - 180
    points = [(f"p{i:04d}", f"2024-01-{1 + i % 28:02d}", min(90.0, centre[0] + random.gauss(0, spread)), wrap(centre[1] + random.gauss(0, spread * (1 if abs(centre[0]) < 80 else 900)))) for i in range(700)]
    got = clusters.leader_clusters(spark.createDataFrame(points, "id string, captured_at string, lat double, lon double"), 100)
    assert {r.id: r.leader for r in got.collect()} == plain_leaders(points, 100)


def test_dense_island(spark):
    """100,000 points of one island take time near their number: five times the points, well under twenty-five times the time."""
    random.seed(6)
    took = []
    for n in (20_000, 100_000):
        centres = clusters.Centres(100, 36)
        points = [(35 + random.random() * 0.2, 139 + random.random() * 0.2) for _ in range(n)]
        began = time.process_time()
        for p in points:
            centres.add(*p)
        took.append(time.process_time() - began)
        assert 5_000 < len(centres.n) < 40_000
    assert took[1] < 12 * took[0]


def test_antimeridian(spark):
    rows = [("a", "t1", 10.0, 179.9999), ("b", "t2", 10.0, -179.9999)]
    assert {r.leader for r in clusters.leader_clusters(spark.createDataFrame(rows, "id string, captured_at string, lat double, lon double"), 100).collect()} == {"a"}
    points = spark.createDataFrame([(1, 10.0, 179.9999), (2, 10.0, -179.9999), (3, 10.0, 179.0), (4, -10.0, 0.0)], "p int, lat double, lon double")
    places = spark.createDataFrame([(7, 10.0, 180.0, 50.0), (8, 10.0, -179.99, 5000.0), (9, 0.0, 0.0, 30_000_000.0)], "q int, place_lat double, place_lon double, radius_m double")
    got = {r.p: r.q for r in geo.nearest_within(points, "p", places, "q", 0.5).collect()}
    assert got == {1: 7, 2: 7, 3: 9, 4: 9}


def plain_pilot(rows, limit):
    """Slots, fill and exchange, one step at a time; rows are (id, at, flags)."""
    rows = sorted({r[0]: r for r in sorted(rows, key=lambda r: r[1], reverse=True)}.values(), key=lambda r: (r[1], r[0]))
    if len(rows) <= limit:
        chosen = list(rows)
    else:
        chosen = [rows[i] for i in sorted({round(s * (len(rows) - 1) / max(limit - 1, 1)) for s in range(limit)})]
        chosen += [r for r in rows if r not in chosen][: limit - len(chosen)]
        chosen.sort(key=lambda r: (r[1], r[0]))
    for j in range(3):
        other = next((r for r in rows if r[2][j]), None)
        if chosen and other and not any(r[2][j] for r in chosen):
            bare = [k for k, r in enumerate(chosen) if not any(r[2])]
            chosen[bare[-1] if bare else len(chosen) - 1] = other
    return sorted(r[0] for r in chosen)


@pytest.mark.parametrize("limit", [1, 2, 3, 5, 8])
def test_pilot(spark, limit):
    random.seed(limit)
    days = {f"d{n}": [(f"m{random.randrange(40):02d}", f"t{random.randrange(30):02d}", tuple(int(random.random() < p) for p in (0.1, 0.15, 0.08))) for _ in range(n)] for n in (1, 2, 3, 5, 9, 14, 30)}
    table = spark.createDataFrame([(d, i, at, *f) for d, rows in days.items() for i, at, f in rows], "d string, id string, at string, a int, b int, c int").dropDuplicates(["d", "id", "at"])
    days = {d: [(r.id, r.at, (r.a, r.b, r.c)) for r in table.where(table.d == d).collect()] for d in days}
    got = ranking.pilot(table.checkpoint(), ["d"], ["at"], "id", ["a", "b", "c"], limit).collect()
    for d, rows in days.items():
        assert sorted(r.id for r in got if r.d == d) == plain_pilot(rows, limit)


def test_pilot_images(spark):
    rows = catalog.queries()["pilot_images"](spark, "/root/testdata/sf0.001").collect()
    assert len(rows) > 30 and max(sum(r.date == d for r in rows) for d in {r.date for r in rows}) <= 8


def test_people_of_media_travel_packed(spark):
    """Links are opened after the exchange by event: no exchange carries a row a link, event and count."""
    evidence = spark.createDataFrame([("e1", "photo", "m1"), ("e1", "photo", "m1"), ("e1", "photo", "m2"), ("e2", "photo", "m1"), ("e2", "line", "m2"), ("e9", "photo", "m1")], "event_id string, evidence_type string, evidence_id string")
    rows = [("m1", f"p{i % 300}", f"f{i}", "manual", 1) for i in range(2500)] + [("m2", "p1", "f1", "manual", 1), ("m2", "p2", None, "manual", 1), ("m2", "p3", "f9", "manual", 0), ("m2", "gone", "f9", "manual", 1)]
    links = spark.createDataFrame(rows, "media_id string, person_id string, face_id string, source string, is_verified int")
    events, persons = spark.createDataFrame([("e1",), ("e2",)], "id string"), spark.createDataFrame([(f"p{i}",) for i in range(300)], "id string")
    want = {}
    for e, m in (("e1", "m1"), ("e1", "m2"), ("e2", "m1")):
        for medium, p, f, _, ok in rows:
            if medium == m and ok and p != "gone":
                want.setdefault((e, p), (set(), set()))
                want[e, p][0].add(m)
                want[e, p][1].update({f} - {None})
    got = people.events_by_faces(evidence, events, links, persons)
    assert {(r.event_id, r.person_id): (r.media_count, r.face_count) for r in got.collect()} == {k: (len(m), len(f)) for k, (m, f) in want.items()}
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(event_id" in x and "person_id" in x]


@pytest.mark.parametrize("few", [0, 500_000])
def test_people_of_events_are_dealt_by_event_once(spark, monkeypatch, few):
    """Faces and lines of odd ids, repeated rows and shared faces, against a plain version; no pair of an event and a person is exchanged."""
    random.seed(11)
    monkeypatch.setattr(people, "FEW", few)
    odd = ['p"1', "p,2", "p\\3", "p\n4", "", "人5", "null", "p'7"]
    who = [*odd, *(f"p{i}" for i in range(30))]
    links = [(f"m{random.randrange(12)}", random.choice([*who, "gone"]), random.choice(["f,1", 'f"2', "", None, *(f"f{i}" for i in range(9))]), random.choice(["manual", "face_cluster", "other"]), random.randrange(3) > 0) for _ in range(700)]
    links += [("m0", f"p{i % 30}", f"f{i}", "manual", True) for i in range(2300)] + [(None, "p1", "f1", "manual", True), ("m1", None, "f1", "manual", True)]
    evidence = [(f"e{random.randrange(25)}", random.choice(["photo", "photo", "line", "ocr"]), f"{random.choice('ml')}{random.randrange(14)}") for _ in range(260)] + [("e1", "photo", None), (None, "photo", "m1"), ("gone", "photo", "m1"), ("gone", "line", "l1")]
    messages = [(f"l{i}", f"c{i % 2}", f"s{i % 4}") for i in range(12)]
    speakers = [(f"c{i % 2}", f"s{i % 4}", who[i % 9], i % 5 > 0, i / 10) for i in range(24)]
    make = spark.createDataFrame
    tables = [
        make(evidence * 2, "event_id string, evidence_type string, evidence_id string"), make([(f"e{i}",) for i in range(24)] + [("e1",)], "id string"),
        make([(m, p, f, s, int(ok)) for m, p, f, s, ok in links * 2], "media_id string, person_id string, face_id string, source string, is_verified int"),
        make(messages, "id string, chat_id string, sender string"), make([(c, s, p, int(ok), x) for c, s, p, ok, x in speakers], "chat_id string, speaker_name string, person_id string, is_verified int, confidence double"),
        make([(p,) for p in who], "id string"),
    ]
    media, faces, lines = ({} for _ in range(3))
    for e, kind, x in evidence:
        if e in {f"e{i}" for i in range(24)}:
            for m, p, f, s, ok in links if kind == "photo" else []:
                if m == x is not None and ok and s != "other" and p in who:
                    media.setdefault((e, p), set()).add(m)
                    faces.setdefault((e, p), set()).update({f} - {None})
            for i, c, name in messages if kind == "line" else []:
                for chat, s, p, ok, _ in speakers:
                    if (i, c, name) == (x, chat, s) and ok:
                        lines.setdefault((e, p), set()).add(i)
    want = [(*k, "face_cluster", 0.6, len(faces[k]), len(m), 0) for k, m in media.items()] + [(*k, "line_speaker", 0.7, len(x), 0, len(x)) for k, x in lines.items()]
    want += [(*k, "combined", 0.9, len(faces[k]) + len(lines[k]), len(media[k]), len(lines[k])) for k in media.keys() & lines.keys()]
    got = people.event_people(*tables)
    assert got.columns == ["event_id", "person_id", "source", "confidence", "evidence_count", "media_count", "line_count"]
    assert sorted(map(tuple, got.collect())) == sorted(want) and any(r[2] == "combined" for r in want)
    plan = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[-1]
    assert not [x for x in plan.splitlines() if "Exchange hashpartitioning(event_id" in x and "person_id" in x]


def test_repeated_rows_of_a_table(spark):
    """A table without its DISTINCT holds the same rows, some of them more than once."""
    from kronoleaf.plans import domain

    load = lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")
    once, rows = domain.table(load, "media_people"), domain.table(load, "media_people", repeated=True)
    assert rows.count() == load("lineitem").count() and rows.exceptAll(once).join(once, once.columns, "left_anti").count() == 0 and rows.distinct().count() == once.count()
