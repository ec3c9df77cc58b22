"""Rules whose order or dialect keeps them out of SQL, against small plain versions and golden facts."""

import math
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from kronoleaf.functions import redaction as rd
from kronoleaf.operators import clusters, events, geo, integrity, people, ranking, search, upkeep
from kronoleaf.plans import catalog, construction, domain
from kronoleaf.sources import chat, files
from kronoleaf.streaming import windows

SF = "/root/testdata/sf0.001"


def tables(spark):
    load = lambda n: spark.read.parquet(f"{SF}/{n}.parquet")
    return lambda n: domain.table(load, n) if n in domain.TABLES else load(n)


def distance(a, b):
    p, q = math.radians(a[0]), math.radians(b[0])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6_371_000 * math.atan2(math.sqrt(h), math.sqrt(1 - h))


def plain_clusters(items, c):
    """Session by session, then merge by merge, as the rules are stated; {(kind, id): cluster}."""
    sessions = []
    for kind, gap in (("photo", c.photo_gap), ("line", c.line_gap)):
        own = []
        for r in sorted((r for r in items if r["kind"] == kind), key=lambda r: (r["at"], r["id"])):
            here = (r["gps_lat"], r["gps_lon"]) if r["gps_lat"] is not None else None
            late = own and (r["at"] - own[-1][-1]["at"]).total_seconds() >= gap * 60
            located = [(x["gps_lat"], x["gps_lon"]) for x in own[-1] if x["gps_lat"] is not None] if own else []
            if not own or late or (here and located and min(distance(here, x) for x in located) > c.far_metres):
                own.append([])
            own[-1].append(r)
        sessions += own
    sessions.sort(key=lambda s: (s[0]["at"], s[-1]["at"]))
    merged = []
    for s in sessions:
        last = merged[-1] if merged else None
        if last:
            kinds = {r["kind"] for r in last}
            end, start = max(r["at"] for r in last), s[0]["at"]
            if (len(kinds) > 1 or s[0]["kind"] not in kinds) and (start - end).total_seconds() <= c.merge_window * 60:
                last += s
                continue
        merged.append(list(s))
    return {(r["kind"], r["id"]): n for n, m in enumerate(merged, 1) for r in m}


@pytest.mark.parametrize("config", [events.Config(), events.Config(300, 600, 240, 150.0)])
def test_clusters_of_items(spark, config):
    items = construction._items(tables(spark)).withColumn("owner", F.lit("all")).checkpoint()
    got = {(r.date, r.kind, r.id): r.cluster for r in events.with_clusters(items, ["owner"], config).collect()}
    rows = [r.asDict() for r in items.collect()]
    want = {}
    for day in {r["date"] for r in rows}:
        want |= {(day, *k): n for k, n in plain_clusters([r for r in rows if r["date"] == day], config).items()}
    assert got == want and max(want.values()) > 3


def test_messages_and_photos_become_one_event(spark):
    media = spark.createDataFrame([("media_a", "a.jpg", "2025-01-02T18:05:00", None, 35.0, 139.0, "c"), ("media_b", "b.jpg", "2025-01-02T18:20:00", None, 35.0001, 139.0, "c")], "id string, file_name string, captured_at string, fallback_captured_at string, gps_lat double, gps_lon double, camera_model string")
    ocr = spark.createDataFrame([("media_a", "menu", "success")], "media_id string, ocr_text string, status string")
    vlm = spark.createDataFrame([("media_b", "noodles", "noodles", "[]", "[]", "[]", True)], "media_id string, caption string, short_caption string, scene_tags_json string, food_cues_json string, activity_tags_json string, ok boolean")
    said = spark.createDataFrame([("m1", "c", "Ann", "2025-01-02T17:30:00", "hello", "text"), ("m2", "c", "Bob", "2025-01-02T17:32:00", "see you", "text")], "id string, chat_id string, sender string, sent_at string, text string, message_type string").withColumn("call_status", F.lit(None).cast("string")).withColumn("duration_sec", F.lit(None).cast("int"))
    photos = events.photo_items(events.reviewed_photos(media, vlm, F.col("ok")), ocr, {"owner": F.lit("x")})
    items = events.with_clusters(photos.unionByName(events.line_items(said, {"owner": F.lit("x")})), ["owner"])
    rows = events.drafts(items, ["owner"]).collect()
    assert len(rows) == 1 and (rows[0].n_line, rows[0].n_photo, rows[0].n_ocr, rows[0].n_vlm) == (2, 2, 1, 1)
    assert rows[0].title == "写真とLINEが残る出来事" and rows[0].confidence_hundredths == 35 + 12 + 15 + 12 + 4 + 4 and rows[0].participants == ["Ann", "Bob"]
    evidence = events.evidence_rows(items).collect()
    assert sorted(e.evidence_type for e in evidence) == ["line", "line", "ocr", "photo", "photo", "vlm"]


def test_call_day_and_photo_day(spark):
    base = dict(owner="x", date="2025-01-01", message_type=None, call_status=None, duration_sec=None, gps_lat=None, gps_lon=None, sender=None, has_ocr=False, has_vlm=False, text="", cluster=1)
    schema = "owner string, date string, kind string, id string, at timestamp_ntz, text string, message_type string, call_status string, duration_sec int, gps_lat double, gps_lon double, sender string, has_ocr boolean, has_vlm boolean, cluster int"
    row = lambda **k: tuple((base | k)[c.split()[0]] for c in schema.split(", "))
    t = datetime(2025, 1, 1, 10)
    calls = [row(kind="line", id=f"c{i}", at=t, message_type="text", call_status=s, duration_sec=d, text="☎") for i, (s, d) in enumerate((("completed", 638), ("completed", 5174), ("missed", None), ("unanswered", None)))]
    photos = [row(kind="photo", id=f"p{i}", at=t, gps_lat=35.0, gps_lon=139.0, cluster=2) for i in range(3)]
    got = {r.cluster: r for r in events.drafts(spark.createDataFrame(calls + photos, schema), ["owner"]).collect()}
    assert got[1].title == "通話・連絡" and (got[1].n_calls, got[1].n_open_calls, got[1].call_seconds) == (2, 2, 5812) and "通話時間合計は約97分です。" in got[1].summary
    assert got[2].title == "位置情報付き写真の記録" and got[2].gps_lat == 35.0 and got[2].confidence_hundredths == 35 + 12 + 12 + 4


def test_built_events_have_unique_ids_and_stay_the_same(spark):
    once, twice = ({r.event_id for r in catalog.queries()["built_events"](spark, SF).collect()} for _ in range(2))
    assert once == twice and len(once) == catalog.queries()["built_events"](spark, SF).count()


def test_events_of_many_small_days_stream_through_tasks(spark):
    """Days of people stream through tasks, without a call of Python a group; evidence has the ids of its events, whole for null owners."""
    built, evidence = (catalog.queries()[n](spark, SF) for n in ("built_events", "built_evidence"))
    assert all("FlatMapGroups" not in d._jdf.queryExecution().toString() for d in (built, evidence))
    items = construction._items(tables(spark)).withColumn("owner", F.when(F.col("id").endswith("3"), F.col("owner"))).checkpoint()
    rows = events.with_clusters(items, ["owner"])
    assert rows.count() == items.count() and rows.where("owner is null").count() == items.where("owner is null").count() > 0
    by, ids = ["owner", "date", "cluster"], events.with_event_ids(rows, ["owner"])
    assert {tuple(r) for r in ids.select(*by, "event_id").distinct().collect()} == {tuple(r) for r in events.drafts(rows, ["owner"]).select(*by, "event_id").collect()}


def test_leader_clusters(spark):
    rng = np.random.default_rng(5)
    centres = [(35.0, 139.0), (35.0, 139.0016), (35.0008, 139.0008), (36.0, 140.0), (-12.5, -77.0)]
    points = [(f"p{i:03d}", f"2024-01-{1 + i % 28:02d}", float(centres[i % 5][0] + rng.normal() * 4e-4), float(centres[i % 5][1] + rng.normal() * 4e-4)) for i in range(300)]
    want, groups = {}, []
    for i, at, lat, lon in sorted(points, key=lambda p: (p[1], p[0])):
        near = min(((distance((lat, lon), g[1]), n) for n, g in enumerate(groups)), default=(math.inf, -1))
        if near[0] <= 100:
            g = groups[near[1]]
            g[2].append((lat, lon))
            g[1] = tuple(np.mean(g[2], 0))
        else:
            groups.append([i, (lat, lon), [(lat, lon)]])
            g = groups[-1]
        want[i] = g[0]
    df = spark.createDataFrame(points, "id string, captured_at string, lat double, lon double")
    assert {r.id: r.leader for r in clusters.leader_clusters(df, 100).collect()} == want and len(groups) > 8
    three = [("a", "m1", "2024-01-01", 35.0, 139.0), ("b", "m2", "2024-01-01", 35.0003, 139.0), ("c", "m3", "2024-01-02", 35.0, 139.0003), ("d", "m4", "2024-01-02", 36.0, 139.0)]
    got = clusters.place_clusters(spark.createDataFrame(three, "id string, media_id string, captured_at string, lat double, lon double"), 80, 3).collect()
    assert [(r.cluster_id, r.point_count) for r in got] == [("place_cluster_001", 3)]


def test_components(spark):
    pairs = [(i, i + 1) for i in range(60)] + [(100, 101), (103, 102), (101, 102), (7, 7)]
    nodes = spark.createDataFrame([(i,) for i in [*range(61), 100, 101, 102, 103, 500]], "id long")
    got = {r.id: r.root for r in clusters.components(nodes, spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(61)} | dict.fromkeys((100, 101, 102, 103), 100) | {500: 500}


def test_three_faces_make_one_cluster(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.1410673]), (3, [0.0, 1.0])], "id long, v array<double>")
    got = clusters.vector_clusters(v, spark.createDataFrame([(1, 2)], "a long, b long"), 2).collect()
    assert {r.id for r in got} == {1, 2} and all(0 <= r.distance < 0.01 for r in got) and sum(r.is_representative for r in got) == 1


def test_coordinates_have_exact_decimals(spark):
    rng = np.random.default_rng(9)
    values = [0.0, 0.0005, 139.0005, 35.0015, -0.0005, -12.34567, 2.5e-4, 0.00049999, 179.9999999, *map(float, rng.uniform(-180, 180, 300).round(4)), *map(float, rng.uniform(-90, 90, 100))]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", *[geo.fixed(F.col("v"), d).alias(f"d{d}") for d in (3, 4, 6)])
    for r in df.collect():
        for d in (3, 4, 6):
            want = f"{r.v:.{d}f}"
            assert r[f"d{d}"] == (want[1:] if float(want) == 0 and want[0] == "-" else want)


def test_hashed_vectors(spark):
    import hashlib

    text = "Ab 日本 ab"
    want = np.zeros(384)
    flat = "".join(text.lower().split())
    for n in (1, 2, 3):
        for i in range(len(flat) - n + 1):
            d = hashlib.sha256(flat[i : i + n].encode()).digest()
            want[int.from_bytes(d[:4], "big") % 384] += 1 if d[4] % 2 == 0 else -1
    got = np.zeros(384)
    for r in clusters.text_vectors(spark.createDataFrame([(1, text), (2, "  "), (3, None)], "id long, t string"), "id", "t").collect():
        assert r.id == 1
        got[r["index"]] = r.value
    assert np.allclose(got, want / np.linalg.norm(want))


def test_vector_bytes_of_wrong_length_are_null(spark):
    df = spark.createDataFrame([(bytearray(b"\x00\x00\x80\x3f"), 1), (bytearray(b"\x00\x00"), 1), (None, 1), (bytearray(b"\x00\x00\x80\x3f"), 2)], "b binary, d int")
    assert [r[0] for r in df.select(clusters.decoded(F.col("b"), F.col("d"))).collect()] == [[1.0], None, None, None]


def test_search_terms_and_keywords(spark):
    texts = ["新宿に行ったのはいつ？", "ラーメンを食べた日はいつ", "いつ", "", "カフェ した", "昨日ラーメンを食べた？", "2024年1月5日に何してた？"]
    df = spark.createDataFrame([(t,) for t in texts], "q string").select("q", search.search_terms(F.col("q")).alias("t"), search.keyword(F.col("q")).alias("k"))
    got = {r.q: (r.t, r.k) for r in df.collect()}
    assert got["新宿に行ったのはいつ？"][0] == ["新宿", "行った"] or got["新宿に行ったのはいつ？"][0][0] == "新宿"
    assert got["いつ"][0] == ["いつ"] and got[""][0] == [] and got["昨日ラーメンを食べた？"][1] == "ラーメン" and got["2024年1月5日に何してた？"][1] is None
    assert got["ラーメンを食べた日はいつ"][0][0] == "ラーメン"


EXPORT = """﻿preamble
2025/1/2(Thu)
9:05\tAnn\t hello
second line

10:00\tBob\t[写真]
not part of it
10:01\t\tno sender
25:61\tBob\tbad time
after it
2025/13/40
2025-01-03 Fri
0:07\tLINE\tjoined
11:00\tAnn\t不在着信
11:01\tAnn\t[odd]
11:02\tAnn\t
11:03\tAnn\t[ファイル] a.pdf
2025.1.4
12:00\tAnn\tx
[photo]
"""


def test_chat_export(spark, tmp_path):
    folder = tmp_path / "Family"
    folder.mkdir()
    (folder / "a.txt").write_text(EXPORT)
    lines = chat.read_lines(spark, str(folder))
    rows = {r.line_number: r for r in chat.parse(lines).collect()}
    assert {n: r.message_type for n, r in rows.items()} == {3: "text", 6: "image", 13: "system", 14: "system", 15: "unknown", 16: "unknown", 17: "file", 19: "text"}
    assert rows[3].text == "hello\nsecond line" and rows[3].sent_at == datetime(2025, 1, 2, 9, 5) and rows[13].sent_at == datetime(2025, 1, 3, 0, 7) and rows[19].text == "x\n[photo]"
    want = [(1, "unparsed line"), (7, "unparsed line after special message"), (8, "unparsed line after special message"), (9, "invalid datetime"), (10, "unparsed line"), (11, "unparsed line")]
    assert sorted((r.line_number, r.reason) for r in chat.warnings(lines).collect()) == want
    import hashlib

    seed = "\x1f".join(["a.txt", "2025-01-02T09:05:00+09:00", "Ann", "hello\nsecond line"])
    assert rows[3].id == "line_msg_" + hashlib.sha256(seed.encode()).hexdigest() and rows[3].chat_id == "line_" + hashlib.sha256(b"Family").hexdigest()[:16]


def test_chat_id_of_generic_folders(spark):
    df = spark.createDataFrame([("/x/exports/talk one.txt",), ("/x/Friends/talk.txt",)], "p string").select(chat.chat_id(F.col("p")).alias("c"))
    a, b = (r.c for r in df.collect())
    import hashlib

    assert a == "line_" + hashlib.sha256(b"talk one").hexdigest()[:16] and b == "line_" + hashlib.sha256(b"Friends").hexdigest()[:16]


def test_ocr_redaction(spark):
    text = "see https://a.b/c or www.x.org, mail a.b+c@d.co, call 03-1234-5678, 〒123-4567 東京都千代田区丸の内1-2-3, no 12345678    end"
    got = spark.createDataFrame([(text,), (None,), ("x" * 30,)], "t string").select(rd.redact_ocr(F.col("t"), 200).alias("r"), rd.redact_ocr(F.col("t"), 10).alias("s")).collect()
    assert got[0].r == "see [URL] or [URL] mail [EMAIL], call [PHONE], [POSTAL_CODE] [ADDRESS], no [NUMBER]\nend" and got[1].r == "" and got[2].s == "x" * 9 + "…"


def test_report_redaction_and_numbers(spark):
    df = spark.createDataFrame([(1, "at 35.6812, 139.7671 media_abcdefgh123 in /home/me/x.jpg"), (2, "plain  text")], "i long, t string")
    assert [r[0] for r in df.orderBy("i").select(rd.redact_report(F.col("t"))).collect()] == ["at [GPS] MEDIA_ID_REDACTED in [PATH]", "plain text"]
    names = spark.createDataFrame([(1, "Bob"), (2, "Ann"), (3, "Bob"), (4, None)], "i long, name string")
    assert [r.label for r in rd.numbered(names, "i", "name", "PERSON").orderBy("i").collect()] == ["PERSON_1", "PERSON_2", "PERSON_1", ""]


def test_json_repair(spark):
    texts = ['```json\n{"a": [1, 2,],}\n```', 'so: {"a": {"b": 1} ok', '{"a": 1}', "none", None, '{"a": [1, {"b": 2']
    got = spark.createDataFrame([(t,) for t in texts], "t string").select(rd.repaired_json(F.col("t")).alias("j")).collect()
    assert [r.j for r in got] == ['{"a":[1,2]}', '{"a":{"b":1}}', '{"a":1}', None, None, '{"a":[1,{"b":2}]}'] or got[1].j is None


def test_dates_of_questions(spark):
    from kronoleaf.functions import dates

    want = {
        "2024年1月5日に何してた": ("2024-01-05", "2024-01-05"), "2024/2/30は": None, "2024年2月のまとめ": ("2024-02-01", "2024-02-29"), "2024-03": ("2024-03-01", "2024-03-31"), "3月4日": ("2023-03-04", "2023-03-04"),
        "昨日": ("2025-05-14", "2025-05-14"), "今月": ("2025-05-01", "2025-05-31"), "先月": ("2025-04-01", "2025-04-30"), "最近": ("2025-04-15", "2025-05-15"), "去年の夏": ("2024-06-01", "2024-08-31"), "去年の2月": ("2024-02-01", "2024-02-29"), "去年": ("2024-01-01", "2024-12-31"), "今年": ("2025-01-01", "2025-12-31"), "x": None,
    }
    df = spark.createDataFrame([(q,) for q in want], "q string").select("q", dates.date_range(F.col("q"), F.lit("2025-05-15").cast("date"), 2023).alias("r"))
    for r in df.collect():
        assert (None if r.r is None else (str(r.r.start), str(r.r.end))) == want[r.q], r.q


def test_files(spark, tmp_path):
    for name in ("a.jpg", "sub/b.PNG", "c.heic", "d.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_bytes(name.encode())
    got = files.images(spark, str(tmp_path))
    assert sorted(r.file_name for r in got.collect()) == ["a.jpg", "b.PNG"] and all(r.id.startswith("media_") for r in got.collect())
    known = spark.createDataFrame([("m1", str(tmp_path / "a.jpg")), ("m2", str(tmp_path / "gone.jpg"))], "id string, file_path string")
    assert [r.id for r in files.missing(known, files.listing(spark, str(tmp_path)), "file_path").collect()] == ["m2"]
    rows = files.dictionary(spark, "places:\n  - id: a\n    name: A\n  - id: b\n    name: B\n", "places", "id string, name string")
    assert [tuple(r) for r in rows.collect()] == [("a", "A"), ("b", "B")]


def test_orphan_evidence_is_reported(spark):
    t = {"evidence": spark.createDataFrame([("e1", "photo"), ("e9", "photo")], "event_id string, evidence_type string"), "life_events": spark.createDataFrame([("e1",)], "id string")}
    rule = integrity.Orphan("evidence", "orphan_event_refs", "event_id", "life_events", "id")
    assert integrity.report(t.__getitem__, [rule]).first().n == 1 and integrity.sample(t.__getitem__, rule, "event_id").first()[0] == "e9"


def test_integrity_counts_references_without_joins(spark):
    """All references meet the keys of their parents in one grouping: no row of a child is exchanged for a join, and a frequent key is counted before it is sent."""
    t = {
        "child": spark.createDataFrame([(1, "a", 1.0), (1, "a", -0.0), (2, None, None), (None, "z", 0.0), (9, "z", 7.0)] + [(9, "a", 1.0)] * 5000, "p int, q string, x double"),
        "other": spark.createDataFrame([("9",), ("1",), (None,)], "p string"),
        "parent": spark.createDataFrame([(1,), (1,), (2,), (None,)], "id long"),
        "named": spark.createDataFrame([("a", 0.0), ("b", 1.0)], "id string, x double"),
        "empty": spark.createDataFrame([], "p int, q string"),
    }
    I = integrity  # noqa: E741
    rules = [
        I.Orphan("child", "p", "p", "parent", "id"), I.Orphan("child", "few", "p", "parent", "id", "x > 5"), I.Orphan("child", "unsure", "p", "parent", "id", "q = 'z'"), I.Orphan("child", "q", "q", "named", "id"), I.Orphan("child", "x", "x", "named", "x"),
        I.Orphan("child", "none", "p", "empty", "p"), I.Orphan("other", "p", "p", "named", "id"), I.Orphan("empty", "p", "p", "parent", "id"), I.Count("child", "z", "q = 'z'"), I.Count("empty", "all", "true"), I.Spread("child", "by", "q"), I.Spread("empty", "by", "q"),
        I.Repeat("child", "again", ("p",)), I.Repeat("child", "pq", ("p", "q")), I.Repeat("empty", "again", ("p",)), I.Repeat("parent", "id", ("id",)),
    ]
    got = integrity.report(t.__getitem__, rules)
    assert {r.metric: r.n for r in got.collect()} == {
        "child.p": 5001, "child.few": 1, "child.unsure": 1, "child.q": 2, "child.x": 1, "child.none": 5004, "other.p": 2, "empty.p": 0, "child.z": 2, "empty.all": 0, "child.by:a": 5002, "child.by:z": 2, "child.by:null": 1, "child.again": 2, "child.pq": 2, "empty.again": 0, "parent.id": 1,
    }
    plan = integrity.report(t.__getitem__, [r for r in rules if isinstance(r, I.Orphan)])._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange") <= 4


def test_first_event_takes_evidence_as_it_is(spark):
    """Repeated evidence is not grouped by event and medium before it meets the events."""
    evidence = spark.createDataFrame([("e1", "m1"), ("e1", "m1"), ("e2", "m1"), ("e2", "m2"), ("e3", "m2"), ("e3", "m2"), ("e4", "m3"), (None, "m1"), ("e1", None)], "event_id string, evidence_id string")
    events = spark.createDataFrame([("e1", 0, 0, "2024-01-02", "09:00"), ("e2", 0, 0, "2024-01-01", "10:00"), ("e3", 1, 0, "2024-01-09", "08:00"), ("e4", 1, 1, "2024-01-01", "07:00")], "id string, is_pinned int, is_hidden int, date string, start_time string")
    got = people.first_event(evidence, events)
    assert {r.evidence_id: r.event_id for r in got.collect()} == {"m1": "e2", "m2": "e3", None: "e1"}
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 1


def test_guards(spark):
    links = spark.createDataFrame([("a", "p1"), ("b", "p2"), ("c", "p1"), ("c", "p2")], "cluster_id string, person_id string")
    assert sorted(map(tuple, upkeep.relinked(links, "a", "b").collect())) == [("a", "p2"), ("b", "p2"), ("c", "p1"), ("c", "p2")]
    with pytest.raises(ValueError, match="exactly one"):
        upkeep.relinked(links, "a", "c")
    old = spark.createDataFrame([("a", "m1"), ("z", "m2")], "id string, method string")
    new = spark.createDataFrame([("n",)], "id string")
    assert sorted(r.id for r in clusters.replaced_clusters(old, new, "m2", links).collect()) == ["a", "n"]
    with pytest.raises(ValueError, match="linked"):
        clusters.replaced_clusters(old, new, "m1", links)


def test_new_links_are_idempotent(spark):
    old = spark.createDataFrame([("m", "p", "f")], "a string, b string, c string")
    new = spark.createDataFrame([("m", "p", "f"), ("m", "q", "f"), ("m", "q", "f")], "a string, b string, c string")
    once = people.new_links(new, old, ["a", "b", "c"])
    assert once.count() == 2 and people.new_links(new, once, ["a", "b", "c"]).count() == 2
    assert people.new_links(new.limit(0), old, ["a", "b", "c"], replace=F.col("a") == "m").count() == 0


def test_strength_and_labels(spark):
    df = spark.createDataFrame([(0.8, ["vlm"], []), (0.8, ["vlm", "ocr"], []), (0.8, ["photo"], ["people_present"]), (0.5, ["line"], []), (0.1, [], [])], "s double, k array<string>, f array<string>")
    assert [r[0] for r in df.select(ranking.capped_label(F.col("s"), F.col("k"), F.col("f"))).collect()] == ["中", "高", "中", "中", "低"]
    assert [r[0] for r in df.select(ranking.with_person(F.col("s"), F.lit(0.0), True)).collect()] == [0.44, 0.44, 0.44, 0.275, 0.055]


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", datetime(2025, 1, 1, 0, 10)), (2, "b", datetime(2025, 1, 1, 1, 30)), (2, "b", datetime(2025, 1, 1, 1, 31)), (3, "a", datetime(2025, 1, 2, 2, 0))], "i long, k string, ts timestamp")
    rows.write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))

    def run(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start().awaitTermination(120)
        return spark.table(name).collect()

    kinds = {"n_a": F.col("k") == "a"}
    assert sorted((r.n_all, r.n_a) for r in run(windows.tumbling(stream(), "ts", "1 day", "1 hour", kinds), "days", "complete")) == [(1, 1), (3, 1)]
    assert len(run(windows.tumbling(stream(), "ts", "1 hour", "1 hour", kinds), "hours", "complete")) == 3
    assert sum(r.n_all for r in run(windows.sliding(stream(), "ts", "30 days", "1 day", "1 hour", kinds), "months", "complete")) == 4 * 30
    assert sorted(r.i for r in run(windows.first_seen(stream(), "ts", "i", "1 hour"), "firsts", "append")) == [1, 2, 3]
    target, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    spark.createDataFrame([("2025-01-01", 9), ("2024-12-31", 5)], "date string, n long").write.partitionBy("date").parquet(target)
    rebuild = lambda dates: rows.withColumn("date", F.date_format("ts", "yyyy-MM-dd")).join(dates, "date", "left_semi").groupBy("date").agg(F.count("*").alias("n"))
    windows.rebuild_dates(stream(), "ts", rebuild, target, checkpoint).awaitTermination(120)
    assert sorted((str(r.date), r.n) for r in spark.read.parquet(target).collect()) == [("2024-12-31", 5), ("2025-01-01", 3), ("2025-01-02", 1)]


def test_safety(spark):
    from kronoleaf.functions import safety

    texts = ["A HAPPY family definitely walks", "走った", "plain", None, "angry"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    assert [r[0] for r in df.select(safety.flags(F.col("t"))).collect()] == [["relationship_inference_removed", "emotion_inference_removed", "overclaim_softened", "sensitive_terms_removed", "forbidden_terms_removed"], [], [], [], ["emotion_inference_removed", "sensitive_terms_removed", "forbidden_terms_removed"]]
    assert [r[0] for r in df.select(safety.cleaned(F.col("t"), 30)).collect()] == ["A walks", "走った", "plain", None, None]


def test_questions(spark):
    from kronoleaf.functions import dates, questions as qs

    want = {"2024年1月5日に何してた？": "date_qa", "2024年1月は何してた": "monthly_summary", "最近のまとめ": "time_range_summary", "よく行った場所": "location_summary", "ラーメンの写真はいつ": "specific_food_search", "海っぽい写真": "multimodal_image_search", "写真が多い日": "photo_activity", "誰かと通話した": "call_activity", "ランチした日": "food_activity", "Annと会った": "person_interaction", "旅行の話": "topic_mention", "渋谷に行った": "place_visit", "思い出": "event_summary", "昨日": "date_qa", "": "unknown", "xyz": "unknown"}
    df = spark.createDataFrame([(q,) for q in want], "q string")
    r = dates.date_range(F.col("q"), F.lit("2025-05-15").cast("date"), 2024)
    got = {x.q: (x.i, x.p, x.w) for x in df.select("q", qs.intent(F.col("q"), r).alias("i"), qs.place(F.col("q")).alias("p"), qs.person(F.col("q")).alias("w")).collect()}
    assert {q: i for q, (i, _, _) in got.items()} == want and got["渋谷に行った"][1] == "渋谷" and got["Annと会った"][2] == "Ann"


def test_entry_imports_without_a_session():
    import subprocess
    import sys
    from pathlib import Path

    code = "import __spark_entry__ as e; assert len(e.queries()) > 150 and set(e.oracle_sql()) <= set(e.queries())"
    subprocess.run([sys.executable, "-c", code], cwd=Path(__file__).resolve().parents[1], check=True, timeout=120)
