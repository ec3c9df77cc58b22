"""Summaries of ranges on small tables, by hand and against sums over the rows."""

import pytest

from kronoleaf.operators import periods


@pytest.fixture(scope="module")
def tables(spark):
    make = spark.createDataFrame
    events = make([("e1", "2024-01-01", "10:00", "ランチ 食事", None, None, 0.9), ("e2", "2024-01-01", None, "", None, "cafe", 0.2), ("e3", "2024-01-03", "09:00", "call", None, None, None), ("e4", None, None, "lost", None, None, 0.5)], "id string, date string, start_time string, title string, summary string, location_name string, confidence double")
    return {
        "events": events, "all_events": events, "evidence": make([("e1", "photo"), ("e1", "photo"), ("e3", None), ("none", "ocr")], "event_id string, evidence_type string"),
        "media": make([("m1", "2024-01-01 10:00", None, 1.0, 2.0), ("m2", None, "2024-01-02 10:00", 1.0, None), ("m3", None, None, None, None)], "id string, captured_at string, fallback_captured_at string, gps_lat double, gps_lon double"),
        "vlm": make([("m1", "ramen", None, None, None, None, None), ("m3", "ramen", None, None, None, None, None)], "media_id string, " + ", ".join(f"{c} string" for c in periods.MODEL_TEXT)),
        "ocr": make([("m2", "success"), ("m1", "failed")], "media_id string, status string"),
        "messages": make([("c", "s", "2024-01-01 11:00"), ("c", "s", "2024-01-01 12:00"), ("c", "x", "2024-01-02 11:00"), ("c", "s", None)], "chat_id string, sender string, sent_at string"),
        "calls": make([("c", "s", "2024-01-03 11:00", "missed"), ("c", "x", "2024-01-03 12:00", None)], "chat_id string, sender string, sent_at string, call_status string"),
        "event_places": make([("e1", "p"), ("e1", "p"), ("e3", "p"), ("e3", "q")], "event_id string, place_id string"),
        "event_people": make([("e1", "a", 0), ("e1", "a", 0), ("e3", "a", 1), ("e3", "b", 0), ("e3", "h", 0)], "event_id string, person_id string, is_hidden int"),
        "media_people": make([("m1", "b", 0), ("m2", "b", 0)], "media_id string, person_id string, is_hidden int"),
        "speaker_links": make([("c", "s", "a", 1), ("c", "x", "b", 0)], "chat_id string, speaker_name string, person_id string, is_verified int"),
    }


def by_range(rows):
    out = {}
    for r in rows.collect():
        assert (r.section, r.name) not in out.setdefault(r.range_id, {})
        out[r.range_id][r.section, r.name] = r.value
    return out


def test_every_section_of_a_range(spark, tables):
    ranges = spark.createDataFrame([("all", "2024-01-01", "2024-01-31"), ("all", "2024-01-01", "2024-01-31"), ("one", "2024-01-02", "2024-01-02"), ("back", "2024-01-03", "2024-01-01"), ("none", None, "2024-01-03"), ("odd", "x", "2024-01-03"), ("later", "2025-01-01", "2025-02-01")], "range_id string, date_from string, date_to string")
    places = spark.createDataFrame([("p", "Park", "Area", "park"), ("q", "", "Area", None)], "id string, display_name string, public_name string, category string")
    persons = spark.createDataFrame([("a", "Ann", None, 0, 0), ("b", None, "Bea", 0, 0), ("h", "Hid", None, 1, 0)], "id string, display_name string, public_name string, is_hidden int, is_deleted int")
    held = periods.range_facts(ranges, periods.daily_facts(**tables))
    got = by_range(periods.summary(held, places, persons))
    assert set(got) == {"all", "one"}
    total = {"events": 3, "evidence": 3, "photos": 2, "gps_photos": 1, "vlm_photos": 1, "ocr_photos": 1, "messages": 3, "calls": 2}
    assert {k[1]: v for k, v in got["all"].items() if k[0] == "total"} == total
    assert {k: v for k, v in got["all"].items() if k[0] not in ("total", "day")} == {
        ("title", "ランチ 食事"): 1, ("title", "untitled"): 1, ("title", "call"): 1, ("call", "missed"): 1, ("call", "unknown"): 1, ("category", "food_cafe"): 3, ("category", "call"): 3,
        ("confidence", "高"): 1, ("confidence", "低"): 1, ("evidence", "photo"): 2, ("evidence", "unknown"): 1, ("place_category", "park"): 2, ("place_category", "other"): 1, ("place_label", "Park"): 2, ("place_label", "Area"): 1,
        ("person_events", "a"): 1, ("person_events", "b"): 1, ("person_media", "b"): 2, ("person_messages", "a"): 2, ("person_calls", "a"): 1,
    }
    days = [(r.date, r.score) for r in periods.best_days(held).where("range_id = 'all'").orderBy("rank").collect()]
    assert days == [("2024-01-01", 2 * 500 + 8 + 6 + 8 + 5), ("2024-01-03", 500 + 300), ("2024-01-02", 8 + 4)]
    public = by_range(periods.summary(held, places, persons, public=True))["all"]
    assert ("place_label", "Area") in public and public["place_label", "Area"] == 3
    assert not any(section.startswith("person") for section, _ in public)
    shown = periods.day_events(periods.best_days(held), tables["events"], tables["evidence"]).where("range_id = 'all'").orderBy("rank", "position").collect()
    assert [(r.date, r.position, r.id, r.n_photo, r.n_line) for r in shown] == [("2024-01-01", 1, "e1", 2, 0), ("2024-01-01", 2, "e2", 0, 0), ("2024-01-03", 1, "e3", 0, 0)]


def test_empty_tables(spark, tables):
    none = {k: v.limit(0) for k, v in tables.items()}
    ranges = spark.createDataFrame([("all", "2024-01-01", "2024-01-31")], "range_id string, date_from string, date_to string")
    assert periods.range_facts(ranges, periods.daily_facts(**none)).count() == 0
    assert periods.range_facts(ranges.limit(0), periods.daily_facts(**tables)).count() == 0


def test_titles_and_people_are_the_most(spark):
    rows = [("r", "2024-01-01", "title", f"t{i:02}", float(i // 2)) for i in range(14)] + [("r", "2024-01-01", "person_events", f"p{i:02}", 1.0) for i in range(12)] + [("r", "2024-01-02", "person_media", "p11", 5.0)]
    held = spark.createDataFrame(rows, "range_id string, date string, section string, name string, value double")
    places = spark.createDataFrame([], "id string, display_name string, public_name string, category string")
    persons = spark.createDataFrame([(f"p{i:02}", "same", None, 0, 0) for i in range(12)], "id string, display_name string, public_name string, is_hidden int, is_deleted int")
    got = by_range(periods.summary(held, places, persons))["r"]
    assert sorted(n for s, n in got if s == "title") == [f"t{i:02}" for i in range(4, 14)]
    assert sorted({n for s, n in got if s.startswith("person")}) == sorted(["p11"] + [f"p{i:02}" for i in range(9)])


def test_people_of_ranges_equal_those_of_whole_facts(spark, tables):
    ranges = spark.createDataFrame([("all", "2024-01-01", "2024-01-31"), ("two", "2024-01-01", "2024-01-02"), ("back", "2024-01-03", "2024-01-01")], "range_id string, date_from string, date_to string")
    places = spark.createDataFrame([("p", "Park", "Area", "park")], "id string, display_name string, public_name string, category string")
    persons = spark.createDataFrame([("a", "Ann", None, 0, 0), ("b", None, "Bea", 0, 0), ("h", "Hid", None, 1, 0)], "id string, display_name string, public_name string, is_hidden int, is_deleted int")
    of = lambda *names: {n: tables[n] for n in names}
    people = periods.range_people(ranges, periods.daily_people(**of("all_events", "media", "messages", "calls", "event_people", "media_people", "speaker_links")), persons)
    counts = periods.daily_counts(**of("events", "all_events", "evidence", "media", "vlm", "ocr", "messages", "calls", "event_places"))
    whole = periods.range_facts(ranges, periods.daily_facts(**tables))
    assert by_range(periods.summary(periods.range_facts(ranges, counts), places, persons, people=people)) == by_range(periods.summary(whole, places, persons))
    days = lambda daily: sorted(map(str, periods.best_days(periods.range_facts(ranges, daily)).collect()))
    totals = periods.daily_totals(**of("events", "media", "vlm", "ocr", "messages", "calls"))
    assert days(totals) == days(periods.daily_facts(**tables)) and not totals.where("section <> 'total'").count()


def test_best_people_of_ranges_among_many(spark):
    daily = [(f"2024-01-{d:02}", k, f"p{i:02}", float((i * d) % 7 + (k == "person_media"))) for d in range(1, 5) for i in range(30) for k in ("person_events", "person_media") if (i + d) % 3 and (i * d) % 7] + [("2024-01-09", "person_calls", "p29", 1.0)]
    daily = spark.createDataFrame(daily, "date string, section string, name string, value double")
    ranges = spark.createDataFrame([(f"{a}-{b}", f"2024-01-{a:02}", f"2024-01-{b:02}") for a in range(1, 10) for b in range(a, 10)], "range_id string, date_from string, date_to string")
    persons = spark.createDataFrame([(f"p{i:02}", "same", None, 0, int(i == 7)) for i in range(30)], "id string, display_name string, public_name string, is_hidden int, is_deleted int")
    places = spark.createDataFrame([], "id string, display_name string, public_name string, category string")
    whole = periods.summary(periods.range_facts(ranges, daily), places, persons).where("section like 'person%'")
    assert by_range(periods.range_people(ranges, daily, persons)) == by_range(whole)
