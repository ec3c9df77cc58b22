"""Fields that reviews replace, and the filters of the review queue, on small tables."""

import pytest

from kronoleaf.operators import search

TEXTS = [*search.REPLACED, "text_cues_json"]
FLAGS = ["is_verified", "is_hidden", "is_wrong", "is_searchable", "is_event_usable"]


@pytest.fixture(scope="module")
def rows(spark):
    def vlm(i, **own):
        own = {"status": "success", "vlm_engine": "model", "confidence": 0.5, "people_count": 0, "safety_flags_json": None} | own
        return (i, *[own.get(c) for c in TEXTS], *[own[c] for c in ("status", "vlm_engine", "confidence", "people_count", "safety_flags_json")])

    def review(i, **own):
        return (i, *[own.get(o) for o in search.REPLACED.values()], *[own.get(f) for f in FLAGS], own.get("review_status"))

    vlm_rows = [
        vlm("a", caption="red car", location_cues_json='["port"]'), vlm("b", caption="red car", object_tags_json='["car"]'), vlm("c", text_cues_json='["car wash"]', vlm_engine="FAKE"),
        vlm("d", text_cues_json='["car wash"]', location_cues_json="no list"), vlm("e", caption="tree"), vlm("f", caption="tree"), vlm("g", caption="car", status="failed"), vlm("h", caption="car"), vlm("lost", caption="car"),
    ]
    reviews = [review("a", caption_override="", object_tags_override_json="", location_cues_override_json='["harbour"]', is_searchable=1, review_status="accepted"), review("b", caption_override="", object_tags_override_json='["boat"]'), review("h", is_wrong=1, is_event_usable=0, review_status="")]
    make = spark.createDataFrame
    return {
        "vlm": make(vlm_rows, "media_id string, " + ", ".join(f"{c} string" for c in TEXTS) + ", status string, vlm_engine string, confidence double, people_count int, safety_flags_json string"),
        "overrides": make(reviews, "media_id string, " + ", ".join(f"{c} string" for c in search.REPLACED.values()) + ", " + ", ".join(f"{f} int" for f in FLAGS) + ", review_status string"),
        "ocr": make([("e", "CAR park"), ("e", "car"), ("b", None)], "media_id string, ocr_text string"),
        "media": make([(i, "car.jpg" if i == "f" else f"{i}.jpg", f"2024-01-0{n + 1} 10:00", None) for n, i in enumerate("abcdefgh")], "id string, file_name string, captured_at string, fallback_captured_at string"),
    }


def ids(df):
    return sorted(r.media_id for r in df.collect())


def test_empty_overrides_keep_the_text_but_hide_it_from_the_search(rows):
    got = {r.media_id: r for r in search.effective_vlm(rows["vlm"], rows["overrides"]).collect()}
    assert (got["a"].caption, got["a"].location_cues_json, got["b"].object_tags_json, got["h"].review_status) == ("red car", '["harbour"]', '["boat"]', "unreviewed")
    assert not set(search.REPLACED.values()) & set(got["a"].asDict())
    find = lambda *terms, **more: ids(search.vlm_candidates(rows["vlm"], rows["overrides"], rows["ocr"], rows["media"], list(terms), **more))
    assert find("Car") == ["d", "e", "f"]
    assert find("car", with_hidden=True) == ["d", "e", "f", "h"]
    assert find("harbour", "boat") == ["a", "b"]
    assert find("port") == []
    assert find("car", date_from="2024-01-05", date_to="2024-01-05") == ["e"]
    assert find("nothing") == []


def test_filters_of_the_queue(rows):
    effective = search.effective_vlm(rows["vlm"], rows["overrides"])
    dates = rows["media"].selectExpr("id as media_id", "substring(captured_at, 1, 10) as date")
    queue = lambda **by: ids(search.vlm_queue(effective, **by))
    everything = sorted([*"abcdefgh", "lost"])
    assert queue() == everything
    assert queue(unreviewed=True) == [i for i in everything if i != "a"]
    assert queue(location_cues=True) == ["a"]
    assert queue(wrong=True) == ["h"] == queue(is_event_usable=False)
    assert queue(wrong=False, is_searchable=True) == [i for i in everything if i != "h"]
    assert queue(dates=dates, date_from="2024-01-07") == ["g", "h"]
    assert queue(dates=dates, date_to="2024-01-02") == ["a", "b"]
    assert queue(without_ocr=rows["ocr"], without_event=dates.where("media_id <> 'c'")) == ["c", "lost"]
    assert queue(with_event=dates.where("media_id in ('a', 'x')")) == ["a"]
    with pytest.raises(ValueError):
        queue(date_from="2024-01-07")


def test_flags_lower_a_text_once(spark):
    from pyspark.sql import functions as F

    from kronoleaf.functions import safety

    rows = spark.createDataFrame([("A SAD friend",), ("",), (None,), ("Definitely rain",)], "text string").select(safety.flags(F.col("text")).alias("f"))
    general = ["sensitive_terms_removed", "forbidden_terms_removed"]
    assert [r.f for r in rows.collect()] == [["relationship_inference_removed", "emotion_inference_removed", *general], [], [], ["overclaim_softened", *general]]
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
