"""Intents with their confidence, and what questions speak of, on real sentences."""

from pyspark.sql import functions as F

from kronoleaf.functions import dates, questions as qs


def one(spark, questions, **columns):
    df = spark.createDataFrame([(q,) for q in questions], "q string")
    return {r.q: r for r in df.select("q", *[c.alias(k) for k, c in columns.items()]).collect()}


def test_confidence(spark):
    want = {
        "": ("unknown", 0.0, "unsupported"), "2024年1月5日に何してた？": ("date_qa", 0.92, "ask"), "2024年1月5日": ("date_qa", 0.72, "ask"), "2024年1月は何してた": ("monthly_summary", 0.88, "monthly_summary"), "最近のまとめ": ("time_range_summary", 0.86, "event_summary"),
        "よく行った場所": ("location_summary", 0.78, "event_summary"), "ラーメンの写真はいつ": ("specific_food_search", 0.9, "multimodal-search"), "海っぽい写真": ("multimodal_image_search", 0.86, "multimodal-search"), "写真が多い日": ("photo_activity", 0.8, "photo_activity"),
        "長電話した日": ("call_activity", 0.9, "call_search"), "カフェでゆっくりした": ("food_activity", 0.86, "search"), "Annと会った": ("person_interaction", 0.78, "search"), "AnnとLINEした": ("person_interaction", 0.78, "search"), "研究の話": ("topic_mention", 0.82, "search"),
        "渋谷に行った": ("place_visit", 0.84, "search"), "主な思い出": ("event_summary", 0.65, "event_summary"), "xyz": ("unknown", 0.25, "unsupported"),
    }
    q = F.col("q")
    got = one(spark, want, c=qs.classified(q, dates.date_range(q, F.lit("2025-05-15").cast("date"), 2024)))
    assert {k: (r.c.intent, r.c.confidence, r.c.route) for k, r in got.items()} == want and got["研究の話"].c.reason == "talk"


def test_entities(spark):
    q = F.col("q")
    asked = ["旅行の話はいつ？", "引っ越しについて", "研究したい", "アルバム見た", "話した人", "ラーメンを食べた店", "不在着信とランチ", "食べた写真", "何もない"]
    got = one(spark, asked, topic=qs.topic(q), food=qs.food_terms(q), act=qs.activity(q), terms=qs.raw_terms(q))
    assert [got[x].topic for x in asked] == ["旅行", "引っ越し", "研究", "アルバム", "話した人", None, None, None, None]
    assert got["ラーメンを食べた店"].food == ["食べ", "ラーメン", "店"] and [got[x].act for x in asked[5:]] == ["food", "call", "photo", None]
    assert got["旅行の話はいつ？"].terms == ["旅行の話"] and got["不在着信とランチ"].terms == ["不在着信", "ランチ"]


def test_search_intent(spark):
    asked = {"電話した": "call_activity", "ランチ": "food_activity", "駅": "place_visit", "アルバム": "topic_mention", "猫": "generic"}
    assert {k: r.i for k, r in one(spark, asked, i=qs.search_intent(F.col("q"))).items()} == asked
