"""Event construction: items of photos and messages, sessions, events with their rules, evidence and rebuilds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions.timeutil import micros
from .search import flag, truthy
from .sessions import MergeFold, PlaceFold, folded

#: Words and endings of places, words of meetings, meals and other activities, special messages, and the method's name.
METHOD = "rule_based_daily_v2"
PLACES = ["新宿", "渋谷", "池袋", "東京", "横浜", "大阪", "京都", "名古屋", "東口", "西口", "南口", "北口"]
PLACE_ENDING = "([一-龥ァ-ヶA-Za-z0-9ー]{1,16}(?:駅|口|公園|空港|ホテル|店|カフェ|レストラン|神社|寺|港|海|山|温泉|美術館|博物館|大学|会場))"
WAITING = ["駅", "着く", "待って", "待ってる", "待ち合わせ", "合流", "集合", "東口", "西口", "南口", "北口"]
FOOD = ["ご飯", "食べ", "食事", "ランチ", "ラーメン", "カフェ", "店", "おいしかった", "飲み", "ramen_possible", "meal_possible", "cafe_possible"]
OTHER = ["予約", "予定", "行く", "会う", "散歩", "旅行", "買い物", "仕事", "映画", "ライブ"]
DERIVED = [("待ち合わせ", ["待って", "待つ"]), ("食事", ["食べ"])]
SPECIAL = ["image", "video", "sticker", "file", "system", "unknown"]
CALL_DONE, CALL_OPEN = "通話時間", ["不在着信", "応答がありませんでした", "キャンセル"]


@dataclass(frozen=True)
class Config:
    """Gaps that part sessions, in minutes; the window of merging; the distance that parts photos, in metres."""

    photo_gap: int = 90
    line_gap: int = 120
    merge_window: int = 90
    far_metres: float = 500.0


def has_any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(w)) for w in words])


def found_words(text: Column, words: list[str]) -> Column:
    return F.filter(F.array(*map(F.lit, sorted(words))), lambda w: F.contains(text, w))


def locations(text: Column) -> Column:
    """Places that a text names, sorted: known words and whatever ends like a place."""
    all_ = F.concat(found_words(text, PLACES), F.regexp_extract_all(text, F.lit(PLACE_ENDING), F.lit(1)))
    return F.array_sort(F.array_distinct(F.filter(F.transform(all_, F.trim), lambda w: w != "")))


def activities(text: Column) -> Column:
    """Activities that a text names, sorted, with the two that follow from verbs."""
    derived = F.array_compact(F.array(*[F.when(has_any(text, words), F.lit(name)) for name, words in DERIVED]))
    return F.array_sort(F.array_distinct(F.concat(found_words(text, sorted({*WAITING, *FOOD, *OTHER})), derived)))


def reviewed_photos(media: DataFrame, vlm: DataFrame, usable: Column) -> DataFrame:
    """Photos with caption and analysis of their model row where that is usable for events; both null where it is not.
    Photos without a model row keep their own."""
    v = vlm.select(F.col("media_id").alias("id"), usable.alias("usable"), F.coalesce(truthy("short_caption"), "caption").alias("v_caption"), F.concat_ws(" ", "scene_tags_json", "food_cues_json", "activity_tags_json").alias("v_analysis"))
    own = lambda c: F.col(c) if c in media.columns else F.lit(None).cast("string")
    rows = media.join(v, "id", "left")
    pick = lambda c, d: F.when(F.col("usable").isNull(), own(c)).when(F.col("usable"), F.col(d))
    return rows.withColumns({"caption": pick("caption", "v_caption"), "analysis": pick("analysis", "v_analysis")}).drop("usable", "v_caption", "v_analysis")


def photo_items(photos: DataFrame, ocr: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Items of photos with a time that can be read; `keys` are columns beside the date that keep people apart."""
    good = ocr.where("status = 'success'").select(F.col("media_id").alias("id"), "ocr_text")
    at = F.expr("try_to_timestamp(coalesce(captured_at, fallback_captured_at))").cast("timestamp_ntz")
    text = F.concat_ws(" ", *[truthy(c) for c in ("caption", "ocr_text", "analysis", "file_name", "camera_model")])
    rows = photos.join(good, "id", "left").withColumn("at", at).where("at is not null").withColumn("text", text)
    blank = lambda c: F.coalesce(F.trim(c) != "", F.lit(False))
    return rows.select(
        *[v.alias(k) for k, v in keys.items()], F.date_format("at", "yyyy-MM-dd").alias("date"), F.lit("photo").alias("kind"), "id", "at", "text", F.lit(None).cast("string").alias("message_type"), F.lit(None).cast("string").alias("call_status"),
        F.lit(None).cast("int").alias("duration_sec"), "gps_lat", "gps_lon", F.lit(None).cast("string").alias("sender"), blank("ocr_text").alias("has_ocr"), (blank("caption") | blank("analysis")).alias("has_vlm"),
    )


def line_items(calls: DataFrame, keys: dict[str, Column]) -> DataFrame:
    """Items of messages with a time that can be read; `calls` are messages with call_status and duration_sec where they are calls."""
    at = F.expr("try_to_timestamp(sent_at)").cast("timestamp_ntz")
    rows = calls.withColumn("at", at).where("at is not null")
    none = F.lit(None).cast("double")
    return rows.select(
        *[v.alias(k) for k, v in keys.items()], F.date_format("at", "yyyy-MM-dd").alias("date"), F.lit("line").alias("kind"), "id", "at", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("message_type", F.lit("text")).alias("message_type"), "call_status",
        F.col("duration_sec").cast("int").alias("duration_sec"), none.alias("gps_lat"), none.alias("gps_lon"), "sender", F.lit(False).alias("has_ocr"), F.lit(False).alias("has_vlm"),
    )


def with_clusters(items: DataFrame, keys: list[str], config: Config = Config()) -> DataFrame:
    """Items with `cluster` (from 1 in each key and date, in order of time).

    Messages part at gaps; photos also part at distance from all located photos of their
    session, and sessions of both kinds merge greedily. These rules depend on all before, so
    the items stream in order through one fold that numbers sessions, and, once the ends of
    sessions are known, through another that numbers clusters.
    """
    by = [*keys, "date"]
    at = micros(F.col("at"))
    order = [F.asc_nulls_last(c) for c in ("at", "id")]

    def parts() -> Callable[..., int]:
        photos, gap = PlaceFold(config.photo_gap, config.far_metres), config.line_gap * 60_000_000
        lines, last = 1, None

        def session(kind: str, at: int, lat: float | None, lon: float | None) -> int:
            nonlocal lines, last
            if kind == "photo":
                return photos.add("", at, lat, lon)
            lines, last = lines + (last is not None and at - last >= gap), at
            return lines

        return session

    rows = items.withColumns({"__at": at, "__lat": F.col("gps_lat").cast("double"), "__lon": F.col("gps_lon").cast("double")})
    parted = folded(rows, [*by, "kind"], order, parts, ["kind", "__at", "__lat", "__lon"], "__session").drop("__lat", "__lon")
    whole = Window.partitionBy(*by, "kind", "__session")
    parted = parted.repartition(*by).withColumns({"__from": F.min("__at").over(whole), "__to": F.max("__at").over(whole)})

    def merges() -> Callable[..., int]:
        merge, last, number = MergeFold(config.merge_window), None, 0

        def cluster(kind: str, session: int, start: int, end: int) -> int:
            nonlocal last, number
            if (kind, session) != last:
                last, number = (kind, session), merge(kind, start, end)
            return number

        return cluster

    order = [F.col("__from"), F.col("__to"), F.desc("kind"), F.col("__session")]
    got = folded(parted, by, order, merges, ["kind", "__session", "__from", "__to"], "__cluster")
    return got.select(*items.columns, F.col("__cluster").cast("int").alias("cluster"))


def _gps() -> Column:
    return F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull()


def drafts(items: DataFrame, keys: list[str]) -> DataFrame:
    """One event a cluster: times, counts, places, activities, people, centroid, title, confidence, summary and id.

    Everything is one aggregate over (keys, date, cluster); lists are taken in order
    of time, kind and id.
    """
    by = [*keys, "date", "cluster"]
    line, photo = F.col("kind") == "line", F.col("kind") == "photo"
    done = line & ((F.col("call_status") == "completed") | F.contains("text", F.lit(CALL_DONE)))
    open_ = line & (F.col("call_status").isin("missed", "unanswered", "canceled") | has_any(F.col("text"), CALL_OPEN))
    located = photo & _gps()
    listed = F.struct("at", "kind", "id", locations(F.col("text")).alias("locations"), activities(F.col("text")).alias("activities"), "sender")
    n = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    got = items.groupBy(*by).agg(
        F.min("at").alias("start_at"), F.max("at").alias("end_at"), n(line).alias("n_line"), n(photo).alias("n_photo"), n(located).alias("n_gps"), n(done).alias("n_calls"), n(open_).alias("n_open_calls"),
        n(photo & (F.col("has_ocr") | F.col("has_vlm"))).alias("n_rich"), n(photo & F.col("has_ocr")).alias("n_ocr"), n(photo & F.col("has_vlm")).alias("n_vlm"), F.bool_or(has_any(F.col("text"), WAITING)).alias("waiting"), F.bool_or(has_any(F.col("text"), FOOD)).alias("food"),
        F.coalesce(F.sum(F.when(line & (F.col("call_status") == "completed"), F.col("duration_sec"))), F.lit(0)).alias("call_seconds"), F.avg(F.when(located, F.col("gps_lat"))).alias("gps_lat"), F.avg(F.when(located, F.col("gps_lon"))).alias("gps_lon"),
        *[n(line & (F.col("message_type") == s)).alias(f"n_{s}") for s in SPECIAL], F.array_sort(F.collect_list(listed)).alias("all"),
    )
    first_seen = lambda f: F.array_distinct(F.flatten(F.transform("all", f)))
    got = got.select(
        "*", first_seen(lambda x: x.locations).alias("locations"), first_seen(lambda x: x.activities).alias("activities"), F.array_distinct(F.filter(F.transform("all", lambda x: x.sender), lambda s: s != "")).alias("participants"),
        F.transform(F.slice("all", 1, 5), lambda x: x.id).alias("first_ids"),
    ).drop("all")
    return got.withColumns({"title": title(), "confidence_hundredths": confidence(), "summary": summary(), "event_id": event_id(), "location_name": F.try_element_at("locations", F.lit(1))})


def title() -> Column:
    """The first rule that holds."""
    c = F.col
    return (
        F.when(c("waiting"), "移動・待ち合わせの可能性").when(c("food"), "食事・カフェの可能性")
        .when((c("n_calls") >= 2) | ((c("n_line") >= 3) & (c("n_calls") >= F.greatest(F.lit(1), F.floor(c("n_line") / 2)))), "通話・連絡")
        .when((c("n_open_calls") > 0) & (c("n_calls") == 0), "不在着信・通話未成立")
        .when((c("n_photo") >= 3) & (c("n_gps") > 0), "位置情報付き写真の記録").when(c("n_photo") >= 3, "写真撮影の記録")
        .when((c("n_photo") > 0) & (c("n_line") > 0), "写真とLINEが残る出来事").when(c("n_photo") > 0, "写真撮影の記録").when(c("n_line") > 0, "LINEのやりとり").otherwise("記録された出来事")
    )


def confidence() -> Column:
    """Hundredths of confidence: a base, bonuses that add up, one cap for images alone and one for all."""
    c, bonus = F.col, lambda test, n: F.when(test, n).otherwise(0)
    n = c("n_line") + c("n_photo")
    score = (
        F.lit(35) + bonus(n >= 2, 12) + bonus(n >= 5, 8) + bonus((c("n_line") > 0) & (c("n_photo") > 0), 15) + bonus(c("n_gps") > 0, 12) + bonus(c("n_gps") >= 3, 4)
        + bonus(F.size("locations") > 0, 6) + bonus(F.size("activities") > 0, 6) + bonus(c("n_rich") > 0, 4) + bonus((c("n_ocr") > 0) & (c("n_vlm") > 0) & (c("n_line") > 0), 4)
    )
    capped = F.when((c("n_vlm") > 0) & (c("n_ocr") == 0) & (c("n_line") == 0), F.least(score, F.lit(74))).otherwise(score)
    return F.least(capped, F.lit(95)).cast("long")


def summary() -> Column:
    """Sentences, each only where it applies."""
    c = F.col
    some = lambda a: F.concat_ws("、", F.slice(a, 1, 3))
    special = F.concat_ws("、", *[F.when(c(f"n_{s}") > 0, F.format_string(f"{s}=%d", f"n_{s}")) for s in SPECIAL])
    return F.concat_ws(
        " ",
        F.format_string("LINE %d件、写真 %d枚から作成したイベント候補です。", "n_line", "n_photo"),
        F.when(c("n_gps") > 0, F.format_string("GPS付き写真が%d枚あります。", "n_gps")),
        F.when(c("n_calls") > 0, F.format_string("completed callが%d件あります。", "n_calls")),
        F.when((c("n_calls") > 0) & (c("call_seconds") > 0), F.format_string("通話時間合計は約%d分です。", F.greatest(F.lit(1), F.bround(c("call_seconds") / 60)).cast("long"))),
        F.when((c("n_calls") == 0) & (c("n_open_calls") > 0), F.format_string("不在着信・未応答・キャンセルなどの通話未成立ログが%d件あります。", "n_open_calls")),
        F.when(F.size("locations") > 0, F.concat(F.lit("場所候補: "), some("locations"), F.lit("。"))),
        F.when(F.size("activities") > 0, F.concat(F.lit("活動候補: "), some("activities"), F.lit("。"))),
        F.when(special != "", F.concat(F.lit("特殊メッセージ: "), special, F.lit("。"))),
        F.when(c("n_rich") > 0, F.lit("写真のcaption/OCR/VLMテキストも弱い根拠に含めています。")),
    )


def event_id() -> Column:
    hm = lambda c: F.date_format(c, "HH:mm")
    return F.concat(F.lit("event_"), F.sha2(F.concat_ws("|", F.lit(METHOD), "date", hm("start_at"), hm("end_at"), (F.col("cluster") - 1).cast("string"), F.concat_ws(",", "first_ids")), 256))


def with_event_ids(items: DataFrame, keys: list[str]) -> DataFrame:
    """Items of `with_clusters` with the `event_id` that `drafts` gives their cluster."""
    by = Window.partitionBy(*keys, "date", "cluster")
    place = F.row_number().over(by.orderBy("at", "kind", "id"))
    early = F.collect_list(F.when(F.col("__place") <= 5, F.struct("__place", "id"))).over(by)
    rows = items.withColumn("__place", place).withColumns({"start_at": F.min("at").over(by), "end_at": F.max("at").over(by), "first_ids": F.transform(F.array_sort(early), lambda x: x.id)})
    return rows.select(*items.columns, event_id().alias("event_id"))


def evidence_rows(items: DataFrame) -> DataFrame:
    """One row an item with its weight in hundredths, and one each for recognised text and model text of photos."""
    photo = F.col("kind") == "photo"
    named = (F.size(locations(F.col("text"))) > 0) | (F.size(activities(F.col("text"))) > 0)
    bonus = lambda test, n: F.when(test, n).otherwise(0)
    own = F.when(photo, 60).otherwise(65) + bonus(photo & _gps(), 15) + bonus(named, 10) + bonus(photo & (F.col("has_ocr") | F.col("has_vlm")), 10) + bonus(F.col("message_type").isin(SPECIAL), 3)
    row = lambda kind, weight: F.struct(kind.alias("evidence_type"), weight.cast("long").alias("weight"))
    rows = F.array_compact(F.array(row(F.col("kind"), F.least(own, F.lit(100))), F.when(photo & F.col("has_ocr"), row(F.lit("ocr"), F.lit(72))), F.when(photo & F.col("has_vlm"), row(F.lit("vlm"), F.lit(45)))))
    keep = [c for c in items.columns if c not in ("id", "kind", "text")]
    return items.select(*keep, F.col("id").alias("evidence_id"), F.inline(rows))


def rebuilt(existing: DataFrame, drafts: DataFrame, dates: DataFrame) -> DataFrame:
    """Events after a rebuild of some dates: generated, unedited events of them give way to the drafts; all others stay.
    A second run changes nothing, for ids follow from the content."""
    day = dates.select("date").distinct().withColumn("rebuilt", F.lit(True))
    marked = existing.join(day, "date", "left")
    gone = F.coalesce("rebuilt", F.lit(False)) & (F.col("source") == "generated") & ~flag("is_user_edited")
    kept = marked.where(~gone).select(*existing.columns)
    return kept.unionByName(drafts.select(*existing.columns).join(kept.select("id"), "id", "left_anti"))


def rebuild_report(before: DataFrame, after: DataFrame, columns: list[str]) -> DataFrame:
    """(change, n) of a rebuild: added, removed, changed and same events."""
    a, b = (df.select(F.col("id").alias(i), F.struct(*columns).alias(v)) for df, i, v in ((before, "i", "v"), (after, "j", "w")))
    change = F.when(F.col("i").isNull(), "added").when(F.col("j").isNull(), "removed").when(F.col("v").eqNullSafe(F.col("w")), "same").otherwise("changed")
    return a.join(b, F.col("i") == F.col("j"), "full").groupBy(change.alias("change")).agg(F.count("*").alias("n"))
