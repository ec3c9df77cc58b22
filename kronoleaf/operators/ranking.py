"""Day results, their classification and rank, hybrid scores of images, and other rules that score and sort."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from .search import flag

#: Words of what has happened, of plans, of open calls; titles that stand for actions; order of classes.
ACTUAL = {
    "place_visit": ["着いた", "着く", "到着", "いる", "来た", "向かってる", "駅着いた", "改札", "待ってる", "待って", "合流"],
    "food_activity": ["食べた", "食べる", "食べます", "おいしかった", "ご飯食べ", "夜ご飯", "昼ご飯", "カフェ", "店"],
    "call_activity": ["通話時間", "LINE通話", "電話した"],
}
PLANS = ["行く？", "行こう", "行きたい", "行くかも", "行けたら", "行くなら", "着いたら", "着くなら", "候補", "どっか", "じゃないかな", "予定", "予約", "どうする", "どうしよ", "見とく", "探す", "あるとしたら", "かも", "かもしれない", "かな", "かなー", "何食べたい", "ご飯どうしよ", "どこ行く"]
MISSED = ["応答がありませんでした", "不在着信", "不在", "キャンセル"]
UNSURE = ["かも", "かな", "どっか", "候補", "予定", "行けたら", "行くなら"]
TITLES = {
    "food_activity": ["食事・カフェの可能性"], "call_activity": ["通話・連絡"], "place_visit": ["移動・待ち合わせの可能性", "外出・写真撮影", "位置情報付き写真の記録", "写真とLINEが残る出来事"],
    "generic": ["移動・待ち合わせの可能性", "食事・カフェの可能性", "通話・連絡", "写真とLINEが残る出来事", "位置情報付き写真の記録"],
}
CLASSES = ["actual_or_likely_action", "plan_or_candidate", "mention_only", "unknown"]
KINDS = ("event", "line", "media", "ocr", "vlm")


def held(text: Column, words: list[str]) -> Column:
    """How many of the words a text holds."""
    return sum((F.contains(text, F.lit(w)).cast("int") for w in words), F.lit(0))


def day_results(hits: DataFrame) -> DataFrame:
    """Hits (kind, id, date, confidence) by day: counts, base score and hundredths of confidence.

    The confidence counts events, messages and photos only, and of them 8 at most.
    """
    n = lambda k: F.count_if(F.col("kind") == k).alias(f"{k}_count")
    rows = hits.where("date <> ''").groupBy("date").agg(*map(n, KINDS), F.coalesce(F.max(F.when(F.col("kind") == "event", F.col("confidence"))), F.lit(0.0)).alias("max_confidence"))
    e, m, p = (F.col(f"{k}_count") for k in ("event", "line", "media"))
    kinds = sum(((c > 0).cast("int") for c in (e, m, p)), F.lit(0))
    sure = kinds * 15 + F.least(e + m + p, F.lit(8)) * 4 + 15 + F.least("max_confidence", F.lit(0.95)) * 20
    score = e * 3 + m * 2 + p + F.col("ocr_count") * 2 + F.col("vlm_count") * 2.5
    return rows.withColumn("score", score).withColumn("confidence", F.round(F.least(sure, F.lit(95.0)) / 100, 2))


def level(score: Column, high: str = "高", middle: str = "中", low: str = "低") -> Column:
    return F.when(score >= 0.75, high).when(score >= 0.45, middle).otherwise(low)


def classified(days: DataFrame, intent: str) -> DataFrame:
    """Days with class and score for an intent.

    A day has text, event_count, line_count, media_count, ocr_count, vlm_count, max_confidence,
    actual_title (whether an event's title stands for the action), photos, gps, completed,
    incomplete and max_call_sec. Words of arrival do not count where they are conditional.
    """
    text = F.col("text")
    words = ACTUAL.get(intent) or [w for k in ("place_visit", "food_activity", "call_activity") for w in ACTUAL[k]]
    has = lambda w: F.contains(text, F.lit(w))
    unsure = reduce(lambda a, b: a | b, map(has, UNSURE))

    def counts(w: str) -> Column:
        if w == "着いた":
            return has(w) & ~has("着いたら")
        if w == "着く":
            return has(w) & ~has("着いたら") & ~has("着くなら")
        if w in ("いる", "来た", "待って", "待ってる", "向かってる"):
            return has(w) & ~unsure
        return has(w)

    actual = sum((counts(w).cast("int") for w in dict.fromkeys(words)), F.lit(0))
    rows = days.withColumns({"actual": actual, "plans": held(text, PLANS), "missed": held(text, MISSED)})
    c, cap = F.col, lambda name, n: F.least(F.col(name), F.lit(n))
    call = intent == "call_activity"
    seen = (c("event_count") > 0).cast("int") + (c("line_count") > 0).cast("int") + ((c("photos") > 0) | (c("media_count") > 0) | (c("ocr_count") > 0) | (c("vlm_count") > 0)).cast("int")
    score = (
        0.12 + cap("event_count", 3) * 0.10 + cap("max_confidence", 0.95) * 0.20 + cap("actual", 4) * 0.15 - cap("plans", 4) * 0.12 - cap("missed", 3) * 0.20 + cap("photos", 5) * 0.035 + cap("gps", 5) * 0.045
        + cap("media_count", 3) * 0.05 + cap("ocr_count", 5) * 0.08 + cap("vlm_count", 5) * 0.10 + F.when(seen >= 3, 0.12).when(seen >= 2, 0.06).otherwise(0.0)
        - F.when((c("line_count") == 1) & (c("event_count") == 0) & (c("photos") == 0), 0.10).otherwise(0.0) + F.when(c("actual_title"), 0.16).otherwise(0.0)
    )
    if call:
        score = score + F.when(c("completed") > 0, cap("completed", 4) * 0.18 + F.least(c("max_call_sec") / 3600, F.lit(1.0)) * 0.16).otherwise(0.0)
        score = score - F.when((c("incomplete") > 0) & (c("completed") == 0), cap("incomplete", 3) * 0.16).otherwise(0.0)
        score = score + F.when((c("actual") > 0) & (c("missed") == 0), 0.20).when((c("missed") > 0) & (c("actual") == 0) & (c("completed") == 0), -0.18).otherwise(0.0)
    done, plan, mention, unknown = map(F.lit, CLASSES)
    signs = (c("actual") > 0) | c("actual_title")
    out = F.when(signs, F.when(c("plans") > c("actual") + c("actual_title").cast("int"), plan).otherwise(done))
    if intent in ("place_visit", "food_activity"):
        out = out.when(((c("gps") > 0) | (c("photos") >= 2) | (c("ocr_count") > 0) | (c("vlm_count") > 0)) & (c("plans") == 0), done)
    out = out.when(c("plans") > 0, plan).when(c("line_count") > 0, mention).otherwise(unknown)
    if call:
        out = F.when(c("completed") > 0, done).when(((c("incomplete") > 0) | (c("missed") > 0)) & ~signs, mention).otherwise(out)
    rows = rows.withColumn("class", out)
    change = F.when(c("class") == CLASSES[0], 0.10).when(c("class") == CLASSES[1], -0.05).when(c("class") == CLASSES[2], -0.15).otherwise(0.0)
    return rows.withColumn("score", F.round(F.greatest(F.lit(0.0), F.least(score + change, F.lit(0.98))), 3))


def ranked(days: DataFrame, mode: str | None = None) -> DataFrame:
    """Classified days in rank: boosts of pinned and verified events added, one class only where asked, best class first,
    then the higher score, then the earlier date."""
    boost = F.when(F.col("pinned"), 0.12).otherwise(0.0) + F.when(F.col("verified"), 0.04).otherwise(0.0)
    order = F.array_position(F.array(*map(F.lit, CLASSES)), F.col("class"))
    rows = days.withColumn("score", F.round(F.least(F.col("score") + boost, F.lit(0.95)), 3)).withColumn("class_order", order)
    rows = rows if mode is None else rows.where(F.col("class") == mode)
    return rows.withColumn("label", level(F.round("score", 2))).orderBy("class_order", F.desc("score"), "date")


def field_score(fields: list[str], terms: list[str], most: float = 1.0) -> Column:
    """0.22 a field with a hit and 0.08 a term that hits anywhere, up to `most`; 0 without a hit."""
    low = [F.lower(F.coalesce(F.col(f), F.lit(""))) for f in fields]
    terms = [t for t in dict.fromkeys(t.strip().lower() for t in terms) if t]
    any_ = lambda tests: reduce(lambda a, b: a | b, tests)
    n_fields = sum((any_([F.contains(c, F.lit(t)) for t in terms]).cast("int") for c in low), F.lit(0))
    n_terms = sum((any_([F.contains(c, F.lit(t)) for c in low]).cast("int") for t in terms), F.lit(0))
    return F.when(n_fields > 0, F.least(F.lit(most), n_fields * 0.22 + n_terms * 0.08)).otherwise(0.0)


#: Flags that lower a score, and states of a refused review.
UNSAFE = ["forbidden_terms_found", "relationship_inference_removed", "emotion_inference_removed"]
REFUSED = ["rejected", "wrong"]


def hybrid(rows: DataFrame, terms: list[str], vlm_fields: list[str], ocr_fields: list[str], place_fields: list[str], specific: list[str] = (), generic: list[str] = ()) -> DataFrame:
    """Images with their part scores and the final one, unrounded.

    A row has the fields, embedding (0 to 1), sql (0 to 1), line_hits, gps_lat, gps_lon, is_verified, is_wrong, review_status,
    safety_flags_json, and event_title, event_summary, event_location, event_confidence, event_verified,
    event_pinned of its event, null without one.
    """
    visual = [*vlm_fields, *ocr_fields]
    emb = F.greatest(F.lit(0.0), F.least(F.col("embedding"), F.lit(1.0)))
    rows = rows.withColumns({"vlm_score": field_score(vlm_fields, terms), "ocr_score": field_score(ocr_fields, terms), "embedding_score": emb, "sql_score": F.col("sql")})
    if specific:
        rows = rows.withColumns({"specific_score": field_score(visual, list(specific)), "generic_score": field_score(visual, list(generic)) if generic else F.lit(0.0)})
        limit = F.when(F.col("generic_score") > 0, 0.2).otherwise(0.0)
        hit = F.col("specific_score") > 0
        rows = rows.withColumns({c: F.when(hit, F.col(c)).otherwise(F.least(F.col(c), limit)) for c in ("vlm_score", "sql_score")})
        named = reduce(lambda a, b: a | b, [F.contains(F.lower("file_name"), F.lit(t.lower())) for t in specific])
        seen = hit | F.coalesce(named, F.lit(False))
    else:
        rows = rows.withColumn("specific_score", F.lit(0.0))
        seen = (F.col("vlm_score") > 0) | (F.col("ocr_score") > 0) | (F.col("sql_score") > 0) | (F.col("embedding_score") >= 0.35)
    rows = rows.withColumn("visual_match", seen)
    rows = rows.withColumns({"event_hit": field_score(["event_title", "event_summary"], terms) > 0, "place_hit": (field_score(["event_location"], terms) > 0) | (field_score(place_fields, terms) > 0)})
    return final_scores(rows)


def final_scores(rows: DataFrame) -> DataFrame:
    """Part scores of lines, event and place, and the final one, from rows with the scores of text and vector, `visual_match`, `specific_score`,
    whether the query's terms hit the event (`event_hit`) or the place (`place_hit`), and the facts that `hybrid` names."""
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    has_event = F.col("event_confidence").isNotNull()
    event = F.when(has_event, F.least(F.lit(1.0), F.lit(0.35) + F.greatest(F.lit(0.0), F.least("event_confidence", F.lit(1.0))) * 0.35 + F.when(F.col("event_hit"), 0.2).otherwise(0.0))).otherwise(0.0)
    place = F.greatest(F.when(F.col("gps_lat").isNotNull() & F.col("gps_lon").isNotNull(), 0.3).otherwise(0.0), F.when(F.col("event_location") != "", 0.4).otherwise(0.0), F.when(F.col("place_hit"), 1.0).otherwise(0.0))
    rows = rows.withColumns({"line_score": F.least(F.lit(1.0), F.col("line_hits") * 0.35), "event_score": event, "place_score": place})
    rows = rows.withColumns({c: F.when(F.col("visual_match"), F.col(c)).otherwise(F.least(F.col(c), F.lit(0.2))) for c in ("line_score", "event_score")})
    boost = F.when(flag("is_verified") | (F.col("review_status") == "accepted"), 0.08).otherwise(0.0) + zero(F.when(flag("event_verified"), 0.1)) + zero(F.when(flag("event_pinned"), 0.12))
    flags = F.coalesce(F.from_json("safety_flags_json", "array<string>"), F.array().cast("array<string>"))
    penalty = F.when(F.arrays_overlap(flags, F.array(*map(F.lit, UNSAFE))), -0.1).otherwise(0.0) + F.when(flag("is_wrong") | F.col("review_status").isin(REFUSED), -0.5).otherwise(0.0)
    c = F.col
    final = c("embedding_score") * 0.30 + c("vlm_score") * 0.20 + c("ocr_score") * 0.15 + c("line_score") * 0.15 + c("event_score") * 0.15 + c("place_score") * 0.05 + boost + penalty + F.least(F.lit(0.18), c("specific_score") * 0.18)
    context = (c("ocr_score") > 0) | (c("line_score") > 0) | (c("event_score") > 0) | (c("place_score") > 0)
    lone = ~context & ((c("embedding_score") > 0) != (c("vlm_score") > 0))
    people_only = ~context & (flags == F.array(F.lit("people_present")))
    final = F.when(lone | people_only, F.least(final, F.lit(0.44))).otherwise(final)
    final = F.when(c("visual_match"), final).otherwise(final * 0.5)
    return rows.withColumn("final_score", F.greatest(F.lit(0.0), F.least(final, F.lit(0.95))))


def with_person(final: Column, person: Column, asked: bool) -> Column:
    """A score raised by the person found, or lowered where one was asked for and none is found."""
    return F.when(person > 0, F.round(F.least(F.lit(0.95), final + F.least(F.lit(0.28), person * 0.28)), 3)).otherwise(F.round(final * 0.55, 3) if asked else final)


def words_of_days(messages: DataFrame, date: Column, text: Column) -> DataFrame:
    """(date, text): of all that is said on a day, the words that `classified` asks for, each once.

    All of its tests are containments, so these words decide them as the whole texts would; they are found message by message
    below the shuffle, and no day's texts are ever brought together.
    """
    words = sorted({w for own in ACTUAL.values() for w in own} | {*PLANS, *MISSED, *UNSURE, "着いたら", "着くなら"})
    found = F.explode(F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)))
    return messages.select(date.alias("date"), found.alias("word")).groupBy("date").agg(F.array_join(F.array_sort(F.collect_set("word")), "\n").alias("text"))


def image_score(fields: Column, confidence: Column, gps: Column, event: Column, verified: Column, wrong: Column, person: Column, asked: bool = False) -> Column:
    """The score of an image search from its matched fields and what supports it."""
    bonus = lambda test, n: F.when(test, n).otherwise(0.0)
    score = F.lit(0.2) + fields * 0.15 + F.coalesce(F.least(confidence, F.lit(1.0)), F.lit(0.0)) * 0.25 + bonus(gps, 0.1) + bonus(event, 0.1)
    score = F.when(person > 0, score + F.least(F.lit(0.35), person * 0.35)).otherwise(F.least(score * 0.35, F.lit(0.24)) if asked else score)
    return F.round(F.greatest(F.lit(0.0), F.least(score + bonus(verified, 0.08) - bonus(wrong, 0.5), F.lit(0.95))), 3)


def capped_label(score: Column, kinds: Column, flags: Column) -> Column:
    """high, middle or low; high becomes middle for visual evidence alone, people alone and unsafe texts."""
    some = lambda a, *words: F.arrays_overlap(a, F.array(*map(F.lit, words)))
    context = some(kinds, "ocr", "line", "event", "place", "gps")
    capped = (some(kinds, "vlm", "embedding") & ~context) | ((F.array_distinct(flags) == F.array(F.lit("people_present"))) & ~context) | some(flags, *UNSAFE)
    label = level(score)
    return F.when((label == "高") & capped, "中").otherwise(label)


def image_strength(vlm: Column, ocr: Column, event: Column, person: Column, verified: Column) -> Column:
    return F.when(verified, "medium").when(person & vlm & event, "strong").when(person, "medium").when(vlm & (event | ocr), "medium").otherwise("weak")


def vlm_strength(supports: list[Column], confidence: Column) -> Column:
    """By the number of independent signals that agree and the model's own confidence."""
    n = sum((s.cast("int") for s in supports), F.lit(0))
    return F.when((n >= 3) & (confidence >= 0.7), "strong").when((n >= 1) & (confidence >= 0.65), "medium").otherwise("weak")


def date_confidence(lines: Column, photos: Column, events: Column) -> Column:
    return F.when((events > 0) | (lines + photos >= 3), "high").when(lines + photos > 0, "medium").otherwise("unknown")


def contact_confidence(lines: Column, senders: Column) -> Column:
    return F.when(lines == 0, "unknown").when((senders > 0) & (lines >= 2), "high").when(senders > 0, "medium").otherwise("low")


def place_confidence(named: Column, gps: Column, photos: Column) -> Column:
    return F.when((named > 0) & (gps > 0), "high").when((named > 0) | (gps > 0), "medium").when(photos > 0, "low").otherwise("unknown")


#: Words of each category of activity.
ACTIVITY = {
    "meeting": ["待ち合わせ", "待って", "待ってる", "合流", "集合", "着く", "到着", "駅", "東口", "西口"], "food": ["ご飯", "食事", "ラーメン", "ランチ", "カフェ", "食べ", "おいしかった", "飲み"], "call": ["通話", "電話", "不在着信", "着信"],
    "work": ["仕事", "会議", "打ち合わせ", "出勤"], "travel": ["旅行", "観光", "移動", "散歩"], "shopping": ["買い物", "購入"], "entertainment": ["映画", "ライブ", "展示", "美術館", "博物館"],
}


def activity_counts(text: Column) -> tuple[Column, Column]:
    """(categories, occurrences) of activity words in a text."""
    times = lambda w: (F.length(text) - F.length(F.replace(text, F.lit(w), F.lit("")))) / len(w)
    per = [sum((times(w) for w in words), F.lit(0.0)) for words in ACTIVITY.values()]
    return sum(((p > 0).cast("int") for p in per), F.lit(0)), F.round(sum(per, F.lit(0.0))).cast("long")


#: Words that suggest text in a picture.
TEXT_WORDS = ["sign", "text", "menu", "receipt", "document", "label", "poster", "ticket", "screen", "screenshot", "storefront", "billboard", "handwritten", "logo", "package"]


def ocr_priority(blob: Column, has_cues: Column, has_hint: Column, words: list[str] = TEXT_WORDS) -> Column:
    return F.when(has_cues, 5).otherwise(0) + F.when(has_hint, 4).otherwise(0) + held(F.lower(blob), words)


def evenly_spaced(rows: DataFrame, keys: list[str], order: list, k: int) -> DataFrame:
    """About `k` rows of each group, evenly spaced in its order: rows round(slot * (n - 1) / (k - 1)), halves to even; all where there are no more."""
    w = Window.partitionBy(*keys)
    numbered = rows.withColumn("i", F.row_number().over(w.orderBy(*order)) - 1).withColumn("n", F.count("*").over(w))
    slots = F.transform(F.sequence(F.lit(0), F.lit(k - 1)), lambda s: F.bround(s * (F.col("n") - 1) / max(k - 1, 1)).cast("int"))
    return numbered.where((F.col("n") <= k) | F.array_contains(slots, F.col("i"))).drop("i", "n")


def pilot(rows: DataFrame, keys: list[str], order: list[str], row_id: str, wanted: list[str], limit: int) -> DataFrame:
    """`limit` rows of each group: evenly spaced in its order, filled up from the start, and for each flag of `wanted` at least one row that has it.

    For a flag that no chosen row has, the group's first row with it takes the place of the last chosen row that has no flag at all, or of the
    last one. Rows that repeat an id count once. Slots and first rows are found by windows; only those, at most `limit` and one a flag, are
    brought together for the exchange.
    """
    w = Window.partitionBy(*keys).orderBy(*order, row_id)
    rows = rows.withColumn("__r", F.row_number().over(Window.partitionBy(*keys, row_id).orderBy(*order))).where("__r = 1").drop("__r")
    numbered = rows.withColumn("__i", F.row_number().over(w) - 1).withColumn("__n", F.count("*").over(Window.partitionBy(*keys)))
    slots = F.transform(F.sequence(F.lit(0), F.lit(max(limit, 1) - 1)), lambda s: F.bround(s * (F.col("__n") - 1) / max(limit - 1, 1)).cast("int"))
    numbered = numbered.withColumn("__slot", (F.col("__n") <= limit) | F.array_contains(slots, F.col("__i")))
    # Slots can coincide where ids repeat no more; the first rows that are no slot fill the rest.
    spare = F.sum(F.when(~F.col("__slot"), 1)).over(w)
    chosen = F.sum(F.col("__slot").cast("int")).over(Window.partitionBy(*keys))
    numbered = numbered.withColumn("__chosen", F.col("__slot") | (F.coalesce(spare, F.lit(0)) <= limit - chosen) & ~F.col("__slot"))
    firsts = {f"__first_{k}": (F.col(k) == 1) & (F.sum((F.coalesce(F.col(k), F.lit(0)) == 1).cast("int")).over(w) == 1) for k in wanted}
    numbered = numbered.withColumns({k: F.coalesce(v, F.lit(False)) for k, v in firsts.items()})
    some = numbered.where(reduce(lambda a, b: a | b, [F.col("__chosen"), *map(F.col, firsts)]))
    names = rows.columns

    def exchange(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("__i")
        mark = {k: pdf[f"__first_{k}"].to_numpy() for k in wanted}
        has = pdf[wanted].fillna(0).to_numpy() == 1
        working = list(np.flatnonzero(pdf["__chosen"].to_numpy()))[: max(limit, 0)]
        for j, k in enumerate(wanted):
            if not working or has[working, j].any() or not mark[k].any():
                continue
            bare = [p for p, i in enumerate(working) if not has[i].any()]
            working[bare[-1] if bare else len(working) - 1] = int(mark[k].argmax())
        return pdf.iloc[sorted(working)][names]

    return some.groupBy(*keys).applyInPandas(exchange, rows.schema)


def to_hide(events: DataFrame, kinds: DataFrame, most: float = 0.5) -> DataFrame:
    """Events of messages alone with little confidence, as a patch that hides them; kinds is (id, photo, line)."""
    return events.where(F.col("confidence") <= most).join(kinds.where("line > 0 and photo = 0").select("id"), "id", "left_semi").select(F.col("id").alias("event_id"), F.lit(1).alias("is_hidden"))
