"""What a question asks for: entities and intent, as column rules over many questions at once."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Words of each kind of question.
WORDS = {
    "date_qa": ["何して", "何があった", "なにして", "この日"], "summary": ["まとめ", "まとめて", "主な", "思い出", "出来事", "イベント"],
    "location": ["よく行った場所", "行った場所", "場所をまとめ", "場所まとめ"],
    "image": ["っぽい写真", "の写真", "が写っている写真", "写っている写真", "を食べた写真", "食べた写真", "みたいな写真", "らしい写真", "を撮った日", "の画像を探して", "画像を探して"],
    "picture": ["写真", "画像"], "looks": ["いつ", "探して", "写って", "っぽ", "みたい", "らしい"],
    "photo_activity": ["写真が多", "写真を撮", "撮った日", "GPS付き写真", "写真ある"], "photo": ["写真", "GPS", "撮った", "撮影"], "many": ["多", "撮", "ある"],
    "call": ["通話", "電話", "長電話", "不在着信", "着信", "応答", "キャンセル"],
    "food": ["ご飯", "食事", "食べ", "ラーメン", "カフェ", "ランチ", "夜ご飯", "昼ご飯", "おいしかった", "店"],
    "person_activity": ["会った", "出かけた", "会う"],
    "line_person": ["LINEした", "ラインした", "LINEが多", "LINE", "ライン", "話した", "話して"],
    "mention": ["話", "話題", "アルバム", "写真送って", "言ってた"],
    "place": ["行った", "行く", "着いた", "着く", "到着", "どこ", "場所", "駅", "会った", "待ち合わせ"],
}
DISHES = {"ramen": ["ラーメン", "らーめん", "ramen"], "soba": ["そば", "蕎麦", "soba"]}
CALL_STATES = [("missed", ["不在着信"]), ("unanswered", ["応答"]), ("canceled", ["キャンセル"]), ("completed", ["長電話", "通話", "電話"])]
NAME = "[一-龥ぁ-んァ-ヶA-Za-z0-9_ー]"
PLACE_FORMS = [r"([一-龥ぁ-んァ-ヶA-Za-z0-9ー]{1,24})(?:に|へ)(?:行った|行く|行った記録|いた|いる|着いた|向かった)", r"([一-龥ぁ-んァ-ヶA-Za-z0-9ー]{1,24})周辺", r"([一-龥ぁ-んァ-ヶA-Za-z0-9ー]{1,24})(?:駅|公園|空港|店|カフェ|大学)"]
NO_PERSON, NO_PLACE = ["誰", "どこ", "いつ", "何"], ["いつ", "どこ", "何", "なに", "記録", "探して", "行った", "行く", "いた", "いる", "日", "場所", "周辺"]


def names(query: Column, kind: str) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(query, F.lit(w)) for w in WORDS[kind]])


#: What is no part of an entity, anywhere and at its end.
ENTITY_SIGNS, ENTITY_ENDS = "[「」『』\"' \u3000?？。!！]", "(いつ|どこ|何|なに|行った|行く|した|していた|日は|日)$"


def cleaned(entity: Column) -> Column:
    """An entity without signs and without what a question may have left at its end; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.regexp_replace(entity, ENTITY_SIGNS, ""), ENTITY_ENDS, ""), F.lit(""))


def person(query: Column) -> Column:
    """Who comes before the particle of company, or null."""
    who = F.regexp_extract(query, f"({NAME}{{1,20}})(?:さん)?と", 1)
    return F.when((who != "") & ~who.isin(NO_PERSON), who)


def place(query: Column) -> Column:
    """Where one went, was, or what a place's ending follows, or null."""
    out = F.lit(None).cast("string")
    for form in reversed(PLACE_FORMS):
        found = cleaned(F.regexp_extract(query, form, 1))
        out = F.when(found.isNotNull() & ~found.isin(NO_PLACE), found).otherwise(out)
    return out


def first_of(query: Column, entries: list[tuple[str, list[str]]]) -> Column:
    """The first entry any of whose words the question holds."""
    out = F.lit(None).cast("string")
    for name, words in reversed(entries):
        out = F.when(reduce(lambda a, b: a | b, [F.contains(query, F.lit(w)) for w in words]), name).otherwise(out)
    return out


def call_status(query: Column) -> Column:
    return first_of(query, CALL_STATES)


def dish(query: Column) -> Column:
    return first_of(query, list(DISHES.items()))


#: Topics that are named as such, what is no topic of its own, and what a question asks with.
TOPICS, NO_TOPIC = ["アルバム", "研究", "旅行"], ["話", "話題", "した", "していた"]
ASKING = "(のはいつ|はいつ|いつ|ですか|でしたか|教えて|探して|まとめて)"
TOPIC_FORMS = [r"(.+?)の(?:話|話題)", r"([一-龥ぁ-んァ-ヶA-Za-z0-9ー]{1,30})(?:のこと|について)"]


def raw_terms(query: Column) -> Column:
    """The parts of a question between particles and signs, in order and once each."""
    cleaned = F.regexp_replace(F.regexp_replace(query, "[?？。!！]", " "), ASKING, " ")
    parts = F.transform(F.split(cleaned, r"(?U)[\s,、/]+|(?:で|に|を|は|が|と)", -1), lambda x: F.btrim(x, F.lit(" \u3000")))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def topic(query: Column) -> Column:
    """What is talked about, or null: before a word of talking, a named topic, or the first term of a question about talk."""
    text = F.trim(query)
    out = F.when(F.contains(text, F.lit("話")), F.try_element_at(F.filter(raw_terms(text), lambda x: ~x.isin(NO_TOPIC)), F.lit(1)))
    out = F.coalesce(first_of(text, [(t, [t]) for t in TOPICS]), cleaned(out))
    for form in reversed(TOPIC_FORMS):
        found = F.regexp_extract(text, form, 1)
        out = F.when(found != "", cleaned(found)).otherwise(out)
    return out




def food_terms(query: Column) -> Column:
    """The food words that a question holds, in their fixed order."""
    return F.filter(F.array(*map(F.lit, WORDS["food"])), lambda w: F.contains(query, w))


def activity(query: Column) -> Column:
    """photo, call or food: the last of food, call and photo that a question speaks of, or null."""
    return F.when(names(query, "photo"), "photo").when(call_status(query).isNotNull(), "call").when(names(query, "food"), "food")


def _rules(query: Column, dates: Column, where: Column | None) -> list[tuple[Column, str, float, str]]:
    """(test, intent, confidence, reason) in order."""
    q = F.trim(F.regexp_replace(query, r"\s+", " "))
    has = lambda k: names(q, k)
    day = F.coalesce(dates.start == dates.end, F.lit(False))
    span = dates.isNotNull() & ~day
    month = span & (F.dayofmonth(dates.start) == 1) & (dates.end == F.last_day(dates.start))
    visual = has("image") | (has("picture") & has("looks"))
    company = person(q).isNotNull() & (has("person_activity") | has("line_person"))
    #: The order of the rules and how sure each is.
    return [
        (q == "", "unknown", 0.0, "empty"), (day & has("date_qa"), "date_qa", 0.92, "date and what was done"), (month & has("date_qa"), "monthly_summary", 0.88, "month and what was done"),
        (span & (has("summary") | has("date_qa")), "time_range_summary", 0.86, "range and summary"), (has("location"), "location_summary", 0.78, "summary of places"), (dish(q).isNotNull() & visual, "specific_food_search", 0.9, "picture of a dish"),
        (visual, "multimodal_image_search", 0.86, "picture of something"), (has("photo_activity") | (has("photo") & has("many")), "photo_activity", 0.8, "photos taken"), (has("call"), "call_activity", 0.9, "call"), (has("food"), "food_activity", 0.86, "food"),
        (company, "person_interaction", 0.78, "person and company"), (has("mention"), "topic_mention", 0.82, "talk"), (has("place") & (place(q) if where is None else where).isNotNull(), "place_visit", 0.84, "place and movement"), (has("summary"), "event_summary", 0.65, "summary"), (day, "date_qa", 0.72, "date"),
    ]


def _first(rules: list, value, other) -> Column:
    out = other
    for test, *rest in reversed(rules):
        out = F.when(F.coalesce(test, F.lit(False)), value(*rest)).otherwise(out)
    return out


def intent(query: Column, dates: Column, where: Column | None = None) -> Column:
    """The first intent that fits; `dates` is `dates.date_range` of the question, `where` its place where that is a column already."""
    return _first(_rules(query, dates, where), lambda name, sure, why: F.lit(name), F.lit("unknown"))


def classified(query: Column, dates: Column) -> Column:
    """A struct of intent, confidence, route and reason: those of the first rule that fits.

    The number of the rule is found once; the rest is looked up by it.
    """
    rules = _rules(query, dates, None)
    known = [(name, sure, ROUTES.get(name, "unsupported"), why) for _, name, sure, why in rules] + [("unknown", 0.25, "unsupported", "no rule")]
    number = _first([(test, i) for i, (test, *_) in enumerate(rules)], F.lit, F.lit(len(rules)))
    row = lambda r: F.struct(*[F.lit(v).alias(k) for k, v in zip(("intent", "confidence", "route", "reason"), r, strict=True)])
    return F.element_at(F.array(*map(row, known)), number + 1)


def search_intent(query: Column) -> Column:
    """The coarse intent of a plain search: call, food, place, mention or generic, the first that fits."""
    q = F.trim(query)
    has = lambda k: names(q, k)
    return F.when(has("call"), "call_activity").when(has("food"), "food_activity").when(has("place"), "place_visit").when(has("mention"), "topic_mention").otherwise("generic")


#: How sure each intent is, and where it is sent.
ROUTES = {
    "date_qa": "ask", "monthly_summary": "monthly_summary", "time_range_summary": "event_summary", "location_summary": "event_summary", "specific_food_search": "multimodal-search", "multimodal_image_search": "multimodal-search", "photo_activity": "photo_activity",
    "call_activity": "call_search", "food_activity": "search", "person_interaction": "search", "topic_mention": "search", "place_visit": "search", "event_summary": "event_summary",
}


def route(name: Column) -> Column:
    out = F.lit("unsupported")
    for k, v in ROUTES.items():
        out = F.when(name == k, v).otherwise(out)
    return out
