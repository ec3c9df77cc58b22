"""Flags and removal of what a model's text must not say of people."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

#: Words of relations, feelings and sensitive attributes, and forms that claim too much.
RELATIONS = ["恋人", "彼氏", "彼女", "カップル", "家族", "友人", "友達", "同僚", "母", "父", "妻", "夫", "girlfriend", "boyfriend", "lover", "couple", "family", "friend", "coworker"]
FEELINGS = ["怒っている", "悲しんでいる", "幸せそう", "楽しそう", "悲しそう", "smiling happily", "depressed", "angry", "sad", "happy"]
ATTRIBUTES = ["病気", "障害", "宗教", "政治", "犯罪歴", "性的", "医療", "支持政党", "職業", "国籍", "sick", "disabled", "religion", "religious", "political", "politics", "medical", "sexuality", "nationality"]
CERTAIN = ["確実に", "間違いなく", "definitely", "certainly"]
CLAIMS = [*CERTAIN, "している", "食べている", "新宿にいる", "カフェにいる"]
SOFTER = (("している", "している可能性があります"), ("した", "した可能性があります"))
FLAGS = (("relationship_inference_removed", RELATIONS), ("emotion_inference_removed", FEELINGS), ("sensitive_attribute_removed", ATTRIBUTES), ("overclaim_softened", CLAIMS))


def flags(text: Column) -> Column:
    """The flags of a text, in order; two general ones follow where there is any."""
    any_ = lambda low, words: reduce(lambda a, b: a | b, [F.contains(low, F.lit(w.lower())) for w in words])
    # A text is lower-cased once, not once a word.
    own = F.get(F.transform(F.array(F.lower(F.coalesce(text, F.lit("")))), lambda low: F.array_compact(F.array(*[F.when(any_(low, words), F.lit(name)) for name, words in FLAGS]))), F.lit(0))
    general = F.array(F.lit("sensitive_terms_removed"), F.lit("forbidden_terms_removed"))
    return F.get(F.transform(F.array(own), lambda x: F.when(F.size(x) > 0, F.concat(x, general)).otherwise(x)), F.lit(0))


def cleaned(text: Column, most: int) -> Column:
    """A text with softened claims and without these words, the longest first and whatever their case, on one line and cut;
    null where nothing is left."""
    either = lambda words: "(?i)" + "|".join(rf"\Q{w}\E" for w in sorted(words, key=lambda w: (-len(w), w)))
    soft = reduce(lambda c, r: F.replace(c, F.lit(r[0]), F.lit(r[1])), SOFTER, F.regexp_replace(F.trim(text), either(CERTAIN), ""))
    left = F.btrim(F.regexp_replace(F.regexp_replace(soft, either({*RELATIONS, *FEELINGS, *ATTRIBUTES}), ""), r"\s{2,}", " "), F.lit(" 、。,."))
    cut = F.when(F.length(left) > most, F.concat(F.rtrim(F.substring(left, 1, most - 1)), F.lit("…"))).otherwise(left)
    return F.when(cut != "", cut)
