"""Redaction of recognised texts and of reports, stable public numbers, and repair of model output."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

#: What is redacted from recognised text, in this order, and what stands for it. A mail's name is tried at its start and
#: after the last match only, and not given back: nothing else could match, and each word is read once.
OCR_RULES = (
    (r"(?i)https?://[^\s]+|www\.[^\s]+", "[URL]"), (r"(?:\G|(?<![\w.+-]))[\w.+-]++@[\w.-]+\.[A-Za-z]{2,}", "[EMAIL]"), (r"(?<!\d)(?:\+?\d{1,3}[-\s])?(?:\d{2,4}[-\s]){2,4}\d{2,4}(?!\d)", "[PHONE]"),
    (r"(?<!\d)(?:〒\s*)?\d{3}-\d{4}(?!\d)", "[POSTAL_CODE]"), (r"(?:東京都|北海道|京都府|大阪府|.{2,3}県).{0,24}?(?:市|区|町|村).{0,24}?\d{1,4}(?:[-ー−]\d{1,4}){0,3}", "[ADDRESS]"), (r"(?<!\d)\d{7,}(?!\d)", "[NUMBER]"),
)
#: The same for reports, before those.
REPORT_RULES = ((r"(?<!\d)(?:[+-]?\d{1,3}\.\d{3,})\s*,\s*(?:[+-]?\d{1,3}\.\d{3,})(?!\d)", "[GPS]"), (r"\bmedia_[A-Za-z0-9_-]{8,}\b", "MEDIA_ID_REDACTED"), (r"(?:/[^\s]+)+|(?:[A-Za-z]:\\[^\s]+)", "[PATH]"))


def _cut(text: Column, most: int | None) -> Column:
    return text if most is None else F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


#: A rule is not tried on texts without any of the characters that each of its matches holds.
NEEDED = {"[EMAIL]": "@", "[POSTAL_CODE]": "-", "[ADDRESS]": "都道府県"}


def _replaced(text: Column, pattern: str, label: str) -> Column:
    label_, needed = F.lit(label.replace("$", r"\$")), NEEDED.get(label)
    if not needed:
        return F.regexp_replace(text, F.lit(pattern), label_)
    held = lambda t: reduce(lambda a, b: a | b, [F.contains(t, F.lit(c)) for c in needed])
    return F.get(F.transform(F.array(text), lambda t: F.when(held(t), F.regexp_replace(t, F.lit(pattern), label_)).otherwise(t)), F.lit(0))


def redact_ocr(text: Column, most: int | None = None) -> Column:
    """A recognised text without addresses, numbers and links; runs of three blanks become a line break; null is empty."""
    clean = reduce(lambda c, r: _replaced(c, *r), OCR_RULES, F.coalesce(text, F.lit("")))
    return _cut(F.regexp_replace(F.trim(clean), r"\s{3,}", "\n"), most)


def redact_report(text: Column, most: int = 120) -> Column:
    """A line of a report without positions, ids, paths and what is redacted from recognised text; on one line."""
    clean = reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), REPORT_RULES, F.coalesce(text, F.lit("")))
    return _cut(F.trim(F.regexp_replace(redact_ocr(clean), r"\s+", " ")), most)


def numbered(rows: DataFrame, order: str, name: str, prefix: str) -> DataFrame:
    """Rows with a `label` that numbers names by their first use; none for null and empty names.

    First uses are one row a name, so the numbering window holds distinct names only.
    """
    first = rows.where(F.trim(name) != "").groupBy(F.trim(name).alias("n")).agg(F.min(order).alias("f"))
    label = first.select("n", F.concat(F.lit(prefix + "_"), F.row_number().over(Window.orderBy("f", "n")).cast("string")).alias("label"))
    return rows.join(label, F.trim(rows[name]) == label.n, "left").drop("n").withColumn("label", F.coalesce("label", F.lit("")))


def month_only(date: Column, public: bool = True) -> Column:
    return F.substring(date, 1, 7 if public else 10)


def _balanced(text: Column) -> Column:
    """A text with the brackets closed that it leaves open, told apart from those in strings."""
    start = F.struct(F.lit("").alias("open"), F.lit(False).alias("quoted"), F.lit(False).alias("escaped"))

    def step(acc, c):
        close = F.when(c == "{", "}").when(c == "[", "]")
        pushed = F.when(~acc.quoted & close.isNotNull(), F.concat(close, acc.open)).when(~acc.quoted & c.isin("}", "]") & F.startswith(acc.open, c), F.substr(acc.open, F.lit(2))).otherwise(acc.open)
        quoted = F.when((c == '"') & ~acc.escaped, ~acc.quoted).otherwise(acc.quoted)
        return F.struct(pushed.alias("open"), quoted.alias("quoted"), (acc.quoted & (c == "\\") & ~acc.escaped).alias("escaped"))

    return F.concat(text, F.aggregate(F.split(text, ""), start, step, lambda acc: F.concat(F.when(acc.quoted, '"').otherwise(""), acc.open)))


def repaired_json(text: Column) -> Column:
    """The JSON object of a model's output as compact text, or null: as it stands, out of a code fence, or out of the
    words around it, with trailing commas dropped and open brackets closed."""
    raw = F.trim(text)
    fenced = F.trim(F.regexp_extract(raw, r"(?s)```(?:json|JSON)?\s*(.*?)```", 1))
    region = lambda t: F.when(F.regexp_extract(t, r"(?s)(\{.*\})", 1) != "", F.regexp_extract(t, r"(?s)(\{.*\})", 1)).otherwise(F.regexp_extract(t, r"(?s)(\{.*)", 1))
    commas = lambda t: F.regexp_replace(t, r",\s*([}\]])", "$1")
    tries = [raw, fenced, region(F.when(fenced != "", fenced).otherwise(raw)), region(raw)]

    def parsed(t: Column) -> Column:
        value = F.try_parse_json(t)
        return F.when(F.startswith(F.schema_of_variant(value), F.lit("OBJECT")), F.to_json(value))

    return F.coalesce(*[parsed(f(t)) for t in tries for f in (lambda x: x, commas, lambda x: _balanced(commas(x)))])
