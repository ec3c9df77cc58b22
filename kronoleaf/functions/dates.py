"""Dates that a question names, and ranges of days and months."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def _day(y: Column, m: Column, d: Column) -> Column:
    return F.try_to_date(F.concat_ws("-", F.lpad(y.cast("string"), 4, "0"), F.lpad(m.cast("string"), 2, "0"), F.lpad(d.cast("string"), 2, "0")), "yyyy-MM-dd")


def month_bounds(year: Column, month: Column) -> Column:
    """struct<start, end> of a month; null where there is no such month."""
    first = _day(year, month, F.lit("1"))
    return F.when(first.isNotNull(), F.struct(first.alias("start"), F.last_day(first).alias("end")))


def days_between(start: Column, end: Column) -> Column:
    """All days from the first to the last, both included; null where the last comes first."""
    return F.when(end >= start, F.sequence(start, end))


def date_range(query: Column, today: Column, default_year: int) -> Column:
    """struct<start, end> of the first rule that fits a question: a full date, a month, a day without a year
    (of `default_year`), then words such as yesterday, this month, lately, last summer; null where none does."""
    none = F.lit(None).cast("struct<start:date,end:date>")
    one = lambda d: F.when(d.isNotNull(), F.struct(d.alias("start"), d.alias("end"))).otherwise(none)
    pair = lambda a, b: F.struct(a.alias("start"), b.alias("end"))
    has, part = lambda p: F.rlike(query, F.lit(p)), lambda p, i: F.regexp_extract(query, p, i)
    span = lambda y, a, b: pair(F.make_date(y, F.lit(a[0]), F.lit(a[1])), F.make_date(y, F.lit(b[0]), F.lit(b[1])))
    written, numeric = r"(\d{4})年(\d{1,2})月(\d{1,2})日", r"(\d{4})[-/](\d{1,2})[-/](\d{1,2})"
    month, dashed, short, last_month = r"(\d{4})年(\d{1,2})月(?!\d{1,2}日)", r"(\d{4})-(\d{1,2})(?!-\d{1,2})", r"(?<!\d)(\d{1,2})月(\d{1,2})日", r"去年(?:の)?(\d{1,2})月"
    full = lambda p: _day(part(p, 1), part(p, 2), part(p, 3))
    before = F.trunc(F.add_months(today, -1), "month")
    year = F.year(today)
    exact = F.when(has(written), full(written)).when(has(numeric), full(numeric))
    return (
        F.when(exact.isNotNull(), one(exact)).when(has(numeric), none)
        .when(has(month), month_bounds(part(month, 1), part(month, 2))).when(has(dashed), month_bounds(part(dashed, 1), part(dashed, 2)))
        .when(has(short), one(_day(F.lit(default_year), part(short, 1), part(short, 2))))
        .when(has("昨日"), one(F.date_sub(today, 1))).when(has("今日"), one(today))
        .when(has("今月"), pair(F.trunc(today, "month").cast("date"), F.last_day(today))).when(has("先月"), pair(before.cast("date"), F.last_day(before)))
        .when(has("最近|この1か月|この一か月"), pair(F.date_sub(today, 30), today)).when(has("去年の夏"), span(year - 1, (6, 1), (8, 31)))
        .when(has(last_month), month_bounds((year - 1), part(last_month, 1))).when(has("去年"), span(year - 1, (1, 1), (12, 31))).when(has("今年"), span(year, (1, 1), (12, 31)))
    )
