"""Text matching, redaction and list helpers as column expressions."""

from functools import reduce

from pyspark.sql import Column, functions as F


def any_term(columns: list[str], terms: list[str]) -> Column:
    """Whether any column holds any term, whatever its case. Each column is lower-cased once, however many terms there are."""

    def held(column: str) -> Column:
        tests = lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(t.lower())) for t in terms])
        return F.coalesce(F.exists(F.array(F.lower(column)), tests), F.lit(False))

    return reduce(lambda a, b: a | b, [held(c) for c in columns])


def matched_fields(columns: list[str], terms: list[str]) -> Column:
    """Names of the columns with a hit, in the order given."""
    return F.array_compact(F.array(*[F.when(any_term([c], terms), F.lit(c)) for c in columns]))


def matched_terms(columns: list[str], terms: list[str], most: int = 20) -> Column:
    """The first `most` terms with a hit in any column, in the order given."""
    return F.slice(F.array_compact(F.array(*[F.when(any_term(columns, [t]), F.lit(t)) for t in terms])), 1, most)


def shorten(text: Column, most: int) -> Column:
    """Blanks collapsed to one; longer texts cut and marked with three dots."""
    flat = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("..."))).otherwise(flat)


#: Redactions in their order: what is found and what stands for it.
REDACTIONS = ((r"https?://[^ \n\t]+", "[URL]"), (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[EMAIL]"), (r"\+?[0-9]{2,4}[- ][0-9]{2,4}[- ][0-9]{3,4}", "[PHONE]"), (r"[0-9]{6,}", "[NUMBER]"))


def redact(text: Column) -> Column:
    return reduce(lambda c, r: F.regexp_replace(c, r[0], r[1]), REDACTIONS, text)


def overlay(override: Column, base: Column) -> Column:
    """An override that is not empty wins."""
    return F.coalesce(F.when(override != "", override), base)
