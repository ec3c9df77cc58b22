"""Date keys and calendar helpers over timestamps without a zone."""

from pyspark.sql import Column, functions as F


def day(ts) -> Column:
    """The ISO day of a timestamp, as text."""
    return F.date_format(ts, "yyyy-MM-dd")


def month(ts) -> Column:
    return F.date_format(ts, "yyyy-MM")


def micros(ts) -> Column:
    """Microseconds since 1970 of a zone-less timestamp; exact for gap arithmetic."""
    return F.unix_micros(F.to_timestamp(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp")))


def duration_text(seconds: Column) -> Column:
    """H:MM:SS from an hour on, else M:SS."""
    h, m, s = F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60
    return F.when(h > 0, F.format_string("%d:%02d:%02d", h, m, s)).otherwise(F.format_string("%d:%02d", m, s))


def duration_seconds(text: Column) -> Column:
    """Seconds of M:SS or H:MM:SS; null for other texts or minutes and seconds of 60 and up."""
    parts = F.split(text, ":")
    ok = text.rlike(r"^\d{1,3}:\d{2}(:\d{2})?$")
    at = lambda i: F.try_element_at(parts, F.lit(i)).cast("int")
    three = F.size(parts) == 3
    minutes, seconds = F.when(three, at(2)).otherwise(at(1)), F.when(three, at(3)).otherwise(at(2))
    total = F.when(three, at(1)).otherwise(0) * 3600 + minutes * 60 + seconds
    return F.when(ok & (seconds < 60) & (~three | (minutes < 60)), total)
