"""Clock texts. Seconds may be fractional; which function rounds, floors or truncates is part of its meaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _hms(s: Column) -> Column:
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)


def timestamp_rounded(seconds: Column) -> Column:
    """HH:MM:SS, rounded."""
    return _hms(F.round(seconds).cast("long"))


def timestamp_floored(seconds: Column) -> Column:
    """HH:MM:SS, floored."""
    return _hms(F.floor(seconds).cast("long"))


def srt_timestamp(ms: Column) -> Column:
    """HH:MM:SS,mmm from milliseconds."""
    return F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3600000), F.floor(ms % 3600000 / 60000), F.floor(ms % 60000 / 1000), ms % 1000)


def clock(seconds: Column) -> Column:
    """m:ss or h:mm:ss."""
    s = F.floor(seconds).cast("long")
    long = F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)
    return F.when(s >= 3600, long).otherwise(F.format_string("%d:%02d", F.floor(s / 60), s % 60))


def parse_clock(text: Column) -> Column:
    """Seconds of m:ss or h:mm:ss; null for anything else."""
    fine = text.rlike(r"^\d+(:\d{2}){1,2}$")
    return F.when(fine, F.aggregate(F.split(text, ":"), F.lit(0).cast("long"), lambda acc, x: acc * 60 + x.cast("long")))


def duration(seconds: Column) -> Column:
    """1h02m03s, 2m03s or 3s."""
    s = F.round(seconds).cast("long")
    return F.when(s >= 3600, F.format_string("%dh%02dm%02ds", F.floor(s / 3600), F.floor(s % 3600 / 60), s % 60)).when(s >= 60, F.format_string("%dm%02ds", F.floor(s / 60), s % 60)).otherwise(F.format_string("%ds", s))


def parse_duration(text: Column) -> Column:
    """Seconds of texts such as 10m, 1h5m, 90s, 250ms; null for anything else."""
    part = lambda unit: F.coalesce(F.try_to_number(F.nullif(F.regexp_extract(text, rf"(?:^|[a-z])(\d+){unit}(?![a-z])", 1), F.lit("")), F.lit("999999999")).cast("double"), F.lit(0.0))
    fine = text.rlike(r"^(\d+h)?(\d+m)?(\d+s)?(\d+ms)?$") & (text != "")
    return F.when(fine, part("h") * 3600 + part("m") * 60 + part("s") + part("ms") / 1000)


def estimated_ms(words: Column) -> Column:
    """How long so many words take: words / 2.5 + 1 seconds."""
    return words * 400 + 1000


def word_at(start: Column, end: Column) -> Column:
    """When a word counts as spoken: 100 ms after its start, or halfway if it is shorter."""
    return start + F.least(F.lit(100), F.floor((end - start) / 2)).cast("long")
