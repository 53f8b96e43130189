"""Dates: reading them from free text, ages and labels. `now` is always given, so results repeat."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import stripped

# ---- fixed values ----
#: Month names, English and French.
MONTHS = {
    "january": 1, "jan": 1, "janvier": 1, "february": 2, "feb": 2, "février": 2, "fevrier": 2, "march": 3, "mar": 3, "mars": 3, "april": 4, "apr": 4, "avril": 4, "may": 5, "mai": 5, "june": 6, "jun": 6, "juin": 6,
    "july": 7, "jul": 7, "juillet": 7, "august": 8, "aug": 8, "août": 8, "aout": 8, "september": 9, "sep": 9, "sept": 9, "septembre": 9, "october": 10, "oct": 10, "octobre": 10, "november": 11, "nov": 11, "novembre": 11,
    "december": 12, "dec": 12, "décembre": 12, "decembre": 12,
}
#: Seconds of the units in relative dates.
UNITS = {"minute": 60, "hour": 3600, "heure": 3600, "day": 86400, "jour": 86400, "week": 604800, "semaine": 604800, "month": 2592000, "mois": 2592000}
DAY = 86_400_000_000
EXPIRY_DAYS = 60


def instant(now: datetime) -> Column:
    return F.lit(now.strftime("%Y-%m-%d %H:%M:%S.%f")).cast("timestamp")


def micros(t: Column) -> Column:
    return F.unix_micros(t.cast("timestamp"))


def _at(seconds: Column) -> Column:
    return F.timestamp_micros((seconds * 1_000_000).cast("long"))


def _named(year: Column, month: Column, day: Column) -> Column:
    table = F.create_map(*(F.lit(x) for k, v in MONTHS.items() for x in (k, v)))
    return F.when(F.try_element_at(table, F.lower(month)).isNotNull(), F.try_to_timestamp(F.format_string("%s-%02d-%02d", year, F.try_element_at(table, F.lower(month)), day.try_cast("int"))))


def parse_date(x: Column, now: datetime) -> Column:
    """Epoch seconds or milliseconds, ISO forms, month names in either order, ages ('3 days ago'), today, yesterday; else null."""
    s = stripped(x)
    n, lower = instant(now), F.lower(s)
    part = lambda p, g: F.nullif(F.regexp_extract(s, p, g), F.lit(""))
    first, second = r"(?iu)([a-zéûôàç]+)\s+(\d{1,2}),?\s+(\d{4})", r"(?iu)(\d{1,2})\s+([a-zéûôàç]+)\.?,?\s+(\d{4})"
    rel = r"(?i)(\d+)\s*(minute|hour|day|week|month|jour|heure|semaine|mois)s?"
    unit = F.try_element_at(F.create_map(*(F.lit(v) for k, u in UNITS.items() for v in (k, u))), F.lower(F.regexp_extract(s, rel, 2)))
    return F.coalesce(
        F.when(s.rlike(r"^\d{10}$"), _at(s.try_cast("long"))),
        F.when(s.rlike(r"^\d{13}$"), F.timestamp_millis(s.try_cast("long"))),
        F.when(s.rlike(r"^\d{4}-\d{2}-\d{2}"), s.try_cast("timestamp")),
        F.when(s.rlike(r"^[A-Za-z]{3}, \d{1,2} [A-Za-z]{3} \d{4}"), F.try_to_timestamp(F.regexp_extract(s, r"^[A-Za-z]{3}, (.*?)(?: GMT| UTC| \+0000)?$", 1), F.lit("d MMM yyyy HH:mm:ss"))),
        _named(part(first, 3), part(first, 1), part(first, 2)),
        _named(part(second, 3), part(second, 2), part(second, 1)),
        F.when(s.rlike(rel), F.timestamp_micros(micros(n) - F.regexp_extract(s, rel, 1).try_cast("long") * unit * 1_000_000)),
        F.when(lower.rlike(r"\b(today|aujourd)"), n),
        F.when(lower.rlike(r"\byesterday|hier\b"), F.timestamp_micros(micros(n) - DAY)),
    )


def parse_age(x: Column, now: datetime) -> Column:
    """Ages as boards state them ('Posted 30+ Days Ago', 'today', 'yesterday'), else as any date."""
    pattern = r"(?i)(\d+)\+?\s*(day|month|hour)s?\s+ago"
    unit = F.try_element_at(F.create_map(*(F.lit(v) for k, u in UNITS.items() for v in (k, u))), F.lower(F.regexp_extract(x, pattern, 2)))
    back = lambda seconds: F.timestamp_micros(micros(instant(now)) - seconds.cast("long") * 1_000_000)
    return F.when(x.rlike(pattern), back(F.regexp_extract(x, pattern, 1).try_cast("long") * unit)).when(x.rlike(r"(?i)\btoday\b"), instant(now)).when(x.rlike(r"(?i)\byesterday\b"), back(F.lit(86400))).otherwise(parse_date(x, now))


def days_since(t: Column, now: datetime) -> Column:
    return F.floor((micros(instant(now)) - micros(t)) / DAY)


def relative_time(t: Column, now: datetime) -> Column:
    """A short label of an age."""
    d = days_since(t, now)
    hours = F.floor((micros(instant(now)) - micros(t)) / 3_600_000_000)
    say = lambda v, unit: F.concat(v.cast("string"), F.lit(unit))
    return (
        F.when(t.isNull(), "Date unknown")
        .when((d <= 0) & (hours <= 1), "Just posted").when(d <= 0, say(hours, "h ago")).when(d == 1, "Yesterday").when(d < 7, say(d, " days ago"))
        .when(d < 14, "1 week ago").when(d < 31, say(F.floor(d / 7), " weeks ago")).when(d < 60, "1 month ago").otherwise(say(F.floor(d / 30), " months ago"))
    )


def is_expired(t: Column, now: datetime, days: int = EXPIRY_DAYS) -> Column:
    return F.coalesce(days_since(t, now) > days, F.lit(False))


def expires_at(t: Column, days: int = EXPIRY_DAYS) -> Column:
    return F.timestamp_micros(micros(t) + days * DAY)
