"""Time: parsing, validity, freshness and overlap, all as expressions over a given reference time (never `now`)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Half-lives in days.
HALFLIFE_DAYS = {
    "price": 0.5, "stock_price": 0.5, "status": 3.0, "outage": 0.25, "headcount": 180.0, "revenue": 120.0,
    "ceo": 365.0, "cto": 365.0, "address": 730.0, "founded": 1e9, "birth_date": 1e9, "default": 240.0,
}
# Formats tried in this order, day before month.
FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "d/M/yyyy", "M/d/yyyy", "yyyy-MM", "yyyy", "MMMM yyyy", "MMM yyyy", "d MMMM yyyy", "d MMM yyyy", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "MMM d yyyy")
FEED_FORMATS = ("d MMM yyyy HH:mm:ss Z", "d MMM yyyy HH:mm:ss z", "d MMM yyyy HH:mm:ss", "d MMM yyyy")


def parse_time(text: Column, formats: tuple[str, ...] = FORMATS) -> Column:
    """A timestamp from ISO text, one of the formats (after a day's name), or the first year named; null where none fits."""
    t = F.regexp_replace(F.trim(text), "^[A-Za-z]{3}, *", "")
    iso = F.when(t.rlike(r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}.*)?$"), F.try_to_timestamp(F.replace(t, F.lit("Z"), F.lit("+00:00"))))
    year = F.nullif(F.regexp_extract(t, r"\b(1[89]\d{2}|2[01]\d{2})\b", 1), F.lit(""))
    return F.coalesce(iso, *[F.try_to_timestamp(t, F.lit(f)) for f in formats], F.try_to_timestamp(F.concat(year, F.lit("-01-01"))))


def halflife(attribute: Column) -> Column:
    table = F.create_map(*[F.lit(x) for pair in HALFLIFE_DAYS.items() for x in pair])
    return F.coalesce(F.try_element_at(table, F.lower(attribute)), F.lit(HALFLIFE_DAYS["default"]))


def covers(start: Column, end: Column, t: Column) -> Column:
    """Half-open interval with null for an open bound."""
    return (start.isNull() | (start <= t)) & (end.isNull() | (t < end))


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    before = lambda x, y: x.isNull() | y.isNull() | (x < y)
    return before(a_start, b_end) & before(b_start, a_end)


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / F.lit(86_400_000_000.0)


def freshness(at: Column, ref: Column, halflife_days: Column) -> Column:
    """0.5 to the power of age over half-life: 0.3 without a date, 1 for the future."""
    age = F.greatest(F.lit(0.0), days_between(ref, at))
    return F.when(at.isNull(), F.lit(0.3)).otherwise(F.pow(F.lit(0.5), age / F.greatest(halflife_days, F.lit(1e-6))))


def overlap_score(start: Column, end: Column, intent: str, anchor: Column, range_start: Column | None = None, range_end: Column | None = None) -> Column:
    """How well a validity interval (null: open) serves a question of the given intent."""
    if intent == "CURRENT":
        years = F.floor(days_between(anchor, end)) / 365.25
        return F.when(end.isNull(), 1.0).when(end >= anchor, 0.9).otherwise(F.pow(F.lit(0.5), years) * 0.4)
    if intent in ("HISTORICAL", "AS_OF"):
        gap = F.least(F.abs(F.floor(days_between(anchor, start))), F.abs(F.floor(days_between(anchor, end))))
        return F.when(covers(start, end, anchor), 1.0).otherwise(F.pow(F.lit(0.5), gap / 365.25))
    if intent == "RANGE":
        low, high = F.greatest(start, range_start), F.least(end, range_end)
        return F.greatest(F.lit(0.0), F.least(F.lit(1.0), days_between(high, low) / F.greatest(days_between(range_end, range_start), F.lit(1 / 86400))))
    if intent == "CHANGE":
        return 0.5 + 0.25 * (start.isNotNull().cast("int") + end.isNotNull().cast("int"))
    return F.lit(0.5)


def shown_date(at: Column, precision: Column | None = None) -> Column:
    """A date no more precise than its source states it (`year`, `month`, else the day); "unknown" for null."""
    day = F.date_format(at, "yyyy-MM-dd")
    if precision is not None:
        day = F.when(precision == "year", F.date_format(at, "yyyy")).when(precision == "month", F.date_format(at, "MMMM yyyy")).otherwise(day)
    return F.coalesce(day, F.lit("unknown"))


def shown_end(at: Column, precision: Column | None = None) -> Column:
    """The end of a validity: "present" for an open one."""
    return F.when(at.isNull(), "present").otherwise(shown_date(at, precision))


def next_poll_seconds(polls: Column, changes: Column, base: int = 3600, low: int = 300, high: int = 604_800) -> Column:
    """Polling interval from the share of polls that saw a change; the base before the third poll."""
    v = changes / F.greatest(polls, F.lit(1))
    wanted = F.when(v < 0.5, base / F.greatest(v, F.lit(0.01))).otherwise(base * v)
    return F.when(polls < 3, F.lit(base)).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), wanted))).cast("int")
