"""Dates given in part, and spans of time."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

# Months by their English abbreviation.
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

# Hours of a period's token; 24 for any other.
PERIOD_HOURS = {"1h": 1, "6h": 6, "24h": 24, "7d": 168}


def partial_date(value: Column) -> Column:
    """A date of yyyy, yyyy-MM or yyyy-MM-dd, missing parts as 1; null for anything else."""
    full = F.regexp_extract(F.trim(value), r"^(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?$", 0)
    padded = F.when(F.length(full) == 4, F.concat(full, F.lit("-01-01"))).when(F.length(full) == 7, F.concat(full, F.lit("-01"))).when(F.length(full) == 10, full)
    return padded.try_cast("date")


def month_number(value: Column) -> Column:
    """A month's number by its name's first three letters or as digits; 1 for anything else."""
    named = F.lit(None).cast("int")
    for i, name in enumerate(MONTHS):
        named = F.when(F.lower(F.substring(F.trim(value), 1, 3)) == name, F.lit(i + 1)).otherwise(named)
    number = F.trim(value).try_cast("int")
    return F.coalesce(named, F.when(number.between(1, 12), number), F.lit(1))


def publication_date(year: Column, month: Column, day: Column) -> Column:
    """A publication's date; null without a year."""
    text = F.format_string("%04d-%02d-%02d", year.try_cast("int"), month_number(month), F.coalesce(day.try_cast("int"), F.lit(1)))
    return F.when(year.try_cast("int").isNotNull(), text.try_cast("date"))


def period_start(period: str, now: Column) -> Column:
    """The start of the day, the week (on Monday) or the month of now."""
    if period not in ("day", "week", "month"):
        raise ValueError(f"no period: {period}")
    return F.date_trunc(period, now)


def cutoff(token: str | None, now: Column) -> Column:
    return now - F.expr(f"interval {PERIOD_HOURS.get((token or '').strip().lower(), 24)} hours")


def remaining_hours(records: Column, elapsed_ms: Column, total: Column) -> Column:
    """Hours to go at the rate so far, at least 0; null without a rate."""
    rate = F.try_divide(records.cast("double"), F.nullif(elapsed_ms / F.lit(3_600_000.0), F.lit(0.0)))
    return F.when(rate > 0, F.greatest(F.lit(0.0), total - records) / rate)


def month_chunks(first: dt.date, last: dt.date, most: int, count) -> list[tuple[dt.date, dt.date]]:
    """Windows of days from first to last: months, halved while they hold more than most by count(from, to) and more than a day; none that holds nothing."""

    def halved(a: dt.date, b: dt.date) -> list[tuple[dt.date, dt.date]]:
        held = count(a, b)
        if a >= b or held <= most:
            return [(a, b)] if held else []
        middle = a + (b - a) // 2
        return halved(a, middle) + halved(middle + dt.timedelta(days=1), b)

    chunks, start = [], first
    while start <= last:
        following = (start.replace(day=1) + dt.timedelta(days=32)).replace(day=1)
        end = min(last, following - dt.timedelta(days=1))
        chunks += halved(start, end)
        start = following
    return chunks
