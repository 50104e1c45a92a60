"""What people read: phases, durations, shortened texts, dates, ranges and lists as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# How phases are shown.
PHASES = {"EARLY_PHASE1": "Early Phase 1", "PHASE1": "Phase 1", "PHASE2": "Phase 2", "PHASE3": "Phase 3", "PHASE4": "Phase 4", "NA": "Not Applicable"}

#: A code of a classification of diseases. A fixed value.
CODE = r"\b[A-TV-Z][0-9][0-9AB]\.?[0-9]{0,4}\b|\b[0-9]{3}\.?[0-9]{0,2}\b"

#: Signs that a range of ids may have.
MOST_RANGE = 200

OTHER_NAMES = "array<struct<first_name: string, last_name: string>>"


def phases(values: Column) -> Column:
    """Phases by their shown names, with commas; unknown ones as they are, and "None" for a missing list."""
    names = F.create_map(*(F.lit(x) for pair in PHASES.items() for x in pair))
    return F.coalesce(F.array_join(F.transform(values, lambda p: F.coalesce(F.try_element_at(names, p), p)), ", "), F.lit("None"))


def duration(ms: Column) -> Column:
    """About how long, in minutes and seconds; two dashes for none."""
    whole = F.floor(ms / 1000).cast("long")
    minutes, seconds = F.floor(whole / 60), whole % 60
    return F.when(ms > 0, F.when(minutes > 0, F.format_string("~%dm %ds", minutes, seconds)).otherwise(F.format_string("~%ds", seconds))).otherwise("--")


def shortened(text: Column, most: int, missing: str = "") -> Column:
    """A text, cut with three dots past a length; a word of its own for a missing or empty one."""
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit("..."))).otherwise(text)
    return F.when(F.coalesce(text, F.lit("")) == "", missing).otherwise(cut)


def moment(at: Column) -> Column:
    return F.date_format(at, "yyyy-MM-dd HH:mm 'UTC'")


def id_range(ids: Column) -> Column:
    """The first and the last of a list of ids, cut to MOST_RANGE signs; empty for an empty list."""
    first, last = F.get(ids, F.lit(0)), F.get(ids, F.size(ids) - 1)
    return F.substring(F.when(F.size(ids) == 0, "").when(F.size(ids) == 1, first).otherwise(F.concat(first, F.lit(" ... "), last)), 1, MOST_RANGE)


def condition_ok(value: Column) -> Column:
    """Whether a condition reads like one: no quotes, no full stop and no code of a classification."""
    return ~(F.contains(value, F.lit('"')) | F.contains(value, F.lit("'")) | F.contains(value, F.lit(".")) | value.rlike(CODE))


def by_value(rates: Column) -> Column:
    """The entries of a map, those with the largest value first, equal ones by key."""
    order = F.transform(F.map_entries(rates), lambda e: F.struct((-e["value"]).alias("n"), e["key"].alias("key"), e["value"].alias("value")))
    return F.transform(F.array_sort(order), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value")))


def names_json(names: Column) -> Column:
    """Other names as JSON text; null for a missing list."""
    return F.to_json(names)


def names_from(text: Column) -> Column:
    """Other names from JSON text; an empty list for a missing or broken one."""
    return F.coalesce(F.from_json(text, OTHER_NAMES), F.array().cast(OTHER_NAMES))
