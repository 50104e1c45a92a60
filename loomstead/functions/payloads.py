"""JSON payloads of events, and decisions written as JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BACKFILL = "count string, from string, to string, requestedAt string, index string"

#: Payload of a decision on a term.
DECISION = "term string, accepted boolean, reason string, similarity double"


def exact_date(value: Column) -> Column:
    return F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), value.try_cast("date"))


def backfill(payload: Column) -> Column:
    """Struct (count, from, to, index) of a backfill event; null unless count > 0, both dates are exact and in order, and a timestamp is there."""
    p = F.from_json(payload, BACKFILL)
    count, first, last = p["count"].try_cast("long"), exact_date(p["from"]), exact_date(p["to"])
    good = (count > 0) & (first <= last) & F.try_to_timestamp(p["requestedAt"]).isNotNull() & (p["index"].isNull() | p["index"].try_cast("int").isNotNull())
    return F.when(good, F.struct(count.alias("count"), first.alias("from"), last.alias("to"), p["index"].try_cast("int").alias("index")))


def incremental(payload: Column) -> Column:
    """Struct (count, from, to) of an incremental event; older ones hold a count only."""
    p = F.from_json(payload, BACKFILL)
    count = p["count"].try_cast("long")
    only = p["from"].isNull() & p["to"].isNull()
    first, last = F.try_to_timestamp(p["from"]), F.try_to_timestamp(p["to"])
    return F.when((count >= 0) & (only | (first <= last)), F.struct(count.alias("count"), first.alias("from"), last.alias("to")))


def written(count: Column, first: Column, last: Column) -> Column:
    """The payload of an incremental event, as incremental() reads it: times in UTC, and one that isn't there written as null."""
    at = lambda t: F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    return F.to_json(F.struct(count.alias("count"), at(first).alias("from"), at(last).alias("to")), {"ignoreNullFields": "false"})


def number(value: Column) -> Column:
    """A number given as such or as text."""
    return value.cast("string").try_cast("double")


def rates(payload: Column) -> Column:
    """A map of names to rates without those that are null."""
    return F.map_filter(F.from_json(payload, "map<string,decimal(18,4)>"), lambda k, v: v.isNotNull())


def decisions(structs: Column) -> Column:
    """An array of decisions as JSON, nulls written out."""
    return F.to_json(structs, {"ignoreNullFields": "false"})
