"""Windows of days, both ends included: their union, what is left of some without others, and which lie within one.

All of it is sweeps over windows in the order of their starts. A key has one window a start at most before it is swept, the longest, as partial aggregates
make it, so a key's sweep holds no more rows than there are days, however many windows it has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _free(df: DataFrame, *others: DataFrame) -> str:
    """The beginning of names that no column of these has."""
    taken, name = {c.lower() for d in (df, *others) for c in d.columns}, "_w"
    while any(c.startswith(name) for c in taken):
        name += "_"
    return name


def longest(windows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end): of the windows of a key that begin on one day, the longest; those with a null or that end before they begin are left out."""
    return windows.where(F.col(start) <= F.col(end)).groupBy(*keys, start).agg(F.max(end).alias(end))


def union_of(windows: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """(keys, start, end): the days of a key's windows as few windows that neither overlap nor touch. Null keys are keys."""
    swept, free = longest(windows, keys, start, end), _free(windows)
    order = Window.partitionBy(*keys).orderBy(start)
    reach = F.max(end).over(order.rowsBetween(Window.unboundedPreceding, -1))
    opens = (reach.isNull() | (F.col(start) > F.date_add(reach, 1))).cast("int")
    numbered = swept.withColumn(free, opens).withColumn(free, F.sum(free).over(order))
    return numbered.groupBy(*keys, free).agg(F.min(start).alias(start), F.max(end).alias(end)).drop(free)


def without(planned: DataFrame, done: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """planned with left_start and left_end: a row for each window of days of a row that no window of done of its key holds, none for a row that is done.

    What is done of a key comes to its rows as one sorted array of windows that don't touch, so of one window for two days at most. Rows of planned with a
    null or an end before the start have no days.
    """
    free = _free(planned, done)
    names = [f"{free}_{k}" for k in range(len(keys))]
    islands = union_of(done, keys, start, end).withColumnsRenamed(dict(zip(keys, names, strict=True)))
    held = islands.groupBy(*names).agg(F.sort_array(F.collect_list(F.struct(F.col(start).alias("s"), F.col(end).alias("e")))).alias(free))
    same = [planned[k].eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    joined = planned.where(F.col(start) <= F.col(end)).join(held, same, "left").drop(*names)
    none = F.array().cast("array<struct<s: date, e: date>>")
    met = F.filter(F.coalesce(F.col(free), none), lambda w: (w["s"] <= F.col(end)) & (w["e"] >= F.col(start)))
    joined = joined.withColumn(free, met)
    starts = F.concat(F.array(F.col(start)), F.transform(free, lambda w: F.date_add(w["e"], 1)))
    ends = F.concat(F.transform(free, lambda w: F.date_sub(w["s"], 1)), F.array(F.col(end)))
    left = F.filter(F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("s"), e.alias("e"))), lambda w: w["s"] <= w["e"])
    exploded = joined.withColumn(free, F.explode(left))
    return exploded.select(*planned.columns, F.col(f"{free}.s").alias("left_start"), F.col(f"{free}.e").alias("left_end"))


def contained(planned: DataFrame, done: DataFrame, keys: list[str], start: str = "start", end: str = "end", name: str = "contained") -> DataFrame:
    """planned with a boolean: whether one window of done of the row's key holds all of the row's days.

    Of the windows that begin no later, the one that reaches farthest decides, so a running maximum over both in the order of starts tells, without a join.
    A row that has no days, by a null or an end before its start, is contained in nothing.
    """
    free = _free(planned, done)
    reach, row, kind = f"{free}_reach", f"{free}_row", f"{free}_kind"
    rows = planned.select(*keys, start, F.lit(1).alias(kind), F.lit(None).cast("date").alias(reach), F.struct(*planned.columns).alias(row))
    shape = rows.schema[row].dataType
    begun = longest(done, keys, start, end).select(*keys, start, F.lit(0).alias(kind), F.col(end).alias(reach), F.lit(None).cast(shape).alias(row))
    upto = Window.partitionBy(*keys).orderBy(F.asc_nulls_first(start), kind).rowsBetween(Window.unboundedPreceding, 0)
    told = begun.unionByName(rows).withColumn(reach, F.max(reach).over(upto)).where(F.col(kind) == 1)
    inside = (F.col(f"{row}.{start}") <= F.col(f"{row}.{end}")) & (F.col(f"{row}.{end}") <= F.col(reach))
    return told.select(f"{row}.*", F.coalesce(inside, F.lit(False)).alias(name))


def days(start: Column, end: Column) -> Column:
    """How many days a window has."""
    return F.greatest(F.datediff(end, start) + 1, F.lit(0))
