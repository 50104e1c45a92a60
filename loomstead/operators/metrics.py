"""Counts, breakdowns, percentiles and rankings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def breakdown(df: DataFrame, column: str, missing: str = "UNKNOWN") -> DataFrame:
    """Rows by a column's value, nulls under another name."""
    return df.groupBy(F.coalesce(column, F.lit(missing)).alias(column)).agg(F.count("*").alias("n"))


#: Ranges of values that percentiles cut each group into.
RANGES = 64


def percentiles(df: DataFrame, keys: list[str], value: str, **shares: float) -> DataFrame:
    """(keys, a column for each share): exact percentiles by linear interpolation over ranks; 0 for a group without values.

    A group's values never meet in one task: approximate quantiles, of a bounded size, cut them into ranges, values are counted, and the two ranks that a
    percentile lies between are found in the range that holds them.
    """
    cuts = [(k + 1) / RANGES for k in range(RANGES - 1)]
    groups = df.groupBy(*keys).agg(F.count(value).alias("_rows"), F.percentile_approx(F.col(value).cast("double"), F.array(*map(F.lit, cuts)), F.lit(1000)).alias("_cuts"))
    names = {k: f"_{k}" for k in keys}
    with_group = lambda rows, side: rows.join(side.withColumnsRenamed(names), [rows[k].eqNullSafe(F.col(names[k])) for k in keys]).drop(*names.values())
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("_value")).agg(F.count("*").alias("_n"))
    placed = with_group(counts, groups).withColumn("_range", F.size(F.filter("_cuts", lambda c: c < F.col("_value")))).drop("_cuts")
    sizes = placed.groupBy(*keys, "_range").agg(F.sum("_n").alias("_size"))
    before = F.coalesce(F.sum("_size").over(Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # RANGES rows a group
    starts = sizes.select(*keys, F.col("_range").alias("_r"), before.alias("_before")).withColumnsRenamed(names)
    found = placed.join(starts, [*(placed[k].eqNullSafe(F.col(names[k])) for k in keys), placed["_range"] == F.col("_r")]).drop(*names.values(), "_r")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys, "_range").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0))
    ranked = found.withColumn("_upto", upto)
    at = lambda rank: F.max(F.when((F.col("_upto") > rank) & (F.col("_upto") - F.col("_n") <= rank), F.col("_value")))
    out = {}
    for name, share in shares.items():
        rank = F.lit(share) * (F.col("_rows") - 1)
        low, high = at(F.floor(rank)), at(F.ceil(rank))
        part = F.max(rank - F.floor(rank))
        out[name] = low + (high - low) * part
    told = ranked.groupBy(*keys).agg(*(c.alias(name) for name, c in out.items()))
    renamed = told.withColumnsRenamed(names)
    joined = groups.join(renamed, [groups[k].eqNullSafe(F.col(names[k])) for k in keys], "left")
    return joined.select(*keys, *(F.coalesce(name, F.lit(0.0)).alias(name) for name in shares))


def with_percentiles(summed: DataFrame, df: DataFrame, keys: list[str], value: str, **shares: float) -> DataFrame:
    """summed, which has a row for each of keys, with percentiles of df beside it."""
    told = percentiles(df, keys, value, **shares).withColumnsRenamed({k: f"_{k}" for k in keys})
    return summed.join(told, [summed[k].eqNullSafe(F.col(f"_{k}")) for k in keys]).drop(*(f"_{k}" for k in keys))


def duration_buckets(df: DataFrame, at: str, value: str, minutes: int) -> DataFrame:
    """Count, mean and percentiles of a value over buckets of so many minutes, aligned to the epoch."""
    placed = df.select(F.window(F.col(at).cast("timestamp_ntz"), f"{minutes} minutes")["start"].alias("bucket"), F.col(value))
    return with_percentiles(placed.groupBy("bucket").agg(F.count("*").alias("n"), F.avg(value).alias("mean")), placed, ["bucket"], value, p50=0.5, p95=0.95, p99=0.99)


def first_by(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row of each key in an order."""
    return top_by(df, keys, 1, *order).drop("rank")


def top_by(df: DataFrame, keys: list[str], n: int, *order: Column) -> DataFrame:
    """The first n rows of each key in an order, with their rank. Spark cuts groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("rank", rank).where(F.col("rank") <= n)


def share_of_total(df: DataFrame, keys: list[str], count: str = "n") -> Column:
    """A count's percentage of its keys' total."""
    return 100.0 * F.col(count) / F.sum(count).over(Window.partitionBy(*keys))


def confusion(actual: Column, predicted: Column) -> list[Column]:
    """Counts of the four cells, precision, recall and F1; 0 where a denominator is."""
    cell = lambda a, p: F.count_if((actual == a) & (predicted == p))
    tp, fp, fn, tn = cell(1, 1), cell(0, 1), cell(1, 0), cell(0, 0)
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    return [
        tp.alias("tp"), fp.alias("fp"), fn.alias("fn"), tn.alias("tn"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"),
        ratio(2 * tp, 2 * tp + fp + fn).alias("f1"),
    ]


def table_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) for each table, and a row "total"; counts of Parquet tables come from their footers."""
    counts = [df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, df in tables.items()]
    all_ = counts[0]
    for c in counts[1:]:
        all_ = all_.unionByName(c)
    return all_.unionByName(all_.agg(F.sum("n").alias("n")).select(F.lit("total").alias("name"), "n"))


def weighted_mean(value: Column, weight: Column) -> Column:
    """Mean of the values that are there; null where none has a weight."""
    there = value.isNotNull()
    return F.try_divide(F.sum(F.when(there, value * weight)), F.nullif(F.sum(F.when(there, weight)), F.lit(0.0)))


def progress(scrapes: DataFrame, source: str = "source", id_: str = "id", kind: str = "kind", records: str = "records") -> DataFrame:
    """For each source, its last discovery, and the batches and records after it."""
    last = scrapes.where(F.col(kind) == "discovery.completed").groupBy(F.col(source).alias("_source")).agg(F.max(id_).alias("discovery"))
    after = scrapes.join(last, scrapes[source].eqNullSafe(F.col("_source"))).drop("_source").where(F.col(id_) >= F.col("discovery"))
    batch = F.col(kind) == "batch.completed"
    return after.groupBy(source, "discovery").agg(F.count_if(batch).alias("batches"), F.coalesce(F.sum(F.when(batch, F.col(records))), F.lit(0)).alias("records"))


def cuts(df: DataFrame, reports: dict[str, list[str]], top: dict[str, int] | None = None, **measures: Column) -> DataFrame:
    """(report, the columns of all reports, n and the measures): several groupings of one table in one pass, as grouping sets.

    A report's row has nulls in the columns of the others. Of reports in top, only so many groups stay: those with the largest n, equal ones by their columns.
    """
    columns = list(dict.fromkeys(c for keys in reports.values() for c in keys))
    found = df.groupingSets([[F.col(c) for c in keys] for keys in reports.values()], *columns).agg(
        F.grouping_id(*columns).alias("_set"), F.count("*").alias("n"), *(m.alias(name) for name, m in measures.items())
    )
    number = lambda keys: sum(1 << (len(columns) - 1 - i) for i, c in enumerate(columns) if c not in keys)  # noqa: E731  a bit for each column that is left out
    if len({number(keys) for keys in reports.values()}) < len(reports):
        raise ValueError("two reports have the same columns")
    name = F.lit(None).cast("string")
    for report, keys in reports.items():
        name = F.when(F.col("_set") == number(keys), report).otherwise(name)
    told = found.withColumn("report", name).select("report", *columns, "n", *measures)
    if not top:
        return told
    limit = F.lit(None).cast("int")
    for report, n in top.items():
        limit = F.when(F.col("report") == report, n).otherwise(limit)
    rank = F.row_number().over(Window.partitionBy("report").orderBy(F.desc("n"), *columns))
    limited = told.where(F.col("report").isin(list(top))).withColumn("_rank", rank).where(F.col("_rank") <= max(top.values())).where(F.col("_rank") <= limit).drop("_rank")
    return told.where(~F.col("report").isin(list(top))).unionByName(limited) if len(top) < len(reports) else limited


def counted(df: DataFrame, **conditions: Column) -> DataFrame:
    """One row: how many rows meet each condition, in one pass; one that tells null is not met."""
    return df.agg(*(F.count_if(c).alias(name) for name, c in conditions.items()))


def runs(events: DataFrame, gap: str, source: str = "source", at: str = "at", **measures: Column) -> DataFrame:
    """(source, started, ended, n, measures): runs of a source's events, each a gap after the one before at most. The same on tables and on streams.

    A stream needs a watermark on at: a run is given out once it has passed the run's end and a gap, and late events within it join runs together.
    """
    window = F.session_window(at, gap)
    found = events.groupBy(source, window).agg(F.min(at).alias("started"), F.max(at).alias("ended"), F.count("*").alias("n"), *(m.alias(name) for name, m in measures.items()))
    return found.drop("session_window")
