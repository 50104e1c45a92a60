"""Merging batches into stored tables: new tables are made from old ones and a batch, so that writing the same batch twice changes nothing."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def merge_rows(stored: DataFrame, batch: DataFrame, key: str) -> DataFrame:
    """stored with the rows of batch: for a key in both, each column is the batch's where it is not null. Keys are unique in each."""
    new = batch.select(F.col(key).alias("_key"), *(F.col(c).alias(f"_{c}") for c in stored.columns if c != key))
    joined = stored.join(new, stored[key] == new["_key"], "full_outer")
    return joined.select(*(F.coalesce(key, "_key").alias(key) if c == key else F.coalesce(f"_{c}", c).alias(c) for c in stored.columns))


def replace_children(stored: DataFrame, batch: DataFrame, keys: list[str], touched: DataFrame) -> DataFrame:
    """stored without the children of touched keys, and the batch's children of them. Keys whose children the batch does not give are not in touched."""
    return stored.join(touched.select(*keys).distinct(), keys, "left_anti").unionByName(batch.join(touched.select(*keys).distinct(), keys, "left_semi").select(*stored.columns))


def insert_absent(stored: DataFrame, batch: DataFrame, keys: list[str]) -> DataFrame:
    """stored with the rows of batch whose key it lacks, one for each key."""
    return stored.unionByName(batch.dropDuplicates(keys).join(stored.select(*keys), keys, "left_anti").select(*stored.columns))


def mark_removed(stored: DataFrame, sweep_start: Column, now: Column, seen: str = "last_seen", removed: str = "removed_at") -> DataFrame:
    """Rows not seen since a sweep began are marked as removed, once."""
    gone = F.col(removed).isNull() & (F.col(seen).isNull() | (F.col(seen) < sweep_start))
    return stored.withColumn(removed, F.when(gone, now).otherwise(F.col(removed)))


def reconcile(current: DataFrame, wanted: DataFrame, key: str, value: str, pinned: Column) -> DataFrame:
    """(key, action) that turns current into wanted: add, update or remove; pinned rows of current stay as they are."""
    new = wanted.select(F.col(key).alias("_key"), F.col(value).alias("_value"), F.lit(True).alias("_there"))
    joined = current.withColumn("_pinned", pinned).withColumn("_here", F.lit(True)).join(new, F.col(key) == F.col("_key"), "full_outer")
    action = F.when(F.coalesce("_pinned", F.lit(False)), F.lit(None)).when(F.col("_here").isNull(), "add").when(F.col("_there").isNull(), "remove")
    action = action.when(~F.col(value).eqNullSafe(F.col("_value")), "update")
    return joined.select(F.coalesce(key, "_key").alias(key), action.alias("action")).where(F.col("action").isNotNull())


def write_swapped(df: DataFrame, path: str, partitions: list[str] | None = None) -> None:
    """Writes a table over a path that df may be read from; with partitions, only those that df holds are replaced.

    The rows are written beside the path first, so nothing that is still to be read is overwritten; that copy stays there, should the swap be cut short.
    """
    staged = f"{path.rstrip('/')}.staged-{uuid.uuid4().hex}"
    df.write.parquet(staged)
    writer = df.sparkSession.read.schema(df.schema).parquet(staged).write.mode("overwrite")
    if partitions:
        writer = writer.option("partitionOverwriteMode", "dynamic").partitionBy(*partitions)
    writer.parquet(path)


#: Parents in a part that a task merges, about.
PART_KEYS = 100_000


def dealt(tables: dict[str, DataFrame], key: str, parent: str = "studies") -> dict[str, DataFrame]:
    """The tables dealt by key into parts of about PART_KEYS parents: what is merged by key after that moves no more, and a task's sorts stay as large as
    they are however many parents there are. Left to itself, Spark makes parts of as many compressed bytes, and rows of keys and numbers grow tenfold when
    they are sorted.
    """
    rows = tables[parent]
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // PART_KEYS))
    return {name: table.repartition(parts, key) for name, table in tables.items()}


def merge_batch(stored: dict[str, DataFrame], batch: dict[str, DataFrame], key: str, seen_at: Column | None = None, parent: str = "studies", rejects: str = "rejected") -> dict[str, DataFrame]:
    """All tables after a batch: the parent's rows merged, their children replaced where the batch gives that table, and new rejects added once.

    Tables that the batch does not hold stay as they are. With seen_at, parents of the batch are marked as seen by a sweep, and are no longer removed.
    """
    incoming = batch[parent].dropDuplicates([key])
    if seen_at is not None:
        incoming = incoming.withColumn("last_seen", seen_at)
    merged = merge_rows(stored[parent], incoming.select(*[c for c in stored[parent].columns if c in incoming.columns], *[F.lit(None).alias(c) for c in stored[parent].columns if c not in incoming.columns]), key)
    if seen_at is not None and "removed_at" in stored[parent].columns:
        merged = merged.withColumn("removed_at", F.when(F.col("last_seen") >= seen_at, F.lit(None)).otherwise(F.col("removed_at")))
    after = {parent: merged}
    for name, table in stored.items():
        if name == rejects and name in batch:
            after[name] = insert_absent(table, batch[name], table.columns)
        elif name != parent:
            after[name] = replace_children(table, batch[name], [key], incoming) if name in batch else table
    return after


def append_log(rows: DataFrame, path: str, day: str | None = None) -> None:
    """Adds rows to a log; with the name of a day's column, in a folder a day, so that readers of few days read little."""
    writer = rows.write.mode("append")
    (writer.partitionBy(day) if day else writer).parquet(path)


@dataclass(frozen=True)
class Batch:
    """What a batch became: the rows taken, those set apart with their reason, and how many of each were seen while they were written."""

    taken: DataFrame
    rejected: DataFrame
    counts: dict[str, int]


def write_batch(rows: DataFrame, reason: Column, path: str, kinds: dict[str, Column] | None = None) -> Batch:
    """Writes rows to a folder, those with a reason apart, in one pass; nothing is read or counted again.

    reason says why a row is set apart, null for one that is taken; it becomes a column of rejected. counts holds n, taken and rejected, and those of
    kinds, conditions on the rows and their reason (F.col("_reason")), all observed as the rows go by. Rows come as they are: copies and nulls too.
    """
    seen = Observation()
    told = rows.withColumn("_reason", reason).withColumn("_rejected", F.col("_reason").isNotNull())
    asked = {"n": F.lit(True), "taken": ~F.col("_rejected"), "rejected": F.col("_rejected")} | (kinds or {})
    told.observe(seen, *(F.count_if(c).alias(name) for name, c in asked.items())).write.partitionBy("_rejected").parquet(path)
    whole = rows.sparkSession.read.schema(told.schema).parquet(path)  # with the folders' column, so a reader of one side opens no file of the other
    side = lambda apart: whole.where(F.col("_rejected") == apart).drop("_rejected")
    return Batch(side(False).drop("_reason"), side(True).withColumnRenamed("_reason", "reason"), {k: v or 0 for k, v in seen.get.items()})
