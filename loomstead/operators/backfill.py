"""The life of a backfill: when a sweep over all windows begins and ends, which windows it queues, and what is still to come."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.operators.intervals import contained

#: The event of a window. A fixed value.
WINDOW_EVENT = "studies.backfill"


def sweep_step(status: Column, waiting: Column, dead: Column, gap: Column, threshold: int, forced: Column) -> Column:
    """Struct (action, status) of what a source's sweep does next.

    forced asks for all windows again, which a sweep that runs covers already. One that runs goes on while windows wait or are worked on, fails if
    some have died, else ends with a reconciliation. One that doesn't run begins if more studies are missing than threshold; a failed one whose
    gap has closed is complete.
    """
    running = F.coalesce(status == "in-progress", F.lit(False))
    step = lambda action, to: F.struct(F.lit(action).alias("action"), (F.lit(to) if isinstance(to, str) else to).alias("status"))
    return (
        F.when(forced & running, step("none", status))
        .when(forced, step("plan all", "in-progress"))
        .when(running & (waiting > 0), step("refresh", status))
        .when(running & (dead > 0), step("fail", "failed"))
        .when(running, step("reconcile", "complete"))
        .when((status == "failed") & (gap <= threshold), step("close", "complete"))
        .when(gap <= threshold, step("none", status))
        .otherwise(step("plan", "in-progress"))
    )


def remaining(available: Column, stored: Column) -> Column:
    """Studies that are still to come."""
    return F.greatest(available - stored, F.lit(0))


def queued(windows: DataFrame, completed: DataFrame, keys: list[str], forced: bool = False) -> DataFrame:
    """(keys, start, end, n, chunk_index, event_type, data): the windows that a sweep queues, in their order.

    windows has keys, start, end and n, the studies in it; completed keys, start and end of windows done before. One that a completed window holds is not
    queued again unless forced; one that is done in part is, in full, as what is stored twice changes nothing.
    """
    open_ = windows if forced else contained(windows, completed, keys, name="_done").where(~F.col("_done")).drop("_done")
    index = F.row_number().over(Window.partitionBy(*keys).orderBy("start", "end")) - 1
    day = lambda c: F.date_format(c, "yyyy-MM-dd")
    numbered = open_.select(*keys, "start", "end", "n", index.alias("chunk_index"))
    data = F.to_json(F.struct(F.col("chunk_index").alias("chunkIndex"), F.col("n").alias("count"), day("start").alias("dateFrom"), day("end").alias("dateTo")))
    return numbered.withColumns({"event_type": F.lit(WINDOW_EVENT), "data": data})
