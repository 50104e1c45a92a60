"""A work queue as a table: what may be claimed, what is stuck, and the state after an outcome. Streams use the same rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.payloads import incremental

#: Retries after which an event is given up.
MOST_RETRIES = 4

# Seconds to wait after the first, second and later failures of an event, and minutes for a scrape.
EVENT_BACKOFF = (30, 120, 600)
SCRAPE_BACKOFF = (1, 5, 15)

#: Minutes without progress after which an event is stuck; backfills take longer.
STUCK_MINUTES, STUCK_BACKFILL_MINUTES = 30, 720


def backoff_seconds(retries: Column, steps: tuple[int, int, int] = EVENT_BACKOFF) -> Column:
    return F.when(retries <= 0, F.lit(0)).when(retries == 1, steps[0]).when(retries == 2, steps[1]).otherwise(steps[2])


def seconds(at: Column) -> Column:
    """A time without zone as seconds of the epoch."""
    return F.unix_micros(at.cast("timestamp")) / F.lit(1_000_000)


def claimable(events: DataFrame, now: Column) -> Column:
    """Pending, and its backoff since the last error is over."""
    waited = F.col("last_error_at").isNull() | (seconds(F.col("last_error_at")) + backoff_seconds(F.col("retry_count")) <= seconds(now))
    return (F.col("status") == "pending") & waited


def next_by_type(events: DataFrame, now: Column) -> DataFrame:
    """The oldest event of each type that may be claimed."""
    rank = F.row_number().over(Window.partitionBy("event_type").orderBy("created_at", "id"))
    return events.where(claimable(events, now)).withColumn("_rank", rank).where("_rank = 1").drop("_rank")


def stuck(now: Column) -> Column:
    """In work, and without progress for too long."""
    limit = F.when(F.col("event_type") == "backfill", F.lit(STUCK_BACKFILL_MINUTES)).otherwise(STUCK_MINUTES)
    return (F.col("status") == "processing") & (seconds(F.coalesce("progress_at", "claimed_at")) < seconds(now) - 60 * limit)


def after_outcome(status: Column, retries: Column, outcome: Column, most: int = MOST_RETRIES) -> tuple[Column, Column]:
    """(status, retry_count) after "claimed", "done", "failed", "released", "retried" or "ignored"; any other outcome changes nothing."""
    failures = F.when(outcome == "failed", retries + 1).when(outcome == "retried", F.lit(0)).otherwise(retries)
    failed = F.when(retries + 1 >= most, "dead-letter").otherwise("pending")
    after = F.when((outcome == "claimed") & (status == "pending"), "processing").when((outcome == "done") & (status == "processing"), "completed")
    after = after.when((outcome == "failed") & (status == "processing"), failed).when((outcome == "released") & (status == "processing"), "pending")
    after = after.when((outcome == "retried") & (status == "dead-letter"), "pending").when((outcome == "ignored") & (status == "dead-letter"), "completed")
    changed = after.isNotNull()
    return F.coalesce(after, status), F.when(changed, failures).otherwise(retries)


def in_flight(processed: Column, total: Column, claimed_at: Column, now: Column) -> list[Column]:
    """percent, rate_per_min and minutes_left of an event in work; null where they can't be told."""
    done = F.greatest(F.coalesce(processed, F.lit(0)), F.lit(0))
    elapsed = F.greatest((seconds(now) - seconds(claimed_at)) / 60, F.lit(0.0001))
    rate = F.when((done > 0) & claimed_at.isNotNull(), done / elapsed)
    percent = F.when(total > 0, F.least(F.lit(100.0), done * 100.0 / total))
    left = F.when((rate > 0) & (total > 0) & (total > done), (total - done) / rate)
    return [percent.alias("percent"), rate.alias("rate_per_min"), left.alias("minutes_left")]


def next_window_end(last: Column, now: Column, strict: bool = False) -> Column:
    """The end of the next incremental window: a day on at most; now if there was none. With strict, a last one after now is an error, else it ends now."""
    end = F.coalesce(F.least(last + F.expr("interval 24 hours"), now), now)
    wrong = F.raise_error(F.lit("the current time cannot come before the last one")).cast("timestamp_ntz")
    return F.when(last > now, wrong).otherwise(end) if strict else end


def advanced(cursor: Column, seen: Column) -> Column:
    """A cursor moves forward only."""
    return F.greatest(cursor, seen)


def alerts(events: DataFrame, now: Column, most_dead: int, most_hours: int) -> DataFrame:
    """One row: dead letters, hours since the last completed event, and whether either is too much."""
    found = events.agg(F.count_if(F.col("status") == "dead-letter").alias("dead"), F.max(F.when(F.col("status") == "completed", F.col("completed_at"))).alias("last"))
    hours = (seconds(now) - seconds(F.col("last"))) / 3600
    return found.select("dead", hours.alias("hours"), ((F.col("dead") > most_dead) | F.coalesce(hours > most_hours, F.lit(True))).alias("alert"))


def remaining_ms(pending: Column, working: Column, mean_ms: Column) -> Column:
    """Milliseconds until what is pending is done by those that work now, one at least; null where nothing is pending or no duration is known."""
    return F.when((pending > 0) & (mean_ms > 0), pending * mean_ms / F.greatest(working, F.lit(1)))


#: What a recovered event is marked with. A fixed value.
SUPERSEDED = "Superseded by full-corpus backfill recovery."


def legacy() -> Column:
    """Whether an event is an open discovery whose payload holds a count and no window: those that recover closes, or lists in a dry run."""
    payload = incremental(F.col("data"))
    return F.coalesce((F.col("event_type") == "studies.discovered") & F.col("status").isin("pending", "processing") & payload.isNotNull() & payload["from"].isNull(), F.lit(False))


def recover(events: DataFrame, now: Column) -> DataFrame:
    """events with the legacy ones closed: completed now, with the reason, and without claim or progress."""
    to = {"status": F.lit("completed"), "completed_at": now, "error": F.lit(SUPERSEDED)} | dict.fromkeys(("claimed_by", "claimed_at", "processed", "total", "progress_at"), F.lit(None))
    return events.withColumns({c: F.when(legacy(), v).otherwise(F.col(c)) for c, v in to.items() if c in events.columns})


#: Types of events that a worker claims, those that it takes first in front. Fixed values.
CLAIMED_FIRST = ["studies.discovered", "studies.backfill"]


def dispatched(events: DataFrame, now: Column, keys: list[str]) -> DataFrame:
    """The event that each worker (keys) takes next: discoveries before backfills, then the oldest."""
    urgency = F.array_position(F.array(*map(F.lit, CLAIMED_FIRST)), F.col("event_type"))
    order = Window.partitionBy(*keys).orderBy(urgency, "created_at", "id")
    open_ = events.where(claimable(events, now) & F.col("event_type").isin(CLAIMED_FIRST))
    return open_.withColumn("_rank", F.row_number().over(order)).where("_rank = 1").drop("_rank")


def completeness(expected: Column, ingested: Column) -> Column:
    """Why an event fails that brought fewer studies than it announced; null for one that is complete."""
    return F.when(ingested < expected, F.format_string("Ingested %d of %d studies", ingested, expected))


# What follows an assigned number, and the scrub of a person's publications.
AFTER_ASSIGNED = ["investigator.discovered", "medicare.utilization", "cms.openpayments"]
AFTER_SCRUB = ["investigator.metrics"]


def fan_out(outcomes: DataFrame) -> DataFrame:
    """(event_type, data, status) of the events that follow outcomes (person_id, outcome): three for "assigned", one for "scrubbed", else none."""
    following = F.when(F.col("outcome") == "assigned", F.array(*map(F.lit, AFTER_ASSIGNED))).when(F.col("outcome") == "scrubbed", F.array(*map(F.lit, AFTER_SCRUB)))
    return outcomes.select(F.explode(following).alias("event_type"), F.col("person_id").cast("string").alias("data"), F.lit("pending").alias("status"))


def source_states(commands: DataFrame) -> DataFrame:
    """The state of each source after commands (source, seq, command, value, error), in the order of seq.

    "status" sets the status, and the error where it gives one or the status is idle; "schedule" sets the next run; "request" a manual run, which
    "consume" takes away; "initialise" makes a source idle that has no state yet. Other commands only make the source known.
    """
    is_ = lambda *names: F.col("command").isin(*names)
    last = lambda value, when: F.max_by(F.struct(value.alias("v")), F.when(when, F.col("seq")))["v"]  # noqa: E731  the struct keeps a last value that is null
    set_error = is_("status") & (F.col("error").isNotNull() | (F.col("value") == "idle"))
    status = F.coalesce(last(F.col("value"), is_("status")), F.when(F.min_by("command", "seq") == "initialise", F.lit("idle")))
    manual = last(F.when(is_("request"), F.col("value")), is_("request", "consume"))
    return commands.groupBy("source").agg(
        status.alias("status"), last(F.col("error"), set_error).alias("error"), last(F.col("value"), is_("schedule")).alias("next_run"), manual.alias("manual_mode")
    )


def requeued(subjects: DataFrame, events: DataFrame, event_type: str, now: Column, subject: str = "subject") -> DataFrame:
    """events with a pending one of a type, made now, for each distinct subject that has none but dead ones of that type; columns not told are null."""
    held = events.where((F.col("event_type") == event_type) & (F.col("status") != "dead-letter")).select(F.col("data").alias("_data"))
    open_ = subjects.select(F.col(subject).cast("string").alias("_data")).where(F.col("_data").isNotNull()).distinct().join(held, "_data", "left_anti")
    told = {"event_type": F.lit(event_type), "data": F.col("_data"), "status": F.lit("pending"), "created_at": now, "updated_at": now}
    return events.unionByName(open_.select(*(told[c].cast(events.schema[c].dataType).alias(c) for c in told if c in events.columns)), allowMissingColumns=True)


def looked_up_again(persons: DataFrame, candidates: DataFrame, events: DataFrame, event_type: str, now: Column, person: str = "person_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(persons, candidates, events) after those humans whose look-up ended ambiguous start anew: no result and no candidates, and each has an event."""
    again = F.coalesce((F.col("result") == "ambiguous") & F.col("human"), F.lit(False))
    found = persons.where(again).select(F.col(person).alias("_again")).distinct()
    told = {"event_type": F.lit(event_type), "data": F.col("_again").cast("string"), "status": F.lit("pending"), "created_at": now, "updated_at": now}
    more = found.select(*(told[c].cast(events.schema[c].dataType).alias(c) for c in told if c in events.columns))
    cleared = persons.withColumn("result", F.when(~again, F.col("result")))
    return cleared, candidates.join(found, candidates[person] == found["_again"], "left_anti"), events.unionByName(more, allowMissingColumns=True)
