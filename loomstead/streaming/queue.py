"""The work queue as streams: state by event, buckets of durations, and landing files."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomstead.operators.queue import MOST_RETRIES, STUCK_BACKFILL_MINUTES, STUCK_MINUTES
from loomstead.sources.registry import flatten_studies

#: What an outcome makes of a status; a failure may end in "dead-letter" instead.
TRANSITIONS = {
    ("pending", "claimed"): "processing", ("processing", "done"): "completed", ("processing", "failed"): "pending", ("processing", "released"): "pending",
    ("dead-letter", "retried"): "pending", ("dead-letter", "ignored"): "completed",
}

STATE = "status string, retry_count int"


def step(status: str, retries: int, outcome: str, most: int = MOST_RETRIES) -> tuple[str, int]:
    """The state after one outcome; the rule of the batch form, for one event."""
    after = TRANSITIONS.get((status, outcome))
    if after is None:
        return status, retries
    if outcome == "failed":
        return ("dead-letter" if retries + 1 >= most else after), retries + 1
    return after, 0 if outcome == "retried" else retries


def queue_states(outcomes: DataFrame, most: int = MOST_RETRIES, lease: str | None = None) -> DataFrame:
    """A stream of (id, status, retry_count) from a stream of (id, outcome, seq): each event's state after each batch of outcomes, in their order.

    Each event has one owner, its key in the state store. With a lease in milliseconds of processing time, an event in work for so long without news is
    released.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        status, retries = state.get if state.exists else ("pending", 0)
        if state.hasTimedOut:
            status, retries = step(status, retries, "released", most)
        else:
            for _, outcome in in_order(frames, ["seq"], "outcome"):
                status, retries = step(status, retries, outcome, most)
        state.update((status, retries))
        if lease and status == "processing":
            state.setTimeoutDuration(int(lease))
        yield one_row(key[0], status, retries, names=("id", "status", "retry_count"))

    timeout = GroupStateTimeout.ProcessingTimeTimeout if lease else GroupStateTimeout.NoTimeout
    return outcomes.groupBy("id").applyInPandasWithState(update, "id long, status string, retry_count int", STATE, "update", timeout)


# Minutes without progress after which work is taken back, and failures after which it is given up, by kind of work; None for any other.
LEASE_MINUTES = {"studies.backfill": STUCK_BACKFILL_MINUTES, None: STUCK_MINUTES}
GIVEN_UP_AT = {"publications.scrub": 3, None: MOST_RETRIES}


@dataclass
class Work:
    """One event's state under a lease: since when nothing was heard of it, in milliseconds, and how often it was taken back."""

    status: str = "pending"
    retries: int = 0
    since: int = 0
    released: int = 0

    def expire(self, now: int, lease: int) -> None:
        """Takes work back whose lease is over before now."""
        if self.status == "processing" and self.since + lease < now:
            self.status, self.released = "pending", self.released + 1

    def take(self, at: int, outcome: str, lease: int, most: int) -> None:
        """One outcome at its time; "progress" renews the lease."""
        self.expire(at, lease)
        if outcome == "progress" and self.status == "processing":
            self.since = at
            return
        before = self.status
        self.status, self.retries = step(self.status, self.retries, outcome, most)
        if before != "processing" and self.status == "processing":
            self.since = at


def in_order(frames: Iterator[pd.DataFrame], order: list[str], *others: str) -> list[tuple]:
    """The rows of one key's frames as plain values, sorted by the columns of order; "at" in microseconds. Sorting a frame takes milliseconds for each key."""
    plain = lambda c: (c.to_numpy().astype("datetime64[us]").astype("int64") if c.name == "at" else c).tolist()
    rows = [row for f in frames for row in zip(*(plain(f[c]) for c in (*order, *others)), strict=True)]
    return sorted(rows, key=lambda row: row[: len(order)])


def one_row(*values, names: tuple[str, ...]) -> pd.DataFrame:
    """A row given out for a key, as one block of objects; Spark casts them to the declared types."""
    return pd.DataFrame([values], columns=names, dtype=object)


def by_kind(table: dict, kind: str | None) -> int:
    return table.get(kind, table[None])


def leased_states(outcomes: DataFrame, late: str = "0 seconds", leases: dict | None = None, given_up: dict | None = None) -> DataFrame:
    """A stream of (id, status, retry_count, released) from a stream of (id, kind, outcome, at, seq): each event's state after each batch.

    Leases run in event time: one is over once the watermark, the latest time seen less late, has passed it, or an outcome comes after it, whichever is
    first; both give the same state, so how a stream is cut into batches changes nothing. leases (minutes) and given_up (failures) go by kind of work. Outcomes
    that come later than late are dropped. A replayed batch begins with the state before it.
    """
    leases, given_up = leases or LEASE_MINUTES, given_up or GIVEN_UP_AT

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        *told, kind = state.get if state.exists else (*astuple(Work()), None)
        work = Work(*told)
        if not state.hasTimedOut:
            for at, _, kind, outcome in in_order(frames, ["at", "seq"], "kind", "outcome"):
                work.take(at // 1000, outcome, by_kind(leases, kind) * 60_000, by_kind(given_up, kind))
        lease, now = by_kind(leases, kind) * 60_000, state.getCurrentWatermarkMs()
        work.expire(now, lease)
        state.update((*astuple(work), kind))
        if work.status == "processing":
            state.setTimeoutTimestamp(max(work.since + lease, now + 1))
        yield one_row(key[0], work.status, work.retries, work.released, names=("id", "status", "retry_count", "released"))

    kind = outcomes.schema["id"].dataType.simpleString()
    kept = "status string, retry_count int, since long, released int, kind string"
    found = outcomes.withWatermark("at", late).groupBy("id")
    return found.applyInPandasWithState(update, f"id {kind}, status string, retry_count int, released int", kept, "update", GroupStateTimeout.EventTimeTimeout)


#: Milliseconds that a window of discoveries spans at most.
WINDOW_MS = 24 * 3_600_000


@dataclass
class Cursor:
    """A source's cursor, in milliseconds, and the window of discoveries that owns it until its work is done; seq tells the last command that counted."""

    at: int | None = None
    open_to: int | None = None
    seq: int = -1

    def take(self, seq: int, command: str, now: int, count: int) -> None:
        """One command, if it is newer than the last.

        "discover" looks from the cursor on for a day, or up to now where there is no cursor: if it finds studies, the window stays open and owns the
        cursor; if none, the cursor moves to its end. While a window is open, discoveries change nothing. "done" closes it and moves the cursor; "failed"
        leaves it open, to be tried again. The cursor never moves back.
        """
        if seq <= self.seq:
            return
        self.seq = seq
        if command == "discover" and self.open_to is None:
            end = now if self.at is None else max(self.at, min(self.at + WINDOW_MS, now))
            if count > 0:
                self.open_to = end
            else:
                self.at = end
        elif command == "done" and self.open_to is not None:
            self.at, self.open_to = self.open_to, None


#: Buckets of sources: Spark's worker takes milliseconds for each key of a batch, so a bucket is the key. Fixed, as it is part of the stored state.
BUCKETS = 4_096


def cursors(commands: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """A stream of (source, cursor_ms, open_to_ms, seq) from a stream of (source, seq, command, at, found): the one owner of each source's cursor.

    Cursor and open window of a source lie in the state of its bucket and nowhere else, so no two batches can move them apart; commands that come again
    change nothing. Sources without commands in a batch are not given out.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = {source: Cursor(*told) for source, *told in zip(*state.get, strict=True)} if state.exists else {}
        touched = {}
        for seq, source, command, at, found in in_order(frames, ["seq"], "source", "command", "at", "found"):
            source = None if source != source else source  # a null among numbers
            touched[source] = held.setdefault(source, Cursor())
            touched[source].take(seq, command, at // 1000, found)
        state.update(tuple(map(list, zip(*((source, *astuple(cursor)) for source, cursor in held.items()), strict=True))))
        out = [(source, cursor.at, cursor.open_to, cursor.seq) for source, cursor in touched.items()]
        yield pd.DataFrame(out, columns=("source", "cursor_ms", "open_to_ms", "seq"), dtype=object)

    kind = commands.schema["source"].dataType.simpleString()
    out, kept = f"source {kind}, cursor_ms long, open_to_ms long, seq long", f"source array<{kind}>, at array<long>, open_to array<long>, seq array<long>"
    bucket = F.when(F.col("source").isNotNull(), F.pmod(F.xxhash64("source"), F.lit(buckets))).otherwise(-1)  # nulls apart: they would turn whole numbers beside them into floats
    rows = commands.select("source", "seq", "command", "at", F.coalesce("found", F.lit(0)).alias("found"), bucket.alias("bucket"))
    return rows.groupBy("bucket").applyInPandasWithState(update, out, kept, "update", GroupStateTimeout.NoTimeout)


def new_discoveries(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Events without those whose source and window came already, while the watermark lasts."""
    return events.withWatermark("created_at", late).dropDuplicatesWithinWatermark(["source", "window"])


def duration_windows(events: DataFrame, minutes: int, late: str = "1 hour") -> DataFrame:
    """(bucket, n, mean) of durations over windows aligned to the epoch, given out once the watermark has passed."""
    windowed = events.withWatermark("completed_at", late).groupBy(F.window("completed_at", f"{minutes} minutes"))
    return windowed.agg(F.count("*").alias("n"), F.avg("duration_ms").alias("mean")).select(F.col("window.start").alias("bucket"), "n", "mean")


def ingest(pages: DataFrame, path: str, checkpoint: str):
    """Starts a query that flattens each new page once and appends it; it ends when all files at hand are read."""
    flat = flatten_studies(pages)
    return flat.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
