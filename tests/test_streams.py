"""Leases and cursors over several batches against one-by-one runs, and batches that fail between."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomstead.plans.streams import sliced
from loomstead.streaming import queue as streams

ZERO = dt.datetime(2024, 1, 1)


def run(stream, path, mode="update", fail_at=None):
    """Runs a stream to its end; with fail_at, the batch of that number fails in its sink."""

    def keep(batch, number):
        if number == fail_at:
            raise RuntimeError("lost")
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).foreachBatch(keep)
    writer.start().awaitTermination()


def last(spark, path, key, *columns):
    found = spark.read.parquet(f"{path}/out").groupBy(key).agg(F.max_by(F.struct(*columns), "batch").alias("s"))
    return {r[key]: tuple(r.s) for r in found.collect()}


KINDS = ["studies.backfill", "publications.scrub", "studies.discovered"]


def outcomes(n, seed):
    pick = random.Random(seed)
    at = ZERO
    for i in range(n):
        at += dt.timedelta(minutes=pick.choice([1, 5, 20, 29, 30, 31]))
        item = pick.randrange(12)
        yield item, KINDS[item % 3], pick.choice(["claimed", "claimed", "done", "failed", "progress", "released", "retried", "ignored"]), at, i


def one_by_one(rows):
    held = {}
    for item, kind, outcome, at, _ in rows:
        work = held.setdefault(item, (streams.Work(), kind))[0]
        work.take(round(at.replace(tzinfo=dt.timezone.utc).timestamp() * 1000), outcome, streams.by_kind(streams.LEASE_MINUTES, kind) * 60_000, streams.by_kind(streams.GIVEN_UP_AT, kind))
    end = round(max(r[3] for r in rows).replace(tzinfo=dt.timezone.utc).timestamp() * 1000)
    for work, kind in held.values():
        work.expire(end, streams.by_kind(streams.LEASE_MINUTES, kind) * 60_000)
    return {k: (w.status, w.retries, w.released) for k, (w, _) in held.items()}


@pytest.mark.parametrize("batches", [1, 5])
def test_leases_run_in_event_time(spark, tmp_path, batches):
    rows = list(outcomes(400, batches))
    df = spark.createDataFrame(rows, "id long, kind string, outcome string, at timestamp, seq long")
    run(streams.leased_states(sliced(spark, df, "outcomes", batches)), str(tmp_path))
    got = last(spark, str(tmp_path), "id", "status", "retry_count", "released")
    assert got == one_by_one(rows)
    assert sum(r for _, _, r in got.values()) > 10


def test_leases_by_kind():
    work, minute = streams.Work(), 60_000
    for kind, minutes in (("studies.backfill", 720), ("studies.discovered", 30)):
        lease = streams.by_kind(streams.LEASE_MINUTES, kind) * minute
        assert lease == minutes * minute
        work = streams.Work()
        work.take(0, "claimed", lease, 4)
        work.expire(lease, lease)
        assert work.status == "processing"  # not longer than its lease
        work.take(lease, "progress", lease, 4)
        work.expire(2 * lease, lease)
        assert work.status == "processing" and work.released == 0
        work.expire(2 * lease + 1, lease)
        assert work.status == "pending" and work.released == 1
    most = streams.by_kind(streams.GIVEN_UP_AT, "publications.scrub")
    work = streams.Work()
    for i in range(most):
        assert work.status == "pending"
        work.take(2 * i, "claimed", 1000, most)
        work.take(2 * i + 1, "failed", 1000, most)
    assert (work.status, work.retries, most) == ("dead-letter", 3, 3)


def test_a_timer_fires_without_news(spark, tmp_path):
    """An event of which nothing is heard any more is released by others' time alone."""
    rows = [(1, "studies.discovered", "claimed", ZERO, 0), (2, "studies.backfill", "claimed", ZERO, 1), (3, "studies.discovered", "claimed", ZERO + dt.timedelta(hours=2), 2)]
    df = spark.createDataFrame(rows, "id long, kind string, outcome string, at timestamp, seq long")
    run(streams.leased_states(sliced(spark, df, "outcomes", 2)), str(tmp_path))
    assert last(spark, str(tmp_path), "id", "status", "released") == {1: ("pending", 1), 2: ("processing", 0), 3: ("processing", 0)}


COMMANDS = "source long, seq long, command string, at timestamp, found long"


def commands(n, seed):
    pick = random.Random(seed)
    return [(i % 5, i, pick.choice(["discover", "discover", "done", "failed"]), ZERO + dt.timedelta(hours=3 * i), pick.randrange(3)) for i in range(n)]


def owned(rows):
    held = {}
    for source, seq, command, at, found in sorted(rows, key=lambda r: r[1]):
        held.setdefault(source, streams.Cursor()).take(seq, command, round(at.replace(tzinfo=dt.timezone.utc).timestamp() * 1000), found)
    return {k: (c.at, c.open_to, c.seq) for k, c in held.items()}


def test_a_cursor_has_one_owner_over_batches_that_fail(spark, tmp_path):
    rows = commands(200, 1)
    again = [r for r in rows if r[1] % 7 == 0]  # commands that come twice, the second time at the end
    df = spark.createDataFrame(rows, COMMANDS)
    folder = str(tmp_path / "in")
    for part in (df.where("seq < 80"), df.where("seq >= 80 and seq < 150"), df.where("seq >= 150"), spark.createDataFrame(again, COMMANDS)):
        part.coalesce(1).write.mode("append").parquet(folder)
    stream = lambda: streams.cursors(spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(folder))
    with pytest.raises(Exception, match="lost"):
        run(stream(), str(tmp_path), fail_at=1)
    with pytest.raises(Exception, match="lost"):
        run(stream(), str(tmp_path), fail_at=2)  # batch 1 runs again from the state before it, then the next one fails
    run(stream(), str(tmp_path))
    assert last(spark, str(tmp_path), "source", "cursor_ms", "open_to_ms", "seq") == owned(rows)


@pytest.mark.parametrize("kind", ["long", "string"])
def test_sources_of_one_bucket_keep_their_own_cursors(spark, tmp_path, kind):
    """Few groups go through Python however many sources there are; null sources and counts and huge ids stay what they are."""
    name = (lambda i: None if i == 3 else 2**60 + i) if kind == "long" else (lambda i: None if i == 3 else f"s{i}")
    rows = [(name(source), *rest) for source, *rest in ((i % 37, *r[1:]) for i, r in enumerate(commands(600, 2)))]
    schema, folder = COMMANDS.replace("source long", f"source {kind}"), str(tmp_path / "in")
    for k in range(3):
        part = rows[200 * k : 200 * k + 200] if k < 2 else rows[400:500]  # some sources come in few batches
        spark.createDataFrame([(*r[:4], None if r[1] % 5 == 0 and r[4] == 0 else r[4]) for r in part], schema).coalesce(1).write.mode("append").parquet(folder)
    stream = streams.cursors(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(folder), 4)
    run(stream, str(tmp_path))
    assert last(spark, str(tmp_path), "source", "cursor_ms", "open_to_ms", "seq") == owned(rows[:500])


def test_a_cursor_waits_for_its_window():
    day, c = streams.WINDOW_MS, streams.Cursor()
    c.take(0, "discover", 1000, 5)
    assert (c.at, c.open_to) == (None, 1000)  # no cursor yet: up to now
    c.take(1, "discover", 2000, 5)
    c.take(2, "failed", 3000, 0)
    assert (c.at, c.open_to) == (None, 1000)
    c.take(3, "done", 4000, 0)
    c.take(3, "done", 4000, 0)
    assert (c.at, c.open_to) == (1000, None)
    c.take(4, "discover", 1000 + 3 * day, 0)
    assert (c.at, c.open_to) == (1000 + day, None)  # nothing found: a day on
    c.take(5, "discover", 500, 0)
    assert c.at == 1000 + day  # a clock that goes back moves nothing back


def test_rows_of_a_key_come_in_order_as_plain_values():
    import pandas as pd

    a = pd.DataFrame({"at": pd.to_datetime(["2024-01-01 00:00:00.000002", "1969-12-31 23:59:59.999999"]), "seq": [5, 7], "outcome": ["x", None]})
    b = pd.DataFrame({"at": pd.to_datetime(["2024-01-01 00:00:00.000002"]), "seq": [4], "outcome": ["y"]})
    rows = streams.in_order(iter([a, b]), ["at", "seq"], "outcome")
    assert rows == [(-1, 7, None), (1_704_067_200_000_002, 4, "y"), (1_704_067_200_000_002, 5, "x")] and type(rows[0][0]) is int
