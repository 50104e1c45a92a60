"""Windows of days against day by day, and the steps of a sweep."""

from __future__ import annotations

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomstead.operators import backfill, intervals

ZERO = dt.date(2024, 1, 1)
SCHEMA = "source string, start date, end date, _w int"


def some(n, seed, longest):
    pick = random.Random(seed)
    rows = []
    for _ in range(n):
        a = ZERO + dt.timedelta(days=pick.randrange(120))
        rows.append((pick.choice(["a", "b", None]), a, a + dt.timedelta(days=pick.randint(-1, longest)), pick.randrange(5)))
    return rows + [("a", None, ZERO, 0), ("a", ZERO, None, 0), ("c", ZERO, ZERO, 0)]


def days_of(rows):
    return {(k, a + dt.timedelta(days=i)) for k, a, b, *_ in rows if a and b for i in range((b - a).days + 1)}


@pytest.fixture
def both(spark):
    planned, done = some(60, 1, 25), some(25, 2, 12) + [("d", ZERO, ZERO, 0)]
    return planned, done, spark.createDataFrame(planned, SCHEMA), spark.createDataFrame(done, SCHEMA)


def test_union(both):
    _, done, _, df = both
    got = [tuple(r) for r in intervals.union_of(df, ["source"]).collect()]
    assert days_of(got) == days_of(done)
    for k, a, _ in got:  # none touches another
        assert (k, a - dt.timedelta(days=1)) not in days_of(done)
    assert sum((b - a).days + 1 for _, a, b in got) == len(days_of(done))


def test_touching_and_overlapping_windows_are_one(spark):
    d = lambda i: ZERO + dt.timedelta(days=i)
    df = spark.createDataFrame([("a", d(0), d(2)), ("a", d(3), d(4)), ("a", d(4), d(9)), ("a", d(5), d(6)), ("a", d(11), d(11))], "source string, start date, end date")
    assert sorted(map(tuple, intervals.union_of(df, ["source"]).collect())) == [("a", d(0), d(9)), ("a", d(11), d(11))]


def test_without(both):
    planned, done, left, right = both
    taken, got = days_of(done), intervals.without(left, right, ["source"]).collect()
    expected = sorted(((k, a, b, x, d) for k, a, b, x in planned if a and b for d in sorted(day for _, day in days_of([(k, a, b)])) if (k, d) not in taken), key=str)
    assert sorted(((r.source, r.start, r.end, r._w, d) for r in got for _, d in days_of([(0, r.left_start, r.left_end)])), key=str) == expected
    assert left.columns + ["left_start", "left_end"] == intervals.without(left, right, ["source"]).columns
    assert intervals.without(left.limit(0), right, ["source"]).count() == 0
    whole = intervals.without(left, right.limit(0), ["source"])
    assert whole.where(F.col("start") != F.col("left_start")).count() == 0 and whole.count() == sum(1 for _, a, b, _ in planned if a and b and a <= b)


def test_contained(both):
    planned, done, left, right = both
    inside = lambda k, a, b: bool(a and b and a <= b) and any(k == c and s and e and s <= a and b <= e for c, s, e, _ in done)
    got = sorted(map(tuple, intervals.contained(left, right, ["source"]).collect()), key=str)
    assert got == sorted(((k, a, b, x, inside(k, a, b)) for k, a, b, x in planned), key=str) and {r[-1] for r in got} == {True, False}
    plan = intervals.contained(left, right, ["source"])._jdf.queryExecution().toString()
    assert "Join" not in plan.split("== Physical Plan ==")[1]


def test_a_queue_leaves_out_what_is_done(both):
    planned, done, left, right = both
    windows = left.where("start <= end").withColumn("n", F.lit(3))
    open_ = backfill.queued(windows, right, ["source"]).collect()
    forced = backfill.queued(windows, right, ["source"], forced=True)
    assert forced.count() == windows.count() > len(open_) > 0
    assert {(r.source, r.start, r.end) for r in open_} == {(k, a, b) for k, a, b, _ in planned if a and b and a <= b and not any(k == c and s and e and s <= a and b <= e for c, s, e, _ in done)}
    for source in ("a", "b", None):
        rows = sorted((r.chunk_index, r.start) for r in open_ if r.source == source)
        assert [i for i, _ in rows] == list(range(len(rows))) and [s for _, s in rows] == sorted(s for _, s in rows)


@pytest.mark.parametrize(
    "row, expected",
    [
        (("in-progress", 0, 0, 9, True), ("none", "in-progress")), (("failed", 0, 0, 0, True), ("plan all", "in-progress")), ((None, 0, 0, 0, True), ("plan all", "in-progress")),
        (("in-progress", 2, 1, 9, False), ("refresh", "in-progress")), (("in-progress", 0, 1, 9, False), ("fail", "failed")), (("in-progress", 0, 0, 9, False), ("reconcile", "complete")),
        (("failed", 0, 1, 5, False), ("close", "complete")), (("failed", 0, 1, 6, False), ("plan", "in-progress")), (("complete", 0, 0, 5, False), ("none", "complete")),
        ((None, 0, 0, 5, False), ("none", None)), ((None, 0, 0, 6, False), ("plan", "in-progress")),
    ],
)
def test_steps_of_a_sweep(spark, row, expected):
    df = spark.createDataFrame([row], "status string, waiting int, dead int, gap int, forced boolean")
    r = df.select(backfill.sweep_step(*(F.col(c) for c in ("status", "waiting", "dead", "gap")), 5, F.col("forced")).alias("s")).first().s
    assert tuple(r) == expected
