"""Comparing the members of bounded groups inside tasks, where some groups are far larger than others."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import broadcast_if_small, materialise

#: Rows of sorted groups that a task looks at together.
BUNDLE = 20_000


def split_hot(members: DataFrame, key: str, item: str, limit: int, sampled: DataFrame | None = None, sample: int = 1) -> DataFrame:
    """Adds columns lo, hi and part to members, so that the rows of one (key, lo, hi) can meet in one task.

    A group of more than limit members is dealt into parts by a hash of item, and each pair of parts becomes a group of its own, in which every
    pair of members with one in part lo and one in part hi, or both in the one part of lo = hi, is to be compared; so each pair of the whole group
    is compared in just one task, and tasks hold twice the limit or so. A smaller group has lo = hi = part = 0. With sampled, sizes are estimated from these
    members, of which there is one for sample items; all members are dealt either way.
    """
    counts = (members if sampled is None else sampled).groupBy(key).agg((F.count("*") * sample).alias("n")).where(F.col("n") > limit)
    hot = broadcast_if_small(materialise(counts.select(key, F.ceil(F.col("n") / limit).cast("int").alias("parts"))))
    part = F.pmod(F.xxhash64(F.lit("part"), item), F.col("parts")).cast("int")
    dealt = members.join(hot, key, "left").withColumn("parts", F.coalesce("parts", F.lit(1))).withColumn("part", part)
    others = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    return dealt.withColumn("other", others).withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")).drop("other", "parts")


def bundles(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = BUNDLE) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups, with the row at which each begins, of batches sorted by keys; a table has about so many rows, or one larger group."""
    held: list[pa.RecordBatch] = []

    def gathered() -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(held).combine_chunks()
        new = np.zeros(table.num_rows, bool)
        new[0] = True
        for k in keys:
            c = table[k].to_numpy()
            new[1:] |= c[1:] != c[:-1]
        return table, np.flatnonzero(new)

    for batch in batches:
        if batch.num_rows:
            held.append(batch)
        if sum(b.num_rows for b in held) >= rows:
            table, starts = gathered()
            last = int(starts[-1])
            if last:
                yield table.slice(0, last), starts[:-1]
                held = table.slice(last).to_batches()
    if held:
        yield gathered()


def small_pairs(starts: np.ndarray, rows: int, limit: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of rows within groups of limit rows at most, as arrays (i, j) with i < j, for all such groups at once."""
    sizes = np.diff(np.append(starts, rows))
    group = np.repeat(np.arange(len(starts)), sizes)
    small = sizes[group] <= limit
    for d in range(1, limit):
        i = np.flatnonzero(small[:-d] & (group[:-d] == group[d:]))
        if not len(i):
            return
        yield i, i + d


def large_groups(starts: np.ndarray, rows: int, limit: int) -> Iterator[tuple[int, int]]:
    """The first row and the one after the last of each group of more than limit rows."""
    ends = np.append(starts[1:], rows)
    for k in np.flatnonzero(ends - starts > limit):
        yield int(starts[k]), int(ends[k])


class UnionFind:
    """Classes of numbered items; the smallest number stands for a class."""

    def __init__(self, n: int):
        self.parent = np.arange(n)

    def roots(self) -> np.ndarray:
        while True:
            up = self.parent[self.parent]
            if (up == self.parent).all():
                return self.parent
            self.parent = up

    def find(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, left: np.ndarray, right: np.ndarray) -> None:
        """Joins left[k] with right[k] for each k; pairs of one class already are dropped at once."""
        roots = self.roots()
        a, b = roots[left], roots[right]
        differ = a != b
        if differ.any():
            pairs = np.unique(np.stack([np.maximum(a[differ], b[differ]), np.minimum(a[differ], b[differ])]), axis=1)
            for x, y in pairs.T.tolist():
                x, y = self.find(x), self.find(y)
                self.parent[max(x, y)] = min(x, y)
