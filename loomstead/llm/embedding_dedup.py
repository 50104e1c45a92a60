"""Near-duplicate embeddings by Euclidean p-stable hashing: quantised random projections bucket normalised vectors in several tables.

The projections in a table follow the number of vectors of a label and how far apart they lie, so that a bucket holds some dozens of strangers at any size,
and the number of tables follows from the recall that is asked for. Rows of buckets are narrow: a vector goes as a sketch of the signs of its projections,
seen from the mean of its label if that is large, and only sketches that differ in few enough bits are candidates: so vectors of a label that all point
one way are no candidates for that. A bucket gives a spanning forest of its candidates; classes of candidates then get their vectors, once each,
and exact cosines decide and count the links within them. Equal vectors of a label are one class and are hashed once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import broadcast_if_small, materialise, small_batches, written
from loomstead.llm.components import connected_components
from loomstead.llm.groups import UnionFind, bundles, large_groups, small_pairs, split_hot

#: The width of a quantised step, in distances of two vectors at the threshold; strangers at a right angle that may share a bucket on average; and the
#: share of pairs at the threshold that may meet in no table.
WIDTH, STRANGERS, MISSED = 5.35, 32, 0.004

#: Bits of a sketch, and the standard deviations beyond those expected at the threshold by which a candidate's may differ.
SKETCH, SLACK = 256, 4.5

#: The columns of a sketch's words.
WORDS = [f"w{k}" for k in range(SKETCH // 64)]

#: Means of labels that are broadcast, of some hundreds of components each.
CENTRES = 10_000

#: Members of a bucket or class in one task, about, and rows of a block of cosines.
BUCKET, BLOCK = 2048, 512

#: The smallest spread that projections follow: where vectors lie closer still, more tables would cost more than strangers do.
LEAST_SPREAD = 0.25

#: Vectors of a label from which on they are seen from their mean.
CENTRED = 1024

#: One in so many vectors, picked by hash, tells which buckets are hot and are split.
HOT_SAMPLE = 16

#: Members of a bucket up to which its pairs are compared together with those of other buckets.
SMALL = 64

#: Vectors whose rows are made at once.
HASHED = 1000

SEED = 6


def meets(distance: float, width: float) -> float:
    """The chance that two vectors at a distance fall into the same step of a projection."""
    if distance == 0:
        return 1.0
    r = width / distance
    return math.erf(r / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * r) * (1 - math.exp(-r * r / 2))


def plan(count: int, threshold: float, spread: float = 1.0) -> tuple[int, int, float]:
    """Projections in a table, tables and the width of a step for a label of so many vectors, whose mean cosine with each other is 1 - spread."""
    apart = math.sqrt(2 - 2 * min(threshold, 1.0))
    width = WIDTH * max(apart, 1e-3)
    strangers = math.sqrt(2 * min(1.0, max(spread, LEAST_SPREAD)))
    projections = max(1, math.ceil(math.log(max(count, 1) / STRANGERS) / -math.log(meets(strangers, width))))
    both = meets(apart, width) ** projections
    return projections, 1 if both == 1 else math.ceil(math.log(MISSED) / math.log(1 - both)), width


def sketch_radius(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """The bits in which the sketches of two vectors at the threshold may differ, by their distances from where they are seen; -1 where none can be so near."""
    apart = 2 - 2 * min(threshold, 1.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        angle = np.nan_to_num((a * a + b * b - apart) / (2 * a * b), nan=-1.0, neginf=-1.0, posinf=1.0)
    p = np.arccos(np.clip(angle, -1.0, 1.0)) / np.pi
    return np.where(np.abs(a - b) > math.sqrt(apart) + 1e-5, -1, np.ceil(SKETCH * p + SLACK * np.sqrt(SKETCH * p * (1 - p))))


@lru_cache(maxsize=2048)
def _projections(size: int, table: int, projections: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng([SEED, size, table, projections])
    return rng.standard_normal((size, projections)), rng.uniform(0, 1, projections)


def bucket_codes(unit: np.ndarray, projections: int, tables: int, width: float) -> np.ndarray:
    """For each vector of length one, the hash of its quantised projections in each table."""
    codes = np.empty((len(unit), tables), np.uint64)
    for t in range(tables):
        lines, shifts = _projections(unit.shape[1], t, projections)
        steps = np.floor(unit @ lines / width + shifts).astype(np.int64).astype(np.uint64)
        code = np.full(len(unit), t, np.uint64)
        for k in range(projections):  # a multiplicative hash of the steps, wrapping at 64 bits
            code = (code ^ steps[:, k]) * np.uint64(0x9E3779B97F4A7C15)
            code ^= code >> np.uint64(29)
        codes[:, t] = code
    return codes


def sketches(unit: np.ndarray) -> np.ndarray:
    """The signs of SKETCH projections, as rows of 64-bit words; rows may have any length."""
    lines, _ = _projections(unit.shape[1], -1 % (1 << 32), SKETCH)
    return np.packbits(unit @ lines > 0, axis=1).view(np.uint64)


def units(vectors: np.ndarray) -> np.ndarray:
    """Rows of length one, in double precision; lengths of huge and tiny rows stay finite."""
    rows = vectors.astype(np.float64)
    rows /= np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.linalg.norm(rows, axis=1, keepdims=True)


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The vectors of a list column by length: their rows, and themselves at length one."""
    ends = np.asarray(column.offsets)
    sizes, values = np.diff(ends), column.flatten().to_numpy(zero_copy_only=False)
    starts = ends[:-1] - ends[0]
    for size in np.unique(sizes):
        rows = np.flatnonzero(sizes == size)
        yield rows, units(values[starts[rows][:, None] + np.arange(size)])


def usable(vector: Column) -> Column:
    """Whether a vector is there, has a component other than zero, and none that is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce((F.size(vector) > 0) & ~bad & F.exists(vector, lambda x: x != 0), F.lit(False))


def means(classes: DataFrame, counts: DataFrame) -> DataFrame:
    """(label, size, mean, spread): for labels with many vectors, by their length, the mean of these and one less its squared length."""
    large = classes.join(broadcast_if_small(counts.where(F.col("of_label") >= CENTRED)), "label").select(F.xxhash64("label").alias("label"), "vector")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column(0).to_numpy()
            for rows, unit in matrices(batch.column(1)):
                names, which = np.unique(label[rows], return_inverse=True)
                total = np.zeros((len(names), unit.shape[1]))
                np.add.at(total, which, unit)
                n, size = np.bincount(which), unit.shape[1]
                each = lambda x: pa.array(np.repeat(x, size))
                columns = [each(names), pa.array(np.full(total.size, size), pa.int32()), pa.array(np.tile(np.arange(size, dtype=np.int32), len(names))), pa.array(total.ravel()), each(n)]
                yield pa.RecordBatch.from_arrays(columns, ["label", "size", "place", "total", "n"])

    summed = large.mapInArrow(sums, "label long, size int, place int, total double, n long").groupBy("label", "size", "place").agg((F.sum("total") / F.sum("n")).alias("m"))
    whole = summed.groupBy("label", "size").agg(F.sort_array(F.collect_list(F.struct("place", "m"))).alias("all"))
    mean = F.transform("all", lambda x: x["m"])
    return whole.select("label", "size", mean.alias("mean"), (1 - F.aggregate(mean, F.lit(0.0), lambda a, x: a + x * x)).alias("spread"))


def candidate_links(classes: DataFrame, threshold: float) -> DataFrame:
    """(a, b): a spanning forest of the candidates in each bucket; classes: node long, label, vector array, with vectors of a label that differ."""
    counts = materialise(classes.groupBy("label").agg(F.count("*").alias("of_label")))
    centres = materialise(means(classes, counts))  # a row for each thousand vectors at most
    sized = classes.join(broadcast_if_small(counts), "label").select("node", F.xxhash64("label").alias("label"), "of_label", "vector")
    seen = sized.withColumn("size", F.size("vector")).join(broadcast_if_small(centres, CENTRES), ["label", "size"], "left").select("node", "label", "of_label", F.coalesce("spread", F.lit(1.0)).alias("spread"), "vector", "mean")

    def hash_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for a in range(0, whole.num_rows, HASHED):
                batch = whole.slice(a, HASHED)
                node, label, of_label, spread = (batch.column(i).to_numpy() for i in range(4))
                for rows, unit in matrices(batch.column(4)):
                    from_mean = unit.copy()
                    for k, mean in enumerate(batch.column(5).take(pa.array(rows)).to_pylist()):
                        if mean is not None:
                            from_mean[k] -= mean
                    signs, far = sketches(from_mean), np.linalg.norm(from_mean, axis=1).astype(np.float32)
                    for count, wide in set(zip(of_label[rows].tolist(), spread[rows].tolist(), strict=True)):
                        at = np.flatnonzero((of_label[rows] == count) & (spread[rows] == wide))
                        projections, tables, width = plan(int(count), threshold, wide)
                        codes = bucket_codes(unit[at], projections, tables, width) ^ label[rows[at]].view(np.uint64)[:, None] ^ np.uint64(unit.shape[1])
                        repeat = lambda x: pa.array(np.repeat(x, tables))
                        words = [repeat(np.ascontiguousarray(signs[at, w]).view(np.int64)) for w in range(signs.shape[1])]
                        yield pa.RecordBatch.from_arrays([repeat(node[rows[at]]), pa.array(codes.ravel().view(np.int64)), *words, repeat(far[at])], ["node", "bucket", *WORDS, "far"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bundle, starts in bundles(batches, ["bucket", "lo", "hi"]):
            node, sketch = bundle["node"].to_numpy(), np.stack([bundle[c].to_numpy().view(np.uint64) for c in WORDS])
            far = bundle["far"].to_numpy().astype(np.float64)
            n, classes = len(node), UnionFind(len(node))
            apart = lambda i, j: np.bitwise_count(sketch[:, i] ^ sketch[:, j]).sum(axis=0)
            for i, j in small_pairs(starts, n, SMALL):
                near = apart(i, j) <= sketch_radius(far[i], far[j], threshold)
                classes.join(i[near], j[near])
            roots = classes.roots().copy()
            for a, b in large_groups(starts, n, SMALL):
                roots[a:b] = a + _reached(sketch[:, a:b], far[a:b], threshold)
            linked = np.flatnonzero(roots != np.arange(n))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[roots[linked]])], ["a", "b"])

    shape = f"node long, bucket long, {', '.join(f'{w} long' for w in WORDS)}, far float"
    few = seen.where(F.pmod(F.xxhash64(F.lit("size"), "node"), F.lit(HOT_SAMPLE)) == 0)  # sampled before it is hashed, so that nothing is hashed twice
    dealt = split_hot(seen.mapInArrow(hash_, shape), "bucket", "node", BUCKET, few.mapInArrow(hash_, shape), HOT_SAMPLE)
    met = dealt.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi").select("bucket", "lo", "hi", "node", *WORDS, "far")
    return met.mapInArrow(compare, "a long, b long").distinct()


def _reached(words: np.ndarray, far: np.ndarray, threshold: float) -> np.ndarray:
    """For each sketch (a column of words), the first of those that it reaches in steps of as few bits as two at the threshold may differ in.

    Each sketch is compared only with those not reached yet, so a group of near copies takes a few rounds and not all of its pairs.
    """
    n = words.shape[1]
    roots, left = np.arange(n), np.arange(n)
    while len(left):
        first, left = left[0], left[1:]
        ahead = [first]
        while ahead and len(left):
            x = ahead.pop()
            near = np.bitwise_count(words[:, left] ^ words[:, x, None]).sum(axis=0) <= sketch_radius(far[left], far[x], threshold)
            found, left = left[near], left[~near]
            roots[found] = first
            ahead += found.tolist()
    return roots


def exact_links(members: DataFrame, threshold: float) -> DataFrame:
    """(node, add, root) in parts: how many vectors one links with in its class, and another one that it is linked to.

    members: node long, component long, copies long, vector array; all vectors of a component have one length.
    """

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bundle, starts in bundles(batches, ["component", "lo", "hi"]):
            n = bundle.num_rows
            node, copies, part, lo, hi = (bundle[c].to_numpy() for c in ("node", "copies", "part", "lo", "hi"))
            found = list(matrices(bundle["vector"].combine_chunks() if isinstance(bundle["vector"], pa.ChunkedArray) else bundle["vector"]))
            unit = np.zeros((n, max(u.shape[1] for _, u in found)))  # shorter ones are filled with zeros, which changes no product within a class
            for rows, u in found:
                unit[rows, : u.shape[1]] = u
            added, classes = np.zeros(n, np.int64), UnionFind(n)

            def count(i: np.ndarray, j: np.ndarray) -> None:
                np.add.at(added, i, copies[j])
                np.add.at(added, j, copies[i])
                classes.join(i, j)

            for i, j in small_pairs(starts, n, SMALL):
                near = (np.einsum("ij,ij->i", unit[i], unit[j]) >= threshold) & ((lo[i] == hi[i]) | (part[i] != part[j]))
                count(i[near], j[near])
            for a, b in large_groups(starts, n, SMALL):
                left, right = a + np.flatnonzero(part[a:b] == lo[a]), a + np.flatnonzero(part[a:b] == hi[a])
                for k in range(0, len(left), BLOCK):
                    rows = left[k : k + BLOCK]
                    i, j = np.nonzero(unit[rows] @ unit[right].T >= threshold)
                    i, j = rows[i], right[j]
                    fresh = i < j if lo[a] == hi[a] else i != j
                    count(i[fresh], j[fresh])
            rows = np.flatnonzero(added)
            if len(rows):
                yield pa.RecordBatch.from_arrays([pa.array(node[rows]), pa.array(added[rows]), pa.array(node[classes.roots()[rows]])], ["node", "add", "root"])

    dealt = split_hot(members, "component", "node", BUCKET)
    met = dealt.repartition("component", "lo", "hi").sortWithinPartitions("component", "lo", "hi").select("component", "lo", "hi", "part", "node", "copies", "vector")
    return met.mapInArrow(compare, "node long, add long, root long")


def near_duplicates(vectors: DataFrame, threshold: float = 0.93, key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """(key, n_links, component_id, kept) for each row: links are pairs of rows of a label with a cosine of threshold or more.

    component_id is the smallest key reachable by links, itself included, and kept says whether it is the row's own. Rows without a label, and vectors
    that are null, empty, zero or hold a null or a component that is not finite, link with nothing; nor do vectors of different length. Copies link with
    each other, and rows that repeat a key are rows of their own. A row without a key never gives a component its id, which is null, and its row kept,
    only where no row reached has a key. Keys are of any type with an order; very long vectors are rows as others are; other columns are not looked at.
    An empty table gives an empty one.
    """
    small_batches(vectors.sparkSession, 5000)
    whole = usable(F.col("vector")) & F.col("label").isNotNull()
    rows = vectors.select(F.col(key).alias("key"), F.col(label).alias("label"), F.col(vector).alias("vector"))
    # 128 bits of hash stand for a vector in all that follows
    rows = rows.withColumns({"d1": F.when(whole, F.xxhash64("label", "vector")), "d2": F.when(whole, F.xxhash64(F.lit("d2"), "vector", "label"))})
    same = rows.where(F.col("d1").isNotNull()).groupBy("label", "d1", "d2").agg(F.min("key").alias("least"), F.count("*").alias("copies"), F.first("vector").alias("vector"))
    classes = written(same.withColumn("node", F.monotonically_increasing_id()), "vectors")
    candidates = connected_components(candidate_links(classes.select("node", "label", "vector"), threshold))
    heads = candidates.select("component").distinct()  # the node that names a component has no row of its own
    candidates = candidates.union(heads.select(F.col("component").alias("node"), "component"))
    members = classes.join(candidates, "node").select("node", "component", "copies", "vector")
    linked = materialise(exact_links(members, threshold))
    sums = linked.groupBy("node").agg(F.sum("add").alias("others"))
    named = connected_components(linked.select(F.col("node").alias("a"), F.col("root").alias("b")))
    known = classes.select("node", "d1", "d2", "least", "copies").join(sums, "node", "left").join(named, "node", "left").withColumn("class", F.coalesce("component", "node"))
    least = known.groupBy("class").agg(F.min("least").alias("first"))
    told = known.join(least, "class").select("d1", "d2", (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n"), "first", F.lit(True).alias("known"))
    joined = rows.drop("label", "vector").join(told, ["d1", "d2"], "left")
    component = F.when(F.col("known"), F.col("first")).otherwise(F.col("key"))
    return joined.select(F.col("key").alias(key), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("key").eqNullSafe(component).alias("kept"))


#: What near_duplicates() returns, as DuckDB SQL that compares all pairs of a label.
ORACLE = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS v FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT e.vec_id, (SELECT count(*) FROM links l WHERE l.a = e.vec_id)::BIGINT AS n_links, m.c AS component_id, m.c = e.vec_id AS kept
FROM embeddings e JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) m ON m.a = e.vec_id
"""
