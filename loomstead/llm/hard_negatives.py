"""Hard negatives by angular triangle filtering: stored angles to reference directions bound a score before it is worked out.

Each row keeps the angles of its vector to a few reference directions. For an anchor at angle p and a row at angle t to one of them, the angle between
both lies from |t - p| to t + p (or 2 pi less that), so all references together give an interval of cosines, and times both norms one of scores. Only
rows whose interval meets a window that is asked for get their integer score. Rows live in cells by their nearest reference, dealt into parts of a bounded
size; an anchor goes to the parts of those cells whose angles leave room for its windows. So rows never move to anchors, and an anchor's search is a
sorted stream: the rows of a part are held, and all anchors that come to it pass by.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.llm.common import broadcast_if_small, materialise, small_batches, written

#: Reference directions, and the vectors, picked by hash, of which they are chosen. What they are changes the work and no result.
REFERENCES, SAMPLE = 16, 1024

#: Components in a part of a cell, about.
PART = 1 << 20

#: What is added to angles, which are stored in single precision, and to scores as a share of the product of norms; far over any rounding.
ANGLE_SLACK, SCORE_SLACK = 2e-6, 1e-9

#: Sums of whole numbers are exact in double precision up to here.
EXACT = 2.0**53

LOWEST, HIGHEST = -(1 << 63), (1 << 63) - 1

ROW = "row long, key long, label string, anchor boolean, size int, cell long, scaled array<double>, norm double, angles array<float>"


def usable(vector: Column, scale: float) -> Column:
    """Whether a vector is there, and all of its components are finite, times scale as well."""
    return vector.isNotNull() & ~F.coalesce(F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double") * scale) == float("inf"))), F.lit(True))


def matrix(column: pa.Array, size: int) -> np.ndarray:
    """The rows of a list column whose lists all have one size."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), size)


def lengths_and_units(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Norms of rows, and rows of length one; a zero row stays zero."""
    most = np.abs(rows).max(axis=1, initial=0.0)
    scaled = rows / np.where(most > 0, most, 1.0)[:, None]
    norm = np.linalg.norm(scaled, axis=1)
    with np.errstate(over="ignore"):
        return norm * most, scaled / np.where(norm > 0, norm, 1.0)[:, None]


def choose(units: np.ndarray, count: int = REFERENCES) -> np.ndarray:
    """Directions far apart: the first unit vector, then each time the one farthest from those chosen; fewer where no others are left."""
    nearest, chosen = np.full(len(units), -2.0), []
    at = 0
    while len(chosen) < min(count, len(units)):
        chosen.append(units[at])
        nearest = np.maximum(nearest, units @ units[at])
        at = int(nearest.argmin())
        if nearest[at] > 1 - 1e-9:
            break
    return np.array(chosen)


def integer_scores(rows: np.ndarray, anchor: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact; those beyond 64 bits become the nearest number that has 64."""
    if np.abs(rows).max(initial=0.0) * np.abs(anchor).max(initial=0.0) * max(1, len(anchor)) < EXACT:
        return (rows @ anchor).astype(np.int64)
    other = [int(x) for x in anchor.tolist()]
    sums = (sum(int(x) * y for x, y in zip(row, other, strict=True)) for row in rows.tolist())
    return np.array([min(max(s, LOWEST), HIGHEST) for s in sums], np.int64)


def score_bounds(angle: np.ndarray, norm: float, angles: np.ndarray, norms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The least and the largest score that the angles of an anchor and of rows leave open, moved apart by far more than rounding can."""
    between = np.abs(angles - angle).max(axis=1, initial=0.0) - ANGLE_SLACK
    folded = angles + angle
    folded = np.minimum(folded, 2 * np.pi - folded).min(axis=1, initial=np.pi) + ANGLE_SLACK
    with np.errstate(all="ignore"):
        product = norms * norm
        low, high = (product * np.cos(np.clip(x, 0, np.pi)) for x in (folded, between))
        return np.minimum(np.floor(low - product * SCORE_SLACK), HIGHEST), np.ceil(high + product * SCORE_SLACK)


def stored(rows: DataFrame, scale: float) -> DataFrame:
    """rows (row, key, label, anchor, vector) with scaled whole components, norm, angles and cell, as a table.

    References are chosen for the vector length that most of a bounded sample has; rows of other lengths have no angles, only norms.
    """
    spark = rows.sparkSession
    sample = rows.select("vector", F.size("vector").alias("size")).where("size > 0").orderBy(F.xxhash64(F.lit("sample"), "row"), "row").limit(SAMPLE).collect()
    sizes = [r.size for r in sample]
    usual = max(set(sizes), key=lambda s: (sizes.count(s), s), default=0)
    _, units = lengths_and_units(np.floor(scale * np.array([r.vector for r in sample if r.size == usual], np.float64).reshape(-1, max(1, usual))))
    shared = spark.sparkContext.broadcast(choose(units[np.abs(units).max(axis=1, initial=0.0) > 0]))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        references = shared.value
        for batch in batches:
            vectors = batch.column(4)
            sizes = np.diff(np.asarray(vectors.offsets))
            for size in np.unique(sizes):
                at = pa.array(np.flatnonzero(sizes == size))
                part = batch.take(at)
                scaled = np.floor(scale * matrix(part.column(4), int(size)))
                norm, unit = lengths_and_units(scaled)
                angles, cell = np.zeros((part.num_rows, 0)), np.full(part.num_rows, -1)
                if size == usual and len(references):
                    angles = np.arccos(np.clip(unit @ references.T, -1, 1))
                    cell = angles.argmin(axis=1)
                lists = lambda x, kind: pa.ListArray.from_arrays(np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, np.int32), pa.array(x.ravel(), kind))
                columns = [
                    part.column(0), part.column(1), part.column(2), part.column(3), pa.array(np.full(part.num_rows, size), pa.int32()), pa.array(cell, pa.int64()),
                    lists(scaled, pa.float64()), pa.array(norm), lists(angles, pa.float32()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["row", "key", "label", "anchor", "size", "cell", "scaled", "norm", "angles"])

    return written(rows.select("row", "key", "label", "anchor", "vector").mapInArrow(measure, ROW), "angles")


def with_parts(table: DataFrame) -> tuple[DataFrame, DataFrame]:
    """table with a column part, which deals a cell into bounded parts, and the cells: how many parts they have, and the ranges of their angles and norms."""
    ends = lambda f: F.array(*(f(F.get("angles", F.lit(i))) for i in range(REFERENCES)))
    cells = table.groupBy("size", "cell").agg(F.count("*").alias("n"), F.max("norm").alias("most"), ends(F.min).alias("low"), ends(F.max).alias("high"))
    cells = materialise(cells.withColumn("parts", F.ceil(F.col("n") * F.greatest("size", F.lit(1)) / PART).cast("int")).drop("n"))
    small = broadcast_if_small(cells.select("size", "cell", "parts"))
    dealt = table.join(small, ["size", "cell"]).withColumn("part", F.pmod(F.xxhash64(F.lit("part"), "row"), F.col("parts")).cast("int"))
    return dealt.drop("parts"), cells


def visits(targets: DataFrame, cells: DataFrame, home: bool) -> DataFrame:
    """Each target once for each part of the cells that its windows may find rows in: of its own cell, or of all others."""
    near = cells.withColumnsRenamed({"cell": "at", "most": "cell_norm"})
    met = targets.join(broadcast_if_small(near), "size").where(F.col("at") == F.col("cell") if home else F.col("at") != F.col("cell"))
    if not home:
        gap = F.transform("angles", lambda a, i: F.greatest(F.lit(0.0), F.get("low", i) - a, a - F.get("high", i)))
        cosine = F.cos(F.greatest(F.lit(0.0), F.coalesce(F.array_max(gap), F.lit(0.0)) - ANGLE_SLACK))
        room = F.col("norm") * F.col("cell_norm") * (F.greatest(cosine, F.lit(0.0)) + SCORE_SLACK)  # with a negative cosine, a short vector scores most
        met = met.where(F.ceil(room) >= F.array_min(F.transform("windows", lambda w: w["low"])).cast("double"))
    return met.select("row", "label", "size", F.col("at").alias("cell"), "scaled", "norm", "angles", "windows", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))


class Part:
    """The rows of one part of a cell, held while targets pass."""

    def __init__(self, rows: pa.Table, size: int):
        rows = rows.combine_chunks()
        self.row, self.key, self.norm = (rows[c].to_numpy() for c in ("row", "key", "norm"))
        self.scaled = matrix(rows["scaled"].combine_chunks(), size)
        angles = rows["angles"].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        self.angles = angles.reshape(len(self.row), -1)
        names = rows["label"].to_pylist()
        self.codes = {name: i for i, name in enumerate(dict.fromkeys(names))}
        self.label = np.array([self.codes[name] for name in names], np.int64)

    def best(self, target: dict, same: bool, top: int) -> Iterator[tuple[int, int, int, int]]:
        """(window, score, key, row) of the best rows in each window of a target, of its label or of others, without itself."""
        label = self.label == self.codes.get(target["label"], -1)
        low, high = score_bounds(np.array(target["angles"], np.float64), target["norm"], self.angles, self.norm)
        asked = [(w["low"], w["high"]) for w in target["windows"]]
        open_ = np.zeros(len(self.row), bool)
        for least, most in asked:
            open_ |= ~(high < least) & ~(low > most)  # bounds that are no numbers leave all open
        at = np.flatnonzero(open_ & (label if same else ~label) & (self.row != target["row"]))
        if not len(at):
            return
        scores = integer_scores(self.scaled[at], np.array(target["scaled"], np.float64))
        for w, (least, most) in enumerate(asked):
            inside = np.flatnonzero((scores >= least) & (scores <= most))
            if len(inside) > top:
                found = scores[inside]
                inside = inside[found >= np.partition(found, len(found) - top)[len(found) - top]]
            order = np.lexsort((self.row[at[inside]], self.key[at[inside]], ~scores[inside]))[:top]
            for i in inside[order].tolist():
                yield w, int(scores[i]), int(self.key[at[i]]), int(self.row[at[i]])


def search(table: DataFrame, targets: DataFrame, same: bool, top: int) -> DataFrame:
    """(target, window, score, key, row): for each window of a target, its best rows in each part, at most top a part."""
    kinds = "array<struct<low:long,high:long>>"
    rows = table.select("size", "cell", "part", F.lit(0).alias("kind"), "row", "key", "label", "scaled", "norm", "angles", F.lit(None).cast(kinds).alias("windows"))
    asked = targets.select("size", "cell", "part", F.lit(1).alias("kind"), "row", F.lit(0).cast("long").alias("key"), "label", "scaled", "norm", "angles", "windows")
    order = ["size", "cell", "part"]
    met = rows.union(asked).repartition(*order).sortWithinPartitions(*order, "kind")

    def pass_by(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, part = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            place = np.stack([batch.column(i).to_numpy() for i in range(4)], axis=1)
            cuts = np.append(np.flatnonzero((place[1:] != place[:-1]).any(axis=1)) + 1, batch.num_rows)
            begin, found = 0, []
            for end in cuts.tolist():
                where, kind = tuple(place[begin, :3].tolist()), place[begin, 3]
                if where != now:
                    now, held, part = where, [], None
                some = batch.slice(begin, end - begin)
                begin = end
                if kind == 0:
                    held.append(some)
                    continue
                if part is None and held:
                    part, held = Part(pa.Table.from_batches(held), where[0]), []
                if part is not None:
                    for target in some.select(["row", "label", "scaled", "norm", "angles", "windows"]).to_pylist():
                        found += [(target["row"], *x) for x in part.best(target, same, top)]
            columns = list(zip(*found, strict=True)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int32()), *(pa.array(c, pa.int64()) for c in columns[2:])], ["target", "window", "score", "key", "row"])

    return met.mapInArrow(pass_by, "target long, window int, score long, key long, row long")


def first(found: DataFrame, top: int) -> DataFrame:
    """found with rank: the first of each window of a target, highest scores first, then by key."""
    order = Window.partitionBy("target", "window").orderBy(F.desc("score"), "key", "row")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def mine(
    vectors: DataFrame, anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
    scale: float = 256.0, positives: int = 5, negatives: int = 5, share: tuple[int, int] = (4, 5),
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows of vectors for which anchor, a condition on them, holds.

    Components become floor(scale * x), and a score is their inner product, a whole number. An anchor's positives are its best other rows of its label;
    for each of them, the negatives are the best rows of other labels whose score is from share (a fraction) of the positive's up to it. Higher scores
    come first, then smaller keys, then either of two rows with one key. Rows without a label, a key (nothing could name them) or a vector take no part, nor
    do those with a component that is null or not finite, before or after scaling. Vectors of different length don't meet; empty and zero ones score 0.
    Repeated rows are rows of their own, so copies of an anchor are its positives. Very long vectors make smaller parts. Scores beyond 64 bits count as the
    nearest number within. Other columns are not looked at. Without anchors or rows, the result is empty.
    """
    spark = vectors.sparkSession
    small_batches(spark, 1000)
    picked = vectors.select(vectors[key].cast("long").alias("key"), vectors[label].cast("string").alias("label"), vectors[vector].cast("array<double>").alias("vector"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = picked.where(F.col("key").isNotNull() & F.col("label").isNotNull() & usable(F.col("vector"), scale))
    table = stored(written(rows.withColumn("row", F.monotonically_increasing_id()), "vectors"), scale)
    dealt, cells = with_parts(table)
    anchors = table.where("anchor").drop("anchor")
    window = lambda low, high: F.struct(low.cast("long").alias("low"), high.cast("long").alias("high"))

    # the anchor's own cell says what a row elsewhere must reach
    wide = anchors.withColumn("windows", F.array(window(F.lit(LOWEST), F.lit(HIGHEST))))
    own = written(first(search(dealt, visits(wide, cells, True), True, positives), positives), "own-positives")
    reached = own.where(F.col("rank") == positives).select(F.col("target").alias("row"), F.col("score").alias("least"))
    wide = anchors.join(reached, "row", "left").withColumn("windows", F.array(window(F.coalesce("least", F.lit(LOWEST)), F.lit(HIGHEST)))).drop("least")
    others = search(dealt, visits(wide, cells, False), True, positives)
    chosen = written(first(own.drop("rank").union(others), positives), "positives").select("target", F.col("key").alias("positive_id"), F.col("rank").alias("place"), F.col("score").alias("positive_score"))

    # windows of negative scores are empty; several positives may ask for the same one
    parts, whole = share
    least = F.expr(f"positive_score - (cast(positive_score as decimal(25,0)) * {whole - parts}) div {whole}")
    asked = chosen.where("positive_score >= 0").groupBy("target").agg(F.sort_array(F.collect_set(window(least, F.col("positive_score")))).alias("windows"))
    narrow = materialise(anchors.join(asked.withColumnRenamed("target", "row"), "row"))
    negative = search(dealt, visits(narrow, cells, True).union(visits(narrow, cells, False)), False, negatives)
    ranked = first(negative, negatives)
    windows = narrow.select(F.col("row").alias("target"), F.posexplode("windows").alias("window", "asked")).select("target", "window", F.col("asked.high").alias("positive_score"))
    pairs = chosen.join(windows, ["target", "positive_score"]).join(ranked.select("target", "window", "rank", F.col("key").alias("negative_id"), F.col("score").alias("negative_score")), ["target", "window"])
    named = pairs.join(table.where("anchor").select(F.col("row").alias("target"), F.col("key").alias("anchor_id")), "target")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: What mine() gives for the query's anchors and labels, as DuckDB SQL that scores every pair.
ORACLE = """
WITH good AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS id, a.label = b.label AS same, list_inner_product(a.q, b.q)::BIGINT AS score
  FROM good a JOIN good b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
positives AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id))::INTEGER AS rank,
  id AS negative_id, positive_score, score AS negative_score
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= 5
"""
