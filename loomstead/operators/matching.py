"""Matching terms to a vocabulary: exact names first, then the nearest embedding.

Vectors of the vocabulary live in cells by their nearest pivot, dealt into parts of a bounded size, with their distance to the pivot. On vectors of length
one the nearest by cosine are the nearest by distance, so the triangle inequality tells which cells, and which rows of a part, cannot hold a nearer one than
those found in a query's own cell: these are never compared.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of a part of the queries or of the vocabulary.
PART = 20_000

#: Pivots, and the vectors of the vocabulary, picked by hash, of which they are chosen. What they are changes the work and no result.
PIVOTS, SAMPLE = 64, 2048

#: What distances are widened by; far over any rounding.
SLACK = 1e-6


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; null if one is zero."""
    return F.try_divide(dot(a, b), F.nullif(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(0.0)))


def unit_rows(vectors) -> tuple[np.ndarray, np.ndarray]:
    """Vectors as rows of length one, and which of them have a length; the others are rows of zeros."""
    rows = np.stack([np.asarray(v, np.float64) for v in vectors])
    size = np.linalg.norm(rows, axis=1)
    there = np.isfinite(size) & (size > 0)
    return np.where(there[:, None], rows / np.where(there, size, 1.0)[:, None], 0.0), there


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of each row of a to each of b, all of length one."""
    return np.sqrt(np.maximum(0.0, 2.0 - 2.0 * (a @ b.T)))


def choose_pivots(units: np.ndarray, count: int = PIVOTS) -> np.ndarray:
    """Vectors far from each other: the first, then each time the one farthest from those chosen; no two are equal."""
    chosen, away, at = [], np.full(len(units), np.inf), 0
    while len(chosen) < min(count, len(units)) and away[at] > SLACK:
        chosen.append(units[at])
        away = np.minimum(away, distances(units, units[at : at + 1])[:, 0])
        at = int(away.argmax())
    return np.array(chosen)


def pivots_of(vocabulary: DataFrame) -> np.ndarray:
    """Pivots for a vocabulary, from a bounded sample of it; a single one where the sample is all of it, as one cell is then searched at once."""
    sample = vocabulary.select("vector").orderBy(F.xxhash64(F.lit("pivot"), "match_id")).limit(SAMPLE).collect()
    if not sample:
        return np.zeros((0, 0))
    units, there = unit_rows([r.vector for r in sample])
    if not there.any():
        return np.eye(1, units.shape[1])
    return choose_pivots(units[there], PIVOTS if len(sample) == SAMPLE else 1)


def placed(df: DataFrame, key: str, pivots: np.ndarray, every: bool = False) -> DataFrame:
    """(id, vector, cell, away): each vector that has a length, with its nearest pivot and how far that is; with every, the distances to all (far)."""
    kind = df.schema[key].dataType.simpleString()
    shared = df.sparkSession.sparkContext.broadcast(pivots)

    def place(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            if not len(frame):
                continue
            units, there = unit_rows(frame["vector"])
            far = distances(units[there], shared.value)
            cell = far.argmin(axis=1)
            found = pd.DataFrame({"id": frame["id"][there], "vector": frame["vector"][there], "cell": cell, "away": far[np.arange(len(far)), cell]})
            yield found.assign(far=list(far)) if every else found

    shape = f"id {kind}, vector array<double>, cell int, away double" + (", far array<double>" if every else "")
    return df.select(F.col(key).alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInPandas(place, shape)


def compared(asked: pd.DataFrame, known: pd.DataFrame, k: int) -> tuple[list[np.ndarray], int]:
    """For each row of asked, the places in known of its k nearest, equal ones by id; and how many pairs were compared.

    known is sorted by away, the distance to the pivot of its cell; asked has its distance to the same pivot (at) and how near a vector must be (within).
    """
    v, _ = unit_rows(known["vector"])
    q, _ = unit_rows(asked["vector"])
    away, ids, found, pairs = known["away"].to_numpy(), known["id"].to_numpy(), [], 0
    low = np.searchsorted(away, asked["at"].to_numpy() - asked["within"].to_numpy() - SLACK)
    high = np.searchsorted(away, asked["at"].to_numpy() + asked["within"].to_numpy() + SLACK, side="right")
    for i, (a, b) in enumerate(zip(low.tolist(), high.tolist(), strict=True)):
        near = v[a:b] @ q[i]
        pairs += b - a
        if len(near) > k:
            held = np.flatnonzero(near >= np.partition(near, len(near) - k)[len(near) - k])  # with all that equal the last
        else:
            held = np.arange(len(near))
        order = np.lexsort((ids[a:b][held], -near[held]))[:k]
        found.append((a + held[order], near[held[order]]))
    return found, pairs


def visits(queries: DataFrame, cells: DataFrame, home: bool) -> DataFrame:
    """(id, vector, cell, at, within) for each cell that a query has to look into: its own, or those of the others that may hold a vector within reach.

    queries is placed with every distance, and has within; cells has cell, and the least and the largest distance of its vectors to the pivot.
    """
    if home:
        return queries.select("id", "vector", "cell", F.col("away").alias("at"), "within")
    met = queries.select("id", "vector", "within", F.col("cell").alias("own"), F.posexplode("far").alias("cell", "at")).where("cell <> own").join(F.broadcast(cells), "cell")
    gap = F.greatest(F.lit(0.0), F.col("at") - F.col("most"), F.col("least") - F.col("at"))
    return met.where(gap <= F.col("within") + SLACK).select("id", "vector", "cell", "at", "within")


def nearest(queries: DataFrame, vocabulary: DataFrame, k: int = 1, part: int = PART) -> DataFrame:
    """(query_id, match_id, similarity, rank): the k nearest of the vocabulary by cosine, equal ones by match_id. None is left out: bounds only spare work.

    queries has query_id and vector, vocabulary match_id (a whole number) and vector, of one length; a zero vector is near nothing. Each query first looks
    into its own cell, then into those that the k found there don't rule out. A task holds a part of a cell and so many queries at most.
    """
    kind = queries.schema["query_id"].dataType.simpleString()
    pivots = pivots_of(vocabulary)
    if not len(pivots):
        return queries.sparkSession.createDataFrame([], f"query_id {kind}, match_id long, similarity double, rank int")
    known = placed(vocabulary.withColumn("match_id", F.col("match_id").cast("long")), "match_id", pivots).persist(StorageLevel.DISK_ONLY)
    cells = known.groupBy("cell").agg(F.min("away").alias("least"), F.max("away").alias("most"), F.count("*").alias("n"))  # a row for each pivot at most
    asked = placed(queries, "query_id", pivots, every=True).withColumn("within", F.lit(float("inf"))).persist(StorageLevel.DISK_ONLY)
    parts = lambda n: F.ceil(n / part).cast("int")
    dealt = lambda key, n: F.pmod(F.xxhash64(key), n).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"query_id": [], "match_id": [], "similarity": []})
        right = right.sort_values("away", kind="stable").reset_index(drop=True)
        found, _ = compared(left, right, k)
        rows = np.repeat(np.arange(len(found)), [len(at) for at, _ in found])
        at, near = (np.concatenate([f[i] for f in found]) for i in (0, 1))
        return pd.DataFrame({"query_id": left["id"].to_numpy()[rows], "match_id": right["id"].to_numpy()[at], "similarity": near})

    def search(seen: DataFrame) -> DataFrame:
        # both sides of a cell are dealt into parts, and each pair of parts meets in one task
        waiting = seen.groupBy("cell").agg(F.count("*").alias("m"))
        sizes = cells.join(waiting, "cell").select("cell", parts(F.col("n")).alias("hi_n"), parts(F.col("m")).alias("lo_n"))
        left = seen.join(F.broadcast(sizes), "cell").select("cell", dealt("id", F.col("lo_n")).alias("lo"), every(F.col("hi_n")).alias("hi"), "id", "vector", "at", "within")
        right = known.join(F.broadcast(sizes), "cell").select("cell", every(F.col("lo_n")).alias("lo"), dealt("id", F.col("hi_n")).alias("hi"), "id", "vector", "away")
        return left.groupBy("cell", "lo", "hi").cogroup(right.groupBy("cell", "lo", "hi")).applyInPandas(meet, f"query_id {kind}, match_id long, similarity double")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("query_id").orderBy(F.desc("similarity"), "match_id")
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)

    own = best(search(visits(asked, cells, True)))
    if len(pivots) <= 1:
        return own
    own = own.persist(StorageLevel.DISK_ONLY)
    reach = own.where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.sqrt(F.greatest(F.lit(0.0), 2 - 2 * F.col("similarity"))).alias("reach"))
    others = asked.join(reach, "id", "left").withColumn("within", F.coalesce("reach", F.lit(float("inf")))).drop("reach")
    return best(own.drop("rank").union(search(visits(others, cells, False))))


def accepted(similarity: Column, threshold: float) -> tuple[Column, Column]:
    """(accepted, reason): reason tells of a similarity below the threshold."""
    low = similarity < threshold
    return ~low, F.when(low, F.format_string("below_threshold (sim=%.4f)", similarity))


def match_terms(terms: DataFrame, names: DataFrame, vectors: DataFrame, vocabulary: DataFrame, threshold: float = 0.55) -> DataFrame:
    """(term, match_id, similarity, accepted, reason) for each distinct term: the exact name's, at 1.0, else the nearest vector's.

    terms has term; names has name and match_id; vectors has term and vector; vocabulary has match_id and vector. Terms are looked up trimmed and in
    lower case. A term with neither name nor vector has no match.
    """
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold lies between 0 and 1")
    distinct = terms.select(F.lower(F.trim("term")).alias("term")).distinct()
    exact = names.groupBy(F.lower(F.trim("name")).alias("term")).agg(F.max("match_id").alias("exact_id"))
    known = distinct.join(exact, "term", "left")
    open_ = known.where(F.col("exact_id").isNull()).join(vectors.select(F.lower(F.trim("term")).alias("term"), "vector").dropDuplicates(["term"]), "term")
    near = nearest(open_.select(F.col("term").alias("query_id"), "vector"), vocabulary).select(F.col("query_id").alias("term"), F.col("match_id").alias("near_id"), "similarity")
    found = known.join(near, "term", "left")
    similarity = F.when(F.col("exact_id").isNotNull(), F.lit(1.0)).otherwise(F.col("similarity"))
    ok, reason = accepted(similarity, threshold)
    return found.select("term", F.coalesce("exact_id", "near_id").alias("match_id"), similarity.alias("similarity"), F.coalesce(ok, F.lit(False)).alias("accepted"), reason.alias("reason"))


def wordpiece(text: Column, vocabulary: dict[str, int], length: int = 20, unknown: str = "[UNK]", first: str = "[CLS]", last: str = "[SEP]", pad: str = "[PAD]") -> Column:
    """Ids (array<int>) of a text column, always length of them: diacritics off, lower case, words and single signs, each cut greedily into its
    longest parts, parts after the first marked by ##. What is too long is cut before the last mark; null gives marks and padding only.
    """

    @F.arrow_udf("array<int>")
    def ids(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        def of_word(word: str) -> list[int]:
            found, start = [], 0
            while start < len(word):
                marked = "##" if start else ""
                end = next((e for e in range(len(word), start, -1) if marked + word[start:e] in vocabulary), None)
                if end is None:
                    return [vocabulary[unknown]]
                found.append(vocabulary[marked + word[start:end]])
                start = end
            return found

        def of_text(value: str | None) -> list[int]:
            plain = "".join(c for c in unicodedata.normalize("NFD", (value or "").lower()) if unicodedata.category(c) != "Mn")
            found = [i for word in re.findall(r"\w+|[^\w\s]", plain) for i in of_word(word)][: length - 2]
            return [vocabulary[first], *found, vocabulary[last], *[vocabulary[pad]] * (length - 2 - len(found))]

        for part in parts:
            yield pa.array([of_text(t) for t in part.to_pylist()], pa.list_(pa.int32()))

    return ids(text)


def mean_pooled(vectors: Column, mask: Column) -> Column:
    """The mean of the token vectors that a mask of 0 and 1 keeps, at length one; null where it keeps none or their mean is zero."""
    kept = F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda t: t["m"] == 1)
    start = F.transform(F.get(F.transform(kept, lambda t: t["v"]), F.lit(0)), lambda x: F.lit(0.0))
    total = F.aggregate(kept, start, lambda a, t: F.zip_with(a, t["v"], lambda x, y: x + y.cast("double")))
    size = F.sqrt(dot(total, total))
    return F.when(size > 0, F.transform(total, lambda x: x / size))
