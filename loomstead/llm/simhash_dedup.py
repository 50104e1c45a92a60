"""SimHash near-duplicates: 64-bit fingerprints of word shingles, linked by BK-trees over shards.

Two fingerprints that differ in at most r bits agree in all but r of a number of blocks of their bits; so shards are keyed by bits of every choice of
blocks that many, and no link is lost. The number of fingerprints sets how many bits, so that shards hold some hundreds at any size. Each shard's
fingerprints make BK-trees, in which a search follows only edges whose distance lies within the radius of its own distance to the parent. A shard gives
a spanning forest of its links, never all pairs, and the classes of all shards are joined as connected components. The trees are built where their
shard is: together they hold all fingerprints, which may not pass through the driver as a broadcast would have them.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import broadcast_if_small, materialise, small_batches
from loomstead.llm.components import connected_components
from loomstead.llm.groups import UnionFind, bundles, large_groups, split_hot

#: Fingerprints that shards hold on average, about, and those in a tree at most; a larger shard is searched as several trees.
SHARD_SIZE, TREE_SIZE = 512, 4096

#: Shingles whose bits are counted at once, so that a very long text takes bounded memory.
COUNTED = 100_000

LOWER = bytes(range(256)).translate(bytes(b + 32 if 65 <= b <= 90 else b for b in range(256)))


def fingerprint_of(text: str | None, shingle: int, seed: int) -> int:
    """A bit is 1 if it is set in over half of the hashes of the text's shingles; without words, the fingerprint is 0."""
    found = (text or "").encode().translate(LOWER).split()  # bytes are split at ASCII white space only
    if not found:
        return 0
    digest = xxhash.xxh64_intdigest
    if len(found) <= shingle:
        return digest(b" ".join(found), seed)
    grams = list(map(b" ".join, zip(*(found[i:] for i in range(shingle)), strict=False)))
    ones = np.zeros(64, np.int64)
    for a in range(0, len(grams), COUNTED):
        hashes = np.array([digest(g, seed) for g in grams[a : a + COUNTED]], ">u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(grams)).tobytes(), "big")


def fingerprint(text: Column, shingle: int = 3, seed: int = 42) -> Column:
    """The fingerprint of a text column as a long with the same bits."""

    @F.arrow_udf("long")
    def prints(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array(np.array([fingerprint_of(t, shingle, seed) for t in part.to_pylist()], np.uint64).view(np.int64))

    return prints(text)


class BkTree:
    """Fingerprints under their parents, keyed by the number of bits in which they differ; searched by many queries at once."""

    def __init__(self, prints: np.ndarray):
        self.prints = prints
        children: list[dict[int, int]] = [{} for _ in prints]
        values = prints.tolist()
        for i in range(1, len(values)):
            node, value = 0, values[i]
            while (below := children[node].setdefault((value ^ values[node]).bit_count(), i)) != i:
                node = below
        self.count = np.array([len(c) for c in children])
        self.first = np.concatenate([[0], np.cumsum(self.count)])[:-1]
        self.child = np.array([n for c in children for n in c.values()], np.int64)
        self.edge = np.array([d for c in children for d in c], np.int64)

    def within(self, queries: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (query, node) at that distance at most."""
        query, node = np.arange(len(queries)), np.zeros(len(queries), np.int64)
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        while len(query):
            far = np.bitwise_count(queries[query] ^ self.prints[node]).astype(np.int64)
            hit = far <= radius
            hits.append((query[hit], node[hit]))
            n = self.count[node]
            row = np.repeat(np.arange(len(query)), n)
            at = np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + self.first[node][row]
            follow = np.abs(self.edge[at] - far[row]) <= radius
            query, node = query[row[follow]], self.child[at[follow]]
        return np.concatenate([h[0] for h in hits]), np.concatenate([h[1] for h in hits])


def shard_links(prints: np.ndarray, part: np.ndarray, lo: int, hi: int, radius: int) -> np.ndarray:
    """For each fingerprint of a shard, the number of the first of its class under the links between parts lo and hi."""
    classes = UnionFind(len(prints))
    owners = np.flatnonzero(part == lo)
    asking = np.flatnonzero(part == hi)
    if len(owners) and len(asking):
        tree = BkTree(prints[owners])
        for a in range(0, len(asking), 256):
            query, node = tree.within(prints[asking[a : a + 256]], radius)
            classes.join(asking[a : a + 256][query], owners[node])
    return classes.roots()


def shard_masks(count: int, radius: int, size: int | None = None) -> list[int]:
    """Masks of bits, such that fingerprints within radius agree under one of them at least, and so many share each value as a shard should hold.

    One block more than the radius allows for must agree at first, under as few masks as can be; where its bits don't tell enough apart, two or three.
    """
    bits = max(0, math.ceil(math.log2(max(count, 1) / (size or SHARD_SIZE))))
    for agree in (1, 2, 3):
        blocks = agree + radius
        width = 64 // blocks
        if bits <= agree * width:
            break
    each = [min(width, (bits + agree - 1 - i) // agree) for i in range(agree)]
    return [sum(((1 << n) - 1) << (block * width) for block, n in zip(chosen, each, strict=True)) for chosen in combinations(range(blocks), agree)]


def similar_classes(prints: DataFrame, radius: int = 3) -> DataFrame:
    """(node, component) for the fingerprints that link with another, named by the smallest of their class: prints has distinct longs in a column print."""
    masks = [m - (1 << 64) if m >> 63 else m for m in shard_masks(prints.count(), radius)]
    keys = F.explode(F.array(*(F.xxhash64(F.lit(i), F.col("print").bitwiseAND(F.lit(m))) for i, m in enumerate(masks))))
    shards = split_hot(prints.select("print", keys.alias("shard")), "shard", "print", TREE_SIZE)

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, starts in bundles(batches, ["shard", "lo", "hi"]):
            node, part, lo, hi = (table[c].to_numpy() for c in ("print", "part", "lo", "hi"))
            prints, roots = node.view(np.uint64), np.arange(len(node))
            for a, b in large_groups(starts, len(node), 1):
                roots[a:b] = a + shard_links(prints[a:b], part[a:b], lo[a], hi[a], radius)
            linked = np.flatnonzero(roots != np.arange(len(node)))
            if len(linked):
                yield pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[roots[linked]])], ["a", "b"])

    met = shards.repartition("shard", "lo", "hi").sortWithinPartitions("shard", "lo", "hi").select("shard", "lo", "hi", "part", "print")
    return connected_components(met.mapInArrow(link, "a long, b long"))


def _printed(docs: DataFrame, shingle: int, seed: int, key: str, text: str) -> DataFrame:
    small_batches(docs.sparkSession)
    return materialise(docs.select(F.col(key).alias("key"), fingerprint(F.col(text), shingle, seed).alias("print")))


def _components(printed: DataFrame, radius: int) -> DataFrame:
    """(print, class, component_id): for each fingerprint, that which names its class, and the smallest key of the class, null if none has a key."""
    prints = materialise(printed.groupBy("print").agg(F.min("key").alias("least")))
    classes = similar_classes(prints.select("print"), radius)
    # a key with several fingerprints links them
    several = materialise(printed.where("key is not null").groupBy("key").agg(F.min("print").alias("low"), F.max("print").alias("high")).where("low <> high"))
    if not several.isEmpty():
        more = printed.join(several, "key").select(F.col("print").alias("a"), F.col("low").alias("b"))
        classes = connected_components(classes.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more))
    named = prints.join(classes, prints["print"] == classes["node"], "left").select("print", "least", F.coalesce("component", "print").alias("class"))
    return named.join(named.groupBy("class").agg(F.min("least").alias("component_id")), "class").select("print", "class", "component_id")


def near_duplicates(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, fingerprint as 16 hex digits, component_id) for each row of docs.

    component_id is the smallest key reachable by links of fingerprints at radius or fewer bits, itself included; keys are of any type with an order.
    Null and empty texts have fingerprint zero and link as any other; very long ones are hashed in full, in parts. Rows with equal keys are one document:
    a link of one is a link of all. A row without a key never gives a component its id; it's null where no row has a key. Copies share a fingerprint and
    are compared once. Other columns are not looked at, and an empty table gives an empty one.
    """
    printed = _printed(docs, shingle, seed, key, text)
    joined = printed.join(_components(printed, radius), "print", "left")
    return joined.select(F.col("key").alias(key), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def keep_first(docs: DataFrame, radius: int = 3, shingle: int = 3, seed: int = 42, key: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each group of near-duplicates, that with the smallest key; rows of that key all stay.

    Rows without a key link as any others and come after all keys: a group of only such rows keeps one of them, that of the smallest fingerprint and
    text. All columns stay, whatever their names.
    """
    printed = _printed(docs, shingle, seed, key, text)
    named = materialise(_components(printed, radius))
    first = printed.join(named, "print").where(F.col("key") == F.col("component_id")).select(F.col("key").alias(key)).distinct()
    first = materialise(first)
    kept = docs.join(broadcast_if_small(first), key, "left_semi").select(docs.columns)
    bare = named.where("component_id is null").select("print", "class")
    if printed.where("key is null").isEmpty():
        return kept
    rows = docs.where(docs[key].isNull()).select(F.struct(*docs.columns).alias("row"), F.coalesce(docs[text], F.lit("")).alias("text"))
    rows = rows.withColumn("print", fingerprint(F.col("text"), shingle, seed)).join(bare, "print")
    one = rows.groupBy("class").agg(F.min_by("row", F.struct("print", "text")).alias("row"))
    return kept.union(one.select("row.*"))
