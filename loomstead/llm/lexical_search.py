"""Ranked lexical search the other way round: an inverted index over the items' terms is broadcast, and documents stream through it.

Items are the few and documents the many, so it is the items that are indexed: for each term, the items that hold it and how often. A first pass counts
the terms of each document that the index knows and keeps these counts; they give the number of documents of a term. A second pass streams them through
the index: a task holds one bounded heap for each item, and heaps are merged by a window. Items whose index would pass a bound are dealt into blocks, each
indexed and broadcast by itself; every block sees every document.
"""

from __future__ import annotations

import heapq
import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.llm.common import materialise, small_batches, written

#: Pairs of a term and an item that are broadcast at once, about; some tens of bytes each.
INDEX_PAIRS = 1_000_000

#: Scores (documents by items) that are summed at once in a task.
CELLS = 1_000_000

#: Pairs of a document's term and an item that are gathered at once in a task.
GATHERED = 1_000_000

#: ASCII characters other than digits and letters become spaces, and A-Z become small; bytes of other characters stay.
PLAIN = bytes((c if chr(c).isalnum() else 32) if c < 128 else c for c in range(256)).lower()

#: The same as an expression for the few texts of items.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: The place of a document without a key among those of an equal score: after all others.
LAST = 1 << 63


def terms_of(text: str | None) -> list[bytes]:
    """The terms of a text, as UTF-8, with A-Z in lower case; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split()


def terms(text: Column) -> Column:
    """terms_of() as an expression."""
    return F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), F.lit(TERM), F.lit(0))


def weight(documents: int, holding: int) -> int:
    """A term's weight, by the documents with a term at all and those that hold it."""
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * holding + 1)))


class Index:
    """The items of a block by term: postings[ends[t - 1]:ends[t]] are the items of term t, times says how often each of them holds it."""

    def __init__(self, pairs: list[tuple[str, int, int]]):
        self.items = np.array(sorted({item for _, item, _ in pairs}), np.int64)
        self.terms = {term.encode("utf-8", "surrogatepass"): t for t, term in enumerate(sorted({term for term, _, _ in pairs}))}
        numbers = {term.decode("utf-8", "surrogatepass"): t for term, t in self.terms.items()}
        rows = np.array(sorted((numbers[term], item, n) for term, item, n in pairs), np.int64).reshape(-1, 3)
        self.ends = np.searchsorted(rows[:, 0], np.arange(len(self.terms)), side="right")
        self.starts = np.append(0, self.ends[:-1]) if len(self.ends) else self.ends
        self.postings, self.times = np.searchsorted(self.items, rows[:, 1]), rows[:, 2]
        self.weights = np.zeros(len(self.terms), np.int64)

    def counts(self, text: str | None) -> tuple[int, list[int], list[int]]:
        """How many terms a text has, those of the index, and how often each of these occurs."""
        words = terms_of(text)
        known = Counter(map(self.terms.get, words))
        del known[None]
        return len(words), list(known.keys()), list(known.values())


def doc_terms(docs: DataFrame, index: Index, key: str, text: str) -> DataFrame:
    """(doc, n, ids, tfs) for each row of docs with a term: its key, its terms, and those of the index with their numbers."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, ids, tfs = zip(*(shared.value.counts(t) for t in batch.column(1).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids, pa.list_(pa.int32())), pa.array(tfs, pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "ids", "tfs"])

    picked = docs.select(docs[key].cast("long").alias("doc"), docs[text].alias("text"))
    return picked.mapInArrow(count, "doc long, n long, ids array<int>, tfs array<int>").where("n > 0")


class Heaps:
    """For each item of an index, the best documents of those that went through."""

    def __init__(self, index: Index, top: int):
        self.index, self.top = index, top
        self.heaps: list[list[tuple[int, int]]] = [[] for _ in index.items]
        self.least = np.ones(len(index.items), np.int64)  # what a score must reach

    def take(self, docs: np.ndarray, ends: np.ndarray, ids: np.ndarray, gains: np.ndarray) -> None:
        """Adds documents: docs their places in the order of keys, ends where the terms of each end, ids these terms, gains what one occurrence in an item adds."""
        index = self.index
        for a in range(0, len(docs), step := max(1, CELLS // max(1, len(index.items)))):
            part = slice(ends[a - 1] if a else 0, ends[min(a + step, len(docs)) - 1])
            row = np.repeat(np.arange(len(docs[a : a + step])), np.diff(np.append(part.start, ends[a : a + step])))
            scores = np.zeros((len(docs[a : a + step]), len(index.items)), np.int64)
            met, gain = ids[part], gains[part]
            sizes = (index.ends - index.starts)[met]
            cuts = np.unique(np.append(np.searchsorted(np.cumsum(sizes), np.arange(GATHERED, sizes.sum(), GATHERED)), [0, len(met)]))
            for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                size = sizes[i:j]
                at = np.repeat(index.starts[met[i:j]] - np.append(0, np.cumsum(size)[:-1]), size) + np.arange(size.sum())
                np.add.at(scores, (np.repeat(row[i:j], size), index.postings[at]), np.repeat(gain[i:j], size) * index.times[at])
            for d, item in zip(*(x.tolist() for x in np.nonzero(scores >= self.least)), strict=True):
                heap, entry = self.heaps[item], (int(scores[d, item]), -int(docs[a + d]))
                if len(heap) < self.top:
                    heapq.heappush(heap, entry)
                else:
                    heapq.heappushpop(heap, entry)
                if len(heap) == self.top:
                    self.least[item] = heap[0][0]

    def rows(self) -> Iterator[tuple[int, int, int]]:
        for item, heap in zip(self.index.items.tolist(), self.heaps, strict=True):
            for score, place in heap:
                yield item, score, -place


def best(counted: DataFrame, index: Index, documents: int, length: int, top: int) -> DataFrame:
    """(item, score, doc): each task's best documents of each item; doc_terms() as they were kept, over all documents with terms and all their terms."""
    shared = counted.sparkSession.sparkContext.broadcast(index)

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shared.value
        heaps = Heaps(index, top)
        for batch in batches:
            doc, n = batch.column(0), batch.column(1).to_numpy()
            m = 75 + 25 * n * documents // length
            ids, tfs = (batch.column(i).flatten().to_numpy().astype(np.int64) for i in (2, 3))
            sizes = np.diff(np.asarray(batch.column(2).offsets))
            gains = index.weights[ids] * (1_000_000_000 * tfs // (1000 * tfs + 12 * np.repeat(m, sizes)))
            docs = np.array([LAST if x is None else x for x in doc.to_pylist()], object)
            heaps.take(docs, np.cumsum(sizes), ids, gains)
        items, scores, places = zip(*heaps.rows(), strict=True) if any(heaps.heaps) else ((), (), ())
        docs = pa.array([None if p == LAST else p for p in places], pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(items, pa.int64()), pa.array(scores, pa.int64()), docs], ["item", "score", "doc"])

    return counted.mapInArrow(stream, "item long, score long, doc long")


def rank(docs: DataFrame, items: DataFrame, top: int = 20, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text") -> DataFrame:
    """(item_key, rank, key, score): for each row of items its best rows of docs with a score above 0, highest first, equal ones by ascending key.

    Terms, weights and scores are whole numbers (see weight() and best()). Documents without a term count nowhere. A null text has no terms, and an
    item without terms no rows. Each row of items, and each row of docs, stands for itself, with its key or none: a document without one comes after those
    of an equal score. Texts are read in full whatever their length; an item of very many terms is a block of its own. Keys of documents are whole numbers.
    Other columns are not looked at. Without documents or items, the result is empty.
    """
    spark = docs.sparkSession
    small_batches(spark)
    asked = written(items.select(items[item_key].alias("id"), terms(items[item_text]).alias("terms")).withColumn("item", F.monotonically_increasing_id()), "items")
    pairs = materialise(asked.select("item", F.explode("terms").alias("term")).groupBy("item", "term").agg(F.count("*").alias("times")))
    blocks = max(1, math.ceil(pairs.count() / INDEX_PAIRS))
    found = []
    for block in range(blocks):
        of_block = pairs.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        index = Index([(r.term, r["item"], r.times) for r in of_block.collect()])  # about INDEX_PAIRS rows
        counted = written(doc_terms(docs, index, key, text), "terms")
        totals = counted.agg(F.count("*").alias("documents"), F.sum("n").alias("length")).first()
        for r in counted.select(F.explode("ids").alias("id")).groupBy("id").count().collect():  # a row for each term of the block
            index.weights[r.id] = weight(totals.documents, r["count"])
        found.append(best(counted, index, totals.documents, totals.length or 1, top))
    every = found[0]
    for more in found[1:]:
        every = every.union(more)
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("doc"))
    ranked = every.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(asked.select("item", "id"), "item").select(F.col("id").alias(item_key), "rank", F.col("doc").alias(key), "score")


#: What rank() gives for the benchmark over documents, as DuckDB SQL.
ORACLE = r"""
WITH terms AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
asked AS (
  SELECT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
lengths AS (SELECT doc_id, count(*)::BIGINT AS n FROM terms GROUP BY doc_id),
totals AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS total FROM lengths),
counts AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY ALL),
weights AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM counts, totals GROUP BY term),
gains AS (
  SELECT doc_id, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * docs) // total))) AS gain
  FROM counts JOIN lengths USING (doc_id) JOIN weights USING (term), totals),
scores AS (SELECT item_id, doc_id, sum(gain)::BIGINT AS score FROM asked JOIN gains USING (term) GROUP BY ALL HAVING sum(gain) > 0)
SELECT item_id, (row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id))::INTEGER AS rank, doc_id, score
FROM scores QUALIFY rank <= 20
"""
