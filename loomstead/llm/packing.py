"""Packing documents into sequences: first-fit decreasing over a tournament tree, in randomised groups of documents.

A document's tokens are cut into whole sequences and one remainder; a remainder goes to the first sequence of its group with room for it, larger
ones first. A group has about a thousand documents picked by hash, so groups are alike, one task holds one group at a time, and a group leaves
one part-filled sequence at most.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomstead.llm.bpe_tables import WORD_CHUNK, BoundedCache
from loomstead.llm.common import materialise, small_batches

#: Characters beyond those of Latin scripts, and the one letter there that lower case makes two characters of. Texts without them are in composed
#: form, can be put in lower case at once, and are cut finely; others are cut at white space only.
EXOTIC = re.compile(r"[^\x00-\u012f\u0131-\u024f]")
UNSPACED = re.compile(r"[\S\x1c-\x1f]+")

#: Documents in a group, on average.
GROUP_DOCS = 1024


class WordBpe:
    """Ids of a tokenizer that drops white space: each run of other characters gives the same ids alone as in its text."""

    def __init__(self, path: str):
        tokenizer = Tokenizer.from_file(path)
        self.chunks = BoundedCache(lambda chunk: array("I", tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes())

    def encode(self, text: str | None, end: int) -> bytes:
        """The ids of a text and then end, as little-endian unsigned numbers of 32 bits."""
        text, tail = text or "", end.to_bytes(4, "little")
        if EXOTIC.search(text) or "<|" in text:  # strings of special tokens may stand in the text
            return b"".join(map(self.chunks.__getitem__, UNSPACED.findall(text))) + tail
        return b"".join(map(self.chunks.__getitem__, WORD_CHUNK.findall(text.lower()))) + tail


@lru_cache(maxsize=4)
def model(path: str) -> WordBpe:
    """One for each worker and file."""
    return WordBpe(path)


class TournamentTree:
    """The room in each of a number of bins; each inner node holds the most room below it."""

    def __init__(self, bins: int, size: int):
        self.leaves = 1 << max(0, bins - 1).bit_length()
        self.room = [size] * (2 * self.leaves)

    def first_fit(self, length: int) -> int:
        """Takes that much room in the first bin that has it, and gives its number."""
        room, node = self.room, 1
        while node < self.leaves:
            node = 2 * node if room[2 * node] >= length else 2 * node + 1
        bin_, room[node] = node - self.leaves, room[node] - length
        while node > 1:
            node //= 2
            room[node] = max(room[2 * node], room[2 * node + 1])
        return bin_


def first_fit_decreasing(lengths: list[int], size: int) -> tuple[list[int], list[int]]:
    """For each item, its bin and its offset there; items are at most size long, and of equal ones the earlier goes first."""
    tree, filled = TournamentTree(len(lengths), size), [0] * (len(lengths) + 1)
    bins, offsets = [0] * len(lengths), [0] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        bins[i] = tree.first_fit(lengths[i])
        offsets[i], filled[bins[i]] = filled[bins[i]], filled[bins[i]] + lengths[i]
    return bins, offsets


def pack(docs: DataFrame, path: str, size: int = 4096, end: int = 2, group_docs: int = GROUP_DOCS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Packs every row's tokens and an end id into sequences of at most size tokens; one row for each piece.

    Columns: the key, start, length, ids_crc32, doc_tokens, sequence_id, offset. Null and empty texts are the end id alone. A document longer than
    size gives whole sequences and a remainder. Rows with equal keys are packed each by itself. An empty table gives no pieces. Other columns are not looked at.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = model(path).encode
        for batch in batches:
            rows: list[tuple] = []
            for i, (key_, group, value) in enumerate(zip(*(c.to_pylist() for c in batch.columns), strict=True)):
                ids = encode(value, end)
                n = len(ids) // 4
                rows += [(key_, group, a, min(size, n - a), zlib.crc32(ids[4 * a : 4 * (a + size)]), n) for a in range(0, n, size)]
            columns = list(zip(*rows, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(columns[0], batch.schema.field(0).type), *(pa.array(c, pa.int64()) for c in columns[1:])], [key, "group", "start", "length", "ids_crc32", "doc_tokens"])

    def fill(pieces: pd.DataFrame) -> pd.DataFrame:
        """Packs one group. The order of rows that shuffles change does not change the result."""
        pieces = pieces.sort_values(["length", key, "start", "ids_crc32"], ascending=[False, True, True, True], ignore_index=True)
        bins, offsets = first_fit_decreasing(pieces["length"].tolist(), size)
        return pieces.assign(sequence_id=pieces["group"] * 2**32 + np.array(bins), offset=np.array(offsets)).drop(columns="group")

    # the row number only deals out copies of a row, so that they don't gather; pieces are kept once it is drawn, and no later rerun draws it again
    dealt = docs.select(key, F.xxhash64(F.lit("packing"), key, F.monotonically_increasing_id()).alias("group"), text)
    pieces = materialise(dealt.mapInArrow(cut, f"`{key}` {kind}, group long, start long, length long, ids_crc32 long, doc_tokens long"))
    groups = max(1, -(-pieces.where("start = 0").count() // group_docs))
    grouped = pieces.withColumn("group", F.pmod("group", F.lit(groups))).groupBy("group")
    return grouped.applyInPandas(fill, f"`{key}` {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")
