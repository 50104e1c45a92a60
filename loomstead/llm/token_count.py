"""Token counts by heap-and-linked-list byte-pair merging.

A count is the number of first symbols (bytes) less the merges made; no identifiers come about. Texts are cut into chunks at white space,
and the count of a short chunk is remembered by each worker, so most of a text costs one look-up a word.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.llm.bpe_tables import CHUNK, BoundedCache, byte_alphabet
from loomstead.llm.common import small_batches

#: The pattern that byte-level pre-tokenizers of this family use: contractions, letters, digits, other signs, white space.
PRETOKEN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


class MergeCounter:
    """Counts the tokens of a text by the merges of a tokenizers file with a byte-level BPE model."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        model = content["model"]
        to_byte = {c: b for b, c in enumerate(byte_alphabet())}
        # symbols are numbered: bytes first, then what each merge makes
        number = {c: to_byte[c] for c in to_byte}
        self.merge: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made = number.setdefault(left + right, len(number))
            self.merge.setdefault((number[left], number[right]), (rank, made))
        self.special = [t["content"] for t in content.get("added_tokens", []) if t["special"]]
        self.cut = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.pieces, self.chunks = BoundedCache(self.of_piece), BoundedCache(self.of_chunk)

    def of_piece(self, piece: str) -> int:
        """Tokens of one pre-token: lowest-rank adjacent pairs are popped and merged until none is left."""
        symbols, merge = list(piece.encode()), self.merge
        n = len(symbols)
        left, right = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            if found := merge.get((symbols[i], symbols[i + 1])):
                heap.append((found[0], i, symbols[i], symbols[i + 1], found[1]))
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, a, b, made = heapq.heappop(heap)
            j = right[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue  # a merge next to it came first
            symbols[i], symbols[j] = made, -1
            right[i] = k = right[j]
            if k < n:
                left[k] = i
                if found := merge.get((made, symbols[k])):
                    heapq.heappush(heap, (found[0], i, made, symbols[k], found[1]))
            if (h := left[i]) >= 0 and (found := merge.get((symbols[h], made))):
                heapq.heappush(heap, (found[0], h, symbols[h], made, found[1]))
            merges += 1
        return n - merges

    def of_chunk(self, chunk: str) -> int:
        return sum(map(self.pieces.__getitem__, PRETOKEN.findall(chunk)))

    def of_text(self, text: str | None) -> int:
        if not text:
            return 0
        if self.cut and (parts := self.cut.split(text)) and len(parts) > 1:
            return len(parts) - 1 + sum(self.of_text(part) for part in parts)
        return sum(map(self.chunks.__getitem__, CHUNK.findall(text)))


@lru_cache(maxsize=4)
def counter(path: str) -> MergeCounter:
    """One for each worker and file."""
    return MergeCounter(path)


def token_count(text: Column, path: str) -> Column:
    """The number of tokens (long) of a text column; null counts as empty."""

    @F.arrow_udf("long")
    def count(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        of_text = counter(path).of_text
        for part in parts:
            yield pa.array([of_text(t) for t in part.to_pylist()], pa.int64())

    return count(text)


def count_tokens(docs: DataFrame, path: str, limit: int = 512, text: str = "text") -> DataFrame:
    """Adds n_bytes, n_tokens (long) and over_limit (n_tokens > limit) to docs.

    Null and empty texts have 0 bytes and 0 tokens; special strings inside a text are one token each, as the library's default is.
    Rows are kept as they are, copies too; columns of these three names are replaced.
    """
    small_batches(docs.sparkSession)
    return (
        docs.withColumn("n_bytes", F.coalesce(F.octet_length(text), F.lit(0)).cast("long"))
        .withColumn("n_tokens", token_count(F.col(text), path))
        .withColumn("over_limit", F.col("n_tokens") > limit)
    )
