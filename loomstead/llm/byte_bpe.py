"""Byte-level BPE encoding and decoding with the tokenizers library, over Arrow batches.

The library's model works on printable characters that stand for bytes; offsets go from tokens to bytes and on to characters. A token that holds
only part of a character covers that character; decoding joins the bytes of all tokens first, so that such a character comes back whole.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer, models, pre_tokenizers

from loomstead.llm.bpe_tables import CHUNK, BoundedCache, byte_alphabet, read_ranks
from loomstead.llm.common import small_batches


class ByteBpe:
    """Encodes by the ranks of a file, each match of a pattern by itself, without special tokens."""

    def __init__(self, path: str, pattern: str):
        ranks, letters = read_ranks(path), byte_alphabet()
        shown = {token: "".join(letters[b] for b in token) for token in ranks}
        # any two tokens that join to a token may be merged, at that token's rank
        pairs = [
            (rank, len(token) - cut, shown[token[:cut]], shown[token[cut:]])
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        pairs.sort()
        self.tokenizer = Tokenizer(models.BPE(vocab={shown[t]: r for t, r in ranks.items()}, merges=[p[2:] for p in pairs], ignore_merges=True))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        top = max(ranks.values()) + 1
        self.bytes_of: list[bytes] = [b""] * top
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.digits = [str(i) for i in range(top)]
        self.chunks = BoundedCache(lambda chunk: array("i", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes())

    def encode(self, text: str | None) -> list[int]:
        return np.frombuffer(b"".join(map(self.chunks.__getitem__, CHUNK.findall(text or ""))), np.int32).tolist()

    def decode(self, ids: list[int]) -> bytes:
        """The bytes of the tokens, joined; a character split over tokens is whole again."""
        return b"".join(map(self.bytes_of.__getitem__, ids))

    def offsets(self, text: str | None, ids: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """First character of each token and the one after its last; tokens with parts of one character both cover it."""
        text = text or ""
        widths = np.fromiter((len(c.encode()) for c in text), np.int64, len(text))
        starts = np.concatenate([[0], np.cumsum(widths)])  # the byte at which each character begins
        ends = np.cumsum([len(self.bytes_of[i]) for i in ids], dtype=np.int64)
        begins = ends - np.array([len(self.bytes_of[i]) for i in ids], dtype=np.int64)
        return np.searchsorted(starts, begins, "right") - 1, np.searchsorted(starts, ends, "left")


@lru_cache(maxsize=4)
def model(path: str, pattern: str) -> ByteBpe:
    """One for each worker and file."""
    return ByteBpe(path, pattern)


def encode(text: Column, path: str, pattern: str) -> Column:
    """Token ids (array<int>) of a text column; null gives none."""

    @F.arrow_udf("array<int>")
    def ids(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = model(path, pattern).encode
        for part in parts:
            yield pa.array([run(t) for t in part.to_pylist()], pa.list_(pa.int32()))

    return ids(text)


def encode_with_offsets(text: Column, path: str, pattern: str) -> Column:
    """Structs (id, begin, end) of a text column: token ids with the characters that they cover; null gives none."""

    @F.arrow_udf("array<struct<id:int,begin:int,end:int>>")
    def spans(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe, kind = model(path, pattern), pa.list_(pa.struct([("id", pa.int32()), ("begin", pa.int32()), ("end", pa.int32())]))
        for part in parts:
            rows = []
            for text in part.to_pylist():
                ids = bpe.encode(text)
                rows.append([{"id": i, "begin": a, "end": b} for i, a, b in zip(ids, *map(np.ndarray.tolist, bpe.offsets(text, ids)), strict=True)])
            yield pa.array(rows, kind)

    return spans(text)


def decode(ids: Column, path: str, pattern: str) -> Column:
    """The bytes (binary) that an array of token ids stands for; null gives none."""

    @F.arrow_udf("binary")
    def content(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        run = model(path, pattern).decode
        for part in parts:
            yield pa.array([run(x or ()) for x in part.to_pylist()], pa.binary())

    return content(ids)


def round_trip(docs: DataFrame, path: str, pattern: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """For each row: its key, n_tokens, and SHA-256 digests of its ids (decimal, joined by a space) and of the bytes decoded from them.

    Ids are encoded, written out and decoded in one pass over each batch, so that only digests leave the workers.
    Null and empty texts have no tokens; rows are kept as they are, copies too.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = model(path, pattern)
        for batch in batches:
            counts, of_ids, of_bytes = [], [], []
            for value in batch.column(1).to_pylist():
                ids = bpe.encode(value)
                counts.append(len(ids))
                of_ids.append(hashlib.sha256(" ".join(map(bpe.digits.__getitem__, ids)).encode()).hexdigest())
                of_bytes.append(hashlib.sha256(bpe.decode(ids)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(counts, pa.int64()), pa.array(of_ids), pa.array(of_bytes)], [key, "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
