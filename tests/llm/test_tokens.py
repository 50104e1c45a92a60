"""Tokenizer operators against the libraries that they stand for."""

from __future__ import annotations

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from loomstead.llm import byte_bpe, packing, queries, token_count

SMALL = "/root/testdata/sf0.001"
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
COUNTS = public_tokenizers.path("byte_bpe_50k.json")
WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = list("ab cde  \n\n\t'sSt12 9.,;!¡é漢字😀  \x1c\x1f\x85​Ñß$%<|>ΣσΑ̈İ") + ["<|endoftext|>", "the", " and", "\r\n", "   ", "ing", "aaa", "====", "don't"]


def texts(n: int) -> list[str]:
    pick = random.Random(7)
    odd = ["".join(pick.choice(PIECES) for _ in range(pick.randint(0, 40))) for _ in range(n)]
    return [*odd, "", " ", "\n\n\n", "a" * 5000, "x y " * 3000, "é" * 300, "<|endoftext|><|endoftext|>", "<|startoftext|> a"]


@pytest.fixture(scope="module")
def tik():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_counts_equal_the_library():
    library, counter = Tokenizer.from_file(COUNTS), token_count.MergeCounter(COUNTS)
    for text in texts(3000):
        assert counter.of_text(text) == len(library.encode(text, add_special_tokens=False).ids), text


def test_count_rows(spark):
    df = spark.createDataFrame([(1, None, 9), (2, "", 9), (3, "the the", 9), (3, "the the", 9), (4, "é", 9)], "doc_id long, text string, n_tokens int")
    got = [tuple(r) for r in token_count.count_tokens(df, COUNTS, limit=1).select("doc_id", "n_bytes", "n_tokens", "over_limit").collect()]
    assert sorted(got) == [(1, 0, 0, False), (2, 0, 0, False), (3, 7, 2, True), (3, 7, 2, True), (4, 2, 1, False)]
    assert token_count.count_tokens(df.limit(0), COUNTS).count() == 0


def test_ids_equal_the_library(tik):
    model = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    for text in texts(3000):
        ids = model.encode(text)
        assert ids == tik.encode_ordinary(text), text
        assert model.decode(ids) == text.encode()


def test_offsets_cover_split_characters():
    model = byte_bpe.ByteBpe(RANKS, public_tokenizers.PATTERN)
    text = "a 漢😀!"
    ids = model.encode(text)
    begin, end = model.offsets(text, ids)
    for i, a, b in zip(ids, begin, end, strict=True):
        token = model.decode([i])
        assert token in text[a:b].encode()
    assert begin[0] == 0 and end[-1] == len(text)
    assert [x.tolist() for x in model.offsets("", [])] == [[], []]


def test_encode_and_decode_columns(spark):
    df = spark.createDataFrame([(1, "héllo wörld"), (2, None), (3, "")], "doc_id long, text string")
    ids = df.select("doc_id", byte_bpe.encode(F.col("text"), RANKS, public_tokenizers.PATTERN).alias("ids"))
    back = {r.doc_id: bytes(r.t) for r in ids.select("doc_id", byte_bpe.decode(F.col("ids"), RANKS, public_tokenizers.PATTERN).alias("t")).collect()}
    assert back == {1: "héllo wörld".encode(), 2: b"", 3: b""}
    spans = df.select(byte_bpe.encode_with_offsets(F.col("text"), RANKS, public_tokenizers.PATTERN).alias("s")).first().s
    assert [s.id for s in spans] == ids.first().ids and spans[-1].end == len("héllo wörld")


def test_round_trip_query(spark, tik):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = queries.op5_byte_bpe(spark, SMALL).collect()
    assert len(got) == len(docs)
    for r in got:
        ids = tik.encode_ordinary(docs[r.doc_id])
        assert (r.n_tokens, r.ids_sha256) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest())
        assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()


def test_count_query(spark):
    library = Tokenizer.from_file(COUNTS)
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    for r in queries.op9_token_count(spark, SMALL).collect():
        n = len(library.encode(docs[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(docs[r.doc_id].encode()), n, n > 512)


def test_packed_ids_equal_the_library():
    library, model = Tokenizer.from_file(WORDS), packing.WordBpe(WORDS)
    for text in texts(3000):
        assert np.frombuffer(model.encode(text, 2), "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 2], text


def test_first_fit_decreasing_equals_the_plain_way():
    pick = random.Random(5)
    for n in (0, 1, 2, 37, 200):
        lengths = [pick.randint(1, 100) for _ in range(n)]
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        room: list[int] = []
        for i in sorted(range(n), key=lambda i: (-lengths[i], i)):
            k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
            if k == len(room):
                room.append(100)
            assert (bins[i], offsets[i]) == (k, 100 - room[k])
            room[k] -= lengths[i]


def check_pieces(rows, docs, size=4096):
    library, by_doc, by_sequence = Tokenizer.from_file(WORDS), {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    assert set(by_doc) == set(docs)
    for key, pieces in by_doc.items():
        ids = np.array([*library.encode(docs[key] or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for p in sorted(pieces, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for pieces in by_sequence.values():
        at = 0
        for p in sorted(pieces, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= size
    return by_sequence


def test_packing_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    sequences = check_pieces(queries.op8_packing(spark, SMALL).collect(), docs)
    used = sum(p.length for s in sequences.values() for p in s)
    assert used / (4096 * len(sequences)) > 0.97


def test_packing_odd_rows(spark):
    docs = {1: None, 2: "", 3: "word " * 20_000, 4: "a b c"}
    df = spark.createDataFrame([(k, t, 1) for k, t in docs.items()], "doc_id long, text string, length int")
    check_pieces(packing.pack(df, WORDS, group_docs=2).collect(), docs)
    twice = packing.pack(df.union(df), WORDS).collect()
    assert sum(r.length for r in twice) == 2 * sum(r.length for r in packing.pack(df, WORDS).collect())
    assert packing.pack(df.limit(0), WORDS).count() == 0
