"""Near-duplicates and line dedup against brute force."""

from __future__ import annotations

import random
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loomstead.llm import components, embedding_dedup, groups, line_dedup, queries, simhash_dedup

SMALL = "/root/testdata/sf0.001"


def labels_of(links, nodes):
    label = {n: n for n in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in links:
            low = min(label[a], label[b])
            if label[a] != low or label[b] != low:
                label[a] = label[b] = low
                changed = True
    return label


def test_components(spark):
    pick = random.Random(2)
    links = [(pick.randint(0, 60), pick.randint(0, 60)) for _ in range(40)] + [(100 + i, 101 + i) for i in range(30)] + [(200, 200), (None, 5)]
    expected = labels_of([p for p in links if None not in p], {x for p in links for x in p if x is not None})
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {n: c for n, c in expected.items() if n in got} and set(got) >= {n for n, c in expected.items() if n != c}
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def fingerprint(text, n=3):
    words = [w for w in "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + n]) for i in range(max(1, len(words) - n + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints(spark):
    cases = [None, "", "  ", "one", "One two", "a b c", "A B C d é F", "x" * 9000 + " y z w", "a b c a b c a b c"]
    assert [simhash_dedup.fingerprint_of(c, 3, 42) for c in cases] == [fingerprint(c) for c in cases]
    df = spark.createDataFrame([("a b c",)], "t string")
    native = df.select(F.xxhash64("t").alias("h")).first().h & (1 << 64) - 1
    assert simhash_dedup.fingerprint_of("a b c", 3, 42) == native


def by_brute_force(prints):
    keys = list(prints)
    links = [(a, b) for i, a in enumerate(keys) for b in keys[:i] if (prints[a] ^ prints[b]).bit_count() <= 3]
    return labels_of(links, keys)


def test_simhash_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    prints = {k: fingerprint(t) for k, t in docs.items()}
    expected = by_brute_force(prints)
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op7_simhash_dedup(spark, SMALL).collect()}
    assert got == {k: (f"{prints[k]:016x}", expected[k]) for k in docs}


def test_bk_tree_and_shards_equal_all_pairs():
    rng = np.random.default_rng(4)
    base = rng.integers(0, 1 << 63, 30, dtype=np.uint64)
    near = np.concatenate([base ^ (np.uint64(1) << rng.integers(0, 64, 30).astype(np.uint64)) for _ in range(20)] + [base])
    near = np.unique(near)
    part = rng.integers(0, 2, len(near)).astype(np.int32)
    far = np.bitwise_count(near[:, None] ^ near[None])
    query, node = simhash_dedup.BkTree(near).within(near, 3)
    assert {*zip(query.tolist(), node.tolist(), strict=True)} == {*zip(*(x.tolist() for x in np.nonzero(far <= 3)), strict=True)}
    for lo, hi in ((0, 0), (0, 1), (1, 1)):
        roots = simhash_dedup.shard_links(near, part, lo, hi, 3)
        pairs = [(i, j) for i, j in zip(*np.nonzero(far <= 3), strict=True) if i < j and {part[i], part[j]} == {lo, hi}]
        expected = labels_of(pairs, range(len(near)))
        assert roots.tolist() == [expected[i] for i in range(len(near))]


def test_large_shards_are_split(spark, monkeypatch):
    monkeypatch.setattr(simhash_dedup, "TREE_SIZE", 8)
    rng = np.random.default_rng(6)
    base = int(rng.integers(0, 1 << 62))
    prints = {base ^ sum(1 << int(b) for b in rng.choice(64, 2, replace=False)) for _ in range(120)} | {int(x) for x in rng.integers(0, 1 << 62, 50)}
    signed = {p: p - (1 << 64) if p >> 63 else p for p in prints}
    got = {r.node: r.component for r in simhash_dedup.similar_classes(spark.createDataFrame([(p,) for p in signed.values()], "print long")).collect()}
    expected = by_brute_force({s: p for p, s in signed.items()})
    assert {k: got.get(k, k) for k in expected} == expected


def test_masks_lose_no_link_and_shards_stay_small():
    rng = np.random.default_rng(7)
    for radius in (0, 1, 3, 5):
        for count in (0, 1, 10_000, 10**7, 10**9, 10**13):
            masks = simhash_dedup.shard_masks(count, radius)
            assert all(0 <= m < 1 << 64 for m in masks) and len(masks) <= 56
            for _ in range(200):
                flip = sum(1 << int(b) for b in rng.choice(64, radius, replace=False))
                assert any(flip & m == 0 for m in masks)
    bits = [max(m.bit_count() for m in simhash_dedup.shard_masks(n, 3)) for n in (512, 512 * 2**9, 512 * 2**16, 512 * 2**20)]
    assert bits == [0, 9, 16, 20] and [len(simhash_dedup.shard_masks(n, 3)) for n in (1000, 10**8, 10**11)] == [4, 10, 20]


def test_simhash_odd_rows(spark):
    rows = [(1, None, 1), (2, "", 1), (3, "a b c d", 1), (3, "a b c d", 1), (4, "A B C D", 1), (None, "a b c d", 1), (5, "q r s t u v", 1), (5, "", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int")
    got = sorted(((r.doc_id, r.component_id) for r in simhash_dedup.near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (2, 1), (3, 3), (3, 3), (4, 3), (None, 3), (5, 1), (5, 1)], key=str)
    kept = simhash_dedup.keep_first(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [1, 3, 3]
    assert simhash_dedup.near_duplicates(df.limit(0)).count() == 0 and simhash_dedup.keep_first(df.limit(0)).count() == 0


def test_simhash_rows_without_keys_and_keys_of_any_type(spark):
    rows = [("a", "x y z w", 1), (None, "x y z w", 2), (None, "p q r s", 3), (None, "p q r s", 4), (None, "k l m n", 5), ("b", "g h i j", 6)]
    df = spark.createDataFrame(rows, "doc_id string, text string, print int").withColumns({"key": F.lit(1), "class": F.lit(2), "_kept": F.lit(3), "row": F.lit(4)})
    kept = simhash_dedup.keep_first(df)
    assert kept.columns == df.columns
    found = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    assert found == sorted([("a", "x y z w"), ("b", "g h i j"), (None, "p q r s"), (None, "k l m n")], key=str)
    named = sorted(((r.doc_id, r.component_id) for r in simhash_dedup.near_duplicates(df).collect()), key=str)
    assert named == sorted([("a", "a"), (None, "a"), (None, None), (None, None), (None, None), ("b", "b")], key=str)


def links_by_brute_force(rows, threshold=0.93):
    good = [(k, np.array(v, float), lab) for k, v, lab in rows if v and lab is not None and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    return [(a, b) for i, (a, x, p) in enumerate(good) for b, y, q in good[:i] if p == q and len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= threshold]


def test_embedding_query(spark):
    rows = [(r.vec_id, list(r.embedding), r.label) for r in spark.read.parquet(f"{SMALL}/embeddings.parquet").collect()]
    links = links_by_brute_force(rows)
    label = labels_of(links, [r[0] for r in rows])
    degree = {r[0]: sum(r[0] in pair for pair in links) for r in rows}
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in queries.op6_embedding_dedup(spark, SMALL).collect()}
    assert got == {k: (degree[k], label[k], label[k] == k) for k in label}


def test_embedding_odd_rows_and_split_buckets(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BUCKET", 8)
    rng = np.random.default_rng(8)
    centre = rng.standard_normal(16)
    rows = [(i, (centre + 0.05 * rng.standard_normal(16)).tolist(), 1) for i in range(60)] + [(100 + i, rng.standard_normal(16).tolist(), i % 3) for i in range(60)]
    rows += [(200, rows[0][1], 1), (201, [2 * x for x in rows[0][1]], 1), (202, rows[0][1], None), (203, rows[0][1], 2), (204, None, 1), (205, [], 1), (206, [0.0] * 16, 1), (207, [float("nan")] * 16, 1)]
    rows += [(208, [1.0, None], 1), (209, [1.0, 0.0], 1), (210, [1e-40] * 16, 0), (211, [1e-40] * 16, 0)]
    df = spark.createDataFrame([(k, v, lab, 1) for k, v, lab in rows], "vec_id long, embedding array<double>, label int, n_links int")
    links = links_by_brute_force(rows)
    label = labels_of(links, [r[0] for r in rows])
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df).collect()}
    assert got == {k: (sum(k in pair for pair in links), label[k]) for k in label}
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    bare = df.select(F.when(F.col("vec_id") > 0, F.col("vec_id").cast("string")).alias("vec_id"), "label", "embedding")
    one = {(r.vec_id, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(bare).collect()}
    assert (None, "1", False) in one and ("1", "1", True) in one and ("202", "202", True) in one
    alone = spark.createDataFrame([(None, [1.0, 2.0], 1), (None, [1.0, 2.0], 1), (5, [2.0, -1.0], 1), (5, [-1.0, 0.1], 1)], "vec_id int, embedding array<float>, label int")
    got = sorted((str(r.vec_id), r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_duplicates(alone).collect())
    assert got == [("5", 0, 5, True), ("5", 0, 5, True), ("None", 1, None, True), ("None", 1, None, True)]


@pytest.mark.parametrize("size", [32, 64, 384])
def test_recall_of_pairs_at_the_threshold(spark, size):
    # 1,500 pairs just at the threshold, and as many vectors again that link with nothing
    rng = np.random.default_rng(size)
    a = rng.standard_normal((1500, size))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    b = rng.standard_normal((1500, size))
    b -= (a * b).sum(axis=1, keepdims=True) * a
    b /= np.linalg.norm(b, axis=1, keepdims=True)
    cosine = 0.9301
    rows = [(i, v.tolist(), 1) for i, v in enumerate(np.concatenate([a, cosine * a + np.sqrt(1 - cosine**2) * b, rng.standard_normal((3000, size))]))]
    got = {r.vec_id: (r.component_id, r.n_links) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert sum(got[1500 + i] == (i, 1) for i in range(1500)) >= 0.99 * 1500
    if size > 32:
        assert all(got[i] == (i, 0) for i in range(3000, 6000))


def test_plan_of_tables_grows_below_the_square():
    for count in (1, 100, 10**4, 10**6, 10**9):
        projections, tables, width = embedding_dedup.plan(count, 0.93)
        assert count * embedding_dedup.meets(2**0.5, width) ** projections <= embedding_dedup.STRANGERS
        assert (1 - embedding_dedup.meets((2 - 1.86) ** 0.5, width) ** projections) ** tables <= embedding_dedup.MISSED
        assert tables <= 10 * count**0.25 + 10


def test_groups_go_on_over_batches():
    import pyarrow as pa

    batch = lambda keys: pa.RecordBatch.from_arrays([pa.array(keys), pa.array(range(len(keys)))], ["k", "v"])
    rows = [[1, 1, 2], [], [2, 2], [3], [4, 4], [4, 5]]
    for size in (1, 3, 100):
        found = []
        for table, starts in groups.bundles(iter(map(batch, rows)), ["k"], size):
            keys, ends = table["k"].to_pylist(), [*starts[1:].tolist(), table.num_rows]
            found += [keys[a:b] for a, b in zip(starts.tolist(), ends, strict=True)]
        assert found == [[1, 1], [2, 2, 2], [3], [4, 4, 4], [5]]
    starts = np.array([0, 2, 5, 6])
    pairs = {(i, j) for a, b in groups.small_pairs(starts, 11, 3) for i, j in zip(a.tolist(), b.tolist(), strict=True)}
    assert pairs == {(0, 1), (2, 3), (3, 4), (2, 4)} and list(groups.large_groups(starts, 11, 3)) == [(6, 11)]


# --- lines


def lines_by_brute_force(docs):
    """{key: text} of the texts (with unique keys) without the chunks that occur before, from the rules in words."""
    seen, spans, filled = {}, {}, {}
    for k in sorted(docs):
        lines = (docs[k] or "").split("\n")
        filled[k] = [i for i, x in enumerate(lines) if x.split()]
        words = [len(lines[i].split()) for i in filled[k]]
        found = {(i, i) for i, w in enumerate(words) if w >= 50}
        for i in range(len(words)):
            ahead = [j for j in range(i + 1, len(words)) if sum(words[i : j + 1]) >= 20][:1]
            back = [j for j in range(i - 1, -1, -1) if sum(words[j : i + 1]) >= 20][:1]
            found |= {(i, j) for j in ahead if min(words[i], words[i + 1]) < 50} | {(j, i) for j in back if min(words[i], words[i - 1]) < 50}
        spans[k] = {(a, b): tuple(lines[filled[k][x]] for x in range(a, b + 1)) for a, b in found}
        for (a, _), body in sorted(spans[k].items()):
            seen.setdefault(body, (k, a))
    out = {}
    for k, text in docs.items():
        lost = set()
        for (a, b), body in spans[k].items():
            first = seen[body]
            if first != (k, a):
                lost |= set(range(max(a, first[1] + len(body)) if first[0] == k else a, b + 1))
        if not lost:
            out[k] = text
            continue
        lines, f = text.split("\n"), filled[k]
        keep = {f[j] for j in range(len(f)) if j not in lost}
        for j in range(-1, len(f)):
            if (0 <= j and j not in lost) or (j + 1 < len(f) and j + 1 not in lost):
                keep |= set(range(f[j] + 1 if j >= 0 else 0, f[j + 1] if j + 1 < len(f) else len(lines)))
        out[k] = "\n".join(lines[i] for i in sorted(keep))
    return out


def line(i, n=12):
    return " ".join(f"w{i}x{k}" for k in range(n))


def test_lines_against_brute_force(spark):
    pick = random.Random(9)
    passage = [line(900 + i) for i in range(6)]
    docs = {}
    for d in range(60):
        body = [line(d * 100 + i, pick.choice([0, 3, 12, 60])) for i in range(pick.randint(1, 9))]
        for _ in range(d % 3):
            at, a = pick.randint(0, len(body)), pick.randint(0, 3)
            body[at:at] = passage[a : a + pick.randint(1, 6)] * pick.choice([1, 1, 2])
        docs[d] = "\n".join(body)
    docs[60], docs[61], docs[62], docs[63] = docs[5], None, "", line(5000, 60)
    docs[64] = docs[63] + "\n" + line(1, 4)
    df = spark.createDataFrame([(k, t, len(t or ""), "x") for k, t in docs.items()], "doc_id long, text string, n_chars long, lines string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert {k: r.text for k, r in got.items()} == lines_by_brute_force(docs)
    assert got[60].text == "" and got[60].n_chars == 0 and got[60].lines == "x" and got[64].text == line(1, 4) and got[63].n_removed_lines == 0
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


def test_line_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in queries.op1_line_dedup(spark, SMALL).collect()}
    expected = lines_by_brute_force(docs)
    assert {k: t for k, (t, _) in got.items()} == expected and any(n for _, n in got.values())


@pytest.mark.parametrize(("lines", "length"), [(2, 10), (6, 5), (20, 1), (2, 26), (3, 18), (9, 6), (50, 1)])
def test_each_passage_goes_whole(spark, lines, length):
    # 100 passages of 20 words and more, each between other lines in two documents
    docs = []
    for k in range(100):
        passage = [line(f"{k}p{i}", length) for i in range(lines)]
        around = [[line(f"{k}{side}{d}", 7) for d in range(2)] for side in "ab"]
        docs += [(d, "\n".join([around[0][d % 2], *passage, around[1][d % 2]]), around) for d in (2 * k, 2 * k + 1)]
    df = spark.createDataFrame([d[:2] for d in docs], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {d: text if d % 2 == 0 else f"{around[0][1]}\n{around[1][1]}" for d, text, around in docs}


def test_wider_spacing_keeps_first_copies_and_finds_long_passages(spark):
    passage = [line(f"p{i}", 9) for i in range(60)]
    docs = [(d, "\n".join([line(f"{d}a", 7), *passage, line(f"{d}b", 7)])) for d in range(3)]
    got = [r.text for r in line_dedup.dedup_lines(spark.createDataFrame(docs, "doc_id long, text string"), spacing=4).orderBy("doc_id").collect()]
    assert got[0] == docs[0][1]
    for d in (1, 2):
        assert line(f"{d}a", 7) in got[d] and line(f"{d}b", 7) in got[d] and sum(x in got[d].split("\n") for x in passage) < 20


def test_runs_of_equal_lines(spark):
    same = "\n".join(["the same line here"] * 30)
    df = spark.createDataFrame([(1, f"x y\n{same}\nq"), (2, f"z z\n{same}\nr s")], "doc_id long, text string")
    got = {r.doc_id: r.text.split("\n") for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: ["x y", *["the same line here"] * 5, "q"], 2: ["z z", "r s"]}


def test_very_long_text_and_its_copy(spark):
    long = "\n".join(line(i, 5) for i in range(30_000))
    df = spark.createDataFrame([(1, long), (2, "first\n" + long), (3, "word " * 200_000)], "doc_id long, text string")
    got = {r.doc_id: (r.text, r.n_removed_lines) for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: (long, 0), 2: ("first", 30_000), 3: ("word " * 200_000, 0)}


def test_names_of_its_own_and_of_any_kind(spark):
    t = "\n".join(line(i) for i in range(5))
    names = ["_spans", "_span_key", "_span_hash", "_key", "_text_hash", "spans", "hash", "at", "_kept", "_unequal", "copies", "first", "c"]
    df = spark.createDataFrame([(k, t, *range(len(names))) for k in (1, 2)], "doc_id long, text string, " + ", ".join(f"{n} int" for n in names))
    out = line_dedup.dedup_lines(df)
    assert out.columns == [*df.columns, "n_removed_lines"]
    assert sorted((r.doc_id, r.text, *r[2:]) for r in out.collect()) == [(1, t, *range(len(names)), 0), (2, "", *range(len(names)), 5)]


def test_equal_hashes_of_different_bytes(spark):
    rows = [(1, "\n".join(line(i) for i in range(4))), (2, "\n".join([*(line(i) for i in range(4)), line(77, 3)])), (3, "\n".join(line(50 + i) for i in range(4)))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    spans = line_dedup.repeated_chunks(df)
    # a span of document 3 that claims to be like the first of document 2
    forged = spans.union(spans.where("_key = 2").select(F.lit(3).cast("long").alias("_key"), F.lit(0).cast("long").alias("_text_hash"), "spans"))
    true_hash = df.where("doc_id = 3").select(line_dedup._text_hash("text")).first()[0]
    forged = forged.withColumn("_text_hash", F.when(F.col("_key") == 3, F.lit(true_hash)).otherwise(F.col("_text_hash")))
    unequal = lambda s: line_dedup.unequal_chunks(line_dedup._with_spans(df, s, "doc_id", "text", "_s"), "doc_id", "text", "_s")
    assert {r._key for r in unequal(forged).collect()} == {3}
    assert unequal(spans) is None


def test_repeated_rows_and_null_keys(spark):
    t = "\n".join(line(i) for i in range(5))
    df = spark.createDataFrame([(7, t), (7, t), (None, t), (8, t)], "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in line_dedup.dedup_lines(df).collect()), key=str)
    assert got == sorted([(7, ""), (7, ""), (None, t), (8, "")], key=str)


def test_passages_with_empty_lines(spark):
    passage = [line("a", 60), "", "", line("b", 60), " ", line("c", 5)]
    docs = {1: [*passage, "", line("x")], 2: [line("y"), *passage, line("z")]}
    df = spark.createDataFrame([(d, "\n".join(t)) for d, t in docs.items()], "doc_id long, text string")
    got = {r.doc_id: r.text for r in line_dedup.dedup_lines(df).collect()}
    assert got == {1: "\n".join(docs[1]), 2: f"{line('y')}\n{line('z')}"}


def leaning(n, size, seed):
    """Vectors of length one whose cosines with each other are about 0.7, with near copies of one in twenty at cosine 0.935 to 0.96."""
    rng = np.random.default_rng(seed)
    unit = lambda x: x / np.linalg.norm(x, axis=-1, keepdims=True)
    rows = unit(np.sqrt(0.7) * unit(rng.standard_normal(size)) + np.sqrt(0.3) * unit(rng.standard_normal((n, size))))
    head = rows[: n // 20]
    aside = rng.standard_normal(head.shape)
    aside = unit(aside - (aside * head).sum(axis=1, keepdims=True) * head)
    cosine = rng.uniform(0.935, 0.96, (len(head), 1))
    return np.vstack([rows, cosine * head + np.sqrt(1 - cosine**2) * aside])


def test_a_label_that_leans_one_way_makes_no_class_of_strangers(spark, monkeypatch):
    rows = leaning(3000, 96, 2)
    df = spark.createDataFrame([(i, i, "x", [float(x) for x in r]) for i, r in enumerate(rows)], "vec_id long, node long, label string, embedding array<double>")
    near = rows @ rows.T
    linked = {(i, j) for i, j in np.argwhere(np.triu(near, 1) >= 0.93).tolist()}
    found = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    expected = Counter(x for p in linked for x in p)
    assert sum(found.values()) >= 0.99 * 2 * len(linked) and all(found[i] <= expected[i] for i in found) and len(linked) >= 150

    def largest():
        classes = components.connected_components(embedding_dedup.candidate_links(df.withColumnRenamed("embedding", "vector"), 0.93))
        return classes.groupBy("component").count().agg(F.max("count")).first()[0]

    seen_from_mean = largest()
    monkeypatch.setattr(embedding_dedup, "CENTRED", 10**9)
    seen_from_zero = largest()
    assert seen_from_mean < 100 < 1000 < seen_from_zero, (seen_from_mean, seen_from_zero)


def passages(lines, words, n, seed):
    """n passages, each in two documents between other lines of nine words, three on either side; and the places of their lines in the second ones."""
    pick = random.Random(seed)
    line = lambda k: " ".join(f"w{pick.randrange(10**9)}" for _ in range(k))
    docs = []
    for i in range(n):
        body = [line(words) for _ in range(lines)]
        for side in (0, 1):
            docs.append((2 * i + side, "\n".join([line(9) for _ in range(3)] + body + [line(9) for _ in range(3)])))
    return docs


#: The share of the lines of repeated passages that go, by lines, words in a line, and spacing; README gives these figures.
SHARES = {(6, 5): {1: 1.0, 2: 0.36, 4: 0.1}, (2, 30): {1: 1.0, 2: 0.1, 4: 0.03}, (10, 12): {1: 1.0, 2: 0.75, 4: 0.35}}


@pytest.mark.parametrize("spacing", [1, 2, 4])
def test_what_a_spacing_costs(spark, spacing):
    for (lines, words), shares in SHARES.items():
        n = 200
        docs = spark.createDataFrame(passages(lines, words, n, lines), "doc_id long, text string")
        gone = line_dedup.dedup_lines(docs, spacing=spacing).where("doc_id % 2 = 1").agg(F.sum("n_removed_lines")).first()[0]
        share = gone / (n * lines)
        print(f"{lines} lines of {words} words, spacing {spacing}: {share:.2f}")
        assert abs(share - shares[spacing]) <= (0 if spacing == 1 else 0.12), (lines, words, spacing, share)
