"""Hard negatives, lexical search and license scans against brute force."""

from __future__ import annotations

import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from loomstead.llm import hard_negatives as HN
from loomstead.llm import lexical_search as LS
from loomstead.llm import license_scan as LI

VECTORS = "vec_id long, embedding array<float>, label int"


def mined(rows, anchors):
    """What mine() gives, pair by pair."""
    finite = lambda v: v is not None and all(x is not None and math.isfinite(x) for x in v)
    good = [(i, k, [math.floor(256 * float(np.float32(x))) for x in v], lab) for i, (k, v, lab) in enumerate(rows) if k is not None and lab is not None and finite(v)]
    found = []
    for i, key, q, label in good:
        if key not in anchors:
            continue
        scored = [(-sum(a * b for a, b in zip(q, p, strict=True)), k, j, lab) for j, k, p, lab in good if j != i and len(p) == len(q)]
        for s, positive, _, _ in sorted(x for x in scored if x[3] == label)[:5]:
            fits = sorted(x for x in scored if x[3] != label and 80 * -s <= 100 * -x[0] <= 100 * -s)
            found += [(key, positive, r + 1, x[1], -s, -x[0]) for r, x in enumerate(fits[:5])]
    return sorted(found)


def clustered(n, size, seed, spread=0.35):
    rng = np.random.default_rng(seed)
    heads = rng.standard_normal((8, size))
    rows = heads[rng.integers(0, 8, n)] + spread * rng.standard_normal((n, size))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    return [(int(i), [float(x) for x in v], int(rng.integers(0, 4))) for i, v in enumerate(rows)]


def mine_rows(spark, rows, anchors, **more):
    df = spark.createDataFrame(rows, VECTORS)
    return sorted(map(tuple, HN.mine(df, df.vec_id.isin(list(anchors)), **more).collect()))


@pytest.mark.parametrize("part", [HN.PART, 1 << 9])
def test_hard_negatives(spark, monkeypatch, part):
    monkeypatch.setattr(HN, "PART", part)
    rows = clustered(400, 12, 3)
    rows += [(1000 + i, list(rows[0][1]), i % 2) for i in range(40)]  # copies of an anchor, with ties
    rows += [(7, rows[7][1], 2), (2000, [0.0] * 12, 1), (2001, None, 1), (2002, [None] * 12, 1), (2003, [math.nan] * 12, 1), (2004, [1.0] * 12, None), (2005, [1.0, 2.0], 1)]
    rows += [(2006, [1.0, 1.5], 2), (2007, [], 1), (2008, [], 2), (2009, [3.0] * 12, 1), (2010, [2.5] * 12, 2), (2011, [-3.0] * 12, 1), (None, [1.0] * 12, 1)]
    anchors = {0, 7, 100, 200, 300, 1000, 2000, 2001, 2004, 2005, 2007, 2009, 2011}
    assert mine_rows(spark, rows, anchors) == mined(rows, anchors) != []


def test_hard_negatives_at_the_edges(spark):
    assert mine_rows(spark, [], {0}) == [] and mine_rows(spark, clustered(20, 4, 1), set()) == []
    huge = [(0, [3e38, 1.0], 1), (1, [3e38, 2.0], 1), (2, [3e38, 0.0], 2), (3, [1.0, 3e38], 2)]
    found = mine_rows(spark, huge, {0})
    assert [(r[0], r[1], r[3], r[4], r[5]) for r in found] == [(0, 1, 2, HN.HIGHEST, HN.HIGHEST), (0, 1, 3, HN.HIGHEST, HN.HIGHEST)]  # beyond 64 bits all are equal
    wide = spark.createDataFrame([(*r, 0, 0, 0.5, "x") for r in clustered(60, 4, 2)], VECTORS + ", row int, part int, norm double, anchor string")
    rows = clustered(60, 4, 2)
    assert sorted(map(tuple, HN.mine(wide, wide.vec_id == 0).collect())) == mined(rows, {0})


def test_bounds_hold_every_score():
    rng = np.random.default_rng(5)
    for size in (2, 3, 64):
        rows = np.floor(256 * rng.standard_normal((300, size)))
        rows[1], rows[2], rows[3] = rows[0], -rows[0], 0
        norm, unit = HN.lengths_and_units(rows)
        references = HN.choose(unit[:100])
        angles = np.arccos(np.clip(unit @ references.T, -1, 1)).astype(np.float32).astype(np.float64)
        for i in range(40):
            low, high = HN.score_bounds(angles[i], norm[i], angles, norm)
            scores = HN.integer_scores(rows, rows[i])
            assert (low <= scores).all() and (scores <= high).all()


def test_bounds_leave_rows_of_other_clusters_unscored(spark, monkeypatch):
    """Where vectors lie in narrow clusters, few rows get a score."""
    rng = np.random.default_rng(1)
    heads = np.linalg.qr(rng.standard_normal((16, 16)))[0]
    rows = np.floor(256 * (heads[np.arange(800) % 16] + 0.02 * rng.standard_normal((800, 16))))
    norm, unit = HN.lengths_and_units(rows)
    angles = np.arccos(np.clip(unit @ HN.choose(unit).T, -1, 1))
    scored = [int(((high >= 0.8 * 65536) & (low <= 65536)).sum()) for low, high in (HN.score_bounds(angles[i], norm[i], angles, norm) for i in range(50))]
    assert max(scored) < 100  # of 800; 50 lie in the anchor's own cluster


DOCS = [
    (1, "the cat sat on the mat"), (2, "The CAT. the cat? cat_cat"), (3, None), (4, ""), (5, "!!! --- ..."), (6, "über die Straße ÜBER 42 cat"), (7, "mat mat mat"),
    (8, "the cat sat on the mat"), (None, "the cat sat on the mat"), (9, "dog " * 3000 + "cat"), (10, "x"), (8, "the cat sat on the mat"),
]
ITEMS = [(1, "The cat, the mat"), (2, "über ÜBER 42"), (3, None), (4, "nothing of this"), (5, "cat cat dog"), (5, "mat"), (None, "x"), (6, "")]


def ranked(docs, items, top=20):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    counted = [(k, Counter(split(t))) for k, t in docs if split(t)]
    n, total = len(counted), sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    found = []
    for item, text in items:
        scores = []
        for k, c in counted:
            m = 100 - 25 + 25 * sum(c.values()) * n // total
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 12 * m)) for t in split(text) if c[t])
            if s > 0:
                scores.append((-s, k is None, k or 0))
        found += [(item, r + 1, None if none else k, -s) for r, (s, none, k) in enumerate(sorted(scores)[:top])]
    return sorted(found, key=str)


@pytest.mark.parametrize("pairs", [LS.INDEX_PAIRS, 3])
def test_lexical_search(spark, monkeypatch, pairs):
    monkeypatch.setattr(LS, "INDEX_PAIRS", pairs)  # three pairs a block: items are indexed in several blocks
    monkeypatch.setattr(LS, "CELLS", 20)
    monkeypatch.setattr(LS, "GATHERED", 3)
    docs = spark.createDataFrame([(*d, 1, 2.0) for d in DOCS], "doc_id long, text string, item long, score double").repartition(3)
    items = spark.createDataFrame([(*i, "x") for i in ITEMS], "item_id long, text string, rank string")
    for top in (2, 20):
        got = sorted(map(tuple, LS.rank(docs, items, top).collect()), key=str)
        assert got == ranked(DOCS, ITEMS, top)


def test_lexical_search_without_rows(spark):
    docs, items = spark.createDataFrame(DOCS, "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string")
    for d, i in ((docs.limit(0), items), (docs, items.limit(0)), (docs.where("doc_id = 3"), items)):
        assert LS.rank(d, i).columns == ["item_id", "rank", "doc_id", "score"] and LS.rank(d, i).count() == 0


WORDS = "permission is hereby granted released under the gnu general public license version 3 of mit apache 2 0 software all rights reserved copyright c acme cc by nc sa terms a x ü".split()


def test_automata_accept_what_their_patterns_match():
    pick = random.Random(4)
    automata = [(p, LI.Automaton(p), re.compile(LI.as_pattern(p) + " ")) for several in LI.TEMPLATES.values() for m in several for p in [LI.parse(m)]]

    def of(parts):  # a wording that the parts accept, or nearly
        out = []
        for p in parts:
            if p[0] == "word":
                out += [p[1].decode()] if pick.random() > 0.01 else []
            elif p[0] == "gap":
                out += pick.choices(WORDS, k=pick.randint(max(0, p[1] - (pick.random() < 0.1)), p[2] + (pick.random() < 0.1)))
            elif p[0] == "one":
                out += [w.decode() for w in pick.choice(p[1])]
            elif pick.random() < 0.5:
                out += of(p[1])
        return out

    hits = 0
    for k in range(3000):
        parts, automaton, pattern = automata[k % len(automata)]
        text = pick.choices(WORDS, k=pick.randint(0, 6)) + (of(parts) if k % 3 else pick.choices(WORDS, k=20)) + pick.choices(WORDS, k=pick.randint(0, 6))
        words = [w.encode() for w in text]
        line = "".join(f" {w}" for w in text) + " "
        accepted = any(automaton.longest(words, i) is not None for i in range(len(words)))
        assert accepted == bool(pattern.search(line)) == bool(list(automaton.spans(words)))
        assert not accepted or LI.longest_run(parts).decode() in line
        hits += accepted
    assert hits > 1000
    small = LI.Automaton(LI.parse("a [[b {{1-2}}]] c"))
    assert [small.longest(t.encode().split(), 0) for t in ("a c", "a b x c c", "a b c", "a x c", "a b x y c", "a b x y z c")] == [2, 5, None, None, 5, None]
    for bad in ("a [[b", "a ]] b"):
        with pytest.raises(ValueError):
            LI.parse(bad)
    with pytest.raises(ValueError):
        LI.Scanner(templates={"all": ["[[a]] {{0-3}}"]})


def test_license_scan(spark):
    mit = """MIT License. Copyright (c) 2020 Acme.\n\nPermission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy"""
    rows = [
        (1, "Released under the MIT License. Under THE MIT license!"), (2, None), (3, ""), (4, mit), (5, mit.replace("free of charge", "at no charge")), (6, "Lizenz: CC BY-NC 4.0, über alles"),
        (7, "word " * 40000 + "under the Apache License, Version 2.0"), (8, "(c) all rights reserved"), (None, "cc by nc"), (1, "cc by nc"), (9, "the apache license version 2x under the mit licenses"),
        (10, "This work is licensed under the GNU General Public License, version 3."),
    ]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, key int, labels string")
    found = LI.scan_licenses(docs)
    got = [(r.doc_id, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels) for r in found.collect()]
    assert got == [
        (1, 2, 1, 5, "mit", "mit"), (2, 0, None, None, "", ""), (3, 0, None, None, "", ""), (4, 0, None, None, "", "mit"), (5, 0, None, None, "", ""), (6, 1, 1, 1, "cc-by-nc", "cc-by-nc"),
        (7, 1, 40002, 40002, "apache-2", "apache-2"), (8, 0, None, None, "", "all-rights-reserved"), (None, 1, 0, 0, "cc-by-nc", "cc-by-nc"), (1, 1, 0, 0, "cc-by-nc", "cc-by-nc"),
        (9, 0, None, None, "", ""), (10, 0, None, None, "", "gpl-3"),
    ]
    assert [r.n_words for r in found.collect()] == [len(re.findall(r"[a-zA-Z0-9\x80-\U0010ffff]+", t or "")) for _, t in rows]
    score = {r.doc_id: r.score for r in found.collect()}
    assert score[2] == score[9] == 0 and 0 < score[1] < score[4] < 1
    assert [tuple(s) for r in found.collect() for s in r.spans if r.doc_id == 10] == [("gpl-3", 3, 12)]
    assert LI.scan_licenses(docs.limit(0)).count() == 0
