"""URL filter, quality rules, archives, toxicity and the pipeline."""

from __future__ import annotations

import base64
import glob
import hashlib
import itertools
import pathlib
import random
import re
import struct
import zlib
from collections import Counter

import corpus_pipeline
import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

from loomstead.llm import line_dedup, quality_rules, queries, simhash_dedup, toxicity, url_filter, warc

SMALL, MIDDLE = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
TABLES = ["documents", "embeddings", "pages", "benchmark", "labels"]


@pytest.mark.parametrize("folder", [SMALL, MIDDLE])
@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_sql(spark, name, folder):
    duck = duckdb.connect()
    for t in TABLES:
        duck.sql(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    expected = duck.sql(queries.ORACLES[name])
    found = queries.QUERIES[name](spark, folder)
    order = sorted(expected.columns)
    assert sorted(found.columns) == order
    plain = lambda v: round(v, 9) if isinstance(v, float) else v
    rows = lambda it, columns: sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in it), key=str)
    assert rows(map(tuple, found.collect()), found.columns) == rows(expected.fetchall(), expected.columns)


# --- URLs


def judged(spark, urls, rules=None):
    df = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    return {r.page_id: r for r in url_filter.judge(df, rules).collect()}


def test_url_parts_and_rules(spark):
    urls = [
        "HTTP://WWW.Example.COM/en/1?x#y", "http://a.example.com/en/2", "http://b.net/es/", "http://net/fr/x", "http://c.org", "//no", None, "http://com", "x://notcom/", "http://a.com?q/en/",
        "http://example.com:80/en/", "http://ÄB.com/é/#", "a://b://c.com/",
    ]
    got = judged(spark, urls)
    assert [(got[i].host, got[i].path, got[i].rule) for i in range(len(urls))] == [
        ("www.example.com", "/en/1", "www.example.com/en/"), ("a.example.com", "/en/2", "example.com/en/"), ("b.net", "/es/", "net/es/"), ("net", "/fr/x", "net/fr/"), ("c.org", "", None), ("", "", None),
        ("", "", None), ("com", "", None), ("notcom", "/", None), ("a.com", "", None), ("example.com:80", "/en/", None), ("Äb.com", "/é/", "com/"), ("b:", "//c.com/", None),
    ]
    assert [got[i].verdict for i in range(5)] == ["allow", "block", "block", "block", "allow"]


def templates_by_brute_force(urls, rules):
    """{url: (template, verdict of the template)} by the method in words, over a tree of dictionaries."""
    parts = {u: (u.split("://")[1].split("/")[0], [re.sub("[0-9]+", "{n}", x) for x in u.split("://")[1].split("/")[1:] if x]) for u in urls}
    marks = {}
    for u in urls:
        host, path = parts[u][0], "/" + u.split("://")[1].split("/", 1)[1] if "/" in u.split("://")[1] else ""
        fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
        marks[u] = max(fits, key=lambda r: len(r[0] + r[1]))[2] if fits else None
    found = {}

    def grow(members, template, level):
        if len({tuple(parts[u][1]) for u in members if len(parts[u][1]) > level}) < 2:
            for u in members:
                found[u] = "".join([template, *(f"/{x}" for x in parts[u][1][level:])]) or "/"
            return
        found.update({u: template or "/" for u in members if len(parts[u][1]) <= level})
        children = {}
        for u in members:
            if len(parts[u][1]) > level:
                children.setdefault(parts[u][1][level], []).append(u)

        def kind(u):
            rest = parts[u][1][level + 1 :]
            return f"{'end' if not rest else 'number' if rest[0] == '{n}' else 'file' if '.' in rest[0] else 'word'},{len(rest)}"

        kinds = {c: Counter(map(kind, us)) for c, us in children.items()}
        pool = {c: max((n, k) for k, n in kinds[c].items())[1] for c in children}
        share = lambda us: (sum(marks[u] == "block" for u in us), sum(marks[u] is not None for u in us))
        groups = {}
        for c, us in children.items():
            pooled = [v for d in children if pool[d] == pool[c] for v in children[d]]
            all_kinds = Counter(map(kind, pooled))
            df, n, total = len(all_kinds) - 1, len(us), len(pooled)
            chi = sum((kinds[c][k] - n * m / total) ** 2 / (n * m / total) for k, m in all_kinds.items())
            critical = df * (1 - 2 / (9 * df) + 3 * (2 / (9 * df)) ** 0.5) ** 3 if df else 0
            (b, m), (ab, am) = share(us), share(pooled)
            p, q = b / max(m, 1), ab / max(am, 1)
            merges = sum(pool[d] == pool[c] for d in children) > 1 and chi <= critical + 1e-9 and (m == 0 or (p - q) ** 2 * m <= 3.8416 * q * (1 - q) + 1e-9)
            groups.setdefault(f"*:{pool[c]}" if merges else c, []).extend(us)
        for name, us in groups.items():
            grow(us, f"{template}/{name}", level + 1)

    for host in {p[0] for p in parts.values()}:
        grow([u for u in urls if parts[u][0] == host], "", 0)
    prior = sum(m == "block" for m in marks.values()) / max(sum(m is not None for m in marks.values()), 1)
    out = {}
    for u in urls:
        same = [marks[v] for v in urls if parts[v][0] == parts[u][0] and found[v] == found[u]]
        b, m = same.count("block"), len(same) - same.count(None)
        out[u] = (found[u], marks[u] or ("block" if b and (b + 5 * prior) / (m + 5) >= 0.8 else "allow"))
    return out


def test_templates_against_brute_force(spark):
    pick = random.Random(3)
    words = ["en", "de", "shop", "blog", "a.html", "b.php", "x1y", "tag", "user"]
    urls = [f"http://{pick.choice(['a.org', 'b.org', 'w.b.org'])}/" + "/".join(pick.choice([*words, str(pick.randrange(99))]) for _ in range(pick.choice([0, 1, 2, 2, 3, 3, 4, 9]))) for _ in range(700)]
    urls += [f"http://deep.org/{'d/' * 12}{pick.choice(['p', 'q'])}/{i}" for i in range(30)]
    rules = [("org", "/en", "block"), ("b.org", "/de", "block"), ("w.b.org", "/shop", "allow"), ("deep.org", "/" + "d/" * 12 + "p", "block"), ("org", "/blog/tag", "allow")]
    expected = templates_by_brute_force(urls, rules)
    got = judged(spark, urls, rules)
    assert {u: (got[i].template, got[i].verdict) for i, u in enumerate(urls)} == {u: expected[u] for u in urls}


def test_unlabelled_pages_go_with_the_blocked_branches_they_are_like(spark):
    rules = [("h.test", "/es/", "block"), ("h.test", "/fr/", "block"), ("h.test", "/help/", "allow")]
    urls = [f"http://h.test/{lang}/{i}" for lang in ("es", "fr") for i in range(20)] + [f"http://h.test/{lang}/{i}.html" for lang in ("es", "fr") for i in range(4)]
    like = [f"http://h.test/en/{i}" for i in range(8)]
    unlike = [f"http://h.test/about/us/team/{x}" for x in "abcdefgh"] + [f"http://h.test/help/{x}" for x in "abcdefghij"] + ["http://h.test/", "http://other.test/en/1"]
    got = {urls_: r.verdict for urls_, r in zip(urls + like + unlike, [r for _, r in sorted(judged(spark, urls + like + unlike, rules).items())], strict=True)}
    assert all(got[u] == "block" for u in urls + like) and all(got[u] == "allow" for u in unlike)
    assert judged(spark, []) == {}


def test_deep_branches_are_told_apart(spark):
    # the same first twelve segments; what is below decides, and a very long URL is only one more shape
    stem = "/".join("abcdefghijkl")
    rules = [("h.test", f"/{stem}/bad/", "block"), ("h.test", f"/{stem}/good/", "allow")]
    urls = [f"http://h.test/{stem}/{side}/{i}" for side in ("bad", "good") for i in range(30)] + ["http://h.test/" + "z/" * 3000]
    got = judged(spark, urls, rules)
    assert got[0].template != got[30].template and got[0].purity > 0.9 > 0.1 > got[30].purity and got[60].verdict == "allow"


# --- quality


def repeated_by_brute_force(words, n=8):
    grams = [tuple(words[i : i + n]) for i in range(len(words) - n + 1)]
    return len({i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(n)})


def test_quality_counts(spark):
    a = " ".join(f"w{i}" for i in range(12))
    texts = [None, "", " \n\t", "a b", a + " " + a, "x " * 40, "x\ny\nx\n\n  \nx", "a#b $*% <|>&", "é漢 😀 x", a + "\x1c" + a, "one " * 7 + "two", "\u00a0 \u2003", "a b c d e f g h a b c d e f g h"]
    df = spark.createDataFrame([(i, t, "en", "s", 5) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_words int")
    for r in quality_rules.measure(df).collect():
        t = texts[r.doc_id] or ""
        words = [w for w in "".join(" " if c in "\t\n\x0b\x0c\r" else c for c in t).split(" ") if w]
        lines = [x for x in t.split("\n") if any(c not in " \t\n\x0b\x0c\r" for c in x)]
        rep = repeated_by_brute_force(words)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), rep), t
        assert r.base_failed == (len(words) < 20 or 100 * rep > 30 * len(words))


def test_quality_thresholds_follow_the_group(spark):
    good = lambda i: " ".join(f"word{(i * 31 + k * k * 7 + k) % 997}" for k in range(60))
    rows = [(i, good(i), "en", None if i % 2 else "s", 1) for i in range(200)] + [(900, " ".join(f"a{k} #" for k in range(60)), "en", "s", 1), (901, " ".join(f"{k}" * 30 for k in range(60)), "en", "s", 1), (None, good(5), None, None, 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, kept int")
    verdict = {r.doc_id: r.kept for r in quality_rules.judge(df).collect()}
    assert not verdict[900] and not verdict[901] and all(v for k, v in verdict.items() if k not in (900, 901))
    kept = quality_rules.keep_good(df)
    assert kept.columns == df.columns and kept.count() == len(rows) - 2
    assert quality_rules.judge(df.limit(0)).count() == 0


def test_bounds_past_the_size_of_a_sketch(spark):
    # 60,000 texts in one group, far more than a sketch holds: its bounds stay near the exact ones, and a small group is drawn to them
    rows = spark.range(60_000).selectExpr(
        "'en' AS lang", "IF(id % 1000 = 0, 't', 's') AS source", "false AS base_failed",
        "CAST(pmod(xxhash64(id), 1000) AS BIGINT) AS word_length", "CAST(pow(pmod(xxhash64(id, 1), 100), 2) AS BIGINT) AS symbol_share", "0L AS dup_line_share",
    )
    got = {r.source: r for r in quality_rules.thresholds(rows).collect()}
    exact = {s: rows.where(f"source = '{s}'").agg(*(F.expr(f"percentile(word_length, {p})") for p in (0.245, 0.255, 0.745, 0.755))).first() for s in "st"}
    low = exact["s"][3] + 3 * (exact["s"][2] - exact["s"][1]) + 100 - 20
    high = exact["s"][3] + 3 * (exact["s"][3] - exact["s"][0]) + 100 + 20
    assert low <= got["s"].high_word_length <= high and abs(got["t"].high_word_length - got["s"].high_word_length) < 300


def test_quality_of_a_very_long_text(spark):
    long = " ".join(f"word{i}" for i in range(300_000))
    df = spark.createDataFrame([(1, long, None, None), (2, "a b " * 100_000, "en", "s")], "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in quality_rules.judge(df).collect()}
    assert got[1].n_words == 300_000 and got[1].kept and got[2].n_repeat_words == 200_000 and not got[2].kept


# --- archives


def page_rows(spark):
    big, other = "x" * 1200, "é" * 700
    rows = [(1, "http://a/ b\r\n", big, 0), (5, "http://b", big, 0), (3, None, big, 0), (4, "u", other, 0), (7, "u", other, 0), (8, "u", None, 0), (9, "u", "", 0), (10, "u", "small", 0), (11, "u", "small", 0), (6, "u", "y" * 999, 0), (2, "u", "y" * 999, 0)]
    return rows, spark.createDataFrame(rows, "page_id long, url string, html string, n int")


def test_archives(spark, tmp_path):
    rows, df = page_rows(spark)
    path = str(tmp_path / "archives")
    warc.write_archives(warc.plan_records(df.repartition(3)), path)
    got = {r.page_id: r for r in warc.read_archives(spark, path).collect()}
    assert len(got) == len(rows)
    for key, _, html, _ in rows:
        payload = (html or "").encode()
        newest = max(k for k, _, h, _ in rows if (h or "") == (html or ""))
        repeats = len(payload) >= 1000 and newest != key
        assert tuple(got[key]) == (key, len(payload), hashlib.sha1(payload).hexdigest(), "revisit" if repeats else "response", newest if repeats else None)
    records = []
    for name in glob.glob(f"{path}/*/part-*"):
        content = open(name, "rb").read()
        assert struct.unpack("<I", content[:4])[0] == warc.DICTIONARY_MAGIC
        records += list(warc.archive_records(content))
    assert len(records) == len(rows) and all(r.startswith(b"WARC/1.1\r\n") and r.endswith(b"\r\n\r\n") for r in records)
    assert not any(b"\n" in warc.parse_record(r).get("warc-target-uri", "").encode() for r in records)


def test_dictionary_is_trained_and_may_be_compressed(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h/{i}", f"<html><body><p>page {i * 7919 % 1000} of many pages {hashlib.sha256(str(i).encode()).hexdigest()}</p></body></html>") for i in range(600)], "page_id long, url string, html string")
    path = str(tmp_path / "archives")
    warc.write_archives(warc.plan_records(df.coalesce(1)), path)
    content = open(glob.glob(f"{path}/*/part-*")[0], "rb").read()
    size = struct.unpack("<II", content[:8])[1]
    assert size > 1000 and warc.read_archives(spark, path).count() == 600
    packed = zstandard.compress(content[8 : 8 + size])
    again = struct.pack("<II", warc.DICTIONARY_MAGIC, len(packed)) + packed + content[8 + size :]
    assert list(warc.archive_records(again)) == list(warc.archive_records(content))
    for bad in (content[:-20], content[: 8 + size + 3], b"junkjunk" + content, content[: size // 2]):
        with pytest.raises(ValueError):
            list(warc.archive_records(bad))


def test_archives_are_bounded_and_unsound_ones_told(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 20_000)
    html = lambda i: " ".join(hashlib.sha256(f"{i}.{k}".encode()).hexdigest() for k in range(10))
    pages = [(i, f"http://h/{i}", html(i)) for i in range(400)] + [(999, "http://h/long", "".join(html(k) for k in range(2000)))]
    path = str(tmp_path / "archives")
    warc.write_archives(warc.plan_records(spark.createDataFrame(pages, "page_id long, url string, html string").coalesce(2)), path)
    files = sorted(glob.glob(f"{path}/*/part-*"))
    sizes = [len(open(f, "rb").read()) for f in files]
    assert len(files) > 6 and all(n < 21_000 for n in sizes if n != max(sizes)) and {r.page_id for r in warc.read_archives(spark, path).collect()} == {p[0] for p in pages}
    content = bytearray(open(files[0], "rb").read())
    content[-30] ^= 255
    open(files[0], "wb").write(content)
    for f in glob.glob(f"{path}/*/.part-*.crc"):
        pathlib.Path(f).unlink()
    told = warc.read_records(spark, path).collect()
    bad = [r for r in told if r.error]
    assert len(bad) == 1 and bad[0].page_id is None and bad[0].file.endswith(files[0].rsplit("/", 1)[1]) and len(told) > 350
    with pytest.raises(Exception, match="part-"):
        warc.read_archives(spark, path).collect()


def test_unsound_records():
    good = warc.record(1, "u", b"payload", hashlib.sha1(b"payload").digest(), None, "2024-01-01T00:00:00Z")
    assert warc.page_record(good) == (1, 7, hashlib.sha1(b"payload").hexdigest(), "response", None)
    for bad in (good[:-1], good.replace(b"WARC/1.1", b"HTTP/1.1"), good.replace(b"WARC-Date", b"X-Date"), good.replace(b"payload", b"paylaod"), good + b"x"):
        with pytest.raises(ValueError):
            warc.page_record(bad)
    other = base64.b32encode(hashlib.sha1(b"other").digest())
    with pytest.raises(ValueError):
        warc.page_record(good.replace(base64.b32encode(hashlib.sha1(b"payload").digest()), other))


def test_no_pages(spark, tmp_path):
    _, df = page_rows(spark)
    warc.write_archives(warc.plan_records(df.limit(0)), str(tmp_path / "none"))
    assert warc.read_archives(spark, str(tmp_path / "none")).count() == 0


# --- toxicity


@pytest.fixture(scope="module")
def learned(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    return docs, labels, toxicity.learn(docs, labels)


def test_held_out_accuracy(spark, learned):
    docs, labels, scorer = learned
    marked = toxicity.score(docs.join(labels.select("doc_id", "toxic"), "doc_id"), scorer).withColumn("h", toxicity.held_out(F.col("doc_id"))).where("h").select("score", "predicted", "toxic").collect()
    bad, fine = ([r.score for r in marked if r.toxic == x] for x in (1, 0))
    auc = np.mean([[(b > f) + 0.5 * (b == f) for f in fine] for b in bad])
    assert auc > 0.9 and np.mean([r.predicted == r.toxic for r in marked]) > 0.95


def test_disguises(learned):
    scorer = learned[2]
    for word, restored in (("l0ser", "loser"), ("1d10t", "idiot"), ("$tup1d", "stupid"), ("stuuupid", "stupid"), ("m0r0n", "moron"), ("tr@sh", "trash")):
        assert scorer.decode(word) == restored, word
        assert scorer.score(f"Of the {word} and.") >= 0.5
    assert scorer.decode("l o s e r") == "loser" and scorer.score("you l o s e r now") >= 0.5 and scorer.score("s.t.u.p.i.d") >= 0.5
    assert scorer.score("the and of 2024, mail x9@y.z 12:30") < 0.5 and scorer.score("") == 0.0 and scorer.score(None) == 0.0
    assert scorer.score("A" * 100_000) < 0.5 and scorer.restore(f"a {'st' + 'u' * 40 + 'pid'} b") == "a stupid b"


def readings_by_brute_force(signs, model):
    """(cost, reading) of every reading of signs as one word, from the costs of the channel and the model in words."""
    options = []
    for i, sign in enumerate(signs):
        if sign in toxicity.LEET:
            options.append([(c, toxicity.AS_LETTER) for c in toxicity.LEET[sign]] + [("", toxicity.DROP_SIGN)])
        elif i and signs[i - 1] == sign:
            run = signs[max(0, i - 2) : i + 2].count(sign) > 2
            options.append([(sign, toxicity.KEEP_REPEAT if run else toxicity.KEEP_DOUBLE), ("", toxicity.DROP_REPEAT if run else toxicity.DROP_DOUBLE)])
        else:
            options.append([(sign, 0.0)])
    for pick in itertools.product(*options):
        word = "".join(c for c, _ in pick)
        codes = [0, 0, *map(int, toxicity.letter_codes(word)), 0]
        yield sum(x for _, x in pick) - sum(float(model[tuple(codes[k : k + 3])]) for k in range(len(codes) - 2)), word


def test_decoding_against_every_reading(learned):
    scorer, pick = learned[2], random.Random(5)
    for _ in range(300):
        signs = toxicity.signs_of("".join(pick.choice("abeilost0134$!@*|éß") * pick.choice([1, 1, 1, 2, 4]) for _ in range(pick.randint(1, 5)))[:6])
        told = sorted(readings_by_brute_force(signs, scorer.model))
        found = next(cost for cost, word in told if word == scorer.read(signs))
        assert found == pytest.approx(told[0][0], abs=1e-6), signs


def test_toxicity_query(spark):
    labels = {r.doc_id: r.toxic for r in spark.read.parquet(f"{MIDDLE}/labels.parquet").collect()}
    docs = [r.doc_id for r in spark.read.parquet(f"{MIDDLE}/documents.parquet").select("doc_id").collect()]
    got = {r.doc_id: r for r in queries.op10_toxicity(spark, MIDDLE).collect()}
    assert sorted(got) == sorted(docs) and all(r.held_out == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for k, r in got.items())
    assert np.mean([got[k].predicted == labels[k] for k in labels if got[k].held_out]) > 0.9


def disguised(text, words, pick):
    """text with those of its words that are in words disguised: by leetspeak, by spaces or by repetition."""
    leet = {"o": "0", "i": "1", "e": "3", "a": "4", "s": "5", "t": "7"}

    def one(word):
        if len(word) < 4 or word.lower().strip(".,!?") not in words:
            return word
        way = pick.randrange(3)
        return " ".join(word) if way == 1 else "".join(leet.get(c, c) for c in word) if way == 0 and set(word) & set(leet) else word[0] + 4 * word[1] + word[2:]

    return " ".join(map(one, text.split(" ")))


def test_planted_disguises_in_held_out_rows(spark, learned):
    """Held-out rows whose telling words are disguised score as they did in the clear; without the channel they tell hardly more than chance."""
    docs, labels, scorer = learned
    rows = docs.join(labels.select("doc_id", "toxic"), "doc_id").where(toxicity.held_out(F.col("doc_id"))).select("text", "toxic").collect()
    pick = random.Random(1)
    planted = [(disguised(r.text or "", scorer.lexicon, pick), r.toxic) for r in rows]

    class Plain(toxicity.Scorer):
        def token_words(self, token):
            return toxicity.WORD.findall(token.lower())

        def spaced_words(self, text):
            return []

    def auc(scored):
        bad, fine = ([v for v, t in scored if t == x] for x in (1, 0))
        return np.mean([[(b > f) + 0.5 * (b == f) for f in fine] for b in bad])

    plain = Plain(scorer.model, scorer.lexicon, scorer.cut)
    clear, restored, bare = (auc([(s.score(t), x) for t, x in texts]) for s, texts in ((scorer, rows), (scorer, planted), (plain, planted)))
    assert clear > 0.95 and abs(restored - clear) < 0.02 and bare < 0.7


def score_by_brute_force(scorer, words):
    """The score from a text's words alone, each by the best of its lexicon entries."""
    shares = {w: max([scorer.lexicon.get(w, 0.0)] + [scorer.lexicon.get(w[:n] + "~", 0.0) for n in toxicity.STEMS if len(w) > n]) for w in words}
    clean = 1.0
    for i, s in enumerate(sorted(shares.values(), reverse=True)):
        clean *= 1.0 - s**toxicity.POWER * toxicity.FADING**i
    raw = 1.0 - clean
    return 0.5 * raw / scorer.cut if raw < scorer.cut else 0.5 + 0.5 * (raw - scorer.cut) / (1 - scorer.cut)


def test_scores_against_brute_force(learned):
    docs, _, scorer = learned
    for r in docs.where("doc_id % 40 = 0").select("text").collect():
        assert scorer.score(r.text) == pytest.approx(score_by_brute_force(scorer, scorer.words(r.text)), abs=1e-9)


def test_what_the_channel_adds(learned):
    """Words in disguise that score as they do in the clear, with and without decoding."""
    scorer = learned[2]
    plain = type("Plain", (toxicity.Scorer,), {"token_words": lambda self, token: toxicity.WORD.findall(token.lower()), "spaced_words": lambda self, text: []})(scorer.model, scorer.lexicon, scorer.cut)
    words = ["loser", "idiot", "stupid", "moron", "trash"]
    disguise = [lambda w: w.translate(str.maketrans("oiesa", "0!3$@")), lambda w: " ".join(w), lambda w: w[0] + w[1] * 4 + w[2:], lambda w: ".".join(w)]
    caught = lambda s: np.mean([s.score(f"Of the {d(w)} and.") >= 0.5 for w in words for d in disguise])
    assert caught(scorer) > 0.85 and caught(plain) < 0.3


def test_disguises_at_either_end(learned):
    scorer = learned[2]
    for token, restored in (("a$$", "ass"), ("merd3", "merde"), ("put0", "puto"), ("idio7", "idiot"), ("pendej0.", "pendejo"), ("!diot", "idiot")):
        assert restored in scorer.words(token), token
    for token in ("idio7", "l0ser$", "!diot", "(!diot)", "$cum", "tra$h."):
        assert scorer.score(f"Of the {token} and.") >= 0.5, token
    pick = random.Random(4)
    for _ in range(20_000):
        token = "".join(pick.choices("abcABé01$!(@*._-,\"", k=pick.randint(1, 6)))
        assert not toxicity.DISGUISED.search(token) or toxicity.HINT.search(token), token


def test_letters_set_apart(learned):
    scorer = learned[2]
    for text in ("foo\ni d i o t bar", '"i d i o t"', "(i d i o t)", "i d i o t", "a s t u p i d", "you a r e a s t u p i d now", "i d i o t a s", "y o u s c u m b u t"):
        assert scorer.score(text) >= 0.5, text
    assert scorer.score("c l a s s of 1 2 3 4 5 and a b c d e") < 0.5


def test_long_spans(learned):
    scorer = learned[2]
    for text in (f"st{'u' * 40}pid", "y o u a r e a s t u p i d i d i o t l o s e r", "w h a t e v e r y o u s a y i t i s t r a s h", "you_know-youareallaverystup1dcrowd"):
        assert scorer.score(text) >= 0.5, text
    assert scorer.score("3f2a9c" * 8) < 0.5 and scorer.score("ab1" * 10_000) < 0.5


def test_held_out_rows(spark):
    df = spark.createDataFrame([(i,) for i in range(50)] + [(None,)], "doc_id long")
    got = {r.doc_id: r.h for r in df.select("doc_id", toxicity.held_out(F.col("doc_id")).alias("h")).collect()}
    assert got == {i: zlib.crc32(str(i).encode()) % 5 == 0 for i in range(50)} | {None: True}


def test_toxicity_without_labels_and_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1.0), (1, None, 1.0), (2, "", 1.0), (None, "loser", 1.0)], "doc_id long, text string, score double")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert [(r.score, r.predicted) for r in toxicity.judge(df, none).collect()] == [(0.0, 0)] * 4
    assert toxicity.judge(df.limit(0), none).count() == 0


def test_cut_between_the_classes():
    assert toxicity.best_cut([(0.1, 0), (0.2, 0), (0.8, 1), (0.9, 1)]) == pytest.approx(0.5)
    assert toxicity.best_cut([(0.1, 0)]) == 0.5 and toxicity.best_cut([]) == 0.5


# --- the pipeline


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    assert [f.__name__ for _, f in corpus_pipeline.STAGES] == ["drop_toxic", "drop_poor", "drop_repeated_lines", "drop_near_copies", "pack"]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, MIDDLE)
        assert out.columns == docs.columns
        before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r.text for r in out.collect()}
        if k == 0:
            labels = spark.read.parquet(f"{MIDDLE}/labels.parquet")
            scores = {r.doc_id: r.predicted for r in toxicity.judge(docs, labels).collect()}
            assert after == {d: t for d, t in before.items() if not scores[d]}
        if k == 1:
            assert set(after) == {r.doc_id for r in quality_rules.judge(docs).where("kept").collect()}
        if k == 2:
            assert after == {r.doc_id: r.text for r in line_dedup.dedup_lines(docs).collect()} and set(after) == set(before)
        if k == 3:
            prints = {d: simhash_dedup.fingerprint_of(t, 3, 42) for d, t in before.items()}
            kept = list(after)
            assert all((prints[a] ^ prints[b]).bit_count() > 3 for i, a in enumerate(kept) for b in kept[:i])
            assert {r.doc_id for r in simhash_dedup.near_duplicates(docs).where("doc_id = component_id").collect()} == set(after)
        out.write.parquet(str(tmp_path / f"stage{k}"))
        docs = spark.read.parquet(str(tmp_path / f"stage{k}"))
    whole = corpus_pipeline.run(spark, MIDDLE)
    last = corpus_pipeline.STAGES[-1][1](spark, docs, MIDDLE)
    key = lambda df: sorted((r.doc_id, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(whole) == key(last) and {r[0] for r in key(whole)} == {r.doc_id for r in docs.collect()}


def test_rows_without_a_key_are_judged(spark):
    good, other, third = (" ".join(f"{w}{i}" for i in range(60)) for w in ("word", "term", "name"))
    docs = [(1, good, "en", "s"), (None, good, "en", "s"), (None, other, "en", "s"), (None, other, "en", "s"), (None, third, "en", "s"), (None, "", "en", "s"), (2, None, "en", "s")]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string")
    texts = lambda out: sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    assert texts(simhash_dedup.keep_first(df)) == sorted([(1, good), (None, other), (None, third), (2, None)], key=str)
    assert texts(simhash_dedup.keep_first(df.where("doc_id IS NULL"))) == sorted([(None, t) for t in (good, other, third, "")], key=str)
    poor = df.union(spark.createDataFrame([(1, "too short", "en", "s")], df.schema))
    assert texts(quality_rules.keep_good(poor)) == sorted([(1, good), (None, good), (None, other), (None, other), (None, third)], key=str)


def test_stages_keep_clashing_columns(spark):
    names = ["score", "predicted", "n_removed_lines", "n_words", "kept", "node", "print", "component_id", "fingerprint", "hash", "group", "label", "removed", "mark"]
    sources = "".join(p.read_text() for p in pathlib.Path(toxicity.__file__).parent.glob("*.py"))
    names += sorted({n for n in re.findall(r"[\"'. (](_[a-z][a-z_0-9]*)\b", sources)})  # every internal name of the sources
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.limit(60).collect()
    odd = [(None, "a b c", None, None, None), (10**9, None, "en", None, 0), (10**9 + 1, "", None, "s", None)]
    schema = docs.schema
    wide = spark.createDataFrame([tuple(r) for r in rows] + odd, schema).select("*", *(F.lit(f"own {n}").alias(n) for n in names))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, wide, SMALL)
        assert out.columns == wide.columns
        assert all(r[n] == f"own {n}" for r in out.collect() for n in names)
        assert stage(spark, wide.limit(0), SMALL).count() == 0
    pieces = corpus_pipeline.STAGES[-1][1](spark, wide, SMALL).collect()
    assert {r.doc_id for r in pieces} == {r[0] for r in rows} | {None, 10**9, 10**9 + 1}


def test_held_out_labels_of_urls(spark):
    """Labels hidden from the tree, one in five, are told by it from the others."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    host, path = url_filter.host_and_path(F.col("url"))
    known = pages.select("page_id", host.alias("host"), path.alias("path"))
    _, verdict = url_filter.match_rules(F.col("host"), F.col("path"), url_filter.RULES)
    segments = F.transform(F.filter(F.split("path", "/"), lambda s: s != ""), lambda s: F.regexp_replace(s, "[0-9]+", "{n}"))
    known = known.withColumns({"truth": verdict, "segments": segments, "hidden": F.pmod(F.xxhash64("page_id"), F.lit(5)) == 0})
    seen = [F.count_if((F.col("truth") == v) & ~F.col("hidden")).alias(c) for v, c in (("block", "blocked"), ("allow", "allowed"))]
    told = url_filter.templates(known.groupBy("host", "segments").agg(*seen, F.count("*").alias("urls")))
    hidden = known.where("hidden and truth is not null").join(told, ["host", "segments"]).select("host", "truth", F.col("template_verdict").alias("said")).collect()
    bad = sum(r.truth == "block" for r in hidden)
    right = sum(r.truth == r.said == "block" for r in hidden)
    wrong = sum(r.truth == "allow" and r.said == "block" for r in hidden)
    print(f"hidden {len(hidden)}, blocked {bad}, found {right}, wrongly blocked {wrong}")
    by_host = Counter((r.host.rsplit(".", 1)[-1], r.truth, r.said) for r in hidden)
    print(sorted(by_host.items()))
    assert bad > 30 and len(hidden) - bad > 30 and right >= 0.9 * bad and wrong <= 0.02 * (len(hidden) - bad)


def test_urls_without_rows_and_very_long(spark):
    pages = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(pages).count() == 0
    urls = ["http://a.net/" + "x" * 200_000, "http://a.net/" + "y/" * 300 + "z?q", "http://" + "h" * 100_000, "http://b.net/es/" + "1" * 50_000]
    got = judged(spark, urls)
    assert got[0].path == "/" + "x" * 200_000 and got[1].path == "/" + "y/" * 300 + "z" and len(got[2].host) == 100_000 and got[3].verdict == "block"
