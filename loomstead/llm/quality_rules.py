"""Quality rules whose thresholds come from the corpus: quantile sketches per language and source, merged upwards, then joined to filter.

All of it is built-in expressions. Counts of each text stay in its row (windows of words are numbered hashes within one array); a sketch for each
language and source is merged to one for each language and one for all. A group's bounds are drawn towards those of its language, and these towards
those of all, by as much as they have few texts to go by: no size of a group switches between rules.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import broadcast_if_small, materialise, words, written

#: Words in a window that counts as repeated.
WINDOW = 8

#: Items that a sketch holds at each level; ranks are off by about 0.1 %, and exact for groups up to this size.
SKETCH_K = 2048

#: Texts that the bounds of the next larger group are worth beside a group's own.
SMOOTHING = 50

#: How many interquartile ranges beyond a quartile a signal may lie.
REACH = 3

#: For each signal, in hundredths: what it may exceed the upper bound by, and fall below the lower one by (None: no lower bound).
SIGNALS = {"word_length": (100, 100), "symbol_share": (10, None), "dup_line_share": (40, None)}

NOT_SPACES = r"[^\x20\x09-\x0D]+"
NOT_SYMBOLS = r"[^#*$%&|<>]+"


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def repeated_words(tokens: Column, window: int = WINDOW) -> Column:
    """How many words lie in windows of so many words that occur twice or more in the array.

    Windows are compared by 64-bit hashes. Only arrays in which one occurs twice sort their windows with their places.
    """

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def places(found: Column) -> Column:
            again = F.transform(found, lambda x, k: F.when((x["h"] == F.get(found, k - 1)["h"]) | (x["h"] == F.get(found, k + 1)["h"]), x["i"]))
            return F.sort_array(F.array_compact(again))

        def words_in(start: Column) -> Column:
            steps = F.transform(start, lambda p, k: F.when(k == 0, F.lit(window)).otherwise(F.least(F.lit(window), p - F.get(start, k - 1))))
            return F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x)

        return _let(_let(pairs, places), words_in)

    def of_hashes(each: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(each) - window)
        hashes = F.transform(at, lambda i: F.xxhash64(*(F.get(each, i + k) for k in range(window))))
        return _let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) < F.size(h), covered(h)).otherwise(F.lit(0).cast("long")))

    short = F.size(tokens) <= window
    return F.when(short, F.lit(0).cast("long")).otherwise(_let(F.transform(tokens, lambda w: F.xxhash64(w)), of_hashes))


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words (long) and base_failed to docs.

    n_lines and n_dup_lines count lines with a word. A null text counts as empty: all counts are 0, and it fails. Columns of these names are replaced.
    """
    whole = F.coalesce(F.col(text), F.lit(""))
    filled = F.filter(F.split(whole, "\n", -1), lambda line: line.rlike(NOT_SPACES))
    counted = docs.withColumn("_words", words(F.col(text))).withColumn("_lines", filled)
    return (
        counted.withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", (F.length(whole) - F.length(F.regexp_replace(whole, NOT_SPACES, ""))).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(whole, NOT_SYMBOLS, "")).cast("long"))
        .withColumn("n_lines", F.size("_lines").cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", repeated_words(F.col("_words")))
        .withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))
        .drop("_words", "_lines")
    )


def signals(measured: DataFrame) -> DataFrame:
    """Adds the signals (long, in hundredths) that have thresholds."""
    share = lambda part, whole: F.expr(f"100 * {part} div greatest({whole}, 1)")
    return (
        measured.withColumn("word_length", share("word_chars", "n_words"))
        .withColumn("symbol_share", share("n_symbols", "n_words"))
        .withColumn("dup_line_share", share("n_dup_lines", "n_lines"))
    )


def thresholds(signalled: DataFrame, lang: str = "lang", source: str = "source") -> DataFrame:
    """For each (lang, source), nulls as groups of their own: low_ and high_ bounds of each signal, over the texts that pass the base rules.

    signalled is read once: sketches of each language and source, a few kilobytes each, are merged for languages and for all.
    """
    passed = signalled.where(~F.col("base_failed"))
    sketches = [F.kll_sketch_agg_bigint(s, F.lit(SKETCH_K)).alias(s) for s in SIGNALS]
    fine = materialise(passed.groupBy(lang, source).agg(F.count("*").alias("n"), *sketches))
    merged = [F.kll_merge_agg_bigint(s, F.lit(SKETCH_K)).alias(s) for s in SIGNALS]

    def bounds(level: DataFrame, prefix: str) -> list[Column]:
        found = []
        for s, (over, under) in SIGNALS.items():
            q1, q3 = (F.kll_sketch_get_quantile_bigint(s, F.lit(p)) for p in (0.25, 0.75))
            found.append((q3 + REACH * (q3 - q1) + over).alias(f"{prefix}high_{s}"))
            if under is not None:
                found.append((q1 - REACH * (q3 - q1) - under).alias(f"{prefix}low_{s}"))
        return found

    names = [f"{side}_{s}" for s, (_, under) in SIGNALS.items() for side in (["high"] if under is None else ["high", "low"])]
    drawn = lambda own, n, wider: (F.col(own) * F.col(n) + SMOOTHING * F.col(wider)) / (F.col(n) + SMOOTHING)
    by_lang = fine.groupBy(F.col(lang).alias("_of")).agg(F.sum("n").alias("_n"), *merged)
    by_lang = by_lang.select("_of", "_n", *bounds(by_lang, "_"))
    all_ = fine.agg(F.count("*").alias("_groups"), *merged).where("_groups > 0")
    all_ = all_.select(*bounds(all_, "__"))  # one row at most
    wide = by_lang.join(F.broadcast(all_), F.lit(True), "left").select("_of", *(drawn(f"_{c}", "_n", f"__{c}").alias(f"_{c}") for c in names))
    own = fine.select(lang, source, "n", *bounds(fine, "")).join(wide, F.col(lang).eqNullSafe(F.col("_of")))
    return own.select(lang, source, *(drawn(c, "n", f"_{c}").alias(c) for c in names))


def judge(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """(key, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept) for each row of docs.

    kept is false for texts that fail the base rules, and for those with a signal outside the thresholds of their language and source. A text whose
    group has none that pass is only held to the base rules. Null languages and sources are groups; copies are judged alike and all stay. A null or empty
    text fails the base rules; a very long one is counted in full, in its own row. An empty table gives an empty one.
    """
    rows = docs.select(docs[key].alias("_key"), *_asked(docs, text, lang, source))
    judged = _judged(materialise(signals(measure(rows, "_text")).drop("_text")))
    return judged.select(F.col("_key").alias(key), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _asked(docs: DataFrame, text: str, lang: str, source: str) -> list[Column]:
    return [docs[c].alias(name) for c, name in ((text, "_text"), (lang, "_lang"), (source, "_source"))]


def _judged(measured: DataFrame) -> DataFrame:
    """measured, a table with the signals of texts, with kept: whether each passes the base rules and the thresholds of its _lang and _source."""
    limits = thresholds(measured, "_lang", "_source").withColumnsRenamed({"_lang": "_of_lang", "_source": "_of_source"})
    limits = broadcast_if_small(materialise(limits))
    within = F.lit(True)
    for s, (_, under) in SIGNALS.items():
        within &= F.coalesce(F.col(s) <= F.col(f"high_{s}"), F.lit(True))
        if under is not None:
            within &= F.coalesce(F.col(s) >= F.col(f"low_{s}"), F.lit(True))
    joined = measured.join(limits, F.col("_lang").eqNullSafe(F.col("_of_lang")) & F.col("_source").eqNullSafe(F.col("_of_source")), "left")
    return joined.withColumn("kept", ~F.col("base_failed") & within)


def keep_good(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """docs without the rows that judge() rejects, each by its own verdict, whatever its key.

    Rows are written once beside their signals, each as one struct, so that columns of any name stay; then only the thresholds, a row for each language
    and source, are joined to them. Nulls, ties, empty and long texts and empty tables are as in judge().
    """
    rows = docs.select(F.struct(*(docs[c] for c in docs.columns)).alias("_row"), *_asked(docs, text, lang, source))
    judged = _judged(written(signals(measure(rows, "_text")).drop("_text"), "signals"))
    return judged.where("kept").select("_row.*")


#: What judge() returns, as DuckDB SQL.
ORACLE = r"""
WITH base AS (
  SELECT doc_id, lang, source, coalesce(text, '') AS t,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
counted AS (
  SELECT *, len(w)::BIGINT AS n_words, len(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines
  FROM base),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i+7], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM counted)),
again AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
repeated AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, range(8) AS r(k) GROUP BY doc_id),
measured AS (
  SELECT c.*, coalesce(r.n, 0)::BIGINT AS n_repeat_words,
    n_words < 20 OR 100 * coalesce(r.n, 0) > 30 * n_words AS base_failed,
    100 * word_chars // greatest(n_words, 1) AS word_length, 100 * n_symbols // greatest(n_words, 1) AS symbol_share,
    100 * n_dup_lines // greatest(n_lines, 1) AS dup_line_share
  FROM counted c LEFT JOIN repeated r USING (doc_id)),
long AS (UNPIVOT (SELECT doc_id, lang, source, word_length, symbol_share, dup_line_share FROM measured WHERE NOT base_failed)
  ON word_length, symbol_share, dup_line_share INTO NAME s VALUE v),
ranked AS (
  SELECT *, cume_dist() OVER (PARTITION BY s, lang, source ORDER BY v) AS c1, cume_dist() OVER (PARTITION BY s, lang ORDER BY v) AS c2,
    cume_dist() OVER (PARTITION BY s ORDER BY v) AS c3 FROM long),
fine AS (SELECT s, lang, source, count(*) AS n, min(v) FILTER (c1 >= 0.25) AS q1, min(v) FILTER (c1 >= 0.75) AS q3 FROM ranked GROUP BY ALL),
by_lang AS (SELECT s, lang, count(*) AS n, min(v) FILTER (c2 >= 0.25) AS q1, min(v) FILTER (c2 >= 0.75) AS q3 FROM ranked GROUP BY ALL),
whole AS (SELECT s, min(v) FILTER (c3 >= 0.25) AS q1, min(v) FILTER (c3 >= 0.75) AS q3 FROM ranked GROUP BY ALL),
margins(s, over) AS (VALUES ('word_length', 100), ('symbol_share', 10), ('dup_line_share', 40)),
drawn AS (
  SELECT s, f.lang, f.source,
    ((f.q3 + 3 * (f.q3 - f.q1) + over) * f.n + 50 * (((b.q3 + 3 * (b.q3 - b.q1) + over) * b.n + 50 * (w.q3 + 3 * (w.q3 - w.q1) + over))::DOUBLE / (b.n + 50))) / (f.n + 50) AS high,
    ((f.q1 - 3 * (f.q3 - f.q1) - over) * f.n + 50 * (((b.q1 - 3 * (b.q3 - b.q1) - over) * b.n + 50 * (w.q1 - 3 * (w.q3 - w.q1) - over))::DOUBLE / (b.n + 50))) / (f.n + 50) AS low
  FROM fine f JOIN by_lang b USING (s) JOIN whole w USING (s) JOIN margins USING (s) WHERE f.lang IS NOT DISTINCT FROM b.lang),
limits AS (
  SELECT lang, source, max(high) FILTER (s = 'word_length') AS high_word, max(low) FILTER (s = 'word_length') AS low_word,
    max(high) FILTER (s = 'symbol_share') AS high_symbol, max(high) FILTER (s = 'dup_line_share') AS high_dup
  FROM drawn GROUP BY ALL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(word_length <= high_word, true) AND coalesce(word_length >= low_word, true)
    AND coalesce(symbol_share <= high_symbol, true) AND coalesce(dup_line_share <= high_dup, true) AS kept
FROM measured m LEFT JOIN limits t ON m.lang IS NOT DISTINCT FROM t.lang AND m.source IS NOT DISTINCT FROM t.source
"""
