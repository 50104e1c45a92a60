"""Line deduplication by content-defined chunks of lines.

Lines with words are hashed, and a rolling hash over the hashes of two neighbours chooses where chunks may be cut: a line is a boundary if its rolling
hash is the least of the `spacing` lines from it on, so every 2 * spacing - 1 lines hold one, and it follows the content and not its place. A chunk
begins at a boundary and ends before the first boundary by which it has two lines and LEAST_WORDS words; another ends there and reaches back likewise.
A line of LONG_LINE words is a passage by itself and a chunk too. Chunks that occur earlier anywhere, byte for byte, are removed.

With a spacing over one, a passage loses its edges to chance, and one of few words is missed as a whole (README has figures). So the spacing is one
unless a caller asks otherwise: each line is a boundary then, and any repeated passage of two or more lines and LEAST_WORDS words goes up to its edges.

All of it is built-in expressions. Nothing is broadcast: hashes are counted with partial aggregates, rows of a few dozen bytes meet by hash, where AQE
splits a chunk that many texts share, and texts are shuffled once to meet their chunks.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.llm.common import SPACES, fresh, materialise, written

#: Words that a chunk of several lines needs: below it are headers, licenses and other short blocks that documents rightly share.
LEAST_WORDS = 20

#: A line of this many words is a chunk by itself.
LONG_LINE = 50

#: Lines between boundaries, about; one makes each line a boundary.
SPACING = 1

def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def chunks(lines: Column, spacing: int = SPACING) -> Column:
    """Structs (at, n, hash): the chunks of an array of lines, as n lines from the one at on, counted without those that hold no word."""

    def of_filled(f: Column) -> Column:
        if spacing == 1:
            cut = lambda i: F.lit(True)
        else:
            rolling = lambda x, i: F.xxhash64(x["h"], F.get(f, i + 1)["h"])
            least = lambda i: F.array_min(F.transform(F.slice(f, i + 2, spacing - 1), lambda x, k: rolling(x, i + k + 1)))
            cut = lambda i: (i == 0) | F.coalesce(rolling(F.get(f, i), i) <= least(i), F.lit(True))
        return _let(F.transform(f, lambda x, i: F.struct(x["h"].alias("h"), x["w"].alias("w"), cut(i).alias("cut"))), of_cuts)

    def of_cuts(c: Column) -> Column:
        last = F.size(c) - 1
        marked = F.transform(c, lambda x, i: F.struct(x["h"].alias("h"), x["w"].alias("w"), x["cut"].alias("begins"), ((i == last) | F.get(c, i + 1)["cut"]).alias("ends")))
        return _let(marked if spacing > 1 else c, of_marks)

    def of_marks(m: Column) -> Column:
        far = max(LEAST_WORDS, 2) + 2 * (spacing - 1)  # lines have a word each, and so many more hold a boundary

        def reach(part: Column, bound: str) -> Column:
            """The lines of part, from its first on, that make a chunk; null if they don't."""

            def step(a: Column, x: Column) -> Column:
                words, n = a["w"] + x["w"], a["n"] + 1
                done = (words >= LEAST_WORDS) & (n >= 2) & (F.lit(True) if spacing == 1 else x[bound])
                return F.when(a["done"], a).otherwise(F.struct(words.alias("w"), n.alias("n"), done.alias("done")))

            start = F.struct(F.lit(0).alias("w"), F.lit(0).alias("n"), F.lit(False).alias("done"))
            return _let(F.aggregate(part, start, step), lambda r: F.when(r["done"], r["n"]))

        def of_line(x: Column, p: Column) -> Column:
            two = lambda q: (spacing == 1) & (x["w"] + F.get(m, q)["w"] >= LEAST_WORDS)
            ahead = F.when(two(p + 1), F.lit(2)).otherwise(reach(F.slice(m, p + 1, far), "ends"))
            back = F.when(two(p - 1), F.lit(2)).otherwise(reach(F.reverse(F.slice(m, F.greatest(p - far + 1, F.lit(0)) + 1, F.least(p + 1, F.lit(far)))), "begins"))
            covered = lambda q: (x["w"] >= LONG_LINE) & (F.get(m, q)["w"] >= LONG_LINE)  # noqa: E731  two long lines, each a chunk by itself
            ahead = F.when(F.coalesce(covered(p + 1), F.lit(False)), None).otherwise(ahead)
            back = F.when(F.coalesce(covered(p - 1), F.lit(False)), None).otherwise(back)
            if spacing > 1:
                ahead, back = F.when(x["begins"], ahead), F.when(x["ends"], back)
            span = lambda at, n: F.when(n.isNotNull(), F.struct(at.alias("at"), n.alias("n")))
            alone = F.when(x["w"] >= LONG_LINE, F.struct(p.alias("at"), F.lit(1).alias("n")))
            return F.array(alone, _let(ahead, lambda n: span(p, n)), _let(back, lambda n: span(p - n + 1, n)))

        found = F.array_distinct(F.array_compact(F.flatten(F.transform(m, of_line))))
        body = lambda s: F.transform(F.slice(m, s["at"] + 1, s["n"]), lambda x: x["h"])
        return F.transform(found, lambda s: F.struct(s["at"].alias("at"), s["n"].alias("n"), F.xxhash64(body(s)).alias("hash")))

    counted = F.transform(lines, lambda s: F.struct(F.xxhash64(s).alias("h"), F.size(F.filter(F.split(s, SPACES), lambda w: w != "")).alias("w")))
    return _let(F.filter(counted, lambda x: x["w"] > 0), of_filled)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _filled(lines: Column) -> Column:
    """The places of the lines that hold a word."""
    return F.array_compact(F.transform(lines, lambda s, i: F.when(s.rlike(r"[^\x20\x09-\x0D]"), i)))


def _text_hash(text: str | Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def repeated_chunks(docs: DataFrame, key: str = "doc_id", text: str = "text", spacing: int = SPACING) -> DataFrame:
    """(_key, _text_hash, spans): for each text with chunks whose hash occurs more than once, structs (at, n, hash, first_key, first_hash, first_at).

    The first of a hash is the first by key, text hash and place. Rows are narrow here: hashes are counted with partial aggregates, and the join back
    to the chunks shuffles by hash, where AQE splits a chunk that many texts share.
    """
    rows = docs.select(F.col(key).alias("_key"), _text_hash(text).alias("_text_hash"), F.explode(chunks(_lines(F.col(text)), spacing)).alias("c"))
    narrow = written(rows.select("_key", "_text_hash", "c.at", "c.n", "c.hash"), "chunks")
    place = F.struct("_key", "_text_hash", "at")
    repeated = narrow.groupBy("hash").agg(F.count("*").alias("copies"), F.min(place).alias("first")).where("copies > 1").select("hash", "first")
    met = narrow.join(repeated, "hash")
    span = F.struct("at", "n", "hash", F.col("first._key").alias("first_key"), F.col("first._text_hash").alias("first_hash"), F.col("first.at").alias("first_at"))
    return written(met.groupBy("_key", "_text_hash").agg(F.collect_set(span).alias("spans")), "spans")


def _with_spans(docs: DataFrame, spans: DataFrame, key: str, text: str, name: str) -> DataFrame:
    """docs with the spans of each row in a column of that name, null for none; written, so that texts are shuffled once."""
    a, b = fresh(docs, "_span_key"), fresh(docs, "_span_hash")
    side = spans.select(F.col("_key").alias(a), F.col("_text_hash").alias(b), F.col("spans").alias(name))
    return written(docs.join(side, docs[key].eqNullSafe(side[a]) & (_text_hash(docs[text]) == side[b]), "left").drop(a, b), "texts")


def unequal_chunks(joined: DataFrame, key: str, text: str, name: str) -> DataFrame | None:
    """(_key, _text_hash, at, n) of the chunks that are not, byte for byte, the first of their hash; None if there are none.

    Bytes are compared once for each distinct content: every hash of a line, and of a chunk as the row of its lines' hashes, must stand for one content
    only. Where one stands for several, the chunks that hold it are compared with their firsts one by one.
    """
    whole = joined.where(F.col(name).isNotNull()).select(F.col(key).alias("_key"), _text_hash(text).alias("_text_hash"), _lines(F.col(text)).alias("all"), F.col(name).alias("spans"))
    own = whole.withColumn("lines", F.filter("all", lambda s: s.rlike(r"[^\x20\x09-\x0D]"))).drop("all")
    held = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["n"] - 1))))
    of_lines = F.transform(held, lambda i: F.struct(F.xxhash64(F.get("lines", i)).alias("hash"), F.get("lines", i).alias("content")))
    hashes = F.transform("lines", lambda line: F.xxhash64(line))
    of_chunks = _let(
        hashes, lambda h: F.transform("spans", lambda s: F.struct(s["hash"].alias("hash"), F.array_join(F.transform(F.slice(h, s["at"] + 1, s["n"]), lambda x: x.cast("string")), " ").alias("content")))
    )
    contents = own.select(F.explode(F.concat(of_lines, of_chunks)).alias("c")).select("c.hash", "c.content").distinct()
    shared = materialise(contents.groupBy("hash").count().where("count > 1").select("hash"))
    if shared.isEmpty():
        return None
    each = own.select("_key", "_text_hash", "lines", F.explode("spans").alias("s"))
    bodies = each.select("_key", "_text_hash", "s.*", F.slice("lines", F.col("s.at") + 1, F.col("s.n")).alias("body"))
    touched = bodies.withColumn("h", F.explode(F.array_append(F.transform("body", lambda line: F.xxhash64(line)), F.col("hash")))).join(shared.select(F.col("hash").alias("h")), "h", "left_semi")
    touched = materialise(touched.drop("h").distinct())
    first = touched.where((F.col("at") == F.col("first_at")) & (F.col("_text_hash") == F.col("first_hash")) & F.col("_key").eqNullSafe(F.col("first_key")))
    first = first.groupBy("hash").agg(F.min("body").alias("first_body"))
    return materialise(touched.join(first, "hash", "left").where(~F.col("body").eqNullSafe(F.col("first_body"))).select("_key", "_text_hash", "at", "n").distinct())


def dedup_lines(docs: DataFrame, key: str = "doc_id", text: str = "text", count: str | None = "n_removed_lines", spacing: int = SPACING) -> DataFrame:
    """docs with text freed of the lines in chunks that occur before, in the order of keys and places, and their number (int) in a column count.

    The first occurrence of a chunk in that order stays, also where it overlaps a later one, as in a run of equal lines. Lines without words don't count
    for chunks, and go where no line beside them stays. Each row stays, with an empty text if all of it occurs before; n_chars follows the text if docs
    has that column. Rows with equal key and text are one document and treated alike. Null keys come first; a null text stays null. An empty table
    gives an empty one. Very long texts are one row as others are, in time and memory that follow their length. Other columns are kept, whatever
    their names; one named as count is replaced, and with None none is added.
    """
    name = fresh(docs, "_spans")
    joined = _with_spans(docs, repeated_chunks(docs, key, text, spacing), key, text, name)
    unequal = unequal_chunks(joined, key, text, name)
    spans = F.col(name)
    if unequal is not None:
        a, b, c = fresh(joined, "_unequal_key"), fresh(joined, "_unequal_hash"), fresh(joined, "_unequal")
        side = unequal.groupBy("_key", "_text_hash").agg(F.collect_set(F.struct("at", "n")).alias(c)).withColumnsRenamed({"_key": a, "_text_hash": b})
        joined = joined.join(side, joined[key].eqNullSafe(side[a]) & (_text_hash(joined[text]) == side[b]), "left").drop(a, b)
        spans = F.filter(spans, lambda s: ~F.coalesce(F.array_contains(F.col(c), F.struct(s["at"].alias("at"), s["n"].alias("n"))), F.lit(False)))
    own = lambda s: (s["first_hash"] == _text_hash(text)) & s["first_key"].eqNullSafe(F.col(key))
    begins = lambda s: F.when(own(s), F.greatest(s["at"], s["first_at"] + s["n"])).otherwise(s["at"])
    later = F.filter(spans, lambda s: ~(own(s) & (s["first_at"] == s["at"])))
    lost = F.array_distinct(F.flatten(F.transform(later, lambda s: F.sequence(begins(s), s["at"] + s["n"] - 1))))

    def left(line: Column) -> Column:
        """The lines that stay: of those with words the ones not lost, each with the lines without words around it."""

        def of_filled(f: Column) -> Column:
            end = lambda j: F.coalesce(F.get(f, j), F.size(line))
            begin = lambda j: F.when(j < 0, F.lit(-1)).otherwise(F.get(f, j))
            gap = lambda j: F.slice(line, begin(j) + 2, end(j + 1) - begin(j) - 1)  # noqa: E731  the lines between two with words
            none = F.array().cast("array<string>")

            def of_kept(kept: Column) -> Column:
                before = lambda j, i: F.when(F.coalesce(F.get(kept, i - 1) == j - 1, F.lit(False)), none).otherwise(gap(j - 1))
                return F.flatten(F.transform(kept, lambda j, i: F.concat(before(j, i), F.array(F.get(line, F.get(f, j))), gap(j))))

            return _let(F.array_except(F.sequence(F.lit(0), F.size(f) - 1), lost), of_kept)

        return _let(_filled(line), of_filled)

    kept = fresh(joined, "_kept")
    out = joined.withColumn(kept, F.when(F.size(lost) > 0, _let(_lines(F.col(text)), left)))
    whole = F.col(kept).isNull()
    if count:
        out = out.withColumn(count, F.when(whole, F.lit(0)).otherwise(F.size(_lines(F.col(text))) - F.size(kept)))
    out = out.withColumn(text, F.when(whole, F.col(text)).otherwise(F.array_join(kept, "\n")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(whole, F.col("n_chars")).otherwise(F.length(text).cast(docs.schema["n_chars"].dataType)))
    names = [*docs.columns, *([count] if count and count not in docs.columns else [])]
    return out.select(*names)
