"""Texts that hold a term, by postings of short runs of letters: candidates share the rarest run of a term, and only they are looked at.

A run (gram) has three letters, or fewer for terms of one or two letters, so every term that isn't empty has a gram, and all texts that hold it have that
gram. Case never counts. Joins are on grams and keys; none compares each text with each term.
"""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions.text import either

#: Letters of a gram.
LENGTH = 3


def grams(text: Column, length: int = LENGTH) -> Column:
    """The distinct runs of so many letters of a text in lower case; none for a null or shorter one."""
    low = F.lower(F.coalesce(text, F.lit("")))
    count = F.length(low) - (length - 1)
    at = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(at, lambda i: F.substr(low, i, F.lit(length))))


def term_grams(term: Column) -> Column:
    """The grams of a term that all texts that hold it have."""
    short = F.length(term)
    return F.when(short >= LENGTH, grams(term)).when(short == 2, grams(term, 2)).when(short == 1, grams(term, 1)).otherwise(F.array().cast("array<string>"))


def postings(texts: DataFrame, key: str, *columns: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """(key, those of keep, gram): the grams of one, two and three letters of each row's texts; to be kept as a table, sorted by gram."""
    every = [grams(F.col(c).cast("string"), n) for c in columns for n in (1, 2, LENGTH)]
    return texts.select(key, *keep, F.explode(F.array_distinct(F.concat(*every))).alias("gram"))


#: Ends every stored text, so that its last letters begin a gram of three letters too: terms of one or two letters are looked up as beginnings of grams.
END = "\0" * (LENGTH - 1)

#: Keys in a part of a stored index, about; a task sorts one part at a time.
PART_KEYS = 100_000


def stored_postings(texts: DataFrame, key: str, text: str, parts: int) -> DataFrame:
    """(key, gram): a stored index of texts, any number a key, in so many parts; only grams of three letters, those of END among them.

    Texts are dealt by key before they are cut, and each part is sorted by itself, so postings are never shuffled. A search reads few pages of each part,
    and finds all postings of a key in one.
    """
    low = texts.where(F.length(text) > 0).select(key, F.concat(F.lower(text), F.lit(END)).alias("low")).repartition(parts, key)  # lowered once a text, not once a gram
    cut = F.transform(F.sequence(F.lit(1), F.length("low") - (LENGTH - 1)), lambda i: F.substr("low", i, F.lit(LENGTH)))
    return low.select(key, F.explode(F.array_distinct(cut)).alias("gram")).sortWithinPartitions("gram")


#: Grams whose presence one number tells, and those that a scan takes as single values: a longer isin() reaches it as one wide range.
BITS, PUSHED = 62, 10


def candidates(index: DataFrame, key: str, keyword: str) -> DataFrame:
    """(key): rows that have all grams of a keyword, which those that hold it are among. index is of postings() or stored_postings(), stored; its scan takes the grams as a filter."""
    low = keyword.lower()
    if len(low) < LENGTH:
        return index.where(F.startswith("gram", F.lit(low))).select(key).distinct()
    wanted = sorted({low[i : i + LENGTH] for i in range(len(low) - LENGTH + 1)})
    held = index.where(either([F.col("gram").isin(wanted[n : n + PUSHED]) for n in range(0, len(wanted), PUSHED)]))
    sets = {f"s{n}": wanted[n : n + BITS] for n in range(0, len(wanted), BITS)}
    place = lambda some: F.array_position(F.array(*map(F.lit, some)), F.col("gram"))  # noqa: E731  from 1; 0 for none
    bit = lambda some: F.when(F.col("gram").isin(some), F.call_function("shiftleft", F.lit(1).cast("long"), (place(some) - 1).cast("int"))).otherwise(F.lit(0).cast("long"))
    found = held.groupBy(key).agg(*(F.bit_or(bit(some)).alias(name) for name, some in sets.items()))
    return found.where(reduce(and_, (F.col(name) == (1 << len(some)) - 1 for name, some in sets.items()))).select(key)


#: Distinct terms up to which they are broadcast, and texts stay where they are.
FEW_TERMS = 10_000


def holding(texts: DataFrame, terms: DataFrame, key: str = "key", text: str = "text", term: str = "term", few: int = FEW_TERMS) -> DataFrame:
    """(term, key) for each distinct term and each key of whose texts one holds it, in any case. Null and empty terms are held by none.

    Up to few terms are counted and broadcast; more of them meet the postings in shuffles. Texts and postings are never broadcast: explode() hides their
    size from Spark's estimates.
    """
    asked = terms.select(F.lower(F.col(term)).alias("low"), F.col(term).alias("term")).where(F.length("low") > 0).distinct()
    shared = asked.count() <= few
    side = F.broadcast if shared else lambda df: df.hint("merge")
    of_terms = asked.select("low").distinct().select("low", F.explode(term_grams(F.col("low"))).alias("gram"))
    rows = texts.select(F.col(key).alias("key"), F.lower(F.col(text)).alias("held")).where(F.col("held").isNotNull()).repartition("key")  # grams take more work than a small file's few tasks
    known = postings(rows, "key", "held").join(side(of_terms.select("gram").distinct()), "gram", "left_semi")
    counts = known.groupBy("gram").agg(F.count("*").alias("n"))
    order = Window.partitionBy("low").orderBy("n", "gram")
    rarest = of_terms.join(side(counts), "gram", "left").withColumn("n", F.coalesce("n", F.lit(0))).withColumn("rank", F.row_number().over(order)).where("rank = 1")
    near = side(rarest.where("n > 0").select("low", "gram"))
    if shared:
        found = postings(rows, "key", "held", keep=("held",)).join(near, "gram")
    else:
        found = known.join(near, "gram").select("low", "key").distinct().join(rows.hint("merge"), "key")
    found = found.where(F.contains("held", F.col("low"))).select("low", "key").distinct()
    return found.join(side(asked), "low").select("term", F.col("key").alias(key))
