"""Toxicity of texts that may be disguised: a noisy channel restores words, then learned words and stems score them.

Disguised words are found by their signs: digits and signs among letters, letters set apart, letters repeated. A lattice holds what each sign may stand
for, and Viterbi decoding picks the reading that a character trigram model likes best. The model is counted over all documents; the words that
speak for a toxic text are learned from labelled rows, and a text's score is the chance that at least one of its words is right, the strongest first.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.llm.bpe_tables import BoundedCache
from loomstead.llm.common import broadcast_if_small, fresh, materialise, small_batches

#: Characters of the model: 0 for all that is no letter, a-z, the lower-case letters of Latin-1, and one for other letters.
LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(chr(c) for c in range(0xDF, 0x100) if c != 0xF7)
SIZE = len(LETTERS) + 2
OTHER = SIZE - 1

#: What a sign may stand for. Fixed values.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c", "&": "a", "*": "aeiou",
}

#: Costs, as natural logarithms: reading a sign as a letter and dropping a sign; keeping a letter that stands a third time or more in all, and dropping
#: it; keeping and dropping the second of a double letter; leaving out the space between two words.
AS_LETTER, DROP_SIGN, KEEP_REPEAT, DROP_REPEAT, KEEP_DOUBLE, DROP_DOUBLE, HIDE_BOUND = 0.5, 12.0, 2.5, 0.1, 0.0, 6.0, 8.0

#: Words with signs inside, letters set apart by single signs, and words with a letter three times in a row.
SIGNS = r"0-9@$!|+€£(&*"
DISGUISED = re.compile(
    rf"(?<![^\W_])(?:[^\W\d_]+[{SIGNS}]+|[{SIGNS}]+[^\W\d_])(?:[{SIGNS}]|[^\W\d_])*(?<![!|+(&*])"
    r"|(?<![^\W_])[^\W_](?:[ .*_\-][^\W_]){2,}(?![^\W_])"
    r"|[^\W\d_]*([^\W\d_])\1\1[^\W\d_]*"
)
APART = re.compile(r"[ .*_\-]")
SET_APART = re.compile(r"[^\W_](?:[ .*_\-][^\W_])+")
WORD = re.compile(r"[^\W\d_]+")
STRETCHED = re.compile(r"([^\W\d_])\1{3,}")

#: What each token holds in which DISGUISED finds something; single letters with spaces between them, and what each text with such letters holds.
HINT = re.compile(rf"[{SIGNS}][^\W\d_]|[^\W\d_][{SIGNS}]|[^\W_][.*_\-][^\W_]|([^\W\d_])\1\1")
MARKS = ".,;:!?\"'()"

#: Signs before a word that may be marks as well as letters; it's read with and without them.
OPENING = "(*&|+"
SPACED = re.compile(r"(?<![^\W_])[^\W_](?: [^\W_]){2,}(?![^\W_])")
SPACED_HINT = re.compile(r" [^\W_] [^\W_](?![^\W_])")

#: Tokens that a generation of a worker's caches holds; what they say is worked out fast.
CACHED = 100_000

#: Lengths of the stems that count beside whole words.
STEMS = (4, 5, 6)

#: Characters that are counted at once.
COUNTED = 1_000_000

#: Labelled rows that the words are learned from, at most; beyond it a part of them picked by hash, about so many.
TRAIN_ROWS = 100_000

#: Standard errors that a word's share of toxic texts is lowered by, and the lowered share that it needs; so a word is in four labelled texts at least.
CAUTION, LEAST_SHARE = 3.0, 0.3

#: What each word counts beside the next stronger one of a text, and the power that sets strong words apart from middling ones.
FADING, POWER = 0.7, 3

#: One in so many of the rows to learn from, picked by hash, sets where the scores are cut and no words.
CUT_PART = 5


def _code_table() -> np.ndarray:
    table = np.zeros(0x250, np.int64)
    for c in range(len(table)):
        small = chr(c).lower()
        table[c] = LETTERS.index(small) + 1 if small in LETTERS and small else (OTHER if chr(c).isalpha() else 0)
    return table


CODES = _code_table()


def letter_codes(text: str) -> np.ndarray:
    """The model's character for each of a text; letters beyond Latin are the one for other letters."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < len(CODES), CODES[np.minimum(points, len(CODES) - 1)], OTHER)


def cells_of(texts: list[str]) -> np.ndarray:
    """How often each run of three characters occurs in texts that begin with two characters that are no letters."""
    c = letter_codes("".join(texts) + "\n\n")
    return np.bincount((c[:-2] * SIZE + c[1:-1]) * SIZE + c[2:], minlength=SIZE**3)


def trigram_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """(cell, n): how often each run of three characters occurs in all texts; SIZE ** 3 rows at most. Texts are bounded by two characters that are no letters."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, pending, size = np.zeros(SIZE**3, np.int64), [], 0
        for batch in batches:
            for value in batch.column(0).to_pylist():
                pending.append(f"\n\n{value or ''}")
                size += len(pending[-1])
                if size >= COUNTED:
                    total += cells_of(pending)
                    pending, size = [], 0
        total += cells_of(pending)
        cells = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(total[cells])], ["cell", "n"])

    return docs.select(text).mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n"))


def language_model(counts: np.ndarray) -> np.ndarray:
    """Log probabilities of a character after two others, from trigram counts; each order is smoothed by the one below."""
    three = counts.reshape(SIZE, SIZE, SIZE).astype(float)
    two, one = three.sum(axis=0), three.sum(axis=(0, 1))
    p1 = (one + 1) / (one.sum() + SIZE)
    p2 = (two + 5 * p1) / (two.sum(axis=1, keepdims=True) + 5)
    return np.log((three + 5 * p2) / (three.sum(axis=2, keepdims=True) + 5)).astype(np.float32)


def signs_of(span: str) -> str:
    """The signs of a disguised span in lower case, without what sets them apart; a letter stands three times in a row at most."""
    return STRETCHED.sub(r"\1\1\1", APART.sub("", span.lower()) if SET_APART.fullmatch(span) else span.lower())


class Scorer:
    """Restores and scores texts; shared by broadcast, so that a worker keeps its caches."""

    def __init__(self, model: np.ndarray, lexicon: dict[str, float] | None = None, cut: float = 0.5):
        self.model, self.lexicon, self.cut = model, lexicon or {}, cut
        self._start()

    def _start(self) -> None:
        self.decoded, self.told = BoundedCache(self.decode, CACHED), BoundedCache(self.span_words, CACHED)
        self.strong = BoundedCache(self.strong_words, CACHED)
        self.longest = max(map(len, self.lexicon), default=0)
        self.heads = {f.rstrip("~")[: min(STEMS)] for f in self.lexicon}  # a word with another beginning says nothing

    def __getstate__(self):
        return {"model": self.model, "lexicon": self.lexicon, "cut": self.cut}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._start()

    def decode(self, span: str) -> str:
        """The likeliest reading of a disguised span: one word, or several where these are likelier though no bounds between them show."""
        return self.read(signs_of(span), True, HIDE_BOUND)

    def span_words(self, span: str) -> list[str]:
        """The words that a disguised span may stand for, in lower case: as one word, and as several where that is likelier or its letters stand apart."""
        signs = signs_of(span)
        whole, several = self.read(signs), self.read(signs, True)
        found = WORD.findall(whole)
        if several != whole or SET_APART.fullmatch(span):
            found += WORD.findall(several)
            found += {part for word in found for part in self.known_parts(word)}
        return found

    def known_parts(self, word: str) -> Iterator[str]:
        """What begins within words that may have run together and speaks for a toxic text: a whole word of the lexicon, else the rest for its stem."""
        for i in range(len(word) - min(STEMS) + 1):
            if word[i : i + min(STEMS)] in self.heads:
                rest = word[i : i + self.longest]
                whole = [rest[:j] for j in range(1, len(rest) + 1) if rest[:j] in self.lexicon]
                if whole or self.share(rest):
                    yield max(whole, key=lambda w: (self.lexicon[w], len(w))) if whole else rest

    def read(self, signs: str, several: bool = False, bound: float = 0.0) -> str:
        """The likeliest reading of signs, as one word or with spaces between several; each space costs bound beside what the model says."""
        # states are the last two characters; each keeps its best cost and its letters, the last one first
        states: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for i, sign in enumerate(signs):
            options = [(letter, AS_LETTER) for letter in LEET.get(sign, "")] + [("", DROP_SIGN)] if sign in LEET else [(sign, 0.0)]
            if sign not in LEET and signs[i - 1 : i] == sign:
                run = signs[max(0, i - 2) : i + 2].count(sign) > 2  # it stands three times or more
                options = [(sign, KEEP_REPEAT if run else KEEP_DOUBLE), ("", DROP_REPEAT if run else DROP_DOUBLE)]
            if several:
                for (a, b), (cost, letters) in list(states.items()):
                    state, now = (b, 0), cost + bound - float(self.model[a, b, 0])
                    if b and (state not in states or now < states[state][0]):
                        states[state] = (now, (" ", letters))
            after: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (cost, letters) in states.items():
                for letter, extra in options:
                    if letter:
                        c = LETTERS.find(letter) + 1 or (OTHER if letter.isalpha() else 0)
                        state, now = (b, c), cost + extra - float(self.model[a, b, c])
                    else:
                        state, now = (a, b), cost + extra
                    if state not in after or now < after[state][0]:
                        after[state] = (now, (letter, letters))
            states = after
        best = min(((cost - float(self.model[a, b, 0]), letters) for (a, b), (cost, letters) in states.items()), key=lambda r: r[0])[1]
        reading = []
        while best:
            letter, best = best
            reading.append(letter)
        return "".join(reversed(reading))

    def restore(self, text: str) -> str:
        return DISGUISED.sub(lambda m: self.decoded[m[0]], text)

    def token_words(self, token: str) -> list[str]:
        """The words of a token without white space, as they stand and as restored, in lower case."""
        low = token.strip(MARKS).lower()
        found = [low] if low.isalpha() else WORD.findall(low)
        if HINT.search(token):
            for m in DISGUISED.finditer(token):
                found += self.told[m[0]]
                bare = m[0].lstrip(OPENING)
                if bare != m[0] and HINT.search(bare):
                    found += self.told[bare]
        return found

    def spaced_words(self, text: str) -> list[str]:
        """The words whose letters stand apart in a text."""
        return [w for m in SPACED.finditer(text) for w in self.told[m[0]]] if SPACED_HINT.search(text) else []

    def words(self, text: str | None) -> set[str]:
        """The words of a text as they stand and as restored, in lower case."""
        if not text:
            return set()
        return {w for token in set(text.split()) for w in self.token_words(token)} | set(self.spaced_words(text))

    def share(self, word: str) -> float:
        return max(self.lexicon.get(f, 0.0) for f in features([word])) if word[: min(STEMS)] in self.heads else 0.0

    def strong_words(self, token: str) -> tuple[tuple[str, float], ...]:
        """The words of a token that speak for a toxic text, with their shares."""
        return tuple([(w, s) for w in self.token_words(token) if (s := self.share(w))])

    def raw(self, text: str | None) -> float:
        """The chance that one of the words is right, taken as independent, with shares to a power that count less from word to word; 0 for a text without any."""
        if not text:
            return 0.0
        found = {w: s for pairs in filter(None, map(self.strong.__getitem__, set(text.split()))) for w, s in pairs}
        found |= {w: s for w in self.spaced_words(text) if (s := self.share(w))}
        return 1.0 - math.prod(1.0 - s**POWER * FADING**i for i, s in enumerate(sorted(found.values(), reverse=True)))

    def score(self, text: str | None) -> float:
        """That chance, stretched so that the cut becomes 0.5."""
        raw = self.raw(text)
        return 0.5 * raw / self.cut if raw < self.cut else 0.5 + 0.5 * (raw - self.cut) / (1 - self.cut)


def features(words: Iterable[str]) -> set[str]:
    """Words, and their stems with a mark."""
    found = set(words)
    for n in STEMS:
        found.update([w[:n] + "~" for w in words if len(w) > n])
    return found


def best_cut(scored: list[tuple[float, int]]) -> float:
    """The cut of raw scores with the fewest errors, in the middle of its gap, of equal ones the widest; 0.5 where nothing is to be told apart."""
    if len({mark for _, mark in scored}) < 2:
        return 0.5
    ordered = sorted(scored)
    errors, gaps = sum(1 for _, mark in ordered if not mark), []  # errors with all rows called toxic
    for (value, mark), (above, _) in zip(ordered, [*ordered[1:], (1.0, 1)], strict=True):
        errors += 1 if mark else -1
        if above > value:
            gaps.append((errors, value - above, (above + value) / 2))
    return min(max(min(gaps)[2], 0.05), 0.99) if gaps else 0.5


def lowered_share(toxic: Column, clean: Column) -> Column:
    """The lower end of Wilson's interval for the share of toxic texts."""
    n, z2 = (toxic + clean).cast("double"), CAUTION * CAUTION
    p = toxic / n
    return (p + z2 / (2 * n) - CAUTION * F.sqrt(p * (1 - p) / n + z2 / (4 * n * n))) / (1 + z2 / n)


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: CRC-32 of the key as text, modulo 5, is 0. A null key is held out."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic") -> Scorer:
    """Counts the character model over all docs, and learns words from the labelled rows that are not held out.

    Of a key's labels the largest counts. Up to TRAIN_ROWS labelled rows are used, so they are few enough to broadcast. What reaches the driver is the
    character model, of a fixed size, and the lexicon: words and stems that are in four or more of these rows, most of them toxic.
    """
    spark = docs.sparkSession
    small_batches(spark)
    counts = np.zeros(SIZE**3, np.int64)
    for row in trigram_counts(docs, text).collect():
        counts[row.cell] = row.n
    scorer = spark.sparkContext.broadcast(Scorer(language_model(counts)))

    known = labels.where(~held_out(F.col(key)) & F.col(label).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.max(label).alias("_label"))
    known = materialise(known)
    every = max(1, math.ceil(known.count() / TRAIN_ROWS))
    chosen = known.where(F.pmod(F.xxhash64(F.lit("train"), "_key"), F.lit(every)) == 0)
    chosen = broadcast_if_small(chosen.withColumn("_cuts", F.pmod(F.xxhash64(F.lit("cut"), "_key"), F.lit(CUT_PART)) == 0))
    train = docs.select(key, text).join(chosen, F.col(key) == F.col("_key")).select(text, F.col("_label").cast("int").alias("mark"), "_cuts")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: tuple[Counter, Counter] = (Counter(), Counter())

        def out() -> pa.RecordBatch:
            names = list(seen[0].keys() | seen[1].keys())
            batch = pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([seen[k][f] for f in names], pa.int64()) for k in (1, 0))], ["feature", "toxic", "clean"])
            seen[0].clear(), seen[1].clear()
            return batch

        for batch in batches:
            for value, mark in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                seen[int(mark == 1)].update(features(scorer.value.words(value)))
                if len(seen[0]) + len(seen[1]) > 500_000:
                    yield out()
        yield out()

    counted = train.where("not _cuts").select(text, "mark").mapInArrow(count, "feature string, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    strong = counted.where("toxic > 0").select("feature", lowered_share(F.col("toxic"), F.col("clean")).alias("share")).where(F.col("share") >= LEAST_SHARE)
    lexicon = {r.feature: r.share for r in strong.collect()}
    uncut = spark.sparkContext.broadcast(Scorer(scorer.value.model, lexicon))

    def raw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([uncut.value.raw(t) for t in batch.column(0).to_pylist()], pa.float64()), batch.column(1)], ["raw", "mark"])

    told = train.where("_cuts").select(text, "mark").mapInArrow(raw, "raw double, mark int")
    counts_at = told.groupBy(F.round("raw", 3).alias("raw"), (F.col("mark") == 1).cast("int").alias("mark")).count().collect()  # 2,002 rows at most
    return Scorer(scorer.value.model, lexicon, best_cut([(r["raw"], r["mark"]) for r in counts_at for _ in range(r["count"])]))


def score_of(docs: DataFrame, scorer: Scorer, text: str = "text") -> Column:
    """The score (double, 0 to 1) of each text of docs; null and empty texts score 0."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(scorer)

    @F.arrow_udf("double")
    def of_text(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for part in parts:
            yield pa.array([shared.value.score(t) for t in part.to_pylist()], pa.float64())

    return of_text(docs[text])


def score(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """Adds score (double) and predicted (int, 1 from 0.5 on) to docs, in place of columns of these names. Only the text is looked at."""
    scored = docs.withColumn("score", score_of(docs, scorer, text))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, scorer: Scorer, text: str = "text") -> DataFrame:
    """docs without the rows that score 0.5 or more; all columns stay as they are, whatever their names. Nulls, copies and texts are as in judge()."""
    name = fresh(docs, "_score")
    return docs.withColumn(name, score_of(docs, scorer, text)).where(F.col(name) < 0.5).drop(name)


def judge(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, held_out, score, predicted) for each row of docs, copies too. Without labels, nothing is learned and all scores are 0.

    Null and empty texts score 0, very long ones are read in full, and equal texts score alike; of readings that cost the same, the first found counts.
    Rows without a key are held out. An empty table gives an empty one; other columns are not looked at.
    """
    scored = score(docs.select(key, text), learn(docs, labels, key, text), text)
    return scored.select(key, held_out(F.col(key)).alias("held_out"), "score", "predicted")
