"""License scans by template markup: optional and replaceable regions are compiled into token automata, and mandatory wording must match exactly.

Markup is plain wording with two kinds of regions: `[[ ... ]]` may be left out and may hold regions itself, and `{{a b|c}}` stands for one of several
wordings, `{{2-8}}` for any two to eight words. Text and templates are compared as words in lower case (A-Z only), so punctuation and layout never count.
An automaton reads words; its states are made when a text first needs them, and are kept. A template is only tried on texts that hold its longest run of
mandatory words, which every accepted text must hold.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from loomstead.llm.common import small_batches

#: Phrases whose places are counted, by label.
PHRASES = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

GRANT = "{{released|licensed|distributed|available|published|provided}} under"
WARRANTY = "the software is provided as is without warranty of any kind"

#: Templates by label. The wording is that of the public licenses and of the notices that refer to them; fixed values.
TEMPLATES = {
    "agpl-3": [f"[[{GRANT}]] the gnu affero general public license [[as published by the free software foundation]] [[either]] {{{{version|v}}}} 3"],
    "apache-2": [
        f"{GRANT} the apache [[software]] license [[version]] 2 0",
        "{{apache license 2 0|apache 2 0 license|apache license v2}}",
        "spdx license identifier apache 2 0",
        "you may not use this file except in compliance with the license [[you may obtain a copy of the license at]] [[http www apache org licenses license 2 0]]",
    ],
    "all-rights-reserved": ["[[copyright [[c]] {{0-8}}]] all rights reserved"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        f"{GRANT} {{{{the|a}}}} [[{{{{2|3|4}}}} clause]] bsd [[{{{{2|3|4}}}} clause]] [[style]] license",
        "spdx license identifier bsd {{2|3}} clause",
    ],
    "cc-by-nc": [
        "creative commons attribution {{noncommercial|non commercial}} [[{{sharealike|share alike|noderivatives|noderivs}}]] [[{{1|2|3|4}} {{0|5}}]]",
        "creativecommons org licenses by nc",
        f"{GRANT} [[a]] [[creative commons]] cc by nc [[{{{{sa|nd}}}}]] [[{{{{1|2|3|4}}}} {{{{0|5}}}}]]",
    ],
    "cc0": ["{{cc0|creative commons zero}} [[1 0]] {{universal|public domain dedication}}", "spdx license identifier cc0 1 0"],
    "gpl-2": [f"{GRANT} the {{{{gnu general public license|gnu gpl|gpl}}}} [[as published by the free software foundation]] [[either]] {{{{version|v}}}} 2"],
    "gpl-3": [
        f"{GRANT} [[the terms of]] the {{{{gnu general public license|gnu gpl|gpl}}}} [[as published by the free software foundation]] [[either]] {{{{version|v}}}} 3 [[or at your option any later version]]",
        "spdx license identifier gpl 3 0 {{only|or later}}",
    ],
    "isc": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["gnu {{lesser|library}} general public license [[as published by the free software foundation]] [[either]] {{version|v}} {{2|2 1|3}}"],
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this {{1-6}} and associated documentation files [[the {{1-6}}]] to deal in the {{1-6}} without restriction"
        f" [[including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the {{{{1-6}}}}]] [[{WARRANTY}]]",
        f"{GRANT} [[the terms of]] {{{{the|a}}}} [[{{{{expat|modified|standard}}}}]] mit [[style]] license",
        "spdx license identifier mit",
    ],
    "mpl-2": ["subject to the terms of the mozilla public license v [[ersion]] 2 0", f"{GRANT} the mozilla public license [[version]] 2 0"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}

#: Mandatory words at which the score is a half.
HALF = 4

#: ASCII characters other than digits and letters become spaces, and A-Z become small; bytes of other characters stay.
PLAIN = bytes((c if chr(c).isalnum() else 32) if c < 128 else c for c in range(256)).lower()

MARK = re.compile(r"\[\[|\]\]|\{\{[^{}]*\}\}|[^\s\[\]{}]+")
GAP = re.compile(r"(\d+)-(\d+)")


def words_of(text: str | None) -> list[bytes]:
    """The words of a text in lower case, as UTF-8; null has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(PLAIN).split()


def parse(markup: str) -> list:
    """The parts of a template, in order: ("word", bytes), ("gap", least, most), ("one", wordings) and ("maybe", parts)."""
    stack: list[list] = [[]]
    for token in MARK.findall(markup):
        if token == "[[":
            stack.append([])
        elif token == "]]":
            if len(stack) == 1:
                raise ValueError(f"a region ends that did not begin: {markup}")
            inner = stack.pop()
            stack[-1].append(("maybe", inner))
        elif token.startswith("{{"):
            inner = token[2:-2].strip()
            if gap := GAP.fullmatch(inner):
                stack[-1].append(("gap", int(gap[1]), int(gap[2])))
            else:
                stack[-1].append(("one", [words_of(wording) for wording in inner.split("|")]))
        else:
            stack[-1] += [("word", word) for word in words_of(token)]
    if len(stack) > 1:
        raise ValueError(f"a region does not end: {markup}")
    return stack[0]


def mandatory(parts: list) -> int:
    """The fewest fixed words of a text that the parts accept."""
    each = {"word": lambda p: 1, "one": lambda p: min(map(len, p[1])), "gap": lambda p: 0, "maybe": lambda p: 0}
    return sum(each[p[0]](p) for p in parts)


def longest_run(parts: list) -> bytes:
    """The longest run of words that stands in every text that the parts accept, between spaces."""
    runs: list[list[bytes]] = [[]]
    for p in parts:
        if p[0] == "word":
            runs[-1].append(p[1])
        else:
            runs.append([])
    return b" %s " % b" ".join(max(runs, key=len)) if any(runs) else b" "


def as_pattern(parts: list) -> str:
    """The parts as a regular expression over words with one space before each; for SQL, and to test automata against."""
    each = {
        "word": lambda p: " " + p[1].decode(),
        "gap": lambda p: f"(?: [^ ]+){{{p[1]},{p[2]}}}",
        "one": lambda p: "(?:" + "|".join("".join(" " + w.decode() for w in wording) for wording in p[1]) + ")",
        "maybe": lambda p: f"(?:{as_pattern(p[1])})?",
    }
    return "".join(each[p[0]](p) for p in parts)


class Automaton:
    """Accepts runs of words that a template matches. States are sets of places in the template, made when first met."""

    def __init__(self, parts: list):
        self.steps: list[dict[bytes | None, set[int]]] = [{}]  # by place and word (None: any) the places that follow
        self.free: list[set[int]] = [set()]  # places reached without a word
        self.end = self._add(parts, 0)
        self.made: dict[frozenset[int], dict[bytes, frozenset[int] | None]] = {}
        self.start = self._closed({0})
        self.named = {word for step in self.steps for word in step if word is not None}
        first = [step for place in self.start for step in self.steps[place]]
        self.first = None if None in first else frozenset(first)

    def _place(self) -> int:
        self.steps.append({})
        self.free.append(set())
        return len(self.steps) - 1

    def _step(self, at: int, word: bytes | None) -> int:
        after = self._place()
        self.steps[at].setdefault(word, set()).add(after)
        return after

    def _add(self, parts: list, at: int) -> int:
        for p in parts:
            if p[0] == "word":
                at = self._step(at, p[1])
            elif p[0] == "gap":
                ends = []
                for k in range(p[2]):
                    if k >= p[1]:
                        ends.append(at)
                    at = self._step(at, None)
                for e in ends:
                    self.free[e].add(at)
            elif p[0] == "one":
                after = self._place()
                for wording in p[1]:
                    here = at
                    for word in wording:
                        here = self._step(here, word)
                    self.free[here].add(after)
                at = after
            else:
                begin, after = self._place(), self._place()  # so that leaving it out leads nowhere but on
                self.free[at] |= {begin, after}
                self.free[self._add(p[1], begin)].add(after)
                at = after
        return at

    def _closed(self, places: set[int]) -> frozenset[int]:
        found, ahead = set(places), list(places)
        while ahead:
            for place in self.free[ahead.pop()] - found:
                found.add(place)
                ahead.append(place)
        return frozenset(found)

    def _after(self, state: frozenset[int], word: bytes) -> frozenset[int] | None:
        reached = {x for place in state for w in ((None, word) if word else (None,)) for x in self.steps[place].get(w, ())}
        return self._closed(reached) if reached else None

    def longest(self, words: list[bytes], start: int) -> int | None:
        """The end (exclusive) of the longest run from start on that is accepted; None if there is none."""
        state, found = self.start, None
        for i in range(start, len(words) + 1):
            if self.end in state:
                found = i
            if i == len(words):
                break
            word = words[i] if words[i] in self.named else b""  # words that the template doesn't name are alike
            step = self.made.setdefault(state, {})
            if word not in step:
                step[word] = self._after(state, word)
            state = step[word]
            if state is None:
                break
        return found

    def spans(self, words: list[bytes]) -> Iterator[tuple[int, int]]:
        """The places of accepted runs from left to right, the longest at each start, none within another."""
        i = 0
        while i < len(words):
            end = self.longest(words, i) if self.first is None or words[i] in self.first else None
            if end is not None and end > i:
                yield i, end
                i = end
            else:
                i += 1


@dataclass
class Scanner:
    """Phrases and templates, compiled. Sent to workers as markup and compiled there, once for each worker process."""

    phrases: dict[str, str] = field(default_factory=lambda: dict(PHRASES))
    templates: dict[str, list[str]] = field(default_factory=lambda: {k: list(v) for k, v in TEMPLATES.items()})

    def __post_init__(self):
        self._compile()

    def __getstate__(self):
        return {"phrases": self.phrases, "templates": self.templates}

    def __setstate__(self, state):
        self.__dict__ |= state
        self._compile()

    def _compile(self) -> None:
        self.wordings = [(label, words_of(phrase)) for label, phrase in self.phrases.items()]
        self.compiled = []
        for label, several in self.templates.items():
            for markup in several:
                parts = parse(markup)
                if not mandatory(parts):
                    raise ValueError(f"a template without mandatory words accepts any text: {markup}")
                self.compiled.append((label, longest_run(parts), mandatory(parts), Automaton(parts)))

    def scan(self, text: str | None) -> dict:
        """What scan_licenses() gives for a text."""
        words = words_of(text)
        line = b" %s " % b" ".join(words)
        places: list[int] = []
        base, spans, most = set(), [], 0
        for label, phrase in self.wordings:
            if b" %s " % b" ".join(phrase) in line:
                at = [i for i, word in enumerate(words) if word == phrase[0] and words[i : i + len(phrase)] == phrase]
                places += at
                base.add(label)
                most = max(most, len(phrase))
        labels = set(base)
        for label, run, fixed, automaton in self.compiled:
            if run in line:
                for begin, end in automaton.spans(words):
                    spans.append({"label": label, "begin": begin, "end": end})
                    labels.add(label)
                    most = max(most, fixed)
        join = lambda names: ",".join(sorted(names))
        return {
            "n_words": len(words), "n_base": len(places), "first_word": min(places, default=None), "last_word": max(places, default=None),
            "base_labels": join(base), "labels": join(labels), "score": most / (most + HALF), "spans": spans,
        }


FOUND = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,begin:long,end:long>>"


def scan_licenses(docs: DataFrame, key: str = "doc_id", text: str = "text", scanner: Scanner | None = None) -> DataFrame:
    """(key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row of docs.

    n_base counts the places of the phrases, first_word and last_word are the least and the largest place (words from 0; null without any). labels holds
    those of phrases and of accepted templates, spans the words [begin, end) of each accepted template. score is m / (m + HALF), where m is the most
    mandatory words of a phrase or template found, so it tells how much exact wording speaks for the labels; 0 without any. Empty lists of labels are
    empty strings. A null text counts as empty; a very long one is read in full, in time that follows its length; copies are scanned alike and all
    stay, with their keys, null or not. Columns other than key and text are not looked at. An empty table gives an empty one.
    """
    spark = docs.sparkSession
    small_batches(spark)
    shared = spark.sparkContext.broadcast(scanner or Scanner())
    picked = docs.select(docs[key].alias("key"), docs[text].alias("text"))
    kind = dict(picked.dtypes)["key"]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = None
        for batch in batches:
            found = [shared.value.scan(t) for t in batch.column(1).to_pylist()]
            if schema is None:
                number, string = pa.int64(), pa.string()
                span = pa.list_(pa.struct([("label", string), ("begin", number), ("end", number)]))
                kinds = {"base_labels": string, "labels": string, "score": pa.float64(), "spans": span}
                schema = [(name.split()[0], kinds.get(name.split()[0], number)) for name in FOUND.split(", ")]
            columns = [pa.array([f[name] for f in found], kind) for name, kind in schema]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], ["key", *(name for name, _ in schema)])

    return picked.mapInArrow(scan, f"key {kind}, {FOUND}").withColumnRenamed("key", key)


def _oracle() -> str:
    """What the query gives, as DuckDB SQL: phrases as runs of a list of words, templates as regular expressions over words with a space before each."""
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    starts = {label: f"list_filter(range(len(w)), lambda i: w[i+1:i+{len(p)}] = [{', '.join(quoted(x.decode()) for x in p)}])" for label, p in ((k, words_of(v)) for k, v in PHRASES.items())}
    patterns = [(label, parse(markup)) for label, several in TEMPLATES.items() for markup in several]
    hit = lambda parts: f"regexp_matches(line, {quoted(as_pattern(parts) + ' ')})"
    names = sorted({*PHRASES, *TEMPLATES})
    base = [f"CASE WHEN len(b{i}) > 0 THEN {quoted(label)} END" for i, label in enumerate(PHRASES)]
    every = [
        f"CASE WHEN {' OR '.join([*(f'len(b{i}) > 0' for i, x in enumerate(PHRASES) if x == label), *(f'm{i}' for i, (x, _) in enumerate(patterns) if x == label)])} THEN {quoted(label)} END"
        for label in names
    ]
    most = [f"CASE WHEN len(b{i}) > 0 THEN {len(words_of(p))} ELSE 0 END" for i, p in enumerate(PHRASES.values())] + [f"CASE WHEN m{i} THEN {mandatory(parts)} ELSE 0 END" for i, (_, parts) in enumerate(patterns)]
    joined = lambda columns: f"array_to_string(list_sort(list_filter([{', '.join(columns)}], lambda x: x IS NOT NULL)), ',')"
    return rf"""
WITH split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
lines AS (SELECT *, ' ' || array_to_string(w, ' ') || ' ' AS line FROM split),
found AS (
  SELECT *, {', '.join(f'{s} AS b{i}' for i, s in enumerate(starts.values()))}, {', '.join(f'{hit(parts)} AS m{i}' for i, (_, parts) in enumerate(patterns))} FROM lines),
places AS (SELECT *, list_concat({', '.join(f'b{i}' for i in range(len(PHRASES)))}) AS b, greatest({', '.join(most)}) AS most FROM found)
SELECT doc_id, len(w)::BIGINT AS n_words, len(b)::BIGINT AS n_base, list_min(b)::BIGINT AS first_word, list_max(b)::BIGINT AS last_word,
  {joined(base)} AS base_labels, {joined(every)} AS labels, most::DOUBLE / (most + {HALF}) AS score FROM places
"""


ORACLE = _oracle()
