"""Cleaning of names, keywords, places and affiliations, as column expressions."""

from __future__ import annotations

import re
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstead.functions import vocabulary as V


def one_of(value: Column, choices: list[str]) -> Column:
    """Whether value, in upper case, is one of the choices."""
    return F.upper(value).isin([c.upper() for c in choices])


def looked_up(value: Column, table: dict[str, str]) -> Column:
    """What a table gives for value in upper case; null for none."""
    pairs = [F.lit(x) for key, found in table.items() for x in (key.upper(), found)]
    return F.create_map(*pairs)[F.upper(value)]


def blank(value: Column) -> Column:
    return value.isNull() | value.rlike(r"^\s*$")


def squeezed(value: Column) -> Column:
    """Trimmed, with runs of white space as one space; null if blank."""
    return F.when(~blank(value), F.trim(F.regexp_replace(value, r"\s+", " ")))


def tokens(value: Column) -> Column:
    """The words between spaces."""
    return F.filter(F.split(value, " "), lambda w: F.trim(w) != "")


def either(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions, F.lit(False))


# --- keywords


def normalized_keyword(keyword: Column) -> Column:
    """Trimmed, without signs at its end, in upper case."""
    return F.upper(F.regexp_replace(F.trim(keyword), r"[,;:.!?]+$", ""))


def expanded_acronym(keyword: Column) -> Column:
    return F.coalesce(looked_up(F.trim(keyword), V.ACRONYMS), keyword)


def junk_keyword(keyword: Column) -> Column:
    return one_of(keyword, V.BLOCKED_KEYWORDS) & ~one_of(keyword, V.DESIGN_TERMS)


def keyword_ok(keyword: Column) -> Column:
    """Whether a normalised keyword is kept, its study's conditions aside."""
    long_enough = (F.length(keyword) >= 4) | ((F.length(keyword) >= 2) & one_of(keyword, V.SHORT_TERMS))
    plain = ~keyword.contains(";") & ~keyword.contains("|") & (F.regexp_count(keyword, F.lit(",")) < 3)
    return long_enough & (F.length(keyword) <= 150) & ~junk_keyword(keyword) & plain & (F.size(tokens(keyword)) <= 10)


def filtered_keywords(keywords: Column, conditions: Column | None = None) -> Column:
    """Struct (cleaned, rejected) of an array of keywords. One that is among the conditions is in neither."""
    filled = F.filter(keywords, lambda k: ~blank(k))
    ready = F.array_distinct(F.transform(filled, lambda k: F.upper(expanded_acronym(normalized_keyword(k)))))
    known = F.transform(conditions, F.upper) if conditions is not None else F.array().cast("array<string>")
    cleaned = F.filter(ready, lambda k: keyword_ok(k) & ~F.array_contains(known, k))
    rejected = F.filter(ready, lambda k: ~keyword_ok(k) & ~F.array_contains(known, k))
    return F.struct(cleaned.alias("cleaned"), rejected.alias("rejected"))


def gated(rejected: Column, matched: Column) -> Column:
    """Struct (accepted, rejected): rejected keywords that a vocabulary matched come back."""
    known = F.transform(matched, F.upper)
    found = lambda k: F.array_contains(known, F.upper(k))
    return F.struct(F.filter(rejected, found).alias("accepted"), F.filter(rejected, lambda k: ~found(k)).alias("rejected"))


# --- names


def once(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of value, which is worked out once however often body uses it; an expression that stands in several places is worked out in each."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without_role_label(name: Column) -> Column:
    """A name without a role after its last comma."""
    trimmed = F.trim(name)
    label = F.replace(F.trim(F.regexp_extract(trimmed, r"(?s)^.+,([^,]*)$", 1)), F.lit("_"), F.lit(" "))
    is_role = one_of(label, V.ROLE_PREFIXES) | one_of(label, [r for r in V.INVESTIGATOR_ROLES if "_" not in r])
    return F.when(is_role, F.trim(F.regexp_extract(trimmed, r"(?s)^(.+),[^,]*$", 1))).otherwise(trimmed)


def _phrase(keyword: str) -> str:
    """A pattern for the words of an organisation's phrase, each with a plural S and signs after it."""
    words = keyword.split(" ")
    return "(?:^| )" + " +".join(re.escape(w) + r"S?[,.;:!?]*" for w in words) + "(?= |$)"


#: Any of the organisations' phrases, in one pattern.
ANY_PHRASE = "(?:^| )(?:" + "|".join(_phrase(k).removeprefix("(?:^| )").removesuffix("(?= |$)") for k in V.ORGANISATION_WORDS) + ")(?= |$)"


def not_human_reason(name: Column, role: Column) -> Column:
    """Why a name is no person's; null for a person. Rules apply in order.

    The name is cleaned and split once for all rules. One pattern of all organisations' phrases tells whether any stands in it; only then are they
    looked for one by one, for the first in the table's order.
    """

    def ruled(trimmed: Column, upper: Column, words: Column) -> Column:
        last = F.upper(F.regexp_replace(F.get(words, F.size(words) - 1), r"[,.]+$", ""))
        first = F.regexp_replace(F.get(words, F.lit(0)), r"[,.]+$", "")
        count = F.size(words)
        foreign = trimmed.rlike(r"[\p{L}&&[^A-Za-z]]")
        reason = F.when(blank(name) | blank(trimmed), "EmptyOrNull")
        reason = reason.when(foreign, F.when((F.length(trimmed) < 2) | (count > 6), "NonLatinName"))
        reason = reason.when(F.length(trimmed) < 3, "TooShort").when(F.length(trimmed) > 100, "TooLong").when(count > 10, "TooManyWords")
        reason = reason.when(one_of(upper, V.NOT_PERSONS), F.concat(F.lit("KnownNonHumanName:"), upper))
        for prefix in V.ROLE_PREFIXES:
            reason = reason.when(upper.startswith(prefix), f"RolePrefix:{prefix}")
        reason = reason.when(last.isin(V.CORPORATE_SUFFIXES), F.concat(F.lit("CorporateSuffix:"), last))
        reason = reason.when(trimmed.contains(" & "), "Ampersand")
        phrases = F.lit(None).cast("string")
        for keyword in reversed(V.ORGANISATION_WORDS):
            phrases = F.when(upper.rlike(_phrase(keyword)), f"OrgKeywords:{keyword}").otherwise(phrases)
        reason = reason.when(upper.rlike(ANY_PHRASE), phrases)
        reason = reason.when(one_of(first, V.COMPANIES), F.concat(F.lit("PharmaBlocklist:"), first))
        investigator = F.coalesce(one_of(F.trim(role), V.INVESTIGATOR_ROLES), F.lit(False))
        return reason.when(~investigator & (count == 1) & (F.length(trimmed) > 20), "SingleLongWord")

    return once(without_role_label(name), lambda t: once(F.struct(F.upper(t).alias("u"), tokens(t).alias("w")), lambda x: ruled(t, x["u"], x["w"])))


def parsed_name(raw: Column) -> Column:
    """Struct (prefix, full_name, suffix): a title at the front, degrees at the end or in a list after a comma."""
    bare = lambda w: F.upper(F.regexp_replace(w, r"[,.]+$", ""))
    is_degree = lambda w: F.coalesce(one_of(bare(w), V.DEGREES), F.lit(False))

    def told(rest: Column, prefix: Column, n: Column, whole: Column, listed: Column) -> Column:
        """From the words after a title, how many at their end are degrees, and the list after the last comma if all of it are degrees."""
        body = F.array_join(F.slice(rest, F.lit(1), F.size(rest) - n), " ")
        ended = F.transform(F.slice(rest, F.size(rest) - n + 1, n), lambda w: F.regexp_replace(w, r",+$", ""))
        named = F.when(n > 0, body).when(listed.isNotNull(), F.trim(F.regexp_extract(whole, r"^(.+), ", 1))).otherwise(whole)
        suffixes = F.when(n > 0, ended).when(listed.isNotNull(), F.reverse(F.transform(listed, lambda w: F.regexp_replace(w, r"[,.]+$", ""))))
        suffix = once(suffixes, lambda found: F.when(F.size(found) > 0, F.array_join(found, ", ")))
        return F.struct(prefix.alias("prefix"), F.trim(F.regexp_replace(named, r",+$", "")).alias("full_name"), suffix.alias("suffix"))

    def of_rest(rest: Column, prefix: Column) -> Column:
        flags = F.transform(F.reverse(rest), is_degree)
        n = once(flags, lambda f: F.when(F.array_contains(f, False), F.array_position(f, F.lit(False)) - 1).otherwise(F.size(f)).cast("int"))
        parts = lambda whole: F.filter(F.transform(F.split(F.regexp_extract(whole, r"^.+, (.*)$", 1), ","), lambda w: F.trim(w)), lambda w: w != "")
        listed = lambda whole: once(parts(whole), lambda found: F.when(whole.rlike(r"^.+, ") & F.forall(found, is_degree), found))
        return once(n, lambda k: once(F.array_join(rest, " "), lambda whole: once(listed(whole), lambda found: told(rest, prefix, k, whole, found))))

    def of_words(words: Column) -> Column:
        titled = F.coalesce(one_of(bare(F.get(words, F.lit(0))), V.TITLES), F.lit(False))
        rest = lambda t: F.when(t, F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0)))).otherwise(words)
        return once(titled, lambda t: once(rest(t), lambda after: of_rest(after, F.when(t, F.get(words, F.lit(0))))))

    return once(tokens(F.coalesce(F.trim(raw), F.lit(""))), of_words)


def name_parts(full_name: Column) -> Column:
    """Struct (first, middle, last); middle is null for two words or fewer."""
    words = tokens(F.coalesce(full_name, F.lit("")))
    n = F.size(words)
    middle = F.when(n > 2, F.array_join(F.slice(words, F.lit(2), F.greatest(n - 2, F.lit(0))), " "))
    return F.struct(F.when(n > 1, F.get(words, F.lit(0))).otherwise("").alias("first"), middle.alias("middle"), F.coalesce(F.get(words, n - 1), F.lit("")).alias("last"))


def name_variations(full_name: Column) -> Column:
    """Structs (first, last) to look a name up by; none for a blank name."""
    words = tokens(F.coalesce(full_name, F.lit("")))
    n = F.size(words)
    at = lambda i: F.get(words, i)
    pair = lambda a, b: F.struct(a.alias("first"), b.alias("last"))
    made = F.array(
        F.when(n > 0, pair(F.when(n > 1, at(F.lit(0))).otherwise(""), at(n - 1))),
        F.when(n > 2, pair(at(F.lit(0)), F.array_join(F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), " "))),
        F.when((n == 3) & (F.length(at(F.lit(1))) <= 2), pair(at(F.lit(0)), at(n - 1))),
    )
    return F.array_compact(made)


def middle_name_match(left: Column, right: Column) -> Column:
    """Whether two middle names agree, one of them an initial or not; null if one is missing."""
    a, b = (F.upper(F.regexp_replace(F.trim(x), r"\.$", "")) for x in (left, right))
    initials = ((F.length(a) == 1) & b.startswith(a)) | ((F.length(b) == 1) & a.startswith(b))
    return F.when(~blank(left) & ~blank(right), (a == b) | initials)


def credentials(value: Column) -> Column:
    """The set of credentials in a text: parts between commas, slashes and spaces, letters and digits only, in upper case."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), "[, /]+"), lambda p: F.upper(F.regexp_replace(p, "[^A-Za-z0-9]", "")))
    return F.array_distinct(F.filter(parts, lambda p: p != ""))


# --- places and affiliations


def country(value: Column) -> Column:
    found = squeezed(value)
    return F.coalesce(looked_up(found, V.COUNTRIES), found)


def state(value: Column) -> Column:
    found = squeezed(value)
    return F.coalesce(looked_up(found, V.STATES), F.when(F.length(found) <= 4, F.upper(found)).otherwise(found))


def institution_ok(value: Column) -> Column:
    """Whether an affiliation names an institution and no occupation."""
    trimmed = F.trim(value)
    single = (~trimmed.contains(" ")) & (F.length(trimmed) > 1) & trimmed.rlike("(?i)(ist|ian)$")
    return ~blank(value) & ~one_of(trimmed, V.OCCUPATIONS) & ~single


def specialties(value: Column) -> Column:
    """The specialties that a text tells of, in the order of the table; none for a blank text."""
    tells = lambda low: F.array_compact(F.array(*(F.when(either([low.contains(k) for k in shortest(keys)]), F.lit(name)) for name, keys in V.SPECIALTIES.items())))
    return F.get(F.transform(F.array(F.lower(F.coalesce(value, F.lit("")))), tells), F.lit(0))  # a lambda's variable, so a text is lowered once


def shortest(keys: list[str]) -> list[str]:
    """Keys without those that hold another: a text with these has the other too."""
    return [k for k in keys if not any(o != k and o in k for o in keys)]


#: Letters of scripts that count as not English: Han, Cyrillic, Arabic, Greek, Thai, Hebrew.
OTHER_SCRIPTS = r"[\p{L}&&[\x{4E00}-\x{9FFF}\x{3400}-\x{4DBF}\x{2E80}-\x{2EFF}\x{F900}-\x{FAFF}\x{2F800}-\x{2FA1F}\x{0400}-\x{04FF}\x{0600}-\x{06FF}\x{0370}-\x{03FF}\x{0E00}-\x{0E7F}\x{0590}-\x{05FF}]]"


def non_english(value: Column) -> Column:
    """Whether half of a text's letters or more are of such scripts; false for a text without letters."""
    letters = F.regexp_count(value, F.lit(r"\p{L}"))
    return F.coalesce((letters > 0) & (2 * F.regexp_count(value, F.lit(OTHER_SCRIPTS)) >= letters), F.lit(False))


# --- output


def number_text(value: Column) -> Column:
    """A number with six decimals at most and no zeros at its end; zero has no sign."""
    unsigned = F.regexp_replace(F.format_string("%.6f", value.cast("double")), r"^-(?=0\.0+$)", "")
    return F.regexp_replace(F.regexp_replace(unsigned, "0+$", ""), r"\.$", "")


def quoted(value: Column) -> Column:
    return F.concat(F.lit('"'), F.replace(F.coalesce(value, F.lit("")), F.lit('"'), F.lit('""')), F.lit('"'))
