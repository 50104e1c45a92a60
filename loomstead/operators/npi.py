"""A person's profile and how a candidate of a provider registry matches it: names, places, specialties and identifiers, each told, denied or unknown."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstead.functions import text as T

#: The identifier type of a researcher's id in the registry. A fixed value.
RESEARCHER_ID = "17"


def known(value: Column) -> Column:
    """A trimmed text; null for a blank one."""
    return F.nullif(F.trim(value), F.lit(""))


def name_parts(full_name: Column) -> Column:
    """Struct (first, middle, last) of a parsed name: one word is a last name, and what is between the first and the last is the middle."""
    words = F.filter(F.split(F.coalesce(full_name, F.lit("")), " +"), lambda w: w != "")
    n = F.size(words)
    first, last = F.when(n > 1, F.get(words, F.lit(0))).otherwise(""), F.coalesce(F.try_element_at(words, F.lit(-1)), F.lit(""))
    return F.struct(first.alias("first"), F.when(n > 2, F.array_join(F.slice(words, 2, F.greatest(n - 2, F.lit(0))), " ")).alias("middle"), last.alias("last"))


def specialties(text: Column, table: dict[str, list[str]]) -> Column:
    """The specialties of a table whose keywords a text holds, in any case."""
    low = F.lower(F.coalesce(text, F.lit("")))
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(low, w))
    return F.array_compact(F.array(*(F.when(holds([w.lower() for w in words]), F.lit(name)) for name, words in table.items())))


def profile(full_name: Column, orcid: Column, institution: Column, department: Column, city: Column, state: Column, categories: Column) -> Column:
    """Struct of a person's signals. The name is parsed once, as each use of it would repeat the whole expression."""

    def told(parsed: Column, parts: Column) -> Column:
        return F.struct(
            parts["first"].alias("first"), parts["middle"].alias("middle"), parts["last"].alias("last"), parsed["suffix"].alias("suffix"), orcid.alias("orcid"),
            known(institution).alias("institution"), known(department).alias("department"), known(city).alias("city"), known(state).alias("state"), categories.alias("specialties"),
        )

    return T.once(T.parsed_name(full_name), lambda parsed: T.once(name_parts(parsed["full_name"]), lambda parts: told(parsed, parts)))


def same(a: Column, b: Column) -> Column:
    """Whether two texts are equal in any case; unknown where one is blank."""
    a, b = known(a), known(b)
    return F.when(a.isNotNull() & b.isNotNull(), F.lower(a) == F.lower(b))


def middle_match(person: Column, candidate: Column) -> Column:
    """Equal middle names, or one that is the other's initial."""
    a, b = F.lower(known(person)), F.lower(known(candidate))
    initial = F.when(F.length(a) == 1, F.startswith(b, a)).otherwise((F.length(b) == 1) & F.startswith(a, b))
    return F.when(a.isNotNull() & b.isNotNull(), (a == b) | initial)


def credential_match(person: Column, candidate: Column) -> Column:
    """Whether two lists of degrees share one, whatever their signs."""
    degrees = lambda c: F.transform(F.filter(F.split(c, "[, /]+"), lambda w: w != ""), lambda w: F.upper(F.regexp_replace(w, r"[^\p{L}\p{N}]", "")))
    return F.when(known(person).isNotNull() & known(candidate).isNotNull(), F.arrays_overlap(degrees(person), degrees(candidate)))


def holds(whole: Column, part: Column) -> Column:
    """Whether a text holds another in any case; unknown where one is blank."""
    return F.when(known(whole).isNotNull() & known(part).isNotNull(), F.contains(F.lower(whole), F.lower(part)))


def first_or(items: Column, wanted) -> Column:
    """The first item that is wanted, else the first."""
    return F.coalesce(F.get(F.filter(items, wanted), F.lit(0)), F.get(items, F.lit(0)))


def match_features(person: Column, candidate: Column, table: dict[str, list[str]]) -> dict[str, Column]:
    """The match features of a candidate: true, false, or null where either side doesn't tell; exact_name, orcid and deactivated are never null.

    person is a profile(); candidate a struct of status, first, last, middle, credential, organisation, other_names (array of structs last,
    organisation), addresses (array of structs purpose, city, state), taxonomies (array of structs desc, main, state) and identifiers (array of
    structs type, identifier). The address of a location and the main taxonomy go first.
    """
    address = first_or(candidate["addresses"], lambda a: F.upper(a["purpose"]) == "LOCATION")
    taxonomy = first_or(candidate["taxonomies"], lambda t: t["main"])
    fields = specialties(taxonomy["desc"], table)
    department = specialties(person["department"], table)
    named = known(candidate["first"]).isNotNull() | known(candidate["last"]).isNotNull()
    exact = lambda a, b: F.lower(F.coalesce(a, F.lit(""))) == F.lower(F.coalesce(F.trim(b), F.lit("")))
    other = F.exists(candidate["other_names"], lambda o: F.coalesce(same(o["last"], person["last"]), F.lit(False)) | F.coalesce(holds(o["organisation"], person["institution"]), F.lit(False)))
    ours = F.exists(candidate["identifiers"], lambda i: (i["type"] == RESEARCHER_ID) & F.coalesce(same(i["identifier"], person["orcid"]), F.lit(False)))
    told = known(taxonomy["desc"]).isNotNull()
    return {
        "exact_name": named & exact(person["first"], candidate["first"]) & exact(person["last"], candidate["last"]),
        "middle_name": middle_match(person["middle"], candidate["middle"]),
        "credential": credential_match(person["suffix"], candidate["credential"]),
        "state": same(person["state"], address["state"]),
        "city": same(person["city"], address["city"]),
        "organisation": holds(candidate["organisation"], person["institution"]),
        "other_name": F.when(F.size(candidate["other_names"]) > 0, other),
        "specialty": F.when((F.size(person["specialties"]) > 0) & told, F.arrays_overlap(person["specialties"], fields)),
        "license_state": same(person["state"], taxonomy["state"]),
        "department": F.when(known(person["department"]).isNotNull() & told & (F.size(department) > 0), F.arrays_overlap(department, fields)),
        "orcid_match": F.coalesce(ours, F.lit(False)),
        "deactivated": F.coalesce(F.upper(candidate["status"]) == "D", F.lit(False)),
    }


def stored_candidate(row: Column) -> Column:
    """A candidate as match_features() takes it, from what was stored of one.

    row: struct of full_name ("first last" as it was stored; one word is a last name), middle, credential, organisation, city, state, specialty, license,
    license_state, status, and other_names and identifiers in JSON. An address is there if a city or a state is, and a specialty if any of its parts is; what
    isn't valid JSON counts as missing.
    """
    words = F.filter(F.split(F.coalesce(row["full_name"], F.lit("")), r"\s+"), lambda w: w != "")
    there = lambda *fields: reduce(lambda a, b: a | b, (known(row[f]).isNotNull() for f in fields))
    address = F.struct(F.lit("LOCATION").alias("purpose"), row["city"].alias("city"), row["state"].alias("state"))
    taxonomy = F.struct(row["specialty"].alias("desc"), F.lit(True).alias("main"), row["license_state"].alias("state"))
    several = lambda value, shape: F.from_json(known(value), f"array<struct<{shape}>>")
    others = F.transform(several(row["other_names"], "last_name: string, organization_name: string"), lambda o: F.struct(o["last_name"].alias("last"), o["organization_name"].alias("organisation")))
    ids = F.transform(several(row["identifiers"], "identifier_type: string, identifier: string"), lambda i: F.struct(i["identifier_type"].alias("type"), i["identifier"].alias("identifier")))
    return F.struct(
        row["status"].alias("status"), F.when(F.size(words) > 1, F.get(words, F.lit(0))).alias("first"), F.get(words, F.size(words) - 1).alias("last"), row["middle"].alias("middle"),
        row["credential"].alias("credential"), row["organisation"].alias("organisation"), others.alias("other_names"), F.when(there("city", "state"), F.array(address)).alias("addresses"),
        F.when(there("specialty", "license", "license_state"), F.array(taxonomy)).alias("taxonomies"), ids.alias("identifiers"),
    )
