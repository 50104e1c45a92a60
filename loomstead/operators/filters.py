"""Search of studies by criteria: all dimensions must hold, and within one any value will do."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field
from urllib.parse import parse_qs, urlencode

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.functions.text import either
from loomstead.operators import trigrams


@dataclass
class Criteria:
    """What a search asks for; empty means anything. Blank values in a list do not count."""

    keyword: str | None = None
    statuses: list[str] = field(default_factory=list)
    phases: list[str] = field(default_factory=list)
    conditions: list[str] = field(default_factory=list)
    tree_prefixes: list[str] = field(default_factory=list)
    countries: list[str] = field(default_factory=list)
    states: list[str] = field(default_factory=list)
    cities: list[str] = field(default_factory=list)
    facilities: list[str] = field(default_factory=list)
    place_prefixes: list[str] = field(default_factory=list)
    least_enrollment: int | None = None
    most_enrollment: int | None = None
    start_from: str | None = None
    start_to: str | None = None
    include_removed: bool = False


@dataclass
class Registry:
    """The tables that a search reads, by study_id; those that are None restrict nothing."""

    studies: DataFrame
    phases: DataFrame | None = None
    conditions: DataFrame | None = None
    descriptors: DataFrame | None = None
    places: DataFrame | None = None
    keywords: DataFrame | None = None
    #: Postings of the studies' texts and keywords (study_id, gram), as trigrams.postings() gives them: with them, a keyword's search reads only candidates.
    grams: DataFrame | None = None


def filled(values: list[str] | None) -> list[str]:
    return [v for v in values or [] if v and v.strip()]


def starts_with_any(value: Column, prefixes: list[str]) -> Column:
    return either([value.startswith(p) for p in prefixes])


def like_pattern(search: str) -> str:
    """A pattern of ILIKE for a search that may hold wildcards itself."""
    return f"%{search}%"


def apply_filters(registry: Registry, criteria: Criteria, *, wildcards: bool = False, study_keywords: bool = True, by_place: bool = True) -> DataFrame:
    """The studies that meet the criteria; children are tested by semi-joins, so that no study comes twice.

    wildcards takes the keyword as a pattern of ILIKE; the two other flags leave out keywords of studies and places, as searches within a person do.
    """
    found = registry.studies
    if not criteria.include_removed and "removed_at" in found.columns:
        found = found.where(F.col("removed_at").isNull())
    if criteria.keyword and criteria.keyword.strip():
        keyword, keywords = criteria.keyword.strip(), registry.keywords if study_keywords else None
        if registry.grams is not None and not wildcards:
            near = trigrams.candidates(registry.grams, "study_id", keyword)
            found = found.join(near, "study_id", "left_semi")
            keywords = keywords.join(near, "study_id", "left_semi") if keywords is not None else None
        found = _by_keyword(found, keywords, keyword, wildcards)
    if statuses := filled(criteria.statuses):
        found = found.where(F.col("status").isin(statuses))
    if phases := filled(criteria.phases):
        found = found.join(registry.phases.where(F.col("phase").isin(phases)).select("study_id"), "study_id", "left_semi")
    if names := filled(criteria.conditions):
        wanted = registry.descriptors.where(F.col("name").isin(names)).select("descriptor_id")
        found = found.join(registry.conditions.join(wanted, "descriptor_id", "left_semi").select("study_id"), "study_id", "left_semi")
    if prefixes := filled(criteria.tree_prefixes):
        wanted = registry.descriptors.where(starts_with_any(F.col("tree_number"), prefixes)).select("descriptor_id")
        found = found.join(registry.conditions.join(wanted, "descriptor_id", "left_semi").select("study_id"), "study_id", "left_semi")
    if by_place:
        for column, values in (("country", criteria.countries), ("state", criteria.states), ("city", criteria.cities), ("facility", criteria.facilities)):
            if wanted_values := filled(values):  # each by itself: two may hold at different places
                found = found.join(registry.places.where(F.col(column).isin(wanted_values)).select("study_id"), "study_id", "left_semi")
    if by_place and (prefixes := filled(criteria.place_prefixes)):
        placed = registry.places.where(F.exists("tree_numbers", lambda number: starts_with_any(number, prefixes)))
        found = found.join(placed.select("study_id"), "study_id", "left_semi")
    if criteria.least_enrollment is not None:
        found = found.where(F.col("enrollment") >= criteria.least_enrollment)
    if criteria.most_enrollment is not None:
        found = found.where(F.col("enrollment") <= criteria.most_enrollment)
    if criteria.start_from:
        found = found.where(F.col("start_date") >= F.lit(criteria.start_from).cast("date"))
    if criteria.start_to:
        found = found.where(F.col("start_date") <= F.lit(criteria.start_to).cast("date"))
    return found


def _by_keyword(studies: DataFrame, keywords: DataFrame | None, keyword: str, wildcards: bool) -> DataFrame:
    test = (lambda c: F.ilike(c, F.lit(like_pattern(keyword)))) if wildcards else (lambda c: F.contains(F.lower(c), F.lit(keyword.lower())))
    texts = [c for c in ("title", "official_title", "summary", "study_id") if c in studies.columns]
    own = either([F.coalesce(test(F.col(c).cast("string")), F.lit(False)) for c in texts])
    if keywords is None:
        return studies.where(own)
    tagged = keywords.where(test(F.col("keyword"))).select(F.col("study_id").alias("_tagged")).distinct()
    return studies.join(tagged, F.col("study_id") == F.col("_tagged"), "left").where(own | F.col("_tagged").isNotNull()).drop("_tagged")


def page(found: DataFrame, number: int, size: int, most: int = 100) -> DataFrame:
    """One page of studies, newest start first, unknown starts before all, equal ones by study_id. Number and size are clamped."""
    number, size = max(1, number), min(max(1, size), most)
    return found.orderBy(F.desc_nulls_first("start_date"), "study_id").offset((number - 1) * size).limit(size)


def listed(registry: Registry, search: str | None = None, status: str | None = None, phase: str | None = None) -> DataFrame:
    """Studies by a pattern in their texts or id, a list of statuses with commas, and one phase; blank ones ask for nothing."""
    found = registry.studies
    if search and search.strip():
        found = _by_keyword(found, None, search, wildcards=True)
    if statuses := split_values(status):
        found = found.where(F.col("status").isin(statuses))
    if phase and phase.strip():
        found = found.join(registry.phases.where(F.col("phase") == phase).select("study_id"), "study_id", "left_semi")
    return found


def listed_page(found: DataFrame, number: int, size: int, created: str = "created_at") -> DataFrame:
    """One page of studies, the latest made first, equal ones by study_id."""
    return found.orderBy(F.desc(created), "study_id").offset((max(1, number) - 1) * size).limit(size)


def sorted_page(shown: DataFrame, by: str, descending: bool = False) -> DataFrame:
    """A page's own rows in another order; rows of other pages do not come in."""
    return shown.orderBy(F.desc_nulls_last(by) if descending else F.asc_nulls_first(by), "study_id")


def drawn(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """n rows at random, the same ones for the same seed wherever rows lie: those whose key and seed have the smallest digests."""
    digest = F.md5(F.concat(F.col(key).cast("string"), F.lit(f":{seed}")))
    return df.orderBy(digest, key).limit(n)


#: Modes of a run that is asked for by hand. Fixed values.
RUN_MODES = ["incremental", "full"]


def run_mode_ok(mode: Column) -> Column:
    return F.coalesce(F.lower(mode).isin(RUN_MODES), F.lit(False))


def disease(tree_numbers: Column) -> Column:
    """Whether any path of a descriptor lies under diseases or mental disorders."""
    return F.coalesce(F.exists(tree_numbers, lambda number: starts_with_any(number, ["C", "F03"])), F.lit(False))


def equal_to(df: DataFrame, **wanted: str | None) -> DataFrame:
    """Rows whose columns equal all values that are given; a blank value asks for nothing."""
    for column, value in wanted.items():
        if value and value.strip():
            df = df.where(F.col(column) == value)
    return df


def page_count(total: int, size: int) -> int:
    return -(-total // size)


def page_strip(current: int, last: int, around: int = 1) -> list[int | None]:
    """Page numbers to show: the first, the last, those around the current one, and None for each gap."""
    shown = sorted({1, last, *range(max(1, current - around), min(last, current + around) + 1)}) if last > 0 else []
    strip: list[int | None] = []
    for n in shown:
        if strip and n - strip[-1] == 2:
            strip.append(n - 1)
        elif strip and n - strip[-1] > 2:
            strip.append(None)
        strip.append(n)
    return strip


def split_values(value: str | None) -> list[str] | None:
    """The parts of a list with commas, trimmed and without empty ones; None if blank."""
    return [p.strip() for p in value.split(",") if p.strip()] if value and value.strip() else None


#: Criteria and the names of their parameters in a URL.
PARAMETERS = {
    "keyword": "q", "statuses": "status", "phases": "phase", "conditions": "condition", "tree_prefixes": "tree", "countries": "country", "states": "state",
    "cities": "city", "facilities": "facility", "least_enrollment": "minEnrollment", "most_enrollment": "maxEnrollment", "start_from": "startFrom",
    "start_to": "startTo", "place_prefixes": "locationTree",
}


def to_query_string(criteria: Criteria) -> str:
    """Criteria as a URL's query; criteria that are empty are left out."""
    pairs = []
    for name, parameter in PARAMETERS.items():
        value = getattr(criteria, name)
        values = filled(value) if isinstance(value, list) else [str(value)] if value not in (None, "") else []
        pairs += [(parameter, v) for v in values]
    return urlencode(pairs)


def from_query_string(query: str) -> Criteria:
    """The criteria that a URL's query holds; numbers and dates that are none are ignored."""
    given, criteria = parse_qs(query.removeprefix("?")), Criteria()
    for name, parameter in PARAMETERS.items():
        values = filled(given.get(parameter))
        if not values:
            continue
        if isinstance(getattr(criteria, name), list):
            setattr(criteria, name, values)
        elif name.endswith("enrollment"):
            if values[0].strip().lstrip("-").isdigit():
                setattr(criteria, name, int(values[0]))
        elif name.startswith("start"):
            try:
                setattr(criteria, name, dt.date.fromisoformat(values[0].strip()).isoformat())
            except ValueError:
                continue
        else:
            criteria.keyword = values[0].strip()
    return criteria


def checked_window(start: str | None, end: str | None, today: dt.date) -> tuple[dt.date, dt.date]:
    """A window of days: both are needed, exact, from 2000 on, not in the future, and in order."""
    if not start or not end:
        raise ValueError("both from and to are needed")
    try:
        first, last = (dt.datetime.strptime(d, "%Y-%m-%d").date() for d in (start, end))
    except ValueError:
        raise ValueError("dates are given as yyyy-MM-dd") from None
    if first < dt.date(2000, 1, 1):
        raise ValueError("from lies before 2000-01-01")
    if last > today:
        raise ValueError("to lies in the future")
    if first > last:
        raise ValueError("from lies after to")
    return first, last
