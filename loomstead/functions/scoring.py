"""Scores of studies, persons and candidates; a signal that is null abstains and takes its weight with it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstead.functions import vocabulary as V

DAYS_A_MONTH, DAYS_A_YEAR = 30.44, 365.25

# Weights of the factors of a recommendation.
FACTORS = {"experience": 0.15, "completion": 0.30, "condition_fit": 0.25, "velocity": 0.10, "publication": 0.15, "geographic": 0.05}

# Weights of the matches of a candidate.
MATCHES = {
    "middle_name": 15, "credential": 5, "state": 10, "city": 5, "organisation": 10, "other_name": 5, "specialty": 15, "license_state": 5, "department": 5,
}
EXACT_NAME = 40

#: Matches of which one is needed before the best of several candidates is assigned.
CORROBORATION = ["state", "city", "organisation", "other_name", "specialty", "license_state", "department", "orcid"]

ASSIGN_AT, ASSIGN_SINGLE_AT, TIE = 0.6, 0.5, 1e-9


def completion_signal(status: Column) -> Column:
    signal = F.lit(None).cast("double")
    for name, value in V.COMPLETION.items():
        signal = F.when(status == name, F.lit(value)).otherwise(signal)
    return signal


def velocity_signal(enrollment: Column, start: Column, end: Column, as_of: Column) -> Column:
    """Enrolled a month; null without enrollment or start, or if the study does not end after it."""
    months = F.datediff(F.coalesce(end, as_of), start) / F.lit(DAYS_A_MONTH)
    return F.when((enrollment > 0) & (months > 0), enrollment / months)


def study_weight(enrollment: Column, start: Column, end: Column, as_of: Column) -> Column:
    """A study's size, less the longer ago it ended."""
    years = F.greatest(F.lit(0.0), F.datediff(as_of, F.coalesce(end, start, as_of)) / F.lit(DAYS_A_YEAR))
    return F.coalesce(enrollment, F.lit(1)) * (1.0 / (1.0 + years))


def experience(studies: Column) -> Column:
    return F.least(F.lit(1.0), studies / F.lit(20.0))


def completion(rate: Column) -> Column:
    return F.when(rate.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), rate)))


def condition_fit(requested: Column, own: Column) -> Column:
    return F.when(F.size(requested) > 0, F.size(F.array_intersect(requested, F.coalesce(own, F.array().cast("array<string>")))) / F.size(requested))


def velocity(rate: Column, target: int | None) -> Column:
    cap = target / 36.0 if target and target > 0 else 20.0
    return F.when(rate.isNotNull(), F.least(F.lit(1.0), rate / F.lit(cap)))


def publication(h_index: Column, papers: Column) -> Column:
    h, p = F.least(F.lit(1.0), h_index / F.lit(50.0)), F.least(F.lit(1.0), papers / F.lit(200.0))
    return F.try_divide(
        F.when(h_index.isNotNull(), 0.6 * h).otherwise(0.0) + F.when(papers.isNotNull(), 0.4 * p).otherwise(0.0),
        F.when(h_index.isNotNull(), F.lit(0.6)).otherwise(0.0) + F.when(papers.isNotNull(), F.lit(0.4)).otherwise(0.0),
    )


def geographic(region: str | None, own: Column) -> Column:
    if not region or not region.strip():
        return F.lit(None).cast("double")
    return F.when(F.size(own) > 0, F.exists(own, lambda r: F.lower(r) == region.lower()).cast("double"))


def weighted(factors: dict[str, Column]) -> Column:
    """The weighted mean of the factors that are there; 0 if none is."""
    top, weight = F.lit(0.0), F.lit(0.0)
    for name, factor in factors.items():
        top = top + F.when(factor.isNotNull(), FACTORS[name] * factor).otherwise(0.0)
        weight = weight + F.when(factor.isNotNull(), F.lit(FACTORS[name])).otherwise(0.0)
    return F.coalesce(F.try_divide(top, weight), F.lit(0.0))


def candidate_score(has_name: Column, exact_name: Column, matches: dict[str, Column], deactivated: Column) -> Column:
    """Matched over applicable weights; 0 for a deactivated candidate or nothing applicable."""
    matched = F.when(has_name & exact_name, F.lit(EXACT_NAME)).otherwise(0)
    applicable = F.when(has_name, F.lit(EXACT_NAME)).otherwise(0)
    for name, match in matches.items():
        matched = matched + F.when(match, F.lit(MATCHES[name])).otherwise(0)
        applicable = applicable + F.when(match.isNotNull(), F.lit(MATCHES[name])).otherwise(0)
    return F.when(deactivated, F.lit(0.0)).otherwise(F.coalesce(F.try_divide(matched.cast("double"), applicable), F.lit(0.0)))
