"""Resolving persons: the best candidate of each, names looked up, and identifiers that only one may own."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomstead.functions import scoring as S


def resolve(candidates: DataFrame, person: str = "person_id", number: str = "number") -> DataFrame:
    """(person, outcome, number, score) from scored candidates.

    candidates has score, deactivated, orcid_match and corroborated. A single active candidate with a matching ORCID is assigned; several are
    ambiguous. Else the best active one is assigned if no other ties with it, it reaches the threshold, and anything corroborates it; a lone one needs
    less. Persons without candidates are not in the table, and have not been found.
    """
    active = ~F.col("deactivated")
    top = F.max(F.when(active, F.col("score"))).over(Window.partitionBy(person))  # the aggregate reuses this partitioning
    known = candidates.withColumn("_top", top).groupBy(person).agg(
        F.count_if(active).alias("n"),
        F.count_if(active & F.col("orcid_match")).alias("n_orcid"),
        F.max(F.when(active & F.col("orcid_match"), F.struct(F.col(number).alias("number"), "score"))).alias("orcid"),
        F.max(F.when(active, F.struct("score", F.col(number).alias("number"), "corroborated"))).alias("best"),
        F.count_if(active & (F.col("score") >= F.col("_top") - S.TIE)).alias("ties"),
    )
    threshold = F.when(F.col("n") == 1, F.lit(S.ASSIGN_SINGLE_AT)).otherwise(S.ASSIGN_AT)
    wins = (F.col("ties") == 1) & (F.col("best.score") >= threshold) & ((F.col("n") == 1) | F.col("best.corroborated"))
    by_orcid = F.col("n_orcid") == 1
    assigned = (F.col("n") > 0) & (by_orcid | ((F.col("n_orcid") == 0) & wins))
    return known.select(
        person,
        F.when(F.coalesce(assigned, F.lit(False)), "Assigned").otherwise("Ambiguous").alias("outcome"),
        F.when(assigned, F.when(by_orcid, F.col("orcid.number")).otherwise(F.col("best.number"))).alias(number),
        F.when(assigned, F.when(by_orcid, F.greatest(F.col("orcid.score"), F.lit(1.0))).otherwise(F.col("best.score"))).alias("score"),
    )


def sole_owners(persons: DataFrame, identifier: str, *order: str) -> DataFrame:
    """Only the first owner of an identifier keeps it; the others are marked as duplicates of it."""
    rank = F.row_number().over(Window.partitionBy(identifier).orderBy(*order))
    second = F.col(identifier).isNotNull() & (rank > 1)
    return persons.withColumn("duplicate", second).withColumn(identifier, F.when(~F.col("duplicate"), F.col(identifier)))


def find_or_create(persons: DataFrame, incoming: DataFrame, name: str = "full_name", raw: str = "raw_name") -> DataFrame:
    """(full_name, person_id, created): each incoming name with the person of that full name, else of the raw name, else a new one by its digest."""
    known = persons.groupBy(F.lower(name).alias("_key")).agg(F.min("person_id").alias("_id"))
    by_raw = known.select(F.col("_key").alias("_raw"), F.col("_id").alias("_raw_id"))
    wanted = incoming.withColumn("_lower", F.lower(name)).dropDuplicates(["_lower"])
    met = wanted.join(known, F.col("_lower") == F.col("_key"), "left").join(by_raw, F.lower(raw) == F.col("_raw"), "left")
    found = F.coalesce("_id", "_raw_id")
    return met.select(name, F.coalesce(found.cast("string"), F.sha2("_lower", 256)).alias("person_id"), found.isNull().alias("created"))
