"""Facts known before a study began, for each investigator of it.

Facts are summed by day or year first, so a person has a bounded number of rows however many facts, and running sums in one ordering of facts and
targets replace the join of each target with all that came before.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Days are counted from here.
EPOCH = "1970-01-01"


def days(date: Column) -> Column:
    return F.datediff(date, F.lit(EPOCH).cast("date"))


def running(targets: DataFrame, facts: DataFrame, at: str, sums: list[str], *, strictly: bool, keys: tuple[str, str] = ("person_id", "study_id")) -> DataFrame:
    """targets' keys with the sums of their person's facts before (or until) the target's position.

    targets has the keys and at; facts has the person, at and a row for each position with the sums; at is a whole number.
    """
    person, study = keys
    marked = targets.select(person, study, at, *(F.lit(None).cast(facts.schema[s].dataType).alias(s) for s in sums), F.lit(1).alias("_target"))
    stream = marked.unionByName(facts.select(person, F.lit(None).cast(targets.schema[study].dataType).alias(study), at, *sums, F.lit(0).alias("_target")))
    before = Window.partitionBy(person).orderBy(at).rangeBetween(Window.unboundedPreceding, -1 if strictly else 0)
    summed = stream.select(person, study, "_target", *(F.sum(s).over(before).alias(s) for s in sums))
    return summed.where("_target = 1").drop("_target")


def history(investigations: DataFrame, person: str = "person_id", study: str = "study_id") -> DataFrame:
    """Each person's studies: how many, how many completed, enrolled in all, and the share of completed ones; a study counts once."""
    each = investigations.groupBy(person, study).agg(F.bool_or(F.coalesce(F.col("status") == "COMPLETED", F.lit(False))).alias("done"), F.coalesce(F.max("enrollment"), F.lit(0)).alias("size"))
    return each.groupBy(person).agg(
        F.count("*").alias("prior_study_count"), F.count_if("done").alias("prior_completed_count"), F.sum("size").alias("prior_enrollment_total"),
        (F.count_if("done") / F.count("*")).alias("prior_completion_rate"),
    )
