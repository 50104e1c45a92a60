"""Rows about a person put together: signals of a candidate, main institutions, the papers that belong to them, and counts of the whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.functions.text import blank
from loomstead.operators.metrics import first_by
from loomstead.operators.npi import specialties


def candidate_signals(candidates: DataFrame, conditions: DataFrame, countries: DataFrame, table: dict[str, list[str]]) -> DataFrame:
    """candidates (person_id, ...) with the categories of their studies' conditions (person_id, name) and the regions of these (person_id, country).

    Each condition is looked at once, whoever studies it. Regions that differ in case only count once, in the spelling that sorts first; blank ones do not
    count. Persons without either have empty lists.
    """
    known = conditions.select("name").distinct().select("name", F.explode(specialties(F.col("name"), table)).alias("category"))
    categories = conditions.distinct().join(known, "name").groupBy("person_id").agg(F.array_sort(F.collect_set("category")).alias("categories"))
    named = countries.where(~blank(F.col("country"))).groupBy("person_id", F.lower("country")).agg(F.min("country").alias("country"))
    regions = named.groupBy("person_id").agg(F.array_sort(F.collect_list("country")).alias("regions"))
    joined = candidates.join(categories, "person_id", "left").join(regions, "person_id", "left")
    return joined.withColumns({c: F.coalesce(c, F.array().cast("array<string>")) for c in ("categories", "regions")})


def primary_institutions(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """(person_id, institution, n, latest) for each person of a batch: of stored and new affiliations (person_id, institution, start_date), in any case, the
    most frequent institution, of equal ones the latest, then the first by name. Persons that the batch does not name stay as they are and are left out."""
    key = F.lower("institution").alias("institution")
    counted = lambda df: df.groupBy("person_id", key).agg(F.count("*").alias("n"), F.max("start_date").alias("latest"))
    kept = counted(stored).join(batch.select("person_id").distinct(), "person_id", "left_semi")
    merged = kept.unionByName(counted(batch)).groupBy("person_id", "institution").agg(F.sum("n").alias("n"), F.max("latest").alias("latest"))
    return first_by(merged, ["person_id"], F.desc("n"), F.desc_nulls_last("latest"), F.asc("institution"))


def own_publications(team: DataFrame, references: DataFrame) -> DataFrame:
    """(person_id, pmid): the papers cited by a person's own studies, once each; references (study_id, pmid) without a number tell nothing."""
    cited = references.where(~blank(F.col("pmid"))).select("study_id", "pmid").distinct()
    return team.select("person_id", "study_id").distinct().join(cited, "study_id").select("person_id", "pmid").distinct()


def with_code(terms: DataFrame, codes: DataFrame, name: str = "name", missing: str = "-") -> DataFrame:
    """terms with the code of their name in any case (codes: name, code, one row a name), else of what stands before " / ", else a sign for none."""
    key = lambda c: F.lower(c)
    table = codes.select(key(F.col("name")).alias("_key"), "code")
    whole = table.withColumnRenamed("code", "_whole").withColumnRenamed("_key", "_name")
    base = table.withColumnRenamed("code", "_before").withColumnRenamed("_key", "_base")
    before = F.when(F.locate(" / ", F.col(name)) > 1, F.trim(F.substring_index(name, " / ", 1)))
    joined = terms.join(whole, key(F.col(name)) == F.col("_name"), "left").join(base, key(before) == F.col("_base"), "left")
    return joined.withColumn("code", F.coalesce("_whole", "_before", F.lit(missing))).drop("_name", "_whole", "_base", "_before")


def ids_of(terms: DataFrame, known: DataFrame, key: str, id_: str, missing: int = -1) -> DataFrame:
    """terms with the id of their key; a number of its own for keys that are not known."""
    return terms.join(known.select(key, id_), key, "left").withColumn(id_, F.coalesce(id_, F.lit(missing)))


def coverage(persons: DataFrame, number: str, result: str) -> DataFrame:
    """One row: persons, those with a number, those by the result of the search, those never looked for, and the share with a number in percent."""
    n, r = F.col(number), F.col(result)
    with_number, total = F.count_if(n.isNotNull()), F.count("*")
    return persons.agg(
        total.alias("total"), with_number.alias("with_number"), F.count_if(r == "not_found").alias("not_found"), F.count_if(r == "ambiguous").alias("ambiguous"),
        F.count_if(n.isNull() & r.isNull()).alias("not_attempted"), F.bround(with_number / F.greatest(total, F.lit(1)) * 100, 1).alias("percent"),
    )


def origin(source: Column, category: Column) -> Column:
    """Where a term stands after matching: keywords that name a disease become conditions."""
    keyword = source == "keyword"
    return F.when(keyword & (category == "disease"), "keyword_remapped").when(keyword, "keyword").otherwise("condition")


def normalised(matches: DataFrame, term: str = "term", threshold: float = 0.5) -> DataFrame:
    """(term, canonical, similarity, is_new, alternatives) from ranked matches (term, name, similarity, rank): the best name if it is near enough, else the
    term itself; all ranked names are kept as alternatives."""
    ranked = matches.groupBy(term).agg(F.array_sort(F.collect_list(F.struct("rank", F.col("name").alias("condition"), F.round("similarity", 4).alias("score"), "similarity"))).alias("r"))
    best = F.get("r", F.lit(0))
    new = best["similarity"] < threshold
    shown = F.transform("r", lambda m: F.struct(m["condition"].alias("condition"), m["score"].alias("score")))
    return ranked.select(term, F.when(new, F.col(term)).otherwise(best["condition"]).alias("canonical"), best["score"].alias("similarity"), new.alias("is_new"), shown.alias("alternatives"))


def model_vector(matches: dict[str, str], certain: dict[str, str]) -> dict[str, Column]:
    """Numbers for a model by their names, from columns: matches that may be unknown give two, whether they hold and whether they are known; others one."""
    number = lambda c: F.coalesce(c, F.lit(False)).cast("double")
    pairs = {m: number(F.col(c)) for m, c in matches.items()} | {f"has_{m}": F.col(c).isNotNull().cast("double") for m, c in matches.items()}
    return pairs | {m: number(F.col(c)) for m, c in certain.items()}


def scored_by(schema: dict | None, available: dict[str, Column]) -> Column | None:
    """The probability that a stored model (features in order, their weights, and a bias) gives; None without a model, or if it asks for unknown features."""
    if not schema or not schema.get("features") or len(schema["features"]) != len(schema["weights"]) or not set(schema["features"]) <= set(available):
        return None
    total = F.lit(float(schema["bias"]))
    for name, weight in zip(schema["features"], schema["weights"], strict=True):
        total += available[name] * F.lit(float(weight))
    return 1 / (1 + F.exp(-total))


def stratified(df: DataFrame, label: str, key: str, share: float = 0.2, seed: int = 42) -> DataFrame:
    """df with the column held_out: of each label, about that share, told by a hash of key and seed, so rows stay on their side wherever they are read."""
    return df.withColumn("held_out", F.pmod(F.xxhash64(F.lit(seed), F.col(label), F.col(key)), F.lit(10_000)) < int(share * 10_000))
