"""Trees, recommendations, candidates and feature frames."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead.functions import scoring as S
from loomstead.operators import features as X
from loomstead.operators import hierarchy as H
from loomstead.operators import npi as N
from loomstead.operators.metrics import weighted_mean
from loomstead.operators.resolution import find_or_create, resolve, sole_owners
from loomstead.plans import roles as R
from loomstead.plans.registry import ORACLES, query

DEC = "decimal(18,2)"

TREE_SQL = f"""{R.WITH}, uses AS (SELECT descriptor_id, count(*) AS u FROM conditions GROUP BY 1),
below AS (SELECT DISTINCT d.descriptor_id, d.name, array_to_string(string_split(tree_number, '.')[1:k], '.') AS node, k AS depth FROM descriptors d, range(1, 4) r(k)),
rolled AS (SELECT node, depth, CAST(sum(coalesce(u, 0)) AS BIGINT) AS n, arg_max(name, coalesce(u, 0) * 10000000 - descriptor_id) AS label
  FROM below LEFT JOIN uses USING (descriptor_id) GROUP BY ALL)"""


def rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.rolled_up(R.descriptors(spark, sf_dir), R.conditions(spark, sf_dir))


@query(f"""{TREE_SQL} SELECT node, label, n, EXISTS (SELECT 1 FROM rolled c WHERE c.depth = 2 AND starts_with(c.node, r.node || '.') AND c.n >= 10) AS has_children
  FROM rolled r WHERE depth = 1 AND n >= 10""")
def tree_root(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.children(rollup(spark, sf_dir), None, 10)


@query(f"""{TREE_SQL} SELECT node, label, n, EXISTS (SELECT 1 FROM rolled c WHERE c.depth = 3 AND starts_with(c.node, r.node || '.') AND c.n >= 5) AS has_children
  FROM rolled r WHERE depth = 2 AND starts_with(node, 'B2.') AND n >= 5""")
def tree_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.children(rollup(spark, sf_dir), "B2", 5)


@query(f"""{R.WITH} SELECT descriptor_id, tree_number, string_split(tree_number, '.')[1] || ' > ' || array_to_string(string_split(tree_number, '.')[1:2], '.') || ' > ' || tree_number AS above FROM descriptors""")
def ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = R.descriptors(spark, sf_dir)
    return found.select("descriptor_id", "tree_number", F.array_join(H.ancestors(F.col("tree_number")), " > ").alias("above"))


@query(f"{R.WITH} SELECT DISTINCT name FROM descriptors WHERE starts_with(tree_number, 'B3') OR starts_with(tree_number, 'B3.SMALL')")
def names_under_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.names_under(R.descriptors(spark, sf_dir), ["B3.SMALL"]).orderBy("name")


@query(f"""{R.WITH}, uses AS (SELECT descriptor_id, count(*) AS u FROM conditions GROUP BY 1),
  worded AS (SELECT *, string_split_regex(lower(name), '[^a-z0-9]+') AS w FROM descriptors)
  SELECT descriptor_id, name, coalesce(u, 0) AS n FROM worded LEFT JOIN uses USING (descriptor_id) WHERE contains(lower(name), 'sm wids')
    OR (len(list_filter(w, lambda x: starts_with(x, 'sm'))) > 0 AND len(list_filter(w, lambda x: starts_with(x, 'wid'))) > 0) ORDER BY n DESC, name, descriptor_id LIMIT 20""")
def word_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.search(R.descriptors(spark, sf_dir), R.conditions(spark, sf_dir), "sm wids")


ENDED_SQL = """ended AS (SELECT l_orderkey AS study_id, CAST(max(l_shipdate) AS DATE) AS end_date FROM lineitem GROUP BY 1),
signals AS (SELECT s.*, end_date, CASE status WHEN 'COMPLETED' THEN 1.0::DOUBLE WHEN 'RECRUITING' THEN 0.2::DOUBLE END AS completion,
  CASE WHEN enrollment > 0 AND date_diff('day', start_date, coalesce(end_date, DATE '2024-06-01')) > 0
    THEN enrollment / (date_diff('day', start_date, coalesce(end_date, DATE '2024-06-01')) / 30.44::DOUBLE) END AS velocity,
  coalesce(enrollment, 1) * (1.0::DOUBLE / (1.0::DOUBLE + greatest(0.0::DOUBLE, date_diff('day', coalesce(end_date, start_date), DATE '2024-06-01') / 365.25::DOUBLE))) AS weight
  FROM studies s LEFT JOIN ended USING (study_id)),
means AS (SELECT person_id, count(*) FILTER (completion IS NOT NULL OR velocity IS NOT NULL) AS included,
  sum(weight * completion) / sum(CASE WHEN completion IS NOT NULL THEN weight END) AS completion_rate, sum(weight * velocity) / sum(CASE WHEN velocity IS NOT NULL THEN weight END) AS velocity_rate
  FROM (SELECT DISTINCT person_id, study_id FROM investigators) JOIN signals USING (study_id) GROUP BY 1)"""


def person_signals(spark: SparkSession, sf_dir: str, team: DataFrame | None = None) -> DataFrame:
    """(person_id, included, completion_rate, velocity_rate): weighted means over a person's studies, of the persons in team if it is given."""
    taking_part = (R.investigators(spark, sf_dir) if team is None else team).select("person_id", "study_id").distinct()
    lines = R.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("study_id"), "l_shipdate")
    if team is not None:
        lines = lines.join(taking_part, "study_id", "left_semi")
    ended = lines.groupBy("study_id").agg(F.to_date(F.max("l_shipdate")).alias("end_date"))
    as_of = F.lit(R.AS_OF).cast("date")
    args = (F.col("enrollment"), F.col("start_date"), F.col("end_date"), as_of)
    signals = R.studies(spark, sf_dir).join(ended, "study_id", "left").select(
        "study_id", S.completion_signal(F.col("status")).alias("completion"), S.velocity_signal(*args).alias("velocity"), S.study_weight(*args).alias("weight")
    )
    included = F.count_if(F.col("completion").isNotNull() | F.col("velocity").isNotNull()).alias("included")
    means = [weighted_mean(F.col(c), F.col("weight")).alias(f"{c}_rate") for c in ("completion", "velocity")]
    return taking_part.join(signals, "study_id").groupBy("person_id").agg(included, *means)


@query(f"{R.WITH}, {ENDED_SQL} SELECT person_id, included, round(completion_rate, 6) AS completion_rate, round(velocity_rate, 6) AS velocity_rate FROM means")
def weighted_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return person_signals(spark, sf_dir).select("person_id", "included", *(F.round(c, 6).alias(c) for c in ("completion_rate", "velocity_rate")))


TOP, PREFIXES, REGION, TARGET = 10, ["B1.PROMO"], "EUROPE", 400


@query(f"""{R.WITH}, {ENDED_SQL},
wanted AS (SELECT descriptor_id, category FROM descriptors WHERE starts_with(tree_number, 'B1') OR starts_with(tree_number, 'B1.PROMO')),
asked AS (SELECT list(DISTINCT category) AS a FROM wanted),
per AS (SELECT person_id, count(DISTINCT study_id) AS study_count FROM investigators GROUP BY 1),
able AS (SELECT DISTINCT i.person_id FROM investigators i JOIN conditions c USING (study_id) JOIN wanted USING (descriptor_id)),
cut AS (SELECT person_id, study_count FROM per JOIN able USING (person_id) ORDER BY study_count DESC, person_id LIMIT {TOP * 3}),
cats AS (SELECT i.person_id, list(DISTINCT d.category) AS own FROM (SELECT DISTINCT person_id, study_id FROM investigators WHERE role = 'PRINCIPAL_INVESTIGATOR') i
  JOIN conditions c USING (study_id) JOIN descriptors d USING (descriptor_id) GROUP BY 1),
regs AS (SELECT i.person_id, bool_or(lower(country) = 'europe') AS near FROM (SELECT DISTINCT person_id, study_id FROM investigators) i JOIN places USING (study_id) GROUP BY 1),
pubs AS (SELECT l_suppkey AS person_id, count(*) FILTER (l_quantity = 50) AS h, count(*) FILTER (l_quantity >= 40) AS papers FROM lineitem GROUP BY 1),
scored AS (SELECT person_id, s_name AS full_name, study_count, least(1.0, study_count / 20.0::DOUBLE) AS experience, greatest(0.0, least(1.0, completion_rate)) AS completion,
  len(list_intersect(a, coalesce(own, [])))::DOUBLE / len(a) AS condition_fit, least(1.0, velocity_rate / ({TARGET} / 36.0::DOUBLE)) AS velocity,
  (0.6::DOUBLE * least(1.0, h / 50.0::DOUBLE) + 0.4::DOUBLE * least(1.0, papers / 200.0::DOUBLE)) / (0.6::DOUBLE + 0.4::DOUBLE) AS publication, near::INT::DOUBLE AS geographic
  FROM cut JOIN supplier ON s_suppkey = person_id CROSS JOIN asked LEFT JOIN means USING (person_id) LEFT JOIN cats USING (person_id) LEFT JOIN regs USING (person_id) LEFT JOIN pubs USING (person_id)),
ranked AS (SELECT *, (coalesce(0.15 * experience, 0) + coalesce(0.3 * completion, 0) + coalesce(0.25 * condition_fit, 0) + coalesce(0.1 * velocity, 0) + coalesce(0.15 * publication, 0) + coalesce(0.05 * geographic, 0))
  / (CASE WHEN experience IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN completion IS NOT NULL THEN 0.3 ELSE 0 END + CASE WHEN condition_fit IS NOT NULL THEN 0.25 ELSE 0 END
    + CASE WHEN velocity IS NOT NULL THEN 0.1 ELSE 0 END + CASE WHEN publication IS NOT NULL THEN 0.15 ELSE 0 END + CASE WHEN geographic IS NOT NULL THEN 0.05 ELSE 0 END)::DOUBLE AS s FROM scored)
SELECT person_id, full_name, study_count, round_even(s, 3) AS score, round_even(completion, 3) AS completion, round_even(condition_fit, 3) AS condition_fit, round_even(publication, 3) AS publication
FROM ranked ORDER BY s DESC, study_count DESC, lower(full_name) LIMIT {TOP}""")
def best_pi_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best persons for a study: those with a condition under the prefixes or above them, cut by number of studies, then scored and ranked."""
    descriptors, uses, team = R.descriptors(spark, sf_dir), R.conditions(spark, sf_dir), R.investigators(spark, sf_dir)
    wanted = descriptors.where(H.either([F.startswith("tree_number", F.lit(p)) for p in H.expanded(PREFIXES)]))
    asked = wanted.agg(F.collect_set("category").alias("asked"))  # categories are few
    able = uses.join(wanted, "descriptor_id", "left_semi").join(team.select("study_id", "person_id"), "study_id").select("person_id").distinct()
    counts = team.groupBy("person_id").agg(F.count_distinct("study_id").alias("study_count"))
    best = counts.join(able, "person_id", "left_semi").orderBy(F.desc("study_count"), "person_id").limit(TOP * 3)
    # thirty rows, worked out once: the filters that they make reach the scans of all that follows
    thirty = [tuple(r) for r in best.collect()]
    cut = spark.createDataFrame(thirty, best.schema)
    own = team.where(F.col("person_id").isin([r[0] for r in thirty]))
    led = own.where("role = 'PRINCIPAL_INVESTIGATOR'").select("person_id", "study_id")
    categories = led.join(uses, "study_id").join(descriptors, "descriptor_id").groupBy("person_id").agg(F.collect_set("category").alias("categories"))
    regions = own.join(R.places(spark, sf_dir), "study_id").groupBy("person_id").agg(F.collect_set("country").alias("regions"))
    lines = R.table(spark, sf_dir, "lineitem").withColumnRenamed("l_suppkey", "person_id").where(F.col("person_id").isin([r[0] for r in thirty]))
    papers = lines.groupBy("person_id").agg(F.count_if(F.col("l_quantity") == 50).alias("h"), F.count_if(F.col("l_quantity") >= 40).alias("papers"))
    joined = cut.join(R.persons(spark, sf_dir), "person_id").join(F.broadcast(asked))
    for side in (person_signals(spark, sf_dir, own), categories, regions, papers):
        joined = joined.join(side, "person_id", "left")
    factors = {
        "experience": S.experience(F.col("study_count")), "completion": S.completion(F.col("completion_rate")), "condition_fit": S.condition_fit(F.col("asked"), F.col("categories")),
        "velocity": S.velocity(F.col("velocity_rate"), TARGET), "publication": S.publication(F.col("h"), F.col("papers")), "geographic": S.geographic(REGION, F.col("regions")),
    }
    scored = joined.withColumns(factors).withColumn("total", S.weighted({name: F.col(name) for name in factors}))
    ranked = scored.orderBy(F.desc("total"), F.desc("study_count"), F.lower("full_name")).limit(TOP)
    shown = [F.bround(c, 3).alias(n) for c, n in (("total", "score"), ("completion", "completion"), ("condition_fit", "condition_fit"), ("publication", "publication"))]
    return ranked.select("person_id", "full_name", "study_count", *shown)


#: What stands for specialties, by words of a part's type.
FIELDS = {"retail": ["promo", "small"], "bulk": ["large", "economy"], "plain": ["standard", "medium"]}

FIELD_SQL = lambda t: f"CASE WHEN {t} IN ('PROMO', 'SMALL') THEN 'retail' WHEN {t} IN ('LARGE', 'ECONOMY') THEN 'bulk' ELSE 'plain' END"

CANDIDATES_SQL = f"""compared AS (SELECT o_custkey AS person_id, o_orderkey AS number, own.p_name = found.p_name AS exact_name, starts_with(found.p_type, own.p_type[1]) AS middle_name,
    CASE WHEN c_mktsegment <> 'FURNITURE' THEN found.p_brand = own.p_brand END AS credential, pn.n_name = cn.n_name AS state, pr.r_name = cr.r_name AS city,
    contains(found.p_brand, own.p_brand) AS organisation, string_split(found.p_name, ' ')[1] = string_split(own.p_name, ' ')[2] OR contains(found.p_brand, own.p_brand) AS other_name,
    {FIELD_SQL("own.p_type")} = {FIELD_SQL("found.p_type")} AS specialty, pn.n_name = cn.n_name AS license_state,
    CASE WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN {FIELD_SQL("own.p_type")} = {FIELD_SQL("found.p_type")} END AS department,
    own.p_partkey = found.p_partkey AS orcid_match, o_orderstatus = 'P' AS deactivated
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN part own ON own.p_partkey = c_custkey JOIN nation pn ON pn.n_nationkey = c_nationkey JOIN region pr ON pr.r_regionkey = pn.n_regionkey
  JOIN lineitem ON l_orderkey = o_orderkey AND l_linenumber = 1 JOIN part found ON found.p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
  JOIN nation cn ON cn.n_nationkey = s_nationkey JOIN region cr ON cr.r_regionkey = cn.n_regionkey),
candidates AS (SELECT * FROM compared),
scored AS (SELECT *, coalesce(state, false) OR coalesce(specialty, false) OR city OR orcid_match AS corroborated, CASE WHEN deactivated THEN 0.0::DOUBLE ELSE
  (CASE WHEN exact_name THEN 40 ELSE 0 END + CASE WHEN middle_name THEN 15 ELSE 0 END + CASE WHEN state THEN 10 ELSE 0 END + CASE WHEN specialty THEN 15 ELSE 0 END + CASE WHEN city THEN 5 ELSE 0 END)::DOUBLE
  / (40 + CASE WHEN middle_name IS NOT NULL THEN 15 ELSE 0 END + CASE WHEN state IS NOT NULL THEN 10 ELSE 0 END + CASE WHEN specialty IS NOT NULL THEN 15 ELSE 0 END + 5) END AS score FROM candidates)"""


def compared(spark: SparkSession, sf_dir: str, stored: bool = False) -> DataFrame:
    """(person_id, number and the match features) of each candidate: customers named as the part of their number stand for persons, and the part and
    supplier of an order's first line for what a registry says of a candidate; with stored, for what was kept of it in flat columns and JSON."""
    t = lambda name: R.table(spark, sf_dir, name)
    places = t("nation").join(t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    place = lambda side, key: F.broadcast(places.select(F.col("n_nationkey").alias(key), F.col("n_name").alias(f"{side}_state"), F.col("r_name").alias(f"{side}_city")))  # noqa: E731  nations are few
    part = lambda side, key: t("part").select(F.col("p_partkey").alias(key), *(F.col(f"p_{c}").alias(f"{side}_{c}") for c in ("name", "type", "brand")))
    persons = t("customer").join(part("own", "c_custkey"), "c_custkey").join(place("own", "c_nationkey"), "c_nationkey")
    lines = t("lineitem").where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", F.col("l_suppkey").alias("s_suppkey"))
    found = lines.join(part("found", "l_partkey"), "l_partkey").join(t("supplier").select("s_suppkey", "s_nationkey"), "s_suppkey").join(place("found", "s_nationkey"), "s_nationkey")
    word = lambda side, k: F.get(F.split(f"{side}_name", " "), F.lit(k))
    segment = F.col("c_mktsegment")
    full = F.concat_ws(" ", word("own", 0), F.substring("own_type", 1, 1), word("own", 1))
    department = F.when(segment.isin("BUILDING", "MACHINERY"), F.col("own_type"))
    person = N.profile(full, F.col("c_custkey").cast("string"), F.col("own_brand"), department, F.col("own_city"), F.col("own_state"), N.specialties(F.col("own_type"), FIELDS))
    person = person.withField("suffix", F.when(segment != "FURNITURE", F.col("own_brand")))
    dealt = persons.repartition(spark.sparkContext.defaultParallelism, "c_custkey")  # names take long to parse, and a small table is one task's
    profiles = R.written(dealt.select("c_custkey", person.alias("person")), "profiles")  # worked out once a person, before candidates multiply them
    joined = t("orders").select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderstatus").join(profiles, "c_custkey").join(found, "o_orderkey")
    address = lambda purpose, city, state: F.struct(F.lit(purpose).alias("purpose"), city.alias("city"), state.alias("state"))
    taxonomy = lambda desc, main, state: F.struct(desc.alias("desc"), F.lit(main).alias("main"), state.alias("state"))
    candidate = F.struct(
        F.when(F.col("o_orderstatus") == "P", "D").otherwise("A").alias("status"), word("found", 0).alias("first"), word("found", 1).alias("last"), F.col("found_type").alias("middle"),
        F.col("found_brand").alias("credential"), F.col("found_brand").alias("organisation"),
        F.array(F.struct(word("found", 0).alias("last"), F.col("found_brand").alias("organisation"))).alias("other_names"),
        F.array(address("MAILING", F.lit("-"), F.lit("-")), address("LOCATION", F.col("found_city"), F.col("found_state"))).alias("addresses"),
        F.array(taxonomy(F.lit("promo"), False, F.lit("-")), taxonomy(F.col("found_type"), True, F.col("found_state"))).alias("taxonomies"),
        F.array(F.struct(F.lit("17").alias("type"), F.col("l_partkey").cast("string").alias("identifier"))).alias("identifiers"),
    )
    if stored:
        json = lambda **fields: F.to_json(F.array(F.struct(*(c.alias(n) for n, c in fields.items()))))
        candidate = N.stored_candidate(F.struct(
            F.concat_ws(" ", word("found", 0), word("found", 1)).alias("full_name"), F.col("found_type").alias("middle"), F.col("found_brand").alias("credential"), F.col("found_brand").alias("organisation"),
            F.col("found_city").alias("city"), F.col("found_state").alias("state"), F.col("found_type").alias("specialty"), F.lit(None).cast("string").alias("license"), F.col("found_state").alias("license_state"),
            F.when(F.col("o_orderstatus") == "P", "D").otherwise("A").alias("status"), json(last_name=word("found", 0), organization_name=F.col("found_brand")).alias("other_names"),
            json(identifier_type=F.lit("17"), identifier=F.col("l_partkey").cast("string")).alias("identifiers"),
        ))
    both = joined.select(F.col("c_custkey").alias("person_id"), F.col("o_orderkey").alias("number"), "person", candidate.alias("candidate"))
    features = both.select("person_id", "number", *(c.alias(n) for n, c in N.match_features(F.col("person"), F.col("candidate"), FIELDS).items()))
    return R.written(features, "features")  # fourteen narrow columns, read by scores, models and resolution as often as they like


@query(f"WITH {CANDIDATES_SQL} SELECT * FROM compared")
def npi_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The twelve match features of each candidate."""
    return compared(spark, sf_dir)


@query(f"WITH {CANDIDATES_SQL} SELECT * FROM compared")
def npi_stored_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same of candidates that were stored and are rebuilt from their rows."""
    return compared(spark, sf_dir, stored=True)


#: Columns of match features by the names that a stored model knows them by.
MATCHES = {
    "middle_name_match": "middle_name", "credential_match": "credential", "state_match": "state", "city_match": "city", "org_match": "organisation", "other_name_match": "other_name",
    "specialty_match": "specialty", "license_state_match": "license_state", "department_match": "department",
}
CERTAIN = {"exact_name_match": "exact_name", "orcid_match": "orcid_match", "deactivated": "deactivated"}


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = compared(spark, sf_dir)
    matches = {m: F.col(m) for m in ("middle_name", "state", "specialty", "city")}
    scored = marked.withColumn("score", S.candidate_score(F.lit(True), F.col("exact_name"), matches, F.col("deactivated")))
    signs = [F.coalesce(m, F.lit(False)) for m in (F.col("state"), F.col("specialty"), F.col("city"), F.col("orcid_match"))]
    return scored.withColumn("corroborated", H.either(signs))


@query(f"WITH {CANDIDATES_SQL} SELECT person_id, number, round(score, 6) AS score, corroborated FROM scored")
def npi_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates(spark, sf_dir).select("person_id", "number", F.round("score", 6).alias("score"), "corroborated")


RESOLVED_SQL = f"""{CANDIDATES_SQL}, per AS (SELECT person_id, count(*) FILTER (NOT deactivated) AS n, count(*) FILTER (NOT deactivated AND orcid_match) AS no,
  max(number) FILTER (NOT deactivated AND orcid_match) AS orcid_number, max(score) FILTER (NOT deactivated) AS top FROM scored GROUP BY 1),
best AS (SELECT s.person_id, count(*) AS ties, max(number) AS best_number, bool_or(corroborated) AS ok FROM scored s JOIN per USING (person_id) WHERE NOT deactivated AND score >= top - 1e-9::DOUBLE GROUP BY 1),
told AS (SELECT *, n > 0 AND (no = 1 OR no = 0 AND ties = 1 AND top >= CASE WHEN n = 1 THEN 0.5 ELSE 0.6 END AND (n = 1 OR ok)) AS assigned FROM per LEFT JOIN best USING (person_id)),
resolved AS (SELECT person_id, CASE WHEN coalesce(assigned, false) THEN 'Assigned' ELSE 'Ambiguous' END AS outcome, CASE WHEN assigned THEN CASE WHEN no = 1 THEN orcid_number ELSE best_number END END AS number,
  CASE WHEN assigned THEN CASE WHEN no = 1 THEN 1.0 ELSE round(top, 6) END END AS score FROM told)"""


@query(f"WITH {RESOLVED_SQL} SELECT * FROM resolved")
def npi_resolve(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve(candidates(spark, sf_dir)).withColumn("score", F.round("score", 6))


@query("""WITH r AS (SELECT o_orderkey AS person_id, floor(o_totalprice)::BIGINT % 5000 AS npi FROM orders),
  k AS (SELECT *, row_number() OVER (PARTITION BY npi ORDER BY person_id) AS rank FROM r) SELECT person_id, CASE WHEN rank = 1 THEN npi END AS npi, rank > 1 AS duplicate FROM k""")
def npi_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    owners = R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("person_id"), (F.floor("o_totalprice") % 5000).alias("npi"))
    return sole_owners(owners, "npi", "person_id")


@query("""WITH incoming AS (SELECT DISTINCT lower(c_name) AS k FROM customer), known AS (SELECT lower(replace(s_name, 'Supplier', 'Customer')) AS k, min(s_suppkey) AS id FROM supplier GROUP BY 1)
  SELECT k AS name, coalesce(CAST(id AS VARCHAR), sha256(k)) AS person_id, id IS NULL AS created FROM incoming LEFT JOIN known USING (k)""")
def find_or_create_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = R.persons(spark, sf_dir).withColumn("full_name", F.replace("full_name", F.lit("Supplier"), F.lit("Customer")))
    incoming = R.table(spark, sf_dir, "customer").select(F.col("c_name").alias("full_name"), F.col("c_name").alias("raw_name"))
    return find_or_create(known, incoming).select(F.lower("full_name").alias("name"), "person_id", "created")


# --- the feature frame

FROM, TO = "1998-01-01", "1998-07-01"

TARGETS_SQL = f"""targets AS (SELECT study_id, person_id, status, start_date, year(start_date) AS y FROM studies JOIN investigators USING (study_id)
  WHERE role = 'PRINCIPAL_INVESTIGATOR' AND status IS NOT NULL AND start_date >= DATE '{FROM}' AND start_date < DATE '{TO}'),
h AS (SELECT person_id, study_id, bool_or(coalesce(status = 'COMPLETED', false)) AS done, max(coalesce(enrollment, 0)) AS size FROM studies JOIN investigators USING (study_id)
  WHERE start_date < DATE '{FROM}' GROUP BY 1, 2),
history AS (SELECT person_id, count(*) AS prior_study_count, count(*) FILTER (done) AS prior_completed_count, CAST(sum(size) AS BIGINT) AS prior_enrollment_total FROM h GROUP BY 1)"""


def targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = R.investigators(spark, sf_dir).where("role = 'PRINCIPAL_INVESTIGATOR'").select("study_id", "person_id")
    found = R.studies(spark, sf_dir).where(F.col("status").isNotNull() & F.col("start_date").between(F.lit(FROM).cast("date"), F.date_sub(F.lit(TO).cast("date"), 1)))
    return found.join(led, "study_id").select("study_id", "person_id", "status", "start_date", F.year("start_date").alias("y"), X.days(F.col("start_date")).alias("day"))


def prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    earlier = R.studies(spark, sf_dir).where(F.col("start_date") < F.lit(FROM).cast("date")).join(R.investigators(spark, sf_dir).select("study_id", "person_id"), "study_id")
    return X.history(earlier)


@query(f"{R.WITH}, {TARGETS_SQL} SELECT person_id, prior_study_count, prior_completed_count, prior_enrollment_total, round(prior_completed_count / prior_study_count, 6) AS prior_completion_rate FROM history")
def history_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prior(spark, sf_dir).withColumn("prior_completion_rate", F.round("prior_completion_rate", 6))


def papers_before_start(spark: SparkSession, sf_dir: str, wanted: DataFrame) -> DataFrame:
    lines = R.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("person_id"), X.days(F.to_date("l_shipdate")).alias("day"), F.year("l_shipdate").alias("year"))
    facts = lines.groupBy("person_id", "day").agg(F.count("*").alias("papers"))
    first = lines.groupBy("person_id").agg(F.min("year").alias("first_year"))
    counted = X.running(wanted, facts, "day", ["papers"], strictly=True).withColumn("papers", F.coalesce("papers", F.lit(0)))
    joined = counted.join(wanted.select("study_id", "person_id", "y"), ["study_id", "person_id"]).join(first, "person_id", "left")
    rate = F.when(F.col("papers") > 0, F.col("papers") / F.greatest(F.lit(1), F.col("y") - F.col("first_year") + 1)).otherwise(0.0)
    return joined.select("study_id", "person_id", F.col("papers").alias("papers_before_start"), rate.alias("papers_per_year"))


@query(f"""{R.WITH}, {TARGETS_SQL} SELECT study_id, person_id, count(l_suppkey) AS papers_before_start,
  round(CASE WHEN count(l_suppkey) > 0 THEN count(l_suppkey) / greatest(1, y - (SELECT min(year(l_shipdate)) FROM lineitem f WHERE f.l_suppkey = person_id) + 1) ELSE 0 END, 6) AS papers_per_year
  FROM targets LEFT JOIN lineitem ON l_suppkey = person_id AND CAST(l_shipdate AS DATE) < start_date GROUP BY study_id, person_id, y""")
def papers_before(spark: SparkSession, sf_dir: str) -> DataFrame:
    return papers_before_start(spark, sf_dir, targets(spark, sf_dir)).withColumn("papers_per_year", F.round("papers_per_year", 6))


def usage_until(spark: SparkSession, sf_dir: str, wanted: DataFrame) -> DataFrame:
    lines = R.table(spark, sf_dir, "lineitem").where("l_linenumber <= 3")
    facts = lines.groupBy(F.col("l_suppkey").alias("person_id"), F.year("l_shipdate").alias("y")).agg(
        F.count("*").alias("beneficiaries"), F.sum("l_quantity").cast("long").alias("services"), F.sum(F.col("l_extendedprice").cast(DEC)).cast("decimal(28,2)").alias("payments"),
        F.sum(F.col("l_discount").cast("decimal(10,4)")).cast("decimal(28,4)").alias("risk"), F.count("l_discount").alias("risks"),
    )
    sums = X.running(wanted, facts, "y", ["beneficiaries", "services", "payments", "risk", "risks"], strictly=False)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    risk = F.coalesce(F.try_divide(F.col("risk").cast("double"), F.col("risks")), F.lit(0.0))
    return sums.select("study_id", "person_id", zero("beneficiaries"), zero("services"), F.coalesce(F.col("payments").cast("double"), F.lit(0.0)).alias("payments"), risk.alias("risk_score"), F.col("beneficiaries").isNotNull().alias("has_usage"))


@query(f"""{R.WITH}, {TARGETS_SQL} SELECT study_id, person_id, count(l_suppkey) AS beneficiaries, CAST(coalesce(sum(l_quantity), 0) AS BIGINT) AS services,
  CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))), 0) AS DOUBLE) AS payments, round(coalesce(CAST(sum(CAST(l_discount AS DECIMAL(10,4))) AS DOUBLE) / nullif(count(l_discount), 0), 0), 6) AS risk_score,
  count(l_suppkey) > 0 AS has_usage FROM targets LEFT JOIN lineitem ON l_suppkey = person_id AND l_linenumber <= 3 AND year(l_shipdate) <= y GROUP BY study_id, person_id""")
def asof_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return usage_until(spark, sf_dir, targets(spark, sf_dir)).withColumn("risk_score", F.round("risk_score", 6))


def payments_until(spark: SparkSession, sf_dir: str, wanted: DataFrame) -> DataFrame:
    lines = R.table(spark, sf_dir, "lineitem").where("l_linenumber > 3").select(F.col("l_suppkey").alias("person_id"), F.year("l_shipdate").alias("y"), "l_returnflag", F.col("l_extendedprice").cast(DEC).alias("amount"), "l_partkey")
    research = F.col("l_returnflag") == "R"
    amount = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount"))), F.lit(0)).cast("decimal(28,2)")
    money = lines.groupBy("person_id", "y").agg(amount(research).alias("research"), amount(~research).alias("general"), F.count("*").alias("n"))
    # a payor counts from its first year on
    payors = lines.groupBy("person_id", "l_partkey").agg(F.min("y").alias("y")).groupBy("person_id", "y").agg(F.count("*").alias("payors"))
    facts = money.join(payors, ["person_id", "y"], "left").withColumn("payors", F.coalesce("payors", F.lit(0)))
    sums = X.running(wanted, facts, "y", ["research", "general", "n", "payors"], strictly=False)
    number = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c)
    return sums.select("study_id", "person_id", number("research"), number("general"), F.coalesce("payors", F.lit(0)).alias("payors"), F.col("n").isNotNull().alias("has_payments"))


@query(f"""{R.WITH}, {TARGETS_SQL} SELECT study_id, person_id, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag = 'R'), 0) AS DOUBLE) AS research,
  CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (l_returnflag <> 'R'), 0) AS DOUBLE) AS general, count(DISTINCT l_partkey) AS payors, count(l_suppkey) > 0 AS has_payments
  FROM targets LEFT JOIN lineitem ON l_suppkey = person_id AND l_linenumber > 3 AND year(l_shipdate) <= y GROUP BY study_id, person_id""")
def asof_payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return payments_until(spark, sf_dir, targets(spark, sf_dir))


def research_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a search for a person's papers told: lines stand for papers, their quantities for citations; persons in debt were not found."""
    size = F.col("l_quantity")
    counts = R.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("person_id")).agg(
        F.max(size).cast("long").alias("current_h_index"), F.sum(size).cast("long").alias("citation_count"), F.count_if(size >= 10).alias("i10_index"), F.count("*").alias("total_papers")
    )
    found = R.persons(spark, sf_dir).where("s_acctbal > 0").select("person_id")
    return counts.join(found, "person_id").withColumn("has_metrics", F.lit(True))


#: The body of an earlier query's SQL over targets.
body = lambda name: ORACLES[name].split(TARGETS_SQL)[1]

#: Columns of the feature frame after what tells the study and the person.
FEATURES = {
    "prior_study_count": "prior_study_count", "prior_completed_count": "prior_completed_count", "prior_enrollment_total": "prior_enrollment_total", "prior_completion_rate": "prior_completion_rate",
    "papers_before_start": "papers_before_start", "papers_per_year_before_start": "papers_per_year", "medicare_beneficiaries": "beneficiaries", "medicare_services": "services",
    "medicare_payments": "payments", "medicare_risk_score": "risk_score", "has_medicare": "has_usage", "research_payments": "research", "general_payments": "general", "payor_count": "payors",
    "has_payments": "has_payments", "current_h_index": "current_h_index", "citation_count": "citation_count", "i10_index": "i10_index", "total_papers": "total_papers", "has_metrics": "has_metrics",
}


@query(f"""{R.WITH}, {TARGETS_SQL}, p AS ({body("papers_before")}), m AS ({body("asof_usage")}), o AS ({body("asof_payments")}),
r AS (SELECT l_suppkey AS person_id, CAST(max(l_quantity) AS BIGINT) AS h, CAST(sum(l_quantity) AS BIGINT) AS c, count(*) FILTER (l_quantity >= 10) AS i, count(*) AS n FROM lineitem JOIN supplier ON s_suppkey = l_suppkey
  WHERE s_acctbal > 0 GROUP BY 1)
SELECT t.study_id AS study_nct_id, t.person_id, s_name AS full_name, status AS overall_status, CASE WHEN status = 'COMPLETED' THEN 1 ELSE 0 END AS label, coalesce(prior_study_count, 0) AS prior_study_count,
  coalesce(prior_completed_count, 0) AS prior_completed_count, coalesce(prior_enrollment_total, 0) AS prior_enrollment_total, round(coalesce(prior_completed_count / nullif(prior_study_count, 0), 0), 6) AS prior_completion_rate,
  papers_before_start, papers_per_year AS papers_per_year_before_start, beneficiaries AS medicare_beneficiaries, services AS medicare_services, payments AS medicare_payments, risk_score AS medicare_risk_score,
  has_usage AS has_medicare, research AS research_payments, general AS general_payments, payors AS payor_count, has_payments, coalesce(h, 0) AS current_h_index, coalesce(c, 0) AS citation_count,
  coalesce(i, 0) AS i10_index, coalesce(n, 0) AS total_papers, n IS NOT NULL AS has_metrics FROM targets t JOIN supplier ON s_suppkey = t.person_id LEFT JOIN history USING (person_id)
  JOIN p USING (study_id, person_id) JOIN m USING (study_id, person_id) JOIN o USING (study_id, person_id) LEFT JOIN r USING (person_id)""")
def pi_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each study and its principal investigators: what was known of them before it."""
    wanted = targets(spark, sf_dir).persist(StorageLevel.DISK_ONLY)  # five sides begin with it
    joined = wanted.join(R.persons(spark, sf_dir).select("person_id", "full_name"), "person_id").join(prior(spark, sf_dir), "person_id", "left")
    joined = joined.join(research_metrics(spark, sf_dir), "person_id", "left")
    for side in (papers_before_start, usage_until, payments_until):
        joined = joined.join(side(spark, sf_dir, wanted), ["study_id", "person_id"])
    rate = F.try_divide(F.col("prior_completed_count").cast("double"), F.col("prior_study_count"))
    rounded = joined.withColumns({"prior_completion_rate": F.round(rate, 6), "papers_per_year": F.round("papers_per_year", 6), "risk_score": F.round("risk_score", 6)})
    missing = lambda c: F.lit(False) if c.startswith("has_") else F.lit(0)
    features = [F.coalesce(F.col(c), missing(name)).alias(name) for name, c in FEATURES.items()]
    return rounded.select(F.col("study_id").alias("study_nct_id"), "person_id", "full_name", F.col("status").alias("overall_status"), (F.col("status") == "COMPLETED").cast("int").alias("label"), *features)


@query("""WITH b AS (SELECT *, count(*) OVER (PARTITION BY o_custkey) AS batch_size, bool_or(o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS resolved FROM orders)
  SELECT o_custkey AS person_id, o_orderkey AS number, batch_size, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS approved FROM b WHERE resolved""")
def npi_candidates_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = Window.partitionBy("o_custkey")
    approved = F.col("o_orderstatus") == "F"
    marked = R.table(spark, sf_dir, "orders").withColumn("batch_size", F.count("*").over(batch)).withColumn("resolved", F.bool_or(approved).over(batch)).where("resolved")
    return marked.select(F.col("o_custkey").alias("person_id"), F.col("o_orderkey").alias("number"), "batch_size", approved.cast("int").alias("approved"))
