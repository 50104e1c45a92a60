"""Upkeep of the registry: batches, sources and logs, the queue's care, the tree's roots, matching reviews and what people are shown."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead.functions import display as D
from loomstead.operators import assembly as A
from loomstead.operators import filters as L
from loomstead.operators import hierarchy as H
from loomstead.operators import queue as Q
from loomstead.operators import upsert as U
from loomstead.operators.resolution import resolve
from loomstead.plans import roles as R
from loomstead.plans.cleaning import SIMILAR_SQL, neighbours
from loomstead.plans.people import CANDIDATES_SQL, CERTAIN, MATCHES, RESOLVED_SQL, candidates, compared
from loomstead.plans.registry import query
from loomstead.plans.search import registry
from loomstead.plans.roles import scratch
from loomstead.sources import files
from loomstead.sources import registry as S

# --- searches


@query(f"""{R.WITH} SELECT study_id, status FROM studies s WHERE EXISTS (SELECT 1 FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
  WHERE o_orderkey = s.study_id AND (starts_with('Z' || n_regionkey || '.' || n_nationkey, 'Z1.1') OR starts_with('Z' || n_regionkey || '.' || n_nationkey, 'Z3')))""")
def place_tree_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies at places that lie below nodes of the tree of places."""
    found, nation = registry(spark, sf_dir), R.table(spark, sf_dir, "nation")
    number = F.concat(F.lit("Z"), F.col("n_regionkey").cast("string"), F.lit("."), F.col("n_nationkey").cast("string"))
    found.places = found.places.join(nation.select(F.col("n_name").alias("state"), F.array(number).alias("tree_numbers")), "state")
    return L.apply_filters(found, L.Criteria(place_prefixes=["Z1.1", "Z3"])).select("study_id", "status")


LISTED_SQL = """FROM studies s JOIN orders ON o_orderkey = study_id WHERE (title ILIKE '%low%' OR CAST(study_id AS VARCHAR) ILIKE '%low%') AND status IN ('COMPLETED', 'RECRUITING')
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = study_id AND l_linestatus = 'O')"""


def listed(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = registry(spark, sf_dir)
    made = R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("study_id"), F.col("o_orderdate").alias("created_at"))
    return L.listed(found, "low", "COMPLETED, RECRUITING,", "PHASE_O").join(made, "study_id")


@query(f"{R.WITH} SELECT study_id, title, status {LISTED_SQL} ORDER BY o_orderdate DESC, study_id LIMIT 25 OFFSET 50")
def listed_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third page of a plain list, in the order of titles on the page."""
    return L.sorted_page(L.listed_page(listed(spark, sf_dir), 3, 25), "title").select("study_id", "title", "status")


@query(f"{R.WITH} SELECT count(*) AS n {LISTED_SQL}")
def listed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listed(spark, sf_dir).agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS study_id, o_orderpriority AS priority FROM orders ORDER BY md5(CAST(o_orderkey AS VARCHAR) || ':42'), o_orderkey LIMIT 100")
def random_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A hundred studies at random, the same ones each time."""
    return L.drawn(R.studies(spark, sf_dir).select("study_id", "priority"), "study_id", 100)


@query("SELECT event_id, coalesce(lower(event_type) IN ('incremental', 'full'), false) AS ok FROM (SELECT event_id, CASE event_type WHEN 'view' THEN 'Full' WHEN 'click' THEN 'INCREMENTAL' WHEN 'error' THEN NULL ELSE event_type END AS event_type FROM events)")
def run_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    mode = F.when(kind == "view", "Full").when(kind == "click", "INCREMENTAL").when(kind != "error", kind)
    return R.table(spark, sf_dir, "events").select("event_id", L.run_mode_ok(mode).alias("ok"))


# --- the tree's roots, terms and categories

LETTERED_SQL = """lettered AS (SELECT p_partkey AS descriptor_id, p_name AS name, left(p_type, 1) || replace(p_brand, 'Brand#', '') || '.' || p_size AS tree_number FROM part)"""


def lettered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as descriptors whose paths begin with a letter, as the vocabulary's do."""
    number = F.concat(F.substring("p_type", 1, 1), F.replace("p_brand", F.lit("Brand#"), F.lit("")), F.lit("."), F.col("p_size").cast("string"))
    return R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("descriptor_id"), F.col("p_name").alias("name"), number.alias("tree_number"))


ROOTS_SQL = ", ".join(f"('{k}', '{v}')" for k, v in H.ROOTS.items())


@query(f"""WITH {LETTERED_SQL}, uses AS (SELECT l_partkey AS descriptor_id, count(*) AS u FROM lineitem GROUP BY 1), known AS (SELECT l.*, coalesce(u, 0) AS u FROM lettered l LEFT JOIN uses USING (descriptor_id)),
  roots(node, name) AS (VALUES {ROOTS_SQL}), low AS (SELECT string_split(tree_number, '.')[1] AS node, CAST(sum(u) AS BIGINT) AS n, arg_max(name, u * 10000000 - descriptor_id) AS name, bool_or(u > 0) AS has_children
    FROM known GROUP BY 1 HAVING left(string_split(tree_number, '.')[1], 1) IN (SELECT node FROM roots))
  SELECT 1 AS level, r.node, r.name, CAST(coalesce(sum(u), 0) AS BIGINT) AS n, count(k.descriptor_id) > 0 AS has_children FROM roots r LEFT JOIN known k ON left(tree_number, 1) = r.node GROUP BY ALL
  UNION ALL SELECT 2, node, name, n, has_children FROM low""")
def tree_browse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The roots of the tree and the level below them, with uses."""
    return H.browse(lettered(spark, sf_dir), R.conditions(spark, sf_dir), 0, 2)


@query(f"""WITH {LETTERED_SQL}, own AS (SELECT descriptor_id, upper(trim(name)) AS synonym FROM lettered),
  entries AS (SELECT p_partkey * 2 AS ordinal, p_name AS name, 'C' || p_partkey AS cui FROM part UNION ALL SELECT p_partkey * 2 + 1, p_brand || ' ' || p_type, 'c' || p_partkey FROM part),
  firsts AS (SELECT upper(cui) AS cui, arg_min(upper(trim(name)), ordinal) AS synonym FROM entries GROUP BY 1), owners AS (SELECT cui, min(descriptor_id) AS descriptor_id FROM firsts JOIN own USING (synonym) GROUP BY 1),
  idx AS (SELECT * FROM own UNION SELECT descriptor_id, upper(trim(name)) FROM entries e JOIN owners o ON upper(e.cui) = o.cui),
  hits AS (SELECT DISTINCT l.descriptor_id, l.name FROM lettered l WHERE starts_with(tree_number, 'S') AND (EXISTS (SELECT 1 FROM idx i WHERE i.descriptor_id = l.descriptor_id AND
    (contains(lower(synonym), 'brand#1 sm') OR (len(list_filter(string_split(lower(synonym), ' '), lambda x: starts_with(x, 'brand#1'))) > 0 AND len(list_filter(string_split(lower(synonym), ' '), lambda x: starts_with(x, 'sm'))) > 0)))))
  SELECT h.*, (SELECT count(*) FROM lineitem WHERE l_partkey = descriptor_id) AS n FROM hits h ORDER BY n DESC, name, descriptor_id LIMIT 30""")
def synonym_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Descriptors of a branch by words of their names or synonyms; a part's other name is its brand and type."""
    part, found = R.table(spark, sf_dir, "part"), lettered(spark, sf_dir)
    cui = F.col("p_partkey").cast("string")
    entries = part.select((F.col("p_partkey") * 2).alias("ordinal"), F.col("p_name").alias("name"), F.concat(F.lit("C"), cui).alias("cui")).unionByName(
        part.select((F.col("p_partkey") * 2 + 1).alias("ordinal"), F.concat_ws(" ", "p_brand", "p_type").alias("name"), F.concat(F.lit("c"), cui).alias("cui"))
    )
    return H.search(found, R.conditions(spark, sf_dir), "Brand#1 sm", 30, "S", H.synonym_index(entries, found))


CATEGORY_SQL = "CASE " + " ".join(f"WHEN left(t, 1) = '{k}' THEN '{v}'" for k, v in H.CATEGORIES.items()) + " END"


@query(f"""WITH n AS (SELECT p_partkey AS descriptor_id, ['X' || p_size, CASE WHEN p_size % 7 = 0 THEN 'F03.' || p_size ELSE left(p_type, 1) || p_size END, left(p_name, 1)] AS ts FROM part)
  SELECT descriptor_id, coalesce(list_filter(list_transform(ts, lambda t: CASE WHEN starts_with(t, 'F03') THEN 'disease' ELSE {CATEGORY_SQL} END), lambda x: x IS NOT NULL)[1], 'other') AS category,
    len(list_filter(ts, lambda t: starts_with(t, 'C') OR starts_with(t, 'F03'))) > 0 AS disease FROM n""")
def term_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The category that a term's paths tell, and whether it is a disease."""
    size, first = F.col("p_size").cast("string"), lambda c: F.substring(c, 1, 1)
    second = F.when(F.col("p_size") % 7 == 0, F.concat(F.lit("F03."), size)).otherwise(F.concat(first("p_type"), size))
    terms = R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("descriptor_id"), F.array(F.concat(F.lit("X"), size), second, first("p_name")).alias("ts"))
    return terms.select("descriptor_id", H.category(F.col("ts")).alias("category"), L.disease(F.col("ts")).alias("disease"))


# --- persons

COVERED_SQL = """persons AS (SELECT CASE WHEN c_acctbal > 0 THEN c_custkey END AS number, CASE WHEN c_acctbal < -500 THEN 'not_found' WHEN c_acctbal < -200 THEN 'ambiguous' END AS result FROM customer)"""


@query(f"""WITH {COVERED_SQL} SELECT count(*) AS total, count(number) AS with_number, count(*) FILTER (result = 'not_found') AS not_found, count(*) FILTER (result = 'ambiguous') AS ambiguous,
  count(*) FILTER (number IS NULL AND result IS NULL) AS not_attempted, round_even(count(number) / greatest(count(*), 1) * 100, 1) AS percent FROM persons""")
def npi_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    result = F.when(balance < -500, "not_found").when(balance < -200, "ambiguous")
    return A.coverage(R.table(spark, sf_dir, "customer").select(F.when(balance > 0, F.col("c_custkey")).alias("number"), result.alias("result")), "number", "result")


#: Categories of conditions by the words that tell them, as the parts' names have them.
KINDS = {"mechanics": ["gear", "bolt"], "jewels": ["ring"], "warm": ["hot", "red"]}
KINDS_SQL = " UNION ALL ".join(f"SELECT '{k}' AS category, '{w}' AS word" for k, words in KINDS.items() for w in words)


@query(f"""{R.WITH}, kinds AS ({KINDS_SQL}), c AS (SELECT DISTINCT l_suppkey AS person_id, category FROM lineitem JOIN part ON l_partkey = p_partkey JOIN kinds ON contains(lower(p_name), word) WHERE l_quantity >= 49),
  g AS (SELECT person_id, min(country) AS country FROM (SELECT person_id, CASE WHEN study_id % 3 = 0 THEN ' ' WHEN study_id % 2 = 0 THEN lower(country) ELSE country END AS country
    FROM investigators JOIN places USING (study_id)) WHERE trim(country) <> '' GROUP BY person_id, lower(country))
  SELECT s_suppkey AS person_id, s_name AS full_name, coalesce((SELECT string_agg(category, ',' ORDER BY category) FROM c WHERE c.person_id = s_suppkey), '') AS categories,
    coalesce((SELECT string_agg(country, ',' ORDER BY country) FROM g WHERE g.person_id = s_suppkey), '') AS regions FROM supplier""")
def candidate_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons with the categories of their conditions and the regions of their studies."""
    lines = R.table(spark, sf_dir, "lineitem").where("l_quantity >= 49").join(R.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    study, country = F.col("study_id"), F.col("country")
    spelt = F.when(study % 3 == 0, " ").when(study % 2 == 0, F.lower(country)).otherwise(country)
    where = R.investigators(spark, sf_dir).join(R.places(spark, sf_dir), "study_id").select("person_id", spelt.alias("country"))
    persons = R.persons(spark, sf_dir).select("person_id", "full_name")
    found = A.candidate_signals(persons, lines.select(F.col("l_suppkey").alias("person_id"), F.col("p_name").alias("name")), where, KINDS)
    return found.select("person_id", "full_name", F.array_join("categories", ",").alias("categories"), F.array_join("regions", ",").alias("regions"))


@query("""WITH f AS (SELECT l_suppkey AS person_id, lower(p_type) AS institution, CAST(l_shipdate AS DATE) AS d, l_linenumber = 3 AND l_quantity > 40 AS fresh FROM lineitem JOIN part ON l_partkey = p_partkey
    WHERE l_linenumber <= 2 OR l_linenumber = 3 AND l_quantity > 40),
  m AS (SELECT person_id, institution, count(*) AS n, max(d) AS latest FROM f WHERE person_id IN (SELECT person_id FROM f WHERE fresh) GROUP BY 1, 2)
  SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY n DESC, latest DESC NULLS LAST, institution) = 1""")
def institutions_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main institution of each person of a batch, over stored and new affiliations."""
    lines = R.table(spark, sf_dir, "lineitem").join(R.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    named = F.when(F.col("l_linenumber") == 2, F.lower("p_type")).otherwise(F.col("p_type"))
    rows = lambda which: lines.where(which).select(F.col("l_suppkey").alias("person_id"), named.alias("institution"), F.to_date("l_shipdate").alias("start_date"))
    return A.primary_institutions(rows("l_linenumber <= 2"), rows("l_linenumber = 3 and l_quantity > 40"))


@query(f"""{R.WITH} SELECT DISTINCT person_id, CAST(l_partkey AS VARCHAR) AS pmid FROM investigators JOIN lineitem ON l_orderkey = study_id WHERE role = 'PRINCIPAL_INVESTIGATOR' AND l_discount >= 0.08""")
def own_publications(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The papers cited by the studies that a person leads; lines are citations, some without a number."""
    team = R.investigators(spark, sf_dir).where("role = 'PRINCIPAL_INVESTIGATOR'")
    number = F.when(F.col("l_discount") >= 0.08, F.col("l_partkey").cast("string")).otherwise(" ")
    return A.own_publications(team, R.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("study_id"), number.alias("pmid")))


@query(f"""{R.WITH} SELECT i.person_id, i.study_id, affiliation FROM investigators i JOIN (SELECT DISTINCT l_suppkey AS person_id, p_type AS affiliation FROM lineitem JOIN part ON l_partkey = p_partkey
  WHERE l_quantity >= 50) USING (person_id)""")
def affiliation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each study of a person and each of their affiliations, repeats kept; kinds of parts of large lines are the affiliations."""
    lines = R.table(spark, sf_dir, "lineitem").where("l_quantity >= 50").join(R.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    affiliations = lines.select(F.col("l_suppkey").alias("person_id"), F.col("p_type").alias("affiliation")).distinct()
    return R.investigators(spark, sf_dir).join(affiliations, "person_id").select("person_id", "study_id", "affiliation")


# --- terms


@query("""WITH t AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN p_name ELSE upper(p_name) || ' / ' || p_type END AS name FROM part),
  codes AS (SELECT lower(p_name) AS k, min(p_brand) AS code FROM part WHERE p_size < 5 GROUP BY 1)
  SELECT id, name, coalesce(a.code, b.code, '-') AS code FROM t LEFT JOIN codes a ON lower(name) = a.k LEFT JOIN codes b ON contains(name, ' / ') AND lower(split_part(name, ' / ', 1)) = b.k""")
def term_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The code of each term, or of what stands before a slash."""
    part = R.table(spark, sf_dir, "part")
    name = F.when(F.col("p_partkey") % 2 == 0, F.col("p_name")).otherwise(F.concat(F.upper("p_name"), F.lit(" / "), F.col("p_type")))
    codes = part.where("p_size < 5").groupBy(F.col("p_name").alias("name")).agg(F.min("p_brand").alias("code"))
    return A.with_code(part.select(F.col("p_partkey").alias("id"), name.alias("name")), codes)


@query("SELECT event_id, coalesce(s_suppkey, -1) AS descriptor_id FROM events LEFT JOIN supplier ON 'C' || user_id * 2 = 'C' || s_suppkey")
def cui_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    cui = lambda c: F.concat(F.lit("C"), c.cast("string")).alias("cui")
    known = R.table(spark, sf_dir, "supplier").select(cui(F.col("s_suppkey")), F.col("s_suppkey").alias("descriptor_id"))
    return A.ids_of(R.table(spark, sf_dir, "events").select("event_id", cui(F.col("user_id") * 2)), known, "cui", "descriptor_id").select("event_id", "descriptor_id")


@query(f"""WITH {SIMILAR_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, match_id) AS rank FROM s QUALIFY rank <= 3)
  SELECT 't' || query_id AS term, CASE WHEN max(sim) < 0.9 THEN 't' || query_id ELSE 'v' || arg_max(match_id, -rank) END AS canonical, max(sim) < 0.9 AS is_new,
    string_agg('v' || match_id || '=' || printf('%.4f', sim), ' ' ORDER BY rank) AS alternatives FROM r GROUP BY query_id""")
def normalised_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms by their nearest name, and the three nearest as alternatives."""
    named = lambda sign, c: F.concat(F.lit(sign), F.col(c).cast("string"))
    ranked = neighbours(spark, sf_dir, 3).select(named("t", "query_id").alias("term"), named("v", "match_id").alias("name"), "similarity", "rank")
    shown = F.array_join(F.transform("alternatives", lambda a: F.concat(a["condition"], F.lit("="), F.format_string("%.4f", a["score"]))), " ")
    return A.normalised(ranked, threshold=0.9).select("term", "canonical", "is_new", shown.alias("alternatives"))


REVIEW_SQL = """t AS (SELECT p_partkey AS id, p_brand, p_size, p_name || CASE p_size % 6 WHEN 0 THEN '.' WHEN 1 THEN ' ''x''' WHEN 2 THEN ' E11' WHEN 3 THEN ' 123' WHEN 4 THEN ' 12' ELSE '' END AS item,
  CASE WHEN p_size % 2 = 1 THEN 'condition' WHEN p_type = 'SMALL' THEN 'keyword_remapped' ELSE 'keyword' END AS origin FROM part)"""


@query(f"""WITH {REVIEW_SQL} SELECT id, item, 'A' AS side, '' AS mesh_term, 'accepted' AS notes FROM t
  WHERE NOT (contains(item, '''') OR contains(item, '.') OR regexp_matches(item, '\\b[A-TV-Z][0-9][0-9AB]\\.?[0-9]{{0,4}}\\b|\\b[0-9]{{3}}\\.?[0-9]{{0,2}}\\b'))
  UNION ALL SELECT id, item, 'B', CASE WHEN p_size < 10 THEN '(unmapped)' ELSE p_brand END, CASE WHEN origin = 'condition' THEN 'direct condition' ELSE 'remapped from keyword' END FROM t WHERE origin <> 'keyword'""")
def blind_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms that rules accept beside those that matching maps, for a review of both sides."""
    size = F.col("p_size")
    tail = F.when(size % 6 == 0, ".").when(size % 6 == 1, " 'x'").when(size % 6 == 2, " E11").when(size % 6 == 3, " 123").when(size % 6 == 4, " 12").otherwise("")
    source, category = F.when(size % 2 == 1, "condition").otherwise("keyword"), F.when(F.col("p_type") == "SMALL", "disease").otherwise("other")
    terms = R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.concat("p_name", tail).alias("item"), A.origin(source, category).alias("origin"), F.when(size >= 10, F.col("p_brand")).alias("mesh"))
    left = terms.where(D.condition_ok(F.col("item"))).select("id", "item", F.lit("A").alias("side"), F.lit("").alias("mesh_term"), F.lit("accepted").alias("notes"))
    notes = F.when(F.col("origin") == "condition", "direct condition").otherwise("remapped from keyword")
    right = terms.where("origin <> 'keyword'").select("id", "item", F.lit("B").alias("side"), F.coalesce("mesh", F.lit("(unmapped)")).alias("mesh_term"), notes.alias("notes"))
    return left.unionByName(right).orderBy("id", "side", "item")


#: A stored model: its features in order, with weights that fall from feature to feature.
ORDER = [*CERTAIN, *MATCHES, *(f"has_{m}" for m in MATCHES)]
MODEL = {"features": ORDER, "weights": [round(2 - 0.125 * k, 3) for k in range(len(ORDER))], "bias": -3}
MODEL_SQL = " + ".join(
    [f"{w} * CAST(coalesce({(MATCHES | CERTAIN)[f]}, false) AS INT)" if f in MATCHES | CERTAIN else f"{w} * CAST({MATCHES[f[4:]]} IS NOT NULL AS INT)" for f, w in zip(MODEL["features"], MODEL["weights"], strict=True)]
)


@query(f"WITH {CANDIDATES_SQL} SELECT person_id, number, round(1 / (1 + exp(-(({MODEL_SQL})::DOUBLE - 3))), 6) AS probability FROM compared")
def model_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stored model of twenty-one features says of each candidate."""
    told = A.scored_by(MODEL, A.model_vector(MATCHES, CERTAIN))
    return compared(spark, sf_dir).select("person_id", "number", F.round(told, 6).alias("probability"))


@query(f"""WITH {RESOLVED_SQL}, shown AS (SELECT c.*, c_name AS full_name, r.number IS NOT DISTINCT FROM c.number AS chosen FROM scored c JOIN resolved r USING (person_id) JOIN customer ON c_custkey = c.person_id JOIN orders ON o_orderkey = c.number
    WHERE outcome = 'Assigned' AND CAST(o_orderdate AS DATE) BETWEEN DATE '1995-01-01' AND DATE '1996-12-31')
  SELECT person_id, full_name, count(*) OVER (PARTITION BY person_id) AS batch_size, {", ".join(f"CAST(coalesce({c}, false) AS INT) AS {m}" for m, c in (CERTAIN | MATCHES).items())},
    {", ".join(f"CAST({c} IS NOT NULL AS INT) AS has_{m}" for m, c in MATCHES.items())}, round(score, 6) AS rule_score, CAST(chosen AS INT) AS label FROM shown""")
def npi_training_frame(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidates of persons whose number is assigned, those made within a window: features as a model takes them, and whether each was the one."""
    found = candidates(spark, sf_dir)
    assigned = resolve(found).where("outcome = 'Assigned'").select("person_id", F.col("number").alias("chosen"))
    made = R.table(spark, sf_dir, "orders").where("to_date(o_orderdate) between date'1995-01-01' and date'1996-12-31'").select(F.col("o_orderkey").alias("number"))
    names = R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("full_name"))
    shown = found.join(made, "number", "left_semi").join(assigned, "person_id").join(names, "person_id")
    size = F.count("*").over(Window.partitionBy("person_id"))
    vector = [c.cast("int").alias(name) for name, c in A.model_vector(MATCHES, CERTAIN).items()]
    return shown.select("person_id", "full_name", size.alias("batch_size"), *vector, F.round("score", 6).alias("rule_score"), F.col("number").eqNullSafe(F.col("chosen")).cast("int").alias("label"))


# --- the queue's care

NOW = "2024-01-20 00:00:00"
CARE_SQL = """care AS (SELECT event_id AS id, user_id AS worker, ts AS created_at, k, CASE event_type WHEN 'view' THEN 'studies.discovered' WHEN 'purchase' THEN 'studies.backfill' ELSE event_type END AS event_type,
  CASE WHEN k % 5 < 2 THEN 'pending' WHEN k % 5 = 2 THEN 'processing' WHEN k % 5 = 3 THEN 'completed' ELSE 'dead-letter' END AS status, CASE WHEN k % 3 = 0 THEN ts + INTERVAL 10 MINUTE END AS last_error_at
  FROM (SELECT *, CAST(regexp_extract(props, '[0-9]+') AS BIGINT) AS k FROM events))"""


def care(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as work: the number in their properties tells the payload, the status and the retries."""
    k, kind = F.regexp_extract("props", "[0-9]+", 0).cast("long"), F.col("event_type")
    events = R.table(spark, sf_dir, "events").withColumn("k", k)
    k = F.col("k")
    data = F.when(k % 10 == 9, "broken").when(k >= 50, F.format_string('{"count":%d,"from":"2024-01-01","to":"2024-01-02"}', k)).otherwise(F.format_string('{"count":%d}', k))
    return events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("worker"), F.col("ts").alias("created_at"), "k", data.alias("data"),
        F.when(kind == "view", "studies.discovered").when(kind == "purchase", "studies.backfill").otherwise(kind).alias("event_type"),
        F.when(k % 5 < 2, "pending").when(k % 5 == 2, "processing").when(k % 5 == 3, "completed").otherwise("dead-letter").alias("status"),
        F.when(k % 3 == 0, F.col("ts") + F.expr("interval 10 minutes")).alias("last_error_at"), (k % 4).cast("int").alias("retry_count"),
        F.when(k % 5 == 2, F.col("ts")).alias("claimed_at"), F.lit(None).cast("timestamp_ntz").alias("completed_at"), F.lit(None).cast("string").alias("error"),
    )


@query(f"""WITH {CARE_SQL}, o AS (SELECT *, event_type = 'studies.discovered' AND status IN ('pending', 'processing') AND k < 50 AND k % 10 <> 9 AS old FROM care)
  SELECT id, CASE WHEN old THEN 'completed' ELSE status END AS status, CASE WHEN old THEN '{Q.SUPERSEDED}' END AS error, NOT old AND status = 'processing' AS claimed FROM o""")
def legacy_recovery(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after its discoveries without a window are closed."""
    found = Q.recover(care(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"))
    return found.select("id", "status", "error", F.col("claimed_at").isNotNull().alias("claimed"))


@query(f"""WITH {CARE_SQL} SELECT worker, id, event_type FROM care WHERE status = 'pending' AND event_type IN ('studies.discovered', 'studies.backfill')
  AND (last_error_at IS NULL OR last_error_at + INTERVAL 1 SECOND * (CASE k % 4 WHEN 0 THEN 0 WHEN 1 THEN 30 WHEN 2 THEN 120 ELSE 600 END) <= TIMESTAMP '{NOW}')
  QUALIFY row_number() OVER (PARTITION BY worker ORDER BY event_type = 'studies.backfill', created_at, id) = 1""")
def dispatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each worker takes next."""
    return Q.dispatched(care(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz"), ["worker"]).select("worker", "id", "event_type")


@query("""SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS expected, count(*) FILTER (o_orderstatus <> 'P') AS ingested,
  CASE WHEN count(*) FILTER (o_orderstatus <> 'P') < count(*) THEN 'Ingested ' || count(*) FILTER (o_orderstatus <> 'P') || ' of ' || count(*) || ' studies' END AS fault FROM orders GROUP BY 1""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days whose studies did not all arrive; those of status P are the missing ones."""
    days = R.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("expected"), F.count_if(F.col("o_orderstatus") != "P").alias("ingested"))
    return days.withColumn("fault", Q.completeness(F.col("expected"), F.col("ingested")))


@query("""SELECT unnest(['investigator.discovered', 'medicare.utilization', 'cms.openpayments']) AS event_type, CAST(o_orderkey AS VARCHAR) AS data, 'pending' AS status FROM orders WHERE o_orderstatus = 'F'
  UNION ALL SELECT 'investigator.metrics', CAST(o_orderkey AS VARCHAR), 'pending' FROM orders WHERE o_orderstatus = 'O'""")
def enrichment_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = F.col("o_orderstatus")
    outcome = F.when(status == "F", "assigned").when(status == "O", "scrubbed").otherwise("ambiguous")
    return Q.fan_out(R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("person_id"), outcome.alias("outcome")))


@query("""WITH c AS (SELECT user_id AS source, event_id AS seq, CASE event_type WHEN 'click' THEN 'status' WHEN 'error' THEN 'status' WHEN 'view' THEN 'schedule' WHEN 'purchase' THEN 'request' ELSE 'consume' END AS command,
    CASE event_type WHEN 'click' THEN CASE WHEN value < 20 THEN 'idle' ELSE 'running' END WHEN 'error' THEN 'failed' WHEN 'view' THEN props WHEN 'purchase' THEN 'full' END AS v, CASE event_type WHEN 'error' THEN props END AS error FROM events)
  SELECT source, list(v ORDER BY seq DESC) FILTER (command = 'status')[1] AS status, list(error ORDER BY seq DESC) FILTER (command = 'status' AND (error IS NOT NULL OR v = 'idle'))[1] AS error,
    list(v ORDER BY seq DESC) FILTER (command = 'schedule')[1] AS next_run, list(CASE WHEN command = 'request' THEN v END ORDER BY seq DESC) FILTER (command IN ('request', 'consume'))[1] AS manual_mode FROM c GROUP BY source""")
def source_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each source after all that was asked of it."""
    kind, told = F.col("event_type"), lambda c, name: F.when(kind == name, c)
    command = F.when(kind.isin("click", "error"), "status").when(kind == "view", "schedule").when(kind == "purchase", "request").otherwise("consume")
    value = F.when(kind == "click", F.when(F.col("value") < 20, "idle").otherwise("running")).when(kind == "error", "failed").when(kind == "view", F.col("props")).when(kind == "purchase", "full")
    return Q.source_states(R.table(spark, sf_dir, "events").select(F.col("user_id").alias("source"), F.col("event_id").alias("seq"), command.alias("command"), value.alias("value"), told(F.col("props"), "error").alias("error")))


# --- what people are shown


@query(f"""SELECT o_orderkey AS study_id, CASE o_orderpriority WHEN '1-URGENT' THEN 'Early Phase 1, Phase 1' WHEN '2-HIGH' THEN 'Phase 2, OTHER' WHEN '5-LOW' THEN '' ELSE 'None' END AS phases,
  CASE WHEN ms <= 0 THEN '--' WHEN ms < 60000 THEN '~' || floor(ms / 1000)::BIGINT || 's' ELSE '~' || floor(ms / 60000)::BIGINT || 'm ' || floor(ms / 1000)::BIGINT % 60 || 's' END AS lasts,
  CASE WHEN length(o_orderpriority) > 6 THEN left(o_orderpriority, 6) || '...' ELSE o_orderpriority END AS short, strftime(o_orderdate, '%Y-%m-%d %H:%M UTC') AS at FROM (SELECT *, o_totalprice - 30000 AS ms FROM orders)""")
def shown_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    values = F.when(priority == "1-URGENT", F.array(F.lit("EARLY_PHASE1"), F.lit("PHASE1"))).when(priority == "2-HIGH", F.array(F.lit("PHASE2"), F.lit("OTHER"))).when(priority == "5-LOW", F.array().cast("array<string>"))
    return R.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("study_id"), D.phases(values).alias("phases"), D.duration(F.col("o_totalprice") - 30000).alias("lasts"), D.shortened(priority, 6).alias("short"), D.moment(F.col("o_orderdate")).alias("at")
    )


@query("""WITH i AS (SELECT o_custkey, list_sort(list('NCT' || o_orderkey)) AS ids FROM orders GROUP BY 1)
  SELECT c_custkey AS sponsor_id, left(CASE WHEN ids IS NULL THEN '' WHEN len(ids) = 1 THEN ids[1] ELSE ids[1] || ' ... ' || ids[-1] END, 200) AS ids FROM customer LEFT JOIN i ON o_custkey = c_custkey""")
def id_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The range of each sponsor's ids; the first and the last come from their minimum and maximum, so no list is gathered."""
    name = F.concat(F.lit("NCT"), F.col("o_orderkey").cast("string"))
    ends = R.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min(name).alias("a"), F.max(name).alias("b"))
    ids = F.when(F.col("a").isNull(), F.array().cast("array<string>")).otherwise(F.array_distinct(F.array("a", "b")))
    joined = R.table(spark, sf_dir, "customer").select("c_custkey").join(ends, "c_custkey", "left")
    return joined.select(F.col("c_custkey").alias("sponsor_id"), D.id_range(ids).alias("ids"))


@query("""SELECT c_custkey AS id, CASE WHEN c_acctbal > 0 THEN '[{"first_name":"' || split_part(c_name, '#', 1) || '","last_name":"' || split_part(c_name, '#', 2) || '"},{"last_name":"' || c_mktsegment || '"}]' END AS text,
  CASE WHEN c_acctbal > 0 THEN split_part(c_name, '#', 2) || ',' || c_mktsegment ELSE '' END AS last_names FROM customer""")
def other_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Other names as JSON, and read back from it."""
    part = lambda k: F.split_part("c_name", F.lit("#"), F.lit(k))
    name = lambda first, last: F.struct(first.alias("first_name"), last.alias("last_name"))
    names = F.when(F.col("c_acctbal") > 0, F.array(name(part(1), part(2)), name(F.lit(None).cast("string"), F.col("c_mktsegment"))))
    rows = R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), D.names_json(names).alias("text"))
    return rows.withColumn("last_names", F.array_join(F.transform(D.names_from(F.col("text")), lambda n: n["last_name"]), ","))


@query("""SELECT person_id, string_agg(flag || ':' || n, ' ' ORDER BY n DESC, flag) AS rates FROM (SELECT l_suppkey AS person_id, l_returnflag || l_linestatus AS flag, count(*) AS n FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def rates_by_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A person's conditions, the most frequent first."""
    counts = R.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("person_id"), F.concat("l_returnflag", "l_linestatus").alias("flag")).agg(F.count("*").alias("n"))
    maps = counts.groupBy("person_id").agg(F.map_from_entries(F.collect_list(F.struct("flag", "n"))).alias("m"))
    return maps.select("person_id", F.array_join(F.transform(D.by_value(F.col("m")), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), " ").alias("rates"))


# --- sources and sinks


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies as nested pages in JSON, a page a sponsor, written and read again."""
    lines = R.table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("study_id")).agg(F.collect_set(F.concat(F.lit(" flag "), "l_returnflag")).alias("keywords"))
    one = lambda value, name: F.struct(value.alias(name))
    day = F.date_format("start_date", "yyyy-MM-dd")
    protocol = F.struct(
        F.struct(F.concat(F.lit("NCT"), F.col("study_id").cast("string")).alias("nctId"), F.col("title").alias("briefTitle")).alias("identificationModule"),
        F.struct(F.col("status").alias("overallStatus"), one(F.substring(day, 1, 7), "date").alias("startDateStruct"), one(day, "date").alias("lastUpdatePostDateStruct")).alias("statusModule"),
        F.struct(F.array("priority", F.lit(" ")).alias("conditions"), F.col("keywords")).alias("conditionsModule"),
        F.struct(one(F.col("enrollment"), "count").alias("enrollmentInfo")).alias("designModule"),
        F.struct(F.array(one(F.concat(F.lit("drug "), (F.col("study_id") % 50).cast("string")), "name")).alias("interventions")).alias("armsInterventionsModule"),
    )
    studies = R.studies(spark, sf_dir).join(lines, "study_id", "left")
    found = studies.groupBy("sponsor_id", (F.col("study_id") % 16).alias("part")).agg(F.collect_list(one(protocol, "protocolSection")).alias("studies"))  # a sponsor's pages stay small
    path = scratch(spark, "pages")
    found.select(F.to_json(F.struct("studies")).alias("value")).write.text(path)
    return S.read_pages(spark, path, lines=True)


@query(f"""{R.WITH} SELECT 'NCT' || study_id AS nct_id, title, status, CAST(date_trunc('month', start_date) AS DATE) AS start_date, enrollment,
  (SELECT count(DISTINCT l_returnflag) FROM lineitem WHERE l_orderkey = study_id) AS n_keywords FROM studies""")
def registry_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies from nested pages; a start without a day is the first of its month."""
    found = S.flatten_studies(pages(spark, sf_dir))
    return found.select("nct_id", "title", "status", "start_date", "enrollment", F.coalesce(F.size("keywords"), F.lit(0)).cast("long").alias("n_keywords"))


@query("SELECT count(*) AS n FROM orders WHERE CAST(o_orderdate AS DATE) BETWEEN DATE '1996-01-15' AND DATE '1997-03-01'")
def registry_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many studies of the pages were updated in a window."""
    return S.count_updated(pages(spark, sf_dir), "1996-01-15", "1997-03-01")


@query("""SELECT o_orderpriority AS term FROM orders UNION SELECT 'drug ' || o_orderkey % 50 FROM orders UNION SELECT 'flag ' || l_returnflag FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders)""")
def registry_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct conditions, keywords and interventions of the pages."""
    return S.page_terms(S.flatten_studies(pages(spark, sf_dir)))


@query("SELECT 'D' || p_partkey AS cui, p_name AS name, 'B' || p_size AS numbers, p_name || '|' || p_brand || '|' || p_type AS synonyms FROM part")
def vocabulary_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The vocabulary as XML, written and read again: the preferred concept comes first, and each synonym once."""
    string = lambda c: F.struct(F.col(c).alias("String"))
    concept = lambda name, yes, *terms: F.struct(string(name).alias("ConceptName"), F.lit(yes).alias("ConceptPreferredNameYN"), F.struct(F.array(*map(string, terms)).alias("Term")).alias("TermList"))
    records = R.table(spark, sf_dir, "part").select(
        F.concat(F.lit("D"), F.col("p_partkey").cast("string")).alias("DescriptorUI"), string("p_name").alias("DescriptorName"),
        F.struct(F.array(F.concat(F.lit("B"), F.col("p_size").cast("string"))).alias("TreeNumber")).alias("TreeNumberList"),
        F.struct(F.array(concept("p_brand", "N", "p_type", "p_name"), concept("p_name", "Y", "p_name")).alias("Concept")).alias("ConceptList"),
    )
    path = scratch(spark, "vocabulary")
    S.write_vocabulary(records, path)
    found = S.vocabulary_records(spark, path)
    return found.select("cui", "name", F.array_join("tree_numbers", "|").alias("numbers"), F.array_join("synonyms", "|").alias("synonyms"))


@query("SELECT n_name AS nation, CAST(count(c_custkey) AS VARCHAR) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY 1 UNION ALL SELECT '# nations', CAST(count(*) AS VARCHAR) FROM nation")
def report_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A report in TSV with a figure at its end, written and read again."""
    nation = R.table(spark, sf_dir, "nation")
    counts = nation.join(R.table(spark, sf_dir, "customer"), F.col("c_nationkey") == F.col("n_nationkey"), "left").groupBy(F.col("n_name").alias("nation")).agg(F.count("c_custkey").alias("customers"))
    path = scratch(spark, "report")
    files.write_report(counts, {"# nations": nation.count()}, path)
    return spark.read.schema("nation string, customers string").options(header=True, sep="\t").csv(path)


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def event_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log that two writers add to, a folder a day."""
    events, path = R.table(spark, sf_dir, "events").withColumn("day", F.to_date("ts")), scratch(spark, "log")
    U.append_log(events.where("event_type = 'error'"), path, "day")
    U.append_log(events.where("event_type <> 'error'"), path, "day")
    return spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(f"""{R.WITH}, sides AS (SELECT study_id, start_date < DATE '1996-01-01' AS old, start_date >= DATE '1995-01-01' AS new, status FROM studies)
  SELECT study_id, coalesce(CASE WHEN new THEN status END, CASE WHEN old THEN 'OLD' END) AS status, new AS seen, (SELECT count(*) FROM lineitem WHERE l_orderkey = study_id AND (new OR l_linenumber <= 2)) AS children FROM sides""")
def batch_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies of before 1996 with two lines each, after a batch of those from 1995 on with all lines."""
    studies, lines = R.studies(spark, sf_dir), R.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("study_id"), "l_linenumber")
    studies, lines = U.dealt({"studies": studies, "lines": lines}, "study_id").values()
    old, new = studies.where("start_date < date'1996-01-01'"), studies.where("start_date >= date'1995-01-01'")
    stored = {"studies": old.select("study_id", F.lit("OLD").alias("status"), F.lit(None).cast("date").alias("last_seen")), "lines": lines.where("l_linenumber <= 2").join(old, "study_id", "left_semi")}
    after = U.merge_batch(stored, {"studies": new.select("study_id", "status"), "lines": lines.join(new, "study_id", "left_semi")}, "study_id", F.lit(R.AS_OF).cast("date"))
    counts = after["lines"].groupBy("study_id").agg(F.count("*").alias("children"))
    return after["studies"].join(counts, "study_id", "left").select("study_id", "status", F.col("last_seen").isNotNull().alias("seen"), F.coalesce("children", F.lit(0)).alias("children"))
