"""Exports, reviews, and the reports around ingestion."""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead.functions import text as T
from loomstead.functions.dates import month_chunks
from loomstead.operators import filters as L
from loomstead.operators import hierarchy as H
from loomstead.operators import trigrams as G
from loomstead.plans import roles as R
from loomstead.plans.registry import query
from loomstead.sources.files import csv_lines


@query("""SELECT 'k:' || p_type AS value, 'keyword' AS kind, 1 AS label FROM part WHERE p_size > 25 UNION ALL SELECT 'k:' || p_brand, 'keyword', 0 FROM part WHERE p_size <= 25
  UNION ALL SELECT s_name, 'name', 1 FROM supplier UNION ALL SELECT c_name, 'name', 0 FROM customer WHERE c_acctbal < 0
  UNION ALL SELECT coalesce(p_name, ''), 'condition', 1 FROM (SELECT DISTINCT l_partkey FROM lineitem) LEFT JOIN part ON l_partkey = p_partkey
  UNION ALL SELECT c_mktsegment, 'affiliation', CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END FROM customer""")
def training_exports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four labelled exports in one table: accepted and rejected keywords, names, conditions and affiliations."""
    t = lambda name: R.table(spark, sf_dir, name)
    part, customer = t("part"), t("customer")
    row = lambda df, value, kind, label: df.select(value.alias("value"), F.lit(kind).alias("kind"), (label if not isinstance(label, int) else F.lit(label)).alias("label"))
    used = t("lineitem").select("l_partkey").distinct().join(part, F.col("l_partkey") == F.col("p_partkey"), "left")
    parts = [
        row(part.where("p_size > 25"), F.concat(F.lit("k:"), "p_type"), "keyword", 1), row(part.where("p_size <= 25"), F.concat(F.lit("k:"), "p_brand"), "keyword", 0),
        row(t("supplier"), F.col("s_name"), "name", 1), row(customer.where("c_acctbal < 0"), F.col("c_name"), "name", 0), row(used, F.coalesce("p_name", F.lit("")), "condition", 1),
        row(customer, F.col("c_mktsegment"), "affiliation", (F.col("c_acctbal") > 0).cast("int")),
    ]
    whole = parts[0]
    for p in parts[1:]:
        whole = whole.unionByName(p)
    return whole


@query("""SELECT '"' || c_name || '",' || c_custkey || ',' || CASE WHEN c_acctbal = floor(c_acctbal) THEN CAST(CAST(c_acctbal AS BIGINT) AS VARCHAR) ELSE rtrim(printf('%.6f', c_acctbal), '0') END || ',' ||
  CASE WHEN c_acctbal > 0 THEN '1' ELSE '0' END AS value FROM customer""")
def csv_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = R.table(spark, sf_dir, "customer")
    return csv_lines(customer.select("c_name", "c_custkey", "c_acctbal", (F.col("c_acctbal") > 0).alias("positive")))


@query("""SELECT o_orderkey AS id, '{"id":' || o_orderkey || ',"status":' || CASE o_orderstatus WHEN 'F' THEN '"COMPLETED"' WHEN 'O' THEN '"RECRUITING"' ELSE 'null' END || ',"team":[' ||
  coalesce((SELECT string_agg(DISTINCT CAST(l_suppkey AS VARCHAR), ',' ORDER BY CAST(l_suppkey AS VARCHAR)) FROM lineitem WHERE l_orderkey = o_orderkey), '') || ']}' AS document FROM orders""")
def json_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested documents with nulls written out."""
    team = R.investigators(spark, sf_dir).groupBy("study_id").agg(F.array_sort(F.collect_set(F.col("person_id").cast("string"))).alias("team"))
    studies = R.studies(spark, sf_dir).join(team, "study_id", "left")
    numbers = F.transform(F.coalesce("team", F.array().cast("array<string>")), lambda x: x.cast("long"))
    shape = F.struct(F.col("study_id").alias("id"), "status", numbers.alias("team"))
    return studies.select(F.col("study_id").alias("id"), F.to_json(shape, {"ignoreNullFields": "false"}).alias("document"))


@query("""SELECT c_custkey AS id, c_name AS name, c_mktsegment AS reason FROM customer WHERE c_mktsegment = 'BUILDING' AND contains(c_name, '7') AND c_acctbal > 0
  ORDER BY c_acctbal DESC, c_custkey LIMIT 50 OFFSET 10""")
def rejected_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of rejected entities: equal reason, affiliation that contains a text as it is, the latest first."""
    found = L.equal_to(R.table(spark, sf_dir, "customer"), c_mktsegment="BUILDING", c_name=" ").where(F.contains("c_name", F.lit("7")) & (F.col("c_acctbal") > 0))
    return found.orderBy(F.desc("c_acctbal"), "c_custkey").offset(10).limit(50).select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("reason"))


@query("SELECT event_id, value FROM events WHERE event_type = 'view' ORDER BY CAST(ts AS DATE) DESC, value DESC, event_id LIMIT 100")
def rejected_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return L.equal_to(R.table(spark, sf_dir, "events"), event_type="view").orderBy(F.desc(F.to_date("ts")), F.desc("value"), "event_id").limit(100).select("event_id", "value")


@query("""SELECT s_suppkey AS person_id, s_name AS full_name, count(DISTINCT l_orderkey) AS n_studies FROM supplier LEFT JOIN lineitem ON l_suppkey = s_suppkey
  WHERE s_acctbal > 0 AND s_name ILIKE '%1%' GROUP BY 1, 2 ORDER BY full_name, person_id LIMIT 25""")
def investigators_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page of persons, cut before their studies are counted."""
    shown = R.persons(spark, sf_dir).where((F.col("s_acctbal") > 0) & F.ilike("full_name", F.lit("%1%"))).orderBy("full_name", "person_id").limit(25).select("person_id", "full_name")
    team = R.table(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("person_id"), "l_orderkey")
    counts = team.join(F.broadcast(shown.select("person_id")), "person_id", "left_semi").groupBy("person_id").agg(F.count_distinct("l_orderkey").alias("n_studies"))
    return shown.join(counts, "person_id", "left").select("person_id", "full_name", F.coalesce("n_studies", F.lit(0)).alias("n_studies"))


@query("""WITH j AS (SELECT lower(c_mktsegment) AS k, c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'OrgKeywords' WHEN c_custkey % 3 = 1 THEN 'Ampersand' END AS reason FROM customer)
  SELECT reason, count(*) AS names, count(DISTINCT o_orderkey) AS studies FROM j LEFT JOIN orders ON o_custkey = c_custkey WHERE reason IS NOT NULL GROUP BY 1""")
def rejected_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names by the reason of their rejection, with rows counted over the studies that they touch."""
    key = F.col("c_custkey")
    reason = F.when(key % 3 == 0, "OrgKeywords").when(key % 3 == 1, "Ampersand")
    judged = R.table(spark, sf_dir, "customer").select(key, reason.alias("reason")).where("reason IS NOT NULL")
    joined = judged.join(R.table(spark, sf_dir, "orders"), F.col("o_custkey") == key, "left")
    return joined.groupBy("reason").agg(F.count("*").alias("names"), F.count_distinct("o_orderkey").alias("studies"))


@query(f"""{R.WITH} SELECT descriptor_id, array_to_string(string_split(tree_number, '.')[1:k], '.') AS tree_number, k AS depth FROM descriptors, range(1, 4) r(k)""")
def tree_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = R.descriptors(spark, sf_dir).select("descriptor_id", F.posexplode(H.ancestors(F.col("tree_number"))).alias("k", "tree_number"))
    return rows.select("descriptor_id", "tree_number", (F.col("k") + 1).cast("long").alias("depth"))


@query("""WITH g AS (SELECT r_name AS name, 'Z' || r_regionkey AS z FROM region UNION ALL SELECT n_name, 'Z' || n_regionkey || '.' || n_nationkey FROM nation),
  p AS (SELECT c_custkey AS id, CASE WHEN c_custkey % 3 = 0 THEN r_name WHEN c_custkey % 3 = 1 THEN 'nowhere' ELSE left(r_name, 4) END AS country, CASE WHEN c_custkey % 2 = 0 THEN n_name ELSE '?' END AS state
    FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  SELECT id, coalesce((SELECT min(z) FROM g WHERE lower(name) = lower(country)), (SELECT min(z) FROM g WHERE lower(name) = lower(state)),
    (SELECT arg_min(z, name) FROM g WHERE contains(lower(name), lower(country)) OR contains(lower(country), lower(name)))) AS node FROM p""")
def geo_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A place's node by its country's name, else its state's, else by a name that holds the other; places with equal names are looked up once."""
    region, nation = R.table(spark, sf_dir, "region"), R.table(spark, sf_dir, "nation")
    nodes = region.select(F.col("r_name").alias("name"), F.concat(F.lit("Z"), F.col("r_regionkey").cast("string")).alias("z")).unionByName(
        nation.select(F.col("n_name").alias("name"), F.concat(F.lit("Z"), F.col("n_regionkey").cast("string"), F.lit("."), F.col("n_nationkey").cast("string")).alias("z"))
    )
    key = F.col("c_custkey")
    joined = R.table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).join(region, F.col("n_regionkey") == F.col("r_regionkey"))
    country = F.when(key % 3 == 0, F.col("r_name")).when(key % 3 == 1, "nowhere").otherwise(F.substring("r_name", 1, 4))
    rows = joined.select(key.alias("id"), country.alias("country"), F.when(key % 2 == 0, F.col("n_name")).otherwise("?").alias("state"))
    exact = nodes.groupBy(F.lower("name").alias("k")).agg(F.min("z").alias("z"))
    countries, names = rows.select("country").distinct(), nodes.select("name").distinct()
    within = G.holding(names, countries, "name", "name", "country").unionByName(G.holding(countries, names, "country", "country", "name").select(F.col("country").alias("term"), F.col("term").alias("name")))
    inside = within.join(nodes, "name").groupBy(F.col("term").alias("country")).agg(F.min_by("z", "name").alias("inside"))
    found = rows.join(exact.select(F.col("k").alias("ck"), F.col("z").alias("by_country")), F.lower("country") == F.col("ck"), "left")
    found = found.join(exact.select(F.col("k").alias("sk"), F.col("z").alias("by_state")), F.lower("state") == F.col("sk"), "left").join(inside, "country", "left")
    return found.select("id", F.coalesce("by_country", "by_state", "inside").alias("node"))


@query("""WITH f AS (SELECT p_partkey AS person_id, p_type AS region, p_brand AS category FROM part)
  SELECT region AS name, count(*) AS n_rows, count(DISTINCT category) AS n_categories, string_agg(DISTINCT category, ',' ORDER BY category) AS categories FROM f GROUP BY 1""")
def candidate_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    grouped = R.table(spark, sf_dir, "part").groupBy(F.col("p_type").alias("name")).agg(F.count("*").alias("n_rows"), F.collect_set("p_brand").alias("c"))
    return grouped.select("name", "n_rows", F.size("c").cast("long").alias("n_categories"), F.array_join(F.array_sort("c"), ",").alias("categories"))


@query(f"""{R.WITH} SELECT person_id, study_id, status, (SELECT count(DISTINCT descriptor_id) FROM conditions c WHERE c.study_id = s.study_id) AS n_conditions,
  (SELECT min(country) FROM places p WHERE p.study_id = s.study_id) AS country FROM (SELECT DISTINCT person_id, study_id FROM investigators WHERE role = 'PRINCIPAL_INVESTIGATOR') JOIN studies s USING (study_id)""")
def person_study_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = R.investigators(spark, sf_dir).where("role = 'PRINCIPAL_INVESTIGATOR'").select("person_id", "study_id").distinct()
    counts = R.conditions(spark, sf_dir).groupBy("study_id").agg(F.count_distinct("descriptor_id").alias("n"))
    countries = R.places(spark, sf_dir).groupBy("study_id").agg(F.min("country").alias("country"))
    joined = led.join(R.studies(spark, sf_dir), "study_id").join(counts, "study_id", "left").join(countries, "study_id", "left")
    return joined.select("person_id", "study_id", "status", F.coalesce("n", F.lit(0)).alias("n_conditions"), "country")


@query("""SELECT count(DISTINCT p_name) AS raw_terms, count(DISTINCT p_type) AS disease_terms, count(DISTINCT p_brand || p_type) AS codes, count(DISTINCT l_partkey) AS used FROM part LEFT JOIN lineitem ON l_partkey = p_partkey""")
def report_cardinalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, used = R.table(spark, sf_dir, "part"), R.table(spark, sf_dir, "lineitem")
    terms = part.agg(F.count_distinct("p_name").alias("raw_terms"), F.count_distinct("p_type").alias("disease_terms"), F.count_distinct(F.concat("p_brand", "p_type")).alias("codes"))
    return terms.join(F.broadcast(used.join(part, F.col("l_partkey") == F.col("p_partkey")).agg(F.count_distinct("l_partkey").alias("used"))))


@query("""SELECT l_suppkey AS person_id, string_agg(l_returnflag || ':' || CAST(n AS VARCHAR), ';' ORDER BY l_returnflag) AS rates FROM
  (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2) WHERE n >= 150 GROUP BY 1""")
def rate_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A map of conditions to rates for each person, those that are missing left out."""
    counts = R.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("person_id")).pivot("l_returnflag", ["A", "N", "R"]).count()
    whole = F.create_map(*(x for f in ("A", "N", "R") for x in (F.lit(f), F.when(F.col(f) >= 150, F.col(f)))))
    filled = F.map_filter(whole, lambda k, v: v.isNotNull())
    shown = F.array_join(F.transform(F.array_sort(F.map_entries(filled)), lambda e: F.concat(e["key"], F.lit(":"), e["value"].cast("string"))), ";")
    return counts.where(F.size(filled) > 0).select("person_id", shown.alias("rates"))


#: Studies that a window of a backfill may hold.
WINDOW_STUDIES = 100


@query(f"""WITH RECURSIVE d AS (SELECT CAST(o_orderdate AS DATE) AS day, count(*) AS n FROM orders GROUP BY 1),
  c AS (SELECT CAST(g AS DATE) AS day, sum(coalesce(n, 0)) OVER (ORDER BY g) AS upto
    FROM (SELECT unnest(generate_series(min(day)::TIMESTAMP - INTERVAL 1 DAY, max(day)::TIMESTAMP, INTERVAL 1 DAY)) AS g FROM d) LEFT JOIN d ON day = CAST(g AS DATE)),
  m AS (SELECT greatest(CAST(g AS DATE), lo) AS a, least(last_day(CAST(g AS DATE)), hi) AS b
    FROM (SELECT unnest(generate_series(date_trunc('month', min(day))::TIMESTAMP, max(day)::TIMESTAMP, INTERVAL 1 MONTH)) AS g, min(day) AS lo, max(day) AS hi FROM d)),
  w AS (SELECT a, b, y.upto - x.upto AS n FROM m JOIN c x ON x.day = a - 1 JOIN c y ON y.day = b
    UNION ALL SELECT p.a, p.b, y.upto - x.upto FROM (SELECT unnest([a, a + ((b - a) // 2)::INT + 1]) AS a, unnest([a + ((b - a) // 2)::INT, b]) AS b FROM w WHERE n > {WINDOW_STUDIES} AND a < b) p
    JOIN c x ON x.day = p.a - 1 JOIN c y ON y.day = p.b)
  SELECT a AS window_from, b AS window_to, CAST(n AS BIGINT) AS n FROM w WHERE n > 0 AND (n <= {WINDOW_STUDIES} OR a = b)""")
def backfill_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of a backfill over all days with studies: months, halved while they hold too much, with what each holds. Counts come from one scan by day."""
    days = R.table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n")).where("day is not null").orderBy("day").collect()  # a row a day
    schema = "window_from date, window_to date, n long"
    if not days:
        return spark.createDataFrame([], schema)
    dates, upto = [r.day for r in days], [0, *accumulate(r.n for r in days)]
    held = lambda a, b: upto[bisect_right(dates, b)] - upto[bisect_left(dates, a)]
    return spark.createDataFrame([(a, b, held(a, b)) for a, b in month_chunks(dates[0], dates[-1], WINDOW_STUDIES, held)], schema)


@query("""SELECT label, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(text, '(?i)licen[sc]e') THEN 'license' WHEN regexp_matches(text, '[A-Za-z0-9._-]+@[A-Za-z0-9.-]+') THEN 'mail'
  WHEN length(text) < 200 THEN 'short' ELSE 'text' END AS label FROM documents) GROUP BY 1""")
def preseed_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by ordered rules."""
    t = F.col("text")
    label = F.when(t.rlike("(?i)licen[sc]e"), "license").when(t.rlike(r"[A-Za-z0-9._-]+@[A-Za-z0-9.-]+"), "mail").when(F.length(t) < 200, "short").otherwise("text")
    return R.table(spark, sf_dir, "documents").groupBy(label.alias("label")).agg(F.count("*").alias("n"))


@query("""SELECT a.user_id, count(*) AS n, count(*) FILTER (a.event_type = b.event_type) AS agree FROM events a JOIN events b ON a.user_id = b.user_id AND b.event_id = a.event_id + 1 GROUP BY 1""")
def ab_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often two matchers agree on a term, by its source."""
    events = R.table(spark, sf_dir, "events")
    a = events.select("user_id", (F.col("event_id") + 1).alias("event_id"), F.col("event_type").alias("left"))
    joined = a.join(events.select("user_id", "event_id", F.col("event_type").alias("right")), ["user_id", "event_id"])
    return joined.groupBy("user_id").agg(F.count("*").alias("n"), F.count_if(F.col("left") == F.col("right")).alias("agree"))


@query("""SELECT s_suppkey AS person_id, part AS last_name, ordinal AS variation FROM (SELECT s_suppkey, unnest([regexp_extract(s_name, '#(.*)', 1), 'Supplier ' || regexp_extract(s_name, '#(.*)', 1)]) AS part,
  unnest([0, 1]) AS ordinal FROM supplier)""")
def name_variations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each way to look a name up."""
    full = F.concat(F.lit("Dr "), F.replace("s_name", F.lit("#"), F.lit(" ")))
    rows = R.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("person_id"), F.posexplode(T.name_variations(full)).alias("variation", "v"))
    return rows.select("person_id", F.col("v.last").alias("last_name"), "variation")


@query("""SELECT event_id, max(ts - INTERVAL 1 HOUR * (event_id % 7)) OVER (PARTITION BY user_id ORDER BY event_id ROWS UNBOUNDED PRECEDING) AS cursor_at FROM events""")
def cursor_advance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cursor that only moves forward, over events that come up to six hours late."""
    seen = F.col("ts") - F.make_dt_interval(hours=F.col("event_id") % 7)
    upto = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, 0)
    return R.table(spark, sf_dir, "events").select("event_id", F.max(seen).over(upto).alias("cursor_at"))
