"""Searches over studies, and the sets around them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.operators import trigrams as G
from loomstead.operators.filters import Criteria, Registry, apply_filters, page
from loomstead.operators.intervals import contained
from loomstead.plans import roles as R
from loomstead.plans.registry import query


def registry(spark: SparkSession, sf_dir: str) -> Registry:
    lines = R.table(spark, sf_dir, "lineitem")
    phases = lines.select(F.col("l_orderkey").alias("study_id"), F.concat(F.lit("PHASE_"), "l_linestatus").alias("phase"))
    keywords = lines.select(F.col("l_orderkey").alias("study_id"), F.concat(F.lit("flag "), "l_returnflag").alias("keyword"))
    return Registry(R.studies(spark, sf_dir), phases, R.conditions(spark, sf_dir), R.descriptors(spark, sf_dir), R.places(spark, sf_dir), keywords)


SHOWN = ["study_id", "title", "status", "start_date", "enrollment"]
SEARCH = Criteria(keyword="URGENT", statuses=["COMPLETED", "RECRUITING", " "], phases=["PHASE_O"], countries=["EUROPE", "ASIA"], least_enrollment=50, start_from="1994-01-01")
SEARCH_SQL = """FROM studies s WHERE contains(lower(title), 'urgent') AND status IN ('COMPLETED', 'RECRUITING')
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = s.study_id AND l_linestatus = 'O')
  AND EXISTS (SELECT 1 FROM places p WHERE p.study_id = s.study_id AND country IN ('EUROPE', 'ASIA')) AND enrollment >= 50 AND start_date >= DATE '1994-01-01'"""


@query(f"{R.WITH} SELECT study_id, title, status, start_date, enrollment {SEARCH_SQL} ORDER BY start_date DESC NULLS FIRST, study_id LIMIT 20 OFFSET 20")
def search_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    return page(apply_filters(registry(spark, sf_dir), SEARCH), 2, 20).select(*SHOWN)


@query(f"{R.WITH} SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages {SEARCH_SQL}")
def search_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_filters(registry(spark, sf_dir), SEARCH).agg(F.count("*").alias("total"), F.ceil(F.count("*") / 20).alias("pages"))


@query(f"""{R.WITH} SELECT study_id, title, status, start_date, enrollment FROM studies s
  WHERE contains(lower(title), '77') OR contains(CAST(study_id AS VARCHAR), '77') OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = s.study_id AND contains(lower('flag ' || l_returnflag), '77'))""")
def keyword_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_filters(registry(spark, sf_dir), Criteria(keyword="77")).select(*SHOWN)


def text_postings(spark: SparkSession, sf_dir: str, found: Registry) -> DataFrame:
    """Postings of studies' titles, ids and keywords, kept as a table in parts sorted by gram, so that a search reads few of its pages."""
    texts = found.studies.select("study_id", F.explode(F.array("title", F.col("study_id").cast("string"))).alias("text")).union(found.keywords.distinct())
    parts = max(spark.sparkContext.defaultParallelism, -(-found.studies.count() // G.PART_KEYS))
    return R.written(G.stored_postings(texts, "study_id", "text", parts), "grams")


@query(f"""{R.WITH} SELECT study_id, title, status, start_date, enrollment FROM studies s
  WHERE contains(lower(title), 'ecified study of 12') OR contains(CAST(study_id AS VARCHAR), 'ecified study of 12') OR EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = s.study_id AND contains(lower('flag ' || l_returnflag), 'ecified study of 12'))""")
def keyword_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A keyword's search by postings."""
    found = registry(spark, sf_dir)
    found.grams = text_postings(spark, sf_dir, found)
    return apply_filters(found, Criteria(keyword="ecified study of 12")).select(*SHOWN)


@query("""WITH t AS (SELECT DISTINCT unnest([p_brand, left(p_name, 3), p_type, left(p_brand, 1), right(p_name, 2), 'Absent ' || p_size]) AS term FROM part),
  n AS (SELECT p_partkey AS id, upper(p_name) || ' ' || p_type || ' ' || p_brand AS name FROM part) SELECT term, count(*) AS n, min(id) AS first FROM t JOIN n ON contains(lower(name), lower(term)) GROUP BY 1""")
def terms_within(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names hold each of many terms, of one letter and more, and the first that does."""
    part = R.table(spark, sf_dir, "part")
    cut = F.array(F.col("p_brand"), F.left("p_name", F.lit(3)), F.col("p_type"), F.left("p_brand", F.lit(1)), F.right("p_name", F.lit(2)), F.concat(F.lit("Absent "), F.col("p_size").cast("string")))
    names = part.select(F.col("p_partkey").alias("id"), F.concat_ws(" ", F.upper("p_name"), "p_type", "p_brand").alias("name"))
    found = G.holding(names, part.select(F.explode(cut).alias("term")), "id", "name")
    return found.groupBy("term").agg(F.count("*").alias("n"), F.min("id").alias("first"))


@query(f"{R.WITH} SELECT study_id, title, status, start_date, enrollment FROM studies WHERE title ILIKE '%low%of 1_2%' OR CAST(study_id AS VARCHAR) ILIKE '%low%of 1_2%'")
def keyword_pattern(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_filters(registry(spark, sf_dir), Criteria(keyword="low%of 1_2"), wildcards=True, study_keywords=False, by_place=False).select(*SHOWN)


@query(f"""{R.WITH} SELECT study_id, status FROM studies s WHERE EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = s.study_id AND l_linestatus IN ('O'))
  AND EXISTS (SELECT 1 FROM conditions c JOIN descriptors d USING (descriptor_id) WHERE c.study_id = s.study_id AND d.name IN (SELECT p_name FROM part WHERE p_partkey <= 20))""")
def semi_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = [r.p_name for r in R.table(spark, sf_dir, "part").where("p_partkey <= 20").select("p_name").distinct().collect()]  # what a user picks, twenty at most
    return apply_filters(registry(spark, sf_dir), Criteria(phases=["PHASE_O"], conditions=names)).select("study_id", "status")


@query(f"""{R.WITH} SELECT study_id, status, o_totalprice > 300000 AS removed FROM studies JOIN orders ON o_orderkey = study_id WHERE status = 'COMPLETED' AND o_totalprice <= 300000""")
def removed_studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed studies without those removed."""
    return with_removed(spark, sf_dir, Criteria(statuses=["COMPLETED"]))


@query(f"""{R.WITH} SELECT study_id, status, o_totalprice > 300000 AS removed FROM studies JOIN orders ON o_orderkey = study_id WHERE status = 'COMPLETED'""")
def removed_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Completed studies, those removed too."""
    return with_removed(spark, sf_dir, Criteria(statuses=["COMPLETED"], include_removed=True))


def with_removed(spark: SparkSession, sf_dir: str, criteria: Criteria) -> DataFrame:
    """A search over studies of which the dearest were removed on the day after their start."""
    found = registry(spark, sf_dir)
    prices = R.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("study_id"), "o_totalprice")
    found.studies = found.studies.join(prices, "study_id").withColumn("removed_at", F.when(F.col("o_totalprice") > 300000, F.date_add("start_date", 1)))
    return apply_filters(found, criteria).select("study_id", "status", F.col("removed_at").isNotNull().alias("removed"))


@query(f"""{R.WITH} SELECT study_id, status FROM studies s WHERE EXISTS (SELECT 1 FROM conditions c JOIN descriptors d USING (descriptor_id)
  WHERE c.study_id = s.study_id AND (starts_with(tree_number, 'B1.PROMO') OR starts_with(tree_number, 'B2')))""")
def prefix_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_filters(registry(spark, sf_dir), Criteria(tree_prefixes=["B1.PROMO", "B2"])).select("study_id", "status")


@query(f"""{R.WITH} SELECT study_id, status FROM studies s WHERE EXISTS (SELECT 1 FROM places p WHERE p.study_id = s.study_id AND country IN ('AMERICA', 'AFRICA'))
  AND EXISTS (SELECT 1 FROM places p WHERE p.study_id = s.study_id AND city IN ('BUILDING', 'MACHINERY'))""")
def geo_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply_filters(registry(spark, sf_dir), Criteria(countries=["AMERICA", "AFRICA"], cities=["BUILDING", "MACHINERY"])).select("study_id", "status")


@query(f"{R.WITH} SELECT study_id, enrollment, start_date FROM studies WHERE enrollment BETWEEN 100 AND 200 AND start_date BETWEEN DATE '1995-01-01' AND DATE '1996-12-31'")
def range_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    criteria = Criteria(least_enrollment=100, most_enrollment=200, start_from="1995-01-01", start_to="1996-12-31")
    return apply_filters(registry(spark, sf_dir), criteria).select("study_id", "enrollment", "start_date")


@query(f"{R.WITH} SELECT DISTINCT name FROM descriptors JOIN conditions USING (descriptor_id)")
def distinct_conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    used = R.descriptors(spark, sf_dir).join(R.conditions(spark, sf_dir), "descriptor_id", "left_semi")
    return used.select("name").distinct().orderBy("name")


@query(f"""{R.WITH} SELECT s.study_id, s.title, list_sort(list(DISTINCT i.person_id) FILTER (i.person_id IS NOT NULL)) AS persons, count(DISTINCT i.person_id) AS n_persons
  FROM studies s LEFT JOIN investigators i USING (study_id) GROUP BY ALL""")
def study_detail(spark: SparkSession, sf_dir: str) -> DataFrame:
    team = R.investigators(spark, sf_dir).groupBy("study_id").agg(F.array_sort(F.collect_set("person_id")).alias("persons"))
    joined = R.studies(spark, sf_dir).join(team, "study_id", "left")
    return joined.select("study_id", "title", "persons", F.coalesce(F.size("persons"), F.lit(0)).cast("long").alias("n_persons"))


@query("""SELECT c_custkey AS sponsor_id, c_name AS name FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o_orderstatus = 'F')""")
def anti_requeue(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = R.table(spark, sf_dir, "orders").where("o_orderstatus = 'F'").select(F.col("o_custkey").alias("c_custkey"))
    return R.table(spark, sf_dir, "customer").join(done, "c_custkey", "left_anti").select(F.col("c_custkey").alias("sponsor_id"), F.col("c_name").alias("name"))


WINDOWS_SQL = """windows AS (SELECT user_id, min(CAST(ts AS DATE)) AS a, max(CAST(ts AS DATE)) AS b, date_trunc('week', ts) AS w, count(*) AS n FROM events GROUP BY user_id, w)"""


@query(f"""WITH {WINDOWS_SQL} SELECT user_id, CAST(w AS DATE) AS week FROM windows p WHERE NOT EXISTS
  (SELECT 1 FROM windows c WHERE c.user_id = p.user_id AND c.n >= 20 AND p.a >= c.a AND p.b <= c.b)""")
def window_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Planned windows that no completed window of their source contains; windows of twenty events or more count as completed."""
    week, day = F.date_trunc("week", "ts").alias("w"), F.to_date("ts")
    windows = R.table(spark, sf_dir, "events").groupBy("user_id", week).agg(F.min(day).alias("a"), F.max(day).alias("b"), F.count("*").alias("n"))
    told = contained(windows, windows.where("n >= 20").select("user_id", "a", "b"), ["user_id"], "a", "b")
    left = told.where("not contained")
    return left.select("user_id", F.to_date("w").alias("week"))


@query("""SELECT lower(text) AS term, 'positive' AS label FROM conversations WHERE role = 'user' AND text IS NOT NULL
  UNION ALL SELECT lower(text), 'negative' FROM conversations WHERE role = 'system' AND text IS NOT NULL""")
def labelled_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = R.table(spark, sf_dir, "conversations").where("text IS NOT NULL")
    part = lambda who, label: turns.where(F.col("role") == who).select(F.lower("text").alias("term"), F.lit(label).alias("label"))
    return part("user", "positive").unionByName(part("system", "negative"))


@query("""SELECT DISTINCT lower(s_name) AS name FROM supplier WHERE lower(s_name) NOT IN
  (SELECT lower(s_name) FROM supplier JOIN lineitem ON s_suppkey = l_suppkey WHERE l_quantity >= 50 AND l_returnflag = 'R')""")
def except_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = R.table(spark, sf_dir, "supplier").select(F.lower("s_name").alias("name"), "s_suppkey")
    taken = names.join(R.table(spark, sf_dir, "lineitem").where("l_quantity >= 50 AND l_returnflag = 'R'"), F.col("s_suppkey") == F.col("l_suppkey")).select("name")
    return names.select("name").distinct().join(taken, "name", "left_anti")


@query(f"""WITH kinds AS (SELECT l_suppkey AS person_id, list(DISTINCT p_type) AS k FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_quantity >= 45 GROUP BY l_suppkey)
  SELECT person_id, list_has_any(k, ['PROMO', 'ECONOMY']) AS fits, len(list_intersect(k, ['PROMO', 'ECONOMY', 'SMALL'])) / 3.0::DOUBLE AS fit FROM kinds""")
def overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = R.table(spark, sf_dir, "lineitem").where("l_quantity >= 45").join(R.table(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kinds = lines.groupBy(F.col("l_suppkey").alias("person_id")).agg(F.collect_set("p_type").alias("k"))
    asked = lambda *names: F.array(*map(F.lit, names))
    fit = F.size(F.array_intersect("k", asked("PROMO", "ECONOMY", "SMALL"))) / F.lit(3.0)
    return kinds.select("person_id", F.arrays_overlap("k", asked("PROMO", "ECONOMY")).alias("fits"), fit.alias("fit"))
