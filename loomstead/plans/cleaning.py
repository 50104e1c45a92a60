"""Cleaning of text, payloads and pages; merging, queues and matching."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead.functions import dates as D
from loomstead.functions import payloads as P
from loomstead.functions import text as T
from loomstead.functions import vocabulary as V
from loomstead.operators import matching as M
from loomstead.operators import queue as Q
from loomstead.operators import upsert as U
from loomstead.plans import roles as R
from loomstead.plans.registry import query

NOW = "2024-01-30 23:00:00"


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def mapped(table: dict[str, str]) -> str:
    return "MAP {" + ", ".join(f"'{k.upper()}': '{v}'" for k, v in table.items()) + "}"


KEYWORDS_SQL = f"""raw AS (SELECT p_partkey AS id, unnest([p_name, p_type, CASE p_size % 7 WHEN 0 THEN ' hiv; ' WHEN 1 THEN 'Treatment' WHEN 2 THEN 'phase 2.' WHEN 3 THEN 'MI' WHEN 4 THEN 'ab' WHEN 5 THEN 'a;b long' ELSE 'DM!' END, ' ']) AS k FROM part),
named AS (SELECT DISTINCT id, upper(coalesce({mapped(V.ACRONYMS)}[n], n)) AS k FROM (SELECT id, upper(regexp_replace(trim(k), '[,;:.!?]+$', '')) AS n FROM raw WHERE trim(k) <> '')),
judged AS (SELECT *, (length(k) >= 4 OR length(k) >= 2 AND k IN ({quoted(V.SHORT_TERMS)})) AND length(k) <= 150 AND (k IN ({quoted(V.DESIGN_TERMS)}) OR lower(k) NOT IN ({quoted(V.BLOCKED_KEYWORDS)}))
  AND NOT contains(k, ';') AND NOT contains(k, '|') AND len(list_filter(string_split(k, ' '), lambda x: x <> '')) <= 10 AND length(k) - length(replace(k, ',', '')) < 3 AS ok,
  k = (SELECT upper(p_type) FROM part WHERE p_partkey = id) AS known FROM named)"""


@query(f"""WITH {KEYWORDS_SQL} SELECT id, coalesce(string_agg(k, '|' ORDER BY k) FILTER (ok AND NOT known), '') AS cleaned, coalesce(string_agg(k, '|' ORDER BY k) FILTER (NOT ok AND NOT known), '') AS rejected FROM judged GROUP BY 1""")
def keyword_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = F.col("p_size") % 7
    odd = F.when(size == 0, " hiv; ").when(size == 1, "Treatment").when(size == 2, "phase 2.").when(size == 3, "MI").when(size == 4, "ab").when(size == 5, "a;b long").otherwise("DM!")
    parts = R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.array("p_name", "p_type", odd, F.lit(" ")).alias("k"), F.array("p_type").alias("conditions"))
    found = parts.withColumn("f", T.filtered_keywords(F.col("k"), F.col("conditions")))
    shown = [F.array_join(F.array_sort(f"f.{c}"), "|").alias(c) for c in ("cleaned", "rejected")]
    return found.select("id", *shown)


NAMES = ["Dr. Jane Doe", "Pfizer", "Study Director", "John Smith, MD, PhD", "Acme Research Institute", "Novartis Pharma AG", "A & B", "Maria Garcia", "Contact us", "Lab Inc"]


@query(f"""WITH n AS (SELECT c_custkey AS id, [{quoted(NAMES)}][c_custkey % 10 + 1] || CASE WHEN c_custkey % 4 = 0 THEN ', Sponsor' ELSE '' END AS name FROM customer),
s AS (SELECT id, upper(CASE WHEN ends_with(name, ', Sponsor') THEN name[:-10] ELSE name END) AS u FROM n)
SELECT id, CASE WHEN u LIKE 'CONTACT%' THEN 'RolePrefix:CONTACT' WHEN u LIKE 'STUDY DIRECTOR%' THEN 'RolePrefix:STUDY DIRECTOR' WHEN regexp_matches(u, ' INC$') THEN 'CorporateSuffix:INC'
  WHEN contains(u, ' & ') THEN 'Ampersand' WHEN contains(u, 'INSTITUTE') THEN 'OrgKeywords:INSTITUTE' WHEN contains(u, 'PHARMA ') THEN 'OrgKeywords:PHARMA' WHEN u = 'PFIZER' THEN 'PharmaBlocklist:Pfizer' END AS reason FROM s""")
def human_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("c_custkey")
    name = F.concat(F.get(F.array(*map(F.lit, NAMES)), (key % 10).cast("int")), F.when(key % 4 == 0, ", Sponsor").otherwise(""))
    reason = T.not_human_reason(name, F.lit(None).cast("string"))
    return R.table(spark, sf_dir, "customer").select(key.alias("id"), reason.alias("reason"))


@query("""WITH n AS (SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN 'Prof. ' ELSE '' END || replace(s_name, '#', ' ') || CASE s_suppkey % 3 WHEN 0 THEN ', MD, PhD' WHEN 1 THEN ' Jr.' ELSE '' END AS raw FROM supplier)
  SELECT id, CASE WHEN id % 4 = 0 THEN 'Prof.' END AS prefix, (SELECT replace(s_name, '#', ' ') FROM supplier WHERE s_suppkey = id) AS full_name,
  CASE id % 3 WHEN 0 THEN 'MD, PhD' WHEN 1 THEN 'Jr.' END AS suffix FROM n""")
def name_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    tail = F.when(key % 3 == 0, ", MD, PhD").when(key % 3 == 1, " Jr.").otherwise("")
    raw = F.concat(F.when(key % 4 == 0, "Prof. ").otherwise(""), F.replace("s_name", F.lit("#"), F.lit(" ")), tail)
    return R.table(spark, sf_dir, "supplier").select(key.alias("id"), T.parsed_name(raw).alias("n")).select("id", "n.*")


PLACES = ["  united   states of america", "UK", " Germany ", "the netherlands", "  ", "U.S.A."]
STATES = ["california", "ny", "Ontario", " new  york ", "  ", "tx"]


@query(f"""WITH r AS (SELECT c_custkey AS id, trim(regexp_replace([{quoted(PLACES)}][c_custkey % 6 + 1], '\\s+', ' ', 'g')) AS c, trim(regexp_replace([{quoted(STATES)}][c_custkey % 6 + 1], '\\s+', ' ', 'g')) AS s FROM customer)
  SELECT id, coalesce({mapped(V.COUNTRIES)}[upper(c)], nullif(c, '')) AS country, coalesce({mapped(V.STATES)}[upper(s)], CASE WHEN length(s) <= 4 THEN upper(nullif(s, '')) ELSE s END) AS state FROM r""")
def location_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda values: F.get(F.array(*map(F.lit, values)), (F.col("c_custkey") % 6).cast("int"))
    return R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), T.country(at(PLACES)).alias("country"), T.state(at(STATES)).alias("state"))


CATEGORIES_SQL = " || ".join("CASE WHEN " + " OR ".join(f"contains(t, '{k}')" for k in keys) + f" THEN '{name} ' ELSE '' END" for name, keys in V.SPECIALTIES.items())


@query(f"SELECT doc_id, trim({CATEGORIES_SQL}) AS categories FROM (SELECT doc_id, lower(text) AS t FROM documents)")
def category_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "documents").select("doc_id", F.array_join(T.specialties(F.col("text")), " ").alias("categories"))


@query(r"""WITH c AS (SELECT doc_id, length(regexp_replace(text, '\P{L}', '', 'g')) AS letters, length(regexp_replace(text, '[^\x{4E00}-\x{9FFF}\x{0400}-\x{04FF}\x{0600}-\x{06FF}\x{0370}-\x{03FF}\x{0E00}-\x{0E7F}\x{0590}-\x{05FF}]', '', 'g')) AS others
  FROM documents) SELECT doc_id, letters > 0 AND 2 * others >= letters AS non_english FROM c""")
def non_english(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "documents").select("doc_id", T.non_english(F.col("text")).alias("non_english"))


@query("""WITH d AS (SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE 'unknown' END AS t FROM orders)
  SELECT id, TRY_CAST(CASE length(t) WHEN 4 THEN t || '-01-01' WHEN 7 THEN CASE WHEN t = 'unknown' THEN NULL ELSE t || '-01' END ELSE t END AS DATE) AS day FROM d""")
def partial_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, at = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    given = F.when(key % 4 == 0, F.date_format(at, "yyyy")).when(key % 4 == 1, F.date_format(at, "yyyy-MM")).when(key % 4 == 2, F.date_format(at, "yyyy-MM-dd")).otherwise("unknown")
    return R.table(spark, sf_dir, "orders").select(key.alias("id"), D.partial_date(given).alias("day"))


@query("""SELECT user_id, count(*) AS n, round(greatest(0.0, 5000 - sum(records)) / (sum(records) / (sum(value) / 3600000)), 6) AS hours_left FROM (SELECT user_id, value, 1 + event_id % 7 AS records FROM events) GROUP BY 1""")
def eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = R.table(spark, sf_dir, "events").withColumn("records", 1 + F.col("event_id") % 7)
    sums = events.groupBy("user_id").agg(F.count("*").alias("n"), F.sum("records").alias("records"), F.sum("value").alias("ms"))
    return sums.select("user_id", "n", F.round(D.remaining_hours(F.col("records"), F.col("ms"), F.lit(5000)), 6).alias("hours_left"))


@query("""WITH p AS (SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CAST(ts AS DATE) AS d FROM events)
  SELECT event_id, CASE WHEN k > 20 THEN k END AS count, CASE WHEN k > 20 THEN d END AS first FROM p""")
def json_payload(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = R.table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").try_cast("long")
    day = F.date_format(F.col("ts").cast("date"), "yyyy-MM-dd")
    made = F.to_json(F.struct((k - 20).cast("string").alias("count"), day.alias("from"), day.alias("to"), F.lit("2024-01-01T00:00:00Z").alias("requestedAt")))
    read = events.select("event_id", P.backfill(made).alias("p"))
    return read.select("event_id", (F.col("p.count") + 20).alias("count"), F.col("p.from").alias("first"))


@query(r"""SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page, nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref FROM pages""")
def url_params(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = R.table(spark, sf_dir, "pages")
    given = F.str_to_map(F.regexp_extract("url", r"\?([^#]*)", 1), F.lit("&"), F.lit("="))
    return pages.select("page_id", given["page"].alias("page"), given["ref"].alias("ref"))


@query(r"""SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, len(regexp_extract_all(html, '<p[ >]')) AS n_paragraphs, nullif(regexp_extract(html, '<html lang="([a-z]+)"', 1), '') AS lang FROM pages""")
def html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = R.table(spark, sf_dir, "pages")
    lang = F.nullif(F.regexp_extract("html", '<html lang="([a-z]+)"', 1), F.lit(""))
    return pages.select("page_id", F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), F.regexp_count("html", F.lit("<p[ >]")).cast("long").alias("n_paragraphs"), lang.alias("lang"))


@query("""SELECT c_custkey AS id, c_mktsegment AS name, lower(c_mktsegment) NOT IN ('director', 'nurse') AND NOT regexp_matches(lower(c_mktsegment), '^[^ ]+(ist|ian)$') AS ok FROM customer""")
def institution_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("name"), T.institution_ok(F.col("c_mktsegment")).alias("ok"))


# --- merging


@query("""WITH b AS (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN upper(c_mktsegment) END AS seg, CASE WHEN c_custkey % 5 = 0 THEN 0.5 END AS bal FROM customer WHERE c_custkey % 2 = 0
    UNION ALL SELECT c_custkey + 1000000, 'NEW', 1.0 FROM customer WHERE c_custkey % 100 = 0)
  SELECT coalesce(c.c_custkey, b.c_custkey) AS c_custkey, coalesce(seg, c_mktsegment) AS c_mktsegment, coalesce(bal::DOUBLE, c_acctbal) AS c_acctbal FROM customer c FULL JOIN b ON c.c_custkey = b.c_custkey""")
def upsert_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored table after a batch; merging the batch once more changes nothing."""
    stored = R.table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal")
    key = F.col("c_custkey")
    some = stored.where(key % 2 == 0).select(key, F.when(key % 3 == 0, F.upper("c_mktsegment")).alias("c_mktsegment"), F.when(key % 5 == 0, F.lit(0.5)).alias("c_acctbal"))
    new = stored.where(key % 100 == 0).select((key + 1000000).alias("c_custkey"), F.lit("NEW").alias("c_mktsegment"), F.lit(1.0).alias("c_acctbal"))
    batch = some.unionByName(new)
    return U.merge_rows(U.merge_rows(stored, batch, "c_custkey"), batch, "c_custkey")


@query("""SELECT l_orderkey, l_linestatus, 'stored' AS origin, count(*) AS n FROM lineitem WHERE NOT (l_orderkey % 4 = 0 AND l_linestatus = 'O') GROUP BY 1, 2
  UNION ALL SELECT l_orderkey, l_linestatus, 'batch', count(*) FROM lineitem WHERE l_orderkey % 4 = 0 AND l_linestatus = 'O' AND l_quantity > 25 GROUP BY 1, 2""")
def replace_children(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = R.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linestatus", "l_quantity")
    touched = lines.where("l_orderkey % 4 = 0 AND l_linestatus = 'O'")
    stored, batch = lines.withColumn("origin", F.lit("stored")), touched.where("l_quantity > 25").withColumn("origin", F.lit("batch"))
    return U.replace_children(stored, batch, ["l_orderkey", "l_linestatus"], touched).groupBy("l_orderkey", "l_linestatus", "origin").agg(F.count("*").alias("n"))


@query("""SELECT o_orderkey AS study_id, CASE WHEN o_orderstatus = 'P' THEN TIMESTAMP '2000-01-01 00:00:00' WHEN o_orderdate < TIMESTAMP '1996-01-01' THEN TIMESTAMP '2024-01-30 23:00:00' END AS removed_at FROM orders""")
def soft_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = R.table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("study_id"), F.col("o_orderdate").alias("last_seen"), F.when(F.col("o_orderstatus") == "P", F.lit("2000-01-01 00:00:00")).cast("timestamp_ntz").alias("removed_at")
    )
    swept = U.mark_removed(stored, F.lit("1996-01-01 00:00:00").cast("timestamp_ntz"), F.lit(NOW).cast("timestamp_ntz"))
    return swept.select("study_id", "removed_at")


@query("""WITH cur AS (SELECT p_partkey AS k, p_type AS v, p_size = 1 AS pinned FROM part WHERE p_partkey % 5 <> 0), want AS (SELECT p_partkey AS k, CASE WHEN p_partkey % 7 = 0 THEN 'X' ELSE p_type END AS v FROM part WHERE p_partkey % 3 <> 0)
  SELECT coalesce(cur.k, want.k) AS k, CASE WHEN cur.k IS NULL THEN 'add' WHEN want.k IS NULL THEN 'remove' ELSE 'update' END AS action FROM cur FULL JOIN want ON cur.k = want.k
  WHERE NOT coalesce(pinned, false) AND (cur.k IS NULL OR want.k IS NULL OR cur.v IS DISTINCT FROM want.v)""")
def reconcile_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), F.col("p_type").alias("v"), "p_size")
    current, wanted = parts.where("k % 5 <> 0"), parts.where("k % 3 <> 0").withColumn("v", F.when(F.col("k") % 7 == 0, "X").otherwise(F.col("v")))
    return U.reconcile(current, wanted, "k", "v", F.col("p_size") == 1)


@query("""SELECT c_custkey AS k, c_name AS v FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, upper(c_name) FROM customer WHERE c_custkey % 2 = 1 AND c_custkey % 3 = 0""")
def alias_insert(spark: SparkSession, sf_dir: str) -> DataFrame:
    aliases = R.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return U.insert_absent(aliases.where("k % 2 = 0"), aliases.where("k % 3 = 0").withColumn("v", F.upper("v")), ["k"])


# --- queues

QUEUE_SQL = """q AS (SELECT event_id AS id, event_type, ts AS created_at, CAST(event_id % 5 AS INT) AS retry_count,
  CASE event_id % 4 WHEN 0 THEN 'pending' WHEN 1 THEN 'processing' WHEN 2 THEN 'completed' ELSE 'dead-letter' END AS status,
  CASE WHEN event_id % 3 = 0 THEN ts + INTERVAL '10 minutes' END AS last_error_at, CASE WHEN event_id % 4 = 1 THEN ts END AS claimed_at FROM events)"""


def work_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    id_, at = F.col("event_id"), F.col("ts")
    status = F.when(id_ % 4 == 0, "pending").when(id_ % 4 == 1, "processing").when(id_ % 4 == 2, "completed").otherwise("dead-letter")
    return R.table(spark, sf_dir, "events").select(
        id_.alias("id"), "event_type", at.alias("created_at"), (id_ % 5).cast("int").alias("retry_count"), status.alias("status"),
        F.when(id_ % 3 == 0, at + F.expr("interval 10 minutes")).alias("last_error_at"), F.when(id_ % 4 == 1, at).alias("claimed_at"), F.lit(None).cast("timestamp_ntz").alias("progress_at"),
    )


BACKOFF_SQL = "CASE retry_count WHEN 0 THEN 0 WHEN 1 THEN 30 WHEN 2 THEN 120 ELSE 600 END"


@query(f"""WITH {QUEUE_SQL} SELECT id FROM q WHERE status = 'pending' AND (last_error_at IS NULL OR last_error_at + to_seconds({BACKOFF_SQL}) <= TIMESTAMP '{NOW}')""")
def backoff_eligible(spark: SparkSession, sf_dir: str) -> DataFrame:
    queue = work_queue(spark, sf_dir)
    return queue.where(Q.claimable(queue, F.lit(NOW).cast("timestamp_ntz"))).select("id")


@query(f"""WITH {QUEUE_SQL} SELECT event_type, id FROM q WHERE status = 'pending' AND (last_error_at IS NULL OR last_error_at + to_seconds({BACKOFF_SQL}) <= TIMESTAMP '{NOW}')
  QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY created_at, id) = 1""")
def claim_next(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.next_by_type(work_queue(spark, sf_dir), F.lit(NOW).cast("timestamp_ntz")).select("event_type", "id")


@query(f"""WITH {QUEUE_SQL} SELECT id FROM q WHERE status = 'processing' AND claimed_at < TIMESTAMP '{NOW}' - INTERVAL '30 minutes'""")
def stuck_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return work_queue(spark, sf_dir).where(Q.stuck(F.lit(NOW).cast("timestamp_ntz"))).select("id")


@query(f"""WITH {QUEUE_SQL} SELECT id, CASE WHEN event_type = 'error' AND status = 'processing' THEN CASE WHEN retry_count + 1 >= 4 THEN 'dead-letter' ELSE 'pending' END
    WHEN event_type = 'purchase' AND status = 'processing' THEN 'completed' WHEN event_type = 'click' AND status = 'pending' THEN 'processing' WHEN event_type = 'view' AND status = 'dead-letter' THEN 'pending' ELSE status END AS status,
  CASE WHEN event_type = 'error' AND status = 'processing' THEN retry_count + 1 WHEN event_type = 'view' AND status = 'dead-letter' THEN 0 ELSE retry_count END AS retry_count FROM q""")
def queue_transition(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    outcome = F.when(kind == "error", "failed").when(kind == "purchase", "done").when(kind == "click", "claimed").when(kind == "view", "retried").otherwise("none")
    status, retries = Q.after_outcome(F.col("status"), F.col("retry_count"), outcome)
    return work_queue(spark, sf_dir).select("id", status.alias("status"), retries.alias("retry_count"))


@query(f"""WITH {QUEUE_SQL}, m AS (SELECT id, id % 100 AS done, 80 AS total, epoch_us(TIMESTAMP '{NOW}') / 60000000.0::DOUBLE - epoch_us(claimed_at) / 60000000.0::DOUBLE AS minutes FROM q WHERE status = 'processing')
  SELECT id, least(100.0, done * 100.0 / total)::DOUBLE AS percent, CASE WHEN done > 0 THEN round(done / greatest(minutes, 0.0001), 6) END AS rate_per_min FROM m""")
def in_flight_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    working = work_queue(spark, sf_dir).where("status = 'processing'")
    percent, rate, _ = Q.in_flight((F.col("id") % 100).cast("int"), F.lit(80), F.col("claimed_at"), F.lit(NOW).cast("timestamp_ntz"))
    return working.select("id", percent, F.round(rate, 6).alias("rate_per_min"))


# --- matching

VECTORS_SQL = "v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)"


SIMILAR_SQL = f"{VECTORS_SQL}, s AS (SELECT a.vec_id AS query_id, b.vec_id AS match_id, list_cosine_similarity(a.e, b.e) AS sim FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id)"


def neighbours(spark: SparkSession, sf_dir: str, k: int) -> DataFrame:
    """The k nearest of all vectors but itself for each vector whose id 100 divides."""
    vectors = R.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    asked, known = vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id"), vectors.withColumnRenamed("vec_id", "match_id")
    found = M.nearest(asked, known, k + 1).where("match_id <> query_id")  # one more, as each is near itself
    order = Window.partitionBy("query_id").orderBy("rank")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


@query(f"""WITH {SIMILAR_SQL}
  SELECT query_id, match_id, round(sim, 6) AS similarity FROM s QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, match_id) = 1""")
def cosine_top1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours(spark, sf_dir, 1).select("query_id", "match_id", F.round("similarity", 6).alias("similarity"))


@query(f"""WITH {SIMILAR_SQL},
  r AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, match_id) AS INT) AS rank FROM s)
  SELECT query_id, match_id, rank, NOT sim < 0.5 AS accepted, CASE WHEN sim < 0.5 THEN printf('below_threshold (sim=%.4f)', sim) END AS reason FROM r WHERE rank <= 3""")
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    ok, reason = M.accepted(F.col("similarity"), 0.5)
    return neighbours(spark, sf_dir, 3).select("query_id", "match_id", "rank", ok.alias("accepted"), reason.alias("reason"))


@query(f"""WITH {VECTORS_SQL}, t AS (SELECT 'term ' || vec_id AS term, list_reverse(e) AS e, vec_id FROM v WHERE vec_id % 50 = 0),
  s AS (SELECT term, b.vec_id AS m, list_cosine_similarity(t.e, b.e) AS sim FROM t JOIN v b ON t.vec_id % 100 <> 0 QUALIFY row_number() OVER (PARTITION BY term ORDER BY sim DESC, b.vec_id) = 1)
  SELECT term, m AS match_id, round(sim, 6) AS similarity, sim >= 0.55 AS accepted FROM s UNION ALL SELECT term, vec_id, 1.0, true FROM t WHERE vec_id % 100 = 0""")
def term_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Terms by exact name, else by the nearest of all vectors; a term's own is that of its number, backwards."""
    vectors = R.table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("vector"))
    named = vectors.where("vec_id % 50 = 0").select("vec_id", F.concat(F.lit(" Term "), F.col("vec_id").cast("string")).alias("term"), F.reverse("vector").alias("vector"))
    names = named.where("vec_id % 100 = 0").select(F.col("term").alias("name"), F.col("vec_id").alias("match_id"))
    found = M.match_terms(named.select("term"), names, named.select("term", "vector"), vectors.withColumnRenamed("vec_id", "match_id"))
    return found.select("term", "match_id", F.round("similarity", 6).alias("similarity"), "accepted")


# --- small lookups


@query("SELECT DISTINCT p_name AS name FROM part WHERE p_name ILIKE '%il%' OR p_name ILIKE '%ro%' ORDER BY name LIMIT 20")
def typeahead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first twenty names that hold what was typed, in any case."""
    names = R.table(spark, sf_dir, "part").select(F.col("p_name").alias("name")).where(F.ilike("name", F.lit("%il%")) | F.ilike("name", F.lit("%ro%")))
    return names.distinct().orderBy("name").limit(20)


@query(f"""WITH {QUEUE_SQL} SELECT count(*) FILTER (status = 'dead-letter') AS dead, round((epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(created_at) FILTER (status = 'completed'))) / 3600000000.0, 6) AS hours,
  count(*) FILTER (status = 'dead-letter') > 10 OR coalesce(epoch_us(TIMESTAMP '{NOW}') - epoch_us(max(created_at) FILTER (status = 'completed')) > 24 * 3600000000, true) AS alert FROM q""")
def queue_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead letters and hours since the last completed event, and whether either is too much."""
    queue = work_queue(spark, sf_dir).withColumn("completed_at", F.col("created_at"))
    return Q.alerts(queue, F.lit(NOW).cast("timestamp_ntz"), 10, 24).withColumn("hours", F.round("hours", 6))


@query(f"SELECT user_id AS source, least(max(ts) + INTERVAL '24 hours', TIMESTAMP '{NOW}') AS window_end FROM events GROUP BY 1")
def next_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the next incremental window of each source ends."""
    last = R.table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("source")).agg(F.max("ts").alias("last"))
    return last.select("source", Q.next_window_end(F.col("last"), F.lit(NOW).cast("timestamp_ntz")).alias("window_end"))


#: A vocabulary of parts for names of goods.
PARTS = {w: i for i, w in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "small", "red", "blue", "hot", "wid", "##get", "gear", "bolt", "ring", "gi", "##z", "##mo"])}


@query("""SELECT p_partkey AS id, '2,' || array_to_string(list_transform(string_split(p_name, ' '), lambda w: CASE w WHEN 'small' THEN '4' WHEN 'red' THEN '5' WHEN 'blue' THEN '6' WHEN 'hot' THEN '7' WHEN 'widget' THEN '8,9'
  WHEN 'gear' THEN '10' WHEN 'bolt' THEN '11' WHEN 'ring' THEN '12' WHEN 'gizmo' THEN '13,14,15' ELSE '1' END), ',') || ',3' AS ids FROM part""")
def wordpieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = M.wordpiece(F.col("p_name"), PARTS, 12)
    found = R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), ids.alias("ids"))
    return found.select("id", F.array_join(F.filter("ids", lambda i: i != 0).cast("array<string>"), ",").alias("ids"))
