"""Counts, breakdowns, percentiles, top lists and telemetry."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead.operators import metrics as M
from loomstead.operators import queue as Q
from loomstead.plans import roles as R
from loomstead.plans.registry import query

DEC = "decimal(18,2)"


@query(f"{R.WITH} SELECT coalesce(status, 'UNKNOWN') AS status, count(*) AS n FROM studies GROUP BY 1")
def status_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.breakdown(R.studies(spark, sf_dir), "status")


@query(f"""{R.WITH} SELECT priority, coalesce(status, 'UNKNOWN') AS status, count(*) AS n, round_even(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY priority), 1) AS percent
  FROM studies GROUP BY 1, 2""")
def status_percentages(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = R.studies(spark, sf_dir).groupBy("priority", F.coalesce("status", F.lit("UNKNOWN")).alias("status")).agg(F.count("*").alias("n"))
    return counts.withColumn("percent", F.bround(M.share_of_total(counts, ["priority"]), 1))


@query("SELECT count(DISTINCT lower(text)) AS n_terms FROM benchmark")
def distinct_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return R.table(spark, sf_dir, "benchmark").agg(F.count_distinct(F.lower("text")).alias("n_terms"))


@query("""SELECT word, count(*) AS n FROM (SELECT unnest(string_split(lower(p_name), ' ')) AS word FROM part) GROUP BY word ORDER BY n DESC, word LIMIT 50""")
def keyword_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = R.table(spark, sf_dir, "part").select(F.explode(F.split(F.lower("p_name"), " ")).alias("word"))
    return words.groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(50)


TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events"]


@query("WITH c AS (" + " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in TABLES) + """)
  SELECT name, n, round_even(n / 1048576.0::DOUBLE, 6) AS size_estimate FROM (SELECT * FROM c UNION ALL SELECT 'total', CAST(sum(n) AS BIGINT) FROM c)""")
def table_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = M.table_counts({t: R.table(spark, sf_dir, t) for t in TABLES})
    return counts.withColumn("size_estimate", F.bround(F.col("n") / 1048576, 6))


@query("""SELECT count(*) AS total, count(*) FILTER (value >= 50) AS accepted, count(*) FILTER (value < 50) AS rejected, count(*) FILTER (value::FLOAT < 25::FLOAT) AS band_low,
  count(*) FILTER (value::FLOAT >= 25::FLOAT AND value::FLOAT < 50::FLOAT) AS band_mid, count(*) FILTER (value::FLOAT >= 50::FLOAT AND value::FLOAT < 75::FLOAT) AS band_high,
  count(*) FILTER (value::FLOAT >= 75::FLOAT) AS band_top FROM events""")
def similarity_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    v, f = F.col("value"), F.col("value").cast("float")
    at = lambda x: F.lit(float(x)).cast("float")
    bands = {"band_low": f < at(25), "band_mid": (f >= at(25)) & (f < at(50)), "band_high": (f >= at(50)) & (f < at(75)), "band_top": f >= at(75)}
    return R.table(spark, sf_dir, "events").agg(F.count("*").alias("total"), F.count_if(v >= 50).alias("accepted"), F.count_if(v < 50).alias("rejected"), *(F.count_if(c).alias(n) for n, c in bands.items()))


@query("""SELECT count(*) AS views, count(DISTINCT user_id) FILTER (user_id > 0) AS sessions FROM events WHERE ts >= date_trunc('week', TIMESTAMP '2024-01-24 12:00:00')""")
def page_view_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.date_trunc("week", F.lit("2024-01-24 12:00:00").cast("timestamp_ntz"))
    views = R.table(spark, sf_dir, "events").where(F.col("ts") >= start)
    return views.agg(F.count("*").alias("views"), F.count_distinct(F.when(F.col("user_id") > 0, F.col("user_id"))).alias("sessions"))


@query("SELECT regexp_extract(url, '^[a-z]+://([^/?#]+)', 1) AS path, count(*) AS n FROM pages GROUP BY 1 ORDER BY n DESC, path LIMIT 10")
def top_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    hosts = R.table(spark, sf_dir, "pages").groupBy(F.regexp_extract("url", "^[a-z]+://([^/?#]+)", 1).alias("path")).agg(F.count("*").alias("n"))
    return hosts.orderBy(F.desc("n"), "path").limit(10)


@query(f"""{R.WITH}, per AS (SELECT person_id, count(DISTINCT study_id) AS n_studies, count(DISTINCT study_id) FILTER (role = 'PRINCIPAL_INVESTIGATOR') AS n_led FROM investigators GROUP BY 1)
  SELECT person_id, n_studies, n_led FROM per""")
def studies_per_person(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = F.when(F.col("role") == "PRINCIPAL_INVESTIGATOR", F.col("study_id"))
    return R.investigators(spark, sf_dir).groupBy("person_id").agg(F.count_distinct("study_id").alias("n_studies"), F.count_distinct(led).alias("n_led"))


@query("""SELECT l_suppkey AS person_id, l_returnflag AS payment_type, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n,
  count(DISTINCT l_partkey) AS payors, CAST(max(year(l_shipdate)) AS INT) AS latest_year FROM lineitem GROUP BY 1, 2""")
def payment_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = R.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("person_id"), F.col("l_returnflag").alias("payment_type"))
    total = F.sum(F.col("l_extendedprice").cast(DEC)).cast("double").alias("total")
    return lines.agg(total, F.count("*").alias("n"), F.count_distinct("l_partkey").alias("payors"), F.max(F.year("l_shipdate")).alias("latest_year"))


@query("""WITH c AS (SELECT l_suppkey AS person_id, l_linestatus AS k, count(*) AS n FROM lineitem GROUP BY 1, 2)
  SELECT person_id, string_agg(k || '=' || n, ',' ORDER BY k) AS histogram FROM c GROUP BY 1""")
def histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = R.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("person_id"), F.col("l_linestatus").alias("k")).agg(F.count("*").alias("n"))
    entries = F.array_sort(F.collect_list(F.struct("k", "n")))
    shown = F.array_join(F.transform(entries, lambda e: F.concat(e["k"], F.lit("="), e["n"].cast("string"))), ",")
    return counts.groupBy("person_id").agg(shown.alias("histogram"))


@query("""WITH t AS (SELECT DISTINCT l_orderkey AS s, l_suppkey AS p FROM lineitem)
  SELECT a.p AS person_id, count(DISTINCT b.p) AS n_colleagues, min(b.p) AS first_colleague FROM t a JOIN t b ON a.s = b.s AND a.p <> b.p GROUP BY 1""")
def co_investigators(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within a study meet through the study's set of persons; a study's team is small, whatever a person's number of studies."""
    team = R.table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.collect_set("l_suppkey").alias("team"))
    pairs = team.select(F.explode("team").alias("person_id"), "team").select("person_id", F.explode("team").alias("other")).where("person_id <> other").distinct()
    return pairs.groupBy("person_id").agg(F.count("*").alias("n_colleagues"), F.min("other").alias("first_colleague"))


@query("""SELECT l_partkey AS code, l_linestatus AS place, CAST(sum(coalesce(l_quantity, 0)) AS BIGINT) AS services,
  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS mean_charge, min(l_returnflag || '/' || l_linenumber) AS description FROM lineitem GROUP BY 1, 2""")
def procedure_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = R.table(spark, sf_dir, "lineitem").withColumn("d", F.concat("l_returnflag", F.lit("/"), F.col("l_linenumber").cast("string")))
    mean = F.sum(F.col("l_extendedprice").cast(DEC)).cast("double") / F.count("*")
    return lines.groupBy(F.col("l_partkey").alias("code"), F.col("l_linestatus").alias("place")).agg(
        F.sum(F.coalesce("l_quantity", F.lit(0))).cast("long").alias("services"), mean.alias("mean_charge"), F.min("d").alias("description")
    )


@query("""WITH c AS (SELECT l_suppkey AS person_id, c_nationkey AS place, count(*) AS n, max(o_orderdate) AS latest FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)
  SELECT person_id, place, n FROM c QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY n DESC, latest DESC NULLS LAST, place) = 1""")
def primary_affiliation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders, customers = R.table(spark, sf_dir, "orders"), R.table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    lines = R.table(spark, sf_dir, "lineitem").join(orders, F.col("l_orderkey") == F.col("o_orderkey")).join(customers, F.col("o_custkey") == F.col("c_custkey"))
    counts = lines.groupBy(F.col("l_suppkey").alias("person_id"), F.col("c_nationkey").alias("place")).agg(F.count("*").alias("n"), F.max("o_orderdate").alias("latest"))
    return M.first_by(counts, ["person_id"], F.desc("n"), F.desc_nulls_last("latest"), F.asc("place")).select("person_id", "place", "n")


DONE = "event_type IN ('purchase', 'view')"


@query(f"""WITH recent AS (SELECT value FROM events WHERE {DONE} ORDER BY ts DESC, event_id DESC LIMIT 10000)
  SELECT (SELECT count(*) FROM events WHERE event_type = 'click') AS pending, (SELECT count(*) FROM events WHERE event_type = 'error') AS failed,
    (SELECT count(*) FROM events WHERE {DONE}) AS completed, (SELECT round(avg(value), 4) FROM recent) AS mean_ms,
    (SELECT round(count(*) FILTER (event_type = 'error') / greatest(count(*) FILTER (event_type = 'error' OR {DONE}), 1), 6) FROM events) AS failure_rate,
    (SELECT round(avg(value) * (SELECT count(*) FILTER (event_type = 'click') / greatest(count(*) FILTER (event_type = 'signup'), 1) FROM events), 4) FROM recent) AS remaining_ms""")
def queue_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by status, and the mean duration of the latest ten thousand completed events, which is what the report is defined on."""
    events = R.table(spark, sf_dir, "events")
    done = F.col("event_type").isin("purchase", "view")
    failed = F.col("event_type") == "error"
    counts = events.agg(
        F.count_if(F.col("event_type") == "click").alias("pending"), F.count_if(F.col("event_type") == "signup").alias("working"), F.count_if(failed).alias("failed"), F.count_if(done).alias("completed"),
        F.round(F.count_if(failed) / F.greatest(F.count_if(failed | done), F.lit(1)), 6).alias("failure_rate"),
    )
    recent = events.where(done).orderBy(F.desc("ts"), F.desc("event_id")).limit(10_000).agg(F.avg("value").alias("mean"))
    joined = counts.join(F.broadcast(recent))  # one row each
    left = F.round(Q.remaining_ms(F.col("pending"), F.col("working"), F.col("mean")), 4)
    return joined.withColumn("mean_ms", F.round("mean", 4)).withColumn("remaining_ms", left).drop("working", "mean")


@query("""SELECT event_type, count(*) AS n, count(*) FILTER (value >= 90) AS slow, count(*) FILTER (ts >= TIMESTAMP '2024-01-30 22:00:00') AS last_hours, round(avg(value), 4) AS mean,
  round(quantile_cont(value, 0.5), 4) AS p50, round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99, arg_max(event_id, ts) AS newest FROM events GROUP BY 1""")
def queue_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    late = F.col("ts") >= F.lit("2024-01-30 22:00:00").cast("timestamp_ntz")
    events = R.table(spark, sf_dir, "events")
    summed = events.groupBy("event_type").agg(
        F.count("*").alias("n"), F.count_if(F.col("value") >= 90).alias("slow"), F.count_if(late).alias("last_hours"), F.round(F.avg("value"), 4).alias("mean"),
        F.max_by("event_id", "ts").alias("newest"),
    )
    found = M.with_percentiles(summed, events, ["event_type"], "value", p50=0.5, p95=0.95, p99=0.99)
    return found.withColumns({c: F.round(c, 4) for c in ("p50", "p95", "p99")})


@query("""SELECT time_bucket(INTERVAL '180 minutes', ts, TIMESTAMP '1970-01-01') AS bucket, count(*) AS n, round(avg(value), 4) AS mean, round(quantile_cont(value, 0.5), 4) AS p50,
  round(quantile_cont(value, 0.95), 4) AS p95, round(quantile_cont(value, 0.99), 4) AS p99 FROM events GROUP BY 1""")
def duration_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = M.duration_buckets(R.table(spark, sf_dir, "events"), "ts", "value", 180)
    return found.select("bucket", "n", *(F.round(c, 4).alias(c) for c in ("mean", "p50", "p95", "p99")))


@query("""SELECT l_shipmonth AS month, count(*) AS n, min(l_quantity) AS least, max(l_quantity) AS most, quantile_cont(l_quantity, 0.5) AS p50, round(quantile_cont(l_quantity, 0.95), 4) AS p95
  FROM (SELECT CAST(month(l_shipdate) AS INT) AS l_shipmonth, l_quantity FROM lineitem) GROUP BY 1""")
def percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = R.table(spark, sf_dir, "lineitem").select(F.month("l_shipdate").alias("month"), "l_quantity")
    summed = lines.groupBy("month").agg(F.count("*").alias("n"), F.min("l_quantity").alias("least"), F.max("l_quantity").alias("most"))
    return M.with_percentiles(summed, lines, ["month"], "l_quantity", p50=0.5, p95=0.95).withColumn("p95", F.round("p95", 4))


@query("""WITH s AS (SELECT user_id AS source, event_id AS id, CASE event_type WHEN 'signup' THEN 'discovery.completed' WHEN 'view' THEN 'batch.completed' ELSE event_type END AS kind,
    CAST(floor(value) AS BIGINT) AS records FROM events),
  d AS (SELECT *, max(id) FILTER (kind = 'discovery.completed') OVER (PARTITION BY source) AS discovery FROM s)
  SELECT source, discovery, count(*) FILTER (kind = 'batch.completed') AS batches, CAST(coalesce(sum(records) FILTER (kind = 'batch.completed'), 0) AS BIGINT) AS records
  FROM d WHERE id >= discovery GROUP BY 1, 2""")
def scrape_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.when(F.col("event_type") == "signup", "discovery.completed").when(F.col("event_type") == "view", "batch.completed").otherwise(F.col("event_type"))
    events = R.table(spark, sf_dir, "events")
    return M.progress(events.select(F.col("user_id").alias("source"), F.col("event_id").alias("id"), kind.alias("kind"), F.floor("value").alias("records")))


@query("SELECT user_id, max(event_id) AS last_id, arg_max(event_type, event_id) AS last_type FROM events WHERE event_type <> 'error' GROUP BY 1")
def latest_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = R.table(spark, sf_dir, "events").where("event_type <> 'error'")
    return events.groupBy("user_id").agg(F.max("event_id").alias("last_id"), F.max_by("event_type", "event_id").alias("last_type"))


CONFUSION_SQL = """count(*) FILTER (a = 1 AND p = 1) AS tp, count(*) FILTER (a = 0 AND p = 1) AS fp, count(*) FILTER (a = 1 AND p = 0) AS fn, count(*) FILTER (a = 0 AND p = 0) AS tn"""


@query(f"""WITH c AS (SELECT {CONFUSION_SQL} FROM (SELECT quality AS a, CASE WHEN n_chars >= 800 THEN 1 ELSE 0 END AS p FROM labels JOIN documents USING (doc_id)))
  SELECT *, round(coalesce(tp / nullif(tp + fp, 0), 0), 6) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) AS f1 FROM c""")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = R.table(spark, sf_dir, "labels").join(R.table(spark, sf_dir, "documents").select("doc_id", "n_chars"), "doc_id")
    found = joined.agg(*M.confusion(F.col("quality"), (F.col("n_chars") >= 800).cast("int")))
    return found.select("tp", "fp", "fn", "tn", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


@query("""WITH y AS (SELECT l_suppkey AS person_id, year(l_shipdate) AS y, CAST(sum(l_quantity) AS BIGINT) AS services FROM lineitem GROUP BY 1, 2)
  SELECT person_id, CAST(y AS INT) AS data_year, services FROM y QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY y DESC) = 1""")
def latest_per_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = R.table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("person_id"), F.year("l_shipdate").alias("data_year"))
    return M.first_by(years.agg(F.sum("l_quantity").cast("long").alias("services")), ["person_id"], F.desc("data_year"))


@query("""WITH c AS (SELECT o_custkey AS batch, o_orderkey AS candidate, floor(o_totalprice / 50000) AS score FROM orders),
  r AS (SELECT *, row_number() OVER (PARTITION BY batch ORDER BY score DESC, candidate) AS k, lead(score) OVER (PARTITION BY batch ORDER BY score DESC, candidate) AS second FROM c)
  SELECT batch, candidate, CAST(score AS DOUBLE) AS score, second IS NULL OR second < score - 1e-9::DOUBLE AS unique_best FROM r WHERE k = 1""")
def unique_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = R.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("batch"), F.col("o_orderkey").alias("candidate"), F.floor(F.col("o_totalprice") / 50000).cast("double").alias("score"))
    order = Window.partitionBy("batch").orderBy(F.desc("score"), "candidate")
    ranked = scored.withColumn("k", F.row_number().over(order)).withColumn("second", F.lead("score").over(order)).where("k = 1")
    return ranked.select("batch", "candidate", "score", (F.col("second").isNull() | (F.col("second") < F.col("score") - 1e-9)).alias("unique_best"))


@query("""SELECT l_suppkey AS person_id, l_orderkey AS study_id, l_linenumber AS line, l_extendedprice AS amount, rank FROM (SELECT *,
  CAST(row_number() OVER (PARTITION BY l_suppkey ORDER BY year(l_shipdate) DESC, l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey) AS INT) AS rank FROM lineitem) WHERE rank <= 20""")
def topk_per_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = (F.desc(F.year("l_shipdate")), F.desc("l_extendedprice"), F.asc("l_orderkey"), F.asc("l_linenumber"), F.asc("l_partkey"))
    top = M.top_by(R.table(spark, sf_dir, "lineitem"), ["l_suppkey"], 20, *order)
    return top.select(F.col("l_suppkey").alias("person_id"), F.col("l_orderkey").alias("study_id"), F.col("l_linenumber").alias("line"), F.col("l_extendedprice").alias("amount"), "rank")


@query("""SELECT o_orderkey AS study_id, count(*) OVER (PARTITION BY o_custkey) AS batch_size, bool_or(o_orderstatus = 'F') OVER (PARTITION BY o_custkey) AS any_approved FROM orders""")
def batch_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    batch = Window.partitionBy("o_custkey")
    orders = R.table(spark, sf_dir, "orders")
    return orders.select(F.col("o_orderkey").alias("study_id"), F.count("*").over(batch).alias("batch_size"), F.bool_or(F.col("o_orderstatus") == "F").over(batch).alias("any_approved"))


@query("""SELECT lang, source_kind, count(*) AS n, round(avg(CASE WHEN matched THEN 1.0 ELSE 0.0 END), 6) AS match_rate FROM
  (SELECT lang, source AS source_kind, n_chars >= 1000 AS matched FROM documents) GROUP BY 1, 2""")
def mapping_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = R.table(spark, sf_dir, "documents").withColumn("matched", (F.col("n_chars") >= 1000).cast("double"))
    return docs.groupBy("lang", F.col("source").alias("source_kind")).agg(F.count("*").alias("n"), F.round(F.avg("matched"), 6).alias("match_rate"))


@query("""SELECT lang, count(*) FILTER (source = 'src0') AS src0, count(*) FILTER (source = 'src1') AS src1, count(*) FILTER (source = 'src2') AS src2 FROM documents GROUP BY 1""")
def crosstab(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = R.table(spark, sf_dir, "documents").groupBy("lang").pivot("source", ["src0", "src1", "src2"]).count()
    return counts.fillna(0, ["src0", "src1", "src2"])


@query("""SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_batches, round(avg(CASE WHEN o_orderstatus = 'F' THEN 1.0 ELSE 0.0 END), 6) AS positive_rate,
  round(avg(CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END), 6) AS coverage FROM orders""")
def training_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = lambda c: F.round(F.avg(c.cast("double")), 6)
    return R.table(spark, sf_dir, "orders").agg(
        F.count("*").alias("n_rows"), F.count_distinct("o_custkey").alias("n_batches"), share(F.col("o_orderstatus") == "F").alias("positive_rate"), share(F.col("o_totalprice") > 150000).alias("coverage")
    )


@query("""WITH b AS (SELECT o_custkey, arg_max(CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END, o_totalprice * 100000 + o_orderkey / 1000000.0) AS won FROM orders GROUP BY 1)
  SELECT count(*) AS n_batches, round(avg(won), 6) AS accuracy FROM b""")
def batch_winner(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = F.col("o_totalprice") * 100000 + F.col("o_orderkey") / 1000000.0
    won = R.table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.max_by((F.col("o_orderstatus") == "F").cast("int"), order).alias("won"))
    return won.agg(F.count("*").alias("n_batches"), F.round(F.avg("won"), 6).alias("accuracy"))


@query("""SELECT count(*) AS compared, count(*) FILTER ((a.value >= 50) <> (b.value >= 50)) AS accept_differs, round(max(abs(a.value - b.value)), 4) AS most_apart
  FROM events a JOIN events b ON a.event_id = b.event_id - 1""")
def model_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = R.table(spark, sf_dir, "events").select((F.col("event_id") + 1).alias("id"), F.col("value").alias("a"))
    b = R.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.col("value").alias("b"))
    return a.join(b, "id").agg(
        F.count("*").alias("compared"), F.count_if((F.col("a") >= 50) != (F.col("b") >= 50)).alias("accept_differs"), F.round(F.max(F.abs(F.col("a") - F.col("b"))), 4).alias("most_apart")
    )
