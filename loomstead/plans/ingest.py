"""Ingestion: the paged scan, the coverage of a backfill and its sweeps, names judged as they come, runs and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.functions import payloads as P
from loomstead.functions import text as T
from loomstead.functions import vocabulary as V
from loomstead.operators import backfill as B
from loomstead.operators import intervals as I
from loomstead.operators import metrics as M
from loomstead.operators import queue as Q
from loomstead.operators import upsert as U
from loomstead.plans import roles as R
from loomstead.plans.registry import query
from loomstead.plans.roles import scratch
from loomstead.plans.streams import drained, sliced
from loomstead.sources import paged

# --- the paged scan


def page_folder(spark: SparkSession, sf_dir: str) -> str:
    """A folder of pages of all studies, in the order of the days on which they were updated."""
    day = F.date_format("start_date", "yyyy-MM-dd")
    protocol = F.struct(
        F.struct(F.concat(F.lit("NCT"), F.col("study_id").cast("string")).alias("nctId"), F.col("title").alias("briefTitle")).alias("identificationModule"),
        F.struct(F.col("status").alias("overallStatus"), F.struct(day.alias("date")).alias("lastUpdatePostDateStruct")).alias("statusModule"),
    )
    path = scratch(spark, "paged")
    studies = R.studies(spark, sf_dir).select("study_id", F.col("start_date").alias("updated"), F.to_json(F.struct(protocol.alias("protocolSection"))).alias("study"))
    paged.write_pages(studies, path, 500, "study_id")
    return path


def read_fields(rows: DataFrame) -> list:
    """nct_id and status of a page's study."""
    at = lambda path: F.get_json_object("study", f"$.protocolSection.{path}")
    return [at("identificationModule.nctId").alias("nct_id"), at("statusModule.overallStatus").alias("status")]


@query(f"{R.WITH} SELECT 'NCT' || study_id AS nct_id, status, start_date AS updated FROM studies WHERE start_date BETWEEN DATE '1996-01-15' AND DATE '1996-03-01'")
def paged_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Studies updated in a window of days; only the pages that it meets are opened."""
    found = paged.read_window(spark, page_folder(spark, sf_dir), "1996-01-15", "1996-03-01")
    return found.select(*read_fields(found), "updated")


@query(f"{R.WITH} SELECT 'NCT' || study_id AS nct_id, start_date AS updated FROM studies WHERE start_date >= DATE '1995-01-01' ORDER BY start_date, study_id LIMIT 300")
def paged_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three hundred studies updated since a year."""
    found = paged.first_updated(spark, page_folder(spark, sf_dir), 300, "1995")
    return found.select(read_fields(found)[0], "updated")


@query(f"{R.WITH} SELECT status, count(*) AS n, min(start_date) AS first, max(start_date) AS last FROM studies GROUP BY status")
def paged_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a stream over the pages brings, by status."""
    path = scratch(spark, "paged-stream")
    drained(paged.stream_updates(spark, page_folder(spark, sf_dir)), path)
    rows = spark.read.parquet(f"{path}/out")
    return rows.select(*read_fields(rows), "updated").groupBy("status").agg(F.count("*").alias("n"), F.min("updated").alias("first"), F.max("updated").alias("last"))


# --- the coverage of a backfill

WINDOWS_SQL = """o AS (SELECT o_orderpriority AS source, CAST(o_orderdate AS DATE) AS d, o_orderstatus AS s FROM orders),
  planned AS (SELECT source, CAST(date_trunc('month', d) AS DATE) AS a, last_day(d) AS b, count(*) AS n FROM o GROUP BY ALL),
  done AS (SELECT source, CAST(date_trunc('week', d) AS DATE) AS s, CAST(date_trunc('week', d) AS DATE) + CASE WHEN 5 * count(*) FILTER (s = 'F') > 3 * count(*) THEN 45 ELSE 6 END AS e
    FROM o GROUP BY source, date_trunc('week', d) HAVING 2 * count(*) FILTER (s = 'F') > count(*))"""


def sweep_windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Months of each source as planned windows, and weeks of mostly completed studies as done ones, which reach on for longer where there were more."""
    day = F.to_date("o_orderdate")
    orders = R.table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("source"), day.alias("d"), (F.col("o_orderstatus") == "F").alias("ok"))
    month, week = F.to_date(F.date_trunc("month", "d")), F.to_date(F.date_trunc("week", "d"))
    planned = orders.groupBy("source", month.alias("start"), F.last_day("d").alias("end")).agg(F.count("*").alias("n"))
    counted = orders.groupBy("source", week.alias("start")).agg(F.count("*").alias("n"), F.count_if("ok").alias("ok")).where("2 * ok > n")
    return planned, counted.select("source", "start", F.date_add("start", F.when(F.expr("5 * ok > 3 * n"), 45).otherwise(6)).alias("end"))


@query(f"""WITH {WINDOWS_SQL}, open AS (SELECT source, a, CAST(g AS DATE) AS day FROM (SELECT source, a, unnest(generate_series(a::TIMESTAMP, b::TIMESTAMP, INTERVAL 1 DAY)) AS g FROM planned) p
    WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.source = p.source AND CAST(p.g AS DATE) BETWEEN d.s AND d.e)),
  r AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY source, a ORDER BY day) AS INT) AS run FROM open)
  SELECT source, a AS planned_from, min(day) AS left_from, max(day) AS left_to, count(*) AS days FROM r GROUP BY source, a, run""")
def coverage_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is left of the planned windows of each source without the union of those done."""
    planned, done = sweep_windows(spark, sf_dir)
    left = I.without(planned, done, ["source"])
    days = I.days(F.col("left_start"), F.col("left_end")).cast("long")
    return left.select("source", F.col("start").alias("planned_from"), F.col("left_start").alias("left_from"), F.col("left_end").alias("left_to"), days.alias("days"))


@query(f"""WITH {WINDOWS_SQL}, days AS (SELECT DISTINCT source, CAST(unnest(generate_series(s::TIMESTAMP, e::TIMESTAMP, INTERVAL 1 DAY)) AS DATE) AS day FROM done),
  r AS (SELECT *, day - CAST(row_number() OVER (PARTITION BY source ORDER BY day) AS INT) AS run FROM days)
  SELECT source, min(day) AS done_from, max(day) AS done_to FROM r GROUP BY source, run""")
def coverage_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The days done of each source as few windows."""
    return I.union_of(sweep_windows(spark, sf_dir)[1], ["source"]).withColumnsRenamed({"start": "done_from", "end": "done_to"})


@query(f"""WITH {WINDOWS_SQL}, q AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY a, b) - 1 AS i FROM planned p
    WHERE NOT EXISTS (SELECT 1 FROM done d WHERE d.source = p.source AND p.a >= d.s AND p.b <= d.e))
  SELECT source, i AS chunk_index, '{{"chunkIndex":' || i || ',"count":' || n || ',"dateFrom":"' || a || '","dateTo":"' || b || '"}}' AS data FROM q""")
def backfill_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The windows that a sweep queues: all but those that a completed one holds."""
    planned, done = sweep_windows(spark, sf_dir)
    return B.queued(planned, done, ["source"]).select("source", F.col("chunk_index").cast("long").alias("chunk_index"), "data")


@query("""WITH t AS (SELECT o_custkey AS source, CASE max(o_orderkey) % 4 WHEN 0 THEN 'in-progress' WHEN 1 THEN 'failed' WHEN 2 THEN 'complete' END AS status, count(*) FILTER (o_orderstatus = 'O') AS waiting,
    count(*) FILTER (o_orderstatus = 'P') AS dead, count(*) - 2 * count(*) FILTER (o_orderstatus = 'F') AS gap, max(o_orderkey) % 11 = 0 AS forced FROM orders GROUP BY 1)
  SELECT source, CASE WHEN forced AND coalesce(status = 'in-progress', false) THEN 'none' WHEN forced THEN 'plan all' WHEN status = 'in-progress' THEN CASE WHEN waiting > 0 THEN 'refresh' WHEN dead > 0 THEN 'fail' ELSE 'reconcile' END
      WHEN gap <= 1 THEN CASE WHEN status = 'failed' THEN 'close' ELSE 'none' END ELSE 'plan' END AS action,
    CASE WHEN forced THEN 'in-progress' WHEN status = 'in-progress' THEN CASE WHEN waiting > 0 THEN status WHEN dead > 0 THEN 'failed' ELSE 'complete' END
      WHEN gap <= 1 THEN CASE WHEN status = 'failed' THEN 'complete' ELSE status END ELSE 'in-progress' END AS status FROM t""")
def sweep_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the sweep of each source does next; sponsors are the sources, and their studies tell how far they are."""
    status, last = F.col("o_orderstatus"), F.max("o_orderkey")
    at = F.when(last % 4 == 0, "in-progress").when(last % 4 == 1, "failed").when(last % 4 == 2, "complete")
    told = R.table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("source")).agg(
        at.alias("status"), F.count_if(status == "O").alias("waiting"), F.count_if(status == "P").alias("dead"), (F.count("*") - 2 * F.count_if(status == "F")).alias("gap"), (last % 11 == 0).alias("forced")
    )
    step = B.sweep_step(*(F.col(c) for c in ("status", "waiting", "dead", "gap")), 1, F.col("forced"))
    return told.select("source", step.alias("s")).select("source", "s.*")


# --- names checked as they are written


def quoted(values: list[str]) -> str:
    return ", ".join("'" + v.upper().replace("'", "''") + "'" for v in values)


def any_of(text: str, patterns: list[str]) -> str:
    return " OR ".join(f"regexp_matches({text}, '{p}')" for p in patterns)


#: What a name gets before and after it by the place of its line, so that every rule meets names of every kind.
DRESSED = {1: ("", " Inc."), 2: ("Contact ", ""), 3: ("", " & Sons"), 4: ("", " Research Institute"), 5: ("Pfizer ", ""), 6: ("", ", Study_Chair"), 7: ("", ", Sponsor")}

SHAPES_SQL = "CASE i % 9 " + " ".join(f"WHEN {k} THEN '{a}' || w2 || '{b}'" for k, (a, b) in DRESSED.items()) + f" WHEN 8 THEN CASE WHEN i % 2 = 0 THEN '{V.NOT_PERSONS[0].lower()}' ELSE repeat(replace(w2, ' ', ''), 3) END ELSE CASE doc_id % 4 WHEN 0 THEN line[:2] WHEN 1 THEN '  ' ELSE line END END"

NAMES_SQL = rf"""lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents),
  made AS (SELECT doc_id, i, CASE WHEN i % 5 = 0 THEN ' sub_investigator ' END AS role, {SHAPES_SQL} AS name FROM (SELECT *, array_to_string(list_filter(string_split(line, ' '), lambda x: trim(x) <> '')[1:2], ' ') AS w2 FROM lines)),
  cut AS (SELECT *, trim(name) AS t0, upper(replace(trim(regexp_extract(trim(name), '(?s)^.+,([^,]*)$', 1)), '_', ' ')) AS label FROM made),
  bare AS (SELECT *, CASE WHEN label IN ({quoted([*V.ROLE_PREFIXES, *(r for r in V.INVESTIGATOR_ROLES if "_" not in r)])}) THEN trim(regexp_extract(t0, '(?s)^(.+),[^,]*$', 1)) ELSE t0 END AS t FROM cut),
  worded AS (SELECT *, upper(t) AS u, list_filter(string_split(t, ' '), lambda x: trim(x) <> '') AS w FROM bare),
  judged AS (SELECT *, CASE WHEN regexp_full_match(coalesce(name, ''), '\s*') OR regexp_full_match(t, '\s*') THEN 'EmptyOrNull'
      WHEN regexp_matches(t, '[^\P{{L}}A-Za-z]') THEN CASE WHEN length(t) < 2 OR len(w) > 6 THEN 'NonLatinName' END
      WHEN length(t) < 3 THEN 'TooShort' WHEN length(t) > 100 THEN 'TooLong' WHEN len(w) > 10 THEN 'TooManyWords' WHEN u IN ({quoted(V.NOT_PERSONS)}) THEN 'KnownNonHumanName'
      WHEN {" OR ".join(f"starts_with(u, '{p}')" for p in V.ROLE_PREFIXES)} THEN 'RolePrefix' WHEN upper(regexp_replace(w[-1], '[,.]+$', '')) IN ({quoted(V.CORPORATE_SUFFIXES)}) THEN 'CorporateSuffix'
      WHEN contains(t, ' & ') THEN 'Ampersand' WHEN {any_of("u", ["(^| )" + " +".join(x.replace(".", "[.]") + "S?[,.;:!?]*" for x in k.split(" ")) + "( |$)" for k in V.ORGANISATION_WORDS])} THEN 'OrgKeywords'
      WHEN upper(regexp_replace(w[1], '[,.]+$', '')) IN ({quoted(V.COMPANIES)}) THEN 'PharmaBlocklist'
      WHEN len(w) = 1 AND length(t) > 20 AND NOT coalesce(upper(trim(role)) IN ({quoted(V.INVESTIGATOR_ROLES)}), false) THEN 'SingleLongWord' END AS kind FROM worded)"""

#: Kinds of reasons in their order; fixed values.
REASONS = "EmptyOrNull NonLatinName TooShort TooLong TooManyWords KnownNonHumanName RolePrefix CorporateSuffix Ampersand OrgKeywords PharmaBlocklist SingleLongWord".split()


def name_batch(spark: SparkSession, sf_dir: str) -> U.Batch:
    """Names made of the lines of all documents, judged as they are written."""
    lines = R.table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("i", "line"))
    two = lines.withColumn("w2", F.array_join(F.slice(T.tokens(F.col("line")), 1, 2), " "))
    at = F.col("i") % 9
    name = F.when(at == 8, F.when(F.col("i") % 2 == 0, V.NOT_PERSONS[0].lower()).otherwise(F.repeat(F.replace("w2", F.lit(" "), F.lit("")), 3)))
    for k, (before, after) in DRESSED.items():
        name = name.when(at == k, F.concat(F.lit(before), "w2", F.lit(after)))
    plain = F.when(F.col("doc_id") % 4 == 0, F.substring("line", 1, 2)).when(F.col("doc_id") % 4 == 1, "  ").otherwise(F.col("line"))
    names = two.select("doc_id", "i", F.when(F.col("i") % 5 == 0, " sub_investigator ").alias("role"), name.otherwise(plain).alias("name"))
    kinds = {k: F.coalesce(F.startswith("_reason", F.lit(k)), F.lit(False)) for k in REASONS}
    return U.write_batch(names, T.not_human_reason(F.col("name"), F.col("role")), R.scratch(spark, "names"), kinds)


@query(f"WITH {NAMES_SQL} SELECT kind, count(*) AS n FROM judged WHERE kind IS NOT NULL GROUP BY 1 UNION ALL SELECT 'all', count(*) FROM judged UNION ALL SELECT 'taken', count(*) FROM judged WHERE kind IS NULL")
def name_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many names were taken and how many set apart, by reason, as observed while they were written."""
    counts = name_batch(spark, sf_dir).counts
    rows = [("all", counts["n"]), ("taken", counts["taken"]), *((k, counts[k]) for k in REASONS if counts[k])]
    return spark.createDataFrame(rows, "kind string, n long")


@query(f"WITH {NAMES_SQL} SELECT doc_id, i, kind FROM judged WHERE kind IS NOT NULL")
def name_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The names set apart, with the kind of their reason."""
    return name_batch(spark, sf_dir).rejected.select("doc_id", F.col("i").cast("long").alias("i"), F.substring_index("reason", ":", 1).alias("kind"))


# --- runs and reports

RUN_SQL = """e AS (SELECT user_id AS source, ts AS t, value FROM events WHERE event_type <> 'error'), m AS (SELECT *, t - lag(t) OVER (PARTITION BY source ORDER BY t) AS d FROM e),
  r AS (SELECT *, sum(CASE WHEN d <= INTERVAL 4 HOUR THEN 0 ELSE 1 END) OVER (PARTITION BY source ORDER BY t ROWS UNBOUNDED PRECEDING) AS run FROM m),
  runs AS (SELECT source, min(t) AS started, max(t) AS ended, count(*) AS n, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS records FROM r GROUP BY source, run)"""

PLAIN = ["source", "n", "records"]


def run_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = R.table(spark, sf_dir, "events").where("event_type <> 'error'")
    return events.select(F.col("user_id").alias("source"), F.col("ts").cast("timestamp").alias("at"), F.col("value").cast("decimal(18,2)").alias("value"))


def shown_runs(found: DataFrame) -> DataFrame:
    return found.select(*PLAIN, *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("started", "ended")))


@query(f"WITH {RUN_SQL} SELECT * FROM runs")
def scrape_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of each source: events four hours apart at most."""
    return shown_runs(M.runs(run_events(spark, sf_dir), "4 hours", records=F.sum("value").cast("double")))


@query(f"WITH {RUN_SQL} SELECT * FROM runs WHERE ended + INTERVAL 4 HOUR <= (SELECT max(t) - INTERVAL 1 HOUR FROM e)")
def stream_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from a stream in four batches: runs that are over by the last watermark."""
    path = scratch(spark, "runs")
    events = sliced(spark, run_events(spark, sf_dir), "run-events").withWatermark("at", "1 hour")
    drained(M.runs(events, "4 hours", records=F.sum("value").cast("double")), path)
    return shown_runs(spark.read.parquet(f"{path}/out"))


@query("""WITH l AS (SELECT l_returnflag AS source, l_linestatus AS category, p_brand AS prefix, l_orderkey AS study, l_discount >= 0.05 AS matched FROM lineitem JOIN part ON p_partkey = l_partkey),
  c AS (SELECT 'source' AS report, source, NULL AS category, NULL AS prefix, NULL::BIGINT AS study, count(*) AS n, count(*) FILTER (matched) AS matched FROM l GROUP BY source
    UNION ALL SELECT 'crosstab', source, category, NULL, NULL, count(*), count(*) FILTER (matched) FROM l GROUP BY source, category
    UNION ALL (SELECT 'prefix', NULL, NULL, prefix, NULL, count(*) AS n, count(*) FILTER (matched) FROM l GROUP BY prefix ORDER BY n DESC, prefix LIMIT 20)
    UNION ALL (SELECT 'study', NULL, NULL, NULL, study, count(*) AS n, count(*) FILTER (matched) FROM l GROUP BY study ORDER BY n DESC, study LIMIT 30))
  SELECT *, round(matched / n, 6) AS match_rate FROM c""")
def report_cuts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Match rates by source, sources by category, and the most frequent prefixes and studies, from one pass."""
    parts = R.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_brand").alias("prefix"))
    lines = R.table(spark, sf_dir, "lineitem").join(parts, "l_partkey")
    named = lines.select(F.col("l_returnflag").alias("source"), F.col("l_linestatus").alias("category"), "prefix", F.col("l_orderkey").alias("study"), (F.col("l_discount") >= 0.05).alias("matched"))
    reports = {"source": ["source"], "crosstab": ["source", "category"], "prefix": ["prefix"], "study": ["study"]}
    found = M.cuts(named, reports, {"prefix": 20, "study": 30}, matched=F.count_if("matched"))
    return found.withColumn("match_rate", F.round(F.col("matched") / F.col("n"), 6))


PERSONS_SQL = """p AS (SELECT c_custkey, c_acctbal > 8000 AS fresh, c_mktsegment <> 'BUILDING' AS human, CASE WHEN c_acctbal > 0 THEN c_custkey END AS npi, CASE WHEN c_acctbal < -500 THEN 'not_found' WHEN c_acctbal < -200 THEN 'ambiguous' END AS result, c_acctbal > 9900 AS removed FROM customer)"""


def looked_up(spark: SparkSession, sf_dir: str) -> DataFrame:
    balance = F.col("c_acctbal")
    return R.table(spark, sf_dir, "customer").select(
        (balance > 8000).alias("fresh"), (F.col("c_mktsegment") != "BUILDING").alias("human"), F.when(balance > 0, F.col("c_custkey")).alias("npi"),
        F.when(balance < -500, "not_found").when(balance < -200, "ambiguous").alias("result"), (balance > 9900).alias("removed"),
    )


@query(f"""WITH {PERSONS_SQL} SELECT count(*) AS everyone, count(*) FILTER (fresh) AS since, count(*) FILTER (NOT removed) AS active, count(*) FILTER (human) AS human, count(npi) AS with_number,
  count(*) FILTER (result = 'not_found') AS not_found, count(*) FILTER (result = 'ambiguous') AS ambiguous, count(*) FILTER (npi IS NULL AND result IS NULL) AS not_attempted FROM p""")
def person_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons by all that is counted of them, in one pass."""
    c = F.col
    return M.counted(
        looked_up(spark, sf_dir), everyone=F.lit(True), since=c("fresh"), active=~c("removed"), human=c("human"), with_number=c("npi").isNotNull(),
        not_found=c("result") == "not_found", ambiguous=c("result") == "ambiguous", not_attempted=c("npi").isNull() & c("result").isNull(),
    )


@query(f"WITH {PERSONS_SQL} SELECT coalesce(CASE WHEN npi IS NOT NULL THEN 'found' ELSE result END, 'pending') AS result, count(*) AS n FROM p WHERE human GROUP BY 1")
def enrichment_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What looking persons up told, of humans only; those not looked up yet are pending."""
    told = F.coalesce(F.when(F.col("npi").isNotNull(), "found").otherwise(F.col("result")), F.lit("pending"))
    return looked_up(spark, sf_dir).where("human").groupBy(told.alias("result")).agg(F.count("*").alias("n"))


# --- work that comes again

AGAIN_SQL = """ev AS (SELECT 'investigator.discovered' AS event_type, CAST(l_suppkey AS VARCHAR) AS data, CASE WHEN l_discount < 0.05 THEN 'dead-letter' ELSE 'completed' END AS status FROM lineitem WHERE l_quantity = 50 AND l_linenumber = 1
    UNION ALL SELECT 'other', CAST(s_suppkey AS VARCHAR), 'pending' FROM supplier)"""


def work_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = R.table(spark, sf_dir, "lineitem").where("l_quantity = 50 and l_linenumber = 1")
    status = F.when(F.col("l_discount") < 0.05, "dead-letter").otherwise("completed")
    own = lines.select(F.lit("investigator.discovered").alias("event_type"), F.col("l_suppkey").cast("string").alias("data"), status.alias("status"))
    return own.unionByName(R.table(spark, sf_dir, "supplier").select(F.lit("other").alias("event_type"), F.col("s_suppkey").cast("string").alias("data"), F.lit("pending").alias("status")))


@query(f"""WITH {AGAIN_SQL} SELECT event_type, status, count(*) AS n FROM (SELECT * FROM ev UNION ALL SELECT 'investigator.discovered', CAST(s_suppkey AS VARCHAR), 'pending' FROM supplier
  WHERE CAST(s_suppkey AS VARCHAR) NOT IN (SELECT data FROM ev WHERE event_type = 'investigator.discovered' AND status <> 'dead-letter')) GROUP BY 1, 2""")
def requeued_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The queue after each person without a live event of a type got one, by type and status."""
    after = Q.requeued(R.table(spark, sf_dir, "supplier"), work_events(spark, sf_dir), "investigator.discovered", F.lit(R.AS_OF), "s_suppkey")
    return after.groupBy("event_type", "status").agg(F.count("*").alias("n"))


@query(f"""WITH {PERSONS_SQL.replace("c_custkey,", "c_custkey AS id,", 1)} SELECT (SELECT count(*) FROM p WHERE result = 'ambiguous' AND NOT human) AS ambiguous, (SELECT count(*) FROM orders JOIN p ON id = o_custkey WHERE NOT coalesce(result = 'ambiguous' AND human, false)) AS candidates,
  (SELECT count(*) FROM p WHERE result = 'ambiguous' AND human) AS queued""")
def ambiguous_again(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Persons that stay ambiguous, candidates that are left, and look-ups queued after ambiguous ones start anew; orders stand for candidates."""
    persons = R.table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("person_id"), F.when(F.col("c_acctbal") < -500, "not_found").when(F.col("c_acctbal") < -200, "ambiguous").alias("result"), (F.col("c_mktsegment") != "BUILDING").alias("human")
    )
    stored = R.table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("person_id"))
    none = work_events(spark, sf_dir).limit(0)
    cleared, left, queued = Q.looked_up_again(persons, stored, none, "investigator.enrichment", F.lit(R.AS_OF))
    counts = [cleared.where("result = 'ambiguous'").agg(F.count("*").alias("ambiguous")), left.agg(F.count("*").alias("candidates")), queued.agg(F.count("*").alias("queued"))]
    return counts[0].join(F.broadcast(counts[1])).join(F.broadcast(counts[2]))  # a row each


@query("SELECT user_id, CAST('{\"count\":' || count(*) || ',\"from\":\"' || strftime(min(ts), '%Y-%m-%dT%H:%M:%SZ') || '\",\"to\":\"' || strftime(max(ts), '%Y-%m-%dT%H:%M:%SZ') || '\"}' AS VARCHAR) AS payload, count(*) AS n FROM events GROUP BY 1")
def window_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payloads of discoveries, and the counts that are read from them again."""
    found = R.table(spark, sf_dir, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b"))
    told = found.select("user_id", P.written(F.col("n"), F.col("a"), F.col("b")).alias("payload"))
    return told.select("user_id", "payload", P.incremental(F.col("payload"))["count"].alias("n"))
