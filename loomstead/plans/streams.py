"""Queries that run as streams, or fit a model."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.operators.assembly import model_vector, stratified
from loomstead.plans import roles as R
from loomstead.plans.people import CERTAIN, MATCHES, candidates
from loomstead.plans.registry import query
from loomstead.plans.roles import scratch
from loomstead.streaming.queue import cursors, duration_windows, leased_states, queue_states


def drained(stream: DataFrame, path: str, mode: str = "append") -> None:
    """Runs a stream over all that is there, and writes what each batch gives out to a folder by its number, so a batch that runs again replaces it."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/out/batch={number}")

    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True)
    writer.foreachBatch(keep).start().awaitTermination()


@query()
def stream_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state of each user's work item after a stream of outcomes; the last state of each is kept."""
    events = spark.readStream.schema(R.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    kind = F.col("event_type")
    outcome = F.when(kind == "click", "claimed").when(kind == "purchase", "done").when(kind == "error", "failed").when(kind == "view", "retried").otherwise("released")
    path = scratch(spark, "states")
    drained(queue_states(events.select(F.col("user_id").alias("id"), outcome.alias("outcome"), F.col("event_id").alias("seq"))), path, "update")
    states = spark.read.parquet(f"{path}/out")
    return states.groupBy("id").agg(F.max_by(F.struct("status", "retry_count"), "batch").alias("s")).select("id", "s.status", "s.retry_count")


@query("""WITH b AS (SELECT time_bucket(INTERVAL '360 minutes', ts, TIMESTAMP '1970-01-01') AS bucket, value FROM events), late AS (SELECT max(ts) - INTERVAL '1 hour' AS w FROM events)
  SELECT bucket, count(*) AS n, round(avg(value), 4) AS mean FROM b, late GROUP BY bucket, w HAVING bucket + INTERVAL '360 minutes' <= w""")
def stream_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Durations over windows of six hours, once the watermark has passed them."""
    events = spark.readStream.schema(R.table(spark, sf_dir, "events").schema).parquet(f"{sf_dir}/events.parquet*")
    path = scratch(spark, "windows")
    drained(duration_windows(events.select(F.col("ts").cast("timestamp").alias("completed_at"), F.col("value").alias("duration_ms")), 360), path)
    return spark.read.parquet(f"{path}/out").select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "n", F.round("mean", 4).alias("mean"))


def sliced(spark: SparkSession, events: DataFrame, name: str, n: int = 4) -> DataFrame:
    """A stream of events in n batches, each a range of time, as they would come day by day."""
    path = scratch(spark, name)
    first, last = events.agg(F.min("at"), F.max("at")).first()
    step = ((last - first) / n) if first else None
    for k in range(n if first else 0):
        upto = F.col("at") <= F.lit(last) if k == n - 1 else F.col("at") < F.lit(first + (k + 1) * step)
        events.where((F.col("at") >= F.lit(first + k * step)) & upto).repartition(1).write.mode("append").parquet(path)
    if not first:
        events.write.parquet(path)
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(path)


WORK_SQL = """e AS (SELECT user_id * 10 + day(ts) // 7 AS id, epoch_us(ts) // 1000 AS t, CASE event_type WHEN 'click' THEN 'claimed' WHEN 'purchase' THEN 'done' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'progress' ELSE 'retried' END AS outcome,
    CASE user_id % 3 WHEN 0 THEN 720 ELSE 30 END * 60000 AS lease, CASE user_id % 3 WHEN 1 THEN 3 ELSE 4 END AS most, row_number() OVER (PARTITION BY user_id * 10 + day(ts) // 7 ORDER BY ts, event_id) AS rn FROM events)"""


@query(f"""WITH RECURSIVE {WORK_SQL}, s AS (SELECT DISTINCT id, CAST(0 AS BIGINT) AS rn, 'pending' AS status, 0 AS retries, CAST(0 AS BIGINT) AS since, 0 AS released, CAST(0 AS BIGINT) AS lease FROM e
  UNION ALL SELECT id, rn, CASE WHEN outcome = 'claimed' AND status = 'pending' THEN 'processing' WHEN outcome = 'done' AND status = 'processing' THEN 'completed'
      WHEN outcome = 'failed' AND status = 'processing' THEN CASE WHEN retries + 1 >= most THEN 'dead-letter' ELSE 'pending' END WHEN outcome = 'retried' AND status = 'dead-letter' THEN 'pending' ELSE status END,
    CASE WHEN outcome = 'failed' AND status = 'processing' THEN retries + 1 WHEN outcome = 'retried' AND status = 'dead-letter' THEN 0 ELSE retries END,
    CASE WHEN outcome = 'claimed' AND status = 'pending' OR outcome = 'progress' AND status = 'processing' THEN t ELSE since END, released, lease
    FROM (SELECT e.*, CASE WHEN s.status = 'processing' AND s.since + e.lease < e.t THEN 'pending' ELSE s.status END AS status, s.retries, s.since,
      s.released + CASE WHEN s.status = 'processing' AND s.since + e.lease < e.t THEN 1 ELSE 0 END AS released FROM s JOIN e ON e.id = s.id AND e.rn = s.rn + 1)),
  f AS (SELECT *, status = 'processing' AND since + lease < (SELECT max(epoch_us(ts) // 1000) FROM events) AS gone FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY rn DESC) = 1)
  SELECT id, CASE WHEN gone THEN 'pending' ELSE status END AS status, retries AS retry_count, released + CASE WHEN gone THEN 1 ELSE 0 END AS released FROM f""")
def stream_leases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Work under leases over four batches of outcomes: a user's week is an item, some of which may take half a day and others half an hour."""
    events, kind = R.table(spark, sf_dir, "events"), F.col("event_type")
    outcome = F.when(kind == "click", "claimed").when(kind == "purchase", "done").when(kind == "error", "failed").when(kind == "view", "progress").otherwise("retried")
    work = F.when(F.col("user_id") % 3 == 0, "studies.backfill").when(F.col("user_id") % 3 == 1, "publications.scrub").otherwise("studies.discovered")
    item = F.expr("user_id * 10 + dayofmonth(ts) div 7")
    rows = events.select(item.alias("id"), work.alias("kind"), outcome.alias("outcome"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("seq"))
    path = scratch(spark, "leases")
    drained(leased_states(sliced(spark, rows, "outcomes")), path, "update")
    states = spark.read.parquet(f"{path}/out")
    return states.groupBy("id").agg(F.max_by(F.struct("status", "retry_count", "released"), "batch").alias("s")).select("id", "s.*")


@query("""WITH RECURSIVE e AS (SELECT user_id AS source, event_id AS seq, epoch_us(ts) // 1000 AS now, CASE event_type WHEN 'view' THEN 'done' WHEN 'error' THEN 'failed' ELSE 'discover' END AS command,
    CAST(json_extract(props, '$.k') AS BIGINT) % 3 AS found, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM events),
  s AS (SELECT DISTINCT source, CAST(0 AS BIGINT) AS rn, CAST(NULL AS BIGINT) AS cur, CAST(NULL AS BIGINT) AS upto, CAST(-1 AS BIGINT) AS seq FROM e
    UNION ALL SELECT e.source, e.rn,
      CASE WHEN command = 'discover' AND upto IS NULL AND found = 0 THEN CASE WHEN cur IS NULL THEN now ELSE greatest(cur, least(cur + 86400000, now)) END WHEN command = 'done' AND upto IS NOT NULL THEN upto ELSE cur END,
      CASE WHEN command = 'discover' AND upto IS NULL THEN CASE WHEN found > 0 THEN CASE WHEN cur IS NULL THEN now ELSE greatest(cur, least(cur + 86400000, now)) END END WHEN command = 'done' THEN NULL ELSE upto END, e.seq
    FROM s JOIN e ON e.source = s.source AND e.rn = s.rn + 1)
  SELECT source, cur AS cursor_ms, upto AS open_to_ms, seq FROM s QUALIFY row_number() OVER (PARTITION BY source ORDER BY rn DESC) = 1""")
def stream_cursor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cursors of sources over four batches of commands, each with one owner: a user is a source."""
    events, kind = R.table(spark, sf_dir, "events"), F.col("event_type")
    command = F.when(kind == "view", "done").when(kind == "error", "failed").otherwise("discover")
    found = F.get_json_object("props", "$.k").cast("long") % 3
    rows = events.select(F.col("user_id").alias("source"), F.col("event_id").alias("seq"), command.alias("command"), F.col("ts").cast("timestamp").alias("at"), found.alias("found"))
    path = scratch(spark, "cursors")
    drained(cursors(sliced(spark, rows, "commands")), path, "update")
    states = spark.read.parquet(f"{path}/out")
    return states.groupBy("source").agg(F.max_by(F.struct("cursor_ms", "open_to_ms", "seq"), "batch").alias("s")).select("source", "s.*")


@query()
def npi_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A logistic regression on candidates' twenty-one features, fitted on four fifths of each label: AUC and precision at 0.6 on the others."""
    marked = candidates(spark, sf_dir).withColumn("label", (F.col("corroborated") & ~F.col("deactivated")).cast("double"))
    vector = model_vector(MATCHES, CERTAIN)
    filled = stratified(marked.select("label", "number", *(c.alias(name) for name, c in vector.items())), "label", "number")
    frame = VectorAssembler(inputCols=list(vector), outputCol="raw").transform(filled)
    train = frame.where("not held_out")
    scaler = StandardScaler(inputCol="raw", outputCol="features", withMean=True).fit(train)
    fitted, path = LogisticRegression(maxIter=20, regParam=0.01).fit(scaler.transform(train)), scratch(spark, "model")
    fitted.save(path)
    model = LogisticRegressionModel.load(path)  # without its training summary, which drags a session along that can't be sent once it has observed a batch
    told = model.transform(scaler.transform(frame.where("held_out")))
    auc = BinaryClassificationEvaluator().evaluate(told)
    sure = vector_to_array("probability")[1] >= 0.6
    precision = F.try_divide(F.count_if(sure & (F.col("label") == 1)).cast("double"), F.count_if(sure))
    return told.agg(F.count("*").alias("n_rows"), F.lit(round(auc, 6)).alias("auc"), F.round(precision, 6).alias("precision"))
