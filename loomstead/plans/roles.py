"""The driver's tables in the roles of a study registry: studies, persons, places, descriptors, facts and events."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The day that stands for today in queries.
AS_OF = "2024-06-01"

#: Status of a study by the code of its order; P tells nothing.
STATUS_SQL = "CASE o_orderstatus WHEN 'F' THEN 'COMPLETED' WHEN 'O' THEN 'RECRUITING' END"

STUDIES_SQL = f"""SELECT o_orderkey AS study_id, o_custkey AS sponsor_id, o_orderpriority || ' study of ' || o_custkey AS title, {STATUS_SQL} AS status,
  CAST(o_orderdate AS DATE) AS start_date, CAST(floor(o_totalprice / 1000) AS INT) AS enrollment, o_orderpriority AS priority FROM orders"""

ROLE_SQL = "CASE l_returnflag WHEN 'R' THEN 'PRINCIPAL_INVESTIGATOR' WHEN 'A' THEN 'SUB_INVESTIGATOR' ELSE 'STUDY_DIRECTOR' END"

INVESTIGATORS_SQL = f"SELECT DISTINCT l_orderkey AS study_id, l_suppkey AS person_id, {ROLE_SQL} AS role FROM lineitem"

PLACES_SQL = """SELECT o_orderkey AS study_id, c_name AS facility, c_mktsegment AS city, n_name AS state, r_name AS country
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey"""

DESCRIPTORS_SQL = """SELECT p_partkey AS descriptor_id, p_name AS name,
  replace(p_brand, 'Brand#', 'B') || '.' || p_type || '.' || CAST(p_size AS VARCHAR(9)) AS tree_number, p_type AS category FROM part"""

#: The common table expressions that queries' SQL begins with.
WITH = f"""WITH studies AS ({STUDIES_SQL}),
investigators AS ({INVESTIGATORS_SQL}),
places AS ({PLACES_SQL}),
descriptors AS ({DESCRIPTORS_SQL}),
conditions AS (SELECT l_orderkey AS study_id, l_partkey AS descriptor_id FROM lineitem)
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder where executors share one. Where the session names none: a temporary one in local mode, an error on a cluster."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loomstead-")
    return f"{folder}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a table in the shared folder, with what made them worked out once."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def studies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("study_id"),
        F.col("o_custkey").alias("sponsor_id"),
        F.concat("o_orderpriority", F.lit(" study of "), F.col("o_custkey").cast("string")).alias("title"),
        F.when(F.col("o_orderstatus") == "F", "COMPLETED").when(F.col("o_orderstatus") == "O", "RECRUITING").alias("status"),
        F.to_date("o_orderdate").alias("start_date"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("enrollment"),
        F.col("o_orderpriority").alias("priority"),
    )


def role(flag: Column | None = None) -> Column:
    flag = F.col("l_returnflag") if flag is None else flag
    return F.when(flag == "R", "PRINCIPAL_INVESTIGATOR").when(flag == "A", "SUB_INVESTIGATOR").otherwise("STUDY_DIRECTOR")


def investigators(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.select(F.col("l_orderkey").alias("study_id"), F.col("l_suppkey").alias("person_id"), role().alias("role")).distinct()


def persons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("person_id"), F.col("s_name").alias("full_name"), "s_nationkey", "s_acctbal")


def places(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("study_id"), "o_custkey")
    customers, nations, regions = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    joined = joined.join(regions, F.col("n_regionkey") == F.col("r_regionkey"))
    return joined.select("study_id", F.col("c_name").alias("facility"), F.col("c_mktsegment").alias("city"), F.col("n_name").alias("state"), F.col("r_name").alias("country"))


def descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    number = F.concat_ws(".", F.replace("p_brand", F.lit("Brand#"), F.lit("B")), "p_type", F.col("p_size").cast("string"))
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("descriptor_id"), F.col("p_name").alias("name"), number.alias("tree_number"), F.col("p_type").alias("category"))


def conditions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("study_id"), F.col("l_partkey").alias("descriptor_id"))
