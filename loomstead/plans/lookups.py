"""What other registries answer: providers, organisations, use, services, payments, authors and researchers, as nested pages written and read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead import schemas
from loomstead.plans import roles as R
from loomstead.plans.registry import query
from loomstead.sources import registry as S


#: Pages of a file.
PAGES_A_FILE = 500_000


def reread(rows: DataFrame, schema: str, name: str) -> DataFrame:
    """Rows as JSON, a page a line, in compressed files of bounded size (a reader can't split them), read with a declared schema."""
    path = R.scratch(rows.sparkSession, name)
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.options(compression="gzip", maxRecordsPerFile=PAGES_A_FILE).text(path)
    return rows.sparkSession.read.schema(schema).json(path)


def text(name: str):
    return F.col(name).cast("string")


FOUND_SQL = """s AS (SELECT s_suppkey, s_name, n_name, r_name, s_acctbal, s_suppkey % 5 AS q FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
  k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s_suppkey) AS i FROM s)"""


def found_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Searches whose results are suppliers, in the order of their numbers; one in three has its practice address last, one in four its main specialty."""
    t = lambda name: R.table(spark, sf_dir, name)
    joined = t("supplier").join(F.broadcast(t("nation")), F.col("s_nationkey") == F.col("n_nationkey")).join(F.broadcast(t("region")), F.col("n_regionkey") == F.col("r_regionkey"))
    key = F.col("s_suppkey")
    place = lambda purpose, city, state: F.struct(F.lit(purpose).alias("address_purpose"), city.alias("city"), state.alias("state"))
    mail, site = place("MAILING", F.col("r_name"), F.lit("XX")), place("LOCATION", F.col("n_name"), F.substring("r_name", 1, 2))
    field = lambda name, main: F.struct(name.alias("desc"), F.lit(main).alias("primary"), F.substring("r_name", 1, 2).alias("state"), F.lit(None).cast("string").alias("license"))
    basic = F.struct(F.col("s_name").alias("last_name"), F.col("r_name").alias("first_name"), F.concat(F.lit("Org "), "s_name").alias("organization_name"), F.when(F.col("s_acctbal") < 0, "D").otherwise("A").alias("status"))
    result = F.struct(
        key.cast("string").alias("number"), basic.alias("basic"), F.when(key % 3 == 0, F.array(mail, site)).otherwise(F.array(site, mail)).alias("addresses"),
        F.when(key % 4 == 0, F.array(field(F.lit("Other"), False), field(F.col("r_name"), True))).otherwise(F.array(field(F.col("r_name"), True))).alias("taxonomies"),
    )
    found = joined.groupBy((key % 5).cast("string").alias("query")).agg(F.sort_array(F.collect_list(F.struct(key.alias("k"), result.alias("r")))).alias("all"))
    return reread(found.select("query", F.transform("all", lambda x: x["r"]).alias("results")), f"query string, {schemas.PROVIDERS}", "providers")


@query(f"WITH {FOUND_SQL} SELECT CAST(s_suppkey AS VARCHAR) AS number, s_acctbal < 0 AS deactivated, s_name AS last_name, n_name AS city, r_name[:2] AS state, r_name AS specialty FROM k WHERE i <= {S.MOST_BY_NAME}")
def provider_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Providers by name, the first twenty of each search."""
    return S.providers(S.searched(found_pages(spark, sf_dir), S.MOST_BY_NAME)).select("number", "deactivated", "last_name", "city", "state", "specialty")


@query(f"WITH {FOUND_SQL}, u AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY s_suppkey) AS j FROM s WHERE r_name[:2] = 'AS') SELECT CAST(q AS VARCHAR) AS query, CAST(s_suppkey AS VARCHAR) AS number, 'Org ' || s_name AS organisation, n_name AS city, 'AS' AS state FROM u WHERE j <= {S.MOST_BY_ORGANISATION}")
def organisation_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Organisations in a state, the first five of each search."""
    return S.organisations(found_pages(spark, sf_dir), " as ")


USE_SQL = """u AS (SELECT CAST(l_suppkey AS VARCHAR) AS npi, CAST(year(l_shipdate) AS INT) AS y, CAST(count(*) AS INT) AS n, CAST(sum(l_quantity) AS BIGINT) AS q, CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DECIMAL(18,2)) AS pay FROM lineitem GROUP BY 1, 2)"""


def use_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yearly use in texts, as it is published: some of one year, all with numbers as texts, and one provider with a blank number."""
    lines = R.table(spark, sf_dir, "lineitem").groupBy("l_suppkey", F.year("l_shipdate").alias("y"))
    sums = lines.agg(F.count("*").alias("n"), F.sum("l_quantity").cast("long").alias("q"), F.sum(F.col("l_extendedprice").cast("decimal(18,2)")).cast("decimal(18,2)").alias("pay"))
    rows = sums.select(
        F.when(F.col("l_suppkey") == 1, " ").otherwise(text("l_suppkey")).alias("Rndrng_NPI"), F.lit("Type").alias("Rndrng_Prvdr_Type"), text("n").alias("Tot_Benes"), text("q").alias("Tot_Srvcs"),
        text("pay").alias("Tot_Mdcr_Pymt_Amt"), F.lit("*").alias("Bene_Avg_Risk_Scre"), "y",
    )
    return reread(rows, f"{schemas.UTILISATION}, y int", "use")


@query(f"WITH {USE_SQL} SELECT npi, y AS data_year, n AS beneficiaries, q AS services, CAST(pay AS DOUBLE) AS payments, NULL::DOUBLE AS risk_score FROM u WHERE npi <> '1' QUALIFY row_number() OVER (PARTITION BY npi ORDER BY y) = 1")
def first_use(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first record of each provider's use; a risk that is suppressed is null, and a blank number is not looked up."""
    raw = use_rows(spark, sf_dir)
    told = S.utilisation(S.first_rows(raw, "Rndrng_NPI", 1, "y"), 0)
    years = raw.groupBy(F.col("Rndrng_NPI").alias("npi")).agg(F.min("y").alias("y"))
    return told.join(years, "npi").select("npi", F.col("y").alias("data_year"), "beneficiaries", "services", F.col("payments").cast("double").alias("payments"), F.col("risk_score").cast("double").alias("risk_score"))


@query(f"WITH l AS (SELECT *, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_partkey) AS i FROM lineitem) SELECT CAST(l_suppkey AS VARCHAR) AS npi, count(*) AS n, max(l_orderkey) AS last FROM l WHERE i <= {S.MOST_SERVICES} GROUP BY 1")
def first_services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many services a look-up gives of each provider, two hundred at most, and the last of them."""
    lines = R.table(spark, sf_dir, "lineitem").select(text("l_suppkey").alias("npi"), "l_orderkey", "l_linenumber", "l_partkey")
    return S.first_rows(lines, "npi", S.MOST_SERVICES, "l_orderkey", "l_linenumber", "l_partkey").groupBy("npi").agg(F.count("*").alias("n"), F.max("l_orderkey").alias("last"))


@query("""SELECT CAST(l_suppkey AS VARCHAR) AS npi, CASE WHEN l_returnflag = 'R' THEN 'research' ELSE 'general' END AS payment_type, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS DOUBLE) AS amount, CAST(l_shipdate AS DATE) AS paid_on,
  'payor ' || l_partkey AS payor, CAST(year(l_shipdate) AS INT) AS data_year, l_orderkey || '-' || l_linenumber AS record_id FROM lineitem""")
def payment_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments of two families from nested pages, whose dates are written in two ways."""
    lines = R.table(spark, sf_dir, "lineitem")

    def pages(kind: str, which: str, day: str) -> DataFrame:
        row = lambda x: F.struct(
            x["l_suppkey"].cast("string").alias("covered_recipient_npi"), x["l_extendedprice"].cast("decimal(18,2)").cast("string").alias("total_amount_of_payment_usdollars"), F.date_format(x["l_shipdate"], day).alias("date_of_payment"),
            F.concat(F.lit("payor "), x["l_partkey"].cast("string")).alias("applicable_manufacturer_or_applicable_gpo_making_payment_name"), F.year(x["l_shipdate"]).cast("string").alias("program_year"),
            F.concat_ws("-", text("l_orderkey"), x["l_linenumber"].cast("string")).alias("record_id"),
        )
        line = F.struct("l_suppkey", "l_partkey", "l_linenumber", "l_extendedprice", "l_shipdate")
        grouped = lines.where(which).repartition("l_orderkey").groupBy("l_orderkey").agg(F.collect_list(line).alias("lines"))  # an order's payments are a page; bare lines are shuffled, not texts
        return reread(grouped.select(F.transform("lines", row).alias("results")), schemas.PAYMENTS, kind)

    found = S.payments({"research": pages("research", "l_returnflag = 'R'", "MM/dd/yyyy"), "general": pages("general", "l_returnflag <> 'R'", "yyyy-MM-dd'T'HH:mm:ss.SSS")})
    return found.select("npi", "payment_type", F.col("amount").cast("double").alias("amount"), F.to_date("paid_at").alias("paid_on"), "payor", "data_year", "record_id")


@query("""SELECT l_orderkey AS query, l_suppkey AS author, CAST(l_linenumber AS INT) AS h_index FROM (SELECT *, CASE WHEN l_linenumber % 3 = 0 THEN 0 ELSE CAST(l_quantity AS INT) END AS c FROM lineitem)
  QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY c DESC, l_linenumber DESC, CAST(l_suppkey AS VARCHAR)) = 1""")
def author_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The most cited author that each search found; some have no citations told."""
    cited = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_quantity").cast("int"))
    author = F.struct(text("l_suppkey").alias("authorId"), F.col("l_quantity").cast("int").alias("paperCount"), cited.alias("citationCount"), F.col("l_linenumber").cast("int").alias("hIndex"))
    pages = R.table(spark, sf_dir, "lineitem").groupBy(text("l_orderkey").alias("query")).agg(F.collect_list(author).alias("data"))
    found = S.best_authors(reread(pages, schemas.AUTHORS, "authors"))
    return found.select(F.col("query").cast("long").alias("query"), F.col("authorId").cast("long").alias("author"), F.col("hIndex").alias("h_index"))


@query("""WITH l AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_returnflag = 'N' THEN '  ' ELSE 'id-' || l_suppkey END AS orcid FROM lineitem)
  SELECT CAST(l_orderkey AS VARCHAR) AS query, orcid FROM l WHERE trim(orcid) <> '' QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, orcid) <= 2""")
def researcher_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first two identifiers that each search found and that aren't blank."""
    path = F.when(F.col("l_returnflag") == "N", "  ").otherwise(F.concat(F.lit("id-"), text("l_suppkey")))
    one = F.struct("l_linenumber", F.struct(F.struct(path.alias("path")).alias("orcid-identifier")).alias("r"))
    pages = R.table(spark, sf_dir, "lineitem").groupBy(text("l_orderkey").alias("query")).agg(F.transform(F.sort_array(F.collect_list(one)), lambda x: x["r"]).alias("result"))
    return S.researcher_ids(reread(pages, schemas.RESEARCHERS, "researchers"), 2)
