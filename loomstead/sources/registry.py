"""Registry records from landing files: nested JSON and XML pages flattened into typed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomstead import schemas
from loomstead.functions.dates import partial_date, publication_date
from loomstead.functions.payloads import number
from loomstead.functions.text import blank


def read_pages(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """Pages of studies in JSON, one document for each file, or for each line."""
    return spark.read.schema(schemas.REGISTRY_PAGE).json(path, multiLine=not lines)


def stream_pages(spark: SparkSession, path: str) -> DataFrame:
    """The same as a stream: each new file is read once."""
    return spark.readStream.schema(schemas.REGISTRY_PAGE).option("multiLine", True).json(path)


def updated_between(pages: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """Studies (column p) last updated in a window of days, the earliest first; an open end is no bound."""
    studies = pages.select(F.explode("studies.protocolSection").alias("p")).withColumn("updated", partial_date(F.col("p.statusModule.lastUpdatePostDateStruct.date")))
    if start:
        studies = studies.where(F.col("updated") >= F.lit(start).cast("date"))
    if end:
        studies = studies.where(F.col("updated") <= F.lit(end).cast("date"))
    return studies.orderBy("updated", "p.identificationModule.nctId").select("p")


def flatten_studies(pages: DataFrame) -> DataFrame:
    """A row for each study of the pages, children as arrays."""
    p = F.explode("studies.protocolSection").alias("p")
    date = lambda name: partial_date(F.col(f"p.statusModule.{name}.date"))
    healthy = F.col("p.eligibilityModule.healthyVolunteers")
    return pages.select(p).select(
        F.col("p.identificationModule.nctId").alias("nct_id"), F.col("p.identificationModule.briefTitle").alias("title"), F.col("p.identificationModule.officialTitle").alias("official_title"),
        F.col("p.identificationModule.orgStudyIdInfo.id").alias("org_id"), F.col("p.statusModule.overallStatus").alias("status"), date("startDateStruct").alias("start_date"),
        date("completionDateStruct").alias("completion_date"), date("studyFirstPostDateStruct").alias("posted_date"), F.col("p.sponsorCollaboratorsModule.leadSponsor.name").alias("sponsor"),
        F.array_join(F.col("p.sponsorCollaboratorsModule.collaborators.name"), "; ").alias("collaborators"), F.col("p.descriptionModule.briefSummary").alias("summary"),
        F.col("p.conditionsModule.conditions").alias("conditions"), F.col("p.conditionsModule.keywords").alias("keywords"), F.col("p.designModule.studyType").alias("study_type"),
        F.col("p.designModule.phases").alias("phases"), F.coalesce("p.designModule.designInfo.maskingInfo.masking", "p.designModule.designInfo.masking").alias("masking"),
        F.col("p.designModule.enrollmentInfo.count").alias("enrollment"), F.col("p.armsInterventionsModule.armGroups").alias("arms"), F.col("p.armsInterventionsModule.interventions").alias("interventions"),
        F.col("p.outcomesModule.primaryOutcomes").alias("primary_outcomes"), F.col("p.outcomesModule.secondaryOutcomes").alias("secondary_outcomes"),
        F.col("p.eligibilityModule.sex").alias("sex"), F.coalesce(healthy.try_cast("boolean"), F.lower(healthy).startswith("accepts")).alias("healthy_volunteers"),
        F.col("p.contactsLocationsModule.overallOfficials").alias("officials"), F.col("p.contactsLocationsModule.locations").alias("locations"), F.col("p.referencesModule.references").alias("references"),
    )


def children(studies: DataFrame, column: str, **extra: Column) -> DataFrame:
    """A row for each element of an array of studies; structs become columns."""
    rows = studies.select("nct_id", F.explode(column).alias("c"), *(c.alias(n) for n, c in extra.items()))
    is_struct = studies.schema[column].dataType.elementType.typeName() == "struct"
    return rows.select("nct_id", *(["c.*"] if is_struct else [F.col("c").alias(column.rstrip("s"))]), *extra)


def outcomes(studies: DataFrame) -> DataFrame:
    """Primary and secondary outcomes with their type; a type whose list is missing has none and replaces none."""
    return children(studies, "primary_outcomes", outcome_type=F.lit("primary")).unionByName(children(studies, "secondary_outcomes", outcome_type=F.lit("secondary")))


def utilisation(raw: DataFrame, year: int) -> DataFrame:
    """Yearly use with numbers as numbers, whether they came so or as text."""
    return raw.select(
        F.col("Rndrng_NPI").alias("npi"), F.lit(year).alias("data_year"), F.col("Rndrng_Prvdr_Type").alias("provider_type"), number(F.col("Tot_Benes")).cast("int").alias("beneficiaries"),
        number(F.col("Tot_Srvcs")).cast("long").alias("services"), F.col("Tot_Mdcr_Pymt_Amt").try_cast("decimal(18,2)").alias("payments"), F.col("Bene_Avg_Risk_Scre").try_cast("decimal(10,4)").alias("risk_score"),
    )


#: Rows that a look-up of a provider's use gives at most, and those that its first record is taken of; of services; of providers by name and by organisation.
# Fixed values.
MOST_YEARS, FIRST_OF, MOST_SERVICES, MOST_BY_NAME, MOST_BY_ORGANISATION = 20, 5, 200, 20, 5


def first_rows(found: DataFrame, key: str, most: int, *order: str) -> DataFrame:
    """The first rows of each key by an order; those without a key, or with a blank one, were not looked up. Spark cuts groups before the shuffle."""
    rank = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return found.where(~blank(F.col(key))).withColumn("_rank", rank).where(F.col("_rank") <= most).drop("_rank")


def searched(pages: DataFrame, most: int, state: str | None = None) -> DataFrame:
    """Pages with the results that a search gives: the first so many, of those with an address in a state if one is asked for."""
    results = F.coalesce("results", F.array().cast(pages.schema["results"].dataType))
    if state and state.strip():
        results = F.filter(results, lambda r: F.exists(r["addresses"], lambda a: F.upper(a["state"]) == state.strip().upper()))
    return pages.withColumn("results", F.slice(results, 1, most))


def organisations(pages: DataFrame, state: str | None = None) -> DataFrame:
    """(query, number, organisation, city, state) of searches by an organisation's name, in a state or anywhere; its practice address before others."""
    cut = searched(pages, MOST_BY_ORGANISATION, state).select("query", F.explode("results").alias("r"))
    address = F.coalesce(F.get(F.filter("r.addresses", lambda a: a["address_purpose"] == "LOCATION"), F.lit(0)), F.get("r.addresses", F.lit(0)))
    return cut.select("query", F.col("r.number").alias("number"), F.col("r.basic.organization_name").alias("organisation"), address["city"].alias("city"), address["state"].alias("state"))


def payments(pages: dict[str, DataFrame]) -> DataFrame:
    """Payments of several families, each with its type."""
    parts = [
        df.select(F.explode("results").alias("r")).select(
            F.col("r.covered_recipient_npi").alias("npi"), F.lit(kind).alias("payment_type"), F.col("r.total_amount_of_payment_usdollars").try_cast("decimal(18,2)").alias("amount"),
            F.coalesce(F.try_to_timestamp("r.date_of_payment"), F.try_to_timestamp("r.date_of_payment", F.lit("MM/dd/yyyy"))).alias("paid_at"),
            F.col("r.applicable_manufacturer_or_applicable_gpo_making_payment_name").alias("payor"), F.col("r.program_year").try_cast("int").alias("data_year"), F.col("r.record_id").alias("record_id"),
        )
        for kind, df in pages.items()
    ]
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part)
    return whole


def providers(pages: DataFrame) -> DataFrame:
    """A row for each provider: its practice address before others, its primary specialty before others."""
    r = pages.select(F.explode("results").alias("r"))
    first = lambda array, test: F.coalesce(F.get(F.filter(array, test), F.lit(0)), F.get(array, F.lit(0)))
    address = first(F.col("r.addresses"), lambda a: a["address_purpose"] == "LOCATION")
    specialty = first(F.col("r.taxonomies"), lambda t: t["primary"])
    return r.select(
        F.col("r.number").alias("number"), (F.col("r.basic.status") == "D").alias("deactivated"), F.col("r.basic.first_name").alias("first_name"), F.col("r.basic.last_name").alias("last_name"),
        F.col("r.basic.middle_name").alias("middle_name"), F.col("r.basic.credential").alias("credential"), address["city"].alias("city"), address["state"].alias("state"),
        specialty["desc"].alias("specialty"), F.array_distinct("r.taxonomies.state").alias("license_states"), F.col("r.identifiers").alias("identifiers"),
    )


def best_authors(searches: DataFrame) -> DataFrame:
    """For each search, its author with the most citations, of those the highest h-index, then the smallest id."""
    rows = searches.select("query", F.explode("data").alias("a")).select("query", "a.*")
    order = (F.desc(F.coalesce("citationCount", F.lit(0))), F.desc(F.coalesce("hIndex", F.lit(0))), F.asc("authorId"))
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where("_rank = 1").drop("_rank")


def researcher_ids(searches: DataFrame, most: int) -> DataFrame:
    """The first identifiers of each search that are not blank."""
    ids = F.slice(F.filter(F.transform("result", lambda r: r["orcid-identifier"]["path"]), lambda i: ~blank(i)), 1, most)
    return searches.select("query", F.explode(ids).alias("orcid"))


def vocabulary(pages: DataFrame) -> DataFrame:
    """(ordinal, name, cui, tree_numbers, category) from parallel arrays."""
    zipped = F.arrays_zip("names", "cuis", "tree_numbers", "categories")
    rows = pages.select(F.posexplode(zipped).alias("ordinal", "v"))
    return rows.select("ordinal", F.col("v.names").alias("name"), F.col("v.cuis").alias("cui"), F.col("v.tree_numbers").alias("tree_numbers"), F.col("v.categories").alias("category"))


def descriptors(entries: DataFrame) -> DataFrame:
    """One row for each cui, that of its first entry, with its other names as synonyms."""
    first = entries.groupBy("cui").agg(F.min_by(F.struct("name", "tree_numbers", "category"), "ordinal").alias("f"), F.array_sort(F.collect_set(F.struct("ordinal", "name"))).alias("all"))
    others = F.array_distinct(F.filter(F.transform("all", lambda e: e["name"]), lambda n: n != F.col("f.name")))
    return first.select("cui", "f.*", others.alias("synonyms"))


def articles(spark: SparkSession, path: str) -> DataFrame:
    """Publications from XML files."""
    raw = spark.read.schema(schemas.ARTICLE).option("rowTag", "PubmedArticle").format("xml").load(path)
    return article_rows(raw)


def article_rows(raw: DataFrame) -> DataFrame:
    a, day = "MedlineCitation.Article", "MedlineCitation.Article.Journal.JournalIssue.PubDate"
    return raw.select(
        F.col("MedlineCitation.PMID").alias("pmid"), F.col(f"{a}.ArticleTitle").alias("title"), F.col(f"{a}.Journal.Title").alias("journal"),
        publication_date(F.col(f"{day}.Year"), F.col(f"{day}.Month"), F.col(f"{day}.Day")).alias("published"), F.array_join(F.col(f"{a}.Abstract.AbstractText"), "\n").alias("abstract"),
        F.col(f"{a}.AuthorList.Author").alias("authors"), F.col(f"{a}.PublicationTypeList.PublicationType").alias("types"),
        F.transform(F.col("MedlineCitation.MeshHeadingList.MeshHeading"), lambda h: h["DescriptorName"]["_UI"]).alias("descriptor_ids"),
    )


def author_orcid(authors: Column, first: Column, last: Column) -> Column:
    """The first ORCID of an author with that last name and the first letter of that first name."""
    fits = lambda a: (F.lower(a["LastName"]) == F.lower(last)) & F.lower(a["ForeName"]).startswith(F.lower(F.substring(first, 1, 1))) & a["Identifier"].isNotNull()
    return F.get(F.filter(authors, fits), F.lit(0))["Identifier"]


def first_studies(pages: DataFrame, n: int) -> DataFrame:
    """The first n studies of pages, flattened; fewer if there are no more."""
    return flatten_studies(pages).orderBy("nct_id").limit(n)


def count_updated(pages: DataFrame, start: str | None, end: str | None) -> DataFrame:
    """One row: how many studies were updated in a window of days."""
    return updated_between(pages, start, end).agg(F.count("*").alias("n"))


def page_terms(studies: DataFrame) -> DataFrame:
    """Distinct trimmed terms of flattened studies: conditions, keywords and names of interventions; blank ones do not count."""
    names = F.transform("interventions", lambda i: i["name"])
    none = F.array().cast("array<string>")
    every = F.concat(F.coalesce("conditions", none), F.coalesce("keywords", none), F.coalesce(names, none))
    return studies.select(F.explode(every).alias("term")).where(~blank(F.col("term"))).select(F.regexp_replace("term", r"^\s+|\s+$", "").alias("term")).distinct()


#: Descriptors of a file of the vocabulary: a reader can't split a file in XML, so this bounds what one task reads.
RECORDS_A_FILE = 20_000


def write_vocabulary(records: DataFrame, path: str, most: int = RECORDS_A_FILE) -> None:
    """Descriptors (DescriptorUI and the other fields of a record) as files of XML, each with so many at most, by tasks that share them evenly."""
    records.repartition("DescriptorUI").write.format("xml").options(rowTag="DescriptorRecord", rootTag="DescriptorRecordSet", maxRecordsPerFile=most).save(path)


def vocabulary_records(spark: SparkSession, path: str) -> DataFrame:
    """(cui, name, tree_numbers, synonyms) from a vocabulary in XML, one element DescriptorRecord a descriptor."""
    return record_rows(spark.read.schema(schemas.DESCRIPTOR_RECORD).option("rowTag", "DescriptorRecord").format("xml").load(path))


def record_rows(raw: DataFrame) -> DataFrame:
    """The same from records that are read already: records without an id or a name are left out; synonyms begin with the preferred concept, once each."""
    concepts = F.coalesce(F.col("ConceptList.Concept"), F.array().cast("array<struct<ConceptName: struct<String: string>, ConceptPreferredNameYN: string, TermList: struct<Term: array<struct<String: string>>>>>"))
    preferred = lambda c: F.coalesce(c["ConceptPreferredNameYN"] == "Y", F.lit(False))
    names = F.concat(
        F.transform(F.filter(concepts, preferred), lambda c: c["ConceptName"]["String"]),
        F.flatten(F.transform(concepts, lambda c: F.concat(F.array(c["ConceptName"]["String"]), F.coalesce(F.transform(c["TermList"]["Term"], lambda t: t["String"]), F.array().cast("array<string>"))))),
    )
    numbers = F.transform(F.filter(F.coalesce("TreeNumberList.TreeNumber", F.array().cast("array<string>")), lambda t: ~blank(t)), lambda t: F.trim(t))
    found = raw.select(F.col("DescriptorUI").alias("cui"), F.col("DescriptorName.String").alias("name"), numbers.alias("tree_numbers"), F.array_distinct(F.filter(names, lambda n: ~blank(n))).alias("synonyms"))
    return found.where("cui is not null and name is not null")
