"""Trees given by dotted paths: ancestors, roll-ups, branches and search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomstead.functions.text import either


def depth(path: Column) -> Column:
    return F.size(F.split(path, "[.]"))


def ancestors(path: Column) -> Column:
    """A path and all paths above it, the highest first."""
    parts = F.split(path, "[.]")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, F.lit(1), k), "."))


def expanded(prefixes: list[str]) -> list[str]:
    """Prefixes and all above them, once each, in order."""
    found = [".".join(p.split(".")[: k + 1]) for p in prefixes for k in range(p.count(".") + 1)]
    return list(dict.fromkeys(found))


def paths(descriptors: DataFrame, numbers: str = "tree_numbers") -> DataFrame:
    """One row for each path of each descriptor."""
    return descriptors.withColumn("tree_number", F.explode(numbers)).drop(numbers)


def rolled_up(descriptors: DataFrame, uses: DataFrame) -> DataFrame:
    """(node, depth, n, label) for each node of the tree: uses at or below it, and the name of the most used descriptor there.

    descriptors has descriptor_id, name, tree_number (a row for each path); uses has a row for each use of a descriptor_id. A descriptor with several
    paths below a node counts once there. Of equally used ones, the smallest descriptor_id gives its name.
    """
    counts = uses.groupBy("descriptor_id").agg(F.count("*").alias("uses"))
    below = descriptors.select("descriptor_id", "name", F.explode(ancestors(F.col("tree_number"))).alias("node")).distinct()
    known = below.join(counts, "descriptor_id", "left").withColumn("uses", F.coalesce("uses", F.lit(0)))
    label = F.max_by("name", F.struct("uses", -F.col("descriptor_id")))
    return known.groupBy("node").agg(F.sum("uses").alias("n"), label.alias("label")).withColumn("depth", depth(F.col("node")))


def children(rollup: DataFrame, branch: str | None, least: int = 0) -> DataFrame:
    """(node, label, n, has_children) for the nodes next below a branch, or the roots, that have enough uses; children are looked for in the same way."""
    level = 1 if branch is None else branch.count(".") + 2
    enough = rollup.where(F.col("n") >= least)
    inside = enough if branch is None else enough.where(F.startswith("node", F.lit(branch + ".")))
    here = inside.where(F.col("depth") == level)
    parents = inside.where(F.col("depth") == level + 1).select(F.expr("substring(node, 1, length(node) - instr(reverse(node), '.'))").alias("node")).distinct()
    return here.join(parents.withColumn("has_children", F.lit(True)), "node", "left").select("node", "label", "n", F.coalesce("has_children", F.lit(False)).alias("has_children"))


def names_under(descriptors: DataFrame, prefixes: list[str]) -> DataFrame:
    """Distinct names of descriptors under any prefix or what is above it. Prefixes need no dot after them."""
    wanted = either([F.startswith("tree_number", F.lit(p)) for p in expanded(prefixes)])
    return descriptors.where(wanted).select("name").distinct()


def _any_starts_with(words: Column, stem: str) -> Column:
    return F.exists(words, lambda word: word.startswith(stem))


def _fits(text: Column, query: str) -> Column:
    """Whether a text holds the query, or each word of the query begins one of its words; a plural s of a word of four letters or more may be missing."""
    lower = F.lower(text)
    words, fits = F.split(lower, " +"), F.lit(True)
    for word in query.split():
        stem = (word[:-1] if len(word) > 3 and word.endswith("s") else word).lower()
        fits &= _any_starts_with(words, stem)
    return F.contains(lower, F.lit(query.lower())) | fits


def search(descriptors: DataFrame, counts: DataFrame, query: str, most: int = 20, branch: str | None = None, synonyms: DataFrame | None = None) -> DataFrame:
    """Descriptors whose name, or one of whose synonyms (descriptor_id, synonym), fits the query, within a branch if one is given: the most used first,
    then by name."""
    inside = descriptors if branch is None else descriptors.where(F.startswith("tree_number", F.lit(branch)))
    found = inside.where(_fits(F.col("name"), query)).select("descriptor_id", "name")
    if synonyms is not None:
        known = synonyms.where(_fits(F.col("synonym"), query)).select("descriptor_id")
        found = found.unionByName(inside.join(known, "descriptor_id", "left_semi").select("descriptor_id", "name"))
    used = counts.groupBy("descriptor_id").agg(F.count("*").alias("n"))
    ranked = found.distinct().join(used, "descriptor_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return ranked.orderBy(F.desc("n"), "name", "descriptor_id").limit(most)


def synonym_index(entries: DataFrame, descriptors: DataFrame) -> DataFrame:
    """(descriptor_id, synonym) from entries (ordinal, name, cui): names in capitals, of descriptors and of all entries whose cui's first name is one.

    Entries without a cui tell nothing. A name of several descriptors gives its synonyms to the one with the smallest id.
    """
    key = F.upper(F.trim("name"))
    own = descriptors.select("descriptor_id", key.alias("synonym")).distinct()
    named = entries.where(F.coalesce(F.col("cui") != "", F.lit(False))).select(F.upper("cui").alias("cui"), "ordinal", key.alias("synonym"))
    first = named.groupBy("cui").agg(F.min_by("synonym", "ordinal").alias("synonym"))
    owners = first.join(own.groupBy("synonym").agg(F.min("descriptor_id").alias("descriptor_id")), "synonym").select("cui", "descriptor_id")
    return own.unionByName(named.join(owners, "cui").select("descriptor_id", "synonym")).distinct()


# The roots of the tree, and the category that a path's first letter tells.
ROOTS = {
    "A": "Anatomy", "B": "Organisms", "C": "Diseases", "D": "Chemicals and Drugs", "E": "Analytical, Diagnostic and Therapeutic Techniques and Equipment",
    "F": "Psychiatry and Psychology", "G": "Phenomena and Processes", "H": "Disciplines and Occupations", "I": "Anthropology, Education, Sociology and Social Phenomena",
    "J": "Technology, Industry, Agriculture", "K": "Humanities", "L": "Information Science", "M": "Named Groups", "N": "Health Care", "V": "Publication Characteristics",
    "Z": "Geographicals",
}
CATEGORIES = {
    "A": "anatomy", "B": "organism", "C": "disease", "D": "chemical", "E": "procedure", "F": "disorder", "G": "procedure", "H": "procedure", "I": "anthropology",
    "J": "technology", "K": "humanities", "L": "information", "M": "named_group", "N": "healthcare",
}


def category(tree_numbers: Column) -> Column:
    """The category of a term's first path that tells one: mental disorders are diseases, others go by their letter; "other" if none does."""
    letters = F.create_map(*(F.lit(x) for pair in CATEGORIES.items() for x in pair))
    told = F.transform(tree_numbers, lambda t: F.when(t.startswith("F03"), "disease").otherwise(F.try_element_at(letters, F.substring(t, 1, 1))))
    return F.coalesce(F.get(F.array_compact(told), F.lit(0)), F.lit("other"))


def browse(descriptors: DataFrame, uses: DataFrame, least: int = 0, levels: int = 1) -> DataFrame:
    """(level, node, name, n, has_children) of the roots and the levels below them, as far as asked; nodes with fewer uses than least are left out.

    A descriptor counts once at a node however many of its paths lie there. A root always has its own name; other nodes have that of the most used
    descriptor at or below them, of equal ones the one with the smallest id. Below the roots, only nodes with used descriptors beneath have children.
    """
    letter, parts = F.substring("tree_number", 1, 1), ancestors(F.col("tree_number"))
    nodes = F.slice(F.when(F.length(F.get(parts, F.lit(0))) == 1, parts).otherwise(F.concat(F.array(letter), parts)), 1, levels)
    counts = uses.groupBy("descriptor_id").agg(F.count("*").alias("u"))
    placed = descriptors.select("descriptor_id", "name", "tree_number", F.posexplode(nodes).alias("level", "node"))
    once = placed.groupBy("descriptor_id", "name", "level", "node").agg(F.bool_or(F.col("tree_number") != F.col("node")).alias("below"))
    known = once.join(counts, "descriptor_id", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    name, beneath = F.max_by("name", F.struct("u", -F.col("descriptor_id"))), F.col("below") & ((F.col("u") > 0) | (F.col("level") == 0))
    summed = known.groupBy("level", "node").agg(F.sum("u").alias("n"), name.alias("name"), F.bool_or(beneath).alias("has_children"))
    spark = descriptors.sparkSession
    roots = spark.createDataFrame(list(ROOTS.items()), "node string, root string")
    top = roots.join(summed.where("level = 0"), "node", "left").select(F.lit(1).alias("level"), "node", F.col("root").alias("name"), F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("has_children", F.lit(False)).alias("has_children"))
    lower = summed.where(F.col("level") > 0).where(F.substring("node", 1, 1).isin(list(ROOTS)))
    if levels > 2 and least < 1:  # nodes are not opened where nothing beneath is used
        opened = summed.where("level = 0 or has_children").select(F.col("node").alias("parent"))
        above = F.when(F.col("level") > 1, F.expr("substring(node, 1, length(node) - instr(reverse(node), '.'))")).otherwise(F.substring("node", 1, 1))
        lower = lower.withColumn("above", above).join(opened, F.col("above") == F.col("parent"), "left_semi")
    return top.unionByName(lower.select((F.col("level") + 1).alias("level"), "node", "name", "n", "has_children")).where(F.col("n") >= least)
