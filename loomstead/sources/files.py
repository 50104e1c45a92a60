"""CSV and TSV in and out, Markdown posts, and matrices in binary files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.functions.text import number_text, quoted


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows with a header; quotes are doubled inside quotes, and fields may hold line breaks."""
    return spark.read.schema(schema).options(header=True, quote='"', escape='"', multiLine=True).csv(path)


def csv_lines(df: DataFrame) -> DataFrame:
    """One column "value" of CSV lines: text always quoted, numbers bare and with six decimals at most, booleans as 1 or 0, nulls empty."""
    cells = []
    for name, kind in df.dtypes:
        c = F.col(f"`{name}`")
        if kind == "boolean":
            cell = c.cast("int").cast("string")
        elif kind in ("double", "float") or kind.startswith("decimal"):
            cell = number_text(c)
        elif kind in ("int", "bigint", "smallint", "tinyint"):
            cell = c.cast("string")
        else:
            cell = quoted(c.cast("string"))
        cells.append(F.coalesce(cell, F.lit("")))
    return df.select(F.concat_ws(",", *cells).alias("value"))


def write_csv(df: DataFrame, path: str) -> None:
    """Text quoted always, with a header in each file."""
    df.write.mode("overwrite").options(header=True, quoteAll=True, escape='"').csv(path)


def write_tsv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").options(header=True, sep="\t").csv(path)


def write_report(df: DataFrame, summary: dict[str, object], path: str) -> None:
    """A TSV report that ends with rows of a name and a figure; the rows before keep their order."""
    first, *rest = df.columns
    cells = [F.col(f"`{c}`").cast("string").alias(c) for c in df.columns]
    rows = df.sparkSession.createDataFrame([(name, str(figure)) for name, figure in summary.items()], "name string, figure string")
    width = [F.lit(None).cast("string").alias(c) for c in rest[1:]]
    ends = rows.select(F.col("name").alias(first), *([F.col("figure").alias(rest[0])] if rest else []), *width)
    df.select(*cells).unionByName(ends).write.mode("overwrite").options(header=True, sep="\t").csv(path)


def write_artefacts(frame: DataFrame, schema: dict, path: str) -> None:
    """A training frame as Parquet, and what it holds as JSON beside it."""
    frame.write.mode("overwrite").parquet(f"{path}/frame")
    spark = frame.sparkSession
    spark.createDataFrame([(json.dumps(schema, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/schema")


def read_artefacts(spark: SparkSession, path: str) -> tuple[DataFrame, dict]:
    text = spark.read.text(f"{path}/schema", wholetext=True).first()
    return spark.read.parquet(f"{path}/frame"), json.loads(text.value)


def posts_tagged(posts: DataFrame, tag: str) -> DataFrame:
    """Posts with a tag, in any case."""
    return posts.where(F.exists("tags", lambda t: F.lower(t) == tag.lower()))


def post_tags(posts: DataFrame) -> DataFrame:
    """Distinct tags of posts, in order."""
    return posts.select(F.explode("tags").alias("tag")).distinct().orderBy("tag")


def read_posts(spark: SparkSession, path: str) -> DataFrame:
    """(path, title, date, tags, pinned, body) of Markdown files with a head between lines of three dashes; pinned ones first, then the newest."""
    raw = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    head = F.regexp_extract("value", r"(?s)\A---\r?\n(.*?)\r?\n---", 1)
    field = lambda name: F.nullif(F.trim(F.regexp_extract(head, rf'(?m)^{name}:\s*"?(.*?)"?\s*$', 1)), F.lit(""))
    tags = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(field("tags"), F.lit("")), r"[\[\]\"]", ""), ","), lambda t: F.trim(t)), lambda t: t != "")
    posts = raw.select(
        "path", field("title").alias("title"), field("date").try_cast("date").alias("date"), tags.alias("tags"), F.coalesce(field("pinned") == "true", F.lit(False)).alias("pinned"),
        F.regexp_replace("value", r"(?s)\A---\r?\n.*?\r?\n---\r?\n?", "").alias("body"),
    )
    return posts.orderBy(F.desc("pinned"), F.desc("date"), "path")


def read_matrix(spark: SparkSession, path: str) -> DataFrame:
    """(match_id, vector) from binary files: two little-endian 32-bit counts, then that many rows of 32-bit floats; rows go on from file to file by row."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                n, size = np.frombuffer(content, "<i4", 2)
                values = np.frombuffer(content, "<f4", n * size, offset=8)
                for a in range(0, int(n), 4096):
                    part = values[a * size : (a + 4096) * size]
                    vectors = pa.ListArray.from_arrays(pa.array(np.arange(0, len(part) + 1, size), pa.int32()), pa.array(part))
                    yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, a + len(part) // size)), vectors], ["match_id", "vector"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(rows, "match_id long, vector array<float>")
