"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"

#: A side of a join is broadcast up to this many rows of a few dozen bytes; beyond it, the join shuffles.
BROADCAST_ROWS = 200_000

#: Rows in an Arrow batch; at most this many whole texts are in a Python worker at once.
ARROW_ROWS = 500


def words(text: Column) -> Column:
    """The words of a text, in order; null gives none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, spark.checkpoint.dir. Where the session names none: a temporary one in local mode, an error on a cluster."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="loomstead-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder


def materialise(df: DataFrame) -> DataFrame:
    """The same rows with their lineage cut, in the shared folder; for narrow rows."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def written(df: DataFrame, name: str) -> DataFrame:
    """The same rows from a Parquet table in the shared folder, which is smaller than a checkpoint and takes wide rows."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fresh(df: DataFrame, name: str) -> str:
    """name, with underscores after it until no column of df has it in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def small_batches(spark: SparkSession, rows: int = ARROW_ROWS) -> None:
    """Bounds the rows that a Python worker holds at once, as texts can be long."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", rows)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df, with a broadcast hint when it is counted to hold no more than that many rows.

    df should be materialised, as counting runs it. Joins with a larger df shuffle, and AQE splits their hot keys.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df
