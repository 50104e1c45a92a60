"""The paged scan: windows open only the pages that they meet, limits hold, and streams restart without loss."""

from __future__ import annotations

import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual

from loomstead.sources import paged


def studies(spark, rows):
    day = F.struct(F.col("updated").cast("string").alias("date"))
    study = F.to_json(F.struct(F.struct(F.struct(day.alias("lastUpdatePostDateStruct")).alias("statusModule"), F.struct(F.col("id").alias("nctId")).alias("identificationModule")).alias("protocolSection")))
    return spark.createDataFrame(rows, "id long, updated date").select("id", "updated", study.alias("study"))


def some(n, seed=1):
    pick = random.Random(seed)
    return [(i, dt.date(2024, 1, 1) + dt.timedelta(days=pick.randrange(100)) if i % 17 else None) for i in range(n)] + [(n + i, dt.date(2024, 2, 2)) for i in range(n // 3)]


@pytest.fixture
def folder(spark, tmp_path):
    rows, path = some(400), str(tmp_path / "pages")
    paged.write_pages(studies(spark, rows[::2]), path, 10)
    paged.write_pages(studies(spark, rows[1::2]), path, 10)
    return rows, path


def ids(df):
    return sorted(r[0] for r in df.select(F.get_json_object("study", "$.protocolSection.identificationModule.nctId").cast("long")).collect())


def test_windows(spark, folder):
    rows, path = folder
    assert ids(paged.read_window(spark, path)) == sorted(i for i, _ in rows)
    for start, end in (("2024-02-01", "2024-02-10"), ("2024-03", None), (None, "2024-01-15"), ("2025", None), ("2024-02-02", "2024-02-02"), ("2024-05-01", "2024-01-01")):
        a, b = paged.day_of(start) or dt.date(1900, 1, 1), paged.day_of(end) or dt.date(2100, 1, 1)
        expected = sorted(i for i, d in rows if d and a <= d <= b)
        assert ids(paged.read_window(spark, path, start, end)) == expected
        assert ids(paged.read_window(spark, path).where(F.col("updated").between(F.lit(a), F.lit(b)))) == expected


def test_a_pushed_window_opens_only_its_pages(spark, folder):
    rows, path = folder
    reader = paged.PushedReader({"path": path})
    every = len(reader.chosen())
    a, b = dt.date(2024, 3, 1), dt.date(2024, 3, 5)
    column = ("updated",)
    filters = [GreaterThan(column, a - paged.DAY), LessThan(column, b + paged.DAY), GreaterThanOrEqual(("page",), 3), EqualTo(("study",), "x")]
    assert list(reader.pushFilters(filters)) == filters and reader.pushed == (a, b)  # Spark applies them all to the rows again
    few = reader.chosen()
    assert every > 50 and len(few) < every / 5 and all(p.last >= a and p.first <= b for p in few)
    assert sum(len(p.pages) for p in reader.partitions()) == len(few)
    list(reader.pushFilters([LessThanOrEqual(column, a)]))
    assert reader.pushed == (a, a)
    # pages outside are never opened: they may even be gone
    for p in paged.listed(path):
        if p not in few:
            os.remove(f"{path}/{p.file}")
    spark.conf.set(paged.PUSHDOWN, True)
    try:
        assert ids(paged.read_window(spark, path).where((F.col("updated") >= F.lit(a)) & (F.col("updated") <= F.lit(b)))) == sorted(i for i, d in rows if d and a <= d <= b)
    finally:
        spark.conf.unset(paged.PUSHDOWN)
    assert ids(paged.read_window(spark, path, "2024-03-01", "2024-03-05")) == sorted(i for i, d in rows if d and a <= d <= b)


def test_the_first_of_a_window(spark, folder):
    rows, path = folder
    for n, start, end in ((1, None, None), (25, None, None), (30, "2024-02-02", None), (10_000, None, None), (7, "2024-02-20", "2024-03-01"), (0, None, None)):
        a, b = paged.day_of(start) or dt.date(1900, 1, 1), paged.day_of(end) or dt.date(2100, 1, 1)
        expected = sorted((d or dt.date.max) for _, d in rows if (start is None and end is None) or (d and a <= d <= b))[:n]
        got = [r.updated or dt.date.max for r in paged.first_updated(spark, path, n, start, end).collect()]
        assert sorted(got) == expected
    assert len(paged.PagedReader({"path": path, "limit": "5"}).chosen()) < 10 < len(paged.listed(path))


def test_a_stream_restarts_without_loss(spark, tmp_path):
    rows, path, out = some(90, 2), str(tmp_path / "pages"), str(tmp_path / "out")

    def run(fails=False):
        def keep(batch, number):
            if fails:
                raise RuntimeError("lost")
            batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

        query = paged.stream_updates(spark, path).writeStream.option("checkpointLocation", str(tmp_path / "checkpoint")).foreachBatch(keep).start()
        try:
            query.processAllAvailable()
        finally:
            query.stop()

    paged.write_pages(studies(spark, rows[:40]), path, 7)
    run()
    paged.write_pages(studies(spark, rows[40:80]), path, 7)
    with pytest.raises(Exception, match="lost"):
        run(fails=True)
    paged.write_pages(studies(spark, rows[80:]), path, 7)  # comes while the failed batch is still open
    run()
    assert ids(spark.read.parquet(out)) == sorted(i for i, _ in rows)
    batches = {r.batch: r.commits for r in spark.read.parquet(out).groupBy("batch").agg(F.sort_array(F.collect_set("commit")).alias("commits")).collect()}
    assert batches[1] == [1]  # the batch that failed reads the same commits again, no more


def test_pages_without_a_commit_do_not_count(spark, tmp_path):
    path = str(tmp_path / "pages")
    assert paged.read_window(spark, path).count() == 0 and paged.commits(path) == []
    paged.write_pages(studies(spark, some(20)), path, 5)
    with open(f"{path}/page-left-behind.json", "w") as file:
        file.write('{"studies":[{}]}')
    assert paged.read_window(spark, path).count() == 26
    paged.write_pages(studies(spark, []), path, 5)
    assert paged.read_window(spark, path).count() == 26 and len(paged.commits(path)) == 2
    with pytest.raises(Exception, match="only ever added"):
        studies(spark, []).selectExpr("1 AS commit", "1 AS page", "1 AS place", "updated", "study").write.format(paged.FORMAT).option("path", path).mode("overwrite").save()


def test_pages_of_one_day_keep_the_order_of_keys(spark, tmp_path):
    path = str(tmp_path / "pages")
    rows = [(i, dt.date(2024, 1, 1 + i % 2)) for i in range(120)]
    paged.write_pages(studies(spark, rows[::-1]), path, 3)
    found = paged.first_updated(spark, path, 100)
    got = [r[0] for r in found.select(F.get_json_object("study", "$.protocolSection.identificationModule.nctId").cast("long")).collect()]
    assert got == [i for i, _ in sorted(rows, key=lambda r: (r[1], r[0]))][:100]
