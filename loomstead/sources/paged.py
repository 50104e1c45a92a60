"""A registry's paged scan as a data source of its own: pages of studies in the order of their last update, read by ranges of pages.

A folder holds pages (files of JSON with an array `studies`) and commits, each a list of the pages that came together: how many studies a page holds and
the first and the last day on which one was updated. So a window of days opens only the pages that it meets, whether it comes as options or as a filter on
`updated` that Spark pushes down; a batch is planned as ranges of pages, and a stream reads commit by commit. Pages without a commit do not count,
so tasks that fail or run twice leave nothing behind that is read.
"""

from __future__ import annotations

import datetime as dt
import json
import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

FORMAT = "paged_studies"

#: Studies of a page, and pages that one task reads, unless options say otherwise.
PAGE_SIZE, PAGES_A_TASK = 1000, 16

#: The setting by which a session pushes filters down to sources in Python.
PUSHDOWN = "spark.sql.python.filterPushdown.enabled"

SCHEMA = "commit int, page int, place int, updated date, study string"

COMMIT = re.compile(r"commit-(\d{8})\.json")

DAY = dt.timedelta(days=1)


def located(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI, and the path in it."""
    return fs.FileSystem.from_uri(path) if re.match(r"\w+:/", path) else (fs.LocalFileSystem(), path)


def day_of(text: str | None) -> dt.date | None:
    """A date given as yyyy, yyyy-MM or yyyy-MM-dd, missing parts as 1; None for anything else."""
    m = re.fullmatch(r"(\d{4})(?:-(\d{2}))?(?:-(\d{2}))?", (text or "").strip())
    try:
        return dt.date(int(m[1]), int(m[2] or 1), int(m[3] or 1)) if m else None
    except ValueError:
        return None


def updated_of(study: dict) -> dt.date | None:
    """The day on which a study was last updated."""
    at = study
    for name in ("protocolSection", "statusModule", "lastUpdatePostDateStruct"):
        at = at.get(name) or {}
    return day_of(at.get("date"))


@dataclass(frozen=True)
class Page:
    """A page as its commit lists it; first and last are None for pages in which no study tells when it was updated."""

    commit: int
    number: int
    file: str
    count: int
    first: dt.date | None
    last: dt.date | None
    undated: int

    def meets(self, start: dt.date | None, end: dt.date | None) -> bool:
        """Whether it may hold studies of a window of days; an open end is no bound, and undated studies are in a window without any."""
        if start is None and end is None:
            return True
        return self.first is not None and (start is None or self.last >= start) and (end is None or self.first <= end)

    def lies_within(self, start: dt.date | None, end: dt.date | None) -> bool:
        whole = start is None and end is None
        return whole or (self.undated == 0 and self.first is not None and (start is None or self.first >= start) and (end is None or self.last <= end))


def commits(path: str) -> list[int]:
    """The numbers of the commits of a folder, in order; none if it isn't there."""
    system, folder = located(path)
    found = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
    return sorted(int(m[1]) for f in found if (m := COMMIT.fullmatch(f.base_name)))


def listed(path: str, after: int = -1, upto: int | None = None) -> list[Page]:
    """The pages of the commits after one number up to another."""
    system, folder = located(path)
    pages = []
    for commit in commits(path):
        if commit > after and (upto is None or commit <= upto):
            with system.open_input_stream(posixpath.join(folder, f"commit-{commit:08d}.json")) as file:
                told = json.loads(file.read())
            day = lambda p, name: dt.date.fromisoformat(p[name]) if p[name] else None
            pages += [Page(commit, i, p["file"], p["count"], day(p, "first"), day(p, "last"), p["undated"]) for i, p in enumerate(told["pages"])]
    return pages


@dataclass
class Pages(InputPartition):
    """A range of pages for one task."""

    path: str
    pages: list[Page]
    start: dt.date | None = None
    end: dt.date | None = None

    def read(self) -> Iterator[pa.RecordBatch]:
        system, folder = located(self.path)
        for page in self.pages:
            with system.open_input_stream(posixpath.join(folder, page.file)) as file:
                studies = json.loads(file.read())["studies"]
            rows = [(i, updated_of(s), json.dumps(s, ensure_ascii=False)) for i, s in enumerate(studies)]
            if self.start or self.end:
                rows = [r for r in rows if r[1] and (not self.start or r[1] >= self.start) and (not self.end or r[1] <= self.end)]
            place, updated, text = zip(*rows, strict=True) if rows else ((), (), ())
            same = lambda x: pa.array([x] * len(rows), pa.int32())
            columns = [same(page.commit), same(page.number), pa.array(place, pa.int32()), pa.array(updated, pa.date32()), pa.array(text, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, ["commit", "page", "place", "updated", "study"])


def ranges(path: str, pages: list[Page], each: int, start: dt.date | None = None, end: dt.date | None = None) -> list[Pages]:
    """Pages as tasks of so many each; one without any where there are none, as Spark reads a source without tasks as one of unknown ones."""
    return [Pages(path, pages[a : a + each], start, end) for a in range(0, max(1, len(pages)), each)]


class PagedReader(DataSourceReader):
    """Batches: a task for each range of pages that the window and the pushed filters meet."""

    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("pagesPerTask", PAGES_A_TASK))
        self.start, self.end = day_of(options.get("from")), day_of(options.get("to"))
        self.limit = int(options["limit"]) if "limit" in options else None
        self.pushed: tuple[dt.date | None, dt.date | None] = (None, None)

    def chosen(self) -> list[Page]:
        """The pages to open, the earliest updates first. With a limit, as many as hold so many studies of the window for sure, and all that overlap them in time."""
        met = [p for p in listed(self.path) if p.meets(self.start, self.end) and p.meets(*self.pushed)]
        met.sort(key=lambda p: (p.first or dt.date.max, p.commit, p.number))
        if self.limit is None:
            return met
        sure, held = None, 0
        for p in sorted((p for p in met if p.lies_within(self.start, self.end) and p.last), key=lambda p: p.last):
            held += p.count
            if held >= self.limit:
                sure = p.last
                break
        return met if sure is None else [p for p in met if p.first is not None and p.first <= sure]

    def partitions(self) -> list[InputPartition]:
        return ranges(self.path, self.chosen(), self.each, self.start, self.end)

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        yield from partition.read()


class PushedReader(PagedReader):
    """The same, with filters on updated; Spark takes such a reader only where the session pushes filters down to sources in Python."""

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes bounds on updated as a window of pages; Spark still applies all filters to the rows. With a limit, which counts before filters, none is taken."""
        low, high = self.pushed
        for f in filters:
            yield f
            if self.limit is not None or getattr(f, "attribute", None) != ("updated",) or not isinstance(getattr(f, "value", None), dt.date):
                continue
            if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                bound = f.value + DAY if isinstance(f, GreaterThan) else f.value
                low = bound if low is None else max(low, bound)
            if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                bound = f.value - DAY if isinstance(f, LessThan) else f.value
                high = bound if high is None else min(high, bound)
        self.pushed = (low, high)


class PagedStream(DataSourceStreamReader):
    """Streams: offsets are numbers of commits, so a batch that runs again reads the same pages."""

    def __init__(self, options: dict):
        self.path, self.each = options["path"], int(options.get("pagesPerTask", PAGES_A_TASK))

    def initialOffset(self) -> dict:
        return {"commit": -1}

    def latestOffset(self) -> dict:
        return {"commit": max(commits(self.path), default=-1)}

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return ranges(self.path, listed(self.path, start["commit"], end["commit"]), self.each)

    def read(self, partition: Pages) -> Iterator[pa.RecordBatch]:
        yield from partition.read()


@dataclass
class Written(WriterCommitMessage):
    pages: list[dict]


class PagedWriter(DataSourceArrowWriter):
    """Writes pages of studies (a column study) in the order in which rows come, and lists them in a commit once all tasks are done."""

    def __init__(self, options: dict):
        self.path, self.size, self.run = options["path"], int(options.get("pageSize", PAGE_SIZE)), uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, folder = located(self.path)
        system.create_dir(folder, recursive=True)
        pages, held, task = [], [], TaskContext.get().partitionId()

        def flush(n: int) -> None:
            name = f"page-{self.run}-{uuid.uuid4().hex}.json"
            with system.open_output_stream(posixpath.join(folder, name)) as file:
                file.write(('{"studies":[' + ",".join(held[:n]) + "]}").encode())
            days = [updated_of(json.loads(s)) for s in held[:n]]
            dated = [d.isoformat() for d in days if d]
            pages.append({"file": name, "count": n, "first": min(dated, default=None), "last": max(dated, default=None), "undated": n - len(dated), "written": [task, len(pages)]})
            del held[:n]

        for batch in iterator:
            held += batch.column(batch.schema.get_field_index("study")).to_pylist()
            while len(held) >= self.size:
                flush(self.size)
        if held:
            flush(len(held))
        return Written(pages)

    def commit(self, messages: list[Written | None]) -> None:
        system, folder = located(self.path)
        pages = sorted((p for m in messages if m for p in m.pages), key=lambda p: (p["first"] or "9999", p["last"] or "9999", p["written"]))  # pages of one day stay as they were written
        number = max(commits(self.path), default=-1) + 1
        hidden = posixpath.join(folder, f"_commit-{self.run}")
        with system.open_output_stream(hidden) as file:
            file.write(json.dumps({"pages": pages}).encode())
        system.move(hidden, posixpath.join(folder, f"commit-{number:08d}.json"))  # all pages of a commit show at once

    def abort(self, messages: list[Written | None]) -> None:
        system, folder = located(self.path)
        for m in filter(None, messages):
            for p in m.pages:
                system.delete_file(posixpath.join(folder, p["file"]))


class PagedStudies(DataSource):
    """Options: path, and for reading from, to (days), limit, pagesPerTask and pushdown (whether filters are taken); for writing pageSize."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PagedReader:
        return (PushedReader if self.options.get("pushdown") == "true" else PagedReader)(self.options)

    def streamReader(self, schema) -> PagedStream:
        return PagedStream(self.options)

    def writer(self, schema, overwrite: bool) -> PagedWriter:
        if overwrite:
            raise ValueError("pages are only ever added")
        return PagedWriter(self.options)


def write_pages(studies: DataFrame, path: str, size: int = PAGE_SIZE, key: str = "id") -> None:
    """Adds studies (key, updated, study in JSON) to a folder of pages in one commit. Ranges of days, and of keys within one, make the tasks."""
    studies.sparkSession.dataSource.register(PagedStudies)
    dealt = studies.repartitionByRange("updated", key).sortWithinPartitions("updated", key)
    place = F.spark_partition_id()
    rows = dealt.select(place.alias("commit"), F.lit(None).cast("int").alias("page"), F.lit(None).cast("int").alias("place"), "updated", "study")
    rows.write.format(FORMAT).option("path", path).option("pageSize", size).mode("append").save()


def read_window(spark: SparkSession, path: str, start: str | None = None, end: str | None = None, **options: str) -> DataFrame:
    """Studies of a folder of pages that were last updated in a window of days, an open end is no bound: (commit, page, place, updated, study)."""
    spark.dataSource.register(PagedStudies)
    window = {k: v for k, v in (("from", start), ("to", end)) if v}
    return spark.read.format(FORMAT).options(path=path, pushdown=spark.conf.get(PUSHDOWN, "false"), **window, **options).load()


def first_updated(spark: SparkSession, path: str, n: int, start: str | None = None, end: str | None = None) -> DataFrame:
    """The first n studies of a window by their last update, of those of a day the first in the folder; undated ones come last."""
    found = read_window(spark, path, start, end, limit=str(n))
    return found.orderBy(F.asc_nulls_last("updated"), "commit", "page", "place").limit(n)


def stream_updates(spark: SparkSession, path: str) -> DataFrame:
    """The same rows as a stream: each commit is read once."""
    spark.dataSource.register(PagedStudies)
    return spark.readStream.format(FORMAT).option("path", path).load()
