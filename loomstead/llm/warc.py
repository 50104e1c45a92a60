"""WARC archives in Zstandard: a dictionary in the leading skippable frame, then one frame for each record.

Spark's own writer puts the frames into files, so archives land on any file system that Spark writes to, with its commit protocol. The line separator
that this writer wants between values is an empty skippable frame, which every Zstandard reader passes over. A file's records come from one
partition, and its dictionary is trained on its own first records. A partition begins another archive once one has ARCHIVE_BYTES, so that an archive, which
is read as one row, stays small whatever the partition holds.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomstead.llm.common import broadcast_if_small, materialise, small_batches

#: Magic numbers of a skippable frame with a dictionary, of the first and last skippable frame, and of a frame with data.
DICTIONARY_MAGIC, SKIPPABLE, DATA_MAGIC = 0x184D2A5D, (0x184D2A50, 0x184D2A5F), 0xFD2FB528

#: An empty skippable frame, all of it ASCII.
SEPARATOR = struct.pack("<II", SKIPPABLE[0], 0).decode("ascii")

#: Payloads from this many bytes on are stored once.
REVISIT_BYTES = 1000

#: Bytes of a dictionary, and of the records that it is trained on, the first of a partition.
DICTIONARY_BYTES, SAMPLE_BYTES = 16_384, 2_000_000

#: Bytes of frames after which a partition begins another archive.
ARCHIVE_BYTES = 64_000_000

LEVEL, FED = 3, 1 << 16

ARCHIVE_SCHEMA = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def plan_records(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """(page_id, url, payload, digest, refers_to) for each page: refers_to is the page whose equal payload it repeats, else null.

    Of pages with equal payloads of REVISIT_BYTES or more, equal by length and SHA-1, that with the largest key is stored and the others refer to it.
    Digests are grouped with partial aggregates, and only those that repeat are joined, by broadcast up to a counted bound. A null html is empty.
    """
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    read = pages.select(F.col(key).cast("long").alias("page_id"), F.col(url).alias("url"), payload.alias("payload"), F.sha1(payload).alias("digest"))
    sized = read.withColumn("n", F.octet_length("payload"))
    grouped = sized.where(F.col("n") >= REVISIT_BYTES).groupBy("digest", "n").agg(F.max("page_id").alias("newest"), F.count("*").alias("copies"))
    repeated = materialise(grouped.where("copies > 1").select("digest", "n", "newest"))
    joined = sized.join(broadcast_if_small(repeated), ["digest", "n"], "left")
    return joined.select("page_id", "url", "payload", "digest", F.when(F.col("newest") != F.col("page_id"), F.col("newest")).alias("refers_to"))


def record(page_id: int | None, url: str | None, payload: bytes, sha1: bytes, refers_to: int | None, date: str) -> bytes:
    """One WARC record: a response with its payload, or a revisit with its header lines only."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if refers_to is not None else http + payload
    name = "" if page_id is None else page_id
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{name}>",
        f"WARC-Date: {date}",
        "Content-Type: application/http; msgtype=response",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(sha1).decode()}",
        f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(block).digest()).decode()}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from sample records; None if they are too few to train one."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, records)
    except zstandard.ZstdError:
        return None


def write_archives(records: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Writes what plan_records() gives as archives of ARCHIVE_BYTES or so, each from one partition, in folders by number; no records give no archive.

    An archive is longer only by its last record. Null urls have no field, null keys an empty one, and repeated rows a record each.
    """
    small_batches(records.sparkSession)

    def frames(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, n, held, compressor = 0, 0, 0, None
        for batch in batches:
            rows = zip(*(c.to_pylist() for c in batch.columns), strict=True)
            found = [record(page, url, payload, bytes.fromhex(digest), refers, date) for page, url, payload, digest, refers in rows]
            out: list[tuple[int, int, bytes]] = []
            for k, raw in enumerate(found):
                if compressor is None:
                    sample, size = [], 0
                    for r in found[k:]:
                        sample.append(r[:SAMPLE_BYTES])
                        if (size := size + len(r)) > SAMPLE_BYTES:
                            break
                    trained = train(sample)
                    content = trained.as_bytes() if trained else b""
                    out.append((archive, n, struct.pack("<II", DICTIONARY_MAGIC, len(content)) + content))
                    compressor, n, held = zstandard.ZstdCompressor(level=LEVEL, dict_data=trained, write_checksum=True, write_content_size=True), n + 1, len(content)
                out.append((archive, n, compressor.compress(raw)))
                n, held = n + 1, held + len(out[-1][2])
                if held >= ARCHIVE_BYTES:
                    archive, compressor = archive + 1, None
            columns = list(zip(*out, strict=True)) or [()] * 3
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int64(), pa.int64(), pa.binary()), strict=True)], ["archive", "n", "frame"])

    made = records.select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(frames, "archive long, n long, frame binary")
    made = made.sortWithinPartitions("archive", "n").select("archive", F.col("frame").cast("string").alias("value"))
    made.write.partitionBy("archive").option("lineSep", SEPARATOR).text(path)


def archive_records(content: bytes) -> Iterator[bytes]:
    """The records of an archive, each decoded from its own frame; ValueError for what is no frame, is cut short or fails its checksum."""
    view, at, decoder, first = memoryview(content), 0, zstandard.ZstdDecompressor(), True
    while at < len(view):
        if len(view) - at < 8:
            raise ValueError("the archive ends within a frame")
        magic, size = struct.unpack_from("<II", view, at)
        if SKIPPABLE[0] <= magic <= SKIPPABLE[1]:
            if at + 8 + size > len(view):
                raise ValueError("the archive ends within a skippable frame")
            if magic == DICTIONARY_MAGIC and first and size:
                raw = bytes(view[at + 8 : at + 8 + size])
                if struct.unpack_from("<I", raw)[0] == DATA_MAGIC:  # a dictionary may be compressed itself
                    raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
                decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at, first = at + 8 + size, False
            continue
        if magic != DATA_MAGIC:
            raise ValueError("a frame has a wrong magic number")
        frame, parts, first = decoder.decompressobj(), [], False
        try:
            while not frame.eof:
                if at >= len(view):
                    raise ValueError("the archive ends within a frame")
                parts.append(frame.decompress(view[at : at + FED]))
                at = min(at + FED, len(view)) - len(frame.unused_data)
        except zstandard.ZstdError as error:
            raise ValueError(f"a frame can't be decoded: {error}") from error
        yield b"".join(parts)


def parse_record(raw: bytes) -> dict:
    """The header fields (names in lower case) and the block of a record; ValueError if its version, header, lengths or block digest are wrong."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not gap or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC record")
    fields = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if not colon:
            raise ValueError(f"no header field: {line!r}")
        fields[name.strip().lower()] = value.strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if name not in fields:
            raise ValueError(f"{name} is missing")
    length = int(fields["content-length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"the block has {len(rest) - 4} bytes, not {length}")
    block = rest[:length]
    if (told := fields.get("warc-block-digest")) and told != "sha1:" + base64.b32encode(hashlib.sha1(block).digest()).decode():
        raise ValueError("the block doesn't match its digest")
    return fields | {"block": block}


def page_of(urn: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(found[1]) if found else None


def page_record(raw: bytes) -> tuple:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of a record, checked against its payload if that is stored."""
    fields = parse_record(raw)
    head, gap, payload = fields["block"].partition(b"\r\n\r\n")
    told = re.search(rb"(?im)^content-length:\s*(\d+)\r?$", head)
    if not gap or not told:
        raise ValueError("the block has no HTTP header with a length")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:"))
    if fields["warc-type"] == "response" and (len(payload) != int(told[1]) or hashlib.sha1(payload).digest() != digest):
        raise ValueError("the payload doesn't match its length or digest")
    return page_of(fields["warc-record-id"]), int(told[1]), digest.hex(), fields["warc-type"], page_of(fields.get("warc-refers-to"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """A row of ARCHIVE_SCHEMA and file and error (string) for each record of the archives in a folder.

    payload_bytes and payload_digest are those of the full payload, of revisits too. A record that isn't sound has nulls and an error; where an archive
    can't be read on, its rest is one such row. A folder without archives gives no rows.
    """
    small_batches(spark)  # and a batch ends once it has 64 MB, as is the default of Spark, so archives come one by one
    names, kinds = zip(*(f.split() for f in ARCHIVE_SCHEMA.split(", ")), strict=True)
    kinds = [pa.int64() if k == "long" else pa.string() for k in kinds]

    def checked(content: bytes) -> Iterator[tuple]:
        records = archive_records(content)
        while True:
            try:
                raw = next(records)
            except StopIteration:
                return
            except ValueError as error:
                yield *(None,) * len(names), str(error)
                return
            try:
                yield *page_record(raw), None
            except ValueError as error:
                yield *(None,) * len(names), str(error)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                columns = list(zip(*checked(content.as_py()), strict=True)) or [()] * (len(names) + 1)
                arrays = [pa.array(c, k) for c, k in zip(columns, [*kinds, pa.string()], strict=True)]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array([file] * len(columns[0]), pa.string())], [*names, "error", "file"])

    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(rows, f"{ARCHIVE_SCHEMA}, error string, file string")


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row of ARCHIVE_SCHEMA for each record; one that isn't sound stops the job with its file and fault. read_records() sets those apart instead."""
    read = read_records(spark, path)
    sound = F.when(F.col("error").isNotNull(), F.raise_error(F.concat("file", F.lit(": "), "error"))).otherwise(F.col("payload_digest"))
    return read.withColumn("payload_digest", sound.cast("string")).select(*(f.split()[0] for f in ARCHIVE_SCHEMA.split(", ")))


#: What writing and reading back gives, as DuckDB SQL.
ORACLE = """
WITH payloads AS (SELECT page_id, encode(coalesce(html, '')) AS p FROM pages),
sized AS (SELECT page_id, octet_length(p)::BIGINT AS payload_bytes, sha1(p) AS payload_digest FROM payloads),
newest AS (SELECT *, max(page_id) OVER (PARTITION BY payload_bytes, payload_digest) AS m FROM sized)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND m <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND m <> page_id THEN m END AS refers_to
FROM newest
"""
