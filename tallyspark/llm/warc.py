"""WARC archives: writing captures with revisits, reading them back as transactions.

Each capture is three records: a request and a metadata record that name the capture's
response (or revisit) record in WARC-Concurrent-To. Of captures with equal payloads of at
least `least_bytes` bytes the one with the largest page_id is the response, the others are
revisit records without payload.

Archives are gzip text files written by Spark's own writer, so any file system that Spark
knows will do: a row is one record up to its last payload byte, the line separator is the
two line ends after it. They are read by Spark's text reader, split at the version line;
a record whose payload itself contains the version line comes in several parts, which are
joined until Content-Length bytes are there (files are not splittable, so a file's parts
come in order to one task; memory holds one record).

`transactions` joins requests and metadata to captures by WARC-Concurrent-To and gives one
nested row per capture.

Defined cases: a null payload counts as empty and a null url gives no WARC-Target-URI;
control characters and non-ASCII in a url are percent-coded in the record header. Repeated
rows give a capture each: record ids are made of page id and payload digest, so rows with
equal page id and different payloads have their own; fully equal rows share a record id and
come back as often as they were written. Null page ids are written as empty.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, join_split, ship

LEAST_BYTES = 1000
VERSION = "WARC/1.1\r\n"
SEPARATOR = "\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = "file string, kind string, record_id string, concurrent_to string, target_uri string, refers_to string, block_digest string, header map<string,string>, http string, payload binary"


def _id(*parts: Column) -> Column:
    h = F.md5(F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts]))
    cuts = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def _safe_uri(url: Column) -> Column:
    """Percent-codes what may not stand in a header line."""
    return F.array_join(F.transform(F.split(url, ""), lambda c: F.when(c.rlike(r"[^\x21-\x7E]"), F.url_encode(c)).otherwise(c)), "")


def _record(kind: str, fields: list[tuple[str, Column]], block: Column) -> Column:
    lines = [F.lit(VERSION), F.lit(f"WARC-Type: {kind}\r\n")]
    lines += [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in fields]
    lines += [F.concat(F.lit("Content-Length: "), F.octet_length(block).cast("string"), F.lit(SEPARATOR)), block]
    return F.concat(*lines)


def captures(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """pages with payload, payload_bytes, payload_digest and refers_to (null for responses)."""
    scratch = Scratch(pages.sparkSession, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    narrow = rows.select("page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.sha1("payload").alias("payload_digest"))
    narrow = scratch.keep(narrow, "digests")
    large = narrow.where(F.col("payload_bytes") >= least_bytes)
    groups = large.groupBy("payload_digest").agg(F.max("page_id").alias("response_id"), F.count(F.lit(1)).alias("n")).where("n > 1")
    # a payload that very many pages share is split over tasks
    key = F.xxhash64("payload_digest").alias("_key")
    shared = groups.select(key, F.col("payload_digest").alias("_of"), "response_id")
    again = join_split(large.select("*", key), shared, "_key").where((F.col("payload_digest") == F.col("_of")) & (F.col("page_id") != F.col("response_id")))
    again = again.select(F.col("page_id").alias("_id"), F.col("payload_digest").alias("_digest"), F.col("response_id")).distinct()
    digest = F.sha1("payload")
    joined = rows.withColumn("payload_digest", digest).join(again, (F.col("page_id") == F.col("_id")) & (F.col("payload_digest") == F.col("_digest")), "left")
    return joined.select("page_id", "url", "payload", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest", F.col("response_id").alias("refers_to"))


def archive_records(captured: DataFrame) -> DataFrame:
    """One column `value`: the records of the captures, three a capture."""
    page, digest = F.col("page_id"), F.col("payload_digest")
    own, other = _id(F.lit("response"), page, digest), _id(F.lit("response"), F.col("refers_to"), digest)
    uri, date = F.when(F.col("url") != "", _safe_uri(F.col("url"))), F.lit(DATE)
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("payload_bytes").cast("string"), F.lit(SEPARATOR))
    fields = [("WARC-Record-ID", own), ("WARC-Date", date), ("WARC-Target-URI", uri), ("Content-Type", F.lit("application/http;msgtype=response")), ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest))]
    response = _record("response", fields, F.concat(head, F.col("payload")))
    revisit = _record("revisit", [*fields, ("WARC-Profile", F.lit(PROFILE)), ("WARC-Refers-To", other)], head)
    main = F.when(F.col("refers_to").isNull(), response).otherwise(revisit)
    host = F.regexp_extract(uri, r"\A[^:]*://([^/?#]*)", 1)
    asked = F.concat(F.lit("GET "), F.coalesce(uri, F.lit("/")), F.lit(" HTTP/1.1\r\nHost: "), F.coalesce(host, F.lit("")), F.lit(SEPARATOR))
    request = _record("request", [("WARC-Record-ID", _id(F.lit("request"), page, digest)), ("WARC-Date", date), ("WARC-Target-URI", uri), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/http;msgtype=request"))], asked)
    notes = F.concat(
        F.lit("page-id: "), F.coalesce(page.cast("string"), F.lit("")), F.lit("\r\npayload-bytes: "), F.col("payload_bytes").cast("string"),
        F.coalesce(F.concat(F.lit("\r\nrefers-to-page: "), F.col("refers_to").cast("string")), F.lit("")), F.lit("\r\n"),
    )
    metadata = _record("metadata", [("WARC-Record-ID", _id(F.lit("metadata"), page, digest)), ("WARC-Date", date), ("WARC-Concurrent-To", own), ("Content-Type", F.lit("application/warc-fields"))], notes)
    return captured.select(F.explode(F.array(request, main, metadata)).alias("value"))


def write_archives(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, records_per_file: int = 60_000) -> None:
    records = archive_records(captures(pages, least_bytes))
    records.write.mode("overwrite").option("lineSep", SEPARATOR).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


def parse_records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Records of parts that were split at the version line, in the order of the files."""
    held: list[bytes] = []
    room, needed, file = 0, 0, ""  # bytes held and of the whole record
    out: list[tuple] = []
    size = 0
    version = VERSION.encode()

    def length_of(part: bytes) -> int:
        """Bytes of the record that begins with this part; no header has a version line."""
        head, found, _ = part.partition(b"\r\n\r\n")
        told = re.search(rb"^Content-Length: (\d+)\r?$", head, re.M)
        if not found or not told:
            raise ValueError(f"{file} has a record without a header")
        return len(head) + 4 + int(told[1])

    def complete() -> tuple:
        body = held[0] if len(held) == 1 else version.join(held)
        head, _, rest = body.partition(b"\r\n\r\n")
        fields = dict(x.split(": ", 1) for x in head.decode("utf-8", "replace").split("\r\n") if ": " in x)
        block = rest[: int(fields["Content-Length"])]
        http, payload = None, block
        if fields["WARC-Type"] in ("response", "revisit", "request"):
            head, _, payload = block.partition(b"\r\n\r\n")
            http = head.decode("utf-8", "replace")
        return (
            file, fields["WARC-Type"], fields.get("WARC-Record-ID"), fields.get("WARC-Concurrent-To"), fields.get("WARC-Target-URI"), fields.get("WARC-Refers-To"),
            re.sub("^sha1:", "", fields["WARC-Payload-Digest"]) if "WARC-Payload-Digest" in fields else None, list(fields.items()), http, payload,
        )

    names = ["file", "kind", "record_id", "concurrent_to", "target_uri", "refers_to", "block_digest", "header", "http", "payload"]
    kinds = [*[pa.string()] * 7, pa.map_(pa.string(), pa.string()), pa.string(), pa.binary()]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    for b in batches:
        for name, part in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            if name != file:
                if held:
                    raise ValueError(f"{file} ends within a record")
                file = name
            if not held and not part:
                continue
            if not held:
                room, needed = 0, length_of(part)
            room += len(part) + (len(version) if held else 0)
            held.append(part)
            if room >= needed:
                out.append(complete())
                size += len(out[-1][-1]) + 500
                held = []
            if size > 4 << 20:
                yield batch()
                out, size = [], 0
    if held:
        raise ValueError(f"{file} ends within a record")
    if out:
        yield batch()


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, kind, record_id, concurrent_to, target_uri, refers_to, block_digest, header, http, payload."""
    ship(spark)
    parts = spark.read.option("lineSep", VERSION).schema("value string").text(path)
    return parts.select(F.col("_metadata.file_path"), F.col("value").cast("binary").alias("value")).mapInArrow(parse_records, RECORD)


def transactions(records: DataFrame) -> DataFrame:
    """One nested row per capture: capture_id, response, request, metadata (structs; null where there is none)."""
    columns = [c for c in records.columns if c != "file"]
    main = records.where(F.col("kind").isin("response", "revisit")).select(F.col("record_id").alias("capture_id"), F.struct(*columns).alias("response"))
    side = records.where(F.col("kind").isin("request", "metadata")).select(F.col("concurrent_to").alias("capture_id"), "kind", F.struct(*columns).alias("own"))
    # each capture has one request and one metadata record; of repeated ones, which are equal, any will do
    side = side.groupBy("capture_id").agg(F.first(F.when(F.col("kind") == "request", F.col("own")), ignorenulls=True).alias("request"), F.first(F.when(F.col("kind") == "metadata", F.col("own")), ignorenulls=True).alias("metadata"))
    return main.join(side, "capture_id", "left")


def capture_summary(records: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every capture that was read.

    Responses are measured by what was read; a digest that differs from the record's own
    shows as the record_type "damaged".
    """
    slim = records.select(
        "file", "kind", "record_id", "concurrent_to", "block_digest",
        F.when(F.col("kind") == "response", F.sha1("payload")).alias("digest"), F.octet_length("payload").cast("long").alias("bytes"),
        F.when(F.col("kind") == "metadata", F.col("payload").cast("string")).alias("notes"),
    )
    whole = transactions(slim)
    note = lambda k: F.nullif(F.regexp_extract("metadata.notes", rf"(?:\A|\n){k}: (-?\d*)\r\n", 1), F.lit(""))
    revisit = F.col("response.kind") == "revisit"
    sound = revisit | (F.col("response.digest") == F.col("response.block_digest"))
    return whole.select(
        note("page-id").cast("long").alias("page_id"),
        F.when(revisit, note("payload-bytes").cast("long")).otherwise(F.col("response.bytes")).alias("payload_bytes"),
        F.when(revisit, F.col("response.block_digest")).otherwise(F.col("response.digest")).alias("payload_digest"),
        F.when(sound, F.col("response.kind")).otherwise(F.lit("damaged")).alias("record_type"),
        F.when(revisit, note("refers-to-page").cast("long")).alias("refers_to"),
    )


def archive_round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes the pages' archives to the shared folder and reads them back."""
    scratch = Scratch(pages.sparkSession, "archives")
    path = f"{scratch.root}/archives"
    write_archives(pages, path, least_bytes)
    return capture_summary(read_archives(pages.sparkSession, path))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
g AS (SELECT payload_digest, max(page_id) AS response_id FROM p WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT p.page_id, p.payload_bytes, p.payload_digest,
       CASE WHEN g.response_id IS NULL OR g.response_id = p.page_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN g.response_id <> p.page_id THEN g.response_id END AS refers_to
FROM p LEFT JOIN g ON p.payload_digest = g.payload_digest AND p.payload_bytes >= 1000
"""
