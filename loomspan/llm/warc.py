"""WARC archives with revisit resolution.

Headers (page_id, payload digest, length) are shuffled by digest, the least page_id of each digest becomes the
response, and each other record of the digest is joined to it and written as a revisit without payload, under a fresh
header. Payload bytes move once, by page_id, to the task that writes them; a digest that a third of all pages share
moves only as one partly aggregated minimum and as small headers.

Archives are gzip files of WARC/1.1 records in a shared folder, written and listed by Spark, so any store that Spark
reaches will do. A file takes as many records as make about ``FILE_BYTES`` at their mean size, and ``MOST_RECORDS`` at
most; it is read as a stream that holds one record at a time. Reading follows Content-Length, never a separator in the
payload. Dates are those of UTC.

Defined cases: a null html is an empty payload; payloads under ``MIN_BYTES`` are always responses; repeated rows with
the least page_id are all responses; a null page_id refers to the least known one and is a response if there is none;
line breaks in a url are escaped; a very long payload makes a long record and may make a file of its own; other columns
are ignored; an empty table gives an empty archive and result.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh_path

MIN_BYTES = 100
CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: What a file of the archive holds at about, before compression, and records at most.
FILE_BYTES, MOST_RECORDS = 64_000_000, 4000
RESULT = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"


def resolve(headers: DataFrame) -> DataFrame:
    """(page_id, digest, original): original is the page that a record revisits, null for responses."""
    first = headers.where(f"bytes >= {MIN_BYTES}").groupBy("digest").agg(F.min("page_id").alias("first_id"))
    found = headers.select("page_id", "digest").distinct().join(first, "digest", "left")
    return found.select(
        "page_id", "digest", F.when(~F.col("page_id").eqNullSafe(F.col("first_id")), F.col("first_id")).alias("original")
    )


def write_archives(pages: DataFrame, path: str) -> None:
    """Write one WARC record per row of ``pages`` (page_id, url, html) below ``path``."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long"),
        F.regexp_replace(F.coalesce(F.col("url").cast("string"), F.lit("")), "[\\r\\n]", "%0A").alias("url"),
        body.alias("body"),
        F.sha2(body, 256).alias("digest"),
        F.octet_length(body).cast("long").alias("bytes"),
    )
    headers = cut(rows.select("page_id", "digest", "bytes"))
    mean = headers.agg(F.avg(F.col("bytes") + 500)).first()[0] or 500
    ids = cut(resolve(headers)).select(F.col("page_id").alias("_page"), F.col("digest").alias("_digest"), "original")
    joined = rows.join(ids, F.col("page_id").eqNullSafe(F.col("_page")) & (F.col("digest") == F.col("_digest")))
    revisit = F.col("original").isNotNull()
    record_id = lambda c: F.concat(F.lit("<urn:x-page:"), F.coalesce(c.cast("string"), F.lit("none")), F.lit(">"))
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    block = F.concat(http, F.when(revisit, F.lit("")).otherwise(F.col("body")))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", F.col("url")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(
            revisit,
            F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", record_id(F.col("original")))),
        ).otherwise(F.lit("")),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.octet_length(http) + F.when(revisit, F.lit(0)).otherwise(F.col("bytes"))).cast("string")),
        F.lit(CRLF),
    )
    (
        joined.select(F.concat(head, block).alias("value"))
        .write.option("compression", "gzip")
        .option("lineSep", CRLF + CRLF)
        .option("maxRecordsPerFile", max(1, min(MOST_RECORDS, int(FILE_BYTES / mean))))
        .text(path)
    )


def records(archive: bytes | BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """(header fields in lower case, block) of each record of an archive, one after the other."""
    stream = io.BytesIO(archive) if isinstance(archive, bytes) else archive
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no WARC record where one should start: {line[:40]!r}")
        fields = {}
        while (line := stream.readline().decode().removesuffix(CRLF)) != "":
            k, _, v = line.partition(": ")
            fields[k.lower()] = v
        block = stream.read(int(fields["content-length"]))
        if len(block) < int(fields["content-length"]) or stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('warc-record-id')} does not end where its header says")
        yield fields, block


def _page(name: str) -> int | None:
    value = name.removeprefix("<urn:x-page:").removesuffix(">")
    return None if value == "none" else int(value)


def parse(archive: bytes | BinaryIO) -> Iterator[tuple]:
    """The result row of each record; a response's digest and length are taken from its payload, and compared."""
    for fields, block in records(archive):
        head, _, payload = block.partition(b"\r\n\r\n")
        size = int(next(x for x in head.split(b"\r\n") if x.lower().startswith(b"content-length:")).split(b":")[1])
        digest, kind = fields["warc-payload-digest"].removeprefix("sha256:"), fields["warc-type"]
        if kind == "response" and (size, digest) != (len(payload), hashlib.sha256(payload).hexdigest()):
            raise ValueError(f"payload of {fields['warc-record-id']} differs from its header")
        refers = _page(fields["warc-refers-to"]) if kind == "revisit" else None
        yield _page(fields["warc-record-id"]), size, digest, kind, refers


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to) of every record below ``path``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [x.split()[0] for x in RESULT.split(",")]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
        for batch in batches:
            for content in batch.column("content"):
                with gzip.open(io.BytesIO(content.as_py())) as archive:
                    rows = list(parse(archive))
                columns = zip(*rows) if rows else [[]] * len(names)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path)
    return files.select("content").mapInArrow(run, RESULT)


def archive(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as deduplicated archives in the shared folder and read them back."""
    path = fresh_path(pages.sparkSession, "warc")
    write_archives(pages, path)
    return read_archives(pages.sparkSession, path)
