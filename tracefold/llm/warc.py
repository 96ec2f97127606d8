"""Revisit resolution: archives in which a repeated payload is stored once.

Only headers (page id, digest, size) are shuffled by payload digest; the decision is joined back on page id,
so pages that share one payload are not gathered in a task.  Archives are written and read by Spark, as WARC 1.1
with one record a page.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracefold.session import scratch_path

DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
RECORD = "page_id long, record_type string, payload_digest string, stored_bytes long, refers_to long, url string"


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of SHA-1: ten hex digits are eight base32 digits."""
    digits = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def resolve(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """One row a page with payload, digest, size, record type and the page that a revisit refers to.

    Null html is the empty payload.  Of equal payloads of at least ``least_bytes`` the smallest page id is the
    response; rows that share that page id are all responses, and so are rows of a group without any page id.
    A null page id beside others is a revisit.  Repeated rows stay rows.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    full = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        payload.alias("payload"), base32_sha1(payload).alias("payload_digest"),
                        F.octet_length(payload).cast("long").alias("payload_bytes"))
    heads = full.filter(F.col("payload_bytes") >= least_bytes).select("page_id", "payload_digest").distinct()
    first = heads.groupBy("payload_digest").agg(F.min("page_id").alias("first"))
    again = heads.join(first, "payload_digest").filter(~F.coalesce(F.col("page_id") == F.col("first"), F.col("first").isNull()))
    again = again.select(F.col("page_id").alias("p"), F.col("payload_digest").alias("d"), F.col("first").alias("refers_to"))
    joined = full.join(again, F.col("page_id").eqNullSafe(F.col("p")) & (F.col("payload_digest") == F.col("d")), "left")
    kind = F.when(F.col("d").isNull(), "response").otherwise("revisit")
    return joined.select("page_id", "url", "payload", "payload_digest", "payload_bytes", kind.alias("record_type"), "refers_to")


def _name(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit("null"))).cast("binary"))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5"), F.lit(">"))


def write_archives(resolved: DataFrame, path: str) -> str:
    """Write the rows of :func:`resolve` as gzipped WARC files of 4,096 records at most."""
    response = F.col("record_type") == "response"
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
                    F.col("payload_bytes").cast("string"), F.lit(END))
    head = lambda name, value: F.when(value.isNotNull(), F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))).otherwise("")
    url = F.regexp_replace(F.col("url"), "[\\x00-\\x20\\x7F]", "%20")
    length = F.octet_length(http) + F.when(response, F.col("payload_bytes")).otherwise(0)
    record = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"), F.lit("\r\n"),
        head("WARC-Record-ID", _name(F.col("page_id"))), F.lit(f"WARC-Date: {DATE}\r\n"),
        head("WARC-Target-URI", F.coalesce(url, F.lit("about:blank"))),
        head("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        head("X-Page-Id", F.col("page_id").cast("string")), head("X-No-URI", F.when(F.col("url").isNull(), F.lit("1"))),
        F.when(~response, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\n")).otherwise(""),
        head("WARC-Refers-To", F.when(~response, _name(F.col("refers_to")))), head("X-Refers-To-Page", F.col("refers_to").cast("string")),
        F.lit("Content-Type: application/http; msgtype=response\r\nContent-Length: "), length.cast("string"), F.lit(END),
        http, F.when(response, F.col("payload").cast("string")).otherwise(""))
    (resolved.select(record.alias("value")).write.option("lineSep", END).option("compression", "gzip")
     .option("maxRecordsPerFile", 4096).text(path))
    return path


def _parse(data: bytes) -> Iterator[tuple]:
    at = 0
    while at < len(data):
        cut = data.index(b"\r\n\r\n", at)
        head = dict(line.split(b": ", 1) for line in data[at:cut].split(b"\r\n")[1:])
        at = cut + 4 + int(head[b"Content-Length"])
        block = memoryview(data)[cut + 4:at]
        at += 4
        kind = head[b"WARC-Type"].decode()
        body = bytes(block[bytes(block[:400]).index(b"\r\n\r\n") + 4:])
        digest = head[b"WARC-Payload-Digest"].decode().removeprefix("sha1:")
        if kind == "response":
            found = hashlib.sha1(body).digest()
            if _b32(found) != digest:
                raise ValueError(f"payload of page {head.get(b'X-Page-Id')} doesn't match its digest")
        page, refers = head.get(b"X-Page-Id"), head.get(b"X-Refers-To-Page")
        url = None if b"X-No-URI" in head else head[b"WARC-Target-URI"].decode()
        yield (None if page is None else int(page), kind, digest, len(body), None if refers is None else int(refers), url, body)


def _b32(raw: bytes) -> str:
    import base64
    return base64.b32encode(raw).decode()


def read_archives(spark, path: str, payloads: bool = False) -> DataFrame:
    """The records of the archives, by their Content-Length; each response's payload is checked against its digest."""
    schema = RECORD + (", payload binary" if payloads else "")
    names = [x.split()[0] for x in schema.split(", ")]

    def parse(batches):
        for batch in batches:
            for content in batch.column("content"):
                raw = content.as_buffer()
                unpack, out = zlib.decompressobj(31), []
                data = unpack.decompress(raw)
                while unpack.unused_data:  # further members
                    rest, unpack = unpack.unused_data, zlib.decompressobj(31)
                    data += unpack.decompress(rest)
                for row in _parse(data):
                    out.append(row[:len(names)])
                    if payloads and len(out) >= 256:
                        yield _batch(out, names)
                        out = []
                if out:
                    yield _batch(out, names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(path).select("content")
    return files.mapInArrow(parse, schema)


def _batch(rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    kinds = {"page_id": pa.int64(), "stored_bytes": pa.int64(), "refers_to": pa.int64(), "payload": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array(c, kinds.get(n, pa.string())) for n, c in zip(names, zip(*rows))], names)


def archive(pages: DataFrame, least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Resolve, write, read back; revisits take the payload size of the response they refer to.

    An empty table gives an empty result.  Columns: page_id, payload_bytes, payload_digest, record_type, refers_to.
    """
    spark = pages.sparkSession
    path = write_archives(resolve(pages, least_bytes), path or scratch_path(spark, "warc"))
    found = read_archives(spark, path)
    stored = (found.filter("record_type = 'response'").groupBy("payload_digest").agg(F.max("stored_bytes").alias("payload_bytes"))
              .withColumnRenamed("payload_digest", "d"))
    found = found.join(stored, F.col("payload_digest") == F.col("d"), "left")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
