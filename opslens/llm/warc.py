"""WARC archives with revisit records: write, read back, resolve.

Headers (id, size, digest) are grouped by payload digest; the smallest id of a group becomes the
response and the others revisits that name it.  Archives are written with Spark's text writer, whose line
separator is the record separator, so any file system that Spark reaches will do; each is
one gzip stream.  Reading back parses by Content-Length and joins revisits to their responses.
"""

from __future__ import annotations

import gzip
import hashlib
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opslens.llm.store import batch, saved
from opslens.sources.workdir import fresh_path

#: Smaller payloads are always written in full.
MIN_REVISIT_BYTES = 100
RECORDS_PER_ARCHIVE = 2000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

_END = "\r\n\r\n"
_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_PARSED = pa.schema(
    [
        ("page_id", pa.int64()),
        ("url", pa.string()),
        ("record_type", pa.string()),
        ("refers_to", pa.int64()),
        ("named_digest", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
    ]
)
_PARSED_DDL = (
    "page_id long, url string, record_type string, refers_to long, named_digest string, "
    "payload_digest string, payload_bytes long"
)


def resolve(pages: DataFrame) -> DataFrame:
    """``pages`` (page_id, url, html) with ``payload, payload_bytes, digest, refers_to``.

    Null html is empty.  ``refers_to`` is null for responses.  Rows that repeat the smallest id of
    their payload are all responses; null ids come last.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), payload.alias("payload"))
    rows = rows.select(
        "*",
        F.octet_length("payload").cast("long").alias("payload_bytes"),
        F.sha2(F.col("payload").cast("binary"), 256).alias("digest"),
    )
    shared = (
        rows.where(F.col("payload_bytes") >= MIN_REVISIT_BYTES)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
        .where("n > 1 AND first IS NOT NULL")
        .drop("n")
    )
    met = rows.join(saved(shared, "firsts"), "digest", "left")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return met.select(*rows.columns, F.when(again, F.col("first")).alias("refers_to"))


def _header(name: str, value: Column) -> Column:
    """One header line, or nothing for null."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))


def _record(date: str) -> Column:
    revisit = F.col("refers_to").isNotNull()
    block = F.concat(F.lit(_HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    address = F.regexp_replace("url", "[\\x00-\\x20\\x7F]", "%20")
    return F.concat(
        F.lit("WARC/1.1\r\n"),
        _header("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _header("WARC-Record-ID", F.format_string("<urn:uuid:%s>", F.expr("uuid()"))),
        _header("WARC-Date", F.lit(date)),
        _header("WARC-Target-URI", address),
        _header("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _header("WARC-Page", F.col("page_id").cast("string")),
        _header("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _header("WARC-Refers-To-Page", F.col("refers_to").cast("string")),
        _header("Content-Type", F.lit("application/http;msgtype=response")),
        _header("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
        block,
    )


def write_archives(resolved: DataFrame, path: str, date: str = "2024-01-01T00:00:00Z") -> None:
    """Write ``resolve``'s rows as WARC records with fresh headers below ``path``."""
    lines = resolved.select(_record(date).alias("value"))
    lines.write.option("lineSep", _END).option("compression", "gzip").option(
        "maxRecordsPerFile", RECORDS_PER_ARCHIVE
    ).text(path)


def records(stream: io.BufferedIOBase) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive."""
    while version := stream.readline():
        if not version.startswith(b"WARC/"):
            raise ValueError(f"not a WARC record: {version[:40]!r}")
        headers = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode().partition(":")
            headers[name] = value.strip()
        size = int(headers["Content-Length"])
        block = stream.read(size)
        if len(block) != size or stream.read(4) != _END.encode():
            raise ValueError("cut-off WARC record")
        yield headers, block


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for content in b["content"]:
            rows = []
            with gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer())) as stream:
                for headers, block in records(stream):
                    payload = block.partition(b"\r\n\r\n")[2]
                    full = headers["WARC-Type"] == "response"
                    rows.append(
                        (
                            int(headers["WARC-Page"]) if "WARC-Page" in headers else None,
                            headers.get("WARC-Target-URI"),
                            headers["WARC-Type"],
                            int(headers["WARC-Refers-To-Page"]) if "WARC-Refers-To-Page" in headers else None,
                            headers["WARC-Payload-Digest"].removeprefix("sha256:"),
                            hashlib.sha256(payload).hexdigest() if full else None,
                            len(payload) if full else None,
                        )
                    )
            if rows:
                yield batch(dict(zip(_PARSED.names, zip(*rows, strict=True), strict=True)), _PARSED)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row per record below ``path``; digests and sizes are those of the payloads read."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_parse, _PARSED_DDL)


def join_revisits(parsed: DataFrame) -> DataFrame:
    """``parsed`` (already written) with each revisit's payload size and digest taken from its response.

    A revisit whose response is absent, or holds another payload, keeps nulls there.
    """
    originals = (
        parsed.where("record_type = 'response'")
        .groupBy(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"))
        .agg(F.max("payload_bytes").alias("__bytes"))
    )
    met = parsed.join(
        originals, (F.col("refers_to") == F.col("__id")) & (F.col("named_digest") == F.col("__digest")), "left"
    )
    return met.select(
        "page_id",
        "url",
        "record_type",
        "refers_to",
        F.coalesce("payload_digest", "__digest").alias("payload_digest"),
        F.coalesce("payload_bytes", "__bytes").alias("payload_bytes"),
    )


def deduplicated_archives(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as deduplicated archives in the shared folder and return what they hold."""
    spark = pages.sparkSession
    path = fresh_path(spark, "warc")
    write_archives(resolve(pages), path)
    return join_revisits(saved(read_archives(spark, path), "records"))
