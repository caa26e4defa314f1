"""WARC archives: one transaction per page, written, read back and assembled.

A transaction has a request, a response (or a revisit of an equal payload) and a metadata record;
request and metadata name the response in WARC-Concurrent-To. ``write_archives`` writes gzip'd
WARC 1.1 files of bounded size with Spark's writer, ``read_records`` parses them by their
Content-Length fields, ``assemble`` brings the three records of each capture together by the
concurrent-to identifier and emits one nested row.

Defined cases: null html is an empty payload; a null page_id or url is left out and reads back as
null; line ends in a url are written as %0A; of equal payloads with equal page_ids the one with
the greatest url is the response; rows that repeat each other wholly are captures of their own,
all but one of them revisits; extra columns are ignored; an empty table gives no captures.
"""

from __future__ import annotations

import gzip
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evidex.session import cut_lineage, work_folder

#: Payloads below this many bytes are never written as revisits.
REVISIT_BYTES = 1000
#: Bytes of records that one file should hold before compression.
FILE_BYTES = 32 << 20
#: All records have one date, so that equal input gives equal archives.
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: Bytes of parsed records that a task holds before it passes them on.
PARSED_BYTES = 8 << 20

RECORD = pa.schema(
    [
        ("record_type", pa.string()),
        ("record_id", pa.string()),
        ("concurrent_to", pa.string()),
        ("refers_to_id", pa.string()),
        ("target_uri", pa.string()),
        ("payload_digest", pa.string()),
        ("payload_bytes", pa.int64()),
        ("page_id", pa.int64()),
        ("refers_to_page", pa.int64()),
        ("payload", pa.binary()),
    ]
)
RECORD_DDL = (
    "record_type string, record_id string, concurrent_to string, refers_to_id string, "
    "target_uri string, payload_digest string, payload_bytes long, page_id long, "
    "refers_to_page long, payload binary"
)


def _id(key: Column, copy: Column) -> Column:
    h = F.sha1(F.concat_ws(":", key.cast("string"), copy.cast("string")))
    pieces = [F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *pieces), F.lit(">"))


def _record(headers: list[tuple[str, Column]], body: Column) -> Column:
    """One record up to its closing line ends, which the writer adds; null headers are left out."""
    lines = [F.coalesce(F.concat(F.lit(f"{k}: "), v, F.lit("\r\n")), F.lit("")) for k, v in headers]
    length = F.concat(F.lit("Content-Length: "), F.octet_length(body).cast("string"), F.lit(END))
    return F.concat(F.lit("WARC/1.1\r\n"), *lines, length, body)


def captures(pages: DataFrame, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Per page row: page_id, url, html, digest, n_bytes, id, and owner, owner_id of revisits.

    Equal payloads are found on rows without text; texts are shuffled once, keyed by the row, and
    equal rows combine before that.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.col("url").cast("string"), r"[\r\n]", "%0A").alias("url"),
        html.alias("html"),
        F.sha1(html.cast("binary")).alias("digest"),
        F.octet_length(html).cast("long").alias("n_bytes"),
    ).withColumn("k", F.xxhash64("page_id", F.coalesce("url", F.lit("\n")), "digest"))
    light = cut_lineage(
        rows.groupBy("k", "page_id", "url", "digest", "n_bytes").agg(F.count("*").alias("n"))
    )
    large = light.filter(F.col("n_bytes") >= revisit_bytes)
    owners = cut_lineage(
        large.groupBy("digest")
        .agg(F.max(F.struct("page_id", "url", "k")).alias("o"), F.sum("n").alias("all"))
        .filter("all > 1")
        .select("digest", F.col("o.page_id").alias("owner"), F.col("o.k").alias("owner_k"))
    )
    marks = cut_lineage(large.join(owners, "digest").select("k", "owner", "owner_k"))
    full = rows.groupBy("k").agg(
        *[F.first(c).alias(c) for c in ("page_id", "url", "html", "digest", "n_bytes")],
        F.count("*").cast("int").alias("n"),
    )
    numbered = full.join(marks, "k", "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("n"))))
    first = F.col("owner_k").isNull() | ((F.col("owner_k") == F.col("k")) & (F.col("copy") == 1))
    return numbered.select(
        "page_id", "url", "html", "digest", "n_bytes",
        _id(F.col("k"), F.col("copy")).alias("id"),
        F.when(~first, F.col("owner")).alias("owner"),
        F.when(~first, _id(F.col("owner_k"), F.lit(1))).alias("owner_id"),
    )


def write_archives(pages: DataFrame, path: str, revisit_bytes: int = REVISIT_BYTES) -> None:
    """Write the transactions of ``pages`` as gzip'd WARC files under ``path``."""
    rows = captures(pages, revisit_bytes)
    size = pages.agg(
        F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length(F.col("html").cast("string"))), F.lit(0)).alias("b")
    ).first()
    per_page = size["b"] / max(size["n"], 1) + 1500
    revisit = F.col("owner_id").isNotNull()
    shared = [("WARC-Date", F.lit(DATE)), ("WARC-Target-URI", F.col("url"))]
    head = F.lit(f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8{END}")
    url = F.coalesce("url", F.lit("/"))
    response = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", F.col("id")),
            *shared,
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "digest")),
            ("WARC-Refers-To", F.col("owner_id")),
            ("WARC-Profile", F.when(revisit, PROFILE)),
            ("Content-Type", F.lit("application/http; msgtype=response")),
        ],
        F.when(revisit, head).otherwise(F.concat(head, "html")),
    )
    request = _record(
        [
            ("WARC-Type", F.lit("request")),
            ("WARC-Record-ID", _id(F.col("id"), F.lit("request"))),
            *shared,
            ("WARC-Concurrent-To", F.col("id")),
            ("Content-Type", F.lit("application/http; msgtype=request")),
        ],
        F.concat(F.lit("GET "), url, F.lit(f" HTTP/1.1{END}")),
    )
    fields = [("page-id", "page_id"), ("payload-length", "n_bytes"), ("refers-to-page-id", "owner")]
    metadata = _record(
        [
            ("WARC-Type", F.lit("metadata")),
            ("WARC-Record-ID", _id(F.col("id"), F.lit("metadata"))),
            *shared,
            ("WARC-Concurrent-To", F.col("id")),
            ("Content-Type", F.lit("application/warc-fields")),
        ],
        F.concat(
            *[F.coalesce(F.concat(F.lit(f"{k}: "), F.col(c).cast("string"), F.lit("\r\n")), F.lit("")) for k, c in fields]
        ),
    )
    (
        rows.select(F.explode(F.array(request, response, metadata)).alias("value"))
        .write.option("lineSep", END)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", max(3, int(3 * FILE_BYTES / per_page)))
        .text(path)
    )


def parse(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers, block) of each record of an archive, as the Content-Length fields say."""
    if content[:2] == b"\x1f\x8b":
        content = gzip.decompress(content)
    at = 0
    while at < len(content):
        end = content.index(b"\r\n\r\n", at)
        version, *lines = content[at:end].decode().split("\r\n")
        if not version.startswith("WARC/"):
            raise ValueError(f"no WARC record at byte {at}")
        headers = dict(line.split(": ", 1) for line in lines)
        start = end + 4
        at = start + int(headers["Content-Length"])
        yield headers, content[start:at]
        at += 4


def read_records(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records under ``path``; a response's digest and length are taken from its payload.

    A payload that does not have the digest of its header raises an error.
    """

    def rows(content: bytes) -> Iterator[tuple]:
        for headers, block in parse(content):
            kind = headers["WARC-Type"]
            digest = headers.get("WARC-Payload-Digest", "").removeprefix("sha1:") or None
            size, fields, payload = None, {}, None
            if kind == "response":
                payload = block[block.index(b"\r\n\r\n") + 4 :]
                size = len(payload)
                if hashlib.sha1(payload).hexdigest() != digest:
                    raise ValueError(f"damaged payload in {headers['WARC-Record-ID']}")
            elif kind == "metadata":
                fields = dict(line.split(": ", 1) for line in block.decode().splitlines())
                size = int(fields["payload-length"])
            number = {k: int(fields[k]) if k in fields else None for k in ("page-id", "refers-to-page-id")}
            yield (
                kind, headers["WARC-Record-ID"], headers.get("WARC-Concurrent-To"), headers.get("WARC-Refers-To"),
                headers.get("WARC-Target-URI"), digest, size, number["page-id"], number["refers-to-page-id"],
                payload if payloads else None,
            )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def packed(found: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, t) for c, t in zip(zip(*found, strict=True), RECORD.types, strict=True)]
            return pa.RecordBatch.from_arrays(columns, schema=RECORD)

        for batch in batches:
            for content in batch.column(0):
                found, held = [], 0
                for row in rows(content.as_py()):
                    found.append(row)
                    held += 200 + len(row[-1] or b"")
                    if held >= PARSED_BYTES:
                        yield packed(found)
                        found, held = [], 0
                if found:
                    yield packed(found)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD_DDL)


def assemble(records: DataFrame) -> DataFrame:
    """One row per capture: capture_id, target_uri, and its request, response and metadata.

    Every record carries the capture's key: its own id (response, revisit) or its concurrent-to
    id. Captures without a response or revisit are left out.
    """
    main = F.col("record_type").isin("response", "revisit")
    part = {
        "response": (main, ("record_type", "record_id", "refers_to_id", "payload_digest", "payload_bytes", "payload")),
        "request": (F.col("record_type") == "request", ("record_id",)),
        "metadata": (F.col("record_type") == "metadata", ("record_id", "page_id", "payload_bytes", "refers_to_page")),
    }
    keyed = records.withColumn("capture_id", F.when(main, F.col("record_id")).otherwise(F.col("concurrent_to")))
    return (
        keyed.groupBy("capture_id")
        .agg(
            F.first(F.when(main, F.col("target_uri")), ignorenulls=True).alias("target_uri"),
            *[F.first(F.when(c, F.struct(*names)), ignorenulls=True).alias(k) for k, (c, names) in part.items()],
        )
        .filter("response is not null")
    )


def round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write ``pages`` to archives, read them back and return the digest columns per page."""
    spark = pages.sparkSession
    path = path or f"{work_folder(spark)}/warc-{uuid.uuid4().hex}"
    write_archives(pages, path)
    whole = assemble(read_records(spark, path, payloads=False))
    return whole.select(
        F.col("metadata.page_id").alias("page_id"),
        F.coalesce("response.payload_bytes", "metadata.payload_bytes").alias("payload_bytes"),
        F.col("response.payload_digest").alias("payload_digest"),
        F.col("response.record_type").alias("record_type"),
        F.col("metadata.refers_to_page").alias("refers_to"),
    )
