"""WARC archives over a content-addressed store.

Writing: each distinct payload becomes one response record, that of its smallest page; pages with an equal
payload become revisit records that refer to it. Spark's text writer writes the records, and its line
separator is the two line breaks that end a WARC record, so archives can be on any storage that Spark writes to.

Reading: records are split by their Content-Length, digests are verified against the bytes, and two tables
result: payload bytes, once by SHA-256, and exact headers with the digest. Joining them gives the records back.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
from collections.abc import Iterator
from typing import BinaryIO

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinloom.llm.common import bind, staged, work_dir

BREAK = "\r\n"
#: Records in an archive file at most. A reader inflates a file record by record and passes on so many bytes at once.
FILE_ROWS, BATCH_BYTES = 1024, 8 << 20
_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HEADER = "page_id long, record_type string, refers_to long, header string, http_header string, digest string"


def base32_sha1(payload: Column) -> Column:
    """The SHA-1 of payload in bare upper-case base32."""
    digit = lambda v, shift: F.substring(F.lit(_ALPHABET), (F.shiftright(v, shift).bitwiseAND(F.lit(31)) + 1).cast("int"), F.lit(1))
    forty = lambda h, k: bind(F.conv(F.substring(h, 1 + 10 * k, 10), 16, 10).cast("long"), lambda v: F.concat(*[digit(v, s) for s in range(35, -1, -5)]))
    return bind(F.sha1(payload), lambda h: F.concat(*[forty(h, k) for k in range(4)]))


def _records(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The responses, with html, and the revisits, without: page_id, url, digest, sha1, size, nth, of, of_url.

    The smallest page of each payload and how often each row repeats are narrow aggregates. Html is shuffled once, by
    digest, after each task has kept one of equal payloads, so that a payload that very many pages share comes once
    from a task. Of repeated rows one is the response. No row needs a number that a lost task could give anew.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce("html", F.lit("")).alias("html"))
    rows = rows.select("page_id", "url", "html", F.sha2("html", 256).alias("digest"))
    facts = [base32_sha1(F.col("html")).alias("sha1"), F.octet_length("html").alias("size")]
    same = rows.select("page_id", "url", "digest", *facts).groupBy("digest", "page_id", "url", "sha1", "size").agg(F.count("*").alias("n"))
    same = staged(same, "warc-pages")
    first = same.groupBy("digest").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", F.col("url").isNull().alias("bare"), "url", "sha1", "size")).alias("first"))
    first = first.select("digest", *[F.col(f"first.{c}").alias(n) for c, n in (("page_id", "of"), ("url", "of_url"), ("sha1", "of_sha1"), ("size", "of_size"))])
    own = F.col("page_id").eqNullSafe(F.col("of")) & F.col("url").eqNullSafe(F.col("of_url"))
    many = same.join(first, "digest").withColumn("left", F.col("n") - F.when(own, 1).otherwise(0)).filter("left > 0")
    many = many.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("left").cast("int"))))
    kept = rows.groupBy("digest").agg(F.any_value("html").alias("html")).join(first, "digest")
    kept = kept.select(F.col("of").alias("page_id"), F.col("of_url").alias("url"), "digest", F.col("of_sha1").alias("sha1"), F.col("of_size").alias("size"), F.lit(0).alias("nth"), "of", "of_url", "html")
    return kept, many.select("page_id", "url", "digest", "sha1", "size", "nth", "of", "of_url")


def _urn(page: Column, url: Column, nth: Column) -> Column:
    """The record's name: its page, its number among repeated rows, and what its page and address hash to."""
    more = F.concat_ws(":", nth.cast("string"), F.lower(F.hex(F.xxhash64(url))), F.substring("digest", 1, 16))
    return F.concat(F.lit("<urn:kinloom:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(":"), more, F.lit(">"))


def _head(kind: str, http: Column, length: Column) -> Column:
    """A record's header, with the blank line after it."""
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(BREAK))
    refers = F.concat(line("WARC-Refers-To", _urn(F.col("of"), F.col("of_url"), F.lit(0))), F.lit(f"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest{BREAK}"))
    return F.concat(
        F.lit(f"WARC/1.1{BREAK}WARC-Type: {kind}{BREAK}"), line("WARC-Record-ID", _urn(F.col("page_id"), F.col("url"), F.col("nth"))),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", r"[\x00-\x20\x7F]", "%20")), F.lit("")), line("WARC-Date", F.lit("1970-01-01T00:00:00Z")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))), line("X-Payload-SHA256", F.col("digest")), refers if kind == "revisit" else F.lit(""),
        F.lit("Content-Type: application/http; msgtype=response" + BREAK), line("Content-Length", (F.octet_length(http) + length).cast("string")), F.lit(BREAK),
    )


def write_archive(pages: DataFrame, path: str, file_rows: int = FILE_ROWS) -> None:
    """Writes a record for each row of pages (page_id, url, html) below path, gzip-compressed.

    Null html counts as empty, and empty payloads are records like others; a null url gives no target header;
    a null page_id comes after all others. Of repeated rows with the smallest id, one is the response.
    """
    responses, revisits = _records(pages)
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{BREAK}Content-Type: text/html; charset=utf-8{BREAK}Content-Length: "), F.col("size").cast("string"), F.lit(2 * BREAK))
    records = responses.select(F.concat(_head("response", http, F.col("size")), http, "html").alias("value")).unionByName(revisits.select(F.concat(_head("revisit", http, F.lit(0)), http).alias("value")))
    writer = records.write.option("lineSep", 2 * BREAK).option("compression", "gzip")
    writer.option("maxRecordsPerFile", file_rows).text(path)


def split_records(content: BinaryIO) -> Iterator[tuple[str, bytes]]:
    """(header with its blank line, block) of each record of a stream, one record at a time."""
    gap = (2 * BREAK).encode()
    while line := content.readline():
        header = [line]
        while line != BREAK.encode():
            if not (line := content.readline()):
                raise ValueError("a record's header does not end")
            header.append(line)
        text = b"".join(header).decode()
        size = int(text.rpartition("Content-Length:")[2].split(BREAK, 1)[0])
        block = content.read(size)
        if len(block) != size or content.read(len(gap)) != gap:
            raise ValueError("a record does not end where its length says")
        yield text, block


def _fields(header: str) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in header.split(BREAK)[1:] if x)


def _page(urn: str | None) -> int | None:
    page = urn.split(":")[3] if urn else "none"
    return None if page == "none" else int(page)


def ingest(spark: SparkSession, archive: str, path: str) -> None:
    """Reads all archive files below ``archive`` into the store below ``path``: kind=header has HEADER's
    columns, kind=payload digest and payload. A payload that does not have its digests raises an error."""
    schema = HEADER + ", payload binary, kind string"
    fields = [("page_id", pa.int64()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("header", pa.string()), ("http_header", pa.string()), ("digest", pa.string()), ("payload", pa.binary()), ("kind", pa.string())]

    def table(out: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * len(fields)
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)], [n for n, _ in fields])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                out, held = [], 0
                for header, block in split_records(gzip.open(io.BytesIO(content.as_py()))):
                    field = _fields(header)
                    http, _, payload = block.partition(2 * BREAK.encode())
                    digest = field["X-Payload-SHA256"]
                    if field["WARC-Type"] == "response":
                        sha1 = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                        if hashlib.sha256(payload).hexdigest() != digest or field["WARC-Payload-Digest"] != f"sha1:{sha1}":
                            raise ValueError(f"{field['WARC-Record-ID']}: the payload does not have its digest")
                        out.append((None, None, None, None, None, digest, payload, "payload"))
                    refers = _page(field.get("WARC-Refers-To")) if field["WARC-Type"] == "revisit" else None
                    out.append((_page(field["WARC-Record-ID"]), field["WARC-Type"], refers, header, http.decode() + 2 * BREAK, digest, None, "header"))
                    held += len(block)
                    if held >= BATCH_BYTES:
                        yield table(out)
                        out, held = [], 0
                yield table(out)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(archive).select("content")
    files.mapInArrow(parse, schema).write.partitionBy("kind").option("compression", "zstd").parquet(path)


def store_table(spark: SparkSession, path: str, kind: str) -> DataFrame:
    columns = HEADER if kind == "header" else "digest string, payload binary"
    return spark.read.schema(columns + ", kind string").parquet(path).filter(F.col("kind") == kind).drop("kind")


def single(payloads: DataFrame) -> DataFrame:
    """One row for each digest, for stores that hold several archives. One archive of write_archive holds each
    payload once."""
    return payloads.dropDuplicates(["digest"])


def reconstruct(headers: DataFrame, payloads: DataFrame, *columns: Column | str) -> DataFrame:
    """The records: headers with the payload of their digest, or with other columns that are made of it alone: those
    are made once for a payload, before the join, and only they move. A payload that very many records share makes a
    skewed join, which adaptive execution splits."""
    return headers.join(payloads.select("digest", *(columns or ("payload",))), "digest")


def archived_pages(pages: DataFrame) -> DataFrame:
    """Writes pages as an archive, reads it into a store, and returns for each record page_id, payload_bytes,
    payload_digest, record_type and refers_to of the reconstructed record: its payload's length and digest are of the
    bytes that the store holds. An empty table gives an empty result."""
    spark = pages.sparkSession
    archive, path = work_dir(spark, "warc"), work_dir(spark, "warc-store")
    write_archive(pages, archive)
    ingest(spark, archive, path)
    size, digest = F.octet_length("payload").cast("long").alias("payload_bytes"), base32_sha1(F.col("payload")).alias("payload_digest")
    records = reconstruct(store_table(spark, path, "header"), store_table(spark, path, "payload"), size, digest)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
