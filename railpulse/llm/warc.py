"""WARC archives: revisit resolution and deduplicated archives."""

from __future__ import annotations

import hashlib
import zlib
from base64 import b32encode
from collections.abc import Iterator
from itertools import islice

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from railpulse.llm.common import one_row, stage
from railpulse.session import work_folder

CRLF = "\r\n"
# Payload and url bytes that an archive holds, unless one record alone has more.
ARCHIVE_BYTES = 64 << 20
# Records are written by size: those of at most this share of an archive, then the larger ones.
RECORD_SHARES = (2_000, 64, 1)
SALTS = 32
# Fixed values of the WARC 1.1 format.
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32_HEX = "0123456789ABCDEFGHIJKLMNOPQRSTUV"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def sha1_base32(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1 of binary data: 160 bits, 40 at a time."""
    digits = F.sha1(payload)
    parts = [F.lpad(F.conv(F.substring(digits, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)]
    return F.translate(F.upper(F.concat(*parts)), BASE32_HEX, BASE32)


def record_uuid(record_id: Column) -> Column:
    """A name-based identifier of a record, the same in every run."""
    h = F.md5(F.concat(F.lit("record:"), record_id))
    at = [(1, 8), (9, 4), (13, 4), (17, 4), (21, 12)]
    return F.concat(F.lit("urn:uuid:"), F.concat_ws("-", *[F.substring(h, a, n) for a, n in at]))


def resolve_revisits(headers: DataFrame, min_bytes: int = 0, salts: int = SALTS) -> DataFrame:
    """Original response of every record, from headers alone.

    Takes (record_id unique, page_id, url, payload_bytes, payload_digest). Of the
    records with one digest the one with the largest page_id (NULL is smallest),
    then record_id, is the response. Payloads below ``min_bytes`` are all responses.
    Returns record_id and, for revisits, the response's ``ref_id``, ``ref_page_id``
    and ``ref_url``; NULL for responses.

    A digest may hold any share of the records. Its records are spread over
    ``salts``; each spread part is reduced to its best record before they meet, and
    the answer goes back to the parts, so that no task sees all records of a digest.
    """
    h = headers.where(F.col("payload_bytes") >= min_bytes).withColumn(
        "_salt", F.pmod(F.xxhash64("record_id"), F.lit(salts))
    )
    best = F.struct("page_id", "record_id", "url")
    parts = h.groupBy("payload_digest", "_salt").agg(F.max(best).alias("_best"), F.count(F.lit(1)).alias("_n"))
    whole = (
        parts.groupBy("payload_digest")
        .agg(F.max("_best").alias("_best"), F.sum("_n").alias("_n"), F.collect_set("_salt").alias("_salts"))
        .where(F.col("_n") > 1)
        .select("payload_digest", F.explode("_salts").alias("_salt"), "_best")
    )
    back = h.select("payload_digest", "_salt", "record_id").join(whole, ["payload_digest", "_salt"])
    return back.where(F.col("record_id") != F.col("_best.record_id")).select(
        "record_id",
        F.col("_best.record_id").alias("ref_id"),
        F.col("_best.page_id").alias("ref_page_id"),
        F.col("_best.url").alias("ref_url"),
    )


def _lines(*pairs: tuple[str, Column]) -> Column:
    """Header lines; those with a NULL value are left out."""
    return F.concat_ws("", *[F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit(CRLF)) for name, value in pairs])


def size_classes(archive_bytes: int) -> list[tuple[Column, int]]:
    """Which records are written together, by ``record_bytes``, and how many to an archive.

    As many of a class as fill an archive at their largest; records of more than an
    archive have one each.
    """
    size, classes, above = F.col("record_bytes"), [], -1
    for share in RECORD_SHARES:
        most = archive_bytes // share
        classes.append(((size > above) & (size <= most), share))
        above = most
    return [*classes, (size > above, 1)]


def write_archives(
    records: DataFrame, revisits: DataFrame, date: str, path: str, per_archive: int, mode: str = "errorifexists"
) -> None:
    """Write one response or revisit record per row, with fresh headers, ``per_archive`` to a file.

    A revisit carries the HTTP header of its capture and no payload. Spark's text
    writer commits the archives to any file system: a record is a line, and the line
    separator is the pair of line ends that closes a WARC record.
    """
    known = revisits.withColumnRenamed("record_id", "_record")
    r = records.join(known, F.col("record_id") == F.col("_record"), "left")
    is_revisit = F.col("_record").isNotNull()
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(CRLF + CRLF),
    )
    block = F.when(is_revisit, F.lit(b"")).otherwise(F.col("payload"))
    url = F.regexp_replace(F.col("url"), r"[\r\n]+", " ")
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        _lines(
            ("WARC-Type", F.when(is_revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", F.concat(F.lit("<"), record_uuid(F.col("record_id")), F.lit(">"))),
            ("WARC-Date", F.lit(date)),
            ("WARC-Target-URI", url),
            ("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
            ("WARC-Profile", F.when(is_revisit, REVISIT_PROFILE)),
            ("WARC-Refers-To", F.when(is_revisit, F.concat(F.lit("<"), record_uuid(F.col("ref_id")), F.lit(">")))),
            ("WARC-Refers-To-Target-URI", F.when(is_revisit, F.regexp_replace(F.col("ref_url"), r"[\r\n]+", " "))),
            ("WARC-Refers-To-Date", F.when(is_revisit, date)),
            ("Page-ID", F.col("page_id")),
            ("Refers-To-Page-ID", F.when(is_revisit, F.col("ref_page_id"))),
            ("Content-Type", F.lit("application/http; msgtype=response")),
            ("Content-Length", F.octet_length(http) + F.octet_length(block)),
        ),
        F.lit(CRLF),
    )
    lines = r.select(F.concat(head.cast("binary"), http.cast("binary"), block).cast("string").alias("value"))
    (
        lines.write.mode(mode)
        .option("lineSep", CRLF + CRLF)
        .option("compression", "gzip")
        .option("maxRecordsPerFile", per_archive)
        .text(path)
    )


def read_archives(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """One row per record, parsed by the lengths in its headers.

    ``payload_bytes`` is the HTTP length, ``payload_ok`` whether a response's payload
    has that length and the digest in its header (NULL for revisits).
    """
    fields = [
        pa.field("page_id", pa.int64()),
        pa.field("url", pa.string()),
        pa.field("payload_bytes", pa.int64()),
        pa.field("payload_digest", pa.string()),
        pa.field("record_type", pa.string()),
        pa.field("refers_to", pa.int64()),
        pa.field("payload_ok", pa.bool_()),
    ] + ([pa.field("payload", pa.binary())] if payloads else [])
    schema = pa.schema(fields)

    def records(content: bytes) -> Iterator[dict]:
        if content[:2] == b"\x1f\x8b":
            content = zlib.decompress(content, 31)
        at = 0
        while at < len(content):
            stop = content.index(b"\r\n\r\n", at)
            head, body = content[at:stop].decode("utf-8", "replace").split("\r\n"), stop + 4
            h = dict(line.split(": ", 1) for line in head[1:])
            at = body + int(h["Content-Length"]) + 4
            http = content.index(b"\r\n\r\n", body) + 4
            length = int(content[body:http].lower().split(b"content-length:")[1].split()[0])
            payload, digest, kind = content[http : at - 4], h["WARC-Payload-Digest"][5:], h["WARC-Type"]
            row = {
                "page_id": int(h["Page-ID"]) if "Page-ID" in h else None,
                "url": h.get("WARC-Target-URI"),
                "payload_bytes": length,
                "payload_digest": digest,
                "record_type": kind,
                "refers_to": int(h["Refers-To-Page-ID"]) if "Refers-To-Page-ID" in h else None,
                "payload_ok": None,
            }
            if kind == "response":
                true = b32encode(hashlib.sha1(payload).digest()).decode()
                row["payload_ok"] = len(payload) == length and true == digest
            if payloads:
                row["payload"] = payload if kind == "response" else None
            yield row

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0):
                rows = records(content.as_py())
                while some := list(islice(rows, 1_000)):
                    yield pa.RecordBatch.from_pylist(some, schema=schema)

    ddl = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload_ok boolean"
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(parse, ddl + (", payload binary" if payloads else ""))


def deduplicated_archives(
    records: DataFrame,
    path: str,
    min_bytes: int = 0,
    date: str = "2024-01-01T00:00:00Z",
    archive_bytes: int = ARCHIVE_BYTES,
) -> None:
    """Archives at ``path`` holding every capture, equal payloads once.

    Takes (record_id, page_id, url, payload binary); record_id is unique and not
    NULL. A NULL payload counts as empty; a NULL page_id or url leaves its header
    out. Repeated captures are records of their own: one is the response. No rows
    give no records. Payloads of any bytes survive, up to the 2 GB that Spark holds in one
    value. Other columns are not read. Headers alone are shuffled by digest; payloads
    move once, to meet what was decided for their record. Records of one class of
    sizes are written together, so that an archive has at most ``archive_bytes`` of
    payloads and urls or a single record. A failed call may leave some of the classes.
    """
    payload = F.coalesce(F.col("payload"), F.lit(b""))
    r = records.select("record_id", F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"))
    r = r.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn(
        "payload_digest", sha1_base32(F.col("payload"))
    )
    r = r.withColumn("record_bytes", F.col("payload_bytes") + F.coalesce(F.octet_length("url"), F.lit(0)))
    headers = stage(r.drop("payload"), "warc-headers")
    revisits = stage(resolve_revisits(headers.drop("record_bytes"), min_bytes), "warc-revisits")
    classes = size_classes(archive_bytes)
    counts = one_row(headers.agg(*[F.count_if(which).alias(str(i)) for i, (which, _) in enumerate(classes)]))
    used = [c for i, c in enumerate(classes) if counts[str(i)]] or classes[:1]
    for i, (which, per_archive) in enumerate(used):
        write_archives(r.where(which), revisits, date, path, per_archive, "append" if i else "errorifexists")


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table as captures, named by the path of their file and their place in it."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    place = F.concat_ws("#", F.md5(F.col("_metadata.file_path")), F.col("_metadata.row_index").cast("string"))
    return pages.select(
        place.alias("record_id"), "page_id", "url", F.col("html").cast("binary").alias("payload")
    )


def round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the pages as deduplicated archives and read them back."""
    path = work_folder(spark, "warc")
    deduplicated_archives(page_records(spark, sf_dir), path)
    return read_archives(spark, path).drop("url")
