"""Content-addressed WARC archive: payload bytes once per digest, exact record headers apart, records by joins.

The archive is two Parquet tables in one folder. `payloads` holds every distinct payload once under its SHA-256.
`headers` holds one row per record with the exact bytes of its WARC header. Reading joins the two, rebuilds the records,
recomputes both digests from the stored bytes and fails on any difference.

Defined cases: a null payload is empty; a null or odd url (control characters) is written percent-encoded, null as no
`WARC-Target-URI` line; a null page id writes `urn:page:none` and is read back as null, below all other ids; rows that repeat an
id and payload give one record each, all of the group's keeper kind; payloads shorter than `min_bytes` are always
responses; an empty table gives an empty archive; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftline.llm.common import MISSING_ID, scratch

_HEX32, _BASE32 = "0123456789abcdefghijklmnopqrstuv", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32_sha1(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 hex digits, five at a time, are four base-32 digits."""
    digest = F.sha1(payload)
    parts = [F.lpad(F.lower(F.conv(F.substring(digest, 1 + 5 * i, 5), 16, 32)), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), _HEX32, _BASE32)


def _name(page: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))


def write_archive(pages: DataFrame, folder: str, page: str = "page_id", url: str = "url", body: str = "html", min_bytes: int = 0) -> None:
    """Write `pages` as an archive. Of equal payloads the record of the largest page id carries the bytes."""
    rows = pages.select(F.col(page).cast("long").alias("page"), F.col(url).cast("string").alias("url"),
                        F.coalesce(F.col(body).cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumns({"key": F.sha2("payload", 256), "size": F.octet_length("payload").cast("long"), "order": F.coalesce("page", F.lit(MISSING_ID))})
    # both groupings combine before the shuffle: a payload that a third of the pages share moves once per task
    keepers = rows.groupBy("key").agg(F.max("order").alias("keep"))
    rows.groupBy("key").agg(F.first("payload").alias("payload")).write.parquet(f"{folder}/payloads")
    records = rows.withColumn("digest", base32_sha1(F.col("payload"))).drop("payload").join(keepers, "key")
    response = (F.col("order") == F.col("keep")) | (F.col("size") < min_bytes)
    target = F.when(F.col("url").isNotNull(), F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace(F.url_encode("url"), "\\+", "%20"), F.lit("\r\n"))).otherwise("")
    kept = F.when(F.col("keep") != MISSING_ID, F.col("keep"))
    header = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(response, "response").otherwise("revisit"),
        F.lit("\r\nWARC-Record-ID: "), _name(F.col("page")), F.lit("\r\n"), target,
        F.lit("WARC-Payload-Digest: sha1:"), F.col("digest"), F.lit("\r\n"),
        F.when(response, "").otherwise(F.concat(F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "), _name(kept), F.lit("\r\n"))),
        F.lit("Content-Length: "), F.when(response, F.col("size")).otherwise(0).cast("string"), F.lit("\r\n\r\n"))
    records.select("key", header.cast("binary").alias("header")).write.parquet(f"{folder}/headers")


def read_archive(spark: SparkSession, folder: str) -> DataFrame:
    """Rebuilt records: page, url, record_type, refers_to, payload_digest, payload, record (exact bytes).

    Each record is joined with the stored payload of its key; a payload whose SHA-256 is not its key, or whose SHA-1 is not the
    one in the header, stops the job.
    """
    headers = spark.read.schema("key string, header binary").parquet(f"{folder}/headers")
    payloads = spark.read.schema("key string, payload binary").parquet(f"{folder}/payloads")
    checked = payloads.withColumn("payload", F.when(F.sha2("payload", 256) == F.col("key"), F.col("payload")).otherwise(F.raise_error(F.lit("a stored payload does not match its digest")).cast("binary")))
    stored = checked.withColumns({"stored_digest": base32_sha1(F.col("payload")), "stored_bytes": F.octet_length("payload").cast("long")})
    joined = headers.join(stored, "key", "left")
    text = F.col("header").cast("string")

    def field(pattern: str) -> Column:
        found = F.regexp_extract(text, pattern, 1)
        return F.when(found != "", found)

    digest = field("\r\nWARC-Payload-Digest: sha1:([A-Z2-7]+)\r\n")
    kind = field("\r\nWARC-Type: ([a-z]+)\r\n")
    out = joined.select(
        field("\r\nWARC-Record-ID: <urn:page:(-?[0-9]+)>\r\n").cast("long").alias("page"),
        F.url_decode(field("\r\nWARC-Target-URI: ([^\r\n]*)\r\n")).alias("url"),
        kind.alias("record_type"), field("\r\nWARC-Refers-To: <urn:page:(-?[0-9]+)>\r\n").cast("long").alias("refers_to"),
        F.when(digest == F.col("stored_digest"), digest).otherwise(F.raise_error(F.lit("a record does not match its stored payload"))).alias("payload_digest"),
        F.col("stored_bytes").alias("payload_bytes"), "payload",
        F.concat("header", F.when(kind == "response", F.col("payload")).otherwise(F.lit(b"")), F.lit(b"\r\n\r\n")).alias("record"))
    return out


def archived_pages(spark: SparkSession, pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write and read back; one row per page."""
    folder = scratch(spark, "warc")
    write_archive(pages, folder, min_bytes=min_bytes)
    return read_archive(spark, folder).select(F.col("page").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS keep, sha1(h) AS hex FROM p),
d AS (SELECT *, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(list_sum(list_transform(range(5), lambda j:
        (CAST(strpos('0123456789abcdef', substr(hex, CAST((i * 5 + j) // 4 + 1 AS INTEGER), 1)) AS BIGINT) - 1 >> (3 - (i * 5 + j) % 4)) % 2 * (1 << (4 - j)))) AS INTEGER) + 1, 1), '' ORDER BY i)
      FROM range(32) t(i)) AS digest FROM k)
SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, digest AS payload_digest,
       CASE WHEN page_id = keep THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = keep THEN NULL ELSE keep END AS refers_to
FROM d"""
