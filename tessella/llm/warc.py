"""Content-addressed web archive in two tables.

Payload bytes are stored once for each SHA-256, after a check that the digest fits the bytes; exact record headers are
stored apart, one for each record. `reconstruct` joins the two into the original records. All of it runs in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import Scratch

CRLF = "\r\n"
END = "\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Archive:
    """Paths of the two tables."""

    headers: str
    payloads: str


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: 40 bits at a time are eight digits."""
    digest = F.sha1(data)
    digits = F.concat(*[F.lpad(F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 32), 8, "0") for i in range(4)])
    return F.translate(digits, "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def write(pages: DataFrame, key: str = "page_id", url: str = "url", payload: str = "html", min_bytes: int = 0, archive: Archive | None = None, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """Write a record per row. Of rows with equal payloads of min_bytes or more, that with the largest key is a response, the rest revisit it.

    A null payload counts as empty, a null url as "urn:none"; payloads of any length are kept whole. `date` is the records'
    WARC-Date. Rows of the same key are records of their own; several
    rows with equal payloads and the same largest key are all responses. Other columns
    are not stored. An empty table gives an empty archive.
    """
    spark = pages.sparkSession
    if archive is None:
        root = Scratch(spark).root
        archive = Archive(f"{root}/headers", f"{root}/payloads")
    rows = pages.select(F.col(key).alias("record_key"), F.coalesce(F.col(url), F.lit("urn:none")).alias("target"), F.coalesce(F.col(payload), F.lit("")).cast("binary").alias("data")).withColumn("digest", F.sha2("data", 256))
    # One row for each payload. Copies are merged before the shuffle, so a hot payload travels once from each task.
    rows.groupBy("digest").agg(F.max("record_key").alias("owner"), F.any_value("data").alias("data")).write.option("compression", "zstd").parquet(archive.payloads)
    owners = spark.read.parquet(archive.payloads).select("digest", "owner")
    slim = rows.select("record_key", "target", "digest", F.octet_length("data").cast("long").alias("n_bytes"), base32_sha1(F.col("data")).alias("payload_digest"))
    records = slim.join(owners, "digest")
    revisit = (F.col("n_bytes") >= min_bytes) & ~F.col("record_key").eqNullSafe(F.col("owner"))
    head = F.concat(
        F.lit(f"WARC/1.1{CRLF}WARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit(f"{CRLF}WARC-Record-ID: <urn:record:"), F.coalesce(F.col("record_key").cast("string"), F.lit("none")),
        F.lit(f">{CRLF}WARC-Target-URI: "), F.regexp_replace("target", "[\\r\\n]", " "),
        F.lit(f"{CRLF}WARC-Date: {date}{CRLF}WARC-Payload-Digest: sha1:"), F.col("payload_digest"),
        F.when(revisit, F.concat(F.lit(f"{CRLF}WARC-Profile: {PROFILE}{CRLF}WARC-Refers-To: <urn:record:"), F.col("owner").cast("string"), F.lit(">"))).otherwise(""),
        F.lit(f"{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n_bytes").cast("string"), F.lit(END),
    )
    records.select("record_key", "digest", head.cast("binary").alias("header")).write.option("compression", "zstd").parquet(archive.headers)
    return archive


def payloads(spark: SparkSession, archive: Archive) -> DataFrame:
    """The stored payloads; bytes that do not have their digest raise."""
    stored = spark.read.schema("digest string, data binary").parquet(archive.payloads)
    fits = F.sha2("data", 256) == F.col("digest")
    return stored.withColumn("data", F.when(fits, F.col("data")).otherwise(F.raise_error(F.concat(F.lit("stored bytes do not have digest "), F.col("digest"))).cast("binary")))


def headers(spark: SparkSession, archive: Archive) -> DataFrame:
    """The stored headers with their fields parsed."""
    text = F.col("header").cast("string")

    def field(name: str) -> Column:
        return F.regexp_extract(text, f"\\r\\n{name}: ([^\\r\\n]*)", 1)

    stored = spark.read.parquet(archive.headers)
    refers = F.regexp_extract(field("WARC-Refers-To"), "^<urn:record:(.*)>$", 1)
    return stored.select(
        "record_key", "digest", "header", F.regexp_extract(text, "\\r\\nWARC-Type: ([^\\r\\n]*)", 1).alias("record_type"), field("WARC-Target-URI").alias("target"),
        F.regexp_extract(field("WARC-Payload-Digest"), "^sha1:(.*)$", 1).alias("header_digest"), field("Content-Length").cast("long").alias("header_bytes"),
        F.when(refers != "", refers).cast(stored.schema["record_key"].dataType).alias("refers_to"),
    )


def reconstruct(spark: SparkSession, archive: Archive) -> DataFrame:
    """The original records: record_key, the parsed fields, and record (binary: header, payload, two line ends)."""
    both = headers(spark, archive).join(payloads(spark, archive), "digest")
    return both.withColumn("record", F.concat("header", "data", F.lit(END).cast("binary")))


def digests(spark: SparkSession, archive: Archive) -> DataFrame:
    """Read the archive back: a row for each record with length and digest of the payload that its record holds.

    The header's own length and digest must agree with the payload cut out of the reconstructed record, else it raises.
    """
    body = F.expr("substring(record, octet_length(header) + 1, octet_length(record) - octet_length(header) - 4)")
    back = reconstruct(spark, archive).withColumn("body", body).select("record_key", "record_type", "refers_to", "header_bytes", "header_digest", F.octet_length("body").cast("long").alias("payload_bytes"), base32_sha1(F.col("body")).alias("payload_digest"))
    agree = (F.col("payload_bytes") == F.col("header_bytes")) & (F.col("payload_digest") == F.col("header_digest"))
    return back.select("record_key", "payload_bytes", F.when(agree, F.col("payload_digest")).otherwise(F.raise_error(F.lit("a header does not fit its payload"))).alias("payload_digest"), "record_type", "refers_to")
