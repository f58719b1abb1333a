"""Content-addressed WARC archive: payloads once by digest, headers apart, records by join."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldkin.llm.common import LAST_ID, table
from fieldkin.session import keep, shared_directory

#: Payloads of fewer bytes are never revisited.
LEAST_BYTES = 100
#: The profile of revisit records, and the date of records whose table has none: fixed values.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
NO_DATE = "1970-01-01T00:00:00Z"


def _record_id(page: Column, row: Column) -> Column:
    name = F.md5(F.concat_ws("/", F.coalesce(page.cast("string"), F.lit("")), row.cast("string")))
    parts = [F.substring(name, at, size) for at, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _line(name: str, value: Column | str) -> Column:
    """A header line; nothing for a null value. Line ends within a value become spaces."""
    value = F.lit(value) if isinstance(value, str) else value.cast("string")
    return F.concat(F.lit(f"{name}: "), F.translate(value, "\r\n", "  "), F.lit("\r\n"))


def write_archive(pages: DataFrame, directory: str, id_column: str = "page_id", url_column: str = "url",
                  payload_column: str = "html", least_bytes: int = LEAST_BYTES) -> None:
    """Write a record per row: its exact header to ``headers``, its payload to ``payloads``.

    A payload is the column's text in UTF-8, null the empty one, and is stored once
    under its SHA-256 digest. Of rows with equal payloads of ``least_bytes`` or more,
    those with the smallest identifier are responses and the others revisit the first
    of them; rows without an identifier come last. Smaller payloads are stored once
    too, but all their records are responses.

    Digests meet their owner in a join whose large keys Spark can split; payloads are
    dealt out by row, so copies of a payload never meet in one task.
    """
    payload = F.coalesce(F.col(payload_column).cast("string"), F.lit(""))
    rows = pages.select(
        F.col(id_column).cast("long").alias("page"), F.col(url_column).cast("string").alias("uri"),
        payload.alias("payload"), F.monotonically_increasing_id().alias("row"))
    digests = rows.select("page", "uri", "row", F.octet_length("payload").cast("long").alias("length"),
                          F.sha2("payload", 256).alias("digest"))
    first = F.min(F.struct(F.coalesce("page", F.lit(LAST_ID)).alias("rank"), "row", "page")).alias("first")
    # Written, so that the join reads both sides from shuffles of its own and can split either.
    owners = keep(digests.groupBy("digest").agg(first), "owners")
    revisit = (F.col("length") >= least_bytes) & ~F.col("page").eqNullSafe(F.col("first.page"))
    size = F.when(revisit, F.lit(0)).otherwise(F.col("length"))
    lines = [
        F.lit("WARC/1.1\r\n"),
        _line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        _line("WARC-Record-ID", _record_id(F.col("page"), F.col("row"))),
        _line("WARC-Date", NO_DATE),
        F.coalesce(_line("WARC-Target-URI", F.col("uri")), F.lit("")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        F.when(revisit, F.concat(
            _line("WARC-Refers-To", _record_id(F.col("first.page"), F.col("first.row"))),
            F.coalesce(_line("WARC-Refers-To-Page", F.col("first.page")), F.lit("")),
            _line("WARC-Profile", PROFILE))).otherwise(""),
        F.coalesce(_line("WARC-Page", F.col("page")), F.lit("")),
        _line("WARC-Payload-Length", F.col("length")),
        _line("Content-Type", "text/html; charset=utf-8"),
        _line("Content-Length", size),
        F.lit("\r\n"),
    ]
    headers = digests.join(owners, "digest").select(
        "row", "digest", F.encode(F.concat(*lines), "UTF-8").alias("header"))
    headers.write.parquet(f"{directory}/headers")
    stored = owners.select("digest", F.col("first.row").alias("row"))
    rows.select("row", F.encode("payload", "UTF-8").alias("payload")).join(stored, "row").select(
        "digest", "payload").write.parquet(f"{directory}/payloads")


def _field(name: str) -> Column:
    """The value of a header line, null where there is none."""
    text = F.decode("header", "UTF-8")
    return F.nullif(F.regexp_extract(text, rf"\r\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))


def headers(spark: SparkSession, directory: str) -> DataFrame:
    """The records' fields, parsed from their header bytes."""
    return spark.read.parquet(f"{directory}/headers").select(
        "row", "header",
        _field("WARC-Type").alias("record_type"),
        _field("WARC-Record-ID").alias("record_id"),
        _field("WARC-Target-URI").alias("uri"),
        F.substring_index(_field("WARC-Payload-Digest"), ":", -1).alias("payload_digest"),
        _field("WARC-Page").cast("long").alias("page_id"),
        _field("WARC-Refers-To-Page").cast("long").alias("refers_to"),
        _field("WARC-Payload-Length").cast("long").alias("payload_bytes"),
        _field("Content-Length").cast("long").alias("content_length"),
    )


def payloads(spark: SparkSession, directory: str) -> DataFrame:
    """The stored payloads; reading one whose bytes don't have its digest fails."""
    digest = F.sha2("payload", 256)
    wrong = F.raise_error(F.concat(F.lit("A stored payload is not what its digest says: "), F.col("digest")))
    return spark.read.parquet(f"{directory}/payloads").select(
        F.when(digest == F.col("digest"), digest).otherwise(wrong).alias("payload_digest"),
        F.octet_length("payload").cast("long").alias("stored_bytes"), "payload")


def records(spark: SparkSession, directory: str) -> DataFrame:
    """Every record as it was, with its full payload; ``record`` is its bytes in a WARC file."""
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(b""))
    return headers(spark, directory).join(payloads(spark, directory), "payload_digest").select(
        "*", F.concat("header", body, F.lit(b"\r\n\r\n")).alias("record"))


def op4_warc_archive(spark: SparkSession, directory: str) -> DataFrame:
    """Every page's record, read back from an archive of the pages."""
    archive = f"{shared_directory(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    write_archive(table(spark, directory, "pages"), archive)
    stored = payloads(spark, archive).select("payload_digest", "stored_bytes")
    return headers(spark, archive).join(stored, "payload_digest").select(
        "page_id", F.col("stored_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")


OP4_SQL = f"""
WITH payloads AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
digests AS (
  SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha256(html) AS payload_digest,
         min(page_id) OVER (PARTITION BY html) AS owner
  FROM payloads)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> owner THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= {LEAST_BYTES} AND page_id <> owner THEN owner END AS refers_to
FROM digests
"""
