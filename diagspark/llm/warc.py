"""WARC archives with revisit records.

Pages with equal payloads are stored once: the headers are grouped by payload
digest, the page with the smallest id becomes the response and the others
revisit records that name it. Archives are text files written by Spark's own
writer (one a task, gzip), so a lost task is simply written again. A boundary
header, new for each write, comes first in every record and separates records
when the archives are read, whatever the payloads hold; Content-Length is
checked against what was read.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import scratch, stored

CRLF = "\r\n"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def _line(name: str, value: Column) -> Column:
    """A header line; '' for a null value. Control characters of a value cannot break the header."""
    return F.when(value.isNull(), F.lit("")).otherwise(F.concat(F.lit(f"{name}: "), F.regexp_replace(value.cast("string"), r"[\x00-\x1f\x7f]", " "), F.lit(CRLF)))


def _boundary(mark: str) -> str:
    return f"WARC/1.1{CRLF}WARC-Boundary: {mark}{CRLF}"


def resolved(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, url, payload, payload_digest, payload_bytes, refers_to of every page.

    refers_to is the smallest page_id with the same payload, if that is of at
    least ``least_bytes`` and belongs to another page; else null. Only digests
    and ids are shuffled to find it; the join back is by digest, where Spark
    splits a hot digest.
    """
    payload = F.coalesce("html", F.lit(""))
    own = pages.select("page_id", "url", payload.alias("payload"), F.sha2(payload, 256).alias("payload_digest"), F.octet_length(payload).cast("long").alias("payload_bytes"))
    repeated = own.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    first = stored(repeated, "first-payloads")
    other = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return own.join(first, "payload_digest", "left").withColumn("refers_to", other).drop("first")


def write_warc(pages: DataFrame, path: str, least_bytes: int = 100, date: str = "1970-01-01T00:00:00Z") -> str:
    """Write a record a page to archives below ``path``; gives the boundary that reads them.

    Headers are fresh: record ids come from the page id and the digest, the
    date is a parameter. A response holds an HTTP header and the payload, a
    revisit only the HTTP header and the names of the response and its digest.
    """
    mark = uuid.uuid4().hex
    revisit = F.col("refers_to").isNotNull()
    identity = lambda page: F.concat(F.lit("<urn:sha256:"), F.sha2(F.concat_ws(" ", page.cast("string"), F.col("payload_digest")), 256), F.lit(">"))
    body = F.concat(F.lit(HTTP), F.when(revisit, F.lit("")).otherwise(F.col("payload")))
    record = F.concat(
        F.lit(_boundary(mark)),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", identity(F.col("page_id"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", F.col("url")),
        _line("WARC-Page", F.col("page_id")),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), "payload_digest")),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, identity(F.col("refers_to")))),
        _line("WARC-Refers-To-Page", F.col("refers_to")),
        F.lit(f"Content-Type: application/http; msgtype=response{CRLF}"),
        _line("Content-Length", F.octet_length(body)),
        F.lit(CRLF), body,
    )
    resolved(pages, least_bytes).select(record.alias("value")).write.option("lineSep", CRLF + CRLF).option("compression", "gzip").text(path)
    return mark


def read_warc(spark: SparkSession, path: str, mark: str) -> DataFrame:
    """record_type, page, url, digest, refers_to, payload of every record below ``path``.

    A record whose length is not its Content-Length fails the job.
    """
    raw = spark.read.option("lineSep", _boundary(mark)).text(path).where("value <> ''")
    end = F.instr("value", CRLF + CRLF)
    head, rest = F.substr("value", F.lit(1), end), F.substr("value", end + 4)
    block = F.substr(rest, F.lit(1), F.length(rest) - 4)
    named = lambda name: F.nullif(F.regexp_extract("head", rf"(?m)^{name}: ([^\r\n]*)", 1), F.lit(""))
    parts = raw.select(head.alias("head"), block.alias("block"))
    checked = F.when(F.octet_length("block") == named("Content-Length").cast("long"), F.substr("block", F.lit(len(HTTP) + 1))).otherwise(F.raise_error(F.lit("a WARC record is not of its Content-Length")))
    return parts.select(
        named("WARC-Type").alias("record_type"), named("WARC-Page").alias("page"), named("WARC-Target-URI").alias("url"),
        F.substr(named("WARC-Payload-Digest"), F.lit(8)).alias("digest"), named("WARC-Refers-To-Page").alias("refers_to"), checked.alias("payload"),
    )


def warc_round_trip(pages: DataFrame, least_bytes: int = 100) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every page, from archives written and read back.

    Digest and length of a response are computed from the payload read; a
    revisit gets them from the response that it names, found by digest and
    page. A null html is an empty payload; null ids and urls are left out of
    the headers, and a null page_id is never the response of others. Rows that
    repeat the smallest page_id and its payload are all responses. An empty
    table gives no rows.
    """
    spark = pages.sparkSession
    path = scratch(spark, "warc")
    mark = write_warc(pages.select("page_id", "url", "html"), path, least_bytes)
    kind = pages.schema["page_id"].dataType.simpleString()
    whole = read_warc(spark, path, mark)
    read = whole.select(
        F.col("page").cast(kind).alias("page_id"), "record_type", "digest", F.col("refers_to").cast(kind).alias("refers_to"),
        F.octet_length("payload").cast("long").alias("payload_bytes"), F.when(F.col("record_type") == "response", F.sha2("payload", 256)).alias("payload_digest"),
    )
    headers = stored(read, "warc-headers")
    responses = headers.where("record_type = 'response'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    origin = stored(
        responses.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.min("page_id").alias("origin"), F.max("payload_bytes").alias("payload_bytes")), "warc-origins"
    )
    revisits = headers.where("record_type = 'revisit'").drop("payload_bytes", "payload_digest").join(origin, F.col("digest") == F.col("payload_digest"))
    same = F.when(F.col("origin") == F.col("refers_to"), F.col("refers_to")).otherwise(F.raise_error(F.lit("a revisit names another page than the response of its digest")).cast(kind))
    return responses.union(revisits.select("page_id", "payload_bytes", "payload_digest", "record_type", same.alias("refers_to")))


ORACLE_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS payload FROM pages
), d AS (
  SELECT page_id, CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS origin FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN origin IS DISTINCT FROM page_id AND origin IS NOT NULL THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN origin IS DISTINCT FROM page_id THEN origin END AS refers_to
FROM f
"""
