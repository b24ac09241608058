"""A content-addressed WARC archive.

An archive is two tables under one folder. ``payloads`` holds the bytes of each distinct
payload once, under its SHA-256. ``records`` holds one row per record with its exact header
block (WARC headers and HTTP headers) and the payload's digest. A record as it stands in a
.warc file is its header block followed by the payload of its digest, or by nothing for a
revisit; reading joins the two and checks every payload against its digest.

Of records with equal payloads of at least ``LEAST`` bytes, the one with the largest id is
the response and the others revisit it; smaller payloads are worth no revisit.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions.storage import fresh_path, materialize

LEAST = 1000
DATE = "2024-01-01T00:00:00Z"
_END = "\r\n"


def _lines(*lines: Column) -> Column:
    """Header lines, the null ones left out, closed by an empty line."""
    return F.concat(F.array_join(F.array(*lines), _END), F.lit(_END + _END))


def _name(id_: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), id_, F.lit(">"))


def write_archive(
    pages: DataFrame, folder: str, id_col: str = "page_id", url_col: str = "url", body_col: str = "html",
    date: str = DATE, least: int = LEAST,
) -> None:
    """Writes one record per row of ``pages`` to ``folder``/payloads and ``folder``/records.

    A null body is an empty payload. A null id or url leaves its header line out; rows of a
    null id are responses. Repeated rows of the id that is the response are responses all.
    Other columns are not read, whatever their names. An empty table gives empty tables."""
    rows = pages.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(url_col).cast("string").alias("url"),
        F.encode(F.coalesce(F.col(body_col).cast("string"), F.lit("")), "UTF-8").alias("payload"),
    ).withColumn("digest", F.sha2("payload", 256))
    # Only digests, sizes and ids are shuffled here; equal payloads combine within tasks.
    facts = materialize(
        rows.select("id", "url", "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("bigint").alias("size")),
        "page-digests")
    # Each payload once: equal ones are dropped within tasks before they move.
    rows.select("digest", "payload").dropDuplicates(["digest"]).write.parquet(f"{folder}/payloads")
    keepers = facts.where(F.col("size") >= least).groupBy("digest").agg(F.max("id").alias("first"))
    # One digest may hold a third of the records; this side is narrow and AQE splits it.
    marked = facts.join(keepers.withColumnRenamed("digest", "d"), F.col("digest") == F.col("d"), "left")
    revisit = F.coalesce(F.col("first") != F.col("id"), F.lit(False))
    http = _lines(F.lit("HTTP/1.1 200 OK"), F.lit("Content-Type: text/html; charset=utf-8"),
                  F.concat(F.lit("Content-Length: "), F.col("size")))
    length = F.octet_length(http) + F.when(revisit, 0).otherwise(F.col("size"))
    head = _lines(
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _name(F.col("id"))),
        F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", "")),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _name(F.col("first")))),
        F.lit("Content-Type: application/http; msgtype=response"),
        F.concat(F.lit("Content-Length: "), length),
    )
    marked.select(F.concat(head, http).alias("headers"), "digest").write.parquet(f"{folder}/records")


def _header(name: str, part: Column) -> Column:
    """The value of a header line; null if there is none."""
    found = F.regexp_extract(part, rf"(?:^|\n){name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def _id_of(value: Column) -> Column:
    return F.regexp_extract(value, r"^<urn:page:(-?[0-9]+)>$", 1).try_cast("bigint")


def read_payloads(spark: SparkSession, folder: str) -> DataFrame:
    """(digest, payload); a payload that does not have its digest is an error."""
    right = F.sha2("payload", 256) == F.col("digest")
    checked = F.when(right, F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("damaged payload "), F.col("digest"))).cast("binary"))
    return spark.read.parquet(f"{folder}/payloads").select("digest", checked.alias("payload"))


def read_records(spark: SparkSession, folder: str) -> DataFrame:
    """(id, url, record_type, refers_to, payload_bytes, payload_digest) of every record, read
    from its headers and verified against the stored payload: a record whose length or
    SHA-1 is not the payload's is an error."""
    facts = read_payloads(spark, folder).select(
        F.col("digest").alias("stored"), F.octet_length("payload").cast("bigint").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"))
    head = F.split("headers", "\r\n\r\n")
    rows = spark.read.parquet(f"{folder}/records").select(
        "digest", head[0].alias("warc"), F.concat(head[1], F.lit(_END)).alias("http"))
    joined = rows.join(facts, F.col("digest") == F.col("stored"), "left")
    told = F.concat_ws(" ", _header("Content-Length", F.col("http")), _header("WARC-Payload-Digest", F.col("warc")))
    holds = F.concat_ws(" ", "payload_bytes", F.concat(F.lit("sha1:"), F.col("payload_digest")))
    kind = F.when(told == holds, _header("WARC-Type", F.col("warc"))).otherwise(
        F.raise_error(F.concat(F.lit("record and payload differ: "), F.col("warc"))))
    return joined.select(
        _id_of(_header("WARC-Record-ID", F.col("warc"))).alias("id"), _header("WARC-Target-URI", F.col("warc")).alias("url"),
        kind.alias("record_type"), _id_of(_header("WARC-Refers-To", F.col("warc"))).alias("refers_to"),
        "payload_bytes", "payload_digest")


def original_records(spark: SparkSession, folder: str) -> DataFrame:
    """(record): the bytes of every record as in a .warc file, joined from both tables."""
    rows = spark.read.parquet(f"{folder}/records")
    full = rows.where(~F.col("headers").contains("WARC-Type: revisit"))
    end = F.encode(F.lit(_END + _END), "UTF-8")
    head = F.encode("headers", "UTF-8")
    payloads = read_payloads(spark, folder).withColumnRenamed("digest", "stored")
    return full.join(payloads, F.col("digest") == F.col("stored")).select(
        F.concat(head, F.col("payload"), end).alias("record")
    ).union(rows.where(F.col("headers").contains("WARC-Type: revisit")).select(F.concat(head, end)))


def op5_warc(spark, folder):
    at = fresh_path(spark, "warc")
    write_archive(spark.read.parquet(f"{folder}/pages.parquet"), at)
    return read_records(spark, at).select(
        F.col("id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


OP5_SQL = """
with p as (
  select page_id, coalesce(html, '') h, octet_length(encode(coalesce(html, ''))) n, sha1(coalesce(html, '')) s from pages),
k as (select h, max(page_id) keep from p where n >= 1000 group by h)
select page_id, cast(n as bigint) payload_bytes, s payload_digest,
  case when keep <> page_id then 'revisit' else 'response' end record_type,
  case when keep <> page_id then keep end refers_to
from p left join k on p.h = k.h and p.n >= 1000
"""
