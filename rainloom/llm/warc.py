"""A content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; the exact header bytes of every record are stored apart, with the
digest that they refer to. Records come back as header + payload by a join on the digest; every payload is
hashed again when it is read, once a digest. The report takes records apart again: the block behind the header must have the length and, where it isn't empty, the digest that the header says.
Only responses fetch payload bytes for it, so a payload that very many pages share travels once, and the marks of revisits are joined in a way that adaptive execution can split. Of the records with one payload the one with the smallest id is a response, the others
revisit it; payloads below `revisit_from` bytes are all responses.

Cases: a null id is the smallest id, and null again in reports; a null html is an empty payload, a null url an empty target, line ends in urls are percent-encoded; repeated rows of one id give records of their own and the digest still has one
payload; an empty table gives an empty archive; other columns are not looked at.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rainloom.llm.common import shared_dir, stash

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
CRLF = "\r\n"
#: Stands for a null id, so that such records join like others.
NO_ID = -(1 << 63)


def base32_of_hex(hexed: Column, chars: int = 40) -> Column:
    """Upper-case base32 of hexadecimal digits, five of which make four characters."""
    out = []
    for i in range(1, chars, 5):
        bits = F.conv(F.substring(hexed, i, 5), 16, 10).cast("int")
        out += [F.substring(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*out)


def write_archive(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", revisit_from: int = 0, date: str = "2020-01-01T00:00:00Z") -> None:
    """Write path/headers (a row per record: record_id, header, sha256) and path/payloads (a row per digest: sha256, payload)."""
    payload = F.encode(F.coalesce(payload_col, F.lit("")), "UTF-8")
    x = pages.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("record_id"), F.coalesce(url_col, F.lit("")).alias("url"), payload.alias("payload"))
    marks = x.select("record_id", "url", F.octet_length("payload").cast("long").alias("n"), F.sha2("payload", 256).alias("sha256"), F.sha1("payload").alias("sha1"))
    # a row per digest, summed before the shuffle; a table, so that a digest of very many records can be split over tasks where it is joined
    first = stash(marks.groupBy("sha256").agg(F.min("record_id").alias("first_id")), "warc-firsts")
    joined = marks.join(first, "sha256")
    revisit = (F.col("record_id") != F.col("first_id")) & (F.col("n") >= revisit_from)
    uuid_of = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), uuid_of(F.col("record_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), base32_of_hex(F.col("sha1"))),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), uuid_of(F.col("first_id")))),
        F.when(revisit, F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.lit("Content-Type: text/html"),
        F.concat(F.lit("Content-Length: "), F.when(revisit, F.lit(0)).otherwise(F.col("n")).cast("string")),
    ]
    header = F.encode(F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2)), "UTF-8")
    joined.select("record_id", header.alias("header"), "sha256").write.option("compression", "zstd").parquet(f"{path}/headers")
    # One shuffle of the payloads: rows that repeat an id and a payload meet where they are joined.
    first = first.withColumnRenamed("first_id", "record_id")
    keep = x.withColumn("sha256", F.sha2("payload", 256)).select("record_id", "sha256", "payload").join(first, ["record_id", "sha256"])
    keep.dropDuplicates(["record_id", "sha256"]).select("sha256", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def _parts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """The headers, with is_revisit, and the payloads, verified: each once."""
    is_revisit = F.decode("header", "UTF-8").contains("\r\nWARC-Type: revisit\r\n")
    headers = spark.read.parquet(f"{path}/headers").withColumn("is_revisit", is_revisit)
    verified = F.coalesce(F.sha2("payload", 256) == F.col("sha256"), F.lit(False))
    return headers, spark.read.parquet(f"{path}/payloads").select("sha256", "payload", F.octet_length("payload").cast("long").alias("n"), verified.alias("verified"))


def _record(block: Column) -> Column:
    return F.concat("header", block, F.encode(F.lit(CRLF * 2), "UTF-8"))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """The records again: record_id, header, payload (the whole one, for revisits too), record (the bytes of the WARC record) and verified."""
    headers, payloads = _parts(spark, path)
    whole = headers.join(payloads, "sha256", "left")
    block = F.when(F.col("is_revisit"), F.encode(F.lit(""), "UTF-8")).otherwise(F.col("payload"))
    return whole.select("record_id", "header", "payload", _record(block).alias("record"), F.coalesce("verified", F.lit(False)).alias("verified"))


def field(header: Column, name: str) -> Column:
    """A named field of record headers; null where absent."""
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)", 1)
    return F.when(found != "", found)


def archive_report(pages: DataFrame, path: str | None = None, **names) -> DataFrame:
    """Write the archive, read it back, and report each record from its reconstructed bytes; a payload that fails its digest stops the job."""
    spark = pages.sparkSession
    path = path or f"{shared_dir(spark)}/rainloom/warc-{uuid.uuid4().hex}"
    write_archive(pages, path, **names)
    headers, payloads = _parts(spark, path)
    own = headers.where(~F.col("is_revisit")).join(payloads, "sha256", "left")
    other = headers.where("is_revisit").join(payloads.select("sha256", "n", "verified"), "sha256", "left")
    records = own.select("record_id", _record(F.col("payload")).alias("record"), "n", "verified").unionByName(other.select("record_id", _record(F.encode(F.lit(""), "UTF-8")).alias("record"), "n", "verified"))
    # From here on the bytes of records alone: the header ends at the first empty line, the block lies between it and the last two line ends.
    split = F.instr(F.decode("record", "ISO-8859-1"), CRLF * 2)
    x = records.withColumn("split", split).select("record_id", "n", "verified", F.decode(F.expr("substring(record, 1, split + 1)"), "UTF-8").alias("h"), F.expr("substring(record, split + 4, octet_length(record) - split - 7)").alias("block"))
    digest = field(F.col("h"), "WARC-Payload-Digest")
    length = F.octet_length("block").cast("string") == field(F.col("h"), "Content-Length")
    whole = (field(F.col("h"), "WARC-Type") == "revisit") | ((digest == F.concat(F.lit("sha1:"), base32_of_hex(F.sha1("block")))) & (F.octet_length("block") == F.col("n")))
    sound = F.col("verified") & length & whole
    return x.select(
        F.nullif("record_id", F.lit(NO_ID)).alias("page_id"),
        F.col("n").alias("payload_bytes"),
        F.when(sound, F.substring(digest, 6, 32)).otherwise(F.raise_error(F.lit("a payload doesn't match its digest"))).alias("payload_digest"),
        field(F.col("h"), "WARC-Type").alias("record_type"),
        F.nullif(F.regexp_extract(field(F.col("h"), "WARC-Refers-To"), r"page:(-?\d+)", 1).cast("long"), F.lit(NO_ID)).alias("refers_to"),
    )


REPORT_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h, strlen(coalesce(html, '')) AS n FROM pages
), r AS (SELECT *, min(page_id) OVER (PARTITION BY sha256(html)) AS first_id FROM p)
SELECT page_id, n AS payload_bytes,
  list_aggregate([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST((('0x' || substr(h, 5 * (i // 4) + 1, 5))::BIGINT >> (15 - 5 * (i % 4))) & 31 AS INTEGER), 1) FOR i IN range(32)], 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM r
"""
