"""WARC archive, content addressed: each payload is stored once under a verified strong
digest, exact record headers are kept apart, and records are put together again by joins.

Layout of an archive folder (Parquet, in the shared folder):
  headers   record_id, page_id, digest (SHA-256 hex), header (the record's exact header block)
  payloads  digest, payload
  copies    page_id and digest of records whose payload another record stores

Of records with equal payloads the one with the largest page_id is `response`, the others
are `revisit` and refer to it. Defined results: null html is an empty payload; empty
payloads are equal like any others; of rows that repeat a page_id and payload the same
record is written each time, one of them stores the payload; a null page_id is below all
others; an empty table gives empty archives; line breaks in a url become blanks, as a header
line may hold none; reading a record whose payload is not in the store fails.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_folder

CRLF = "\r\n"
DATE = "2024-01-01T00:00:00Z"


def base32(hex_digest: Column) -> Column:
    """RFC 4648 base32 of a SHA-1 in hex: 5 hex digits are 20 bits, so 4 characters."""
    parts = [F.lpad(F.conv(F.substring(hex_digest, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _payloads(pages: DataFrame) -> DataFrame:
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    return pages.select("page_id", "url", payload.alias("payload"))


def write_archive(pages: DataFrame, path: str | None = None) -> str:
    """Writes the three tables and gives their folder.

    Only digests are grouped and joined; the payloads go from the pages straight into the
    store, less those of revisit records."""
    path = path or shared_folder(pages.sparkSession)
    spark = pages.sparkSession
    whole = _payloads(pages).select(
        "page_id", "url", F.sha2("payload", 256).alias("digest"), F.sha1("payload").alias("sha1"),
        F.octet_length("payload").cast("bigint").alias("bytes"),
    )
    whole.write.mode("overwrite").parquet(f"{path}/keys")
    keys = spark.read.schema(whole.schema).parquet(f"{path}/keys")
    owner = keys.groupBy(F.col("digest").alias("d")).agg(F.max("page_id").alias("owner"), F.count("*").alias("n"))
    row = keys.join(owner, F.col("digest") == F.col("d"))
    first = F.col("page_id").eqNullSafe(F.col("owner"))
    line = lambda name, value: F.concat(F.lit(name + ": "), value, F.lit(CRLF))
    urn = F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1" + CRLF),
        line("WARC-Type", F.when(first, F.lit("response")).otherwise(F.lit("revisit"))),
        line("WARC-Record-ID", urn),
        line("WARC-Date", F.lit(DATE)),
        F.when(F.col("url").isNotNull(), line("WARC-Target-URI", F.regexp_replace("url", r"[\r\n]", " "))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), base32(F.col("sha1")))),
        F.when(first, F.lit("")).otherwise(F.concat(
            line("WARC-Refers-To", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("owner").cast("string"), F.lit("null")), F.lit(">"))),
            line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        )),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.when(first, F.col("bytes")).otherwise(F.lit(0)).cast("string")),
        F.lit(CRLF),
    )
    row.select("page_id", "digest", header.alias("header")).write.mode("overwrite").parquet(f"{path}/headers")
    # written out, so that the planner sees its true size: it is broadcast only if small
    # a page_id may repeat with another payload, so both decide (a null page_id is a copy only of an owner with an id)
    row.where(~first).select(F.col("page_id").alias("i"), F.col("digest").alias("g")).write.mode("overwrite").parquet(f"{path}/copies")
    copies = spark.read.schema("i bigint, g string").parquet(f"{path}/copies")
    own = _payloads(pages).select("page_id", F.sha2("payload", 256).alias("digest"), "payload")
    own = own.join(copies, F.col("page_id").eqNullSafe(F.col("i")) & (F.col("digest") == F.col("g")), "left_anti")
    own.select("digest", "payload").write.mode("overwrite").option(
        "compression", "zstd"
    ).parquet(f"{path}/payloads")
    return path


def read_headers(spark, path: str) -> DataFrame:
    """Header fields parsed from the stored blocks."""
    h = spark.read.schema("page_id bigint, digest string, header string").parquet(f"{path}/headers")
    field = lambda name: F.nullif(F.regexp_extract("header", rf"\n{name}: ([^\r\n]*)\r\n", 1), F.lit(""))
    page = lambda x: F.nullif(F.regexp_extract(x, r"^<urn:page:(.*)>$", 1), F.lit("null")).try_cast("bigint")
    return h.select(
        page(field("WARC-Record-ID")).alias("page_id"), "digest", "header",
        field("WARC-Type").alias("record_type"),
        F.regexp_replace(field("WARC-Payload-Digest"), "^sha1:", "").alias("payload_digest"),
        page(field("WARC-Refers-To")).alias("refers_to"),
        field("WARC-Target-URI").alias("url"),
    )


def read_payloads(spark, path: str) -> DataFrame:
    """Stored payloads whose content matches their digest; anything else fails the job.
    Rows that repeat a digest (repeated page rows) count once."""
    p = spark.read.schema("digest string, payload binary").parquet(f"{path}/payloads")
    ok = F.sha2("payload", 256) == F.col("digest")
    return p.withColumn(
        "payload", F.when(ok, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("payload does not match "), "digest")).cast("binary"))
    )


def _there(col: str) -> Column:
    """The column of a payload row; a record whose payload is not in the store fails the job."""
    lost = F.raise_error(F.concat(F.lit("payload is lost: "), F.col("digest")))
    return F.when(F.col(col).isNull(), lost).otherwise(F.col(col))


def reconstruct(spark, path: str) -> DataFrame:
    """Every original record: its header fields, exact header and full payload."""
    payloads = read_payloads(spark, path).dropDuplicates(["digest"])
    return read_headers(spark, path).join(payloads, "digest", "left").withColumn("payload", _there("payload"))


def describe(spark, path: str) -> DataFrame:
    """Per record what the archive says and what its stored payload gives: both are read
    back. Payloads are measured where they lie, so the join moves digests only."""
    stored = read_payloads(spark, path).select(
        "digest", F.octet_length("payload").cast("bigint").alias("payload_bytes"), base32(F.sha1("payload")).alias("actual")
    ).distinct()
    return read_headers(spark, path).join(stored, "digest", "left").select(
        "page_id", _there("payload_bytes").alias("payload_bytes"),
        F.when(F.col("actual") == F.col("payload_digest"), F.col("actual")).otherwise(
            F.raise_error(F.concat(F.lit("payload digest differs: "), F.col("header"))).cast("string")
        ).alias("payload_digest"),
        "record_type", "refers_to",
    )


def archive(pages: DataFrame) -> DataFrame:
    """Writes the archive and describes it from what was written."""
    return describe(pages.sparkSession, write_archive(pages))


ORACLE = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, max(page_id) OVER (PARTITION BY coalesce(html, '')) AS owner,
         sha1(coalesce(html, '')) AS hex
  FROM pages
), g AS (
  SELECT *, list_transform(range(0, 8), lambda i: ('0x' || substr(hex, 1 + 5 * i, 5))::BIGINT) AS parts,
         'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567' AS a
  FROM p
)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes,
       list_aggregate(list_transform(parts, lambda v:
         a[(v // 32768) % 32 + 1] || a[(v // 1024) % 32 + 1] || a[(v // 32) % 32 + 1] || a[v % 32 + 1]), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = owner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = owner THEN NULL ELSE owner END AS refers_to
FROM g
"""
