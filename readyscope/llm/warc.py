"""WARC records in a content-addressed archive.

An archive is two tables. ``payloads`` holds the bytes of each distinct payload once,
under their SHA-256. ``headers`` holds a row per record with its exact header text and
the digest of its payload. Joining the two gives back the records as they were; every
payload is hashed again on the way, and one that does not match its digest stops the
read.

Of the records that share a payload of at least ``min_bytes`` bytes the one with the
largest id is the response, all others are revisits that refer to it; a revisit's block
ends with its HTTP header. Deciding that takes a table of digests, never the payloads;
those are not shuffled to be stored.

Defined results: a null payload is empty; a record without an id can be a revisit but
cannot be referred to, so where no record of a payload has an id, all are responses;
rows that repeat an id and payload are all responses, whose payload is stored once; a
null address leaves out its header line, line breaks in one are percent-encoded.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from readyscope.llm.common import attach, stored, whole
from readyscope.sources.scratch import shared_directory

# The names of the format
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"

MIN_BYTES = 0
DATE = "2000-01-01T00:00:00Z"


@dataclass(frozen=True)
class Archive:
    payloads: str
    headers: str


def sha1_base32(octets: Column) -> Column:
    """SHA-1 in upper-case base 32: five hexadecimal digits make four characters."""
    digest, characters = F.sha1(octets), []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            at = F.shiftright(bits, shift).bitwiseAND(F.lit(31)) + 1
            characters.append(F.substring(F.lit(BASE32), at, F.lit(1)))
    return F.concat(*characters)


def _record_name(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">"))


def _http(bytes_: Column) -> Column:
    lines = ["HTTP/1.1 200 OK", "Content-Type: text/html; charset=utf-8", "Content-Length: "]
    return F.concat(F.lit(CRLF.join(lines)), bytes_.cast("string"), F.lit(CRLF * 2))


def _header(date: str) -> Column:
    """The header text of a record, up to and with the blank line and the HTTP header."""
    revisit = F.col("refers_to").isNotNull()
    http = _http(F.col("bytes"))
    length = F.length(http) + F.when(revisit, 0).otherwise(F.col("bytes"))
    address = F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    lines = [
        F.lit("WARC/1.1"),
        F.concat(F.lit("WARC-Type: "), F.when(revisit, "revisit").otherwise("response")),
        F.concat(F.lit("WARC-Record-ID: "), _record_name(F.col("page_id"))),
        F.lit(f"WARC-Date: {date}"),
        F.concat(F.lit("WARC-Target-URI: "), address),
        F.concat(F.lit("WARC-Payload-Digest: sha1:"), F.col("sha1")),
        F.when(revisit, F.concat(F.lit("WARC-Refers-To: "), _record_name(F.col("refers_to")))),
        F.when(revisit, F.lit(f"WARC-Profile: {PROFILE}")),
        F.lit("Content-Type: application/http;msgtype=response"),
        F.concat(F.lit("Content-Length: "), length.cast("string")),
    ]
    # concat_ws passes over the lines that are null
    return F.concat(F.concat_ws(CRLF, *lines), F.lit(CRLF * 2), http)


def _matching(records: DataFrame, rows: DataFrame, how: str) -> DataFrame:
    same = [records["sha256"] == rows["sha256"], records["page_id"].eqNullSafe(rows["page_id"])]
    return records.join(rows, same, how)


def write_archive(
    pages: DataFrame,
    page_id: str = "page_id",
    url: str = "url",
    payload: str = "html",
    min_bytes: int = MIN_BYTES,
    date: str = DATE,
) -> Archive:
    """Archive a record per row in a new folder below the shared one."""
    spark = pages.sparkSession
    octets = whole(payload).cast("binary")
    records = pages.select(
        F.col(page_id).cast("long").alias("page_id"),
        F.col(url).cast("string").alias("url"),
        octets.alias("payload"),
        F.sha2(octets, 256).alias("sha256"),
    )
    digests = stored(
        records.select(
            "page_id", "url", "sha256", F.length("payload").cast("long").alias("bytes"),
            sha1_base32(F.col("payload")).alias("sha1"),
        ),
        "warc-digests",
    )
    keepers = digests.groupBy("sha256").agg(
        F.max("page_id").alias("keeper"), F.count("*").alias("key_rows")
    )
    keepers = stored(keepers, "warc-keepers")
    shared = keepers.where("key_rows > 1")
    alone = digests.join(shared.select("sha256"), "sha256", "left_anti")
    alone = alone.withColumn("keeper", F.col("page_id"))
    rows = alone.unionByName(attach(digests, shared, ["sha256"]))
    again = (F.col("bytes") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("keeper"))
    rows = rows.withColumn("refers_to", F.when(again, F.col("keeper")))
    base = shared_directory(spark, "warc")
    archive = Archive(f"{base}/payloads", f"{base}/headers")
    rows.select("page_id", "sha256", _header(date).alias("header")).write.parquet(archive.headers)

    # Which rows' payloads are not stored is a narrow table. Stored first, its size is
    # known when the join is planned, so the payloads are shuffled only where it is large.
    key = ["page_id", "sha256"]
    others = stored(rows.where(~F.col("page_id").eqNullSafe(F.col("keeper"))).select(*key), "warc-others")
    twins = stored(digests.groupBy(*key).count().where("count > 1").select(*key), "warc-twins")
    kept = _matching(records, others, "left_anti")
    if not twins.isEmpty():
        once = _matching(kept, twins, "left_semi").dropDuplicates(["sha256"])
        kept = _matching(kept, twins, "left_anti").unionByName(once)
    kept = kept.select("sha256", "payload")
    kept.write.option("compression", "zstd").parquet(archive.payloads)
    return archive


def read_archive(spark: SparkSession, archive: Archive) -> DataFrame:
    """page_id, record_type, refers_to, header and payload of every record."""
    headers = spark.read.schema("page_id long, sha256 string, header string").parquet(archive.headers)
    payloads = spark.read.schema("sha256 string, payload binary").parquet(archive.payloads)
    intact = F.sha2("payload", 256) == F.col("sha256")
    verified = payloads.select(
        "sha256",
        F.when(intact, F.col("payload"))
        .otherwise(F.raise_error(F.concat(F.lit("damaged payload "), F.col("sha256"))))
        .alias("payload"),
    )
    refers = F.regexp_extract("header", r"\r\nWARC-Refers-To: <urn:page:(-?[0-9]+)>\r\n", 1)
    return headers.join(verified, "sha256", "left").select(
        "page_id",
        F.regexp_extract("header", r"\r\nWARC-Type: (\w+)\r\n", 1).alias("record_type"),
        F.when(refers != "", refers).cast("long").alias("refers_to"),
        "header",
        F.coalesce(
            "payload", F.raise_error(F.concat(F.lit("lost payload "), F.col("sha256")))
        ).alias("payload"),
    )


def record_bytes(records: DataFrame) -> DataFrame:
    """Add each record as it stands in a WARC file: header, block and two line breaks."""
    block = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(
        F.lit("").cast("binary")
    )
    end = F.lit(CRLF * 2).cast("binary")
    return records.withColumn("record", F.concat(F.col("header").cast("binary"), block, end))


# Groups pages by the payload itself and spells out base 32 from the hexadecimal digest
ORACLE = f"""
    WITH page AS (SELECT page_id, coalesce(html, '') AS payload FROM pages),
    keeper AS (SELECT payload, max(page_id) AS keeper FROM page GROUP BY payload)
    SELECT page_id,
           CAST(octet_length(encode(payload)) AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('{BASE32}', 1 + ((CAST(
               '0x' || substr(sha1(payload), CAST(5 * (i // 4) + 1 AS INTEGER), 5) AS INTEGER
           ) >> CAST(15 - 5 * (i % 4) AS INTEGER)) & 31), 1)), '') AS payload_digest,
           CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id <> keeper THEN keeper END AS refers_to
    FROM page JOIN keeper USING (payload)
"""
