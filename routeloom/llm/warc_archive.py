"""Content-addressed WARC archive.

Payload bytes are stored once, under their SHA-256; the exact header bytes of
each record are kept apart; original records are rebuilt by joining the two.
Digests are verified: a payload is used only if its bytes hash to its key.

Of records with equal payloads the one with the smallest page_id is the
response, the others are revisits of it (a payload of any length counts, from
0 bytes up). Among rows that repeat a page_id with the same payload, one is
the response.

Defined results: null html is an empty payload; a null page_id comes after all
others; line ends in a URL are percent-encoded in the header; a very long page
is one payload; an empty table gives an empty archive; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._common import Scratch, settle

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
#: The pages say nothing of when they were fetched.
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(hex160: Column) -> Column:
    """Upper-case base32 of 160 bits in hex: 5 hex digits are 4 base32 digits."""
    parts = [F.lpad(F.conv(F.substring(hex160, 1 + 5 * i, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", BASE32)


def url_header(url: Column) -> Column:
    """URL for a header line; percent-encodes what would end it."""
    out = F.coalesce(url.cast("string"), F.lit(""))
    for char in "\r\n":
        out = F.replace(out, F.lit(char), F.lit(f"%{ord(char):02X}"))
    return out


def write_archive(pages: DataFrame, path: str, date: str = DATE) -> None:
    """Write ``path``/payloads (digest, payload: one row per distinct payload) and ``path``/headers.

    ``pages``: page_id (long), url, html. ``date``: WARC-Date of all records.
    Headers: page_id, digest, head (the record's bytes before the payload:
    WARC header, blank line, HTTP head), has_payload (false for revisits).
    """
    spark = pages.sparkSession
    with Scratch(spark) as scratch:
        payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
        source = pages.select("page_id", "url", payload.alias("payload")).select("page_id", "url", "payload", F.sha2("payload", 256).alias("digest"))
        keys = source.select("page_id", url_header(F.col("url")).alias("url"), "digest", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("bytes"))
        keys = scratch.write(keys.withColumn("row", F.monotonically_increasing_id()), "keys")
        # Of equal payloads the least page_id, and of rows that repeat it the least row, is the response.
        least = F.min(F.struct(F.col("page_id").isNull().alias("unnamed"), "page_id", "row"))
        copies = keys.groupBy("digest").agg(least.alias("first"), F.count("*").alias("n")).where("n > 1")
        # Only payloads that occur again need a look-up; a written table has a size that the join can check.
        copies = scratch.write(copies.select("digest", "first.*").withColumnsRenamed({"page_id": "first_id", "row": "first_row"}), "copies")
        records = keys.join(copies, "digest", "left").withColumn("is_first", F.coalesce(F.col("row") == F.col("first_row"), F.lit(True)))
        named = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(F.col(c).cast("string"), F.lit("null")), F.lit(":"), F.col("digest"), F.lit(">"))
        own_id = F.when(F.col("is_first"), named("page_id")).otherwise(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))
        refers = F.concat(F.lit(f"\r\nWARC-Profile: {PROFILE}\r\nWARC-Refers-To: "), named("first_id"))
        lines = F.concat(
            F.lit("WARC/1.1\r\nWARC-Type: "), F.when(F.col("is_first"), F.lit("response")).otherwise(F.lit("revisit")),
            F.lit("\r\nWARC-Record-ID: "), own_id,
            F.lit(f"\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.col("url"),
            F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("sha1")),
            F.when(F.col("is_first"), F.lit("")).otherwise(refers),
            F.lit("\r\nContent-Type: application/http;msgtype=response\r\nContent-Length: "),
            (F.lit(len(HTTP)) + F.when(F.col("is_first"), F.col("bytes")).otherwise(F.lit(0))).cast("string"),
            F.lit("\r\n\r\n" + HTTP),
        )
        records.select("page_id", "digest", F.encode(lines, "UTF-8").alias("head"), F.col("is_first").alias("has_payload")).write.option("compression", "zstd").parquet(f"{path}/headers")
        # A payload that occurs again is stored from its first page; the rest need no look-up.
        s = source.select("page_id", "digest", "payload").join(copies.select("digest", "unnamed", "first_id"), "digest", "left")
        alone = s.where(F.col("unnamed").isNull())
        shared = s.where(F.col("unnamed").isNotNull() & F.col("page_id").eqNullSafe(F.col("first_id"))).dropDuplicates(["digest"])
        alone.unionByName(shared).select("digest", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")


def verified_payloads(spark: SparkSession, path: str) -> DataFrame:
    """digest and payload of the archive; a payload that doesn't hash to its digest is an error."""
    sound = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(F.raise_error(F.lit("payload doesn't match its digest")))
    return spark.read.parquet(f"{path}/payloads").withColumn("payload", sound)


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Original records, rebuilt: page_id, digest, record (exact bytes), head. Only responses are joined to payload bytes."""
    headers = spark.read.parquet(f"{path}/headers")
    end = F.lit(b"\r\n\r\n")
    responses = headers.where("has_payload").join(verified_payloads(spark, path), "digest")
    responses = responses.select("page_id", "digest", F.concat("head", "payload", end).alias("record"), "head")
    return responses.unionByName(headers.where("not has_payload").select("page_id", "digest", F.concat("head", end).alias("record"), "head"))


def op6_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    with Scratch(spark) as scratch:
        write_archive(pages, f"{scratch.path}/archive")
        # Parsed from each record's own bytes.
        head = F.decode(F.col("head"), "UTF-8")
        length = F.regexp_extract(head, r"\r\nContent-Length: (\d+)\r\n", 1).cast("int") - len(HTTP)
        refers = F.regexp_extract(head, r"\r\nWARC-Refers-To: <urn:page:(-?\d+):", 1)
        records = read_records(spark, f"{scratch.path}/archive")
        records = records.withColumn("record_type", F.regexp_extract(head, r"\r\nWARC-Type: (\w+)\r\n", 1)).withColumn("size", length)
        own = F.expr("substring(record, octet_length(head) + 1, size)")
        parsed = records.select("page_id", "digest", "record_type", F.when(refers != "", refers).cast("long").alias("refers_to"), F.octet_length(own).cast("long").alias("payload_bytes"), base32(F.sha1(own)).alias("payload_digest"))
        parsed = scratch.write(parsed, "parsed")
        columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
        responses, revisits = parsed.where("record_type = 'response'"), parsed.where("record_type = 'revisit'")
        # A revisit's payload is that of the response it refers to.
        full = revisits.drop("payload_bytes", "payload_digest").join(responses.select("digest", "payload_bytes", "payload_digest"), "digest")
        return settle(responses.select(*columns).unionByName(full.select(*columns)))
