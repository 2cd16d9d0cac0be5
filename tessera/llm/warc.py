"""Content-addressed WARC archive.

Payload bytes are stored once under their SHA-256, in a table bucketed by digest; exact
record headers are a table of their own. Original records come back by a join of the two,
which moves headers only: the store is already laid out by the join key. All JVM-side.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lookup, scratch, stored

LEAST = 1000
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:tessera:page:"


class Archive:
    """The two tables: ``payloads`` (digest, n, copies, response_id, payload) and ``headers`` (page_id, digest, n_copies, header)."""

    def __init__(self, spark: SparkSession, path: str, buckets: int):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.store = f"tessera_payloads_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.store} (digest binary, n bigint, copies bigint, response_id bigint, payload binary) USING parquet OPTIONS (compression 'zstd') "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}/payloads'"
        )

    def payloads(self) -> DataFrame:
        return self.spark.table(self.store)

    def drop(self) -> None:
        """Takes the store out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.store}")

    def headers(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/headers")


def write(pages: DataFrame, archive: Archive, date: str = "2024-01-01T00:00:00Z") -> int:
    """Archives every row of pages (page_id, url, html) as one record; returns how many.

    The payload is html in UTF-8; null counts as empty. Of equal payloads of at least 1000
    bytes, the record with the largest page_id is the response and others revisit it; a row
    that repeats that page_id is a response too, and a null page_id only if all are null.
    Line ends in url are percent-encoded; a null url leaves its header line out. An empty table
    makes an empty archive; payloads of any length are stored whole; other columns, whatever their names, are not read.
    """
    payload = F.encode(F.coalesce(F.col("html"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", payload.alias("payload"))
    rows = rows.withColumns({"digest": F.unhex(F.sha2("payload", 256)), "n": F.octet_length("payload").cast("bigint")})
    # One partial row for each task and digest crosses the network, however hot the digest.
    once = rows.groupBy("digest").agg(F.max("n").alias("n"), F.count("*").alias("copies"), F.max("page_id").alias("response_id"), F.first("payload").alias("payload"))
    once.select("digest", "n", "copies", "response_id", "payload").repartition(archive.buckets, "digest").sortWithinPartitions("digest").write.insertInto(archive.store)
    archive.spark.catalog.refreshTable(archive.store)
    plain = stored(rows.select("page_id", "url", "digest", F.sha1("payload").alias("sha1")), "records")
    total = plain.count()
    typed = lookup(plain, archive.payloads().select("digest", "n", "copies", "response_id"), "digest", "copies", total)
    again = (F.col("n") >= LEAST) & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    uri = F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    urn = lambda page: F.concat(F.lit(f"<{URN}"), F.coalesce(page.cast("string"), F.lit("none")), F.lit(">"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(again, "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        F.when(again, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", urn(F.col("response_id"))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("X-Payload-Length", F.col("n").cast("string")),
        line("Content-Length", F.when(again, F.lit("0")).otherwise(F.col("n").cast("string"))),
        F.lit("\r\n"),
    )
    typed.select("page_id", "digest", "copies", header.alias("header")).write.option("compression", "zstd").parquet(f"{archive.path}/headers")
    return total


def field(name: str):
    return F.regexp_extract("header", rf"\r\n{name}: ([^\r]*)\r\n", 1)


def read(archive: Archive, total: int) -> DataFrame:
    """The archive's records: page_id, header, record (exact bytes), type and the parsed fields; ``verified`` holds
    whether the stored payload has the length and both digests that the header declares, for revisits too, which hold none."""
    heads = archive.headers().withColumns({"record_type": field("WARC-Type"), "declared": field("WARC-Payload-Digest"), "declared_n": field("X-Payload-Length").cast("bigint")})
    sound = lambda payload: (F.unhex(F.sha2(payload, 256)) == F.col("digest")) & (F.concat(F.lit("sha1:"), F.sha1(payload)) == F.col("declared")) & (F.octet_length(payload) == F.col("declared_n"))
    # A digest has several responses only below LEAST bytes, so the payloads that lookup() broadcasts are small.
    full = lookup(heads.filter("record_type = 'response'").drop("copies"), archive.payloads().select("digest", "payload", F.when(F.col("n") < LEAST, F.col("copies")).otherwise(1).alias("copies")), "digest", "copies", total)
    full = full.select("page_id", "header", "record_type", F.concat(F.encode("header", "UTF-8"), F.col("payload"), F.lit(b"\r\n\r\n")).alias("record"), sound(F.col("payload")).alias("verified"))
    # Digests of the stored bytes, once for each payload however many revisits it has.
    facts = archive.payloads().select("digest", "copies", (F.unhex(F.sha2("payload", 256)) == F.col("digest")).alias("own"), F.concat(F.lit("sha1:"), F.sha1("payload")).alias("sha1"), F.octet_length("payload").cast("bigint").alias("bytes"))
    revisits = lookup(heads.filter("record_type = 'revisit'").drop("copies"), facts, "digest", "copies", total).select(
        "page_id", "header", "record_type", F.concat(F.encode("header", "UTF-8"), F.lit(b"\r\n\r\n")).alias("record"),
        (F.col("own") & (F.col("sha1") == F.col("declared")) & (F.col("bytes") == F.col("declared_n"))).alias("verified"),
    )
    return full.unionByName(revisits).withColumns(
        {
            "payload_bytes": field("X-Payload-Length").cast("bigint"),
            "payload_digest": F.substring_index(field("WARC-Payload-Digest"), ":", -1),
            "refers_to": F.nullif(F.regexp_extract("header", rf"\r\nWARC-Refers-To: <{URN}(-?\d+)>\r\n", 1), F.lit("")).cast("bigint"),
        }
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    archive = Archive(spark, scratch(spark, "warc"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    total = write(pages, archive)
    sound = F.when(F.col("verified"), F.col("page_id")).otherwise(F.raise_error(F.lit("a stored payload differs from its digest")).cast("bigint"))
    out = stored(read(archive, total).select(sound.alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to", F.octet_length("record").cast("bigint").alias("record_bytes")), "read")
    archive.drop()
    return out


SQL = r"""
WITH p AS (
  SELECT page_id, url, encode(coalesce(html, '')) AS b FROM pages),
q AS (SELECT page_id, url, octet_length(b) AS n, sha1(b) AS h FROM p),
k AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS r FROM q),
t AS (SELECT *, n >= 1000 AND page_id <> r AS again FROM k)
SELECT page_id, n AS payload_bytes, h AS payload_digest,
       CASE WHEN again THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN again THEN r END AS refers_to,
       CAST(CASE WHEN again THEN 0 ELSE n END + 4 + strlen(
         'WARC/1.1' || 'WARC-Type: ' || CASE WHEN again THEN 'revisit' ELSE 'response' END
         || 'WARC-Record-ID: <urn:tessera:page:' || page_id || '>' || 'WARC-Date: 2024-01-01T00:00:00Z'
         || 'WARC-Target-URI: ' || url || 'WARC-Payload-Digest: sha1:' || h
         || CASE WHEN again THEN 'WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest'
              || 'WARC-Refers-To: <urn:tessera:page:' || r || '>' ELSE '' END
         || 'Content-Type: text/html; charset=utf-8' || 'X-Payload-Length: ' || n
         || 'Content-Length: ' || CASE WHEN again THEN 0 ELSE n END)
       + CASE WHEN again THEN 24 ELSE 20 END AS BIGINT) AS record_bytes
FROM t
"""
