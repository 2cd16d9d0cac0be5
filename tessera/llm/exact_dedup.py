"""Exact dedup against a persistent digest index.

The index is a table bucketed and sorted by digest. A batch is reduced to one row for
each digest, anti-joined with the index by sort-merge (the index side is neither shuffled
nor sorted) and what is new is appended. Only DataFrame operations run; texts never move,
only 32-byte digests do.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import lookup, scratch, stored, text_or_empty

WHITE = " \t\n\x0b\x0c\r"
INDEX = "digest binary, keep_id bigint, n_chars bigint, batch string"


def normalised(text: Column) -> Column:
    for c in WHITE:
        text = F.replace(text, F.lit(c), F.lit(""))
    return text


class DigestIndex:
    """A table of digests already kept, in the catalog as ``name`` with its files at ``path``."""

    def __init__(self, spark: SparkSession, path: str, buckets: int, name: str | None = None):
        """Opens the index at path, or begins an empty one. buckets must not change between batches."""
        self.spark, self.path, self.buckets = spark, path, buckets
        self.name = name or f"tessera_digests_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} ({INDEX}) USING parquet OPTIONS (compression 'zstd') "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def drop(self) -> None:
        """Takes the table out of the catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append(self, groups: DataFrame, batch: str) -> None:
        """groups whose digest the index lacks are added to it, so a batch that was cut off may be appended again. One file for each bucket and batch."""
        new = groups.hint("merge").join(self.table().select("digest"), "digest", "left_anti")
        (
            new.select("digest", F.col("top.keep_id").alias("keep_id"), F.col("top.n_chars").alias("n_chars"), F.lit(batch).alias("batch"))
            .repartition(self.buckets, "digest")
            .sortWithinPartitions("digest")
            .write.mode("append").insertInto(self.name)
        )
        self.spark.catalog.refreshTable(self.name)


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str) -> DataFrame:
    """One row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, seen_before.

    Texts are equal if the same without ASCII white space; a null text counts as empty. Of
    equal texts the row with most code points, then the smallest doc_id stays; a null doc_id
    comes after all others; of wholly equal rows one stays. If an earlier batch had the text
    (seen_before), none stays and keep_id names its row. group_size counts this batch.

    batch names docs: what the index has from a batch of this name is the batch's own, so a
    batch whose result was lost may be run again with the same result and adds nothing twice. An
    empty table gives no rows. Further columns of docs are not read, whatever their names.
    """
    rows = stored(
        docs.select(
            F.col("doc_id").cast("bigint").alias("doc_id"),
            F.unhex(F.sha2(normalised(text_or_empty()).cast("binary"), 256)).alias("digest"),
            F.char_length(text_or_empty()).cast("bigint").alias("n_chars"),
            F.monotonically_increasing_id().alias("row"),
        ),
        "digests",
    )
    best = F.max(F.struct("n_chars", (-F.col("doc_id")).alias("back"), (-F.col("row")).alias("last"), F.col("doc_id").alias("keep_id"), "row"))
    groups = stored(rows.groupBy("digest").agg(best.alias("top"), F.count("*").alias("group_size")), "groups")
    index.append(groups, batch)
    before = F.col("batch") != batch
    known = stored(
        groups.hint("merge").join(index.table().select("digest", "batch", F.col("keep_id").alias("in_keep")), "digest")
        .select("digest", "group_size", F.when(before, F.col("in_keep")).otherwise(F.col("top.keep_id")).alias("in_keep"), F.col("top.row").alias("keep_row"), before.alias("seen_before")),
        "known",
    )
    out = lookup(rows, known, "digest", "group_size", rows.count())
    return out.select(
        "doc_id",
        F.col("in_keep").alias("keep_id"),
        "group_size",
        (~F.col("seen_before") & (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        "seen_before",
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    index = DigestIndex(spark, scratch(spark, "index"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    out = deduplicate(docs, index, "documents").drop("seen_before")
    index.drop()  # the rows come from tables of their own
    return out


SQL = r"""
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
         sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS h
  FROM documents),
k AS (SELECT h, count(*) AS group_size, arg_min(doc_id, {'a': -n, 'b': doc_id}) AS keep_id FROM d GROUP BY h)
SELECT d.doc_id, k.keep_id, k.group_size, d.doc_id = k.keep_id AS kept, d.h AS text_sha256
FROM d JOIN k USING (h)
"""
