"""Exact deduplication against a persistent digest index.

The index is a table bucketed and sorted by the SHA-256 of the normalised text. New data is reduced
to one row per digest, matched with the index by a sort-merge anti-join on the digest (the index
side needs no shuffle), and the digests not found there are appended.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import BLANKS, documents, folder, free, fresh, shared_dir, stage


def digest(text: Column) -> Column:
    """SHA-256 (32 bytes) of the text with each run of white space as one space; null counts as empty."""
    return F.unhex(F.sha2(F.regexp_replace(F.coalesce(text, F.lit("")), BLANKS, " "), 256))


class DigestIndex:
    """A digest table kept at `path`, in `buckets` buckets, sorted by digest within each file, a folder a batch.

    Opening a path that already holds files attaches them with the same bucketing, so that an index
    outlives its session. The number of buckets is fixed when the index is made. A batch that is
    run again, as after a lost driver, meets the index as it was before that batch, and replaces
    what it had written.
    """

    def __init__(self, spark: SparkSession, path: str, id_type: str = "bigint", buckets: int = 64):
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "digest_index_" + re.sub(r"\W", "_", path)[-40:] + "_" + uuid.uuid4().hex[:8]
        fs, at = folder(spark, path)
        fs.mkdirs(at)
        spark.sql(
            f"CREATE TABLE {self.table} (digest BINARY, keep_id {id_type}, batch STRING) USING parquet PARTITIONED BY (batch) "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )
        spark.sql(f"ALTER TABLE {self.table} RECOVER PARTITIONS")

    def read(self, but: str) -> DataFrame:
        """All batches but one; the other one's folder is not read."""
        return self.spark.table(self.table).where(F.col("batch") != but)

    def new(self, groups: DataFrame, batch: str) -> DataFrame:
        """Those groups whose digest no other batch has: a merge anti-join, never a broadcast."""
        return groups.join(self.read(batch).hint("merge"), "digest", "left_anti")

    def append(self, groups: DataFrame, batch: str) -> None:
        """Write the batch's digests, in place of any that it had."""
        if not re.fullmatch(r"[\w.-]+", batch):
            raise ValueError(f"a batch is named by letters, digits, _ . -: {batch!r}")
        rows = groups.select("digest", "keep_id").repartition(self.buckets, "digest")
        self.spark.sql(f"INSERT OVERWRITE TABLE {self.table} PARTITION (batch = '{batch}') SELECT digest, keep_id FROM {{rows}}", rows=rows)

    def close(self) -> None:
        """Forget the table's name; the files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.table}")


def match(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Deduplicate docs within themselves and against the index, then append what is new.

    A batch that is named can be run again and gives the same rows; without a name each call is a
    batch of its own.

    Returns (rows, groups). rows: the id and digest of every input row. groups: one row per digest
    with keep_id (the id in the index, else the smallest id here), group_size (rows here), keep_rows
    (rows here that bear the smallest id) and is_new (false: the index had it already).

    Null texts count as empty, so all null and empty texts are one group; a null id sorts after all
    others; rows repeated with one id form one group and are all marked by that id; an empty input
    gives empty tables and leaves the index as it was; other columns are ignored.
    """
    batch = batch or uuid.uuid4().hex
    rows = stage(docs.select(F.col(id_col).alias("row_id"), digest(F.col(text_col)).alias("digest")), "digests")
    per_id = rows.groupBy("digest", "row_id").agg(F.count("*").alias("n"))
    first = F.min(F.struct(F.col("row_id").isNull().alias("last"), F.col("row_id"), F.col("n")))
    groups = stage(
        per_id.groupBy("digest").agg(first.alias("first"), F.sum("n").alias("group_size")).select("digest", F.col("first.row_id").alias("keep_id"), F.col("first.n").alias("keep_rows"), "group_size"),
        "digest-groups",
    )
    new = stage(index.new(groups, batch), "digest-new")
    known = index.read(batch).select("digest", F.col("keep_id").alias("index_id"), F.lit(False).alias("is_new")).hint("merge")
    decided = stage(
        groups.join(known, "digest", "left").select("digest", F.when(F.col("is_new").isNull(), F.col("keep_id")).otherwise(F.col("index_id")).alias("keep_id"), "keep_rows", "group_size", F.coalesce("is_new", F.lit(True)).alias("is_new")),
        "digest-decided",
    )
    index.append(new, batch)
    free(groups, new)
    return rows, decided


def open_index(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", path: str | None = None, buckets: int = 64) -> DigestIndex:
    return DigestIndex(spark, path or f"{shared_dir(spark)}/digest-index-{uuid.uuid4().hex}", docs.schema[id_col].dataType.simpleString(), buckets)


def drop_copies(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text", batch: str | None = None) -> DataFrame:
    """The rows of docs that stay: of equal texts the row with the smallest id, and none the index had.

    Where several rows repeat both that id and that text, one of them stays. All columns are kept.
    """
    rows, groups = match(docs, index, id_col, text_col, batch)
    free(rows)
    own, first, n = fresh(docs, "digest", "keep_id", "keep_rows")
    keep = groups.where("is_new").select(F.col("digest").alias(own), F.col("keep_id").alias(first), F.col("keep_rows").alias(n))
    found = docs.withColumn(own, digest(F.col(text_col))).join(keep, own).where(F.col(id_col).eqNullSafe(F.col(first)))
    once = found.where(F.col(n) == 1)
    repeated = found.where(F.col(n) > 1).dropDuplicates([own])
    return once.unionByName(repeated).select(*docs.columns)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    index = open_index(spark, docs)
    rows, groups = match(docs, index)
    index.close()
    # Both sides are staged tables, so the join shuffles both and AQE can split a hot digest.
    return rows.join(groups, "digest").select(
        F.col("row_id").cast(T.LongType()).alias("doc_id"),
        "keep_id",
        "group_size",
        F.col("row_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


QUERIES = {"op6_exact_dedup": op6_exact_dedup}

ORACLE_SQL = {
    "op6_exact_dedup": r"""
        WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
        g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
    """
}
