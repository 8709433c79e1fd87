"""Exact dedup against a persistent digest index. DataFrame and SQL functions only."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelake.llm.common import shared_folder, stored, unused, width
from sitelake.session import read_shared, write_shared


class DigestIndex:
    """A table (digest, keep_id) of every text seen, bucketed and sorted by digest, in a folder that outlives the session.

    Batches meet it in a sort-merge join: the batch is shuffled to the buckets, the index is not shuffled. The number of buckets is written beside
    the data when the index is made, and every later session reads it there: asking for another number is an error. A batch
    that failed and is run again finds its own digests and adds none twice. Batches are registered one at a time.
    The table's name lasts until ``close``; the folder stays.
    """

    def __init__(self, spark: SparkSession, location: str, buckets: int | None = None):
        note = f"{location.rstrip('/')}/_buckets"
        held = read_shared(spark, note)
        if held is None:
            write_shared(spark, note, str(buckets or width(spark)))
            held = read_shared(spark, note)
        if buckets is not None and buckets != int(held):
            raise ValueError(f"the digest index in {location} has {held} buckets, not {buckets}")
        self.spark, self.name, self.buckets = spark, f"digest_index_{uuid.uuid4().hex}", int(held)
        spark.sql(f"create table {self.name} (digest binary, keep_id bigint) using parquet "
                  f"clustered by (digest) sorted by (digest) into {self.buckets} buckets location '{location}'")

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def register(self, groups: DataFrame) -> DataFrame:
        """Append the digests of ``groups`` (digest, last_id, ...) that are new; returns ``groups`` with the index's keep_id, written once."""
        fresh = groups.hint("merge").join(self.rows(), "digest", "left_anti").select("digest", F.col("last_id").alias("keep_id"))
        fresh.repartition(self.buckets, "digest").write.insertInto(self.name)
        self.spark.catalog.refreshTable(self.name)
        return stored(groups.hint("merge").join(self.rows(), "digest"), "digest-resolved")

    def close(self) -> None:
        self.spark.sql(f"drop table if exists {self.name}")


def digest_of(text_col: str) -> Column:
    return F.unhex(F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))


def _flagged(docs: DataFrame, index: DigestIndex, id_col: str, text_col: str) -> DataFrame:
    """doc_id, digest, keep_id, group_size, kept, and last_rows: how many rows of the group have its largest id."""
    rows = stored(docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("bigint").alias("doc_id"), digest_of(text_col).alias("digest")), "digest-rows")
    same = rows.groupBy("digest", "doc_id").agg(F.max("row").alias("last_row"), F.count("*").alias("n"))
    last = F.max(F.struct("doc_id", "last_row", "n"))
    groups = same.groupBy("digest").agg(last.alias("last"), F.sum("n").alias("group_size"))
    resolved = index.register(stored(groups.select("digest", F.col("last.doc_id").alias("last_id"), "last.last_row", F.col("last.n").alias("last_rows"), "group_size"), "digest-groups"))
    return rows.join(resolved, "digest").select("doc_id", "digest", "keep_id", "group_size", F.expr("keep_id <=> last_id and row = last_row").alias("kept"), "last_rows")


def dedup(docs: DataFrame, index: DigestIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical, to the letter; null counts as empty. Of a batch's equal texts the row with the
    largest id stays, unless the index holds the text from an earlier batch: then that batch's row stays and
    all rows of this one go. group_size counts the rows of this batch. Rows equal in id and text: one of them stays.
    Null ids are smaller than all others. An empty table gives no rows. Other columns are ignored.

    Only ids and digests are shuffled. Counts and the row that stays come from aggregates that each task begins, and what follows is one
    plain join of the rows with their groups (one row per digest), so a hot text is a skewed join that the session may split.
    """
    return _flagged(docs, index, id_col, text_col).select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("digest")).alias("text_sha256"))


def dedup_once(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``dedup`` against a new index in the shared folder."""
    index = DigestIndex(docs.sparkSession, shared_folder(docs.sparkSession, "digest-index"))
    try:
        return dedup(docs, index, id_col, text_col)
    finally:
        index.close()


def kept_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns. Texts are shuffled by id and digest, never by digest alone, and rows equal in both
    are cut to one by an aggregate that each task begins; only where such rows occur is there such an aggregate."""
    key, digest = unused("dedup_key", docs), unused("dedup_digest", docs)
    index = DigestIndex(docs.sparkSession, shared_folder(docs.sparkSession, "digest-index"))
    try:
        flagged = _flagged(docs, index, id_col, text_col)
    finally:
        index.close()
    id_key = lambda c: F.coalesce(F.col(c).cast("bigint"), F.lit(-(2**63)))
    kept = stored(flagged.where("kept").select(F.col("digest").alias(digest), id_key("doc_id").alias(key), "last_rows"), "digest-kept")
    keyed = docs.withColumn(digest, digest_of(text_col)).withColumn(key, id_key(id_col))
    out = keyed.join(kept.where("last_rows = 1"), [digest, key], "left_semi")
    again = kept.where("last_rows > 1")
    if not again.isEmpty():
        out = out.unionByName(keyed.join(again, [digest, key], "left_semi").dropDuplicates([digest, key]))
    return out.select(*docs.columns)


SQL = """
select doc_id, max(doc_id) over (partition by coalesce(text, '')) as keep_id, count(*) over (partition by coalesce(text, '')) as group_size,
  doc_id = max(doc_id) over (partition by coalesce(text, '')) as kept, sha256(coalesce(text, '')) as text_sha256 from documents
"""
