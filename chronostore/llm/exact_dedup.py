"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest, with a row for each
digest of each batch that was added. A batch of documents is reduced to one
candidate row for each digest (map-side partial aggregation, so a digest that a
third of all rows share costs one row a task), the candidates that the index
lacks are found by a sort-merge anti-join on the bucketed side, and the batch's
rows are appended. Texts themselves are never shuffled.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, new_path, stored, text_of

# The characters that equality ignores.
IGNORED = r"[\x20\x09-\x0D]+"
#: Digests in a bucket, about, and the least number of buckets.
BUCKET_DIGESTS, LEAST_BUCKETS = 2_000_000, 32


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, SHA-256 of the text without white space, code points of the text as it was."""
    return docs.select(
        F.col("doc_id"),
        F.sha2(F.regexp_replace(text_of(), IGNORED, ""), 256).alias("digest"),
        F.length(text_of()).cast("long").alias("chars"),
    )


def buckets_for(documents: int) -> int:
    """Buckets that hold so many digests, at a bounded size each."""
    return max(LEAST_BUCKETS, -(-documents // BUCKET_DIGESTS))


class DigestIndex:
    """Digests seen so far, in a folder; opening the same folder again continues it, with the buckets it has.

    ``buckets`` counts for a new folder; choose it by ``buckets_for`` of what
    the index will come to hold, or move a grown index with ``rebuilt``.
    """

    COLUMNS = ("digest", "keep_id", "size", "first", "batch")

    def __init__(self, spark: SparkSession, path: str, buckets: int = LEAST_BUCKETS):
        self.spark, self.path = spark, path
        self.name = "digest_index_" + hashlib.md5(path.encode()).hexdigest()
        meta = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_buckets")  # a name that reads of the table pass over
        if meta.getFileSystem(spark._jsc.hadoopConfiguration()).exists(meta):
            self.buckets = spark.read.parquet(f"{path}/_buckets").first()["buckets"]
        else:
            self.buckets = buckets
            spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{path}/_buckets")
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.name} (digest STRING, keep_id BIGINT, size BIGINT, first BOOLEAN, batch STRING) "
            f"USING parquet CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{path}'"
        )

    def table(self) -> DataFrame:
        """digest, keep_id, size, first, batch: rows of each batch; ``first`` marks the batch that a digest came with."""
        return self.spark.table(self.name)

    def held(self) -> DataFrame:
        """digest, held_id, held: the document that stays and the rows counted, one row for each digest; no shuffle."""
        return self.table().groupBy("digest").agg(F.max(F.when(F.col("first"), F.struct("keep_id"))).alias("f"), F.sum("size").alias("held")).select("digest", F.col("f.keep_id").alias("held_id"), "held")

    def _append(self, rows: DataFrame) -> None:
        rows.select(*self.COLUMNS).repartition(self.buckets, "digest").sortWithinPartitions("digest").write.insertInto(self.name)

    def drop(self) -> None:
        """Take the table out of the session's catalog; the folder stays and can be opened again."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def rebuilt(self, path: str, buckets: int) -> DigestIndex:
        """The same index in another folder, with another number of buckets."""
        other = DigestIndex(self.spark, path, buckets)
        other._append(self.table())
        return other

    def add(self, docs: DataFrame, batch: str | None = None) -> DataFrame:
        """Append the digests of ``docs``; return a decision for each row.

        Columns: doc_id, keep_id, group_size, kept, text_sha256. Of equal texts
        the longest original stays, then the smallest doc_id; a digest that the
        index already had keeps its earlier document. group_size counts rows of
        this batch and all others. ``batch`` names it: one that the index has
        already is not counted again, so a batch may be tried again under its
        name; without a name it is always a new one. Null texts equal empty
        ones. Rows with a null doc_id count in their group and stay only where
        no other row does. Repeated rows share one decision. Columns beside
        doc_id and text are not read, whatever their names; of a very long text
        only the digest is kept. An empty batch gives no rows.
        """
        batch = batch or uuid.uuid4().hex
        rows = stored(digests(docs), "digests")
        if self.table().where(F.col("batch") == batch).isEmpty():
            groups = rows.groupBy("digest").agg(
                F.min(F.struct((-F.col("chars")).alias("chars"), F.col("doc_id").isNull().alias("unknown"), "doc_id")).alias("best"),
                F.count("*").alias("size"),
            )
            groups = stored(groups.select("digest", F.col("best.doc_id").alias("keep_id"), "size"), "digest-groups")
            fresh = groups.join(self.table().hint("merge"), "digest", "left_anti").withColumn("first", F.lit(True))
            again = groups.join(self.held().hint("merge"), "digest").select("digest", F.col("held_id").alias("keep_id"), "size", F.lit(False).alias("first"), "held")
            done = stored(fresh.withColumn("held", F.lit(0).cast("bigint")).unionByName(again).withColumn("batch", F.lit(batch)), "digests-decided")
            self._append(done)
            known = done.select("digest", "keep_id", (F.col("size") + F.col("held")).alias("group_size"))
        else:
            wanted = rows.select("digest").distinct()
            known = stored(self.held().hint("merge").join(wanted, "digest").select("digest", F.col("held_id").alias("keep_id"), F.col("held").alias("group_size")), "digests-decided")
        # Both sides are plain files, so both are shuffled and AQE can split a digest that many rows share.
        return rows.join(known, "digest").select(
            "doc_id",
            "keep_id",
            "group_size",
            F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
            F.col("digest").alias("text_sha256"),
        )


def op10_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    index = DigestIndex(spark, new_path(spark, "digest-index"), buckets_for(docs.count()))
    out = index.add(docs)
    index.drop()
    return out


ORACLE_SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text,
         regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
  FROM documents
), g AS (
  SELECT norm, count(*) AS group_size, first(doc_id ORDER BY length(text) DESC, doc_id) AS keep_id
  FROM t GROUP BY norm
)
SELECT t.doc_id, g.keep_id, g.group_size, t.doc_id = g.keep_id AS kept, sha256(t.norm) AS text_sha256
FROM t JOIN g ON t.norm = g.norm
"""
