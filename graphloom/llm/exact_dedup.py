"""Exact deduplication against a persistent digest index.

Two texts are equal when they are identical without the characters
``[\\x20\\x09-\\x0D]``. The index is a Parquet table of one row per digest, bucketed
and sorted by the digest. A batch is grouped by digest (partial aggregation before
the shuffle, so a digest shared by a third of all rows sends one row per task),
sort-merge anti-joined with the index, and the new digests are appended.

Defined cases: a null text counts as empty, and all empty texts are one group; of
equal texts the one with the most code points, then the smallest id stays; rows that
repeat an id with an equal text share its fate; an empty batch adds nothing; other
columns are ignored, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import pick
from graphloom.session import checkpoint_dir, configure

WHITESPACE = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    out = F.coalesce(text, F.lit(""))
    for c in WHITESPACE:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text as 32 bytes."""
    return F.unhex(F.sha2(normalised(text), 256))


class DigestIndex:
    """An index of digests in the folder ``path``, which later sessions can open again.

    Every digest has the id that was kept and the number of rows of the batch that
    brought it. Appending writes one more sorted file per bucket; ``compact`` is not
    needed for right results.
    """

    COLUMNS = "digest binary, keep_id bigint, group_size bigint"

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        configure(spark)
        self.spark = spark
        self.path = path
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.table = f"digest_index_{uuid.uuid4().hex}"
        spark.sql(
            f"CREATE TABLE {self.table} ({self.COLUMNS}) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS "
            f"LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        """The index, read by bucket: joins on the digest do not shuffle it."""
        return self.spark.table(self.table)

    def add(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """Append the digests that are new; returns doc_id, digest and chars of the batch."""
        batch = pick(docs, [doc_id, text]).select(
            F.col(doc_id).alias("doc_id"), text_digest(F.col(text)).alias("digest"),
            F.length(F.coalesce(F.col(text), F.lit(""))).alias("chars"),
        )
        # Both aggregates have buffers of fixed width, so Spark hashes and combines them.
        by_length = batch.groupBy("digest", "chars").agg(
            F.min("doc_id").alias("doc_id"), F.count(F.lit(1)).alias("n")
        )
        groups = by_length.groupBy("digest").agg(
            F.max_by("doc_id", "chars").alias("keep_id"), F.sum("n").alias("group_size")
        )
        fresh = groups.join(self.rows().hint("merge"), "digest", "left_anti")
        (fresh.repartition(self.buckets, "digest").sortWithinPartitions("digest")
         .select("digest", "keep_id", "group_size").write.insertInto(self.table))
        return batch

    def decide(self, batch: DataFrame) -> DataFrame:
        """Every row of a batch with the id that stays for its text.

        The index is read as plain files here: with an exchange on both sides AQE
        splits the partition of a digest that very many rows share.
        """
        index = self.spark.read.schema(self.COLUMNS).parquet(self.path)
        return batch.join(index, "digest").select(
            "doc_id", "keep_id", "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
            F.lower(F.hex("digest")).alias("text_sha256"),
        )


def exact_dedup(docs: DataFrame, index: DigestIndex | None = None, doc_id: str = "doc_id",
                text: str = "text") -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Without an index a fresh one is made in the shared folder.
    """
    spark = docs.sparkSession
    if index is None:
        folder = checkpoint_dir(spark).rstrip("/")
        index = DigestIndex(spark, f"{folder}/digests-{uuid.uuid4().hex}")
    return index.decide(index.add(docs, doc_id, text))
