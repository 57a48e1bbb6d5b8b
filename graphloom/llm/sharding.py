"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; sorted by the
fractional rank (rank - 1/2) / rows of the source, sources interleave in proportion,
and cutting that order into equal pieces gives every shard the mixture. The law is
``rows``: shard sizes are at most one row apart.

Ranks are counted over range-partitioned pieces, so a source with a third of all rows
spans many tasks. Only (id, content hash) pairs are ranked; texts move once, to meet
their place.

Defined cases: a null source is a source of its own; null ids and texts are ordinary
values; rows repeated in full each get a place of their own; an empty table gives no
rows; columns with the names of the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import fresh
from graphloom.operators.skew import exact_rank
from graphloom.session import configure, stage

SHARDS = 8
SEED = 20
SALTS = 32


def places(rows: DataFrame, shards: int = SHARDS, seed: int = SEED) -> DataFrame:
    """(id, source, content) to the same rows with shard and slot.

    ``content`` is any value that settles ties of ids. Rows that agree in all three
    are interchangeable.
    """
    rows = stage(rows.select("id", "source", "content").withColumn(
        "draw", F.xxhash64(F.lit(seed), "id", "content")), "shard-rows")
    ranked = exact_rank(rows, ["source"], ["draw", "id", "content"], "rank")
    counts = (rows.groupBy("source", F.pmod("draw", F.lit(SALTS)).alias("part")).count()
              .groupBy("source").agg(F.sum("count").alias("n"))
              .withColumnRenamed("source", "same_source"))
    share = (F.col("rank") - 0.5) / F.col("n")
    spread = ranked.join(counts, F.col("source").eqNullSafe(F.col("same_source"))).select(
        "id", "source", "content", "draw", share.alias("share"))
    placed = exact_rank(spread, [], ["share", "draw", "id", "content"], "place")
    total = rows.count()
    # Integer arithmetic throughout: (place - 1) * shards is exact in a bigint.
    shard = F.expr(f"((place - 1) * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (placed.withColumn("shard", shard).withColumn("slot", F.col("place") - 1 - first)
            .select("id", "source", "content", F.col("shard").cast("int").alias("shard"),
                    F.col("slot").cast("bigint").alias("slot")))


def content_hash(columns: list[str]) -> Column:
    """64 bits of all the columns; the flags tell null from left out."""
    flags = F.concat(*[F.col(f"`{c}`").isNull().cast("string") for c in columns])
    return F.xxhash64(*[F.col(f"`{c}`") for c in columns], flags)


def shard(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, doc_id: str = "doc_id",
          source: str = "source") -> DataFrame:
    """``docs`` with the columns shard and slot.

    Equal rows are merged and meet as many places as they had copies, so the texts are
    shuffled once and identical rows are interchangeable. Rows with different ids never
    merge, whatever their hashes.
    """
    configure(docs.sparkSession)
    docs = docs.drop("shard", "slot")
    columns = docs.columns
    key, content = fresh(docs, "_key"), fresh(docs, "_hash")
    hashed = docs.withColumn(content, content_hash(columns)).withColumn(
        key, F.coalesce(F.col(doc_id).cast("string"), F.lit("null")))
    where = places(
        hashed.select(F.col(key).alias("id"), F.col(source).alias("source"),
                      F.col(content).alias("content")), shards, seed)
    where = where.select(F.col("id").alias(key), F.col("content").alias(content),
                         "shard", "slot")
    distinct = hashed.groupBy(key, content).agg(
        *[F.first(F.col(f"`{c}`")).alias(c) for c in columns])
    return distinct.join(where, [key, content]).select(
        *[F.col(f"`{c}`") for c in columns], "shard", "slot")
