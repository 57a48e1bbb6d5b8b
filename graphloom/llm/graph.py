"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import broadcast_if_small
from graphloom.session import stage


#: Links that one task takes; the tables of a turn are small next to the corpus.
TASK_LINKS = 100_000


def components(links: DataFrame) -> DataFrame:
    """(a, b) links to (node, component): the smallest node each one reaches.

    Large and small stars in turn: every node hands its larger neighbours, then its
    smaller ones, to its smallest neighbour. The links stay about as many and form
    stars after O(log n) turns. Minima are combined in the tasks, and a hub's links are
    joined with its minimum by a broadcast while minima are few, else by a join with an
    exchange on both sides, which AQE splits. Every turn is written to the shared folder,
    in as many files as ``TASK_LINKS`` asks for.
    """
    def ordered(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter(
            "u != v").distinct()

    def state(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    current = stage(ordered(links), "links")
    before = state(current)
    while before[0]:
        tasks = 1 + before[0] // TASK_LINKS

        def kept(df: DataFrame, name: str) -> DataFrame:
            return stage(df.coalesce(tasks), name)

        both = current.union(current.select("v", "u").toDF("u", "v"))
        least = kept(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "minima")
        large = both.join(broadcast_if_small(least, row_bytes=32), "u").filter("v > u").select(
            F.col("v").alias("u"), F.col("m").alias("v"))
        large = kept(large.distinct(), "large-stars")
        least = kept(large.groupBy("u").agg(F.min("v").alias("m")), "minima")
        small = large.join(broadcast_if_small(least, row_bytes=32), "u")
        current = kept(ordered(
            small.select(F.col("v").alias("a"), F.col("m").alias("b")).union(
                small.select(F.col("u").alias("a"), F.col("m").alias("b")))), "links")
        after = state(current)
        if after == before:
            break
        before = after
    return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
        current.select("v").distinct().select(F.col("v").alias("node"), F.col("v")))
