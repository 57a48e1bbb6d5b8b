"""Mixing sources to target weights.

Tokens are summed per source, targets follow from the weights, and every document
is emitted floor(rate) times plus one more copy with probability rate - floor(rate),
drawn from a seeded hash of its id. Documents are never shuffled for that: a source
that holds a third of all rows costs no more than any other.

Defined cases: a null or empty text has size 0; a null source is a source of its own,
last in order; a source of size 0 has target 0; rows that repeat an id draw alike; an
empty table has no rows; other columns stay as they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import broadcast_if_small, fresh
from graphloom.operators.skew import exact_rank
from graphloom.session import configure, stage

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (1, 2, 3)
MOST_COPIES = 3
SEED = "mix-1"
BITS = 52


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def unit_draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the seed and the id only."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))))
    return F.conv(F.substring(digest, 1, BITS // 4), 16, 10).cast("double") / F.lit(2.0 ** BITS)


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS,
                   most: float = MOST_COPIES) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    Sources in code-point order, null last, have the weights in turn. A target is the
    weighted share of all tokens, at most ``most`` times the source; what exceeds that
    is shared anew by weight until no target is above. Each pass is one aggregate of
    two numbers over the sources.
    """
    ordered = exact_rank(
        sizes.withColumn("_last", F.col("source").isNull()), [], ["_last", "source"], "_rank"
    )
    turn = (F.col("_rank") - 1) % len(weights) + 1
    weighted = stage(
        ordered.withColumn("_w", F.element_at(F.array(*map(F.lit, weights)), turn.cast("int")))
        .select("source", "source_size", F.col("_w").cast("double").alias("_w"),
                (F.col("source_size") * most).cast("double").alias("_cap")), "mix-sources")
    total = float(weighted.agg(F.sum("source_size")).first()[0] or 0)
    level = 0.0
    while True:
        over = F.col("_cap") < level * F.col("_w")
        row = weighted.agg(
            F.sum(F.when(over, F.col("_cap")).otherwise(0.0)).alias("capped"),
            F.sum(F.when(over, 0.0).otherwise(F.col("_w"))).alias("free"),
        ).first()
        if not row["free"]:
            break
        raised = (total - row["capped"]) / row["free"]
        if raised <= level:
            break
        level = raised
    return weighted.select(
        "source", "source_size", F.least("_cap", level * F.col("_w")).alias("target")
    )


def with_copies(docs: DataFrame, source: str = "source", text: str = "text",
                doc_id: str = "doc_id", weights: tuple[int, ...] = WEIGHTS,
                most: float = MOST_COPIES, seed: str = SEED, into: str = "_mix") -> DataFrame:
    """``docs`` with one struct ``into``: size, source_size, target, copies."""
    configure(docs.sparkSession)
    of, goal = fresh(docs, "_source"), fresh(docs, "_target")
    size = word_count(F.col(text))
    sizes = docs.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    targets = source_targets(sizes, weights, most).select(
        F.col("source").alias(of), F.struct("source_size", "target").alias(goal)
    )
    total, target = F.col(goal)["source_size"], F.col(goal)["target"]
    rate = F.when(total > 0, target / total).otherwise(0.0)
    whole = F.floor(rate)
    extra = (unit_draw(F.col(doc_id), seed) < rate - whole).cast("bigint")
    joined = docs.join(broadcast_if_small(targets),
                       F.col(source).eqNullSafe(F.col(of)))
    return joined.withColumn(into, F.struct(
        size.alias("size"), total.alias("source_size"), target.alias("target"),
        (whole + extra).alias("copies"))).drop(of, goal)


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed corpus: every document as often as its source's rate says."""
    into, copy = fresh(docs, "_mix"), fresh(docs, "_copy")
    copies = F.array_repeat(F.lit(True), F.col(into)["copies"].cast("int"))
    return (with_copies(docs, into=into, **options).withColumn(copy, F.explode(copies))
            .drop(copy, into))
