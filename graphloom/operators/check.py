"""Validation, coverage and version differences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema as s
from graphloom.functions.text import row_hash
from graphloom.operators.skew import skewed_join, top_per_group
from graphloom.session import checkpoint


def _edge_key() -> Column:
    return F.concat_ws("|", "from_id", "type", "to_id")


def validate(nodes: DataFrame, edges: DataFrame, salts: int | None = None) -> DataFrame:
    """Violations as rows (rule, item, occurrences); empty when the graph is valid."""
    one = F.lit(1).cast("bigint").alias("occurrences")

    def flat(df: DataFrame, rule: str, item: Column) -> DataFrame:
        return df.select(F.lit(rule).alias("rule"), item.alias("item"), one)

    missing = nodes.filter(F.col("id").isNull() | F.col("type").isNull())
    repeated = nodes.filter(F.col("id").isNotNull()).groupBy("id").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)
    # A missing confidence is not in range either.
    in_range = F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))
    parts = [
        flat(missing, "missing_id_or_type", F.coalesce("id", F.lit(""))),
        repeated.select(F.lit("duplicate_node").alias("rule"), F.col("id").alias("item"),
                        (F.col("n") - 1).alias("occurrences")),
        flat(nodes.filter(~in_range), "node_confidence", F.col("id")),
        flat(edges.filter(~in_range), "edge_confidence", _edge_key()),
    ]
    ids = nodes.select("id").distinct()
    for end, rule in (("from_id", "edge_from_unknown"), ("to_id", "edge_to_unknown")):
        unknown = skewed_join(edges.select(*s.EDGE_KEY), ids.withColumnRenamed("id", end), end,
                              "left_anti", salts, s.EDGE_KEY)
        parts.append(flat(unknown, rule, _edge_key()))
    violations = parts[0]
    for part in parts[1:]:
        violations = violations.unionByName(part)
    return violations


def provenance_coverage(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(item, total, without): facts and how many of them carry no evidence."""
    def row(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.lit(name).alias("item"), F.count(F.lit(1)).alias("total"),
                      F.count_if(F.coalesce("n_prov", F.lit(0)) == 0).alias("without"))

    return row(nodes, "nodes").unionByName(row(edges, "edges"))


def without_provenance(facts: DataFrame) -> DataFrame:
    return facts.filter(F.coalesce("n_prov", F.lit(0)) == 0)


def diff(old: DataFrame, new: DataFrame, keys: Sequence[str] = ("id",),
         compare: Sequence[str] = ()) -> DataFrame:
    """Changes between two versions of a fact table: (keys, status).

    Status is ``added`` or ``removed``, and ``changed`` when ``compare`` names
    columns whose values differ. Both sides are unique by key, so the full outer
    join has no hot key; only the keys and one hash per row are shuffled.
    """
    digest = row_hash(*compare) if compare else F.lit("")
    a = old.select(*keys, digest.alias("_old"))
    b = new.select(*keys, digest.alias("_new"))
    status = (
        F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed")
        .when(F.col("_old") != F.col("_new"), "changed"))
    joined = a.join(b, list(keys), "full_outer").select(*keys, status.alias("status"))
    return joined.filter(F.col("status").isNotNull())


#: Buckets of all folders together: their sums, a few bytes each, may be broadcast.
MOST_BUCKETS = 1 << 20


def write_digests(facts: DataFrame, path: str, keys: Sequence[str] = ("id",),
                  compare: Sequence[str] = (), folders: int = 64, buckets: int = 4096) -> None:
    """A version of a fact table as row digests, for :func:`diff_digests`.

    ``rows`` holds (keys, digest), in ``folders`` by a hash of the keys, each in the order
    of its ``buckets``; ``sums`` holds the number and the sums of the digests of every
    bucket. Facts are unique by key. Versions are comparable when they were written with
    the same arguments.
    """
    if folders * buckets > MOST_BUCKETS:
        raise ValueError(f"at most {MOST_BUCKETS} buckets in all folders")
    place = F.pmod(F.xxhash64(*keys), F.lit(folders * buckets))
    rows = facts.select(
        *keys, (row_hash(*compare) if compare else F.lit("")).alias("_digest"),
        F.floor(place / buckets).cast("int").alias("_folder"),
        F.pmod(place, F.lit(buckets)).cast("int").alias("_bucket"))
    rows.repartitionByRange("_folder", "_bucket").sortWithinPartitions(
        "_folder", "_bucket").write.mode("overwrite").partitionBy("_folder").parquet(f"{path}/rows")
    # An empty version has no files to tell its columns.
    rows.limit(0).write.mode("overwrite").parquet(f"{path}/layout")
    # Read again, so that the sums are those of the rows that were written.
    stored = facts.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")

    def total(seed: int) -> Column:
        return F.sum(F.xxhash64(F.lit(seed), *keys, "_digest").cast("decimal(38,0)"))

    stored.groupBy("_folder", "_bucket").agg(
        F.count(F.lit(1)).alias("n"), total(1).alias("a"), total(2).alias("b"),
    ).write.mode("overwrite").parquet(f"{path}/sums")


def differing_buckets(spark: SparkSession, old_path: str, new_path: str) -> DataFrame:
    """(_folder, _bucket) whose rows are not the same in both versions."""
    place = ["_folder", "_bucket"]
    old, new = (spark.read.parquet(f"{path}/sums").select(
        *place, F.struct("n", "a", "b").alias(name))
        for path, name in ((old_path, "_old"), (new_path, "_new")))
    return old.join(new, place, "full_outer").filter(
        ~F.col("_old").eqNullSafe(F.col("_new"))).select(*place)


def rows_to_compare(spark: SparkSession, path: str, differing: DataFrame) -> DataFrame:
    """The rows of one version that lie in differing buckets; other folders are not read."""
    folders = [r["_folder"] for r in differing.select("_folder").distinct().collect()]
    layout = spark.read.parquet(f"{path}/layout").schema
    rows = spark.read.schema(layout).parquet(f"{path}/rows").filter(
        F.col("_folder").isin(folders))
    # At most MOST_BUCKETS pairs of integers.
    return rows.join(F.broadcast(differing), ["_folder", "_bucket"], "left_semi")


def diff_digests(spark: SparkSession, old_path: str, new_path: str,
                 keys: Sequence[str] = ("id",)) -> DataFrame:
    """:func:`diff` of two versions written by :func:`write_digests`.

    Sums are compared first. Only folders with a differing bucket are read, and only the
    rows of differing buckets are shuffled, so the cost follows the changes once these are
    fewer than the buckets.
    """
    differing = checkpoint(differing_buckets(spark, old_path, new_path))
    old, new = (rows_to_compare(spark, path, differing) for path in (old_path, new_path))
    return diff(old, new, keys, ["_digest"])


def diff_report(old: DataFrame, new: DataFrame, changes: DataFrame, n: int = 40) -> DataFrame:
    """The first ``n`` added and removed nodes: (status, id, type, title)."""
    listed = changes.filter(F.col("status").isin("added", "removed"))
    first = top_per_group(listed, ["status"], [F.asc("id")], n)
    details = new.select("id", "type", "title", F.lit("added").alias("status")).unionByName(
        old.select("id", "type", "title", F.lit("removed").alias("status")))
    return details.join(first, ["id", "status"]).select("status", "rank", "id", "type", "title")


def diff_counts(old: DataFrame, new: DataFrame, changes: DataFrame) -> DataFrame:
    """One row: sizes of both versions and the number of changes of each kind."""
    key = F.lit(1).alias("_one")
    a = old.agg(F.count(F.lit(1)).alias("old_rows"), key)
    b = new.agg(F.count(F.lit(1)).alias("new_rows"), key)
    c = changes.agg(*[F.count_if(F.col("status") == k).alias(k)
                      for k in ("added", "removed", "changed")], key)
    return a.join(b, "_one").join(c, "_one").drop("_one")


def version_edges(old: DataFrame, new: DataFrame, old_version: str,
                  new_version: str) -> DataFrame:
    """``version_of`` candidates: the same node in two versions."""
    both = old.select("id").join(new.select("id"), "id")
    tag = F.concat(F.col("id"), F.lit("@"))
    return s.edge_candidates(
        both,
        from_id=F.concat(tag, F.lit(old_version)), to_id=F.concat(tag, F.lit(new_version)),
        type=F.lit("version_of"),
        label=F.lit(f"{old_version} -> {new_version}"),
        prov=s.provenance(F.col("id")),
        ord=s.ordinal(s.PHASE_MODEL, "id"),
    )
