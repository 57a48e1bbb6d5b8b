"""Merging, de-duplication and pruning.

Facts and evidence are separated here. Grouping keeps only constant-size state
per key (first, best, count), so Spark combines on the map side and a key that
holds a third of all rows is reduced before the shuffle; its evidence stays in
rows of its own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import schema as s
from graphloom.functions import text as t
from graphloom.operators.skew import skewed_join
from graphloom.session import stage


def _n_prov(df: DataFrame) -> Column:
    """Evidence count of a row: stored for facts, 0 or 1 for candidates."""
    if "n_prov" in df.columns:
        return F.sum("n_prov")
    return F.count("prov.source")


def merge_edges(edges: DataFrame) -> DataFrame:
    """One row per (from_id, type, to_id).

    Label and weight come from the first edge, confidence is the maximum, and
    ``derived_by`` belongs to the first edge that reached it. Works on candidates and
    on merged edges alike: ``best_ord`` keeps the place of the best edge, so parts may
    be merged in any order and grouping.
    """
    o = F.col("ord")
    at = F.coalesce("best_ord", "ord") if "best_ord" in edges.columns else o
    # Structs are compared field by field: the smallest one holds the order it was chosen by, which
    # ``min_by`` would keep, sort and shuffle once more.
    merged = edges.groupBy(*s.EDGE_KEY).agg(
        F.min(F.when(o.isNotNull(), F.struct(o.alias("ord"), "label", "weight"))).alias("first"),
        F.max("confidence").alias("confidence"),
        F.min(F.struct((-F.col("confidence")).alias("c"), at.alias("at"), "derived_by")).alias("best"),
        _n_prov(edges).alias("n_prov"),
    )
    return merged.select(
        "from_id", "to_id", "type", F.col("first.label").alias("label"),
        F.col("first.weight").alias("weight"), "confidence",
        F.col("best.derived_by").alias("derived_by"), "n_prov", F.col("first.ord").alias("ord"),
        F.col("best.at").alias("best_ord"),
    )


def edge_evidence(candidates: DataFrame) -> DataFrame:
    """The provenance of edge candidates, one row per entry."""
    cited = candidates.filter(F.col("prov.source").isNotNull())
    return cited.select(*s.EDGE_KEY, "ord", "prov.*")


def node_evidence(candidates: DataFrame) -> DataFrame:
    """The provenance of node candidates, one row per entry."""
    cited = candidates.filter(F.col("prov.source").isNotNull())
    return cited.select("id", "ord", "prov.*")


def dedupe_nodes(nodes: DataFrame) -> DataFrame:
    """One row per id, the first one, with ``duplicates`` = rows merged into it."""
    kept = [c for c in s.NODES.fieldNames() if c not in ("id", "n_prov")]
    first = nodes.groupBy("id").agg(
        F.min_by(F.struct(*kept), "ord").alias("first"),
        _n_prov(nodes).alias("n_prov"),
        (F.count(F.lit(1)) - 1).alias("duplicates"),
    )
    columns = [F.col(f"first.{c}").alias(c) if c in kept else F.col(c)
               for c in s.NODES.fieldNames()]
    return first.select(*columns, "duplicates")


def drop_dangling_edges(edges: DataFrame, nodes: DataFrame, salts: int | None = None) -> DataFrame:
    """Edges whose both ends exist. ``nodes`` must be unique by id.

    Both sides are written once: the joins would otherwise be pushed into every branch
    of a union of edges, and repeat the lineage of the nodes in each of them.
    """
    ids, edges = stage(nodes.select("id"), "ids"), stage(edges, "edges")
    for end in ("from_id", "to_id"):
        edges = skewed_join(edges, ids.withColumnRenamed("id", end), end, "left_semi",
                            salts, s.EDGE_KEY)
    return edges.select(*[c for c in s.EDGES.fieldNames() if c in edges.columns])


def endpoints(edges: DataFrame) -> DataFrame:
    """The distinct ids that edges touch."""
    return edges.select(F.explode(F.array("from_id", "to_id")).alias("id")).distinct()


def from_api_spec(evidence: DataFrame, source: str = "swagger.json") -> DataFrame:
    """Distinct ids with evidence in the API description."""
    return evidence.filter(F.col("source") == source).select("id").distinct()


def drop_orphans(nodes: DataFrame, edges: DataFrame, evidence: DataFrame,
                 min_body: int = 40) -> DataFrame:
    """Keep nodes that are connected or substantial.

    Substantial means a body of more than ``min_body`` characters, type-specific
    metadata, or evidence in the API description.
    """
    linked = endpoints(edges).withColumn("_linked", F.lit(True))
    specified = from_api_spec(evidence).withColumn("_spec", F.lit(True))
    keep = (
        F.col("_linked").isNotNull() | F.col("_spec").isNotNull()
        | (F.length("body") > min_body) | F.col("meta").isNotNull()
    )
    joined = nodes.join(linked, "id", "left").join(specified, "id", "left")
    return joined.filter(keep).select(*nodes.columns)


def compress_bodies(nodes: DataFrame, limit: int = 4000) -> DataFrame:
    """Trim long bodies that were not trimmed before, and mark them."""
    long = ~F.col("body_trimmed") & (F.length("body") > limit)
    return nodes.withColumns({
        "body": F.when(long, t.trim_body(F.col("body"), limit)).otherwise(F.col("body")),
        "body_trimmed": F.col("body_trimmed") | F.coalesce(long, F.lit(False)),
    })


def unique_docs(docs: DataFrame, key: str, text_hash: Column) -> DataFrame:
    """One row per content hash: the smallest key and the number of copies."""
    hashed = docs.select(F.col(key), text_hash.alias("content_hash"))
    return hashed.groupBy("content_hash").agg(
        F.min(key).alias(key), F.count(F.lit(1)).alias("copies"))
