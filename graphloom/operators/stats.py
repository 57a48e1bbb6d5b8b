"""Graph statistics. All are hash aggregations with map-side combine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import schema as s


def node_type_counts(nodes: DataFrame) -> DataFrame:
    """(type, n) for the types that occur."""
    return nodes.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def node_type_counts_wide(nodes: DataFrame) -> DataFrame:
    """One row with a column per declared node type."""
    return nodes.agg(*[
        F.count_if(F.col("type") == t).alias(c) for t, c in s.COUNT_COLUMNS.items()])


def edge_type_counts(edges: DataFrame) -> DataFrame:
    """(type, n) for the types that occur."""
    return edges.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def _edge_type_map() -> Column:
    pairs = []
    for t in s.EDGE_TYPES:
        pairs += [F.lit(t), F.count_if(F.col("type") == t)]
    return F.map_filter(F.create_map(*pairs), lambda _, n: n > 0)


def density(nodes: Column, edges: Column) -> Column:
    pairs = nodes.cast("double") * (nodes - 1).cast("double")
    return F.when(nodes > 1, edges.cast("double") / pairs).otherwise(F.lit(0.0))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The statistics row: counts per type, edge-type map and density.

    ``duplicate_removed`` comes from the ``duplicates`` column of a de-duplicated
    node table, if it is there.
    """
    merged = F.coalesce(F.sum("duplicates"), F.lit(0)) if "duplicates" in nodes.columns \
        else F.lit(0).cast("bigint")
    per_node = nodes.agg(
        *[F.count_if(F.col("type") == t).alias(c) for t, c in s.COUNT_COLUMNS.items()],
        F.count(F.lit(1)).alias("nodes"), merged.alias("duplicate_removed"),
    )
    per_edge = edges.agg(F.count(F.lit(1)).alias("edges"), _edge_type_map().alias("edge_types"))
    # Two one-row aggregates side by side.
    both = per_node.withColumn("_one", F.lit(1)).join(
        per_edge.withColumn("_one", F.lit(1)), "_one").drop("_one")
    return both.withColumn("graph_density", density(F.col("nodes"), F.col("edges")))


def is_model_derived() -> Column:
    return F.startswith(F.col("derived_by"), F.lit("ai:"))


def ai_count(nodes: DataFrame) -> DataFrame:
    """One row: how many nodes a model wrote."""
    return nodes.agg(F.count_if(is_model_derived()).alias("ai_nodes"))


def row_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(item, n): the sizes of the two fact tables."""
    return nodes.agg(F.lit("nodes").alias("item"), F.count(F.lit(1)).alias("n")).unionByName(
        edges.agg(F.lit("edges").alias("item"), F.count(F.lit(1)).alias("n")))


def degree_counts(edges: DataFrame, edge_type: str = "prerequisite_of") -> DataFrame:
    """(id, prerequisites, unlocks): in- and out-degree over one edge type."""
    typed = edges.filter(F.col("type") == edge_type)
    ends = typed.select(F.inline(F.array(
        F.struct(F.col("to_id").alias("id"), F.lit(1).alias("is_in")),
        F.struct(F.col("from_id").alias("id"), F.lit(0).alias("is_in")))))
    return ends.groupBy("id").agg(
        F.sum("is_in").cast("bigint").alias("prerequisites"),
        F.sum(1 - F.col("is_in")).cast("bigint").alias("unlocks"))


def api_group(meta_group: Column) -> Column:
    return F.when(F.coalesce(meta_group, F.lit("")) == "", F.lit("core")).otherwise(meta_group)


def api_groups(nodes: DataFrame) -> DataFrame:
    """(api_group, objects) over the API objects."""
    objects = nodes.filter(F.col("type") == "api_object")
    return objects.groupBy(api_group(F.col("meta.group")).alias("api_group")).agg(
        F.count(F.lit(1)).alias("objects"))


def corpus_summary(nodes: DataFrame, edges: DataFrame, version: str) -> DataFrame:
    """One row: version, node, edge and model-written node counts."""
    left = nodes.agg(F.lit(version).alias("version"), F.count(F.lit(1)).alias("nodes"),
                     F.count_if(is_model_derived()).alias("ai_nodes"), F.lit(1).alias("_one"))
    right = edges.agg(F.count(F.lit(1)).alias("edges"), F.lit(1).alias("_one"))
    return left.join(right, "_one").select("version", "nodes", "edges", "ai_nodes")
