"""Stored graphs: Parquet tables laid out for lookups, or JSON lines.

Edges are stored twice, range-sorted by either endpoint, so that looking up a
node's outgoing or incoming edges reads only the row groups that hold it. The
range keys include the whole edge key: a hub is split over several files.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema as s
from graphloom.schema import Graph
from graphloom.session import sorting

_LAYOUT = {
    "nodes": s.NODES,
    "edges": s.EDGES,
    "node_evidence": s.NODE_EVIDENCE,
    "edge_evidence": s.EDGE_EVIDENCE,
}


def _sorted(df: DataFrame, *keys: str) -> DataFrame:
    return df.repartitionByRange(*keys).sortWithinPartitions(*keys)


def _sorted_edges(edges: DataFrame, *keys: str) -> DataFrame:
    """Edges by range; ``best_ord`` is sent along only where it is not ``ord``, as it mostly is."""
    if "best_ord" not in edges.columns:
        return _sorted(edges, *keys)
    same = F.col("best_ord").eqNullSafe(F.col("ord"))
    sent = edges.withColumns({"_same": same, "best_ord": F.when(~same, F.col("best_ord"))})
    best = F.when(F.col("_same"), F.col("ord")).otherwise(F.col("best_ord"))
    return _sorted(sent, *keys).withColumn("best_ord", best).drop("_same")


def write_graph(graph: Graph, path: str, mode: str = "errorifexists") -> None:
    """The graph as Parquet: nodes by type, edges sorted by from and by to."""
    spark = graph.nodes.sparkSession

    def write(df: DataFrame, name: str, *partitions: str) -> None:
        df.write.mode(mode).option("compression", "zstd").partitionBy(*partitions).parquet(f"{path}/{name}")

    with sorting(spark):
        write(_sorted(graph.nodes, "type", "id"), "nodes", "type")
        write(_sorted_edges(graph.edges, "from_id", "type", "to_id"), "edges")
        edges = graph.edges
        if mode.lower() not in ("append", "ignore"):
            # The copy just written: merging the edges once more would shuffle all candidates.
            edges = spark.read.schema(graph.edges.schema).parquet(f"{path}/edges")
        write(_sorted_edges(edges, "to_id", "type", "from_id"), "edges_by_to")
        write(_sorted(graph.node_evidence, "id", "ord"), "node_evidence")
        write(_sorted(graph.edge_evidence, "from_id", "type", "to_id", "ord"), "edge_evidence")
    meta = F.lit(json.dumps(graph.meta)).alias("value")
    spark.range(1).select(meta).write.mode(mode).text(f"{path}/meta")


def read_graph(spark: SparkSession, path: str, fmt: str = "parquet") -> Graph:
    """A graph written by :func:`write_graph` (parquet) or the JSON export (json)."""
    tables = {}
    for name, layout in _LAYOUT.items():
        df = spark.read.schema(layout).format(fmt).load(f"{path}/{name}")
        tables[name] = df.select(*layout.fieldNames())
    meta = json.loads(spark.read.text(f"{path}/meta").first()["value"])
    return Graph(meta=meta, **tables)


def read_edges_by_to(spark: SparkSession, path: str) -> DataFrame:
    """The edge copy sorted by ``to_id``, for incoming lookups."""
    return spark.read.schema(s.EDGES).parquet(f"{path}/edges_by_to")
