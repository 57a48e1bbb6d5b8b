"""Distributed exports.

Each export is a row-to-text projection plus a range-sorted write: the part
files, read in name order, form the document. Nothing passes through one task.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions.render import gexf_edge, gexf_node, node_text_block
from graphloom.operators.select import edge_view, sample_per_type, sitemap_urls, with_evidence
from graphloom.operators.stats import graph_stats
from graphloom.schema import Graph
from graphloom.seeds import DUMP_TYPES

JSONL_FIELDS = ["id", "type", "title", "summary", "tags", "body", "derived_by", "confidence"]
SEARCH_FIELDS = ["id", "type", "title", "summary", "tags", "section", "url"]

# The frame of a GEXF document.
GEXF_HEAD = [
    '<?xml version="1.0" encoding="UTF-8"?>',
    '<gexf xmlns="http://gexf.net/1.3" version="1.3">',
    '<graph mode="static" defaultedgetype="directed">',
    '<attributes class="node">',
    '<attribute id="type" title="type" type="string"/>',
    '<attribute id="section" title="section" type="string"/>',
    '<attribute id="confidence" title="confidence" type="double"/>',
    "</attributes>",
    "<nodes>",
]
GEXF_MIDDLE = ["</nodes>", "<edges>"]
GEXF_TAIL = ["</edges>", "</graph>", "</gexf>"]


def register_edge_view(graph: Graph, name: str = "edge_view") -> DataFrame:
    """The edges with both titles as a temporary view."""
    view = edge_view(graph.edges, graph.nodes)
    view.createOrReplaceTempView(name)
    return view


def jsonl_lines(nodes: DataFrame) -> DataFrame:
    """(id, line): one JSON object per node."""
    line = F.to_json(F.struct(*JSONL_FIELDS), {"ignoreNullFields": "false"})
    return nodes.select("id", "ord", line.alias("line"))


def write_jsonl(nodes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    lines = jsonl_lines(nodes).repartitionByRange("ord", "id").sortWithinPartitions("ord", "id")
    lines.select("line").write.mode(mode).text(path)


def search_entries(nodes: DataFrame) -> DataFrame:
    return nodes.select(*SEARCH_FIELDS)


def write_search_index(nodes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The entries as JSON lines, and their number beside them."""
    search_entries(nodes).write.mode(mode).option("ignoreNullFields", "false").json(
        f"{path}/entries")
    nodes.agg(F.count(F.lit(1)).alias("count")).write.mode(mode).json(f"{path}/count")


def write_dataset_json(graph: Graph, path: str, mode: str = "errorifexists") -> None:
    """The whole graph as gzipped JSON lines per table, with metadata and statistics.

    :func:`graphloom.sources.tables.read_graph` reads it back with ``fmt="json"``.
    """
    tables = {
        "nodes": graph.nodes, "edges": graph.edges,
        "node_evidence": graph.node_evidence, "edge_evidence": graph.edge_evidence,
        "stats": graph_stats(graph.nodes, graph.edges),
    }
    for name, df in tables.items():
        df.write.mode(mode).options(ignoreNullFields="false", compression="gzip").json(f"{path}/{name}")
    meta = F.lit(json.dumps(graph.meta)).alias("value")
    graph.nodes.sparkSession.range(1).select(meta).write.mode(mode).text(f"{path}/meta")


def text_blocks(nodes: DataFrame, evidence: DataFrame) -> DataFrame:
    """(id, type, ord, block): the plain text of every node."""
    cited = with_evidence(nodes, evidence, 3)
    return cited.select("id", "type", "ord", node_text_block().alias("block"))


def text_dumps(nodes: DataFrame, evidence: DataFrame, types: Sequence[str] = DUMP_TYPES,
               sample_type: str = "concept", sample: int | None = None,
               corpus: str = "Kubernetes") -> DataFrame:
    """(type, ord, id, line): per type a header and the blocks of its nodes.

    With ``sample`` given, ``sample_type`` is represented by its first nodes only and
    its header says how many there are in all.
    """
    wanted = nodes.filter(F.col("type").isin([*types, sample_type]))
    full = wanted.filter(F.col("type") != sample_type)
    some = wanted.filter(F.col("type") == sample_type)
    if sample is not None:
        some = sample_per_type(some, sample).drop("rank")
    # At most one row per listed type, hence small enough to broadcast.
    sizes = wanted.groupBy("type").agg(
        F.count(F.lit(1)).alias("n"), F.min(F.struct("ord", "id")).alias("first"))
    blocks = text_blocks(full.unionByName(some), evidence)
    marked = blocks.join(F.broadcast(sizes.select("type", "first")), "type")
    rule = F.when(F.struct("ord", "id") == F.col("first"), F.col("block")).otherwise(
        F.concat(F.lit("\n---\n\n"), F.col("block")))
    body = marked.select("type", F.lit(1).alias("part"), "ord", "id", rule.alias("line"))
    shown = F.col("n") if sample is None else F.least("n", F.lit(sample))
    title = F.when(F.col("type") == sample_type, F.concat(
        F.lit("concept headings (sample of "), shown, F.lit("/"), F.col("n"), F.lit(")\n"),
    )).otherwise(F.concat("type", F.lit(" ("), F.col("n"), F.lit(" entries)\n")))
    head = F.concat(F.lit(f"# {corpus} knowledge — "), title)
    heads = sizes.select("type", F.lit(0).alias("part"), F.col("first.ord").alias("ord"),
                         F.col("first.id").alias("id"), head.alias("line"))
    return heads.unionByName(body)


def write_text_dumps(nodes: DataFrame, evidence: DataFrame, path: str,
                     mode: str = "errorifexists", **options: object) -> None:
    keys = ["type", "part", "ord", "id"]
    lines = text_dumps(nodes, evidence, **options)
    ordered = lines.repartitionByRange(*keys).sortWithinPartitions(*keys)
    ordered.select("type", "line").write.mode(mode).partitionBy("type").text(path)


def gexf_elements(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(kind, key, element): one XML element per node and per edge."""
    n = nodes.select(F.lit("node").alias("kind"), F.col("id").alias("key"),
                     gexf_node().alias("element"))
    e = edges.select(F.lit("edge").alias("kind"),
                     F.concat_ws("|", "from_id", "type", "to_id").alias("key"),
                     gexf_edge().alias("element"))
    return n.unionByName(e)


def write_gexf(nodes: DataFrame, edges: DataFrame, path: str,
               mode: str = "errorifexists") -> None:
    """A GEXF document in parts; concatenated in name order it is well-formed."""
    spark = nodes.sparkSession

    def frame(part: int, lines: Sequence[str]) -> DataFrame:
        listed = F.posexplode(F.array(*[F.lit(line) for line in lines])).alias("pos", "element")
        return spark.range(1).select(listed).select(
            F.lit(part).alias("part"), F.lpad(F.col("pos").cast("string"), 4, "0").alias("key"),
            "element")

    rows = gexf_elements(nodes, edges).select(
        F.when(F.col("kind") == "node", 1).otherwise(3).alias("part"), "key", "element")
    for part, lines in ((0, GEXF_HEAD), (2, GEXF_MIDDLE), (4, GEXF_TAIL)):
        rows = rows.unionByName(frame(part, lines))
    ordered = rows.repartitionByRange("part", "key").sortWithinPartitions("part", "key")
    ordered.select("element").write.mode(mode).text(path)


def write_sitemap(nodes: DataFrame, base_url: str, path: str,
                  mode: str = "errorifexists") -> None:
    """One URL per line, the plain-text sitemap format."""
    sitemap_urls(nodes, base_url).select("url").write.mode(mode).text(path)


