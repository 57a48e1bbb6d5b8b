"""Round trips through storage: corpora, API descriptions and graphs written and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.harness.base import (
    ENTITY_EDGES_SQL, ENTITY_NODES_SQL, Tables, as_facts, entity_edges, entity_nodes, order_lines,
    query, supply_candidates, union)
from graphloom.operators import refine
from graphloom.schema import Graph
from graphloom.session import checkpoint_dir
from graphloom.sinks.exports import write_dataset_json
from graphloom.sinks.files import write_files_now
from graphloom.sources.api_spec import read_api_spec, spec_definitions, spec_operations
from graphloom.sources.corpus import read_fixture_corpus, read_markdown_corpus
from graphloom.sources.tables import read_edges_by_to, read_graph, write_graph


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _written_documents(spark, sf_dir) -> str:
    """Every document as a Markdown file of its language; those without one are contributions."""
    root = _folder(spark, "markdown")
    docs = Tables(spark, sf_dir).spread("documents", "doc_id", "lang", "text")
    path = F.concat(F.coalesce("lang", F.lit("contribute")), F.lit("/doc "),
                    F.col("doc_id").cast("string"), F.lit("+1%.md"))
    write_files_now(docs.select(path.alias("rel_path"), "text"), root)
    return root


#: Files of zero bytes are not listed, and line ends are those of Unix.
FILES_SQL = r"""
f AS (SELECT coalesce(lang, 'contribute') AS section,
             coalesce(lang, 'contribute') || '/doc ' || doc_id AS stem,
             regexp_replace(text, '\r\n?', chr(10), 'g') AS text
      FROM documents WHERE length(text) > 0)"""


@query("markdown_corpus", f"""
WITH {FILES_SQL}
SELECT stem || '+1%.md' AS rel_path, section, 'https://docs.example/docs/' || stem || '+1%/' AS url,
       sha256(text) AS content_hash FROM f WHERE section <> 'contribute'""")
def markdown_corpus(spark, sf_dir) -> DataFrame:
    """All documents written as files and read back, without the excluded section."""
    docs = read_markdown_corpus(spark, _written_documents(spark, sf_dir),
                                base_url="https://docs.example/")
    return docs.select("rel_path", "section", "url", "content_hash")


@query("fixture_corpus", f"""
WITH {FILES_SQL}
SELECT stem || '+1%.md' AS rel_path, section, NULL::VARCHAR AS url, sha256(text) AS content_hash
FROM f""")
def fixture_corpus(spark, sf_dir) -> DataFrame:
    """The same files as a sample corpus: every section, and no addresses."""
    docs = read_fixture_corpus(spark, _written_documents(spark, sf_dir))
    return docs.select("rel_path", "section", "url", "content_hash")


@query("api_spec_files", r"""
WITH s AS (SELECT s_suppkey || '.json' AS spec_file, 'Supplier' || s_suppkey AS kind,
                  '/apis/supply/v1/' || s_suppkey AS path, s_name, s_nationkey FROM supplier)
SELECT spec_file, 'definition' AS item, 'io.supply.v1.' || kind AS name,
       '{"description":"' || s_name || '","properties":{"nation":{"$ref":"#/definitions/Nation'
       || s_nationkey || '"}}}' AS detail, NULL::VARCHAR AS operation_id FROM s
UNION ALL SELECT spec_file, 'get', path, 'reads ' || s_name, 'read' || kind FROM s
UNION ALL SELECT spec_file, 'delete', path, 'drops ' || s_name, NULL FROM s""")
def api_spec_files(spark, sf_dir) -> DataFrame:
    """An API description of one file per supplier, written, read and taken apart."""
    root = _folder(spark, "spec")
    key = F.col("s_suppkey").cast("string")
    kind = F.concat(F.lit("Supplier"), key)
    text = F.concat(
        F.lit('{"swagger": "2.0", "definitions": {"io.supply.v1.'), kind,
        F.lit('": {"description":"'), "s_name",
        F.lit('","properties":{"nation":{"$ref":"#/definitions/Nation'), F.col("s_nationkey").cast("string"),
        F.lit('"}}}},\n"paths": {"/apis/supply/v1/'), key,
        F.lit('": {"get": {"operationId": "read'), kind, F.lit('", "description": "reads '), "s_name",
        F.lit('"}, "delete": {"description": "drops '), "s_name", F.lit('"}}}}'))
    suppliers = Tables(spark, sf_dir).supplier
    write_files_now(suppliers.select(F.concat(key, F.lit(".json")).alias("rel_path"),
                                     text.alias("text")), root)
    spec = read_api_spec(spark, root)
    definitions = spec_definitions(spec).select(
        "spec_file", F.lit("definition").alias("item"), "name", F.col("definition").alias("detail"),
        F.lit(None).cast("string").alias("operation_id"))
    operations = spec_operations(spec).select(
        "spec_file", F.col("method").alias("item"), F.col("path").alias("name"),
        F.col("description").alias("detail"), "operation_id")
    return definitions.unionByName(operations)


def _entity_graph(spark, sf_dir) -> Graph:
    tables = Tables(spark, sf_dir)
    candidates, lines = entity_nodes(tables, candidates=True), order_lines(tables)
    return Graph(nodes=as_facts(candidates), edges=entity_edges(tables, lines),
                 node_evidence=refine.node_evidence(candidates),
                 edge_evidence=refine.edge_evidence(supply_candidates(tables, lines)),
                 meta={"version": "harness"})


def _rows_of(graph: Graph, more: dict[str, DataFrame]) -> DataFrame:
    """All rows of a graph's tables in one layout."""
    nothing = F.lit(None).cast("string")

    def rows(name, df, first, second, kind, value, number):
        return df.select(F.lit(name).alias("item"), F.col(first).alias("id"),
                         second.alias("to_id"), kind.alias("type"), F.col(value).alias("value"),
                         number.alias("n"))

    parts = [
        rows("nodes", graph.nodes, "id", nothing, F.col("type"), "title", F.col("n_prov")),
        rows("node_evidence", graph.node_evidence, "id", nothing, nothing, "quote",
             F.col("ord.phase").cast("bigint")),
        rows("edge_evidence", graph.edge_evidence, "from_id", F.col("to_id"), F.col("type"), "quote",
             F.col("ord.pos"))]
    for name, df in {"edges": graph.edges, **more}.items():
        parts.append(rows(name, df, "from_id", F.col("to_id"), F.col("type"), "label", F.col("n_prov")))
    return union(parts).withColumn("version", F.lit(graph.meta["version"]))


def _stored_sql(*edge_tables: str) -> str:
    edges = " ".join(f"UNION ALL SELECT '{name}', from_id, to_id, type, label, n_prov FROM e"
                     for name in edge_tables)
    return f"""
WITH {ENTITY_NODES_SQL}, {ENTITY_EDGES_SQL}
SELECT *, 'harness' AS version FROM (
  SELECT 'nodes' AS item, id, NULL::VARCHAR AS to_id, type, title AS value, 1::BIGINT AS n FROM n
  UNION ALL SELECT 'node_evidence', id, NULL, NULL, title, phase FROM n
  UNION ALL SELECT 'edge_evidence', 'part:' || l_partkey, 'supplier:' || l_suppkey, 'related_to',
         l_orderkey::VARCHAR, l_linenumber FROM lineitem
  {edges})"""


@query("stored_graph", _stored_sql("edges", "edges_by_to"))
def stored_graph(spark, sf_dir) -> DataFrame:
    """The entity graph written as Parquet tables, all of them read back."""
    path = _folder(spark, "graph")
    write_graph(_entity_graph(spark, sf_dir), path)
    return _rows_of(read_graph(spark, path), {"edges_by_to": read_edges_by_to(spark, path)})


@query("stored_graph_json", _stored_sql("edges"))
def stored_graph_json(spark, sf_dir) -> DataFrame:
    """The entity graph exported as JSON lines and read back."""
    path = _folder(spark, "graph-json")
    write_dataset_json(_entity_graph(spark, sf_dir), path)
    return _rows_of(read_graph(spark, path, "json"), {})
