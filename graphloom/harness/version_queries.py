"""Versions, hashes, manifests and incremental ingestion."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as t
from graphloom.harness.base import (
    ENTITY_EDGES_SQL, ENTITY_NODES_SQL, Tables, as_facts, entity_edges, entity_nodes, query, text_id)
from graphloom.operators import check, manifest, refine
from graphloom.schema import Graph
from graphloom.session import checkpoint_dir
from graphloom.plans.compile import CompileOptions
from graphloom.plans.incremental import IncrementalGraph, graph_stream
from graphloom.streaming import ingest


def _versions(spark, sf_dir):
    """Orders before 2000 against orders after 1995, with another title for some."""
    orders = Tables(spark, sf_dir).orders
    rows = orders.select(
        text_id("order:", "o_orderkey").alias("id"), F.lit("api_path").alias("type"),
        F.col("o_orderpriority").alias("title"), "o_orderdate", "o_orderkey")
    old = rows.filter(F.col("o_orderdate") < F.lit("2000-01-01").cast("timestamp_ntz"))
    new = rows.filter(F.col("o_orderdate") >= F.lit("1995-01-01").cast("timestamp_ntz"))
    title = F.when(F.col("o_orderkey") % 10 == 0, "other").otherwise(F.col("title"))
    return old, new.withColumn("title", title)


VERSIONS_SQL = """
o AS (SELECT o_orderkey, 'order:' || o_orderkey AS id, o_orderpriority AS title FROM orders
      WHERE o_orderdate < TIMESTAMP '2000-01-01'),
v AS (SELECT o_orderkey, 'order:' || o_orderkey AS id,
        CASE WHEN o_orderkey % 10 = 0 THEN 'other' ELSE o_orderpriority END AS title FROM orders
      WHERE o_orderdate >= TIMESTAMP '1995-01-01'),
d AS (SELECT coalesce(o.id, v.id) AS id,
        CASE WHEN o.id IS NULL THEN 'added' WHEN v.id IS NULL THEN 'removed'
             WHEN o.title <> v.title THEN 'changed' END AS status
      FROM o FULL JOIN v ON o.id = v.id)"""


@query("diff_versions", f"""
WITH {VERSIONS_SQL} SELECT id, status FROM d WHERE status IN ('added', 'removed')""")
def diff_versions(spark, sf_dir) -> DataFrame:
    return check.diff(*_versions(spark, sf_dir))


@query("diff_changed", f"WITH {VERSIONS_SQL} SELECT id, status FROM d WHERE status IS NOT NULL")
def diff_changed(spark, sf_dir) -> DataFrame:
    return check.diff(*_versions(spark, sf_dir), compare=["title", "type"])


@query("diff_bucketed", f"WITH {VERSIONS_SQL} SELECT id, status FROM d WHERE status IS NOT NULL")
def diff_bucketed(spark, sf_dir) -> DataFrame:
    """The changes of both versions, found by the sums of their buckets."""
    root = f"{checkpoint_dir(spark).rstrip('/')}/digests-{uuid.uuid4().hex}"
    for name, rows in zip(("old", "new"), _versions(spark, sf_dir), strict=True):
        check.write_digests(rows, f"{root}/{name}", compare=["title", "type"], folders=16)
    return check.diff_digests(spark, f"{root}/old", f"{root}/new")


@query("diff_counts", f"""
WITH {VERSIONS_SQL}
SELECT (SELECT count(*) FROM o)::BIGINT AS old_rows, (SELECT count(*) FROM v)::BIGINT AS new_rows,
       count(*) FILTER (WHERE status = 'added')::BIGINT AS added,
       count(*) FILTER (WHERE status = 'removed')::BIGINT AS removed,
       count(*) FILTER (WHERE status = 'changed')::BIGINT AS changed FROM d""")
def diff_counts(spark, sf_dir) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return check.diff_counts(old, new, check.diff(old, new, compare=["title", "type"]))


@query("diff_report", f"""
WITH {VERSIONS_SQL}, r AS (
  SELECT id, status, row_number() OVER (PARTITION BY status ORDER BY id)::INT AS rank FROM d
  WHERE status IN ('added', 'removed'))
SELECT status, rank, r.id, 'api_path' AS type, coalesce(v.title, o.title) AS title
FROM r LEFT JOIN o ON r.status = 'removed' AND o.id = r.id
LEFT JOIN v ON r.status = 'added' AND v.id = r.id WHERE rank <= 40""")
def diff_report(spark, sf_dir) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return check.diff_report(old, new, check.diff(old, new))


@query("diff_edges", """
WITH a AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'O'),
b AS (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_linestatus = 'F')
SELECT 'part:' || l_partkey AS from_id, 'related_to' AS type, 'supplier:' || l_suppkey AS to_id,
       'added' AS status FROM (FROM b EXCEPT FROM a)
UNION ALL SELECT 'part:' || l_partkey, 'related_to', 'supplier:' || l_suppkey, 'removed'
FROM (FROM a EXCEPT FROM b)""")
def diff_edges(spark, sf_dir) -> DataFrame:
    lines = Tables(spark, sf_dir).lineitem

    def pairs(status):
        return lines.filter(F.col("l_linestatus") == status).select(
            text_id("part:", "l_partkey").alias("from_id"), F.lit("related_to").alias("type"),
            text_id("supplier:", "l_suppkey").alias("to_id")).distinct()

    return check.diff(pairs("O"), pairs("F"), keys=["from_id", "type", "to_id"])


@query("version_edges", f"""
WITH {VERSIONS_SQL}
SELECT id || '@v1' AS from_id, id || '@v2' AS to_id, 'version_of' AS type
FROM o SEMI JOIN v USING (id)""")
def version_edges(spark, sf_dir) -> DataFrame:
    old, new = _versions(spark, sf_dir)
    return check.version_edges(old, new, "v1", "v2").select("from_id", "to_id", "type")


_LIMBS_SQL = " || ',' || ".join(
    f"sum(('0x' || h[{1 + 8 * i}:{8 + 8 * i}])::BIGINT)::HUGEINT::VARCHAR" for i in range(8))


@query("corpus_hash", f"""
SELECT sha256({_LIMBS_SQL} || ',' || count(*)) AS corpus_hash, count(*)::BIGINT AS n
FROM (SELECT sha256(lang || '/' || doc_id || '|' || sha256(text)) AS h FROM documents)""")
def corpus_hash(spark, sf_dir) -> DataFrame:
    docs = Tables(spark, sf_dir).documents.select(
        F.concat("lang", F.lit("/"), F.col("doc_id").cast("string")).alias("rel_path"),
        t.content_hash(F.col("text")).alias("content_hash"))
    return manifest.corpus_hash(docs)


def _graph(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    candidates = entity_nodes(tables, candidates=True)
    return Graph(
        nodes=as_facts(candidates), edges=entity_edges(tables),
        node_evidence=refine.node_evidence(candidates),
        edge_evidence=refine.edge_evidence(
            tables.lineitem.select(
                text_id("part:", "l_partkey").alias("from_id"), F.lit("related_to").alias("type"),
                text_id("supplier:", "l_suppkey").alias("to_id"), F.lit(None).alias("ord"),
                F.struct(F.lit("lineitem").alias("source"),
                         F.col("l_orderkey").cast("string").alias("quote")).alias("prov"))),
        meta={"version": "v1"})


def _s(value: str) -> str:
    return f"coalesce(length({value})::VARCHAR || ':' || {value}, '~')"


def _d(value: str) -> str:
    return f"{value}::DECIMAL(20,9)::VARCHAR || ';'"


# The canonical text of every row, columns in the order of their names.
GRAPH_HASH_SQL = f"""
{ENTITY_NODES_SQL}, {ENTITY_EDGES_SQL},
rows AS (
  SELECT 0 AS part, sha256('[]' || '0:' || 'false;' || '1.000000000;' || '13:deterministic'
           || {_s('id')}
           || CASE WHEN meta_group IS NULL THEN '~' ELSE '(~~' || {_s('meta_group')} || '~~~~~~~~~~)' END
           || '1;' || {_s('section')} || {_s('summary')} || '['
           || array_to_string(list_transform(tags, lambda x: length(x)::VARCHAR || ':' || x), '') || ']'
           || {_s('title')} || {_s('type')} || '~' || '7:unknown') AS h FROM n
  UNION ALL
  SELECT 1, sha256({_d('confidence')} || {_s('derived_by')} || {_s('from_id')} || {_s('label')}
           || n_prov || ';' || {_s('to_id')} || {_s('type')} || {_d('weight')}) FROM e
  UNION ALL
  SELECT 2, sha256({_s('id')} || '~~' || {_s('title')} || {_s("split_part(id, ':', 1)")} || '~') FROM n
  UNION ALL
  SELECT 3, sha256({_s("'part:' || l_partkey")} || {_s('l_orderkey::VARCHAR')} || '8:lineitem'
           || {_s("'supplier:' || l_suppkey")} || '10:related_to') FROM lineitem
),
tables AS (SELECT part, sha256({_LIMBS_SQL} || ',' || count(*)) AS h FROM rows GROUP BY part),
graph AS (SELECT sha256(string_agg(h, '|' ORDER BY part)) AS ir_hash FROM tables)"""


@query("graph_hash", f"WITH {GRAPH_HASH_SQL} SELECT ir_hash FROM graph")
def graph_hash(spark, sf_dir) -> DataFrame:
    return manifest.graph_hash(_graph(spark, sf_dir))


@query("manifest", f"""
WITH {GRAPH_HASH_SQL},
c AS (SELECT sha256({_LIMBS_SQL} || ',' || count(*)) AS corpus_hash
      FROM (SELECT sha256('doc:' || doc_id || '|' || sha256(text)) AS h FROM documents))
SELECT ir_hash, corpus_hash, (SELECT count(*) FROM n)::BIGINT AS node_count,
       (SELECT count(*) FROM e)::BIGINT AS edge_count, 'v1' AS version, 'graphloom' AS generator
FROM graph, c""")
def build_manifest(spark, sf_dir) -> DataFrame:
    docs = Tables(spark, sf_dir).documents.select(
        text_id("doc:", "doc_id").alias("rel_path"),
        t.content_hash(F.col("text")).alias("content_hash"))
    return manifest.build_manifest(_graph(spark, sf_dir), docs)


def _edited(docs):
    """A hundredth of the documents edited; every fiftieth is new."""
    text = F.when(F.col("doc_id") % 100 == 3, F.concat("text", F.lit("!"))).otherwise(
        F.col("text"))
    before = docs.filter(F.col("doc_id") % 50 != 7)
    return before, docs.withColumn("text", text)


def _hashed(docs):
    return docs.select(F.col("doc_id").cast("string").alias("rel_path"),
                       t.content_hash(F.col("text")).alias("content_hash"))


@query("changed_docs", """
SELECT doc_id::VARCHAR AS rel_path,
       sha256(CASE WHEN doc_id % 100 = 3 THEN text || '!' ELSE text END) AS content_hash
FROM documents WHERE doc_id % 100 = 3 OR doc_id % 50 = 7""")
def changed_docs(spark, sf_dir) -> DataFrame:
    before, after = _edited(Tables(spark, sf_dir).documents)
    return manifest.changed_docs(manifest.document_manifest(_hashed(before)), _hashed(after))


@query("stream_ingest", """
SELECT doc_id::VARCHAR AS rel_path, lang AS section,
       sha256(CASE WHEN doc_id % 100 = 3 THEN text || '!' ELSE text END) AS content_hash
FROM documents""")
def stream_ingest(spark, sf_dir) -> DataFrame:
    """Two runs of the stream: all documents, then the same ones with some edited."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/ingest-{uuid.uuid4().hex}"
    docs = Tables(spark, sf_dir).documents
    before, after = _edited(docs)
    columns = ["rel_path STRING", "text STRING", "url STRING", "section STRING"]
    for version in (before, after):
        version.select(
            F.col("doc_id").cast("string").alias("rel_path"), "text",
            F.lit(None).cast("string").alias("url"), F.col("lang").alias("section"),
        ).write.mode("append").parquet(f"{base}/in")
        texts = spark.readStream.schema(", ".join(columns)).parquet(f"{base}/in")
        ingest.ingest_stream(texts, f"{base}/out", f"{base}/progress", buckets=8).awaitTermination()
    latest = ingest.read_latest_docs(spark, f"{base}/out", buckets=8)
    return latest.select("rel_path", "section", "content_hash")


def _graph_texts(docs: DataFrame) -> DataFrame:
    """(rel_path, text, url, section): documents as pages that use a term of their language and
    link to the document ``goal``."""
    key, lang = F.col("doc_id").cast("string"), F.coalesce("lang", F.lit("none"))
    text = F.concat(
        F.lit("---\ntitle: Doc "), key, F.lit("\n---\nUses {{< glossary_tooltip text=\"it\" term_id=\""), lang,
        F.lit("\" >}} and [that](/docs/d/"), F.col("goal").cast("string"), F.lit("/).\n## About "),
        F.coalesce("source", F.lit("none")), F.lit("\n"), F.coalesce("text", F.lit("")))
    return docs.select(F.concat(F.lit("d/"), key, F.lit(".md")).alias("rel_path"), text.alias("text"),
                       F.lit(None).cast("string").alias("url"), F.lit("d").alias("section"))


def _graph_terms(docs: DataFrame) -> DataFrame:
    lang = F.coalesce("lang", F.lit("none"))
    return docs.select(lang.alias("term")).distinct().select(
        F.concat(F.lit("reference/glossary/"), "term", F.lit(".md")).alias("rel_path"),
        F.concat(F.lit("---\ntitle: Term "), "term", F.lit("\nid: "), "term", F.lit("\n---\nIt.\n")).alias("text"),
        F.lit(None).cast("string").alias("url"), F.lit("reference").alias("section"))


@query("stream_graph", r"""
WITH p AS (
  SELECT doc_id, coalesce(lang, 'none') AS lang, coalesce(source, 'none') AS source,
         CASE WHEN doc_id % 100 = 3 THEN doc_id // 3 ELSE doc_id // 2 END AS goal, text
  FROM documents WHERE doc_id % 10 <> 9),
g AS (SELECT DISTINCT coalesce(lang, 'none') AS lang FROM documents),
h AS (
  SELECT doc_id, unnest(list_concat(['About ' || source],
           regexp_extract_all(coalesce(text, ''), '(?m)^###?[ \t]+([^\n]+)', 1))) AS heading FROM p),
s AS (
  SELECT doc_id, heading, CASE WHEN x = '' THEN 'untitled' ELSE x END AS slug FROM (
    SELECT *, trim(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '-') AS x FROM h))
SELECT 'node' AS item, 'page:d/' || doc_id AS key, 'Doc ' || doc_id AS label, 1::BIGINT AS n_prov FROM p
UNION ALL SELECT 'node', 'gloss:' || lang, 'Term ' || lang, 1 FROM g
UNION ALL SELECT 'node', 'concept:' || slug, NULL, 1 FROM s GROUP BY slug
UNION ALL SELECT 'edge', 'page:d/' || doc_id || ' references gloss:' || lang, 'it', 1 FROM p
UNION ALL SELECT 'edge', 'page:d/' || p.doc_id || ' links_to page:d/' || goal, '/docs/d/' || goal || '/', 1
  FROM p SEMI JOIN p q ON q.doc_id = p.goal
UNION ALL SELECT 'edge', 'page:d/' || doc_id || ' part_of concept:' || slug, 'describes', count(*)
  FROM s GROUP BY doc_id, slug""")
def stream_graph(spark, sf_dir) -> DataFrame:
    """A graph kept up with a stream: first most documents, then some are added, some rewritten
    and a tenth deleted. Nodes and edges of documents as the last batch left them."""
    base = f"{checkpoint_dir(spark).rstrip('/')}/graph-{uuid.uuid4().hex}"
    docs = Tables(spark, sf_dir).documents
    half = docs.withColumn("goal", F.floor(F.col("doc_id") / 2))
    changed = docs.filter(F.col("doc_id") % 100 == 3).withColumn("goal", F.floor(F.col("doc_id") / 3))
    gone = _graph_texts(half.filter(F.col("doc_id") % 10 == 9)).withColumn("text", F.lit(None).cast("string"))
    batches = [_graph_texts(half.filter(F.col("doc_id") % 50 != 7)),
               _graph_terms(docs).union(_graph_texts(half.filter(F.col("doc_id") % 50 == 7)))
               .union(_graph_texts(changed)).union(gone)]
    graph = IncrementalGraph(spark, f"{base}/graph", CompileOptions(version="stream"), buckets=8)
    columns = "rel_path STRING, text STRING, url STRING, section STRING"
    for rows in batches:
        rows.write.mode("append").parquet(f"{base}/in")
        texts = spark.readStream.schema(columns).parquet(f"{base}/in")
        graph_stream(texts, f"{base}/docs", f"{base}/progress", graph, buckets=8).awaitTermination()
    found = graph.graph()
    of_docs = F.col("id").startswith("page:") | F.col("id").startswith("gloss:") | F.col("id").startswith("concept:")
    nodes = found.nodes.filter(of_docs).select(
        F.lit("node").alias("item"), F.col("id").alias("key"),
        F.when(F.col("type") != "concept", F.col("title")).alias("label"), "n_prov")
    edges = found.edges.filter(F.col("from_id").startswith("page:")).select(
        F.lit("edge"), F.concat_ws(" ", "from_id", "type", "to_id"), "label", "n_prov")
    return nodes.union(edges)
