"""Statistics, look-ups, rankings, walks, listings and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema as s
from graphloom.functions import text as t
from graphloom.harness.base import (
    ENTITY_EDGES_SQL, ENTITY_NODES_SQL, SEEN_SQL, WEB_NODES_SQL, Tables, as_facts, entity_edges,
    entity_nodes, query, text_id, web_nodes)
from graphloom.operators import check, paths, refine, select, stats
from graphloom.sinks import exports

BOTH_SQL = f"WITH {ENTITY_NODES_SQL}, {ENTITY_EDGES_SQL}"
SEEN = f"{BOTH_SQL}, {SEEN_SQL}"


def _graph(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    return entity_nodes(tables), entity_edges(tables)


# -- validation and statistics -----------------------------------------------


@query("validate", f"""
WITH {ENTITY_NODES_SQL}, {ENTITY_EDGES_SQL},
gone AS (SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE s_acctbal < 0)
SELECT 'duplicate_node' AS rule, id AS item, 1::BIGINT AS occurrences FROM n
WHERE type = 'glossary' AND pos % 5 = 0
UNION ALL SELECT 'node_confidence', id, 1 FROM n WHERE type = 'api_path' AND pos % 7 = 0
UNION ALL SELECT 'edge_confidence', concat_ws('|', from_id, type, to_id), 1 FROM e
WHERE type = 'related_to' AND confidence + 0.01 > 1
UNION ALL SELECT 'edge_from_unknown', concat_ws('|', from_id, type, to_id), 1 FROM e
WHERE from_id IN (SELECT id FROM gone)
UNION ALL SELECT 'edge_to_unknown', concat_ws('|', from_id, type, to_id), 1 FROM e
WHERE to_id IN (SELECT id FROM gone)""")
def validate(spark, sf_dir) -> DataFrame:
    """A graph broken on purpose: repeats, bad confidences, missing ends."""
    tables = Tables(spark, sf_dir)
    nodes, edges = entity_nodes(tables), entity_edges(tables)
    key = F.col("ord.doc").cast("bigint")
    poor = tables.supplier.filter(F.col("s_acctbal") < 0).select(
        text_id("supplier:", "s_suppkey").alias("id"))
    nodes = nodes.join(poor, "id", "left_anti")
    nodes = nodes.unionByName(nodes.filter((F.col("type") == "glossary") & (key % 5 == 0)))
    bad = (F.col("type") == "api_path") & (key % 7 == 0)
    nodes = nodes.withColumn("confidence", F.when(bad, 1.5).otherwise(F.col("confidence")))
    edges = edges.withColumn("confidence", F.when(
        F.col("type") == "related_to", F.col("confidence") + 0.01).otherwise(F.col("confidence")))
    return check.validate(nodes, edges)


@query("provenance_coverage", """
SELECT 'nodes' AS item, count(*)::BIGINT AS total,
       count(*) FILTER (WHERE quality IS NULL)::BIGINT AS without
FROM documents LEFT JOIN labels USING (doc_id)
UNION ALL SELECT 'edges', count(*), 0 FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem)
""")
def provenance_coverage(spark, sf_dir) -> DataFrame:
    tables = Tables(spark, sf_dir)
    labelled = tables.documents.select("doc_id").join(tables.labels, "doc_id", "left")
    nodes = labelled.select("doc_id", F.when(F.col("quality").isNotNull(), 1).alias("n_prov"))
    edges = entity_edges(tables).filter(F.col("type") == "related_to")
    return check.provenance_coverage(nodes, edges)


@query("node_type_counts", f"WITH {ENTITY_NODES_SQL} SELECT type, count(*)::BIGINT AS n FROM n GROUP BY type")
def node_type_counts(spark, sf_dir) -> DataFrame:
    return stats.node_type_counts(entity_nodes(Tables(spark, sf_dir)))


@query("edge_type_counts", f"WITH {ENTITY_EDGES_SQL} SELECT type, count(*)::BIGINT AS n FROM e GROUP BY type")
def edge_type_counts(spark, sf_dir) -> DataFrame:
    return stats.edge_type_counts(entity_edges(Tables(spark, sf_dir)))


_WIDE = ", ".join(
    f"(SELECT count(*) FROM n WHERE type = '{t_}')::BIGINT AS {c}" for t_, c in
    s.COUNT_COLUMNS.items())


@query("graph_stats", f"""
{BOTH_SQL}
SELECT {_WIDE}, (SELECT count(*) FROM n)::BIGINT AS nodes, 0::BIGINT AS duplicate_removed,
       (SELECT count(*) FROM e)::BIGINT AS edges,
       (SELECT string_agg(type || '=' || c, ',' ORDER BY type)
        FROM (SELECT type, count(*) AS c FROM e GROUP BY type)) AS edge_types,
       round((SELECT count(*) FROM e)::DOUBLE
             / ((SELECT count(*) FROM n)::DOUBLE * ((SELECT count(*) FROM n) - 1)), 12)
       AS graph_density""")
def graph_stats(spark, sf_dir) -> DataFrame:
    row = stats.graph_stats(*_graph(spark, sf_dir))
    listed = F.array_sort(F.transform(F.map_entries("edge_types"), lambda e: F.concat_ws(
        "=", e["key"], e["value"].cast("string"))))
    return row.withColumns({"edge_types": F.array_join(listed, ","),
                            "graph_density": F.round("graph_density", 12)})


@query("corpus_summary", f"""
{BOTH_SQL}
SELECT 'v1' AS version, (SELECT count(*) FROM n)::BIGINT AS nodes,
       (SELECT count(*) FROM e)::BIGINT AS edges,
       (SELECT count(*) FROM n WHERE type = 'concept')::BIGINT AS ai_nodes""")
def corpus_summary(spark, sf_dir) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    nodes = nodes.withColumn("derived_by", F.when(
        F.col("type") == "concept", "ai:m").otherwise(F.col("derived_by")))
    return stats.corpus_summary(nodes, edges, "v1")


@query("row_counts", f"""
{BOTH_SQL} SELECT 'nodes' AS item, count(*)::BIGINT AS n FROM n
UNION ALL SELECT 'edges', count(*) FROM e""")
def row_counts(spark, sf_dir) -> DataFrame:
    return stats.row_counts(*_graph(spark, sf_dir))


@query("degree_counts", f"""
WITH {ENTITY_EDGES_SQL}, d AS (
  SELECT to_id AS id, 1 AS i, 0 AS o FROM e WHERE type = 'prerequisite_of'
  UNION ALL SELECT from_id, 0, 1 FROM e WHERE type = 'prerequisite_of')
SELECT id, sum(i)::BIGINT AS prerequisites, sum(o)::BIGINT AS unlocks FROM d GROUP BY id""")
def degree_counts(spark, sf_dir) -> DataFrame:
    return stats.degree_counts(entity_edges(Tables(spark, sf_dir)))


@query("api_groups", """
SELECT CASE WHEN c_mktsegment = 'BUILDING' THEN 'core' ELSE c_mktsegment END AS api_group,
       count(*)::BIGINT AS objects FROM customer GROUP BY 1""")
def api_groups(spark, sf_dir) -> DataFrame:
    nodes = entity_nodes(Tables(spark, sf_dir))
    group = F.col("meta.group")
    blank = F.when(group == "BUILDING", "").otherwise(group)
    return stats.api_groups(nodes.withColumn("meta", F.col("meta").withField("group", blank)))


# -- look-ups ----------------------------------------------------------------


@query("edge_view", f"""
{BOTH_SQL}
SELECT e.from_id, f.title AS from_title, e.to_id, t.title AS to_title, e.type, e.label,
       e.confidence
FROM e JOIN n f ON f.id = e.from_id JOIN n t ON t.id = e.to_id""")
def edge_view(spark, sf_dir) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return select.edge_view(edges, nodes)


@query("neighbors", f"""
WITH {ENTITY_EDGES_SQL}, {SEEN_SQL}
SELECT direction, type, other_id FROM seen WHERE id = 'nation:3' AND type <> 'related_to'""")
def neighbors(spark, sf_dir) -> DataFrame:
    edges = entity_edges(Tables(spark, sf_dir))
    out = select.neighbors(edges, "nation:3").select(
        F.lit("out").alias("direction"), "type", F.col("to_id").alias("other_id"))
    into = select.incoming(edges, "nation:3").select(
        F.lit("in").alias("direction"), "type", F.col("from_id").alias("other_id"))
    return out.unionByName(into)


@query("edges_in_types", f"""
WITH {ENTITY_EDGES_SQL}
SELECT from_id, to_id, type FROM e WHERE type IN ('api_for', 'references', 'related_to')""")
def edges_in_types(spark, sf_dir) -> DataFrame:
    edges = entity_edges(Tables(spark, sf_dir))
    found = select.edges_of_types(edges, "api_for", "references", "related_to")
    return found.select("from_id", "to_id", "type")


@query("nodes_with_prefix", f"""
WITH {ENTITY_NODES_SQL} SELECT id, title FROM n WHERE id LIKE 'customer:%'""")
def nodes_with_prefix(spark, sf_dir) -> DataFrame:
    return select.with_id_prefix(entity_nodes(Tables(spark, sf_dir)), "customer:").select(
        "id", "title")


@query("related_topk", f"""
WITH {ENTITY_EDGES_SQL}, {SEEN_SQL}
SELECT id, rank, direction, other_id, type, label, confidence FROM (
  SELECT *, row_number() OVER (PARTITION BY id
    ORDER BY confidence DESC, other_id, type, direction)::INT AS rank FROM seen)
WHERE rank <= 25""")
def related_topk(spark, sf_dir) -> DataFrame:
    return select.related_topk(entity_edges(Tables(spark, sf_dir)))


@query("related_to", f"""
WITH {ENTITY_EDGES_SQL}, {SEEN_SQL}
SELECT other_id, direction, type, confidence FROM seen WHERE id = 'supplier:1'
ORDER BY confidence DESC, other_id, type, direction LIMIT 25""")
def related_to(spark, sf_dir) -> DataFrame:
    found = select.related_to(entity_edges(Tables(spark, sf_dir)), "supplier:1")
    return found.select("other_id", "direction", "type", "confidence")


@query("node_pages", f"""
{SEEN}, top AS (
  SELECT * FROM (
    SELECT *, row_number() OVER (PARTITION BY id
      ORDER BY confidence DESC, other_id, type, direction)::INT AS rank FROM seen)
  WHERE rank <= 25)
SELECT n.id, n.type, n.title, n.summary, split_part(n.id, ':', 1) || ' — ' || n.title AS sources,
       top.rank, top.direction, top.type AS edge_type, top.other_id, o.title AS other_title,
       top.label, top.confidence
FROM n LEFT JOIN top ON top.id = n.id LEFT JOIN n o ON o.id = top.other_id""")
def node_pages(spark, sf_dir) -> DataFrame:
    tables = Tables(spark, sf_dir)
    evidence = refine.node_evidence(entity_nodes(tables, candidates=True))
    return select.node_pages(entity_nodes(tables), entity_edges(tables), evidence)


@query("first_evidence", """
SELECT 'customer:' || o_custkey AS id, string_agg(o_orderkey::VARCHAR, ',' ORDER BY o_orderkey)
       AS quotes
FROM (SELECT o_custkey, o_orderkey,
        row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS r FROM orders)
WHERE r <= 4 GROUP BY o_custkey""")
def first_evidence(spark, sf_dir) -> DataFrame:
    rows = s.node_candidates(
        Tables(spark, sf_dir).orders,
        id=text_id("customer:", "o_custkey"), type=F.lit("page"), title=F.lit("x"),
        prov=s.provenance(F.lit("orders"), quote=F.col("o_orderkey").cast("string")),
        ord=s.ordinal(1, s.sortable("o_orderkey")))
    first = select.first_evidence(refine.node_evidence(rows), 4)
    quotes = F.transform("provenance", lambda p: p["quote"])
    return first.select("id", F.array_join(quotes, ",").alias("quotes"))


# -- prerequisites and walks -------------------------------------------------


@query("prereqs_unlocks", f"""
{SEEN}
SELECT s.id, a.title, CASE direction WHEN 'in' THEN 'prerequisite' ELSE 'unlocks' END AS direction,
       other_id, b.title AS other_title
FROM seen s JOIN n a ON a.id = s.id JOIN n b ON b.id = s.other_id
WHERE s.type = 'prerequisite_of' AND a.type IN ('concept', 'api_object')""")
def prereqs_unlocks(spark, sf_dir) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return select.prerequisite_pairs(edges, nodes, ["concept", "api_object"])


@query("prerequisites_of", f"""
{BOTH_SQL}
SELECT 'before' AS side, n.id, n.title FROM e JOIN n ON n.id = e.from_id
WHERE e.type = 'prerequisite_of' AND e.to_id = 'customer:7'
UNION ALL SELECT 'after', n.id, n.title FROM e JOIN n ON n.id = e.to_id
WHERE e.type = 'prerequisite_of' AND e.from_id = 'customer:7'""")
def prerequisites_of(spark, sf_dir) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    before = select.prerequisites_of(edges, nodes, "customer:7")
    after = select.unlocks(edges, nodes, "customer:7")
    return before.select(F.lit("before").alias("side"), "id", "title").unionByName(
        after.select(F.lit("after").alias("side"), "id", "title"))


@query("start_here", f"""
{BOTH_SQL}, d AS (
  SELECT id, (SELECT count(*) FROM e WHERE type = 'prerequisite_of' AND to_id = x.id) AS pre
  FROM (SELECT DISTINCT from_id AS id FROM e WHERE type = 'prerequisite_of') x)
SELECT n.id, title, pre::BIGINT AS prerequisites FROM d JOIN n USING (id)
WHERE n.type IN ('api_object', 'page')
ORDER BY pre, lower(title), title, n.id LIMIT 12""")
def start_here(spark, sf_dir) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return select.start_here(edges, nodes, types=["api_object", "page"]).select(
        "id", "title", "prerequisites")


@query("prereq_chain", f"""
WITH RECURSIVE {ENTITY_EDGES_SQL}, walk AS (
  SELECT to_id AS id, from_id AS ancestor, 1 AS depth FROM e WHERE type = 'prerequisite_of'
  UNION ALL SELECT w.id, e.from_id, depth + 1 FROM walk w
  JOIN e ON e.to_id = w.ancestor AND e.type = 'prerequisite_of')
SELECT id, ancestor, depth FROM walk""")
def prereq_chain(spark, sf_dir) -> DataFrame:
    edges = entity_edges(Tables(spark, sf_dir))
    return paths.prerequisite_chain(edges, edges.select(F.col("to_id").alias("id")))


@query("prereq_chain_of", f"""
WITH RECURSIVE {ENTITY_EDGES_SQL}, walk AS (
  SELECT to_id AS id, from_id AS ancestor, 1 AS depth FROM e
  WHERE type = 'prerequisite_of' AND to_id IN (
    SELECT 'order:' || o_orderkey FROM orders WHERE o_totalprice > 400000)
  UNION ALL SELECT w.id, e.from_id, depth + 1 FROM walk w
  JOIN e ON e.to_id = w.ancestor AND e.type = 'prerequisite_of')
SELECT id, ancestor, depth FROM walk""")
def prereq_chain_of(spark, sf_dir) -> DataFrame:
    tables = Tables(spark, sf_dir)
    dear = tables.orders.filter(F.col("o_totalprice") > 400_000).select(
        text_id("order:", "o_orderkey").alias("id"))
    return paths.prerequisite_chain(entity_edges(tables), dear)


@query("learning_levels", """
SELECT 'region:' || r_regionkey AS id, 0 AS level FROM region
UNION ALL SELECT 'nation:' || n_nationkey, 1 FROM nation
UNION ALL SELECT 'customer:' || c_custkey, 2 FROM customer
UNION ALL SELECT 'supplier:' || s_suppkey, 2 FROM supplier
UNION ALL SELECT 'order:' || o_orderkey, 3 FROM orders""")
def learning_levels(spark, sf_dir) -> DataFrame:
    return paths.learning_levels(entity_edges(Tables(spark, sf_dir)))


@query("shortest_paths", """
SELECT 'region:1' AS id, 0 AS hops, 'region:1' AS path
UNION ALL SELECT 'nation:' || n_nationkey, 1, 'region:1>nation:' || n_nationkey FROM nation
WHERE n_regionkey = 1
UNION ALL SELECT 'customer:' || c_custkey, 2,
  'region:1>nation:' || n_nationkey || '>customer:' || c_custkey
FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE n_regionkey = 1
UNION ALL SELECT 'supplier:' || s_suppkey, 2,
  'region:1>nation:' || n_nationkey || '>supplier:' || s_suppkey
FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE n_regionkey = 1
UNION ALL SELECT 'order:' || o_orderkey, 3,
  'region:1>nation:' || n_nationkey || '>customer:' || c_custkey || '>order:' || o_orderkey
FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey
WHERE n_regionkey = 1""")
def shortest_paths(spark, sf_dir) -> DataFrame:
    edges = entity_edges(Tables(spark, sf_dir))
    found = paths.shortest_paths_from(edges, "region:1", ["part_of"])
    return found.select("id", "hops", F.array_join("path", ">").alias("path"))


@query("path_between", """
SELECT 'customer:5' AS id, CASE WHEN c.c_nationkey = d.c_nationkey THEN 2 ELSE 4 END AS hops
FROM customer c JOIN nation a ON a.n_nationkey = c.c_nationkey,
     customer d JOIN nation b ON b.n_nationkey = d.c_nationkey
WHERE c.c_custkey = 2 AND d.c_custkey = 5 AND a.n_regionkey = b.n_regionkey""")
def path_between(spark, sf_dir) -> DataFrame:
    edges = entity_edges(Tables(spark, sf_dir))
    return paths.path_between(edges, "customer:2", "customer:5", ["part_of"]).select("id", "hops")


# -- listings, samples, routes -----------------------------------------------


@query("index_pages", f"""
WITH {ENTITY_NODES_SQL} SELECT id, title FROM n WHERE type IN ('api_object', 'api_path')""")
def index_pages(spark, sf_dir) -> DataFrame:
    return select.index_page(entity_nodes(Tables(spark, sf_dir)), "api_object", "api_path").select(
        "id", "title")


@query("section_counts", f"""
WITH {ENTITY_NODES_SQL} SELECT section, count(*)::BIGINT AS n FROM n GROUP BY section""")
def section_counts(spark, sf_dir) -> DataFrame:
    return select.sections(entity_nodes(Tables(spark, sf_dir)))


@query("sample_per_type", f"""
WITH {ENTITY_NODES_SQL}
SELECT type, rank, id FROM (
  SELECT type, id, row_number() OVER (PARTITION BY type ORDER BY phase, pos, id)::INT AS rank
  FROM n) WHERE rank <= 40""")
def sample_per_type(spark, sf_dir) -> DataFrame:
    return select.sample_per_type(entity_nodes(Tables(spark, sf_dir)), 40).select(
        "type", "rank", "id")


@query("induced_subgraph", f"""
{BOTH_SQL}, chosen AS (SELECT id FROM n ORDER BY phase, pos LIMIT 2400)
SELECT from_id, type, to_id FROM e
WHERE from_id IN (SELECT id FROM chosen) AND to_id IN (SELECT id FROM chosen)
ORDER BY phase, key, pos, from_id, type, to_id LIMIT 600""")
def induced_subgraph(spark, sf_dir) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    _, inside = select.induced_subgraph(nodes, edges, 2400, 600)
    return inside.select("from_id", "type", "to_id")


def _colliding_nodes(spark, sf_dir):
    """Parts whose distinct ids differ only in characters a slug drops."""
    parts = Tables(spark, sf_dir).part
    marks = F.translate(F.bin("p_partkey"), "01", "{}")
    kind = F.when(F.col("p_size") % 3 == 0, "role").when(
        F.col("p_size") % 3 == 1, "crd").otherwise("api_object")
    return s.node_candidates(
        parts, id=F.concat(F.lit("part:"), "p_name", F.lit("/"), marks), type=kind,
        title=F.col("p_name"), ord=s.ordinal(1, s.sortable("p_partkey")))


SLUGS_SQL = """
sl AS (
  SELECT 'part:' || p_name || '/' || translate(bin(p_partkey), '01', '{}') AS id,
         ['role', 'crd', 'api_object'][p_size % 3 + 1] AS type,
         ['rbac', 'docs', 'api'][p_size % 3 + 1] AS section, p_partkey,
         'part-' || replace(p_name, ' ', '-') || '-' AS base,
         row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k
  FROM part
),
slugs AS (SELECT *, base || CASE WHEN k = 0 THEN '' ELSE '-' || k END AS slug FROM sl)"""


@query("node_slugs", f"""
WITH {SLUGS_SQL} SELECT id, type, section, slug, '/' || section || '/' || slug || '/' AS href
FROM slugs""")
def node_slugs(spark, sf_dir) -> DataFrame:
    return select.hrefs(_colliding_nodes(spark, sf_dir))


_ROUTES = ", ".join(f"('{r}')" for r in select.SITE_ROUTES)


@query("sitemap_urls", f"""
WITH sl AS (
  SELECT ['rbac', 'docs', 'api'][p_size % 3 + 1] AS section,
         'part-' || replace(p_name, ' ', '-') || '-' AS base,
         row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) - 1 AS k
  FROM part WHERE p_size % 3 <> 1)
SELECT 'https://example.test' || r AS url FROM (VALUES {_ROUTES}) v(r)
UNION ALL SELECT 'https://example.test/' || section || '/' || base
       || CASE WHEN k = 0 THEN '' ELSE '-' || k END || '/' FROM sl""")
def sitemap_urls(spark, sf_dir) -> DataFrame:
    return select.sitemap_urls(_colliding_nodes(spark, sf_dir), "https://example.test/")


@query("ids_for_section", f"""
WITH {ENTITY_NODES_SQL}
SELECT 'docs' AS section, id FROM n WHERE type IN ('glossary', 'page', 'concept')
UNION ALL SELECT 'api', id FROM n WHERE type IN ('api_object', 'api_path')
UNION ALL SELECT 'relationships', id FROM n WHERE type = 'controller'""")
def ids_for_section(spark, sf_dir) -> DataFrame:
    nodes = entity_nodes(Tables(spark, sf_dir))
    parts = [select.ids_for_section(nodes, name).select(F.lit(name).alias("section"), "id")
             for name in ("docs", "api", "rbac", "relationships")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).unionByName(parts[3])


def _flow_nodes(spark, sf_dir):
    """Event types and users as flow nodes; three of them have a fixed rank."""
    events = Tables(spark, sf_dir).events
    names = F.when(F.col("event_type") == "view", "kubectl").when(
        F.col("event_type") == "click", "kubelet").when(
        F.col("event_type") == "error", "kube-apiserver").otherwise(
        F.concat("event_type", F.col("user_id").cast("string")))
    actors = events.select(F.concat(F.lit("flow:"), names).alias("id"), "props", "event_id")
    return actors.groupBy("id").agg(F.min_by("props", "event_id").alias("summary")).withColumn(
        "title", F.col("id"))


@query("flow_listing", """
SELECT id, id AS title, arg_min(props, event_id) AS summary,
       CASE id WHEN 'flow:kubectl' THEN 0 WHEN 'flow:kube-apiserver' THEN 1
               WHEN 'flow:kubelet' THEN 4 ELSE 5 END AS rank
FROM (SELECT 'flow:' || CASE event_type WHEN 'view' THEN 'kubectl' WHEN 'click' THEN 'kubelet'
        WHEN 'error' THEN 'kube-apiserver' ELSE event_type || user_id END AS id, props, event_id
      FROM events) GROUP BY id""")
def flow_listing(spark, sf_dir) -> DataFrame:
    return select.flow_listing(_flow_nodes(spark, sf_dir))


# -- exports -----------------------------------------------------------------


@query("jsonl", f"""
WITH {WEB_NODES_SQL}
SELECT id, to_json({{'id': id, 'type': type, 'title': title, 'summary': summary,
       'tags': [section], 'body': body, 'derived_by': 'deterministic',
       'confidence': 1.0::DOUBLE}})::VARCHAR AS line FROM w""")
def jsonl(spark, sf_dir) -> DataFrame:
    return exports.jsonl_lines(web_nodes(Tables(spark, sf_dir))).select("id", "line")


@query("search_index", f"""
WITH {WEB_NODES_SQL} SELECT id, type, title, summary, section AS tags, section, url FROM w""")
def search_index(spark, sf_dir) -> DataFrame:
    entries = exports.search_entries(web_nodes(Tables(spark, sf_dir)))
    return entries.withColumn("tags", F.array_join("tags", ","))


@query("text_blocks", f"""
WITH {WEB_NODES_SQL}
SELECT id, '# ' || title || '  [page]' || chr(10) || 'tags: ' || section
       || CASE WHEN summary <> '' THEN chr(10) || chr(10) || summary ELSE '' END
       || CASE WHEN body <> '' THEN chr(10) || chr(10) || body ELSE '' END
       || chr(10) || chr(10) || 'sources: pages (' || url || ')' AS block FROM w""")
def text_blocks(spark, sf_dir) -> DataFrame:
    tables = Tables(spark, sf_dir)
    nodes = web_nodes(tables)
    evidence = nodes.select(
        "id", "ord", F.lit("pages").alias("source"), "url", F.lit(None).cast("int").alias("line_start"),
        F.lit(None).cast("int").alias("line_end"), F.col("title").alias("quote"))
    return exports.text_blocks(nodes, evidence).select("id", "block")


@query("text_dumps", f"""
WITH {ENTITY_NODES_SQL}, c AS (SELECT type, count(*) AS n, min(pos) AS first FROM n
  WHERE type IN ('glossary', 'page', 'concept', 'api_object', 'controller') GROUP BY type),
r AS (SELECT n.*, row_number() OVER (PARTITION BY type ORDER BY pos) AS k FROM n)
SELECT type, 0 AS part, CASE type WHEN 'concept'
  THEN '# K knowledge — concept headings (sample of ' || least(c.n, 10) || '/' || c.n || ')'
  ELSE '# K knowledge — ' || type || ' (' || c.n || ' entries)' END || chr(10) AS line FROM c
UNION ALL
SELECT type, 1, CASE WHEN k = 1 THEN '' ELSE chr(10) || '---' || chr(10) || chr(10) END
  || '# ' || title || '  [' || type || ']' || chr(10) || 'tags: ' || array_to_string(tags, ', ')
  || CASE WHEN summary <> '' THEN chr(10) || chr(10) || summary ELSE '' END
  || chr(10) || chr(10) || 'sources: ' || split_part(id, ':', 1)
FROM r WHERE type IN ('glossary', 'page', 'api_object', 'controller')
   OR (type = 'concept' AND k <= 10)""")
def text_dumps(spark, sf_dir) -> DataFrame:
    tables = Tables(spark, sf_dir)
    evidence = refine.node_evidence(entity_nodes(tables, candidates=True))
    lines = exports.text_dumps(entity_nodes(tables), evidence, sample=10, corpus="K")
    return lines.select("type", "part", "line")


@query("gexf_elements", f"""
WITH {WEB_NODES_SQL}
SELECT 'node' AS kind, id AS key, '<node id="' || id || '" label="' || xt || '"><attvalues>'
       || '<attvalue for="type" value="page"/><attvalue for="section" value="' || xs || '"/>'
       || '<attvalue for="confidence" value="1.0"/></attvalues></node>' AS element
FROM (SELECT id,
        replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"',
                '&quot;') AS xt,
        replace(replace(replace(replace(section, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"',
                '&quot;') AS xs FROM w)
UNION ALL
SELECT 'edge', id || '|part_of|section:' || section,
       '<edge id="' || sha256(id || '|part_of|section:' || section) || '" source="' || id
       || '" target="section:' || section
       || '" type="directed" label="part_of" weight="2.5" confidence="1.0"/>' FROM w""")
def gexf_elements(spark, sf_dir) -> DataFrame:
    nodes = web_nodes(Tables(spark, sf_dir))
    edges = as_facts(s.edge_candidates(
        nodes, from_id=F.col("id"), to_id=F.concat(F.lit("section:"), "section"),
        type=F.lit("part_of"), weight=F.lit(2.5)))
    return exports.gexf_elements(nodes, edges)


@query("web_slugs", f"""
WITH {WEB_NODES_SQL} SELECT id, replace(id, ':', '-') AS slug, 'docs' AS section FROM w""")
def web_slugs(spark, sf_dir) -> DataFrame:
    nodes = web_nodes(Tables(spark, sf_dir))
    return nodes.select("id", t.node_slug(F.col("id")).alias("slug"),
                        select.section_for(F.col("type")).alias("section"))
