"""Builders, rule passes, merging and pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema as s
from graphloom.functions import text as t
from graphloom.harness.base import (
    ENTITY_EDGES_SQL, ENTITY_NODES_SQL, SUPPLY_SQL, WEB_SQL, Tables, as_facts,
    entity_edges, entity_nodes, padded, query, supply_candidates, text_id,
    web_docs, web_terms)
from graphloom.operators import builders as b
from graphloom.operators import refine, rules, select
from graphloom.plans.compile import CompileOptions, compile_graph
from graphloom.sources.corpus import corpus_from_table

EDGE_COLUMNS = ["from_id", "to_id", "type", "label", "weight", "confidence", "derived_by",
                "n_prov"]


# -- document and page builders ----------------------------------------------


@query("reference_edges", f"""
WITH {WEB_SQL}
SELECT 'page:' || lpad(page_id::VARCHAR, 19, '0') AS from_id, 'gloss:' || term AS to_id,
       'references' AS type, term AS label, 1.0::DOUBLE AS weight, 1.0::DOUBLE AS confidence,
       'deterministic' AS derived_by, count(*)::BIGINT AS n_prov
FROM links SEMI JOIN terms USING (term) GROUP BY page_id, term""")
def reference_edges(spark, sf_dir) -> DataFrame:
    docs = web_docs(Tables(spark, sf_dir))
    return refine.merge_edges(b.reference_edges(docs, web_terms(docs))).select(*EDGE_COLUMNS)


@query("reference_evidence", f"""
WITH {WEB_SQL}
SELECT 'page:' || lpad(page_id::VARCHAR, 19, '0') AS from_id, 'gloss:' || term AS to_id, pos,
       lpad(page_id::VARCHAR, 19, '0') || '.md' AS source, url, term AS quote
FROM links SEMI JOIN terms USING (term)""")
def reference_evidence(spark, sf_dir) -> DataFrame:
    docs = web_docs(Tables(spark, sf_dir))
    found = refine.edge_evidence(b.reference_edges(docs, web_terms(docs)))
    return found.select("from_id", "to_id", "ord.pos", "source", "url", "quote")


@query("dangling_terms", f"""
WITH {WEB_SQL}
SELECT lpad(page_id::VARCHAR, 19, '0') || '.md' AS rel_path, pos, term AS term_id
FROM links ANTI JOIN (SELECT DISTINCT regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS term
                      FROM pages) USING (term)""")
def dangling_terms(spark, sf_dir) -> DataFrame:
    docs = web_docs(Tables(spark, sf_dir))
    # Known are the terms that some page's address has as its section.
    known = docs.select(F.col("section").alias("term_id"),
                        F.concat(F.lit("gloss:"), "section").alias("term_node")).distinct()
    return b.dangling_terms(docs, known).select("rel_path", "pos", "term_id")


def _linked_docs(spark, sf_dir, body):
    docs = Tables(spark, sf_dir).documents
    path = F.concat(F.col("doc_id").cast("string"), F.lit(".md"))
    return corpus_from_table(docs, path, body, section=F.col("lang"))


def _definition_docs(spark, sf_dir):
    body = F.concat(F.lit('{{< glossary_definition term_id="'), F.col("source"),
                    F.lit('" >}} {{< glossary_definition term_id="'), F.col("lang"),
                    F.lit('" >}} '), F.col("text"))
    return _linked_docs(spark, sf_dir, body)


@query("define_edges", """
SELECT 'page:' || doc_id AS from_id, 'gloss:' || source AS to_id, 'defines' AS type,
       1::BIGINT AS n_prov, 0::BIGINT AS pos
FROM documents WHERE source IN (SELECT source FROM documents WHERE n_chars > 5000)""")
def define_edges(spark, sf_dir) -> DataFrame:
    docs = _definition_docs(spark, sf_dir)
    long = Tables(spark, sf_dir).documents.filter(F.col("n_chars") > 5000)
    terms = long.select(F.col("source").alias("term_id"),
                        F.concat(F.lit("gloss:"), "source").alias("term_node")).distinct()
    merged = refine.merge_edges(b.define_edges(docs, terms))
    return merged.select("from_id", "to_id", "type", "n_prov", "ord.pos")


def _link_docs(spark, sf_dir):
    key = F.col("doc_id")
    body = F.concat(
        F.lit("[x](/docs/"), (key * 3).cast("string"), F.lit("/) [y](/docs/"),
        F.floor(key / 3).cast("string"), F.lit(".md#part) "), F.col("text"))
    return _linked_docs(spark, sf_dir, body)


LINKS_SQL = """
l AS (
  SELECT doc_id, 0 AS pos, '/docs/' || (doc_id * 3) || '/' AS target,
         doc_id * 3 AS goal FROM documents
  UNION ALL SELECT doc_id, 1, '/docs/' || (doc_id // 3) || '.md', doc_id // 3 FROM documents
)"""


@query("link_edges", f"""
WITH {LINKS_SQL}
SELECT 'page:' || l.doc_id AS from_id, 'page:' || goal AS to_id, 'links_to' AS type,
       arg_min(target, pos) AS label, count(*)::BIGINT AS n_prov
FROM l SEMI JOIN documents d ON d.doc_id = goal GROUP BY l.doc_id, goal""")
def link_edges(spark, sf_dir) -> DataFrame:
    docs = _link_docs(spark, sf_dir)
    merged = refine.merge_edges(b.link_edges(docs, docs))
    return merged.select("from_id", "to_id", "type", "label", "n_prov")


@query("dangling_links", f"""
WITH {LINKS_SQL}
SELECT l.doc_id || '.md' AS rel_path, pos, target, goal || '.md' AS target_path
FROM l ANTI JOIN documents d ON d.doc_id = goal""")
def dangling_links(spark, sf_dir) -> DataFrame:
    docs = _link_docs(spark, sf_dir)
    return b.dangling_links(docs, docs).select("rel_path", "pos", "target", "target_path")


HEADINGS_SQL = r"""
h AS (
  SELECT page_id, regexp_replace(unnest(found), '^[\s\p{Z}]+|[\s\p{Z}]+$', '', 'g') AS heading,
         generate_subscripts(found, 1) - 1 AS pos
  FROM (SELECT page_id, list_concat(
          regexp_extract_all(html, '<h1>([^<\n]*[^<\s][^<\n]*)</h1>', 1),
          regexp_extract_all(html, '<a href="[^"]*">([^<\n]*[^<\s][^<\n]*)</a>', 1)) AS found
        FROM pages)
),
hs AS (
  SELECT *, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug FROM (
    SELECT *, trim(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM h
    WHERE heading <> '')
)"""


def _heading_docs(spark, sf_dir):
    """Whole pages, their headings and link texts written as Markdown headings."""
    text = r"([^<\n]*[^<\s][^<\n]*)"
    body = F.regexp_replace("html", f"<h1>{text}</h1>", "\n## $1\n")
    body = F.regexp_replace(body, f'<a href="[^"]*">{text}</a>', "\n### $1\n")
    return Tables(spark, sf_dir).spread("pages").select(
        F.concat(padded("page_id"), F.lit(".md")).alias("rel_path"), "url",
        F.regexp_extract("url", "^https?://[^/]+/([^/?#]*)", 1).alias("section"),
        body.alias("body_raw"))


@query("concepts", f"""
WITH {HEADINGS_SQL}
SELECT 'concept:' || slug AS id, arg_min(heading, row(page_id, pos)) AS title,
       arg_min(lpad(page_id::VARCHAR, 19, '0') || '.md', row(page_id, pos)) AS source,
       1::BIGINT AS n_prov
FROM hs GROUP BY slug""")
def concepts(spark, sf_dir) -> DataFrame:
    found = b.concept_nodes(b.headings(_heading_docs(spark, sf_dir)))
    nodes = refine.dedupe_nodes(found)
    evidence = refine.node_evidence(found).select("id", "source")
    return nodes.join(evidence, "id").select("id", "title", "source", "n_prov")


@query("part_of", f"""
WITH {HEADINGS_SQL}
SELECT 'page:' || lpad(page_id::VARCHAR, 19, '0') AS from_id, 'concept:' || slug AS to_id,
       'part_of' AS type, 'describes' AS label, count(*)::BIGINT AS n_prov,
       min(pos)::BIGINT AS first_pos
FROM hs GROUP BY page_id, slug""")
def part_of(spark, sf_dir) -> DataFrame:
    merged = refine.merge_edges(b.part_of_edges(b.headings(_heading_docs(spark, sf_dir))))
    return merged.select("from_id", "to_id", "type", "label", "n_prov",
                         F.col("ord.pos").alias("first_pos"))


# -- API descriptions --------------------------------------------------------


def _part_definitions(spark, sf_dir):
    """One definition per part, named after its brand, size and kind of thing."""
    kind = F.replace(F.initcap("p_name"), F.lit(" "), F.lit(""))
    name = F.concat(F.lit("io.store."), F.lower(F.replace("p_brand", F.lit("#"), F.lit(""))),
                    F.lit(".v"), F.col("p_size").cast("string"), F.lit("."), kind)
    definition = F.concat(
        F.lit('{"description":"'), F.col("p_type"),
        F.lit('","properties":{"price":{"type":"number"},"zone":{},"area":{"$ref":"#/x/Y"}'),
        F.when(F.col("p_size") % 2 == 0, F.lit(',"even":{"items":[1,{"a":"}"}]}')).otherwise(""),
        F.lit("}}"))
    return Tables(spark, sf_dir).part.select(
        F.col("p_partkey").alias("def_ord"), name.alias("name"), definition.alias("definition"))


PART_DEFINITIONS_SQL = """
d AS (
  SELECT p_partkey, p_size, p_type, lower(replace(p_brand, '#', '')) AS grp,
         upper(split_part(p_name, ' ', 1)[1:1]) || split_part(p_name, ' ', 1)[2:]
         || upper(split_part(p_name, ' ', 2)[1:1]) || split_part(p_name, ' ', 2)[2:] AS kind
  FROM part
)"""


@query("api_objects", f"""
WITH {PART_DEFINITIONS_SQL}
SELECT 'api:' || kind AS id, kind AS title, arg_min(p_type, p_partkey) AS summary,
       arg_min(grp, p_partkey) AS api_group, arg_min('v' || p_size, p_partkey) AS api_version,
       arg_min('price,zone,area' || CASE WHEN p_size % 2 = 0 THEN ',even' ELSE '' END,
               p_partkey) AS fields,
       arg_min(CASE WHEN p_size % 2 = 0 THEN 4 ELSE 3 END, p_partkey) AS field_count,
       arg_min('io.store.' || grp || '.v' || p_size || '.' || kind, p_partkey) AS def_name,
       (count(*) - 1)::BIGINT AS duplicates, count(*)::BIGINT AS n_prov
FROM d GROUP BY kind""")
def api_objects(spark, sf_dir) -> DataFrame:
    nodes = refine.dedupe_nodes(b.api_object_nodes(_part_definitions(spark, sf_dir)))
    return nodes.select(
        "id", "title", "summary", F.col("meta.group").alias("api_group"), "meta.api_version",
        F.array_join("meta.fields", ",").alias("fields"), "meta.field_count", "meta.def_name",
        "duplicates", "n_prov")


def _operations(spark, sf_dir):
    parts = Tables(spark, sf_dir).part
    methods = F.array(*[F.lit(m) for m in ("GET", "post", "parameters", "delete")])
    brand = F.lower(F.replace("p_brand", F.lit("#"), F.lit("")))
    thing = F.substring_index("p_name", " ", -1)
    prefix = F.when(F.col("p_size") % 3 == 0, F.lit("/api/v1/")).otherwise(
        F.concat(F.lit("/apis/"), brand, F.lit("/v1/")))
    path = F.concat(prefix, F.col("p_partkey").cast("string"), F.lit("/"), thing,
                    F.lit(".x-y(z)/{name}"))
    name = F.when(F.col("p_size") % 2 == 0, F.concat(F.lit("op"), F.col("p_partkey").cast("string")))
    return parts.select(
        F.col("p_partkey").alias("path_ord"), F.lit(0).alias("op_ord"), path.alias("path"),
        F.get(methods, (F.col("p_partkey") % 4).cast("int")).alias("method"),
        name.alias("operation_id"), F.col("p_type").alias("description"))


OPERATIONS_SQL = """
o AS (
  SELECT p_partkey, p_size, p_type,
         ['GET', 'post', 'parameters', 'delete'][p_partkey % 4 + 1] AS raw,
         CASE WHEN p_size % 3 = 0 THEN 'core' ELSE lower(replace(p_brand, '#', '')) END AS tag,
         CASE WHEN p_size % 3 = 0 THEN '/api/v1/' ELSE '/apis/' || lower(replace(p_brand, '#', ''))
              || '/v1/' END || p_partkey || '/' || split_part(p_name, ' ', 2)
              || '.x-y(z)/{name}' AS path,
         upper(split_part(p_name, ' ', 2)[1:1]) || split_part(p_name, ' ', 2)[2:] AS kind
  FROM part
)"""


@query("api_paths", f"""
WITH {OPERATIONS_SQL}
SELECT 'apipath:' || lower(raw) || ' ' || path AS id,
       CASE WHEN p_size % 2 = 0 THEN 'op' || p_partkey ELSE raw || ' ' || path END AS title,
       p_type AS summary, upper(raw) || ' ' || path AS body, tag, lower(raw) AS method, kind
FROM o WHERE raw <> 'parameters'""")
def api_paths(spark, sf_dir) -> DataFrame:
    nodes = b.api_path_nodes(b.api_paths(_operations(spark, sf_dir)))
    return nodes.select("id", "title", "summary", "body", F.array_join("tags", ",").alias("tag"),
                        "meta.method", "meta.kind")


@query("path_exposes", f"""
WITH {OPERATIONS_SQL}
SELECT 'apipath:' || lower(raw) || ' ' || path AS from_id, 'api:' || kind AS to_id,
       'exposes API object' AS label
FROM o WHERE raw <> 'parameters' AND kind IN (
  SELECT upper(word[1:1]) || word[2:]
  FROM (SELECT split_part(p_name, ' ', 1 + p_size % 2) AS word FROM part))""")
def path_exposes(spark, sf_dir) -> DataFrame:
    word = F.split_part("p_name", F.lit(" "), 1 + F.col("p_size") % 2)
    definitions = Tables(spark, sf_dir).part.select(
        F.col("p_partkey").alias("def_ord"),
        F.concat(F.lit("io.x.v1."), F.initcap(word)).alias("name"))
    paths = b.api_paths(_operations(spark, sf_dir))
    edges = b.path_exposes_edges(paths, b.api_kinds(definitions))
    return edges.select("from_id", "to_id", "label")


@query("type_refs", """
SELECT 'api:Order' || o_orderkey AS from_id, 'api:Customer' || o_custkey AS to_id,
       'references type' AS label, 'io.c.v1.Customer' || o_custkey AS quote
FROM orders""")
def type_refs(spark, sf_dir) -> DataFrame:
    tables = Tables(spark, sf_dir)
    buyer = F.concat(F.lit('{"$ref":"#/definitions/io.c.v1.Customer'),
                     F.col("o_custkey").cast("string"), F.lit('"}'))
    own = F.concat(F.lit('{"$ref" : "#/definitions/io.o.v1.Order'),
                   F.col("o_orderkey").cast("string"), F.lit('"}'))
    orders = tables.orders.select(
        F.col("o_orderkey").alias("def_ord"), text_id("io.o.v1.Order", "o_orderkey").alias("name"),
        F.concat(F.lit('{"properties":{"by":'), buyer, F.lit(',"again":{"items":'), buyer,
                 F.lit('},"self":'), own,
                 F.lit(',"none":{"$ref":"#/definitions/io.x.Missing"}}}')).alias("definition"))
    customers = tables.customer.select(
        (F.col("c_custkey") + F.lit(1 << 40)).alias("def_ord"),
        text_id("io.c.v1.Customer", "c_custkey").alias("name"), F.lit("{}").alias("definition"))
    definitions = orders.unionByName(customers)
    edges = b.type_ref_edges(definitions, b.api_kinds(definitions))
    return edges.select("from_id", "to_id", "label", F.col("prov.quote").alias("quote"))


@query("title_kind_match", f"""
WITH {WEB_SQL},
k AS (SELECT term AS kind, min(page_id) AS def_ord FROM links GROUP BY term)
SELECT 'page:' || p.page_id AS from_id,
       'api:' || arg_min(kind, row(def_ord, kind)) AS to_id, 'api_for' AS type
FROM (SELECT page_id, lower(regexp_extract(html, '<title>([^<]*)</title>', 1)) AS title
      FROM pages) p JOIN k ON contains(p.title, lower(k.kind))
GROUP BY p.page_id""")
def title_kind_match(spark, sf_dir) -> DataFrame:
    tables = Tables(spark, sf_dir)
    pages = tables.pages.select(
        text_id("page:", "page_id").alias("id"), "url",
        F.concat(padded("page_id"), F.lit(".md")).alias("rel_path"),
        F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"))
    named = tables.pages.select("page_id", F.explode(
        t.extract_links(F.col("html"), t.HTML_LINK)).alias("path"))
    kinds = named.groupBy(F.substring("path", 2, 1 << 30).alias("kind")).agg(
        F.min("page_id").alias("def_ord"))
    return b.api_for_edges(pages, kinds).select("from_id", "to_id", "type")


# -- rule passes -------------------------------------------------------------


def _customer_name(key):
    return F.concat(F.lit("Customer#"), F.lpad(key.cast("string"), 9, "0"))


@query("ownership", f"""
SELECT 'customer:' || c_custkey AS from_id, 'customer:' || (c_custkey // 2) AS to_id,
       'owns' AS type,
       'Customer#' || lpad((c_custkey // 2)::VARCHAR, 9, '0') || ' owns/manages ' || c_name
       AS label
FROM customer WHERE c_custkey % 5 <> 0""")
def ownership(spark, sf_dir) -> DataFrame:
    tables = Tables(spark, sf_dir)
    key = F.col("c_custkey")
    parent = F.when(key % 5 == 0, F.lit("nobody")).otherwise(
        _customer_name(F.floor(key / 2)))
    chain = tables.customer.select(key.alias("rule_ord"), F.col("c_name").alias("child"),
                                   parent.alias("parent"))
    objects = rules.objects_by_title(entity_nodes(tables))
    return rules.ownership_edges(objects, chain).select("from_id", "to_id", "type", "label")


@query("rbac_roles", """
SELECT 'role:' || lower(replace(p_name, ' ', '')) || p_size AS id,
       'permissions:' || lower(replace(p_name, ' ', '')) || p_size AS title,
       'rbac,' || arg_min(grp, p_partkey) AS tags,
       arg_min(verbs, p_partkey) AS verbs, (count(*) - 1)::BIGINT AS duplicates
FROM (SELECT *, CASE WHEN p_partkey % 2 = 0 THEN 'core' ELSE p_type END AS grp,
      CASE WHEN p_size > 25 THEN 'get,list,watch' ELSE 'get,list' END AS verbs FROM part)
GROUP BY 1, 2""")
def rbac_roles(spark, sf_dir) -> DataFrame:
    parts = Tables(spark, sf_dir).part
    verbs = F.array(F.lit("get"), F.lit("list"))
    seed = parts.select(
        F.col("p_partkey").alias("rule_ord"),
        F.concat(F.lower(F.replace("p_name", F.lit(" "), F.lit(""))),
                 F.col("p_size").cast("string")).alias("resource"),
        F.when(F.col("p_partkey") % 2 == 0, F.lit("")).otherwise(F.col("p_type")).alias("api_group"),
        F.when(F.col("p_size") > 25, F.array_append(verbs, F.lit("watch"))).otherwise(verbs)
        .alias("verbs"))
    nodes = refine.dedupe_nodes(rules.rbac_roles(seed))
    return nodes.select("id", "title", F.array_join("tags", ",").alias("tags"),
                        F.array_join("meta.verbs", ",").alias("verbs"), "duplicates")


@query("requires", """
SELECT 'role:' || lower(c_name) || CASE WHEN c_custkey % 2 = 0 THEN 'ss' ELSE '' END AS from_id,
       'customer:' || c_custkey AS to_id, 'required to manage ' || c_name AS label
FROM customer WHERE c_custkey % 3 <> 0""")
def requires(spark, sf_dir) -> DataFrame:
    tables = Tables(spark, sf_dir)
    key = F.col("c_custkey")
    name = F.lower("c_name")
    resource = F.when(key % 3 == 0, F.concat(F.lit("no"), name)).otherwise(name)
    seed = tables.customer.select(
        key.alias("rule_ord"),
        F.concat(resource, F.when(key % 2 == 0, "ss").otherwise("")).alias("resource"))
    objects = rules.objects_by_title(entity_nodes(tables), F.lower("title"))
    return rules.requires_edges(seed, objects).select("from_id", "to_id", "label")


@query("components", """
SELECT 'ctrl:' || s_name AS from_id,
       'ctrl:Supplier#' || lpad((s_suppkey // 3)::VARCHAR, 9, '0') AS to_id,
       CASE WHEN s_suppkey // 3 = 0 THEN 'controls' ELSE 'links_to' END AS type,
       'nation ' || s_nationkey AS label
FROM supplier WHERE s_suppkey % 4 <> 0""")
def components(spark, sf_dir) -> DataFrame:
    key = F.col("s_suppkey")
    target = F.concat(F.lit("Supplier#"), F.lpad(F.floor(key / 3).cast("string"), 9, "0"))
    seed = Tables(spark, sf_dir).supplier.select(
        key.alias("rule_ord"), F.col("s_name").alias("component"),
        F.when(key % 4 == 0, F.lit("elsewhere")).otherwise(target).alias("target"),
        F.concat(F.lit("nation "), F.col("s_nationkey").cast("string")).alias("label"))
    edges = rules.component_edges(seed, hub="Supplier#000000000")
    return edges.select("from_id", "to_id", "type", "label")


def _event_steps(spark, sf_dir):
    return Tables(spark, sf_dir).events.select(
        F.col("user_id").cast("string").alias("user_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("step"),
        F.col("event_type").alias("actor"), F.col("props").alias("description"))


@query("flow_chain", """
SELECT user_id::VARCHAR AS user_id, step, 'flow:' || previous AS from_id,
       'flow:' || event_type AS to_id, props AS quote
FROM (SELECT user_id, event_type, props, epoch_us(ts) AS step,
        lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) AS previous FROM events)
WHERE previous IS NOT NULL""")
def flow_chain(spark, sf_dir) -> DataFrame:
    edges = rules.flow_edges(_event_steps(spark, sf_dir), ["user_id"])
    return edges.select(F.col("ord.doc").alias("user_id"), F.col("ord.pos").alias("step"),
                        "from_id", "to_id", F.col("prov.quote").alias("quote"))


@query("flow_graph", """
SELECT 'flow:' || previous AS from_id, 'flow:' || role AS to_id, 'then' AS label,
       count(*)::BIGINT AS n_prov
FROM (SELECT role, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS previous
      FROM conversations) WHERE previous IS NOT NULL GROUP BY 1, 2, 3""")
def flow_graph(spark, sf_dir) -> DataFrame:
    steps = Tables(spark, sf_dir).conversations.select(
        F.col("conv_id").cast("string").alias("conv_id"), F.col("turn").alias("step"),
        F.col("role").alias("actor"), F.col("text").alias("description"))
    merged = refine.merge_edges(rules.flow_edges(steps, ["conv_id"]))
    return merged.select("from_id", "to_id", "label", "n_prov")


@query("flow_actors", """
SELECT 'flow:' || event_type AS id, 'kubectl apply: ' || event_type AS title,
       arg_min(props, ts) AS summary, min(epoch_us(ts)) AS first_step
FROM events GROUP BY event_type""")
def flow_actors(spark, sf_dir) -> DataFrame:
    nodes = rules.flow_nodes(_event_steps(spark, sf_dir))
    return nodes.select("id", "title", "summary",
                        F.col("ord.doc").cast("bigint").alias("first_step"))


TAG_RULES = {"alpha": ["tion", "the "], "beta": ["der", "und"], "gamma": ["ción"], "en": ["re"]}


def _tag_nodes(spark, sf_dir):
    docs = Tables(spark, sf_dir).documents
    return docs.select("doc_id", F.col("text").alias("title"),
                       F.col("source").alias("summary"),
                       F.array("lang", "source").alias("tags"))


DOMAIN_TAGS_SQL = """
tagged AS (
  SELECT doc_id, concat_ws(',', lang, source,
    CASE WHEN contains(x, 'tion') OR contains(x, 'the ') THEN 'alpha' END,
    CASE WHEN contains(x, 'der') OR contains(x, 'und') THEN 'beta' END,
    CASE WHEN contains(x, 'ción') THEN 'gamma' END,
    CASE WHEN contains(x, 're') AND lang <> 'en' THEN 'en' END) AS tags
  FROM (SELECT doc_id, lang, source,
          lower(text || ' ' || source || ' ' || lang || ' ' || source) AS x FROM documents)
)"""


@query("domain_tags", f"WITH {DOMAIN_TAGS_SQL} SELECT doc_id, tags FROM tagged")
def domain_tags(spark, sf_dir) -> DataFrame:
    tagged = rules.tag_by_keywords(_tag_nodes(spark, sf_dir), TAG_RULES)
    return tagged.select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("domain_tags_table", """
WITH r AS (
  SELECT * FROM (VALUES ('alpha', 1, 'tion'), ('alpha', 1, 'the '), ('beta', 2, 'der'), ('beta', 2, 'und'),
                        ('gamma', 3, 'ción'), ('en', 4, 're')) v(domain, rank, keyword)
  UNION ALL SELECT lower(n_name), 10 + n_nationkey, lower(substr(n_name, 1, 3)) FROM nation),
d AS (
  SELECT doc_id, [lang, source] AS own,
         lower(text || ' ' || source || ' ' || lang || ' ' || source) AS x FROM documents),
f AS (
  SELECT doc_id, own, domain, min(rank) AS rank FROM d JOIN r ON contains(x, keyword)
  WHERE NOT list_contains(own, domain) GROUP BY ALL)
SELECT doc_id, concat_ws(',', array_to_string(any_value(d.own), ','),
                         string_agg(domain, ',' ORDER BY rank, domain)) AS tags
FROM d LEFT JOIN f USING (doc_id) GROUP BY doc_id""")
def domain_tags_table(spark, sf_dir) -> DataFrame:
    """Rules as rows: those of the rule table and one for each nation."""
    listed = spark.createDataFrame(
        [(d, k + 1, w) for k, (d, words) in enumerate(TAG_RULES.items()) for w in words],
        "domain string, rank int, keyword string")
    named = Tables(spark, sf_dir).nation.select(
        F.lower("n_name"), (F.col("n_nationkey") + 10).cast("int"), F.lower(F.substring("n_name", 1, 3)))
    tagged = rules.tag_by_rules(_tag_nodes(spark, sf_dir), listed.union(named))
    return tagged.select("doc_id", F.array_join("tags", ",").alias("tags"))


@query("tag_filter", f"""
WITH {DOMAIN_TAGS_SQL} SELECT doc_id FROM tagged WHERE ',' || tags || ',' LIKE '%,beta,%'""")
def tag_filter(spark, sf_dir) -> DataFrame:
    tagged = rules.tag_by_keywords(_tag_nodes(spark, sf_dir), TAG_RULES)
    return select.with_tag(tagged, "beta").select("doc_id")


# -- merging and pruning -----------------------------------------------------


@query("merge_edges", f"""
WITH {SUPPLY_SQL}
SELECT from_id, to_id, type, label, weight, confidence, derived_by, n_prov FROM m""")
def merge_edges(spark, sf_dir) -> DataFrame:
    return refine.merge_edges(supply_candidates(Tables(spark, sf_dir))).select(*EDGE_COLUMNS)


@query("merge_again", f"""
WITH {SUPPLY_SQL}
SELECT from_id, to_id, type, label, weight, confidence, derived_by, n_prov FROM m""")
def merge_again(spark, sf_dir) -> DataFrame:
    """Two halves merged first, then merged with each other."""
    rows = supply_candidates(Tables(spark, sf_dir))
    half = F.col("ord.pos") % 2 == 0
    parts = refine.merge_edges(rows.filter(half)).unionByName(
        refine.merge_edges(rows.filter(~half)))
    return refine.merge_edges(parts).drop("ord", "best_ord")


@query("edge_evidence", """
SELECT 'part:' || l_partkey AS from_id, 'supplier:' || l_suppkey AS to_id,
       lpad(l_orderkey::VARCHAR, 19, '0') AS doc, l_linenumber::BIGINT AS pos,
       'lineitem' AS source, l_orderkey::VARCHAR AS quote
FROM lineitem""")
def edge_evidence(spark, sf_dir) -> DataFrame:
    found = refine.edge_evidence(supply_candidates(Tables(spark, sf_dir)))
    return found.select("from_id", "to_id", "ord.doc", "ord.pos", "source", "quote")


def _buyers(tables):
    """A candidate node per order, keyed by customer: many duplicates."""
    return s.node_candidates(
        tables.orders,
        id=text_id("customer:", "o_custkey"), type=F.lit("api_object"),
        title=F.col("o_orderpriority"), tags=F.array("o_orderstatus"),
        prov=s.provenance(F.lit("orders"), quote=F.col("o_orderkey").cast("string")),
        ord=s.ordinal(1, padded("o_orderkey")))


@query("dedupe_nodes", """
SELECT 'customer:' || o_custkey AS id, arg_min(o_orderpriority, o_orderkey) AS title,
       arg_min(o_orderstatus, o_orderkey) AS tag, (count(*) - 1)::BIGINT AS duplicates,
       count(*)::BIGINT AS n_prov
FROM orders GROUP BY o_custkey""")
def dedupe_nodes(spark, sf_dir) -> DataFrame:
    nodes = refine.dedupe_nodes(_buyers(Tables(spark, sf_dir)))
    return nodes.select("id", "title", F.array_join("tags", ",").alias("tag"), "duplicates",
                        "n_prov")


@query("node_evidence", """
SELECT 'customer:' || o_custkey AS id, 'orders' AS source, o_orderkey::VARCHAR AS quote
FROM orders""")
def node_evidence(spark, sf_dir) -> DataFrame:
    return refine.node_evidence(_buyers(Tables(spark, sf_dir))).select("id", "source", "quote")


def _rich(nodes, tables):
    """Nodes without the suppliers whose balance is negative."""
    poor = tables.supplier.filter(F.col("s_acctbal") < 0).select(
        text_id("supplier:", "s_suppkey").alias("id"))
    return nodes.join(poor, "id", "left_anti")


@query("dangling_drop", f"""
WITH {ENTITY_EDGES_SQL},
gone AS (SELECT 'supplier:' || s_suppkey AS id FROM supplier WHERE s_acctbal < 0)
SELECT from_id, to_id, type FROM e
WHERE from_id NOT IN (SELECT id FROM gone) AND to_id NOT IN (SELECT id FROM gone)""")
def dangling_drop(spark, sf_dir) -> DataFrame:
    tables = Tables(spark, sf_dir)
    nodes = _rich(entity_nodes(tables), tables)
    kept = refine.drop_dangling_edges(entity_edges(tables), nodes)
    return kept.select("from_id", "to_id", "type")


@query("orphans", f"""
WITH {ENTITY_NODES_SQL},
x AS (SELECT 'part:' || l_partkey AS a, 'supplier:' || l_suppkey AS b FROM lineitem
      WHERE l_discount > 0.095)
SELECT id, type FROM n
WHERE id IN (SELECT a FROM x) OR id IN (SELECT b FROM x) OR meta_group IS NOT NULL
   OR (type = 'api_path' AND pos % 2 = 0) OR (type = 'page')""")
def orphans(spark, sf_dir) -> DataFrame:
    tables = Tables(spark, sf_dir)
    rows = entity_nodes(tables, candidates=True)
    even = (F.col("type") == "api_path") & (F.col("ord.doc").cast("bigint") % 2 == 0)
    body = F.when(even, F.repeat(F.lit("x"), 41)).otherwise(F.repeat(F.lit("x"), 40))
    source = F.when(F.col("type") == "page", F.lit("swagger.json")).otherwise(F.lit("table"))
    rows = rows.withColumns({"body": body, "prov": F.col("prov").withField("source", source)})
    few = supply_candidates(tables).filter(F.col("confidence") < 1 - 0.095)
    kept = refine.drop_orphans(as_facts(rows), few, refine.node_evidence(rows))
    return kept.select("id", "type")


# -- the whole job -----------------------------------------------------------


def document_corpus(spark, sf_dir, topic=None) -> DataFrame:
    """Documents as a Markdown corpus with front matter, shortcodes and links.

    Every source gets one glossary document, its first; the others are pages. ``topic``
    is put behind the titles of pages.
    """
    docs = Tables(spark, sf_dir).spread("documents")
    first = docs.groupBy("source").agg(F.min("doc_id").alias("doc_id")).withColumn(
        "is_term", F.lit(True))
    marked = docs.join(first.drop("source"), "doc_id", "left")
    key = F.col("doc_id").cast("string")
    term = F.coalesce("is_term", F.lit(False))
    path = F.when(term, F.concat(F.lit("reference/glossary/"), "source", F.lit(".md"))).otherwise(
        F.concat("lang", F.lit("/"), key, F.lit(".md")))
    front = F.concat(
        F.lit('---\ntitle: "'), F.when(term, F.col("source")).otherwise(
            F.concat(F.lit("Doc "), key, F.lit("") if topic is None else topic)), F.lit('"\ndescription: about '), "source",
        F.lit("\nshort_description: term "), "source", F.lit("\ntags:\n- "), "lang",
        F.lit("\n---\n"))
    body = F.concat(
        F.lit('Uses {{< glossary_tooltip text="it" term_id="'), "source",
        F.lit('" >}} and [that](/docs/'), "lang", F.lit("/"),
        F.floor(F.col("doc_id") / 2).cast("string"), F.lit("/).\n## About "), "source",
        F.lit("\n{{% note %}}"), "source", F.lit("{{% /note %}}\n"), "text")
    return corpus_from_table(marked, path, F.concat(front, body))


COMPILE_SQL = """
WITH terms AS (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source),
pages AS (SELECT d.* FROM documents d ANTI JOIN terms USING (doc_id)),
counts AS (
  SELECT 'references' AS type, count(*) AS n FROM pages
  UNION ALL SELECT 'links_to', count(*) FROM pages p JOIN pages q
    ON q.doc_id = p.doc_id // 2 AND q.lang = p.lang
)
SELECT 'edge' AS item, type, n::BIGINT AS n FROM counts
UNION ALL SELECT 'node', 'page', count(*) FROM pages
UNION ALL SELECT 'node', 'glossary', count(*) FROM terms
UNION ALL SELECT 'node', 'role', 16
UNION ALL SELECT 'node', 'controller', 5"""


@query("compile_documents", COMPILE_SQL)
def compile_documents(spark, sf_dir) -> DataFrame:
    """Corpus to graph; the counts that do not depend on headings inside the texts."""
    graph = compile_graph(spark, document_corpus(spark, sf_dir),
                          options=CompileOptions(version="harness"))
    nodes = graph.nodes.filter(F.col("type").isin("page", "glossary", "role", "controller"))
    edges = graph.edges.filter(F.col("type").isin("references", "links_to")).filter(
        F.startswith(F.col("from_id"), F.lit("page:")))
    parts = [df.groupBy("type").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit(item).alias("item"), "type", "n") for item, df in (("node", nodes), ("edge", edges))]
    return parts[0].unionByName(parts[1])




def _nation_spec(spark, sf_dir):
    """An API description of one file per nation: the nation, its region, and a path."""
    name = F.replace(F.lower("n_name"), F.lit(" "), F.lit(""))
    kind = F.initcap(name)
    region = F.concat(F.lit("io.geo.v1.Region"), F.col("n_regionkey").cast("string"))
    nation = F.concat(
        F.lit('{"description":"'), F.col("n_name"),
        F.lit('","properties":{"region":{"$ref":"#/definitions/'), region, F.lit('"}}}'))
    operations = F.concat(
        F.lit('{"get":{"operationId":"read'), kind, F.lit('","description":"reads '), name,
        F.lit('"},"delete":{"description":"drops '), name, F.lit('"},"parameters":[]}'))
    return Tables(spark, sf_dir).nation.select(
        F.concat("n_name", F.lit(".json")).alias("spec_file"),
        F.create_map(F.concat(F.lit("io.geo.v1."), kind), nation,
                     region, F.lit('{"description":"region"}')).alias("definitions"),
        F.create_map(F.concat(F.lit("/apis/geo/v1/"), name, F.lit("/{name}")),
                     operations).alias("paths"))


def _compiled(spark, sf_dir):
    """Documents about regions and the description of the regions' API, compiled."""
    topic = F.concat(F.lit(" on Region"), (F.col("doc_id") % 5).cast("string"))
    return compile_graph(spark, document_corpus(spark, sf_dir, topic), _nation_spec(spark, sf_dir),
                         CompileOptions(version="harness"))


COMPILED_SQL = r"""
terms AS (SELECT source, min(doc_id) AS doc_id FROM documents GROUP BY source),
pages AS (SELECT d.*, lang || '/' || d.doc_id AS path FROM documents d ANTI JOIN terms USING (doc_id)),
found AS (
  SELECT path, list_concat(regexp_extract_all(body, '(?m)^##[\s\p{Z}]+(.+?)[\s\p{Z}]*$', 1),
                           regexp_extract_all(body, '(?m)^###[\s\p{Z}]+(.+?)[\s\p{Z}]*$', 1)) AS found
  FROM (SELECT path, '## About ' || source || chr(10) || text AS body FROM pages)),
h AS (SELECT path, unnest(found) AS heading, generate_subscripts(found, 1) AS pos FROM found),
hs AS (
  SELECT *, CASE WHEN s = '' THEN 'untitled' ELSE s END AS slug
  FROM (SELECT *, trim(regexp_replace(lower(heading), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM h)),
api AS (SELECT n_name, n_regionkey, replace(lower(n_name), ' ', '') AS name,
               upper(n_name[1:1]) || replace(lower(n_name), ' ', '')[2:] AS kind FROM nation),
ops AS (SELECT name, kind, unnest(['get', 'delete']) AS method FROM api)"""


@query("compile_nodes", f"""
WITH {COMPILED_SQL}
SELECT 'page:' || path AS id, 'page' AS type, 'Doc ' || doc_id || ' on Region' || doc_id % 5 AS title,
       'about ' || source AS summary, 1::BIGINT AS n_prov FROM pages
UNION ALL SELECT 'gloss:' || source, 'glossary', source, 'term ' || source, 1 FROM terms
UNION ALL SELECT 'concept:' || slug, 'concept', arg_min(heading, row(path || '.md', pos)), '', 1
FROM hs GROUP BY slug
UNION ALL SELECT 'api:' || kind, 'api_object', kind, n_name, 1 FROM api
UNION ALL SELECT 'api:Region' || n_regionkey, 'api_object', 'Region' || n_regionkey, 'region', count(*)
FROM api GROUP BY n_regionkey
UNION ALL SELECT 'apipath:' || method || ' /apis/geo/v1/' || name || '/{{name}}', 'api_path',
       CASE method WHEN 'get' THEN 'read' || kind ELSE 'delete /apis/geo/v1/' || name || '/{{name}}' END,
       CASE method WHEN 'get' THEN 'reads ' ELSE 'drops ' END || name, 1 FROM ops""")
def compile_nodes(spark, sf_dir) -> DataFrame:
    """All nodes that documents and the API description give; rule tables have queries of their own."""
    nodes = _compiled(spark, sf_dir).nodes.filter(
        ~F.col("type").isin("role", "controller") & ~F.startswith(F.col("id"), F.lit("flow:")))
    return nodes.select("id", "type", "title", "summary", "n_prov")


@query("compile_edges", f"""
WITH {COMPILED_SQL}
SELECT 'page:' || path AS from_id, 'gloss:' || source AS to_id, 'references' AS type, 'it' AS label,
       1::BIGINT AS n_prov FROM pages
UNION ALL SELECT 'page:' || p.path, 'page:' || q.path, 'links_to', '/docs/' || q.path || '/', 1
FROM pages p JOIN pages q ON q.doc_id = p.doc_id // 2 AND q.lang = p.lang
UNION ALL SELECT 'page:' || path, 'concept:' || slug, 'part_of', 'describes', count(*)
FROM hs GROUP BY path, slug
UNION ALL SELECT 'page:' || path, 'api:Region' || doc_id % 5, 'api_for', 'documents API object', 1
FROM pages WHERE doc_id % 5 IN (SELECT n_regionkey FROM api)
UNION ALL SELECT 'api:' || kind, 'api:Region' || n_regionkey, 'related_to', 'references type', 1 FROM api
UNION ALL SELECT 'apipath:' || method || ' /apis/geo/v1/' || name || '/{{name}}', 'api:' || kind,
       'related_to', 'exposes API object', 1 FROM ops""")
def compile_edges(spark, sf_dir) -> DataFrame:
    """All edges from documents and the API description, not those among rule tables' nodes."""
    kinds = ("page", "api", "apipath")
    edges = _compiled(spark, sf_dir).edges.filter(
        F.substring_index("from_id", ":", 1).isin(*kinds))
    return edges.select("from_id", "to_id", "type", "label", "n_prov")
