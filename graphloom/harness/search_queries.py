"""Searches and questions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema as s
from graphloom.harness.base import (
    ENTITY_EDGES_SQL, ENTITY_NODES_SQL, SEEN_SQL, WEB_NODES_SQL, Tables, as_facts, entity_edges,
    entity_nodes, query, text_id, web_nodes)
from graphloom.operators import search
from graphloom.operators.skew import substring_pairs
from graphloom.seeds import QUESTION_STOP_WORDS

BOTH_SQL = f"WITH {ENTITY_NODES_SQL}, {ENTITY_EDGES_SQL}"
SEEN = f"{BOTH_SQL}, {SEEN_SQL}"
HAY_SQL = "lower(title || ' ' || summary || ' ' || array_to_string(tags, ' '))"
RELATION_SQL = """CASE type WHEN 'references' THEN 0 WHEN 'related_to' THEN 1 WHEN 'api_for' THEN 2
  WHEN 'owns' THEN 3 WHEN 'requires' THEN 4 WHEN 'prerequisite_of' THEN 5 ELSE 6 END"""
MATCH_SQL = """CASE type WHEN 'glossary' THEN 0 WHEN 'api_object' THEN 1 WHEN 'page' THEN 2
  WHEN 'concept' THEN 3 ELSE 4 END"""
_STOP = ", ".join(f"'{w}'" for w in QUESTION_STOP_WORDS)


def _graph(spark, sf_dir):
    tables = Tables(spark, sf_dir)
    return entity_nodes(tables), entity_edges(tables)


@query("best_matches", f"""
WITH {ENTITY_NODES_SQL}
SELECT id, type, title FROM n
WHERE contains(lower(title), 'hot gear') OR contains(lower(id), 'hot gear')
ORDER BY CASE WHEN lower(title) = 'hot gear' THEN 0 ELSE 1 END, {MATCH_SQL}, length(title), title,
         id LIMIT 5""")
def best_matches(spark, sf_dir) -> DataFrame:
    return search.best_matches(entity_nodes(Tables(spark, sf_dir)), "Hot Gear")


@query("related_to_term", f"""
{BOTH_SQL}, top AS (
  SELECT id FROM n WHERE contains(lower(title), 'nation_1') OR contains(lower(id), 'nation_1')
  ORDER BY CASE WHEN lower(title) = 'nation_1' THEN 0 ELSE 1 END, {MATCH_SQL}, length(title),
           title, id LIMIT 1)
SELECT e.from_id, f.title AS from_title, e.to_id, t.title AS to_title, e.type, e.label,
       e.confidence
FROM (SELECT *, {RELATION_SQL} AS rel FROM e) e JOIN n f ON f.id = from_id JOIN n t ON t.id = to_id
WHERE from_id = (SELECT id FROM top) OR to_id = (SELECT id FROM top)
ORDER BY rel, e.confidence DESC, from_id, e.type, to_id LIMIT 25""")
def related_to_term(spark, sf_dir) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return search.related_to_term(nodes, edges, "nation_1")


def _document_graph(spark, sf_dir):
    """Orders document their customers: api_for edges with a distinct title."""
    tables = Tables(spark, sf_dir)
    documents = as_facts(s.edge_candidates(
        tables.orders, from_id=text_id("order:", "o_orderkey"),
        to_id=text_id("customer:", "o_custkey"), type=F.lit("api_for"),
        ord=s.ordinal(1, s.sortable("o_orderkey"))))
    return entity_nodes(tables), documents


def _top_customer(term):
    return f"""top AS (
  SELECT 'customer:' || c_custkey AS id FROM customer WHERE contains(lower(c_name), '{term}')
  ORDER BY CASE WHEN lower(c_name) = '{term}' THEN 0 ELSE 1 END, length(c_name), c_name LIMIT 1)"""


@query("depends_on", f"""
WITH {_top_customer('customer#00000000')}
SELECT 'order ' || o_orderkey AS title, 'api_for' AS type FROM orders
WHERE 'customer:' || o_custkey = (SELECT id FROM top) ORDER BY title LIMIT 20""")
def depends_on(spark, sf_dir) -> DataFrame:
    nodes, edges = _document_graph(spark, sf_dir)
    return search.depends_on(nodes, edges, "Customer#00000000")


@query("depends_on_fallback", f"""
WITH {_top_customer('customer#000000003')}
SELECT n_name AS title, 'part_of' AS type FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE 'customer:' || c_custkey = (SELECT id FROM top)
UNION SELECT 'order ' || o_orderkey, 'prerequisite_of' FROM orders
WHERE 'customer:' || o_custkey = (SELECT id FROM top)
ORDER BY type, title LIMIT 20""")
def depends_on_fallback(spark, sf_dir) -> DataFrame:
    """Nothing of the listed types points at a customer here."""
    nodes, edges = _graph(spark, sf_dir)
    return search.depends_on(nodes, edges, "Customer#000000003")


@query("permissions", """
SELECT 'role:' || s_suppkey AS id, s_name AS title,
       CASE WHEN s_suppkey % 3 = 0 THEN 'core' ELSE 'g' || s_nationkey END AS api_group,
       array_to_string((['get', 'list', 'watch', 'create', 'update', 'patch', 'delete']
                        [1:1 + s_suppkey % 7])[1:6], ',') AS verbs
FROM supplier""")
def permissions(spark, sf_dir) -> DataFrame:
    suppliers = Tables(spark, sf_dir).supplier
    verbs = F.array(*[F.lit(v) for v in (
        "get", "list", "watch", "create", "update", "patch", "delete")])
    key = F.col("s_suppkey")
    group = F.when(key % 3 == 0, "").otherwise(text_id("g", "s_nationkey"))
    nodes = s.node_candidates(
        suppliers, id=text_id("role:", "s_suppkey"), type=F.lit("role"), title=F.col("s_name"),
        meta=s.meta(group=group, verbs=F.slice(verbs, F.lit(1), (key % 7 + 1).cast("int"))))
    return search.permissions(nodes)


KEYWORDS_SQL = f"""
k AS (
  SELECT DISTINCT item_id, keyword FROM (
    SELECT item_id, lower(trim(w, '?.,')) AS keyword
    FROM (SELECT item_id, unnest(regexp_split_to_array(replace(text, '/', ' '), '\\s+')) AS w
          FROM benchmark)
    WHERE length(w) > 2 AND lower(w) NOT IN ({_STOP}))
),
kk AS (SELECT * FROM k UNION ALL SELECT item_id, 'kubernetes' FROM benchmark
       WHERE item_id NOT IN (SELECT item_id FROM k)),
hits AS (
  SELECT DISTINCT item_id AS question_id, w.id, w.type, w.title, w.section
  FROM kk JOIN w ON contains(lower(w.title || chr(10) || w.summary), keyword)
),
first AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id
                           ORDER BY type, title, id)::INT AS rank FROM hits) WHERE rank <= 15
)"""


def _questions(spark, sf_dir):
    return Tables(spark, sf_dir).benchmark.select(
        F.col("item_id").alias("question_id"), F.col("text").alias("question"))


@query("keyword_search", f"""
WITH {WEB_NODES_SQL}, {KEYWORDS_SQL}
SELECT question_id, id, type, title, section, rank FROM first""")
def keyword_search(spark, sf_dir) -> DataFrame:
    return search.keyword_matches(web_nodes(Tables(spark, sf_dir)), _questions(spark, sf_dir))


@query("keyword_fallback", """
WITH first AS (SELECT 'part:' || p_partkey AS id, row_number() OVER (ORDER BY p_partkey)::INT AS rank
               FROM part)
SELECT n_nationkey AS question_id, id, rank FROM nation, first WHERE rank <= 15""")
def keyword_fallback(spark, sf_dir) -> DataFrame:
    """Questions that match nothing get the first glossary nodes."""
    tables = Tables(spark, sf_dir)
    questions = tables.nation.select(
        F.col("n_nationkey").alias("question_id"),
        F.concat(F.lit("zq0xj "), F.reverse("n_name"), F.lit("zq0xj")).alias("question"))
    return search.keyword_matches(entity_nodes(tables), questions).select(
        "question_id", "id", "rank")


@query("keyword_documents", """
WITH k AS (SELECT DISTINCT lower(p_type) AS word FROM part
           UNION SELECT lower(n_name) FROM nation
           UNION SELECT DISTINCT substr(lower(text), 1, 5) FROM benchmark)
SELECT doc_id, word FROM documents JOIN k ON contains(lower(text), word)""")
def keyword_documents(spark, sf_dir) -> DataFrame:
    """Words in whole document texts."""
    tables = Tables(spark, sf_dir)
    words = tables.part.select(F.lower("p_type").alias("word")).union(
        tables.nation.select(F.lower("n_name"))).union(
        tables.benchmark.select(F.substring(F.lower("text"), 1, 5))).distinct()
    texts = tables.spread("documents", "doc_id", "text").select(
        "doc_id", F.lower("text").alias("_text"))
    return substring_pairs(texts, "_text", words, "word").select("doc_id", "word")


@query("keyword_many", """
WITH k AS (SELECT DISTINCT unnest(string_split(lower(text), ' ')) AS word FROM benchmark
           UNION SELECT lower(c_name) FROM customer
           UNION SELECT lower(c_name) || ' x' FROM customer)
SELECT word, count(*)::BIGINT AS n, min(doc_id) AS first_doc
FROM documents JOIN k ON contains(lower(text), word) WHERE word <> '' GROUP BY word""")
def keyword_many(spark, sf_dir) -> DataFrame:
    """Thousands of words in whole document texts, through the gram index."""
    tables = Tables(spark, sf_dir)
    words = tables.benchmark.select(F.explode(F.split(F.lower("text"), " ")).alias("word")).union(
        tables.customer.select(F.lower("c_name"))).union(
        tables.customer.select(F.concat(F.lower("c_name"), F.lit(" x")))).distinct()
    texts = tables.spread("documents", "doc_id", "text").select(
        "doc_id", F.lower("text").alias("_text"))
    return substring_pairs(texts, "_text", words, "word", few=100).groupBy("word").agg(
        F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("first_doc"))


def _web_edges(tables):
    """Each page is followed by the next one; every page belongs to its section's first."""
    nodes = tables.pages
    following = F.concat(F.lit("page:"), s.sortable(F.col("page_id") + 1))
    own = F.concat(F.lit("page:"), s.sortable("page_id"))
    confidence = F.round(1 - (F.col("page_id") % 7) / 10, 1)
    chain = as_facts(s.edge_candidates(
        nodes, from_id=own, to_id=following, type=F.lit("links_to"), confidence=confidence,
        label=F.lit("next")))
    loop = as_facts(s.edge_candidates(
        nodes.filter(F.col("page_id") % 4 == 0), from_id=own, to_id=own, type=F.lit("related_to"),
        confidence=F.lit(0.5), label=F.lit("self")))
    return chain.unionByName(loop)


WEB_EDGES_SQL = """
we AS (
  SELECT 'page:' || lpad(page_id::VARCHAR, 19, '0') AS from_id,
         'page:' || lpad((page_id + 1)::VARCHAR, 19, '0') AS to_id, 'links_to' AS type,
         'next' AS label, round(1 - (page_id % 7) / 10, 1) AS confidence FROM pages
  UNION ALL SELECT 'page:' || lpad(page_id::VARCHAR, 19, '0'),
         'page:' || lpad(page_id::VARCHAR, 19, '0'), 'related_to', 'self', 0.5 FROM pages
  WHERE page_id % 4 = 0
),
ws AS (
  SELECT from_id AS id, to_id AS other_id, 'out' AS direction, type, label, confidence FROM we
  UNION ALL SELECT to_id, from_id, 'in', type, label, confidence FROM we WHERE from_id <> to_id
)"""


@query("keyword_walk", f"""
WITH {WEB_NODES_SQL}, {KEYWORDS_SQL}, {WEB_EDGES_SQL},
best AS (SELECT question_id, id, title AS hit_title FROM first WHERE rank = 1)
SELECT question_id, rank, x.id, hit_title, direction, x.type, other_id, o.title AS other_title,
       label, confidence
FROM (SELECT b.question_id, b.hit_title, ws.*, row_number() OVER (PARTITION BY question_id
        ORDER BY confidence DESC, other_id, type, direction)::INT AS rank
      FROM ws JOIN best b USING (id)) x
JOIN w o ON o.id = x.other_id WHERE rank <= 25""")
def keyword_walk(spark, sf_dir) -> DataFrame:
    tables = Tables(spark, sf_dir)
    return search.keyword_walk(web_nodes(tables), _web_edges(tables), _questions(spark, sf_dir))


@query("search_all", f"""
WITH {ENTITY_NODES_SQL}
SELECT id, title FROM n WHERE contains({HAY_SQL}, 'gear') AND contains({HAY_SQL}, 'brand#1')
ORDER BY phase, pos, id LIMIT 50""")
def search_all(spark, sf_dir) -> DataFrame:
    return search.search_all_terms(entity_nodes(Tables(spark, sf_dir)), " Gear brand#1 x ").select(
        "id", "title")


@query("search_hits", f"""
WITH {ENTITY_NODES_SQL}
SELECT id FROM n WHERE contains({HAY_SQL}, 'urgent') AND contains({HAY_SQL}, 'order')""")
def search_hits(spark, sf_dir) -> DataFrame:
    return search.search_hits(entity_nodes(Tables(spark, sf_dir)), "order URGENT").select("id")


@query("search_phrase", f"""
WITH {ENTITY_NODES_SQL}
SELECT id, title FROM n WHERE contains({HAY_SQL}, 'gear promo')
ORDER BY phase, pos, id LIMIT 40""")
def search_phrase(spark, sf_dir) -> DataFrame:
    return search.search_phrase(entity_nodes(Tables(spark, sf_dir)), "Gear PROMO ").select(
        "id", "title")


@query("title_filter", f"""
WITH {ENTITY_NODES_SQL}
SELECT id, title FROM n WHERE contains(lower(title), 'old') ORDER BY phase, pos, id LIMIT 220""")
def title_filter(spark, sf_dir) -> DataFrame:
    return search.title_filter(entity_nodes(Tables(spark, sf_dir)), "OLD").select("id", "title")


@query("seed_answer", f"""
WITH {ENTITY_NODES_SQL}
SELECT id, title FROM n WHERE contains(lower(title), 'order') OR contains(id, 'order')
ORDER BY phase, pos, id LIMIT 1""")
def seed_answer(spark, sf_dir) -> DataFrame:
    return search.seed_answer(entity_nodes(Tables(spark, sf_dir)), "order").select("id", "title")


@query("expand", f"""
{BOTH_SQL}
SELECT x.to_id, n.title AS to_title, x.type, x.label, x.confidence
FROM (SELECT * FROM e WHERE from_id = 'nation:2' ORDER BY phase, key, pos, type, to_id LIMIT 30) x
JOIN n ON n.id = x.to_id""")
def expand(spark, sf_dir) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return search.expand(edges, nodes, "nation:2")


@query("search_expanded", f"""
{SEEN}, hit AS (SELECT id FROM n WHERE contains({HAY_SQL}, 'red') AND contains({HAY_SQL}, 'rod'))
SELECT id, 'match' AS via FROM hit
UNION ALL SELECT DISTINCT other_id, 'neighbour' FROM seen
WHERE id IN (SELECT id FROM hit) AND other_id NOT IN (SELECT id FROM hit)""")
def search_expanded(spark, sf_dir) -> DataFrame:
    nodes, edges = _graph(spark, sf_dir)
    return search.search_expanded(nodes, edges, "red rod")
