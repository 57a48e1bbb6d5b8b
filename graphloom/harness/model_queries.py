"""Batch inference operators around a deterministic stand-in for a model."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom import schema as s
from graphloom.functions.render import grounded_context, render_card
from graphloom.harness.base import Tables, as_facts, query
from graphloom.operators import inference, refine, select
from graphloom.schema import Graph

MODEL = "stub"


def _candidates(spark, sf_dir):
    """Documents as nodes: four types, short titles, bodies as they are."""
    docs = Tables(spark, sf_dir).documents
    kind = F.when(F.col("lang") == "en", "page").when(F.col("lang") == "de", "glossary").when(
        F.col("lang") == "fr", "api_object").otherwise("concept")
    body = F.when(F.col("doc_id") % 3 == 0, F.lit("")).otherwise(F.col("text"))
    quoted = F.when(F.col("doc_id") % 2 == 0, F.col("text"))
    return s.node_candidates(
        docs, id=F.concat(F.substring("lang", 1, 2), F.lit(":"), F.col("doc_id").cast("string")),
        type=kind, title=F.concat(F.lit("Doc "), F.col("doc_id").cast("string")),
        summary=F.when(F.col("doc_id") % 5 == 0, F.col("text")).otherwise("short"),
        body=body, tags=F.array("source"),
        prov=s.provenance(F.col("source"), quote=quoted),
        ord=s.ordinal(1, s.sortable("doc_id")))


def _nodes(spark, sf_dir):
    return as_facts(_candidates(spark, sf_dir))


NODES_SQL = """
m AS (
  SELECT lang || ':' || doc_id AS id, doc_id, source, lang, 'Doc ' || doc_id AS title,
         CASE lang WHEN 'en' THEN 'page' WHEN 'de' THEN 'glossary' WHEN 'fr' THEN 'api_object'
              ELSE 'concept' END AS type,
         CASE WHEN doc_id % 5 = 0 THEN text ELSE 'short' END AS summary,
         CASE WHEN doc_id % 3 = 0 THEN '' ELSE text END AS body,
         CASE WHEN doc_id % 2 = 0 THEN text END AS quote
  FROM documents
),
ctx AS (
  SELECT *, CASE WHEN quote <> '' THEN 'Passages to rely on:'
              || chr(10) || '- "' || quote[1:300] || '" - from ' || source
            WHEN body <> '' THEN 'Text to rely on:' || chr(10) || body[1:1500]
            ELSE 'Only the title is known: ' || title END AS context,
         type <> 'concept' AND length(body) <= 600 AS wants
  FROM m
)"""


@query("grounded_context", f"WITH {NODES_SQL} SELECT id, context FROM ctx")
def grounded(spark, sf_dir) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    cited = select.with_evidence(as_facts(rows), refine.node_evidence(rows), 3)
    return cited.select("id", grounded_context(
        F.col("title"), F.col("body"), F.col("provenance")).alias("context"))


def _batches(spark, sf_dir):
    rows = _candidates(spark, sf_dir)
    cited = select.with_evidence(as_facts(rows), refine.node_evidence(rows), 3)
    return inference.synthesis_batches(cited, MODEL, batch_size=10)


BATCHES_SQL = f"""
{NODES_SQL},
ranked AS (
  SELECT *, row_number() OVER (ORDER BY doc_id) - 1 AS rank,
         'id=' || id || chr(10) || 'Concept: ' || title || chr(10) || context AS item
  FROM ctx WHERE wants
),
b AS (
  SELECT (rank // 10)::BIGINT AS batch, count(*)::INT AS size,
         'Write one card per concept, using only the quotes given.' || chr(10) || chr(10)
         || string_agg(item, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank)
         || chr(10) || chr(10)
         || 'Answer with JSON: an object with an array ''cards''; repeat each id. Cards: '
         || count(*) AS prompt
  FROM ranked GROUP BY 1
)"""


@query("synth_batches", f"WITH {BATCHES_SQL} SELECT batch, size, sha256(prompt) AS prompt_hash FROM b")
def synth_batches(spark, sf_dir) -> DataFrame:
    return _batches(spark, sf_dir).select(
        "batch", "size", F.sha2("prompt", 256).alias("prompt_hash"))


@query("uncached", f"WITH {BATCHES_SQL} SELECT batch FROM b WHERE batch % 4 <> 0")
def uncached(spark, sf_dir) -> DataFrame:
    """Every fourth batch has a valid answer; others have empty or nameless cards."""
    batches = _batches(spark, sf_dir)
    which = F.col("batch") % 4
    card_id = F.when(which == 0, "x").when(which == 1, "")
    card = F.struct(card_id.alias("id"))
    cards = F.when(which == 3, F.array().cast("array<struct<id:string>>")).otherwise(F.array(card))
    cache = batches.filter(which != 2).select("cache_key", cards.alias("cards"))
    return inference.uncached(batches, cache).select("batch")


def answer_cards(prompt: str) -> str | None:
    """A stand-in model: a card per id, wrapped in chatter; some ids break it."""
    ids = re.findall(r"^id=(.+)$", prompt, re.MULTILINE)
    if any(i.endswith("9") for i in ids):
        raise ValueError("refused")
    cards = [{"id": i, "overview": f" About {i} ", "key_facts": ["a", "", i],
              "related": ["x", "y"] if i.endswith("1") else []} for i in ids]
    return "Here you are: " + json.dumps({"cards": cards}) + " done"


def _requests(spark, sf_dir):
    nodes = _nodes(spark, sf_dir)
    return nodes.filter(inference.wants_card()).select(
        F.col("id").alias("cache_key"), F.concat(F.lit("id="), "id").alias("prompt"))


CARDS_SQL = """
cards AS (
  SELECT *, ' About ' || id || ' ' AS overview,
         'About ' || id || chr(10) || chr(10) || '**Key facts**' || chr(10) || '- a' || chr(10)
         || '- ' || id || CASE WHEN id LIKE '%1'
           THEN chr(10) || chr(10) || '**Related**' || chr(10) || 'x, y' ELSE '' END AS card_body
  FROM ctx WHERE wants AND id NOT LIKE '%9'
)"""


@query("batch_inference", f"""
WITH {NODES_SQL}, {CARDS_SQL}
SELECT ctx.id AS cache_key, cards.id AS card_id, cards.overview,
       CASE WHEN cards.id IS NOT NULL THEN 'a,,' || cards.id END AS key_facts
FROM ctx LEFT JOIN cards USING (id) WHERE ctx.wants""")
def batch_inference(spark, sf_dir) -> DataFrame:
    answers = inference.run_batch_inference(_requests(spark, sf_dir), answer_cards)
    parsed = inference.parse_cards(answers).select("cache_key", F.get("cards", F.lit(0)).alias("c"))
    return parsed.select("cache_key", F.col("c.id").alias("card_id"), "c.overview",
                         F.array_join("c.key_facts", ",").alias("key_facts"))


def _cards(spark, sf_dir):
    answers = inference.run_batch_inference(_requests(spark, sf_dir), answer_cards)
    parsed = inference.parse_cards(answers)
    return inference.card_rows(parsed.select(F.col("cache_key").alias("batch"), "cards"))


@query("render_card", f"WITH {NODES_SQL}, {CARDS_SQL} SELECT id, card_body AS body FROM cards")
def render_cards(spark, sf_dir) -> DataFrame:
    cards = _cards(spark, sf_dir)
    return cards.select("id", render_card(F.struct(*cards.columns)).alias("body"))


@query("apply_cards", f"""
WITH {NODES_SQL}, {CARDS_SQL}
SELECT m.id, coalesce(card_body, m.body) AS body,
       CASE WHEN card_body IS NOT NULL AND length(m.summary) < 40 THEN overview ELSE m.summary END
       AS summary,
       CASE WHEN card_body IS NOT NULL THEN 0.82::DOUBLE ELSE 1.0::DOUBLE END AS confidence,
       CASE WHEN card_body IS NOT NULL THEN 'ai:stub' ELSE 'deterministic' END AS derived_by
FROM m LEFT JOIN cards USING (id)""")
def apply_cards(spark, sf_dir) -> DataFrame:
    nodes = inference.apply_cards(_nodes(spark, sf_dir), _cards(spark, sf_dir), MODEL)
    return nodes.select("id", "body", "summary", "confidence", "derived_by")


ALLOWED_SQL = """
g AS (
  SELECT id, title, doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r
  FROM m WHERE type = 'glossary'),
allowed AS (
  SELECT g.id, any_value(g.title) AS title, min_by(p.id, p.doc_id) AS first,
         string_agg(p.doc_id::VARCHAR, ', ' ORDER BY p.doc_id) AS ids
  FROM g JOIN g p ON p.source = g.source AND p.r BETWEEN g.r - 80 AND g.r - 1 GROUP BY g.id)"""


@query("prereq_requests", f"""
WITH {NODES_SQL}, {ALLOWED_SQL}
SELECT id, 'Which terms must be understood before this one? At most 3.' || chr(10) || 'Concept: '
       || title || chr(10) || 'Allowed ids: ' || ids AS prompt FROM allowed""")
def prereq_requests(spark, sf_dir) -> DataFrame:
    return inference.prerequisite_requests(_nodes(spark, sf_dir), MODEL).select("id", "prompt")


@query("prereq_suggest", f"""
WITH {NODES_SQL}, g AS (SELECT * FROM m WHERE type = 'glossary'),
a AS (SELECT id, title, 0 AS pos, doc_id // 2 AS want FROM g
      UNION ALL SELECT id, title, 1, doc_id FROM g
      UNION ALL SELECT id, title, 2, doc_id + 4 FROM g)
SELECT p.id AS from_id, a.id AS to_id, 0.7::DOUBLE AS confidence, 'ai:stub' AS derived_by,
       'ai-suggested prerequisite' AS label, 'prereq of ' || a.title AS quote, pos::BIGINT AS pos
FROM a JOIN g p ON p.doc_id = want WHERE p.id <> a.id""")
def prereq_suggest(spark, sf_dir) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    key = F.substring_index("id", ":", -1).cast("bigint")
    wanted = F.array(F.floor(key / 2), key, key + 4).cast("array<string>")
    answers = nodes.filter(F.col("type") == "glossary").select("id", wanted.alias("prerequisites"))
    found = inference.prerequisite_suggestions(answers, nodes, MODEL)
    return found.select("from_id", "to_id", "confidence", "derived_by", "label",
                        F.col("prov.quote").alias("quote"), "ord.pos")


LABELS = ["src1", "src2", "src3", "networking", "api"]


@query("unlabelled", f"""
WITH {NODES_SQL} SELECT id, row_number() OVER (ORDER BY doc_id) - 1 AS rank FROM m
WHERE source NOT IN ('src1', 'src2', 'src3')""")
def unlabelled(spark, sf_dir) -> DataFrame:
    return inference.unlabelled(_nodes(spark, sf_dir), LABELS).select("id", "rank")


@query("label_requests", f"""
WITH {NODES_SQL}
SELECT id, 'Assign 1 to 3 of the labels.' || chr(10) || 'Concept: ' || title || chr(10)
       || 'Labels: src1, src2, src3, networking, api' AS prompt
FROM m WHERE source NOT IN ('src1', 'src2', 'src3')""")
def label_requests(spark, sf_dir) -> DataFrame:
    return inference.label_requests(_nodes(spark, sf_dir), MODEL, LABELS).select("id", "prompt")


@query("cluster_labels", f"""
WITH {NODES_SQL}
SELECT id, source || CASE WHEN doc_id % 2 = 0 THEN
         CASE WHEN source <> 'src1' THEN ',api,src1' ELSE ',api' END ELSE '' END AS tags FROM m""")
def cluster_labels(spark, sf_dir) -> DataFrame:
    nodes = _nodes(spark, sf_dir)
    even = F.substring_index("id", ":", -1).cast("bigint") % 2 == 0
    labels = F.array(F.lit("api"), F.lit("bogus"), F.lit("src1"), F.lit("api"))
    answers = nodes.filter(even).select("id", labels.alias("labels"))
    tagged = inference.apply_labels(nodes, answers, LABELS)
    return tagged.select("id", F.array_join("tags", ",").alias("tags"))


def answer_all(prompt: str) -> str | None:
    """One stand-in for all three passes, told apart by their prompts."""
    if prompt.startswith("Write one card"):
        ids = re.findall(r"^id=(.+)$", prompt, re.MULTILINE)
        return json.dumps({"cards": [{"id": i, "overview": f"About {i}"} for i in ids]})
    if prompt.startswith("Which terms"):
        listed = prompt.rsplit("Allowed ids: ", 1)[1].split(", ")
        return json.dumps({"prerequisites": listed[:1]})
    return json.dumps({"labels": ["api", "unknown"]})


PASSES_SQL = f"""
WITH {NODES_SQL}, {ALLOWED_SQL}
SELECT 'node' AS item, id AS a, CASE WHEN wants THEN 'ai:stub' ELSE 'deterministic' END AS b,
       source || ',api' AS c FROM ctx
UNION ALL SELECT 'edge', first, id, 'ai:stub' FROM allowed"""


@query("model_passes", PASSES_SQL)
def model_passes(spark, sf_dir) -> DataFrame:
    """All registered passes on a graph, one after the other."""
    return _passed(spark, sf_dir, inference.AnswerCache(spark))


@query("model_passes_cached", PASSES_SQL)
def model_passes_cached(spark, sf_dir) -> DataFrame:
    """The passes again, with a model that refuses and the answers of the first run."""
    cache = inference.AnswerCache(spark)
    _passed(spark, sf_dir, cache)

    def refuse(prompt: str) -> str | None:
        raise ValueError("asked again")

    return _passed(spark, sf_dir, inference.AnswerCache(spark, cache.rows), refuse)


def _passed(spark, sf_dir, cache, answer=answer_all) -> DataFrame:
    rows = _candidates(spark, sf_dir)
    graph = Graph(
        nodes=as_facts(rows), edges=spark.createDataFrame([], s.EDGES),
        node_evidence=refine.node_evidence(rows),
        edge_evidence=spark.createDataFrame([], s.EDGE_EVIDENCE))
    done = inference.model_passes(answer, MODEL, cache=cache).run(graph, enabled=True)
    nodes = done.nodes.select(F.lit("node").alias("item"), F.col("id").alias("a"),
                              F.col("derived_by").alias("b"), F.array_join("tags", ",").alias("c"))
    edges = done.edges.select(F.lit("edge").alias("item"), F.col("from_id").alias("a"),
                              F.col("to_id").alias("b"), F.col("derived_by").alias("c"))
    return nodes.unionByName(edges)
