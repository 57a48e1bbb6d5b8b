"""Batch inference around a caller's function.

No model client lives here. Prompts are rows, answers are rows, and a callable
turns one into the other inside Spark tasks. Answers are cached in a table keyed
by a hash of the prompt, so a re-run only asks what is new.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema as s
from graphloom.functions.render import grounded_context, render_card
from graphloom.operators.refine import edge_evidence, merge_edges
from graphloom.operators.select import with_evidence
from graphloom.operators.skew import exact_rank, skewed_join, top_per_group
from graphloom.schema import Graph
from graphloom.seeds import CLUSTER_LABELS
from graphloom.session import stage

# The layout of an answer and the weight of model-made facts.
CARD = ("STRUCT<id: STRING, overview: STRING, why_it_matters: STRING, "
        "key_facts: ARRAY<STRING>, pitfalls: ARRAY<STRING>, related: ARRAY<STRING>>")
CARDS_ANSWER = f"STRUCT<cards: ARRAY<{CARD}>>"
CARD_TYPES = ["glossary", "page", "api_object"]
CARD_CONFIDENCE = 0.82
PREREQUISITE_CONFIDENCE = 0.7
LONG_BODY = 600
SHORT_SUMMARY = 40
SUMMARY_LENGTH = 200


def wants_card(types: Sequence[str] = CARD_TYPES) -> Column:
    """Nodes of the chosen types that have no long text of their own."""
    long = F.length(F.coalesce("body", F.lit(""))) > LONG_BODY
    return F.col("type").isin(list(types)) & ~long


def first_ranked(df: DataFrame, n: int | None) -> DataFrame:
    """The first ``n`` rows by ordinal (all for None) with a 0-based ``rank``.

    Ids are ranked alone and then joined, so texts are not sorted. Ids are unique.
    """
    ranked = exact_rank(df.select("id", "ord"), [], ["ord", "id"]).select(
        "id", (F.col("rank") - 1).alias("rank"))
    return df.join(ranked if n is None else ranked.filter(F.col("rank") < n), "id")


def cache_key(model: str, kind: str, prompt: Column) -> Column:
    return F.sha2(F.to_json(F.struct(
        F.lit(model).alias("model"), F.lit(kind).alias("kind"), prompt.alias("prompt"))), 256)


def synthesis_batches(nodes: DataFrame, model: str, batch_size: int = 10,
                      max_nodes: int | None = None, quotes: int = 3, quote_chars: int = 300,
                      body_chars: int = 1500) -> DataFrame:
    """(batch, size, prompt, cache_key): card requests for the nodes that want one.

    ``nodes`` carries ``provenance`` (see :func:`select.with_evidence`). Batches
    hold ``batch_size`` nodes in node order; the other numbers bound a prompt.
    """
    candidates = nodes.filter(wants_card()).select(
        "id", "ord", F.concat(
            F.lit("id="), F.col("id"), F.lit("\nConcept: "), F.col("title"), F.lit("\n"),
            grounded_context(F.col("title"), F.col("body"), F.col("provenance"), quotes, quote_chars,
                             body_chars)).alias("item"))
    ranked = first_ranked(candidates, max_nodes)
    batches = ranked.groupBy(F.floor(F.col("rank") / batch_size).alias("batch")).agg(
        F.array_sort(F.collect_list(F.struct("rank", "item"))).alias("items"))
    texts = F.transform("items", lambda i: i["item"])
    prompt = F.concat(
        F.lit("Write one card per concept, using only the quotes given.\n\n"),
        F.array_join(texts, "\n\n---\n\n"),
        F.lit("\n\nAnswer with JSON: an object with an array 'cards'; repeat each id. Cards: "),
        F.size("items").cast("string"))
    return batches.select("batch", F.size("items").alias("size"), prompt.alias("prompt")).withColumn(
        "cache_key", cache_key(model, "cards", F.col("prompt")))


def valid_cards(cards: Column) -> Column:
    """At least one card, and every card names its node."""
    return F.coalesce(
        (F.size(cards) > 0)
        & F.forall(cards, lambda c: F.coalesce(F.length(c["id"]) > 0, F.lit(False))),
        F.lit(False))


def uncached(batches: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests without a valid cached answer; ``cache`` has (cache_key, cards)."""
    answered = cache.filter(valid_cards(F.col("cards"))).select("cache_key")
    return batches.join(answered, "cache_key", "left_anti")


def run_batch_inference(requests: DataFrame, answer: Callable[[str], str | None],
                        key: str = "cache_key", prompt: str = "prompt") -> DataFrame:
    """(key, response): the caller's function applied to every prompt.

    A call that raises yields NULL, so one bad prompt never fails the job.
    Parallelism is the number of partitions.
    """
    def ask(text: str) -> str | None:
        try:
            return answer(text)
        except Exception:
            return None

    def run(frames: Iterator[pd.DataFrame]) -> Iterable[pd.DataFrame]:
        for frame in frames:
            responses = [ask(p) for p in frame[prompt]]
            yield pd.DataFrame({key: frame[key], "response": pd.Series(responses, dtype=object)})

    narrow = requests.select(key, prompt)
    return narrow.mapInPandas(run, schema=f"{key} STRING, response STRING")


def _json_part(response: Column) -> Column:
    """The JSON text of a response: the whole of it, else its outermost braces."""
    braces = F.regexp_extract(response, r"(?s)\{.*\}", 0)
    whole = F.try_parse_json(response).isNotNull()
    return F.when(whole, response).otherwise(braces)


def parse_cards(answers: DataFrame) -> DataFrame:
    """(cache_key, cards) from responses; unusable responses give NULL cards."""
    parsed = F.from_json(_json_part(F.col("response")), CARDS_ANSWER)
    return answers.select("cache_key", parsed["cards"].alias("cards"))


def card_rows(cards: DataFrame) -> DataFrame:
    """(card_ord, id, overview, ...): the cards of valid answers, one per row.

    ``cards`` has (batch, cards); an id answered twice keeps its last card.
    """
    rows = cards.filter(valid_cards(F.col("cards"))).select(
        "batch", F.posexplode("cards").alias("pos", "card"))
    last = rows.groupBy(F.col("card.id").alias("id")).agg(
        F.max_by("card", F.struct("batch", "pos")).alias("card"))
    return last.select("card.*")


def apply_cards(nodes: DataFrame, cards: DataFrame, model: str) -> DataFrame:
    """Nodes with the bodies of their cards; other nodes are unchanged.

    ``cards`` is unique by id. A card without content is ignored, and so is one
    for a node that did not want a card.
    """
    fields = ["overview", "why_it_matters", "key_facts", "pitfalls", "related"]
    given = cards.select("id", F.struct(*fields).alias("_card"))
    given = given.select("id", "_card", render_card(F.col("_card")).alias("_body"))
    joined = nodes.join(given.filter(F.col("_body") != ""), "id", "left")
    applies = F.col("_body").isNotNull() & wants_card()
    thin = F.length(F.coalesce("summary", F.lit(""))) < SHORT_SUMMARY
    overview = F.when(F.col("_card.overview") != "", F.col("_card.overview"))
    summary = F.substring(F.coalesce(overview, F.col("summary"), F.lit("")), 1, SUMMARY_LENGTH)
    flagged = joined.withColumn("_applies", applies)
    a = F.col("_applies")
    return flagged.select(*[
        {
            "summary": F.when(a & thin, summary).otherwise(F.col("summary")),
            "body": F.when(a, F.col("_body")).otherwise(F.col("body")),
            "body_trimmed": F.when(a, F.lit(False)).otherwise(F.col("body_trimmed")),
            "confidence": F.when(a, F.least("confidence", F.lit(CARD_CONFIDENCE)))
            .otherwise(F.col("confidence")),
            "derived_by": F.when(a, F.lit(f"ai:{model}")).otherwise(F.col("derived_by")),
        }.get(c, F.col(c)).alias(c)
        for c in nodes.columns
    ])


def prerequisite_requests(nodes: DataFrame, model: str, max_nodes: int | None = None,
                          allowed: int = 80) -> DataFrame:
    """(id, prompt, cache_key) for the glossary terms that have possible prerequisites.

    What may come before a term are the ``allowed`` terms that precede it most closely
    among those with one of its tags; that bounds the prompt. Terms are ranked within
    their tags over range-partitioned pieces and joined on (tag, rank), so a tag that
    most terms have yields ``allowed`` rows per term and no list of all its terms.
    """
    terms = nodes.filter(F.col("type") == "glossary").select("id", "title", "ord", "tags")
    if max_nodes is not None:
        terms = first_ranked(terms, max_nodes).drop("rank")
    tagged = terms.select("id", "ord", F.explode(F.array_distinct("tags")).alias("tag"))
    ranked = exact_rank(tagged, ["tag"], ["ord", "id"])
    back = F.explode(F.sequence(F.lit(1), F.lit(allowed)))
    wanted = ranked.select("id", "tag", "rank", back.alias("_back")).select(
        "id", "tag", (F.col("rank") - F.col("_back")).alias("rank")).filter(F.col("rank") > 0)
    earlier = ranked.select("tag", "rank", F.col("ord").alias("_ord"), F.col("id").alias("_term"))
    near = wanted.join(earlier, ["tag", "rank"]).select("id", "_ord", "_term").distinct()
    near = top_per_group(near, ["id"], [F.desc("_ord"), F.desc("_term")], allowed)
    short = F.substring_index("_term", ":", -1)
    listed = near.groupBy("id").agg(F.array_sort(F.collect_list(
        F.struct("_ord", "_term", short.alias("t")))).alias("terms"))  # ``allowed`` at most
    ids = F.array_join(F.transform("terms", lambda i: i["t"]), ", ")
    prompt = F.concat(
        F.lit("Which terms must be understood before this one? At most 3.\nConcept: "),
        F.col("title"), F.lit("\nAllowed ids: "), ids)
    return terms.join(listed, "id").select("id", prompt.alias("prompt")).withColumn(
        "cache_key", cache_key(model, "prerequisites", F.col("prompt")))


def prerequisite_suggestions(answers: DataFrame, nodes: DataFrame, model: str,
                             salts: int | None = None) -> DataFrame:
    """prerequisite -> term candidates from answers (id, prerequisites).

    Only known glossary terms other than the node itself count.
    """
    terms = nodes.filter(F.col("type") == "glossary").select("id", "title")
    wanted = answers.join(terms, "id").select(
        "id", "title", F.posexplode("prerequisites").alias("pos", "term_id"))
    known = terms.select(F.regexp_replace("id", "^[^:]*:", "").alias("term_id"),
                         F.col("id").alias("term_node"))
    linked = skewed_join(wanted, known, "term_id", "inner", salts, ["id", "pos"])
    return s.edge_candidates(
        linked.filter(F.col("term_node") != F.col("id")),
        from_id=F.col("term_node"), to_id=F.col("id"), type=F.lit("prerequisite_of"),
        label=F.lit("ai-suggested prerequisite"), confidence=F.lit(PREREQUISITE_CONFIDENCE),
        derived_by=F.lit(f"ai:{model}"),
        prov=s.provenance(F.lit(f"ai:{model}"), quote=F.concat(F.lit("prereq of "), "title")),
        ord=s.ordinal(s.PHASE_MODEL, "id", F.col("pos")),
    )


def unlabelled(nodes: DataFrame, labels: Sequence[str] = CLUSTER_LABELS,
               max_nodes: int | None = None) -> DataFrame:
    """The first nodes (all for None) that carry none of the topical labels."""
    known = F.array(*[F.lit(x) for x in labels])
    return first_ranked(nodes.filter(~F.arrays_overlap("tags", known)), max_nodes)


def label_requests(nodes: DataFrame, model: str, labels: Sequence[str] = CLUSTER_LABELS,
                   max_nodes: int | None = None) -> DataFrame:
    """(id, prompt, cache_key) for the nodes that have no topical label yet."""
    prompt = F.concat(F.lit("Assign 1 to 3 of the labels.\nConcept: "), F.col("title"),
                      F.lit("\nLabels: " + ", ".join(labels)))
    asked = unlabelled(nodes, labels, max_nodes)
    return asked.select("id", prompt.alias("prompt")).withColumn(
        "cache_key", cache_key(model, "labels", F.col("prompt")))


def apply_labels(nodes: DataFrame, answers: DataFrame,
                 labels: Sequence[str] = CLUSTER_LABELS) -> DataFrame:
    """Append the listed labels of answers (id, labels) that a node lacks."""
    known = F.array(*[F.lit(x) for x in labels])
    joined = nodes.join(answers.select("id", F.col("labels").alias("_labels")), "id", "left")
    new = F.array_except(F.array_intersect(F.coalesce("_labels", s.empty_array()), known), "tags")
    return joined.withColumn("tags", F.concat("tags", new)).select(*nodes.columns)


# -- passes ------------------------------------------------------------------

GraphPass = Callable[[Graph], Graph]


class PassRegistry:
    """Named graph-to-graph passes, run in the order they are asked for."""

    def __init__(self, passes: dict[str, GraphPass] | None = None) -> None:
        self._passes: dict[str, GraphPass] = dict(passes or {})

    def register(self, name: str, run: GraphPass) -> None:
        self._passes[name] = run

    def names(self) -> list[str]:
        return list(self._passes)

    def resolve(self, enabled: bool, chosen: str | None = None) -> list[str]:
        """No pass when disabled, all without a choice, else the known ones chosen."""
        if not enabled:
            return []
        if not chosen:
            return self.names()
        asked = [name.strip() for name in chosen.split(",")]
        return [name for name in asked if name in self._passes]

    def run(self, graph: Graph, enabled: bool, chosen: str | None = None) -> Graph:
        for name in self.resolve(enabled, chosen):
            graph = self._passes[name](graph)
        return graph


class AnswerCache:
    """Answers by ``cache_key``, each asked for once.

    ``rows`` (cache_key, response) may come from an earlier run and can be stored for the
    next one. Answers are staged as soon as they are given: whatever is read from them
    later, and however often, the model is not called again.
    """

    def __init__(self, spark: SparkSession, rows: DataFrame | None = None) -> None:
        self.rows = spark.createDataFrame([], "cache_key string, response string") \
            if rows is None else rows.select("cache_key", "response")

    def answers(self, requests: DataFrame, answer: Callable[[str], str | None]) -> DataFrame:
        """(cache_key, response) of all requests that have an answer."""
        distinct = requests.select("cache_key", "prompt").dropDuplicates(["cache_key"])
        fresh = distinct.join(self.rows.select("cache_key"), "cache_key", "left_anti")
        asked = stage(run_batch_inference(fresh, answer), "answers")
        # Without an answer the prompt is asked again next time.
        self.rows = self.rows.unionByName(asked.filter(F.col("response").isNotNull()))
        return requests.select("cache_key").distinct().join(self.rows, "cache_key")


def _answers(requests: DataFrame, responses: DataFrame, layout: str) -> DataFrame:
    parsed = F.from_json(_json_part(F.col("response")), layout)
    return requests.select("id", "cache_key").join(
        responses.select("cache_key", parsed.alias("a")), "cache_key").select("id", "a.*")


def model_passes(answer: Callable[[str], str | None], model: str, batch_size: int = 6,
                 cache: AnswerCache | None = None, max_nodes: int | None = None,
                 allowed: int = 80) -> PassRegistry:
    """The three model passes around one text-completion function.

    All wanting nodes are asked for unless ``max_nodes`` is given. With a ``cache`` only
    what it lacks is asked.
    """
    def given(graph: Graph, requests: DataFrame) -> DataFrame:
        nonlocal cache
        cache = cache or AnswerCache(graph.nodes.sparkSession)
        return cache.answers(requests, answer)

    def synthesis(graph: Graph) -> Graph:
        nodes = with_evidence(graph.nodes, graph.node_evidence, 3)
        batches = stage(synthesis_batches(nodes, model, batch_size, max_nodes), "requests")
        cards = parse_cards(given(graph, batches)).join(
            batches.select("cache_key", "batch"), "cache_key")
        return graph.with_(nodes=apply_cards(graph.nodes, card_rows(cards), model))

    def prerequisites(graph: Graph) -> Graph:
        requests = stage(prerequisite_requests(graph.nodes, model, max_nodes, allowed), "requests")
        answers = _answers(requests, given(graph, requests), "STRUCT<prerequisites: ARRAY<STRING>>")
        found = prerequisite_suggestions(answers, graph.nodes, model)
        merged = merge_edges(graph.edges.unionByName(s.as_facts(found), allowMissingColumns=True))
        return graph.with_(
            edges=merged, edge_evidence=graph.edge_evidence.unionByName(edge_evidence(found)))

    def clusters(graph: Graph) -> Graph:
        requests = stage(label_requests(graph.nodes, model, max_nodes=max_nodes), "requests")
        answers = _answers(requests, given(graph, requests), "STRUCT<labels: ARRAY<STRING>>")
        return graph.with_(nodes=apply_labels(graph.nodes, answers))

    return PassRegistry(
        {"synthesis": synthesis, "prerequisites": prerequisites, "clusters": clusters})
