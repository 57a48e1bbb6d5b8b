"""Questions over the graph: matching, walking, searching."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.select import (
    both_directions, edge_view, edges_of_types, neighbors, nodes_by_type, priority,
    relation_priority)
from graphloom.operators.skew import skewed_join, small, substring_pairs, top_per_group
from graphloom.seeds import (
    DEPENDENT_TYPES, MATCH_TYPE_ORDER, QUESTION_STOP_WORDS, WALK_TYPE_ORDER)


def _has(text: Column, needle: str) -> Column:
    """Case-insensitive substring test."""
    return F.contains(F.lower(text), F.lit(needle.lower()))


# -- related to a term -------------------------------------------------------


def best_matches(nodes: DataFrame, term: str, limit: int = 5) -> DataFrame:
    """Nodes whose title or id contains the term, best match first."""
    exact = F.when(F.lower("title") == term.lower(), 0).otherwise(1)
    found = nodes.filter(_has(F.col("title"), term) | _has(F.col("id"), term))
    order = [exact, priority(F.col("type"), MATCH_TYPE_ORDER), F.length("title"),
             F.col("title"), F.col("id")]
    return found.select("id", "type", "title").orderBy(*order).limit(limit)


def _touching(edges: DataFrame, one: DataFrame) -> DataFrame:
    """Edges from or to the single node in ``one`` (id); a self-loop counts once."""
    hint = small(one)
    out = edges.join(hint.select(F.col("id").alias("from_id")), "from_id", "left_semi")
    into = edges.filter(~F.col("from_id").eqNullSafe(F.col("to_id"))).join(
        hint.select(F.col("id").alias("to_id")), "to_id", "left_semi")
    return out.unionByName(into)


def related_to_term(nodes: DataFrame, edges: DataFrame, term: str, k: int = 25) -> DataFrame:
    """The edges of the best match, ranked by relation type, then confidence."""
    top = best_matches(nodes, term, 1).select("id")
    view = edge_view(_touching(edges, top), nodes)
    order = [relation_priority(F.col("type")), F.desc("confidence"), "from_id", "type", "to_id"]
    return view.orderBy(*order).limit(k)


def depends_on(nodes: DataFrame, edges: DataFrame, kind: str, k: int = 20) -> DataFrame:
    """What depends on an API object: distinct (title, type) of incoming edges.

    When nothing points at it, what the object itself points to is listed.
    """
    objects = nodes_by_type(nodes, "api_object")
    top = best_matches(objects, kind, 1).select("id")
    one = small(top)
    to_it = one.select(F.col("id").alias("to_id"))
    from_it = one.select(F.col("id").alias("from_id"))
    titles = nodes.select("id", "title")

    def listed(found: DataFrame, end: str) -> DataFrame:
        ends = titles.withColumnRenamed("id", end)
        return found.join(ends, end).select("title", "type").distinct()

    dependants = listed(
        edges_of_types(edges, *DEPENDENT_TYPES).join(to_it, "to_id", "left_semi"), "from_id")
    targets = listed(edges.join(from_it, "from_id", "left_semi"), "to_id")
    has_dependants = dependants.limit(1).select(F.lit(1).alias("_one"))
    fallback = targets.withColumn("_one", F.lit(1)).join(
        F.broadcast(has_dependants), "_one", "left_anti").drop("_one")
    return dependants.unionByName(fallback).orderBy("type", "title").limit(k)


def permissions(nodes: DataFrame, verbs: int = 6) -> DataFrame:
    """Roles by title with their group and first verbs."""
    group = F.when(F.coalesce(F.col("meta.group"), F.lit("")) == "", "core").otherwise(
        F.col("meta.group"))
    return nodes_by_type(nodes, "role").select(
        "id", "title", group.alias("api_group"),
        F.array_join(F.slice("meta.verbs", 1, verbs), ",").alias("verbs"),
    ).orderBy("title", "id")


# -- keyword questions -------------------------------------------------------


def question_keywords(question: Column, stop_words: Sequence[str] = QUESTION_STOP_WORDS,
                      fallback: str = "kubernetes") -> Column:
    """The distinct search words of a question.

    Words of up to two letters and stop words (compared as written, punctuation
    included) are left out; without any word left, ``fallback`` is searched.
    """
    words = F.split(F.replace(question, F.lit("/"), F.lit(" ")), r"(?U)\s+")
    kept = F.filter(
        words, lambda w: (F.length(w) > 2) & ~F.lower(w).isin(list(stop_words)))
    clean = F.array_distinct(F.transform(kept, lambda w: F.lower(F.trim(w, F.lit("?.,")))))
    return F.when(F.size(clean) > 0, clean).otherwise(F.array(F.lit(fallback)))


def keyword_matches(nodes: DataFrame, questions: DataFrame, k: int = 15,
                    fallback_type: str | None = "glossary") -> DataFrame:
    """The first ``k`` nodes, by type and title, that contain a question's keyword.

    ``questions`` has (question_id, question). The distinct keywords are matched once for
    all questions. A question that matches nothing gets the first nodes, by ordinal, of
    ``fallback_type``.
    """
    asked = questions.select(
        "question_id", F.explode(question_keywords(F.col("question"))).alias("keyword"))
    shown = ["id", "type", "title", "section"]
    order = [F.asc("type"), F.asc("title"), F.asc("id")]
    texts = nodes.select(*shown, F.lower(
        F.concat_ws("\n", "title", F.coalesce("summary", F.lit("")))).alias("_text"))
    words = asked.select("keyword").distinct()
    pairs = substring_pairs(texts, "_text", words, "keyword").drop("_text")
    # The first k of a question are among the first k of its keywords, so a word
    # that every node contains brings k rows to the questions that ask for it.
    best = top_per_group(pairs, ["keyword"], order, k).drop("rank")
    hits = asked.join(best, "keyword").select("question_id", *shown)
    # An empty keyword ("...") matches everything, as LIKE '%%' does.
    whole = asked.filter(F.col("keyword") == "").select("question_id")
    hits = hits.unionByName(_with_first(whole, nodes.select(*shown), order, k)).distinct()
    ranked = top_per_group(hits, ["question_id"], order, k)
    if fallback_type is None:
        return ranked
    unmet = questions.select("question_id").join(hits, "question_id", "left_anti")
    place = [c for c in ("ord",) if c in nodes.columns]
    first = nodes.filter(F.col("type") == fallback_type).select(*shown, *place)
    listed = _with_first(unmet, first, [F.asc(c) for c in (*place, "id")], k)
    return ranked.unionByName(listed.select(
        "question_id", *shown, F.row_number().over(
            Window.partitionBy("question_id").orderBy(*place, "id")).alias("rank")))


def _with_first(questions: DataFrame, nodes: DataFrame, order: Sequence[Column],
                k: int) -> DataFrame:
    """Every question with the same first ``k`` nodes: one short array, no join."""
    first = nodes.orderBy(*order).limit(k).agg(
        F.collect_list(F.struct(*nodes.columns)).alias("all")).scalar()
    return questions.select("question_id", F.explode(first).alias("_n")).select(
        "question_id", "_n.*")


def keyword_walk(nodes: DataFrame, edges: DataFrame, questions: DataFrame, hits: int = 15,
                 k: int = 25) -> DataFrame:
    """Per question, the edges around its best hit.

    The best hit is the one of the preferred type among the first ``hits``.
    """
    found = keyword_matches(nodes, questions, hits)
    order = F.struct(priority(F.col("type"), WALK_TYPE_ORDER), F.col("rank"))
    best = found.groupBy("question_id").agg(
        F.min_by(F.struct("id", "title"), order).alias("b")).select(
        "question_id", F.col("b.id").alias("id"), F.col("b.title").alias("hit_title"))
    seen = both_directions(edges).filter(~(
        (F.col("direction") == "in") & (F.col("id") == F.col("other_id"))))
    # Cut each hit's edges to k first: many questions may share one hub.
    hit_ids = best.select("id").distinct()
    near = top_per_group(
        skewed_join(seen, hit_ids, "id", "left_semi", salt_by=["other_id"]), ["id"],
        [F.desc("confidence"), F.asc("other_id"), F.asc("type"), F.asc("direction")], k)
    top = near.join(best, "id")
    titles = nodes.select(F.col("id").alias("other_id"), F.col("title").alias("other_title"))
    return skewed_join(top, titles, "other_id", "inner", salt_by=["question_id", "rank"]).select(
        "question_id", "rank", "id", "hit_title", "direction", "type", "other_id",
        "other_title", "label", "confidence")


# -- searches for one phrase -------------------------------------------------


def _haystack() -> Column:
    return F.lower(F.concat_ws(
        " ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")),
        F.array_join("tags", " ")))


def search_hits(nodes: DataFrame, query: str) -> DataFrame:
    """All nodes whose title, summary and tags contain every term of the query."""
    terms = [w for w in query.lower().split() if len(w) > 1]
    if not query.strip():
        return nodes.filter(F.lit(False))
    every = reduce(lambda a, b: a & b, [F.contains(_haystack(), F.lit(w)) for w in terms],
                   F.lit(True))
    return nodes.filter(every)


def search_all_terms(nodes: DataFrame, query: str, limit: int = 50) -> DataFrame:
    return search_hits(nodes, query).orderBy("ord", "id").limit(limit)


def search_phrase(nodes: DataFrame, phrase: str, limit: int = 40) -> DataFrame:
    """Nodes whose title, summary and tags contain the phrase as a whole."""
    text = F.contains(_haystack(), F.lit(phrase.lower().strip()))
    return nodes.filter(text).orderBy("ord", "id").limit(limit)


def title_filter(nodes: DataFrame, query: str, limit: int = 220) -> DataFrame:
    found = nodes.filter(_has(F.col("title"), query.strip())) if query.strip() else nodes
    return found.orderBy("ord", "id").limit(limit)


def seed_answer(nodes: DataFrame, term: str) -> DataFrame:
    """The first node with the term in its lower-case title or in its id."""
    found = nodes.filter(
        F.contains(F.lower("title"), F.lit(term)) | F.contains(F.col("id"), F.lit(term)))
    return found.orderBy("ord", "id").limit(1)


def expand(edges: DataFrame, nodes: DataFrame, node_id: str, limit: int = 30) -> DataFrame:
    """The first outgoing edges of a node with the titles of their targets."""
    first = neighbors(edges, node_id).orderBy("ord", "type", "to_id").limit(limit)
    titles = nodes.select(F.col("id").alias("to_id"), F.col("title").alias("to_title"))
    joined = small(first).join(titles, "to_id")
    return joined.select("to_id", "to_title", "type", "label", "confidence")


def search_expanded(nodes: DataFrame, edges: DataFrame, query: str) -> DataFrame:
    """(id, via): the hits of a search plus the nodes one edge away from a hit."""
    hits = search_hits(nodes, query).select("id")
    seen = both_directions(edges).select("id", "other_id")
    near = skewed_join(seen, hits, "id", "left_semi", salt_by=["other_id"]).select(
        F.col("other_id").alias("id")).distinct()
    known = near.join(nodes.select("id"), "id", "left_semi").join(hits, "id", "left_anti")
    return hits.withColumn("via", F.lit("match")).unionByName(
        known.withColumn("via", F.lit("neighbour")))


