"""Look-ups, rankings, samples and views over the fact tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import schema as s
from graphloom.functions import text as t
from graphloom.operators.skew import DEFAULT_SALTS, exact_rank, skewed_join, small, top_per_group
from graphloom.operators.stats import degree_counts
from graphloom.seeds import (
    FLOW_ORDER, RELATION_ORDER, SITE_ROUTES, SITE_SECTIONS, TYPE_SECTION)


# -- predicates --------------------------------------------------------------


def nodes_by_type(nodes: DataFrame, *types: str) -> DataFrame:
    return nodes.filter(F.col("type").isin(list(types)))


def _typed(edges: DataFrame, edge_type: str | None) -> DataFrame:
    return edges if edge_type is None else edges.filter(F.col("type") == edge_type)


def neighbors(edges: DataFrame, node_id: str, edge_type: str | None = None) -> DataFrame:
    """Outgoing edges of a node."""
    return _typed(edges.filter(F.col("from_id") == node_id), edge_type)


def incoming(edges: DataFrame, node_id: str, edge_type: str | None = None) -> DataFrame:
    """Incoming edges of a node."""
    return _typed(edges.filter(F.col("to_id") == node_id), edge_type)


def neighbors_of_type(edges: DataFrame, node_id: str, edge_type: str) -> DataFrame:
    """Edges of one type in either direction; a self-loop appears twice."""
    return neighbors(edges, node_id, edge_type).unionByName(
        incoming(edges, node_id, edge_type))


def edges_of_types(edges: DataFrame, *types: str) -> DataFrame:
    return edges.filter(F.col("type").isin(list(types)))


def with_id_prefix(nodes: DataFrame, prefix: str) -> DataFrame:
    return nodes.filter(F.startswith(F.col("id"), F.lit(prefix)))


def with_tag(nodes: DataFrame, tag: str) -> DataFrame:
    return nodes.filter(F.array_contains("tags", tag))


def confidence_out_of_range(facts: DataFrame) -> DataFrame:
    return facts.filter(~F.col("confidence").between(0.0, 1.0))


# -- joins to titles ---------------------------------------------------------


def edge_view(edges: DataFrame, nodes: DataFrame, salts: int | None = None) -> DataFrame:
    """Edges with the titles of both ends; edges without an end are left out."""
    titles = nodes.select("id", "title")
    view = edges
    for end, name in (("from_id", "from_title"), ("to_id", "to_title")):
        view = skewed_join(view, titles.withColumnsRenamed({"id": end, "title": name}),
                           end, "inner", salts, s.EDGE_KEY)
    return view.select(
        "from_id", "from_title", "to_id", "to_title", "type", "label", "confidence")


def both_directions(edges: DataFrame) -> DataFrame:
    """Every edge seen from each end: (id, other_id, direction, ...).

    One scan; a self-loop yields two rows.
    """
    ends = F.array(
        F.struct(F.col("from_id").alias("id"), F.col("to_id").alias("other_id"),
                 F.lit("out").alias("direction")),
        F.struct(F.col("to_id").alias("id"), F.col("from_id").alias("other_id"),
                 F.lit("in").alias("direction")))
    return edges.select("type", "label", "confidence", F.inline(ends))


def related_topk(edges: DataFrame, k: int = 25) -> DataFrame:
    """The ``k`` most confident edges of every node, with their rank."""
    order = [F.desc("confidence"), F.asc("other_id"), F.asc("type"), F.asc("direction")]
    return top_per_group(both_directions(edges), ["id"], order, k)


def related_to(edges: DataFrame, node_id: str, k: int = 25) -> DataFrame:
    """The ``k`` most confident edges of one node."""
    mine = edges.filter((F.col("from_id") == node_id) | (F.col("to_id") == node_id))
    seen = both_directions(mine).filter(F.col("id") == node_id)
    return seen.orderBy(F.desc("confidence"), "other_id", "type", "direction").limit(k)


def priority(column: Column, order: Sequence[str]) -> Column:
    """The position of a value in ``order``; unlisted values come last."""
    rank = F.lit(len(order))
    for i, value in reversed(list(enumerate(order))):
        rank = F.when(column == value, F.lit(i)).otherwise(rank)
    return rank


def relation_priority(column: Column) -> Column:
    return priority(column, RELATION_ORDER)


def node_pages(nodes: DataFrame, edges: DataFrame, evidence: DataFrame, k: int = 25,
               sources: int = 4, salts: int | None = None) -> DataFrame:
    """Everything a page per node shows, one row per (node, related edge).

    Nodes without edges keep one row with NULL relation columns. ``sources`` is a
    text of at most ``sources`` evidence entries.
    """
    top = related_topk(edges, k)
    titles = nodes.select(F.col("id").alias("other_id"), F.col("title").alias("other_title"))
    named = skewed_join(top, titles, "other_id", "left", salts, ["id", "rank"])
    cited = first_evidence(evidence, sources).select("id", F.array_join(F.transform(
        "provenance", lambda p: F.concat_ws(" — ", p["source"], F.substring(p["quote"], 1, 240))
    ), " | ").alias("sources"))
    base = nodes.select("id", "type", "title", "summary").join(cited, "id", "left")
    related = named.select(
        "id", "rank", "direction", F.col("type").alias("edge_type"), "other_id",
        F.coalesce("other_title", "other_id").alias("other_title"), "label", "confidence")
    return base.join(related, "id", "left")


def first_evidence(evidence: DataFrame, n: int) -> DataFrame:
    """(id, provenance): the first ``n`` evidence entries of each node, in order."""
    entry = F.struct("source", "url", "line_start", "line_end", "quote")
    first = top_per_group(evidence, ["id"], [F.asc("ord"), F.asc(entry)], n, "_rank")
    ordered = F.array_sort(F.collect_list(F.struct("_rank", entry.alias("p"))))
    return first.groupBy("id").agg(
        F.transform(ordered, lambda e: e["p"]).alias("provenance"))


def with_evidence(nodes: DataFrame, evidence: DataFrame, n: int) -> DataFrame:
    """Nodes with column ``provenance`` (at most ``n`` entries, never NULL)."""
    joined = nodes.join(first_evidence(evidence, n), "id", "left")
    none = F.array().cast(f"array<{s.PROVENANCE.simpleString()}>")
    return joined.withColumn("provenance", F.coalesce("provenance", none))


# -- prerequisites -----------------------------------------------------------


def prerequisites_of(edges: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """Nodes one step before a node."""
    ids = incoming(edges, node_id, "prerequisite_of").select(F.col("from_id").alias("id"))
    return nodes.join(ids, "id")


def unlocks(edges: DataFrame, nodes: DataFrame, node_id: str) -> DataFrame:
    """Nodes one step after a node."""
    ids = neighbors(edges, node_id, "prerequisite_of").select(F.col("to_id").alias("id"))
    return nodes.join(ids, "id")


def prerequisite_pairs(edges: DataFrame, nodes: DataFrame, types: Sequence[str] = ("glossary",),
                       salts: int | None = None) -> DataFrame:
    """(id, title, direction, other_id, other_title) over prerequisite edges.

    One row per pair, so a term that unlocks millions of others stays in rows.
    """
    seen = both_directions(edges.filter(F.col("type") == "prerequisite_of"))
    named = seen.select(
        "id", "other_id",
        F.when(F.col("direction") == "in", "prerequisite").otherwise("unlocks").alias("direction"))
    mine = nodes.filter(F.col("type").isin(list(types))).select("id", "title")
    others = nodes.select(F.col("id").alias("other_id"), F.col("title").alias("other_title"))
    pairs = skewed_join(named, mine, "id", "inner", salts, ["other_id", "direction"])
    pairs = skewed_join(pairs, others, "other_id", "inner", salts, ["id", "direction"])
    return pairs.select("id", "title", "direction", "other_id", "other_title")


def start_here(edges: DataFrame, nodes: DataFrame, limit: int = 12,
               types: Sequence[str] = ("glossary",)) -> DataFrame:
    """Terms that unlock others, those with the fewest prerequisites first."""
    degrees = degree_counts(edges).filter(F.col("unlocks") > 0)
    terms = nodes.filter(F.col("type").isin(list(types))).select("id", "title")
    ranked = terms.join(degrees, "id")
    return ranked.orderBy("prerequisites", F.lower("title"), "title", "id").limit(limit)


# -- listings and samples ----------------------------------------------------


def index_page(nodes: DataFrame, *types: str) -> DataFrame:
    """Nodes of some types by title."""
    return nodes_by_type(nodes, *types).orderBy("title", "id")


def sections(nodes: DataFrame) -> DataFrame:
    """(section, n) over all nodes."""
    return nodes.groupBy("section").agg(F.count(F.lit(1)).alias("n"))


def sample_per_type(facts: DataFrame, n: int, key: str = "id") -> DataFrame:
    """The first ``n`` facts of every type, by ordinal and key; types are few."""
    return top_per_group(facts, ["type"], [F.asc("ord"), F.asc(key)], n, salts=DEFAULT_SALTS)


def induced_subgraph(nodes: DataFrame, edges: DataFrame, n: int,
                     m: int) -> tuple[DataFrame, DataFrame]:
    """The first ``n`` nodes, and the first ``m`` edges among them."""
    chosen = nodes.orderBy("ord", "id").limit(n)
    inside = edges
    for end in ("from_id", "to_id"):
        ids = chosen.select(F.col("id").alias(end))
        inside = inside.join(small(ids), end, "left_semi")
    return chosen, inside.orderBy("ord", "from_id", "type", "to_id").limit(m)


def flow_listing(nodes: DataFrame) -> DataFrame:
    """The flow nodes in reading order: (rank, id, title, summary)."""
    flow = with_id_prefix(nodes, "flow:")
    rank = priority(F.col("id"), FLOW_ORDER)
    return flow.select(rank.alias("rank"), "id", "title", "summary").orderBy("rank", "id")


# -- slugs and routes --------------------------------------------------------


def section_for(node_type: Column) -> Column:
    mapping: list[Column] = []
    for name, section in TYPE_SECTION.items():
        mapping += [F.lit(name), F.lit(section)]
    known = F.try_element_at(F.create_map(*mapping), node_type)
    return F.coalesce(known, F.lit(SITE_SECTIONS[0]))


def node_slugs(nodes: DataFrame, salts: int | None = None) -> DataFrame:
    """(id, type, slug): the URL slug of every node, unique per node.

    The first node of a slug keeps it; the others get ``-1``, ``-2``, ... in
    node order. Only the colliding rows are ranked.
    """
    slugs = nodes.select("id", "type", "ord", t.node_slug(F.col("id")).alias("slug"))
    order = F.struct("ord", "id")
    shared = slugs.groupBy("slug").agg(
        F.min_by("id", order).alias("_first"), F.count(F.lit(1)).alias("_n"),
    ).filter(F.col("_n") > 1).drop("_n")
    marked = skewed_join(slugs, shared, "slug", "left", salts, ["id"])
    again = F.col("_first").isNotNull() & (F.col("_first") != F.col("id"))
    unique = marked.filter(~again).select("id", "type", "slug")
    ranked = exact_rank(marked.filter(again).drop("_first"), ["slug"], ["ord", "id"], "_rank")
    suffixed = ranked.select(
        "id", "type", F.concat("slug", F.lit("-"), F.col("_rank").cast("string")).alias("slug"))
    return unique.unionByName(suffixed)


def hrefs(nodes: DataFrame, salts: int | None = None) -> DataFrame:
    """(id, type, section, slug, href) of every node's page."""
    routed = node_slugs(nodes, salts).withColumn("section", section_for(F.col("type")))
    href = F.concat(F.lit("/"), F.col("section"), F.lit("/"), F.col("slug"), F.lit("/"))
    return routed.select("id", "type", "section", "slug", href.alias("href"))


def ids_for_section(nodes: DataFrame, section: str) -> DataFrame:
    """The ids that get a static page in a section, in node order."""
    types = [name for name, where in TYPE_SECTION.items() if where == section]
    return nodes_by_type(nodes, *types).select("id", "ord").orderBy("ord", "id").select("id")


def sitemap_urls(nodes: DataFrame, base_url: str, salts: int | None = None) -> DataFrame:
    """(url): the fixed routes and one URL per node of a listed type."""
    base = base_url.rstrip("/")
    listed = hrefs(nodes.filter(F.col("type").isin(list(TYPE_SECTION))), salts)
    pages = listed.select(F.concat(F.lit(base), F.col("href")).alias("url"))
    spark = nodes.sparkSession
    routes = F.explode(F.array(*[F.lit(base + r) for r in SITE_ROUTES]))
    return spark.range(1).select(routes.alias("url")).unionByName(pages)
