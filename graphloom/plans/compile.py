"""Corpus and API description to a finished graph."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom import schema as s
from graphloom import seeds
from graphloom.operators import builders as b
from graphloom.operators import refine, rules
from graphloom.operators.inference import PassRegistry
from graphloom.operators.skew import skewed_join
from graphloom.schema import Graph
from graphloom.session import stage
from graphloom.sources.api_spec import spec_definitions, spec_operations


@dataclass(frozen=True)
class CompileOptions:
    version: str = "main"
    source_label: str = ""
    trim_bodies: bool = True
    body_max_chars: int = 4000
    literal_group_tag: bool = False
    begin_sections: bool = False
    model_passes: PassRegistry | None = None
    enabled_passes: str | None = None


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y), parts)


def terms_of(glossary: DataFrame) -> DataFrame:
    """(term_id, term_node), unique, of glossary candidates."""
    term = F.substring("id", len("gloss:") + 1, 1 << 30)
    return glossary.select(term.alias("term_id"), F.col("id").alias("term_node")).distinct()


Parts = tuple[list[DataFrame], list[DataFrame]]


def document_parts(docs: DataFrame, opt: CompileOptions, terms: DataFrame, targets: DataFrame,
                   kinds: DataFrame | None, per_document: bool = False) -> Parts:
    """Node and edge candidates that documents (with ``fm``) give rise to, before tagging.

    References resolve to ``terms`` and links to ``targets`` (rel_path). ``per_document``
    leaves one concept candidate for each document that has the heading.
    """
    pages = docs.filter(~b.is_glossary())
    body_max = opt.body_max_chars if opt.trim_bodies else None
    page_rows = b.page_nodes(docs, opt.version, body_max)
    found = b.headings(pages)
    keys = ("slug", "rel_path") if per_document else ("slug",)
    nodes = [b.glossary_nodes(docs, opt.version), page_rows, b.concept_nodes(found, opt.version, keys)]
    edges = [b.reference_edges(pages, terms), b.define_edges(pages, terms),
             b.link_edges(pages, targets), b.part_of_edges(found)]
    if opt.begin_sections:
        edges.append(b.before_you_begin_edges(pages, terms, targets))
    if kinds is not None:
        titles = page_rows.select("id", "title", F.col("meta.rel_path").alias("rel_path"), "url")
        edges.append(b.api_for_edges(titles, kinds))
    return nodes, edges


def fixed_parts(spark: SparkSession, spec: DataFrame | None, opt: CompileOptions) -> Parts:
    """Candidates that no document changes: of the API description and the rule tables."""
    nodes, edges = [], []
    if spec is not None:
        definitions = spec_definitions(spec)
        kinds = b.api_kinds(definitions)
        paths = b.api_paths(spec_operations(spec), opt.literal_group_tag)
        objects = b.api_object_nodes(definitions, opt.version)
        nodes += [objects, b.api_path_nodes(paths, opt.version)]
        edges += [
            b.path_exposes_edges(paths, kinds),
            rules.ownership_edges(rules.objects_by_title(objects), seeds.ownership(spark)),
            b.type_ref_edges(definitions, kinds),
            rules.requires_edges(
                seeds.resource_verbs(spark),
                rules.objects_by_title(objects, F.lower("title"))),
        ]
    nodes += [rules.rbac_roles(seeds.resource_verbs(spark)),
              rules.component_nodes(seeds.components(spark), opt.version)]
    edges += [rules.component_edges(seeds.components(spark)),
              rules.flow_edges(seeds.apply_steps(spark))]
    return nodes, edges


def tagged(spark: SparkSession, nodes: list[DataFrame], opt: CompileOptions,
           flows: bool = True) -> DataFrame:
    """All node candidates with their domain tags; flow nodes come after tagging and get none."""
    rows = rules.tag_by_keywords(_union(nodes))
    return rows.unionByName(rules.flow_nodes(seeds.apply_steps(spark), opt.version)) if flows else rows


def compile_graph(spark: SparkSession, docs: DataFrame, spec: DataFrame | None = None,
                  options: CompileOptions | None = None) -> Graph:
    """Build, enrich, merge and prune the graph of a corpus.

    Three tables are staged in the shared folder: the parsed documents (text work
    is done once, later readers prune columns) and the candidate nodes and edges
    (each feeds both its fact and its evidence table).
    """
    opt = options or CompileOptions()
    docs = stage(b.with_front_matter(docs), "docs")
    kinds = None if spec is None else b.api_kinds(spec_definitions(spec))
    terms = terms_of(b.glossary_nodes(docs, opt.version))
    nodes, edges = document_parts(docs, opt, terms, docs.filter(~b.is_glossary()), kinds)
    more_nodes, more_edges = fixed_parts(spark, spec, opt)
    node_rows = stage(tagged(spark, nodes + more_nodes, opt), "node-candidates")
    edge_rows = stage(_union(edges + more_edges), "edge-candidates")

    graph = Graph(
        nodes=refine.dedupe_nodes(node_rows),
        edges=refine.merge_edges(edge_rows),
        node_evidence=refine.node_evidence(node_rows),
        edge_evidence=refine.edge_evidence(edge_rows),
        meta={"version": opt.version, "source_label": opt.source_label,
              "generator": "graphloom"},
    )
    if opt.model_passes is not None:
        graph = opt.model_passes.run(graph, True, opt.enabled_passes)
    return prune(graph, opt.body_max_chars)


def prune(graph: Graph, body_max: int = 4000) -> Graph:
    """Drop dangling edges and orphan nodes, trim what is still too long.

    An orphan touches no edge, so dropping orphans leaves no edge dangling; the
    evidence of dropped facts goes with them.
    """
    nodes = stage(graph.nodes, "nodes")
    edges = stage(refine.drop_dangling_edges(graph.edges, nodes), "edges")
    kept = refine.drop_orphans(
        refine.compress_bodies(nodes, body_max), edges, graph.node_evidence)
    kept = stage(kept, "kept-nodes")
    return graph.with_(
        nodes=kept,
        edges=edges,
        node_evidence=skewed_join(graph.node_evidence, kept.select("id"), "id", "left_semi",
                                  salt_by=["ord", "quote"]),
        edge_evidence=skewed_join(graph.edge_evidence, edges.select(*s.EDGE_KEY), s.EDGE_KEY,
                                  "left_semi", salt_by=["ord", "quote"]),
    )
