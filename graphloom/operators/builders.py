"""Node and edge builders: extract, explode, join.

Builders return candidate rows. Candidates of one document are merged per
(from, type, to) before any lookup join wherever the key allows it, so a term
that every document mentions reaches the join once per document at most.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import schema as s
from graphloom.functions import text as t
from graphloom.functions.front_matter import front_matter_fields
from graphloom.operators.skew import skewed_join, substring_pairs

# The path mark of glossary documents and the spec's source name.
GLOSSARY_MARK = "reference/glossary"
SPEC_SOURCE = "swagger.json"
HTTP_METHODS = ["get", "post", "put", "delete", "patch"]


def with_front_matter(docs: DataFrame) -> DataFrame:
    """Docs with their parsed front matter as struct column ``fm``."""
    return docs.withColumn("fm", front_matter_fields(F.col("front_matter")))


def is_glossary(path: Column | None = None) -> Column:
    return F.contains(F.col("rel_path") if path is None else path, F.lit(GLOSSARY_MARK))


def _nonempty(text: Column) -> Column:
    return F.when(text != "", text)


def glossary_nodes(docs: DataFrame, version: str = "unknown") -> DataFrame:
    """One candidate per glossary document; needs ``fm``."""
    term = F.coalesce(_nonempty(F.col("fm.id")), t.file_stem(F.col("rel_path")))
    summary = F.coalesce(t.strip(F.col("fm.short_description")), F.lit(""))
    return s.node_candidates(
        docs.filter(is_glossary()),
        id=F.concat(F.lit("gloss:"), term),
        type=F.lit("glossary"),
        title=F.coalesce(F.col("fm.title"), term),
        summary=summary,
        body=F.col("body_norm"),
        version=F.lit(version),
        tags=F.coalesce(F.col("fm.tags"), s.empty_array()),
        url=F.coalesce(_nonempty(F.col("fm.full_link")), F.col("url")),
        prov=s.provenance(F.col("rel_path"), F.col("url"),
                          t.line_of(F.col("body_raw"), F.lit("title:")), summary),
        ord=s.ordinal(s.PHASE_GLOSSARY, "rel_path"),
    )


def page_id(rel_path: Column) -> Column:
    return F.concat(F.lit("page:"), F.replace(rel_path, F.lit(".md"), F.lit("")))


def page_title(rel_path: Column) -> Column:
    return F.coalesce(_nonempty(F.col("fm.title")), t.file_stem(rel_path))


def page_nodes(docs: DataFrame, version: str = "unknown", body_max: int | None = 4000) -> DataFrame:
    """One candidate per page document; needs ``fm``."""
    body = F.col("body_norm")
    title = page_title(F.col("rel_path"))
    trimmed = F.lit(False) if body_max is None else F.length(body) > body_max
    return s.node_candidates(
        docs.filter(~is_glossary()),
        id=page_id(F.col("rel_path")),
        type=F.lit("page"),
        title=title,
        summary=F.coalesce(F.col("fm.description"), F.lit("")),
        body=body if body_max is None else t.trim_body(body, body_max),
        body_trimmed=trimmed,
        version=F.lit(version),
        section=F.col("section"),
        tags=F.array("section"),
        url=F.col("url"),
        meta=s.meta(weight=F.col("fm.weight"), rel_path=F.col("rel_path")),
        prov=s.provenance(F.col("rel_path"), F.col("url"), quote=title),
        ord=s.ordinal(s.PHASE_PAGE, "rel_path"),
    )


def term_mentions(docs: DataFrame, kind: str) -> DataFrame:
    """(rel_path, url, pos, term_id, text, line) for each reference of ``kind``."""
    refs = docs.select("rel_path", "url", "body_raw", F.posexplode("refs").alias("pos", "ref"))
    hits = refs.filter(F.col("ref.kind") == kind)
    needle = F.concat(F.lit('term_id="'), F.col("ref.term_id"), F.lit('"'))
    return hits.select(
        "rel_path", "url", "pos", "ref.term_id", "ref.text",
        t.line_of(F.col("body_raw"), needle).alias("line"),
    )


def _known_terms(mentions: DataFrame, terms: DataFrame, salts: int) -> DataFrame:
    """Mentions whose term exists; ``terms`` is unique by term_id."""
    return skewed_join(mentions, terms.select("term_id", "term_node"), "term_id", "inner",
                       salts, ["rel_path", "pos"])


def reference_edges(docs: DataFrame, terms: DataFrame, salts: int | None = None) -> DataFrame:
    """page -> term candidates for tooltips; ``terms`` has (term_id, term_node)."""
    known = _known_terms(term_mentions(docs, "glossary_tooltip"), terms, salts)
    return s.edge_candidates(
        known,
        from_id=page_id(F.col("rel_path")), to_id=F.col("term_node"), type=F.lit("references"),
        label=F.col("text"),
        prov=s.provenance(F.col("rel_path"), F.col("url"), F.col("line"), F.col("text")),
        ord=s.ordinal(s.PHASE_PAGE, "rel_path", F.col("pos")),
    )


def define_edges(docs: DataFrame, terms: DataFrame, salts: int | None = None) -> DataFrame:
    """page -> term candidates for inlined definitions."""
    known = _known_terms(term_mentions(docs, "glossary_definition"), terms, salts)
    return s.edge_candidates(
        known,
        from_id=page_id(F.col("rel_path")), to_id=F.col("term_node"), type=F.lit("defines"),
        prov=s.provenance(F.col("rel_path"), F.col("url")),
        ord=s.ordinal(s.PHASE_PAGE, "rel_path", F.col("pos")),
    )


def doc_links(docs: DataFrame) -> DataFrame:
    """(rel_path, url, pos, target, target_path) for each document link."""
    links = docs.select(
        "rel_path", "url", F.posexplode(t.extract_links(F.col("body_raw"))).alias("pos", "target"))
    return links.withColumn("target_path", t.link_rel_path(F.col("target")))


def link_edges(docs: DataFrame, pages: DataFrame, salts: int | None = None) -> DataFrame:
    """page -> page candidates for resolvable links; ``pages`` has (rel_path)."""
    targets = pages.select(F.col("rel_path").alias("target_path"))
    resolved = skewed_join(doc_links(docs), targets, "target_path", "left_semi",
                           salts, ["rel_path", "pos"])
    return s.edge_candidates(
        resolved,
        from_id=page_id(F.col("rel_path")), to_id=page_id(F.col("target_path")),
        type=F.lit("links_to"), label=F.col("target"),
        prov=s.provenance(F.col("rel_path"), F.col("url")),
        ord=s.ordinal(s.PHASE_PAGE, "rel_path", F.col("pos")),
    )


def dangling_links(docs: DataFrame, pages: DataFrame, salts: int | None = None) -> DataFrame:
    """Links whose target document does not exist."""
    targets = pages.select(F.col("rel_path").alias("target_path"))
    return skewed_join(doc_links(docs), targets, "target_path", "left_anti",
                       salts, ["rel_path", "pos"])


def dangling_terms(docs: DataFrame, terms: DataFrame, salts: int | None = None) -> DataFrame:
    """Tooltip and definition references to terms that do not exist."""
    both = term_mentions(docs, "glossary_tooltip").unionByName(
        term_mentions(docs, "glossary_definition"))
    return skewed_join(both, terms.select("term_id"), "term_id", "left_anti",
                       salts, ["rel_path", "pos"])


def headings(docs: DataFrame) -> DataFrame:
    """(rel_path, url, section, pos, heading, slug, line) of every heading."""
    found = docs.select(
        "rel_path", "url", "section", "body_raw",
        F.posexplode(t.extract_headings(F.col("body_raw"))).alias("pos", "heading"))
    return found.select(
        "rel_path", "url", "section", "pos", "heading",
        t.slugify(F.col("heading")).alias("slug"),
        t.line_of(F.col("body_raw"), F.col("heading")).alias("line"),
    )


def concept_nodes(found: DataFrame, version: str = "unknown",
                  keys: Sequence[str] = ("slug",)) -> DataFrame:
    """One candidate per heading slug (per ``keys``): the first document's heading wins.

    Only the first use of a heading is evidence for the concept, so the grouping
    yields finished candidates of constant size.
    """
    o = s.ordinal(s.PHASE_PAGE, "rel_path", F.col("pos") + 1)
    first = found.withColumn("ord", o).groupBy(*keys).agg(
        F.min_by(F.struct("rel_path", "url", "section", "heading", "line"), "ord").alias("f"),
        F.min("ord").alias("ord"))
    return s.node_candidates(
        first,
        id=F.concat(F.lit("concept:"), F.col("slug")), type=F.lit("concept"),
        title=F.col("f.heading"), version=F.lit(version), section=F.col("f.section"),
        tags=F.array("f.section"),
        prov=s.provenance(F.col("f.rel_path"), F.col("f.url"), F.col("f.line")),
        ord=F.col("ord"),
    )


def part_of_edges(found: DataFrame) -> DataFrame:
    """page -> concept candidates, one per heading."""
    return s.edge_candidates(
        found,
        from_id=page_id(F.col("rel_path")), to_id=F.concat(F.lit("concept:"), F.col("slug")),
        type=F.lit("part_of"), label=F.lit("describes"),
        prov=s.provenance(F.col("rel_path"), F.col("url"), F.col("line")),
        ord=s.ordinal(s.PHASE_PAGE, "rel_path", F.col("pos")),
    )


# -- API description ---------------------------------------------------------


def with_api_names(definitions: DataFrame) -> DataFrame:
    """Definitions with their name parts as struct column ``api``."""
    return definitions.withColumn("api", t.split_api_name(F.col("name")))


def api_object_nodes(definitions: DataFrame, version: str = "unknown") -> DataFrame:
    """One candidate per definition (def_ord, name, definition JSON)."""
    keys = F.coalesce(
        F.json_object_keys(F.get_json_object("definition", "$.properties")), s.empty_array())
    named = with_api_names(definitions).withColumn("keys", keys)
    return s.node_candidates(
        named,
        id=F.concat(F.lit("api:"), F.col("api.kind")), type=F.lit("api_object"),
        title=F.col("api.kind"),
        summary=F.coalesce(F.get_json_object("definition", "$.description"), F.lit("")),
        version=F.lit(version), tags=F.array("api.group"),
        meta=s.meta(group=F.col("api.group"), api_version=F.col("api.version"),
                    fields=F.col("keys"), field_count=F.size("keys"),
                    def_name=F.col("name")),
        prov=s.provenance(F.lit(SPEC_SOURCE), quote=F.col("name")),
        ord=s.ordinal(s.PHASE_API_OBJECT, s.sortable("def_ord")),
    )


def api_kinds(definitions: DataFrame) -> DataFrame:
    """(kind, def_ord): each distinct kind at its first place in the spec."""
    return with_api_names(definitions).groupBy(F.col("api.kind").alias("kind")).agg(
        F.min("def_ord").alias("def_ord"))


def api_paths(operations: DataFrame, literal_group_tag: bool = False) -> DataFrame:
    """Operations with known methods, plus their node id, kind and tag.

    The tag is the API group, the segment after ``/apis``. ``literal_group_tag``
    tags grouped paths with ``apis`` itself.
    """
    method = F.lower("method")
    grouped = F.startswith(F.col("path"), F.lit("/apis/"))
    group = F.get(F.split("path", "/"), F.lit(1 if literal_group_tag else 2))
    return operations.filter(method.isin(HTTP_METHODS)).select(
        "path_ord", "op_ord", "path", "operation_id", "description",
        F.col("method").alias("raw_method"), method.alias("method"),
        F.concat(F.lit("apipath:"), method, F.lit(" "), F.col("path")).alias("id"),
        t.infer_path_kind(F.col("path"), F.col("method")).alias("kind"),
        F.when(grouped, group).otherwise(F.lit("core")).alias("tag"),
    )


def api_path_nodes(paths: DataFrame, version: str = "unknown") -> DataFrame:
    """One candidate per row of :func:`api_paths`."""
    title = F.coalesce("operation_id", F.concat_ws(" ", "raw_method", "path"))
    return s.node_candidates(
        paths,
        id=F.col("id"), type=F.lit("api_path"), title=title,
        summary=F.coalesce("description", F.lit("")),
        body=F.concat(F.upper("method"), F.lit(" "), F.col("path")),
        version=F.lit(version), tags=F.array("tag"),
        meta=s.meta(method=F.col("method"), path=F.col("path"),
                    operation_id=F.col("operation_id"), kind=F.col("kind")),
        prov=s.provenance(F.lit(SPEC_SOURCE), quote=F.col("path")),
        ord=s.ordinal(s.PHASE_API_PATH, s.sortable("path_ord"), F.col("op_ord")),
    )


def path_exposes_edges(paths: DataFrame, kinds: DataFrame, salts: int | None = None) -> DataFrame:
    """api_path -> api_object candidates where the inferred kind exists."""
    known = skewed_join(paths, kinds.select("kind"), "kind", "left_semi", salts, ["id"])
    return s.edge_candidates(
        known,
        from_id=F.col("id"), to_id=F.concat(F.lit("api:"), F.col("kind")),
        type=F.lit("related_to"), label=F.lit("exposes API object"),
        prov=s.provenance(F.lit(SPEC_SOURCE), quote=F.col("path")),
        ord=s.ordinal(s.PHASE_API_PATH, s.sortable("path_ord"), F.col("op_ord")),
    )


def title_kinds(titles: DataFrame, kinds: DataFrame) -> DataFrame:
    """(id, kind): the first kind in spec order that occurs in each title.

    ``titles`` has (id, title), ``kinds`` has (kind, def_ord); case is ignored.
    """
    texts = titles.select("id", F.lower("title").alias("_title"))
    patterns = kinds.select("kind", "def_ord", F.lower("kind").alias("_kind"))
    pairs = substring_pairs(texts, "_title", patterns, "_kind")
    return pairs.groupBy("id").agg(F.min_by("kind", F.struct("def_ord", "kind")).alias("kind"))


def api_for_edges(pages: DataFrame, kinds: DataFrame) -> DataFrame:
    """page -> api_object candidates; ``pages`` has (id, title, rel_path, url)."""
    matched = pages.select("id", "rel_path", "url").join(
        title_kinds(pages.select("id", "title"), kinds), "id")
    return s.edge_candidates(
        matched,
        from_id=F.col("id"), to_id=F.concat(F.lit("api:"), F.col("kind")),
        type=F.lit("api_for"), label=F.lit("documents API object"),
        prov=s.provenance(F.col("rel_path"), F.col("url")),
        ord=s.ordinal(s.PHASE_API_FOR, "rel_path"),
    )


def type_ref_edges(definitions: DataFrame, kinds: DataFrame, salts: int | None = None) -> DataFrame:
    """api_object -> api_object candidates for each distinct ``$ref`` of a definition."""
    target = r'"\$ref"\s*:\s*"(?:[^"]*/)?([^"/]+)"'
    refs = with_api_names(definitions).select(
        "def_ord", F.col("api.kind").alias("src"),
        F.posexplode(F.array_distinct(
            F.regexp_extract_all("definition", F.lit(target), 1))).alias("pos", "ref"),
    ).withColumn("kind", F.substring_index("ref", ".", -1))
    others = refs.filter(F.col("kind") != F.col("src"))
    known = skewed_join(others, kinds.select("kind"), "kind", "left_semi",
                        salts, ["def_ord", "pos"])
    return s.edge_candidates(
        known,
        from_id=F.concat(F.lit("api:"), F.col("src")),
        to_id=F.concat(F.lit("api:"), F.col("kind")),
        type=F.lit("related_to"), label=F.lit("references type"),
        prov=s.provenance(F.lit(SPEC_SOURCE), quote=F.col("ref")),
        ord=s.ordinal(s.PHASE_TYPE_REF, s.sortable("def_ord"), F.col("pos")),
    )


# -- "Before you begin" ------------------------------------------------------


def before_you_begin_edges(docs: DataFrame, terms: DataFrame, pages: DataFrame,
                           salts: int | None = None) -> DataFrame:
    """Prerequisite candidates from the section of that name.

    Each term reference or document link inside the section, up to the next
    heading of the same level, becomes (term or page) -> this page.
    """
    pattern = r"(?sdi)(?:^|\n)##\s+Before you begin[^\n]*\n(.*?)(?=\n##\s|\z)"
    part = F.regexp_extract("body_raw", pattern, 1)
    sliced = docs.filter(F.rlike("body_raw", F.lit(pattern))).select(
        "rel_path", "url", part.alias("body_raw"), t.extract_refs(part).alias("refs"))
    by_term = _known_terms(
        term_mentions(sliced, "glossary_tooltip"), terms, salts
    ).select("rel_path", "url", "pos", F.col("term_node").alias("needed"))
    targets = pages.select(F.col("rel_path").alias("target_path"))
    by_link = skewed_join(doc_links(sliced), targets, "target_path", "left_semi",
                          salts, ["rel_path", "pos"]).select(
        "rel_path", "url", "pos", page_id(F.col("target_path")).alias("needed"))
    return s.edge_candidates(
        by_term.unionByName(by_link),
        from_id=F.col("needed"), to_id=page_id(F.col("rel_path")),
        type=F.lit("prerequisite_of"), label=F.lit("before you begin"),
        prov=s.provenance(F.col("rel_path"), F.col("url")),
        ord=s.ordinal(s.PHASE_PAGE, "rel_path", F.col("pos")),
    )
