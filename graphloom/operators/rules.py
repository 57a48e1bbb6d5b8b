"""Rule passes: small rule tables joined to the graph.

Rule tables are DataFrames; the defaults in :mod:`graphloom.seeds` are literal
relations and are broadcast. A large rule table simply becomes a shuffled join.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom import schema as s
from graphloom.operators.skew import lag_in_order, short_list, skewed_join, small, substring_pairs
from graphloom.seeds import CONTROLLED_BY, DOMAIN_KEYWORDS

# Where the documented facts come from.
ARCHITECTURE_SOURCE = "kubernetes/website:concepts/architecture"
RBAC_SOURCE = "kubernetes/website:reference/access-authn-authz/rbac"
APPLY_SOURCE = "kubernetes/website:reference/kubectl/apply"
SITE_SOURCE = "kubernetes/website"


def objects_by_title(nodes: DataFrame, title: Column | None = None) -> DataFrame:
    """(key, id, title) of the API objects, the last one of a title winning."""
    key = F.col("title") if title is None else title
    objects = nodes.filter(F.col("type") == "api_object")
    last = objects.groupBy(key.alias("key")).agg(
        F.max_by(F.struct("id", "title"), "ord").alias("o"))
    return last.select("key", "o.id", "o.title")


def ownership_edges(objects: DataFrame, chain: DataFrame, salts: int | None = None) -> DataFrame:
    """child -> parent candidates where both kinds exist.

    ``objects`` has (key = title, id); ``chain`` has (rule_ord, child, parent).
    """
    children = objects.select(F.col("key").alias("child"), F.col("id").alias("child_id"))
    parents = objects.select(F.col("key").alias("parent"), F.col("id").alias("parent_id"))
    linked = skewed_join(chain, children, "child", "inner", salts)
    linked = skewed_join(linked, parents, "parent", "inner", salts)
    return s.edge_candidates(
        linked,
        from_id=F.col("child_id"), to_id=F.col("parent_id"), type=F.lit("owns"),
        label=F.concat("parent", F.lit(" owns/manages "), "child"),
        prov=s.provenance(F.lit(ARCHITECTURE_SOURCE), quote=F.concat(
            F.lit("owner references: "), "parent", F.lit(" manages "), "child",
            F.lit(" lifecycle"))),
        ord=s.ordinal(s.PHASE_OWNERSHIP, s.sortable("rule_ord")),
    )


def rbac_roles(seed: DataFrame) -> DataFrame:
    """One role candidate per (rule_ord, resource, api_group, verbs)."""
    group = F.when(F.col("api_group") == "", "core").otherwise(F.col("api_group"))
    return s.node_candidates(
        seed,
        id=F.concat(F.lit("role:"), "resource"), type=F.lit("role"),
        title=F.concat(F.lit("permissions:"), "resource"),
        summary=F.concat(F.lit("RBAC permissions to manage '"), F.col("resource"),
                         F.lit("' (group="), group, F.lit(").")),
        tags=F.array(F.lit("rbac"), group),
        meta=s.meta(resource=F.col("resource"), group=F.col("api_group"), verbs=F.col("verbs")),
        prov=s.provenance(F.lit(RBAC_SOURCE), quote=F.concat(
            F.lit("resource '"), F.col("resource"), F.lit("' permits "),
            F.array_join("verbs", ","))),
        ord=s.ordinal(s.PHASE_ROLE, s.sortable("rule_ord")),
    )


def requires_edges(seed: DataFrame, objects: DataFrame) -> DataFrame:
    """role -> API object candidates.

    A resource names the object whose lower-case title equals it without its
    trailing "s" letters, or else equals it as it is. Both spellings go through
    one join; the first that exists wins. ``objects`` has (key = lower title).
    """
    spellings = F.array(
        F.struct(F.lit(0).alias("rank"), F.rtrim("resource", F.lit("s")).alias("key")),
        F.struct(F.lit(1).alias("rank"), F.col("resource").alias("key")))
    wanted = seed.select("rule_ord", "resource", F.inline(spellings))
    found = small(wanted).join(objects, "key").groupBy("rule_ord", "resource").agg(
        F.min_by(F.struct("id", "title"), "rank").alias("o"))
    return s.edge_candidates(
        found,
        from_id=F.concat(F.lit("role:"), "resource"), to_id=F.col("o.id"),
        type=F.lit("requires"),
        label=F.concat(F.lit("required to manage "), F.col("o.title")),
        prov=s.provenance(F.lit(RBAC_SOURCE), quote=F.concat(
            F.col("o.title"), F.lit(" requires "), F.col("resource"), F.lit(" permissions"))),
        ord=s.ordinal(s.PHASE_ROLE, s.sortable("rule_ord")),
    )


def component_nodes(seed: DataFrame, version: str = "unknown") -> DataFrame:
    """One controller candidate per (rule_ord, component, target, label)."""
    return s.node_candidates(
        seed,
        id=F.concat(F.lit("ctrl:"), "component"), type=F.lit("controller"),
        title=F.col("component"),
        summary=F.concat(F.lit("Control-plane component: "), F.col("component"), F.lit(".")),
        version=F.lit(version), tags=F.array(F.lit("control-plane")),
        prov=s.provenance(F.lit(ARCHITECTURE_SOURCE), quote=F.concat(
            F.lit("control plane component "), "component")),
        ord=s.ordinal(s.PHASE_COMPONENT, s.sortable("rule_ord")),
    )


def component_edges(seed: DataFrame, hub: str = CONTROLLED_BY, salts: int | None = None) -> DataFrame:
    """Edges between components; talking to ``hub`` means controlling."""
    known = seed.select(F.col("component").alias("target")).distinct()
    linked = skewed_join(seed, known, "target", "left_semi", salts, ["component"])
    return s.edge_candidates(
        linked,
        from_id=F.concat(F.lit("ctrl:"), "component"), to_id=F.concat(F.lit("ctrl:"), "target"),
        type=F.when(F.col("target") == hub, "controls").otherwise("links_to"),
        label=F.col("label"),
        prov=s.provenance(F.lit(ARCHITECTURE_SOURCE), quote=F.col("label")),
        ord=s.ordinal(s.PHASE_COMPONENT, s.sortable("rule_ord")),
    )


def domain_tags(text: Column, rules: Mapping[str, Sequence[str]] = DOMAIN_KEYWORDS) -> Column:
    """The domains, in rule order, with a keyword that occurs in ``text``."""
    hits = []
    for domain, words in rules.items():
        found = F.lit(False)
        for word in words:
            found = found | F.contains(text, F.lit(word))
        hits.append(F.when(found, F.lit(domain)))
    return F.array_compact(F.array(*hits))


def tagging_text() -> Column:
    return F.lower(F.concat_ws(
        " ", F.coalesce("title", F.lit("")), F.coalesce("summary", F.lit("")),
        F.array_join("tags", " ")))


def tag_by_keywords(nodes: DataFrame,
                    rules: Mapping[str, Sequence[str]] = DOMAIN_KEYWORDS) -> DataFrame:
    """Append the domain tags a node's title, summary and tags call for."""
    new = F.array_except(domain_tags(tagging_text(), rules), F.col("tags"))
    return nodes.withColumn("tags", F.concat("tags", new))


def tag_by_rules(nodes: DataFrame, rules: DataFrame) -> DataFrame:
    """:func:`tag_by_keywords` with a table of rules (domain, rank, keyword) of any size.

    ``rank`` orders the domains; a domain's first rank counts. Keywords are compared with
    the lower-cased text as they are. Rows without a domain or keyword are no rules.
    """
    usable = rules.filter("domain IS NOT NULL AND keyword <> ''").select("domain", "rank", "keyword")
    rows = nodes.withColumn("_text", tagging_text())
    listed = short_list(usable, "keyword")
    if listed is not None:  # every row is tested in place, nothing is shuffled
        hits = F.filter("_rules", lambda x: F.contains(F.col("_text"), x["keyword"]))
        ranked = F.transform(F.array_distinct(F.col("_hits.domain")), lambda d: F.struct(
            F.array_min(F.transform(F.filter("_hits", lambda x: x["domain"] == d), lambda x: x["rank"])).alias("rank"),
            d.alias("domain")))
        named = F.transform(F.array_sort(ranked), lambda x: x["domain"])
        return rows.withColumn("_rules", listed).withColumn("_hits", hits).withColumn(
            "tags", F.concat("tags", F.array_except(named, F.col("tags")))).select(*nodes.columns)
    rows = rows.withColumn("_of", F.md5("_text"))
    pairs = substring_pairs(rows.select("_of", "_text"), "_text", usable, "keyword")
    first = pairs.groupBy("_of", "domain").agg(F.min("rank").alias("rank"))
    # As long as the list of domains.
    found = first.groupBy("_of").agg(
        F.array_sort(F.collect_list(F.struct("rank", "domain"))).alias("_found"))
    named = F.transform(F.coalesce("_found", F.expr("CAST(array() AS array<struct<rank:int,domain:string>>)")),
                        lambda x: x["domain"])
    tagged = skewed_join(rows, found, "_of", "left")
    return tagged.withColumn("tags", F.concat("tags", F.array_except(named, F.col("tags")))).select(
        *nodes.columns)


def flow_id(actor: Column) -> Column:
    return F.concat(F.lit("flow:"), F.translate(actor, "/ ", "__"))


def flow_nodes(steps: DataFrame, version: str = "unknown",
               title_prefix: str = "kubectl apply: ", source: str = APPLY_SOURCE) -> DataFrame:
    """One concept candidate per actor of (step, actor, description).

    The first description wins; later steps of the same actor add no evidence.
    """
    first = steps.groupBy("actor").agg(
        F.min_by("description", "step").alias("description"), F.min("step").alias("step"))
    return s.node_candidates(
        first,
        id=flow_id(F.col("actor")), type=F.lit("concept"),
        title=F.concat(F.lit(title_prefix), F.col("actor")), summary=F.col("description"),
        version=F.lit(version), tags=F.array(F.lit("kubectl"), F.lit("flow")),
        prov=s.provenance(F.lit(source), quote=F.col("description")),
        ord=s.ordinal(s.PHASE_FLOW, s.sortable("step")),
    )


def flow_edges(steps: DataFrame, keys: Sequence[str] = (), source: str = SITE_SOURCE) -> DataFrame:
    """previous actor -> actor candidates along each chain of steps.

    ``keys`` separates chains and ``step`` orders them; actors of one step follow each other
    by name. Chains may be of any length.
    """
    chained = lag_in_order(steps, keys, ["step", "actor"], "actor", "previous")
    return s.edge_candidates(
        chained.filter(F.col("previous").isNotNull()),
        from_id=flow_id(F.col("previous")), to_id=flow_id(F.col("actor")),
        type=F.lit("prerequisite_of"), label=F.lit("then"),
        prov=s.provenance(F.lit(source), quote=F.col("description")),
        ord=s.ordinal(s.PHASE_FLOW, F.concat_ws("/", *keys), F.col("step")),
    )
