"""Column layouts of the graph tables.

A graph is four flat tables. Facts (nodes, edges) hold one row per key; their
evidence (the provenance entries) is kept in its own long tables, so a hub that
is supported by billions of source lines never becomes one giant array value.

*Candidate* rows are what builders emit: a fact plus one inline ``prov`` struct
and an explicit ordinal ``ord``. Merging candidates by key
(:mod:`graphloom.operators.refine`) yields the fact table, and projecting them
yields the evidence table.

``ord`` is the total order of the source material, ``(phase, doc, pos)``:
structs compare field by field in Spark, so "first wins" is ``min_by(x, ord)``
and needs no sort of the whole data set.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The declared node and edge types.
NODE_TYPES = [
    "page", "glossary", "api_object", "api_path", "concept",
    "manifest", "role", "controller", "operator", "crd",
]
EDGE_TYPES = [
    "references", "defines", "links_to", "prerequisite_of", "related_to", "api_for", "owns",
    "selects", "part_of", "version_of", "permits", "requires", "controls", "installs",
]
# The wide count columns of the statistics row, by node type.
COUNT_COLUMNS = {
    "page": "pages", "glossary": "glossary", "api_object": "api_objects",
    "api_path": "api_paths", "concept": "concepts", "manifest": "manifests",
    "role": "roles", "controller": "controllers", "operator": "operators", "crd": "crds",
}

# Phases order the builders; within a phase ``doc`` and ``pos`` decide.
PHASE_GLOSSARY, PHASE_PAGE, PHASE_API_OBJECT, PHASE_API_PATH = 1, 2, 3, 4
PHASE_API_FOR, PHASE_OWNERSHIP, PHASE_TYPE_REF, PHASE_ROLE = 5, 6, 7, 8
PHASE_COMPONENT, PHASE_FLOW, PHASE_MODEL = 9, 10, 11

ORDINAL = T.StructType([
    T.StructField("phase", T.IntegerType()),
    T.StructField("doc", T.StringType()),
    T.StructField("pos", T.LongType()),
])
PROVENANCE = T.StructType([
    T.StructField("source", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("line_start", T.IntegerType()),
    T.StructField("line_end", T.IntegerType()),
    T.StructField("quote", T.StringType()),
])
META = T.StructType([
    T.StructField("weight", T.IntegerType()),
    T.StructField("rel_path", T.StringType()),
    T.StructField("group", T.StringType()),
    T.StructField("api_version", T.StringType()),
    T.StructField("fields", T.ArrayType(T.StringType())),
    T.StructField("field_count", T.IntegerType()),
    T.StructField("def_name", T.StringType()),
    T.StructField("method", T.StringType()),
    T.StructField("path", T.StringType()),
    T.StructField("operation_id", T.StringType()),
    T.StructField("kind", T.StringType()),
    T.StructField("resource", T.StringType()),
    T.StructField("verbs", T.ArrayType(T.StringType())),
])
REFS = T.ArrayType(T.StructType([
    T.StructField("kind", T.StringType()),
    T.StructField("term_id", T.StringType()),
    T.StructField("text", T.StringType()),
]))
DOCS = T.StructType([
    T.StructField("rel_path", T.StringType()),
    T.StructField("front_matter", T.StringType()),
    T.StructField("body_raw", T.StringType()),
    T.StructField("body_norm", T.StringType()),
    T.StructField("refs", REFS),
    T.StructField("content_hash", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("section", T.StringType()),
])

_NODE_FACTS = [
    T.StructField("id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("body_trimmed", T.BooleanType()),
    T.StructField("version", T.StringType()),
    T.StructField("section", T.StringType()),
    T.StructField("tags", T.ArrayType(T.StringType())),
    T.StructField("aliases", T.ArrayType(T.StringType())),
    T.StructField("url", T.StringType()),
    T.StructField("meta", META),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("derived_by", T.StringType()),
]
_EDGE_FACTS = [
    T.StructField("from_id", T.StringType()),
    T.StructField("to_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("label", T.StringType()),
    T.StructField("weight", T.DoubleType()),
    T.StructField("confidence", T.DoubleType()),
    T.StructField("derived_by", T.StringType()),
]
_PROV = T.StructField("prov", PROVENANCE)
_ORD = T.StructField("ord", ORDINAL)
_N_PROV = T.StructField("n_prov", T.LongType())
#: The ordinal of the edge that gave the confidence; it makes merging associative.
_BEST_ORD = T.StructField("best_ord", ORDINAL)

NODE_CANDIDATES = T.StructType([*_NODE_FACTS, _PROV, _ORD])
EDGE_CANDIDATES = T.StructType([*_EDGE_FACTS, _PROV, _ORD])
NODES = T.StructType([*_NODE_FACTS, _N_PROV, _ORD])
EDGES = T.StructType([*_EDGE_FACTS, _N_PROV, _ORD, _BEST_ORD])
NODE_EVIDENCE = T.StructType([T.StructField("id", T.StringType()), _ORD, *PROVENANCE.fields])
EDGE_EVIDENCE = T.StructType([
    T.StructField("from_id", T.StringType()),
    T.StructField("type", T.StringType()),
    T.StructField("to_id", T.StringType()),
    _ORD,
    *PROVENANCE.fields,
])
EDGE_KEY = ["from_id", "type", "to_id"]


@dataclass(frozen=True)
class Graph:
    """The four tables of a compiled graph plus build metadata."""

    nodes: DataFrame
    edges: DataFrame
    node_evidence: DataFrame
    edge_evidence: DataFrame
    meta: dict[str, str] = field(default_factory=dict)

    def with_(self, **changes: Any) -> Graph:
        return replace(self, **changes)


def sortable(number: Column | str) -> Column:
    """A non-negative integer as text that sorts like the number."""
    return F.lpad((F.col(number) if isinstance(number, str) else number).cast("string"), 19, "0")


def ordinal(phase: int, doc: Column | str, pos: Column | int = 0) -> Column:
    doc = F.col(doc) if isinstance(doc, str) else doc
    place = F.expr(f"{pos}L AS pos") if isinstance(pos, int) else pos.cast("bigint").alias("pos")
    return F.struct(F.expr(f"{phase} AS phase"), doc.alias("doc"), place)


def provenance(
    source: Column,
    url: Column | None = None,
    line_start: Column | None = None,
    quote: Column | None = None,
) -> Column:
    values = {"source": source, "url": url, "line_start": line_start, "quote": quote}
    return F.struct(*[_member(f, values.get(f.name)) for f in PROVENANCE.fields])


def _member(f: T.StructField, value: Column | None) -> Column:
    """A struct member; the NULL ones are written as SQL to keep planning cheap."""
    if value is None:
        return F.expr(f"CAST(NULL AS {f.dataType.simpleString()}) AS {f.name}")
    return value.cast(f.dataType.simpleString()).alias(f.name)


def meta(**values: Column) -> Column:
    """The meta struct with the given members set and the others NULL."""
    unknown = set(values) - set(META.fieldNames())
    if unknown:
        raise ValueError(f"unknown meta fields: {sorted(unknown)}")
    return F.struct(*[_member(f, values.get(f.name)) for f in META.fields])


def empty_array() -> Column:
    return F.array().cast("array<string>")


# SQL of the columns a builder leaves out; any other one is NULL.
_NODE_DEFAULTS = {
    "summary": "''", "body": "''", "body_trimmed": "false", "version": "'unknown'",
    "tags": "CAST(array() AS array<string>)", "aliases": "CAST(array() AS array<string>)",
    "confidence": "1.0D", "derived_by": "'deterministic'",
}
_EDGE_DEFAULTS = {
    "label": "''", "weight": "1.0D", "confidence": "1.0D", "derived_by": "'deterministic'",
}


def _fill(df: DataFrame, schema: T.StructType, defaults: dict[str, str],
          values: dict[str, Column]) -> DataFrame:
    unknown = set(values) - set(schema.fieldNames())
    if unknown:
        raise ValueError(f"unknown columns: {sorted(unknown)}")
    columns = []
    for f in schema.fields:
        value = values.get(f.name)
        if value is None and f.name in defaults:
            columns.append(F.expr(f"{defaults[f.name]} AS {f.name}"))
        elif value is not None and isinstance(f.dataType, (T.StructType, T.ArrayType)):
            columns.append(value.alias(f.name))
        else:
            columns.append(_member(f, value))
    return df.select(*columns)


def node_candidates(df: DataFrame, **values: Column) -> DataFrame:
    """Project ``df`` onto the node candidate layout, filling the defaults."""
    return _fill(df, NODE_CANDIDATES, _NODE_DEFAULTS, values)


def edge_candidates(df: DataFrame, **values: Column) -> DataFrame:
    """Project ``df`` onto the edge candidate layout, filling the defaults."""
    return _fill(df, EDGE_CANDIDATES, _EDGE_DEFAULTS, values)


def as_facts(candidates: DataFrame) -> DataFrame:
    """Candidates that are unique by construction, in the fact layout."""
    facts = candidates.withColumn(
        "n_prov", F.when(F.col("prov.source").isNotNull(), 1).otherwise(0).cast("bigint")
    ).drop("prov")
    return facts.withColumn("best_ord", F.col("ord")) if "from_id" in facts.columns else facts
