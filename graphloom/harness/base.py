"""Registry and the mapping of the driver's tables onto the graph layout.

* web graph: ``pages``; a page refers to the terms its links name
* document graph: ``documents``; shortcodes and headings are built from columns
* entity graph: the region / nation / customer / order / part / supplier tables

The SQL twins of the mappings are the ``*_SQL`` texts below.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from graphloom import schema as s
from graphloom.functions import text as t
from graphloom.operators.refine import merge_edges
from graphloom.operators.skew import in_pieces, spread
from graphloom.schema import as_facts  # noqa: F401  (re-exported)
from graphloom.session import configure

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
_SCHEMAS: dict[str, StructType] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def register(run: Query) -> Query:
        def configured(spark: SparkSession, sf_dir: str) -> DataFrame:
            return run(configure(spark), sf_dir)

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = configured
        if sql is not None:
            ORACLES[name] = sql
        return run

    return register


class Tables:
    """Lazy readers of the tables in one scale-factor folder."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self._spark = spark
        self._dir = sf_dir

    def __getattr__(self, name: str) -> DataFrame:
        path = f"{self._dir}/{name}.parquet"
        # Resolving a file's schema is a job of its own: do it once per session.
        known = _SCHEMAS.get(path)
        reader = self._spark.read if known is None else self._spark.read.schema(known)
        table = reader.parquet(path)
        _SCHEMAS[path] = table.schema
        setattr(self, name, table)
        return table

    def spread(self, name: str, *columns: str) -> DataFrame:
        """A table for CPU-heavy work; small inputs use all cores."""
        table = getattr(self, name)
        return spread(table.select(*columns) if columns else table)


#: Stored bytes of order lines that one task turns into candidates: some 300,000 lines, which
#: as candidates take about 0.5 kB each while they are sorted by key.
LINE_BYTES = 4 << 20


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def text_id(prefix: str, key: str) -> Column:
    return F.concat(F.lit(prefix), F.col(key).cast("string"))


def padded(key: str) -> Column:
    return s.sortable(key)


# -- entity graph ------------------------------------------------------------


def entity_nodes(tables: Tables, candidates: bool = False) -> DataFrame:
    """Six entity kinds as nodes, in the fact layout (or as candidates)."""
    def part(df: DataFrame, phase: int, prefix: str, key: str, node_type: str, title: Column,
             section: str, summary: Column | None = None, tags: Column | None = None,
             group: Column | None = None) -> DataFrame:
        values = {
            "id": text_id(prefix, key), "type": F.lit(node_type), "title": title,
            "section": F.lit(section),
            "tags": F.array(F.lit(section)) if tags is None else tags,
            "prov": s.provenance(F.lit(prefix[:-1]), quote=title),
            "ord": s.ordinal(phase, padded(key)),
        }
        if summary is not None:
            values["summary"] = summary
        if group is not None:
            values["meta"] = s.meta(group=group)
        return s.node_candidates(df, **values)

    c = F.col
    rows = union([
        part(tables.part, 7, "part:", "p_partkey", "glossary", c("p_name"), "supply",
             F.concat_ws(" ", "p_type", "p_brand"), F.array("p_brand", "p_type")),
        part(tables.region, 2, "region:", "r_regionkey", "page", c("r_name"), "geo"),
        part(tables.nation, 3, "nation:", "n_nationkey", "concept", c("n_name"), "geo"),
        part(tables.customer, 4, "customer:", "c_custkey", "api_object", c("c_name"), "sales",
             c("c_mktsegment"), F.array("c_mktsegment"), c("c_mktsegment")),
        part(tables.orders, 5, "order:", "o_orderkey", "api_path",
             F.concat(F.lit("order "), c("o_orderkey").cast("string")), "sales",
             c("o_orderpriority"), F.array("o_orderpriority")),
        part(tables.supplier, 6, "supplier:", "s_suppkey", "controller", c("s_name"), "supply"),
    ])
    return rows if candidates else as_facts(rows)


ENTITY_NODES_SQL = """
n AS (
  SELECT 'part:' || p_partkey AS id, 'glossary' AS type, p_name AS title,
         p_type || ' ' || p_brand AS summary, 'supply' AS section, [p_brand, p_type] AS tags,
         NULL::VARCHAR AS meta_group, 7 AS phase, p_partkey AS pos FROM part
  UNION ALL SELECT 'region:' || r_regionkey, 'page', r_name, '', 'geo', ['geo'], NULL, 2,
         r_regionkey FROM region
  UNION ALL SELECT 'nation:' || n_nationkey, 'concept', n_name, '', 'geo', ['geo'], NULL, 3,
         n_nationkey FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'api_object', c_name, c_mktsegment, 'sales',
         [c_mktsegment], c_mktsegment, 4, c_custkey FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'api_path', 'order ' || o_orderkey, o_orderpriority,
         'sales', [o_orderpriority], NULL, 5, o_orderkey FROM orders
  UNION ALL SELECT 'supplier:' || s_suppkey, 'controller', s_name, '', 'supply', ['supply'],
         NULL, 6, s_suppkey FROM supplier
)"""


def part_of_candidates(tables: Tables) -> DataFrame:
    """nation -> region, customer -> nation, order -> customer, supplier -> nation."""
    def part(df: DataFrame, phase: int, child: str, key: str, parent: str, ref: str) -> DataFrame:
        return s.edge_candidates(
            df, from_id=text_id(child, key), to_id=text_id(parent, ref), type=F.lit("part_of"),
            label=F.lit("in"), prov=s.provenance(F.lit(child[:-1])),
            ord=s.ordinal(phase, padded(key)))

    return union([
        part(tables.nation, 1, "nation:", "n_nationkey", "region:", "n_regionkey"),
        part(tables.customer, 2, "customer:", "c_custkey", "nation:", "c_nationkey"),
        part(tables.orders, 3, "order:", "o_orderkey", "customer:", "o_custkey"),
        part(tables.supplier, 4, "supplier:", "s_suppkey", "nation:", "s_nationkey"),
    ])


def order_lines(tables: Tables) -> DataFrame:
    """The columns of order lines that candidates are made of."""
    return tables.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_discount",
        "l_returnflag", "l_linestatus")


def supply_candidates(tables: Tables, lines: DataFrame | None = None) -> DataFrame:
    """part -> supplier, one candidate per order line; lines are dealt out unless given."""
    return s.edge_candidates(
        in_pieces(order_lines(tables), LINE_BYTES) if lines is None else lines,
        from_id=text_id("part:", "l_partkey"), to_id=text_id("supplier:", "l_suppkey"),
        type=F.lit("related_to"), label=F.col("l_returnflag"), weight=F.col("l_quantity"),
        confidence=F.lit(1.0) - F.col("l_discount"),
        derived_by=F.concat(F.lit("line:"), F.col("l_linestatus")),
        prov=s.provenance(F.lit("lineitem"), quote=F.col("l_orderkey").cast("string")),
        ord=s.ordinal(5, padded("l_orderkey"), F.col("l_linenumber")))


def reversed_prerequisites(part_of: DataFrame) -> DataFrame:
    """region -> nation -> customer -> order, and nation -> supplier."""
    return part_of.withColumns({
        "from_id": F.col("to_id"), "to_id": F.col("from_id"),
        "type": F.lit("prerequisite_of"), "label": F.lit("then"),
    })


def entity_edges(tables: Tables, lines: DataFrame | None = None) -> DataFrame:
    """All merged edges. The key-unique kinds need no merge."""
    up = as_facts(part_of_candidates(tables))
    return union([up, reversed_prerequisites(up), merge_edges(supply_candidates(tables, lines))])


PART_OF_SQL = """
p AS (
  SELECT 'nation:' || n_nationkey AS from_id, 'region:' || n_regionkey AS to_id, 1 AS phase,
         n_nationkey::BIGINT AS key FROM nation
  UNION ALL SELECT 'customer:' || c_custkey, 'nation:' || c_nationkey, 2, c_custkey FROM customer
  UNION ALL SELECT 'order:' || o_orderkey, 'customer:' || o_custkey, 3, o_orderkey FROM orders
  UNION ALL SELECT 'supplier:' || s_suppkey, 'nation:' || s_nationkey, 4, s_suppkey FROM supplier
)"""
SUPPLY_SQL = """
m AS (
  SELECT 'part:' || l_partkey AS from_id, 'supplier:' || l_suppkey AS to_id,
         'related_to' AS type,
         arg_min(l_returnflag, row(l_orderkey, l_linenumber)) AS label,
         arg_min(l_quantity, row(l_orderkey, l_linenumber)) AS weight,
         max(1.0::DOUBLE - l_discount) AS confidence,
         arg_min('line:' || l_linestatus,
                 row(-(1.0::DOUBLE - l_discount), l_orderkey, l_linenumber)) AS derived_by,
         count(*)::BIGINT AS n_prov,
         arg_min(l_orderkey, row(l_orderkey, l_linenumber)) AS first_order,
         arg_min(l_linenumber, row(l_orderkey, l_linenumber)) AS first_line
  FROM lineitem GROUP BY 1, 2, 3
)"""
ENTITY_EDGES_SQL = PART_OF_SQL + "," + SUPPLY_SQL + """,
e AS (
  SELECT from_id, to_id, 'part_of' AS type, 'in' AS label, 1.0::DOUBLE AS weight,
         1.0::DOUBLE AS confidence, 'deterministic' AS derived_by, 1::BIGINT AS n_prov,
         phase, key, 0::BIGINT AS pos FROM p
  UNION ALL SELECT to_id, from_id, 'prerequisite_of', 'then', 1.0, 1.0, 'deterministic', 1,
         phase, key, 0 FROM p
  UNION ALL SELECT from_id, to_id, type, label, weight, confidence, derived_by, n_prov,
         5, first_order, first_line FROM m
)"""
SEEN_SQL = """
seen AS (
  SELECT from_id AS id, to_id AS other_id, 'out' AS direction, type, label, confidence FROM e
  UNION ALL SELECT to_id, from_id, 'in', type, label, confidence FROM e
)"""


# -- web graph ---------------------------------------------------------------

PAGE_TITLE = "<title>([^<]*)</title>"
PAGE_HEADING = "<h1>([^<]*)</h1>"
URL_SECTION = "^https?://[^/]+/([^/?#]*)"


def web_docs(tables: Tables) -> DataFrame:
    """Pages as documents whose references are the terms their links name."""
    terms = t.extract_links(F.col("html"), t.HTML_LINK)
    refs = F.transform(terms, lambda path: F.struct(
        F.lit("glossary_tooltip").alias("kind"),
        F.substring(path, 2, 1 << 30).alias("term_id"),
        F.substring(path, 2, 1 << 30).alias("text")))
    return tables.pages.select(
        F.concat(padded("page_id"), F.lit(".md")).alias("rel_path"),
        F.col("html").alias("body_raw"), refs.alias("refs"), "url",
        F.regexp_extract("url", URL_SECTION, 1).alias("section"))


def web_terms(docs: DataFrame) -> DataFrame:
    """(term_id, term_node): the terms that several pages name."""
    named = docs.select("rel_path", F.explode(
        F.array_distinct(F.transform("refs", lambda r: r["term_id"]))).alias("term_id"))
    often = named.groupBy("term_id").agg(F.count(F.lit(1)).alias("n"))
    return often.filter(F.col("n") >= 2).select(
        "term_id", F.concat(F.lit("gloss:"), "term_id").alias("term_node"))


WEB_SQL = """
links AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, 'href="/([^"#?]+)"', 1)) AS term,
         generate_subscripts(regexp_extract_all(html, 'href="/([^"#?]+)"', 1), 1) - 1 AS pos
  FROM pages
),
terms AS (
  SELECT term FROM links GROUP BY term HAVING count(DISTINCT page_id) >= 2
)"""


def web_nodes(tables: Tables) -> DataFrame:
    """Pages as nodes: title, first heading as summary, the whole page as body, URL section."""
    title = F.regexp_extract("html", PAGE_TITLE, 1)
    section = F.regexp_extract("url", URL_SECTION, 1)
    return as_facts(s.node_candidates(
        tables.pages,
        id=F.concat(F.lit("page:"), padded("page_id")), type=F.lit("page"), title=title,
        summary=F.regexp_extract("html", PAGE_HEADING, 1), body=F.col("html"), section=section,
        tags=F.array(section), url=F.col("url"),
        prov=s.provenance(F.lit("pages"), F.col("url"), quote=title),
        ord=s.ordinal(s.PHASE_PAGE, padded("page_id"))))


WEB_NODES_SQL = """
w AS (
  SELECT 'page:' || lpad(page_id::VARCHAR, 19, '0') AS id, 'page' AS type,
         regexp_extract(html, '<title>([^<]*)</title>', 1) AS title,
         regexp_extract(html, '<h1>([^<]*)</h1>', 1) AS summary, html AS body,
         regexp_extract(url, '^https?://[^/]+/([^/?#]*)', 1) AS section, url, page_id
  FROM pages
)"""
