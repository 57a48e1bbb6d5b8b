"""A graph that follows its documents: only what a batch touches is merged again.

Candidates are kept with the document they come from. A changed or deleted document
retracts all its candidates and brings new ones; the node ids and edge keys of either are
*touched*, and so are edges whose target came or went with another document. Touched keys
are merged anew from their remaining candidates and replace the facts of before. Every
table is a :class:`~graphloom.sources.state.StateTable`, bucketed by what it is looked up by,
so a batch reads the buckets of its own keys.

References and links wait for their targets: an edge candidate carries the key it *needs*
(``term:`` and a glossary term, ``doc:`` and a path), documents *provide* such keys, and an
edge counts only while its need is provided. The graph equals the one that
:func:`~graphloom.plans.compile.compile_graph` builds from the current documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from graphloom import schema as s
from graphloom.functions import text as t
from graphloom.operators import builders as b
from graphloom.operators import refine
from graphloom.operators.skew import skewed_join
from graphloom.plans.compile import CompileOptions, document_parts, fixed_parts, prune, tagged
from graphloom.schema import Graph
from graphloom.session import stage
from graphloom.sources.api_spec import spec_definitions
from graphloom.sources.state import BUCKETS, MOST_DELTAS, StateTable
from graphloom.streaming.ingest import write_batch

_DOC = T.StructField("doc", T.StringType())
_NEEDS = T.StructField("needs", T.StringType())


def _layout(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


class IncrementalGraph:
    """The maintained graph under ``path``."""

    def __init__(self, spark: SparkSession, path: str, options: CompileOptions | None = None,
                 spec: DataFrame | None = None, buckets: int = BUCKETS,
                 most_deltas: int = MOST_DELTAS) -> None:
        self.spark, self.opt, self.spec = spark, options or CompileOptions(), spec
        if self.opt.begin_sections or self.opt.model_passes is not None:
            raise ValueError("begin sections and model passes look at the whole graph: compile it")

        def table(name: str, layout: T.StructType, key: list[str], by: list[str] | None = None):
            return StateTable(spark, f"{path}/{name}", layout, key, by, buckets, most_deltas)

        self.node_rows = table("node_rows", T.StructType([*s.NODE_CANDIDATES.fields, _DOC]), ["doc"], ["id"])
        self.edge_rows = table("edge_rows", T.StructType([*s.EDGE_CANDIDATES.fields, _DOC, _NEEDS]),
                               ["doc"], s.EDGE_KEY)
        # What a document stands for: node ids, edge keys and provided keys.
        self.of_doc = table("of_doc", _layout("doc", "kind", *s.EDGE_KEY), ["doc"])
        self.by_need = table("by_need", _layout("doc", "needs", *s.EDGE_KEY), ["doc"], ["needs"])
        self.provided = table("provided", _layout("doc", "item"), ["doc"], ["item"])
        self.nodes = table("nodes", s.NODES, ["id"])
        self.edges = table("edges", s.EDGES, s.EDGE_KEY)

    # -- candidates

    def _of_documents(self, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
        """Nodes (with doc), edges (with doc and needs) and provided keys of some documents.

        Every term and path that a document names counts as known here.
        """
        docs = stage(b.with_front_matter(docs), "changed-parsed")
        pages = docs.filter(~b.is_glossary())
        named = pages.select(F.explode("refs.term_id").alias("term_id")).distinct()
        terms = named.withColumn("term_node", F.concat(F.lit("gloss:"), "term_id"))
        targets = b.doc_links(pages).select(F.col("target_path").alias("rel_path")).distinct()
        kinds = None if self.spec is None else b.api_kinds(spec_definitions(self.spec))
        nodes, edges = document_parts(docs, self.opt, terms, targets, kinds, per_document=True)
        node_rows = tagged(self.spark, nodes, self.opt, flows=False).withColumn("doc", F.col("ord.doc"))
        term = F.concat(F.lit("term:"), F.substring("to_id", len("gloss:") + 1, 1 << 30))
        link = F.concat(F.lit("doc:"), t.link_rel_path(F.col("label")))
        needs = F.when(F.col("type").isin("references", "defines"), term).when(
            F.col("type") == "links_to", link)
        edge_rows = edges[0]
        for part in edges[1:]:
            edge_rows = edge_rows.unionByName(part)
        edge_rows = edge_rows.withColumn("doc", F.col("ord.doc")).withColumn("needs", needs)
        glossary = b.glossary_nodes(docs, self.opt.version).select(
            F.col("ord.doc").alias("doc"),
            F.concat(F.lit("term:"), F.substring("id", len("gloss:") + 1, 1 << 30)).alias("item"))
        provided = glossary.union(pages.select("rel_path", F.concat(F.lit("doc:"), "rel_path")))
        return node_rows, edge_rows, provided

    def _fixed(self) -> tuple[DataFrame, DataFrame]:
        nodes, edges = fixed_parts(self.spark, self.spec, self.opt)
        edge_rows = edges[0]
        for part in edges[1:]:
            edge_rows = edge_rows.unionByName(part)
        none = F.lit(None).cast("string")
        return (tagged(self.spark, nodes, self.opt).withColumn("doc", F.lit("")),
                edge_rows.withColumn("doc", F.lit("")).withColumn("needs", none))

    # -- a batch

    def apply(self, batch: int, changed: DataFrame, paths: DataFrame) -> None:
        """Bring the graph up to a batch: ``changed`` documents, and the ``paths`` (rel_path) of
        those and the deleted ones. The first batch also brings what no document changes."""
        nodes, edges, provided = self._of_documents(changed)
        docs = paths.select(F.col("rel_path").alias("doc"))
        first = self.node_rows.parts(before=batch) == (None, [])
        if first:
            more_nodes, more_edges = self._fixed()
            nodes, edges = nodes.unionByName(more_nodes), edges.unionByName(more_edges)
            docs = docs.union(self.spark.range(1).select(F.lit("").alias("doc")))
        nodes, edges = stage(nodes, "new-node-rows"), stage(edges, "new-edge-rows")
        provided, docs = stage(provided, "new-provided"), stage(docs, "batch-docs")
        none = F.lit(None).cast("string")
        stands = nodes.select("doc", F.lit("node").alias("kind"), F.col("id").alias("from_id"),
                              none.alias("type"), none.alias("to_id")).union(
            edges.select("doc", F.lit("edge"), *s.EDGE_KEY)).union(
            provided.select("doc", F.lit("item"), "item", none, none)).distinct()
        before = stage(self.of_doc.read(before=batch, wanted=docs), "old-of-doc")
        both = stage(before.union(stands).select("kind", *s.EDGE_KEY).distinct(), "touched")
        ids = both.filter("kind = 'node'").select(F.col("from_id").alias("id"))
        items = both.filter("kind = 'item'").select(F.col("from_id").alias("item"))

        def there(until: int) -> DataFrame:
            return self.provided.read(before=until, wanted=items).select("item").distinct()

        was = stage(there(batch), "items-before")
        self.node_rows.write(batch, nodes, docs)
        self.edge_rows.write(batch, edges, docs)
        self.provided.write(batch, provided, docs)
        self.by_need.write(batch, edges.filter("needs IS NOT NULL").select(
            "doc", "needs", *s.EDGE_KEY).distinct(), docs)
        now = stage(there(batch + 1), "items-after")
        flipped = was.join(now, "item", "left_anti").union(now.join(was, "item", "left_anti"))
        waiting = self.by_need.read(before=batch + 1, wanted=flipped.select(F.col("item").alias("needs")))
        keys = stage(both.filter("kind = 'edge'").select(*s.EDGE_KEY).union(
            waiting.select(*s.EDGE_KEY)).distinct(), "touched-edges")
        # Of the first batch all rows are touched.
        node_rows = nodes if first else self.node_rows.read(batch + 1, wanted=ids)
        edge_rows = edges if first else self.edge_rows.read(batch + 1, wanted=keys)
        self.nodes.write(batch, self._merged_nodes(node_rows), ids)
        self.edges.write(batch, refine.merge_edges(self._resolved(edge_rows, batch + 1)), keys)
        # Last, so that a batch that failed half-way still finds what it replaces.
        self.of_doc.write(batch, stands, docs)

    @staticmethod
    def _one_per_concept(rows: DataFrame) -> DataFrame:
        """A heading's first use alone is the concept; later ones are no evidence for it."""
        heading = (F.col("type") == "concept") & (F.col("ord.phase") == s.PHASE_PAGE)
        columns = s.NODE_CANDIDATES.fieldNames()
        first = rows.filter(heading).groupBy("id").agg(
            F.min_by(F.struct(*columns), "ord").alias("r")).select("r.*")
        return rows.filter(~heading).select(*columns).unionByName(first)

    def _merged_nodes(self, rows: DataFrame) -> DataFrame:
        return refine.dedupe_nodes(self._one_per_concept(rows))

    def _resolved(self, rows: DataFrame, until: int | None = None) -> DataFrame:
        """Edge candidates whose need is provided, or that need nothing."""
        rows = stage(rows, "edge-rows")
        free, bound = rows.filter("needs IS NULL"), rows.filter("needs IS NOT NULL")
        wanted = bound.select(F.col("needs").alias("item")).distinct()
        there = self.provided.read(before=until, wanted=wanted).select(
            F.col("item").alias("needs")).distinct()
        met = skewed_join(bound, there, "needs", "left_semi", salt_by=["from_id"])
        columns = s.EDGE_CANDIDATES.fieldNames()
        return free.select(*columns).unionByName(met.select(*columns))

    # -- reading

    def graph(self) -> Graph:
        """The pruned graph of the current documents, with its evidence."""
        node_rows = self._one_per_concept(self.node_rows.read())
        found = Graph(
            nodes=self.nodes.read(), edges=self.edges.read(),
            node_evidence=refine.node_evidence(node_rows),
            edge_evidence=refine.edge_evidence(self._resolved(self.edge_rows.read())),
            meta={"version": self.opt.version, "source_label": self.opt.source_label,
                  "generator": "graphloom"})
        return prune(found, self.opt.body_max_chars)


def graph_stream(texts: DataFrame, target: str, checkpoint: str, graph: IncrementalGraph,
                 **options: int) -> StreamingQuery:
    """Ingest a streaming DataFrame of texts (rel_path, text, url, section; without a text: the
    document is gone) and keep the graph up with it; stops when caught up."""

    def run(df: DataFrame, batch: int) -> None:
        changed, paths = write_batch(df, batch, target, **options)
        graph.apply(batch, changed, paths)

    return (texts.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint)
            .trigger(availableNow=True).start())
