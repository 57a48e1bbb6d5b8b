"""Content hashes, build manifests and incremental re-ingestion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.schema import Graph

_LIMBS = 8


def table_hash(df: DataFrame, digest: Column) -> DataFrame:
    """One row (table_hash, n): an order-free hash of a table.

    ``digest`` is a SHA-256 hex text per row. The digests are added up in eight
    32-bit limbs, which is commutative, so partial sums combine in any order and
    no list of digests is ever built; the sums and the count are hashed last.
    """
    rows = df.select(digest.alias("_d"))
    limbs = [
        F.sum(F.conv(F.substring("_d", 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"_l{i}")
        for i in range(_LIMBS)]
    sums = rows.agg(*limbs, F.count(F.lit(1)).alias("n"))
    parts = [F.coalesce(F.col(f"_l{i}"), F.lit(0)).cast("decimal(38,0)").cast("string")
             for i in range(_LIMBS)]
    return sums.select(F.sha2(F.concat_ws(",", *parts, F.col("n").cast("string")), 256).alias(
        "table_hash"), "n")


def canonical(value: Column, kind: T.DataType) -> Column:
    """A text that tells any two values of a type apart, the same in every engine.

    Strings carry their length, doubles have nine decimals, NULL is ``~``.
    """
    if isinstance(kind, T.StringType):
        text = F.concat(F.length(value).cast("string"), F.lit(":"), value)
    elif isinstance(kind, T.StructType):
        fields = [canonical(value[f.name], f.dataType) for f in kind.fields]
        text = F.when(value.isNotNull(), F.concat(F.lit("("), *fields, F.lit(")")))
    elif isinstance(kind, T.ArrayType):
        items = F.transform(value, lambda x: canonical(x, kind.elementType))
        text = F.concat(F.lit("["), F.array_join(items, ""), F.lit("]"))
    else:
        plain = value.cast("decimal(20,9)") if isinstance(kind, T.DoubleType) else value
        text = F.concat(plain.cast("string"), F.lit(";"))
    return F.coalesce(text, F.lit("~"))


def _fact_hash(df: DataFrame) -> DataFrame:
    # The ordinal is a position in the input, not content; merge counts are derived.
    columns = sorted(c for c in df.columns if c not in ("ord", "best_ord", "duplicates"))
    row = F.concat(*[canonical(F.col(c), df.schema[c].dataType) for c in columns])
    return table_hash(df, F.sha2(row, 256))


def graph_hash(graph: Graph) -> DataFrame:
    """One row (ir_hash): the identity of the graph, whatever its row order."""
    tables = [graph.nodes, graph.edges, graph.node_evidence, graph.edge_evidence]
    joined = None
    for i, df in enumerate(tables):
        part = _fact_hash(df).select(F.lit(1).alias("_one"), F.col("table_hash").alias(f"h{i}"))
        joined = part if joined is None else joined.join(part, "_one")
    names = [f"h{i}" for i in range(len(tables))]
    return joined.select(F.sha2(F.concat_ws("|", *names), 256).alias("ir_hash"))


def document_manifest(docs: DataFrame) -> DataFrame:
    """(rel_path, content_hash) of every document."""
    return docs.select("rel_path", "content_hash")


def corpus_hash(docs: DataFrame) -> DataFrame:
    """One row (corpus_hash, n) over the documents' paths and contents."""
    hashed = table_hash(docs, F.sha2(F.concat_ws("|", "rel_path", "content_hash"), 256))
    return hashed.withColumnRenamed("table_hash", "corpus_hash")


def build_manifest(graph: Graph, docs: DataFrame, generator: str = "graphloom") -> DataFrame:
    """One row: graph and corpus hash, counts, version, generator."""
    one = F.lit(1).alias("_one")
    nodes = graph.nodes.agg(F.count(F.lit(1)).alias("node_count"), one)
    edges = graph.edges.agg(F.count(F.lit(1)).alias("edge_count"), one)
    return (
        graph_hash(graph).withColumn("_one", F.lit(1))
        .join(corpus_hash(docs).drop("n").withColumn("_one", F.lit(1)), "_one")
        .join(nodes, "_one").join(edges, "_one")
        .select("ir_hash", "corpus_hash", "node_count", "edge_count",
                F.lit(graph.meta.get("version")).cast("string").alias("version"),
                F.lit(generator).alias("generator"))
    )


def changed_docs(manifest: DataFrame | None, docs: DataFrame) -> DataFrame:
    """Documents that are new or differ from the manifest; all without a manifest."""
    if manifest is None:
        return docs
    return docs.join(manifest.select("rel_path", "content_hash"),
                     ["rel_path", "content_hash"], "left_anti")


def changed_since(manifest: DataFrame | None, docs: DataFrame) -> bool:
    """Whether anything has to be rebuilt."""
    if manifest is None:
        return True
    known = manifest.select("rel_path", "content_hash")
    gone = known.join(docs.select("rel_path", "content_hash"),
                      ["rel_path", "content_hash"], "left_anti")
    changed = changed_docs(known, docs).select("rel_path").unionByName(gone.select("rel_path"))
    return not changed.isEmpty()
