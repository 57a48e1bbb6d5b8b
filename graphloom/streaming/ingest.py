"""Incremental ingestion with Structured Streaming.

Each micro-batch is compared with the manifest and only new or changed documents
are written. Manifest and documents are state tables (:mod:`graphloom.sources.state`):
a batch adds the rows of its documents, readers see the newest ones, and older ones are
folded away, so a run reads the live rows and a few deltas however many runs there were.
A batch that is run again after a failure has the same effect once. The comparison is an
anti-join with the manifest table rather than streaming state.

A file stream sees every path once. Where files are rewritten in place or deleted,
``sync_corpus`` compares a listing with the manifest instead: each run is one batch.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from graphloom import schema as s
from graphloom.functions.text import content_hash
from graphloom.operators.manifest import changed_docs
from graphloom.session import stage
from graphloom.sources.corpus import docs_from_texts, markdown_texts, relative_path
from graphloom.sources.state import StateTable

MANIFEST = T.StructType([T.StructField("rel_path", T.StringType()),
                         T.StructField("content_hash", T.StringType())])
LISTING = "rel_path STRING, modificationTime TIMESTAMP, length BIGINT, batch BIGINT"


def _read(spark: SparkSession, path: str, layout: str) -> DataFrame | None:
    try:
        return spark.read.schema(layout).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None


def manifest_table(spark: SparkSession, target: str, **options: int) -> StateTable:
    return StateTable(spark, f"{target}/manifest", MANIFEST, ["rel_path"], **options)


def docs_table(spark: SparkSession, target: str, **options: int) -> StateTable:
    return StateTable(spark, f"{target}/docs", s.DOCS, ["rel_path"], **options)


def read_manifest(spark: SparkSession, target: str, before: int | None = None,
                  **options: int) -> DataFrame:
    """(rel_path, content_hash) of every document that is there."""
    return manifest_table(spark, target, **options).read(before)


def read_latest_docs(spark: SparkSession, target: str, **options: int) -> DataFrame:
    """The current version of every ingested document."""
    return docs_table(spark, target, **options).read()


def one_per_path(texts: DataFrame) -> DataFrame:
    """The last delivery of each path in a batch, by ``seq``.

    Without ``seq`` nothing says which delivery is the last, so different ones are an error.
    """
    rest = [c for c in texts.columns if c not in ("rel_path", "seq")]
    if "seq" in texts.columns:
        last = texts.groupBy("rel_path").agg(F.max_by(F.struct(*rest), "seq").alias("r"))
        return last.select("rel_path", "r.*")
    if texts.groupBy("rel_path").count().filter("count > 1").isEmpty():
        return texts  # only the paths were shuffled
    code = F.xxhash64(*rest)
    found = texts.groupBy("rel_path").agg(
        F.first(F.struct(*rest)).alias("r"), (F.min(code) != F.max(code)).alias("differ"))
    message = F.concat(F.lit("a batch has several versions of "), "rel_path",
                       F.lit("; give their order in a column seq"))
    checked = F.when(F.col("differ"), F.raise_error(message)).otherwise(F.col("rel_path"))
    return found.select(checked.alias("rel_path"), "r.*")


def write_batch(texts: DataFrame, batch_id: int, target: str, deleted: DataFrame | None = None,
                **options: int) -> tuple[DataFrame, DataFrame]:
    """Ingest one micro-batch of (rel_path, text, url, section[, seq]).

    Rows without a text, and the paths in ``deleted`` (rel_path), are documents that are gone.
    Returns the documents that are new or changed, and the paths of those and the deleted ones.
    """
    spark = texts.sparkSession
    latest = one_per_path(texts)
    manifest = manifest_table(spark, target, **options)
    there = latest.filter(F.col("text").isNotNull())
    known = manifest.read(before=batch_id, wanted=latest.select("rel_path"))
    # Documents are compared by their hashes; whole ones move to be written.
    hashes = there.select("rel_path", content_hash(F.col("text")).alias("content_hash"))
    hashes = stage(changed_docs(known, hashes).select("rel_path", "content_hash"), "changed-hashes")
    if manifest.parts(before=batch_id) != (None, []):
        fresh = hashes.select(F.col("rel_path").alias("_path"))
        there = there.join(fresh, F.col("rel_path").eqNullSafe(F.col("_path")), "left_semi")
    gone = latest.filter(F.col("text").isNull()).select("rel_path")
    if deleted is not None:
        gone = gone.union(deleted.select("rel_path"))
    keys = stage(hashes.select("rel_path").union(gone).distinct(), "changed-paths")
    docs = docs_table(spark, target, **options)
    docs.write(batch_id, docs_from_texts(there), keys)
    manifest.write(batch_id, hashes, keys)
    return docs.delta(batch_id), keys


def ingest_stream(texts: DataFrame, target: str, checkpoint: str, **options: int) -> StreamingQuery:
    """Start ingesting a streaming DataFrame of texts; stops when caught up."""
    return (
        texts.writeStream.foreachBatch(lambda df, batch: write_batch(df, batch, target, **options))
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def markdown_stream(spark: SparkSession, root: str, max_files: int = 10_000) -> DataFrame:
    """New ``*.md`` files under ``root`` as a stream of texts; rewritten ones need sync_corpus."""
    files = (
        spark.readStream.format("text").option("wholetext", "true")
        .option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md")
        .option("maxFilesPerTrigger", max_files).load(root)
    )
    return markdown_texts(files, root).withColumn("url", F.lit(None).cast("string"))


def sync_corpus(spark: SparkSession, root: str, target: str) -> int:
    """Bring ``target`` up to the ``*.md`` files under ``root``; returns the batch number.

    Files are listed without being opened. Those modified since the last listing are read
    (all of them when a path is new but old, as after a move), and of these only documents
    with another content hash are written. Listed paths that are gone become deletions. A
    run that failed is repeated under the same number.
    """
    def markdown(fmt: str):
        return spark.read.format(fmt).option("recursiveFileLookup", "true").option(
            "pathGlobFilter", "*.md")

    listed = stage(markdown("binaryFile").load(root).select(
        relative_path(root).alias("rel_path"), "modificationTime", "length"), "listing")
    before = _read(spark, f"{target}/listing", LISTING)
    batch, files, deleted = 0, markdown("text").option("wholetext", "true"), None
    if before is not None:
        batch = before.agg(F.max("batch")).first()[0] + 1
        before = before.filter(F.col("batch") == batch - 1)
        since = before.agg(F.max("modificationTime").cast("string")).first()[0]
        fresh = listed.join(before, "rel_path", "left_anti")
        if since and fresh.filter(F.col("modificationTime") <= since).isEmpty():
            # Equal times are read again: a file may have changed twice within one tick.
            earlier = spark.sql(
                f"SELECT date_format(TIMESTAMP'{since}' - INTERVAL 1 SECOND, "
                "\"yyyy-MM-dd'T'HH:mm:ss\")").first()[0]
            files = files.option("modifiedAfter", earlier).option(
                "timeZone", spark.conf.get("spark.sql.session.timeZone"))
        known = read_manifest(spark, target, before=batch)
        deleted = known.join(listed.select("rel_path"), "rel_path", "left_anti")
    texts = markdown_texts(files.load(root), root).withColumn("url", F.lit(None).cast("string"))
    write_batch(texts, batch, target, deleted)
    listed.write.mode("overwrite").parquet(f"{target}/listing/batch={batch}")
    return batch
