"""Documents as rows.

Every reader returns the ``DOCS`` layout. ``rel_path`` is both the key and the
order of the documents, so no global numbering pass is needed.
"""

from __future__ import annotations

import os
import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, DataFrameReader, SparkSession
from pyspark.sql import functions as F

from graphloom.functions import text as t
from graphloom.sources import listing

# Defaults of a documentation checkout.
DOCS_BASE_URL = "https://kubernetes.io"
EXCLUDED_SECTIONS = ["contribute"]


def docs_from_texts(texts: DataFrame) -> DataFrame:
    """``DOCS`` from rows (rel_path, text, url, section).

    The shortcode tokens are computed once and feed both the normalised body and
    the references; columns nobody reads are pruned before they are computed.
    """
    split = texts.withColumn("_parts", t.split_front_matter(F.col("text"))).select(
        "rel_path", "url", "section", "text",
        F.col("_parts.front_matter").alias("front_matter"),
        F.col("_parts.body").alias("body_raw"),
    )
    tokens = split.withColumn("_tokens", t.shortcode_tokens(F.col("body_raw")))
    return tokens.select(
        "rel_path", "front_matter", "body_raw",
        t.normalize_tokens(F.col("_tokens")).alias("body_norm"),
        t.refs_of_tokens(F.col("_tokens")).alias("refs"),
        t.content_hash(F.col("text")).alias("content_hash"),
        "url", "section",
    )


def doc_url(rel_path: Column, base_url: str | None) -> Column:
    if base_url is None:
        return F.lit(None).cast("string")
    stem = F.replace(rel_path, F.lit(".md"), F.lit("/"))
    return F.concat(F.lit(base_url.rstrip("/") + "/docs/"), stem)


def _absolute(root: str) -> str:
    remote = re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*:", root)
    return root.rstrip("/") if remote else os.path.abspath(root)


def _decode_path(path: Column) -> Column:
    # url_decode would turn a literal plus sign into a blank.
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def relative_path(root: str) -> Column:
    """The path below ``root`` of the file a row was read from."""
    marker = re.sub(r"^file:/*", "/", _absolute(root)) + "/"
    path = _decode_path(F.col("_metadata.file_path"))
    return F.substring(path, F.position(F.lit(marker), path) + len(marker), F.lit(1 << 30))


def markdown_texts(files: DataFrame, root: str) -> DataFrame:
    """(rel_path, text, section) of whole-text file rows, batch or streaming."""
    rows = files.select(relative_path(root).alias("rel_path"), _unix(F.col("value")).alias("text"))
    return rows.withColumn("section", _section())


def _unix(text: Column) -> Column:
    return F.regexp_replace(text, "\r\n?", "\n")


def _section() -> Column:
    return t.section_from_path(F.concat(F.lit("docs/"), F.col("rel_path")))


def whole_texts(files: DataFrameReader, root: str) -> DataFrame:
    """(value) of every file as one text, as ``text(wholetext=True)`` gives it.

    That source copies the Hadoop configuration for every file, which takes longer than
    reading a small one.
    """
    return files.format("binaryFile").load(root).withColumn("value", F.col("content").cast("string"))


def read_markdown_corpus(spark: SparkSession, root: str,
                         exclude_sections: Sequence[str] = EXCLUDED_SECTIONS,
                         base_url: str | None = DOCS_BASE_URL) -> DataFrame:
    """All ``*.md`` files under ``root``, one row per file.

    Files of zero bytes are left out. The section filter depends only on the file path: excluded
    files are not opened. Tasks list the folder, and read it if it has very many files, as Spark's
    file sources would keep every file in the driver's memory. Patterns of paths, and stores that
    ``pyarrow.fs`` does not reach, are left to Spark.
    """
    folder = listing.folder_of(spark, root)
    listed = listing.list_files(spark, folder, ".md") if folder else None
    n = listed.count() if folder else 0
    if n > listing.MANY_FILES:
        rows = listed.withColumn("section", _section())
    else:
        files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md")
        rows = markdown_texts(whole_texts(files, root), root)
    if exclude_sections:
        rows = rows.filter(~F.col("section").isin(list(exclude_sections)))
    if n > listing.MANY_FILES:
        read = listing.read_files(rows.select("rel_path"), folder, n)
        rows = read.select("rel_path", _unix(F.col("content").cast("string")).alias("text"),
                           _section().alias("section"))
    return docs_from_texts(rows.withColumn("url", doc_url(F.col("rel_path"), base_url)))


def read_fixture_corpus(spark: SparkSession, root: str) -> DataFrame:
    """A sample corpus: no excluded sections and no public URLs."""
    return read_markdown_corpus(spark, root, exclude_sections=(), base_url=None)


def corpus_from_table(df: DataFrame, rel_path: Column, text: Column,
                      url: Column | None = None, section: Column | None = None) -> DataFrame:
    """Documents from any table that has a key and a text column."""
    if section is None:
        section = t.section_from_path(F.concat(F.lit("docs/"), rel_path))
    return docs_from_texts(df.select(
        rel_path.alias("rel_path"), text.alias("text"),
        (F.lit(None) if url is None else url).cast("string").alias("url"),
        section.alias("section"),
    ))
