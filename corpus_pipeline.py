"""A corpus pipeline: each stage takes the documents that its predecessor kept.

Stages are functions of (spark, docs, sf_dir) that return a DataFrame; every result is
written as Parquet and read again as the next stage's documents, so no stage repeats
the work of another and a lost executor costs only its own tasks.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import language
from graphloom.llm.common import broadcast_if_small, fresh, prepare
from graphloom.llm.decontaminate import decontaminate
from graphloom.llm.mixing import mix
from graphloom.llm.near_dedup import near_groups
from graphloom.llm.sharding import shard
from graphloom.session import checkpoint_dir, release, stage, staged

#: A text goes when it has no letters, or when less than this share of its trigrams is
#: known in the language it looks most like.
LEAST_KNOWN = 0.3


def keep_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop texts in no known language; the filters are learned from the labelled rows."""
    prepare(spark)
    model = language.learn(docs)
    name = fresh(docs, "_found")
    found = F.col(name)
    known = (found["lang_pred"] != language.UNKNOWN) & (found["score"] >= LEAST_KNOWN)
    return docs.withColumn(name, language.language_of(model, F.col("text"), docs)).filter(known).drop(name)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document of each group of near copies, the one with the smallest id."""
    name = fresh(docs, "_copy")
    copies = stage(near_groups(docs).filter(~F.col("kept")).select(
        F.col("doc_id").alias(name)).distinct(), "copies")
    return docs.join(broadcast_if_small(copies, row_bytes=16), F.col("doc_id") == F.col(name),
                     "left_anti")


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop documents that hold a passage of the benchmark."""
    prepare(spark)
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat documents so that the sources meet their target weights."""
    prepare(spark)
    return mix(docs)


def cut_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Give every row its shard and its slot there."""
    prepare(spark)
    return shard(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", keep_languages),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_benchmark),
    ("mixing", mix_sources),
    ("sharding", cut_shards),
]

#: Language ID and near-duplicate groups cannot be stated in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    folder = f"{checkpoint_dir(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for k, (name, apply) in enumerate(STAGES):
        before = staged()
        apply(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        release(spark, before)  # what the stage wrote for itself
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
