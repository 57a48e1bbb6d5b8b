"""The operators of this package as queries on the driver's tables, with their SQL.

SQL is given where it can state the whole result. Language ID, near-duplicate groups,
secrets, language-model scores, the classifier, CRC sums and fuzzy matches have none;
tests compare those queries with brute force on small tables.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm import language, quality
from graphloom.llm.common import crc, prepare
from graphloom.llm.decontaminate import leaks
from graphloom.llm.exact_dedup import exact_dedup
from graphloom.llm.katz import score_texts
from graphloom.llm.line_dedup import dedup_lines
from graphloom.llm.mixing import with_copies
from graphloom.llm.near_dedup import near_groups
from graphloom.llm.prefix_trie import paths, prefix_trie, rebuilt, turn_lists
from graphloom.llm.secrets import common_words, secrets_of
from graphloom.llm.sharding import SHARDS, places
from graphloom.llm.token_files import read_tokens, token_folder, write_tokens
from graphloom.llm.whitening import whitened_rows
from graphloom.session import stage

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


def table(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir))


@query
def op2_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_groups(table(spark, sf_dir))


@query
def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    held_out = F.pmod(crc(F.col("doc_id")), F.lit(4)) == 2
    model = language.learn(docs.filter(~held_out))
    found = language.language_of(model, F.col("text"), docs)
    return docs.select("doc_id", held_out.alias("held_out"), found.alias("found")).select(
        "doc_id", "held_out", "found.lang_pred", "found.score")


@query
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir))


ORACLES["op4_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS chars,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS h
  FROM documents),
k AS (
  SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS group_size,
         first_value(doc_id) OVER (PARTITION BY h ORDER BY chars DESC, doc_id) AS keep_id
  FROM d)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, h AS text_sha256 FROM k
"""


@query
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    ranks = common_words(F.col("text"), docs)
    return docs.select("doc_id", secrets_of(F.col("text"), ranks=ranks).alias("found")).select(
        "doc_id", "found.*")


@query
def op6_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.pmod(crc(F.col("doc_id")), F.lit(5)) == 1
    scored = score_texts(table(spark, sf_dir), ~held_out)
    return scored.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens",
        "base_score", "score")


@query
def op7_quality_pu(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir), table(spark, sf_dir, "labels")
    held_out = F.pmod(crc(F.col("doc_id")), F.lit(4)) == 2
    model = quality.learn(docs.filter(~held_out), labels.filter(~held_out))
    score = quality.quality_of(model, F.col("text"), docs)
    return docs.select("doc_id", held_out.alias("held_out"), score.alias("score")).withColumn(
        "predicted", (F.col("score") >= 0.7).cast("int"))


@query
def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir)
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint") + 1
    # All the query needs of a text besides its place fits the tie-breaking content.
    rows = docs.select(F.col("doc_id").alias("id"), "source",
                       F.struct(size.alias("size"), crc(F.col("text")).alias("crc")).alias("content"))
    return places(rows, SHARDS).select(
        F.col("id").alias("doc_id"), F.col("content.size").alias("size"),
        F.col("content.crc").alias("text_crc32"), F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = with_copies(table(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select(
        "doc_id", "_mix.size", "_mix.source_size", "_mix.target",
        (F.col("_mix.size") * F.col("_mix.copies")).alias("taken"),
    )


ORACLES["op9_mixing"] = """
WITH d AS (
  SELECT doc_id, source,
         CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY 3.0 * source_size / w, w) AS i,
         coalesce(sum(3 * source_size) OVER before, 0) AS capped,
         sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS free,
         sum(source_size) OVER () AS total
  FROM s
  WINDOW before AS (ORDER BY 3.0 * source_size / w, w
                    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l AS (
  SELECT min_by((total - capped)::DOUBLE / free::DOUBLE, i) AS level FROM o
  WHERE (total - capped)::DOUBLE / free::DOUBLE <= 3.0 * source_size / w),
t AS (
  SELECT source, source_size, least(3.0::DOUBLE * source_size, level * w) AS target FROM s, l),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS rate,
         ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT
           / 4503599627370496.0::DOUBLE AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)
            AS BIGINT) AS taken
FROM r
"""


@query
def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir), table(spark, sf_dir, "benchmark"))


@query
def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = stage(turn_lists(table(spark, sf_dir, "conversations")), "turn-lists")
    return prefix_trie(paths(rebuilt(lists)))


# CRC-32 is folded over the decimal's bytes; nodes are joined by their whole prefixes.
ORACLES["op11_prefix_trie"] = """
WITH bits AS (
  SELECT i, list_reduce(list_concat([i], range(8)), lambda c, j:
           CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
  FROM range(256) t(i)),
crcs AS (SELECT list(v ORDER BY i) AS tab FROM bits),
t AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
                       ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
h AS (
  SELECT conv_id, own, conv_id - conv_id % 100 AS head_of,
         xor(list_reduce(list_concat([4294967295],
             list_transform(range(1, len(conv_id::VARCHAR) + 1),
                            lambda k: ascii(substr(conv_id::VARCHAR, k, 1))::BIGINT)),
             lambda c, b: xor(c >> 8, tab[(xor(c, b) & 255) + 1])), 4294967295) % 6 AS h
  FROM t, crcs),
r AS (
  SELECT h.conv_id, list_concat(coalesce(list_slice(b.own, 1, h), []), list_slice(h.own, h + 1, len(h.own))) AS seq
  FROM h LEFT JOIN t b ON b.conv_id = h.head_of),
p AS (
  SELECT conv_id, d, list_slice(seq, 1, d) AS pre, d = len(seq) AS ends
  FROM r, range(10000) g(d) WHERE d <= len(seq)),
n AS (
  SELECT pre, d AS depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256
  FROM p GROUP BY pre, d),
c AS (SELECT list_slice(pre, 1, depth - 1) AS pre, count(*) AS n_children FROM n WHERE depth > 0 GROUP BY 1),
m AS (SELECT n.*, coalesce(n_children, 0) AS n_children FROM n LEFT JOIN c USING (pre)),
s AS (
  SELECT list_slice(pre, 1, g.d) AS pre, count(*) FILTER (n_children = 0) AS n_leaves,
         sum(CASE WHEN depth > 0 THEN (n_convs - 1) * length(pre[depth].t) ELSE 0 END) AS saved
  FROM m, range(10000) g(d) WHERE g.d <= depth GROUP BY 1)
SELECT m.conv_id, m.depth, u.conv_id AS parent_conv_id, m.n_convs, m.n_children, s.n_leaves,
       s.saved::BIGINT AS saved_tokens, m.ends_sha256
FROM m JOIN s USING (pre) LEFT JOIN n u ON m.depth > 0 AND u.pre = list_slice(m.pre, 1, m.depth - 1)
"""


@query
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened_rows(table(spark, sf_dir, "embeddings"))


@query
def op13_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = token_folder(spark)
    files = write_tokens(table(spark, sf_dir), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return read_tokens(spark, files, folder).select(
        "doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
