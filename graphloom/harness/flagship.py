"""The flagship query: pages to references to the top terms of every page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.harness.base import WEB_SQL, Tables, query, web_docs, web_terms
from graphloom.operators import builders, refine
from graphloom.operators.skew import top_per_group


@query("top_terms_per_page", f"""
WITH {WEB_SQL}, r AS (
  SELECT page_id, term, count(*) AS mentions, min(pos) AS first_pos FROM links
  SEMI JOIN terms USING (term) GROUP BY page_id, term)
SELECT 'page:' || lpad(page_id::VARCHAR, 19, '0') AS page_id, 'gloss:' || term AS term_id,
       mentions::BIGINT AS mentions, rank
FROM (SELECT *, row_number() OVER (PARTITION BY page_id
        ORDER BY mentions DESC, term)::INT AS rank FROM r) WHERE rank <= 25""")
def top_terms_per_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = web_docs(Tables(spark, sf_dir))
    edges = refine.merge_edges(builders.reference_edges(docs, web_terms(docs)))
    named = edges.select(F.col("from_id").alias("page_id"), F.col("to_id").alias("term_id"),
                         F.col("n_prov").alias("mentions"))
    return top_per_group(named, ["page_id"], [F.desc("mentions"), F.asc("term_id")], 25)
