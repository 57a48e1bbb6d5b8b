"""Sources and text functions on documents and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.functions import text as t
from graphloom.functions.front_matter import front_matter_fields
from graphloom.harness.base import Tables, query
from graphloom.operators import refine
from graphloom.operators.builders import before_you_begin_edges
from graphloom.sources.corpus import corpus_from_table, doc_url


@query("corpus_docs", """
SELECT lang || '/' || source || '/' || doc_id || '.md' AS rel_path, lang AS section,
       sha256(text) AS content_hash, length(text)::BIGINT AS n_chars
FROM documents""")
def corpus_docs(spark, sf_dir) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    path = F.concat_ws("/", "lang", "source",
                       F.concat(F.col("doc_id").cast("string"), F.lit(".md")))
    corpus = corpus_from_table(docs, path, F.col("text"))
    return corpus.select("rel_path", "section", "content_hash",
                         F.length("body_raw").cast("bigint").alias("n_chars"))


@query("corpus_pages", """
SELECT 'docs/' || page_id || '.md' AS rel_path, 'https://kubernetes.io/docs/docs/' || page_id
       || '/' AS url, 'docs' AS section, sha256(html) AS content_hash
FROM pages""")
def corpus_pages(spark, sf_dir) -> DataFrame:
    pages = Tables(spark, sf_dir).pages
    path = F.concat(F.lit("docs/"), F.col("page_id").cast("string"), F.lit(".md"))
    corpus = corpus_from_table(pages, path, F.col("html"), doc_url(path, "https://kubernetes.io"))
    return corpus.select("rel_path", "url", "section", "content_hash")


def _front_matter_text():
    return F.concat(
        F.lit('---\ntitle: "T'), F.col("doc_id").cast("string"), F.lit('"\nid: d'),
        F.col("doc_id").cast("string"), F.lit("\nweight: "),
        (F.col("n_chars") % 100).cast("string"),
        F.lit("\ndescription: >\n  From\n  "), F.col("source"),
        F.lit("\ntags:\n- "), F.col("lang"), F.lit("\n- "), F.col("source"),
        F.lit("\n---\n"), F.col("text"))


@query("front_matter", """
SELECT doc_id, 'T' || doc_id AS title, 'd' || doc_id AS fm_id, (n_chars % 100)::INT AS weight,
       'From ' || source || chr(10) AS description, lang || ',' || source AS tags, sha256(text) AS body_hash
FROM documents""")
def front_matter(spark, sf_dir) -> DataFrame:
    docs = Tables(spark, sf_dir).spread("documents")
    parts = docs.select("doc_id", t.split_front_matter(_front_matter_text()).alias("p"))
    fields = parts.select("doc_id", "p.body", front_matter_fields(F.col("p.front_matter")).alias("f"))
    return fields.select(
        "doc_id", "f.title", F.col("f.id").alias("fm_id"), "f.weight", "f.description",
        F.array_join("f.tags", ",").alias("tags"), t.content_hash(F.col("body")).alias("body_hash"))


def _shortcode_text():
    return F.concat(
        F.lit('See {{< glossary_tooltip text="'), F.col("lang"), F.lit('" term_id="'),
        F.col("source"), F.lit('" >}} and {{< glossary_definition term_id="'), F.col("lang"),
        F.lit('" >}}.\n{{% note %}}'), F.col("text"), F.lit("{{% /note %}}\n<!--more-->"),
        F.lit('{{< figure src="a.png" alt="'), F.col("source"),
        F.lit('" caption="c" >}}end {{< open >}}x{{< tabs >}}'),
        F.lit('{{< glossary_tooltip term_id="hidden" >}}{{< /tabs >}}'))


@query("shortcode_norm", r"""
SELECT doc_id,
       'See [' || lang || '](#gloss:' || source || ') and [definition:' || lang || '].' || chr(10)
       || chr(10) || '> **Note:** ' || regexp_replace(text, '^\s+|\s+$', '', 'g') || chr(10)
       || chr(10) || chr(10) || '![' || source || '](a.png) — c' || chr(10) || 'end x' AS body
FROM documents""")
def shortcode_norm(spark, sf_dir) -> DataFrame:
    docs = Tables(spark, sf_dir).spread("documents")
    return docs.select("doc_id", t.normalize_shortcodes(_shortcode_text()).alias("body"))


@query("shortcode_blocks", r"""
SELECT doc_id,
  CASE doc_id % 4
    WHEN 0 THEN chr(10) || '```mermaid' || chr(10) || inside || chr(10) || '```' || chr(10)
    WHEN 1 THEN chr(10) || '<details><summary>' || source || '</summary>' || chr(10) || chr(10)
                || inside || chr(10) || '</details>' || chr(10)
    WHEN 2 THEN chr(10) || '> **Warning:** ' || inside || chr(10)
    ELSE ' ' || text || ' ' END || '|' AS body
FROM (SELECT doc_id, source, text, regexp_replace(text, '^\s+|\s+$', '', 'g') AS inside FROM documents)""")
def shortcode_blocks(spark, sf_dir) -> DataFrame:
    docs = Tables(spark, sf_dir).spread("documents")
    names = F.array(*[F.lit(n) for n in ("mermaid", "details", "warning", "tabs")])
    name = F.get(names, (F.col("doc_id") % 4).cast("int"))
    body = F.concat(
        F.lit("{{< "), name, F.lit(' summary="old" summary="'), F.col("source"), F.lit('" >}} '),
        F.col("text"), F.lit(" {{< /"), name,
        F.lit(" >}}|{{< /gone >}}"))
    return docs.select("doc_id", t.normalize_shortcodes(body).alias("body"))


@query("shortcode_refs", """
SELECT doc_id, 0 AS pos, 'glossary_tooltip' AS kind, source AS term_id, lang AS ref_text
FROM documents
UNION ALL SELECT doc_id, 1, 'glossary_definition', lang, NULL FROM documents""")
def shortcode_refs(spark, sf_dir) -> DataFrame:
    docs = Tables(spark, sf_dir).spread("documents")
    refs = docs.select("doc_id", F.posexplode(t.extract_refs(_shortcode_text())).alias("pos", "r"))
    return refs.select("doc_id", "pos", "r.kind", "r.term_id", F.col("r.text").alias("ref_text"))


@query("shortcode_attrs", """
SELECT doc_id, lang AS a, source AS b, NULL::VARCHAR AS c, 2 AS n FROM documents""")
def shortcode_attrs(spark, sf_dir) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    raw = F.concat(F.lit('a="first" b = "'), F.col("source"), F.lit('" a="'), F.col("lang"),
                   F.lit('"'))
    attrs = docs.select("doc_id", t.shortcode_attrs(raw).alias("m"))
    return attrs.select(
        "doc_id", *[F.try_element_at("m", F.lit(k)).alias(k) for k in ("a", "b", "c")],
        F.size("m").alias("n"))


@query("html_links", """
SELECT page_id, unnest(regexp_extract_all(html, 'href="(/[^"#?]+)"', 1)) AS target FROM pages""")
def html_links(spark, sf_dir) -> DataFrame:
    pages = Tables(spark, sf_dir).pages
    return pages.select(
        "page_id", F.explode(t.extract_links(F.col("html"), t.HTML_LINK)).alias("target"))


@query("line_numbers", """
SELECT doc_id, CASE WHEN instr(text, needle) > 0 THEN
       (length(text[1:instr(text, needle) - 1])
        - length(replace(text[1:instr(text, needle) - 1], chr(10), '')) + 1)::INT END AS line
FROM (SELECT doc_id, text, CASE lang WHEN 'en' THEN ' of ' WHEN 'de' THEN ' und ' ELSE ' la '
      END AS needle FROM documents)""")
def line_numbers(spark, sf_dir) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    needle = F.when(F.col("lang") == "en", " of ").when(F.col("lang") == "de", " und ").otherwise(
        " la ")
    return docs.select("doc_id", t.line_of(F.col("text"), needle).alias("line"))


@query("slug_sections", r"""
SELECT doc_id,
       CASE WHEN slug = '' THEN 'untitled' ELSE slug END AS slug,
       CASE WHEN doc_id % 3 = 0 THEN source WHEN doc_id % 3 = 1 THEN 'root' ELSE 'root' END AS section,
       'doc.' || doc_id AS stem
FROM (SELECT doc_id, source,
        trim(regexp_replace(lower(text), '[^a-z0-9]+', '-', 'g'), '-') AS slug
      FROM documents)""")
def slug_sections(spark, sf_dir) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    which = F.col("doc_id") % 3
    path = F.when(which == 0, F.concat(F.lit("x/docs/"), "source", F.lit("/a.md"))).when(
        which == 1, F.lit("x/docs")).otherwise(F.concat(F.lit("y/"), "source"))
    file = F.concat(F.lit("a/b.c/doc."), F.col("doc_id").cast("string"), F.lit(".md"))
    return docs.select(
        "doc_id", t.slugify(F.col("text")).alias("slug"),
        t.section_from_path(path).alias("section"), t.file_stem(file).alias("stem"))


@query("trim_bodies", """
SELECT doc_id, length(text) > 4000 AS body_trimmed,
       sha256(CASE WHEN length(text) > 4000 THEN text[1:4000] || chr(10) || '…(trimmed)'
              ELSE text END) AS body_hash
FROM documents""")
def trim_bodies(spark, sf_dir) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    nodes = docs.select("doc_id", F.col("text").alias("body"), F.lit(False).alias("body_trimmed"))
    trimmed = refine.compress_bodies(nodes)
    return trimmed.select("doc_id", "body_trimmed", t.content_hash(F.col("body")).alias("body_hash"))


@query("unique_docs", """
SELECT sha256(text) AS content_hash, min(doc_id) AS doc_id, count(*)::BIGINT AS copies
FROM documents GROUP BY 1""")
def unique_docs(spark, sf_dir) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    return refine.unique_docs(docs, "doc_id", t.content_hash(F.col("text")))


@query("excerpts", """
SELECT doc_id, text[1:120] AS summary, text[1:90] AS short, text[1:240] AS quote,
       replace(replace(replace(replace(text[1:300], '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"',
               '&quot;') AS escaped
FROM documents""")
def excerpts(spark, sf_dir) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    text = F.col("text")
    return docs.select(
        "doc_id", t.excerpt(text, 120).alias("summary"), t.excerpt(text, 90).alias("short"),
        t.excerpt(text, 240).alias("quote"),
        t.xml_escape(t.excerpt(text, 300)).alias("escaped"))


@query("extract_json", """
SELECT event_id, user_id, json_extract_string(props, '$.k')::BIGINT AS k,
       event_id % 3 <> 2 AS found
FROM (SELECT event_id, user_id, CASE WHEN event_id % 3 = 2 THEN NULL ELSE props END AS props
      FROM events)""")
def extract_json(spark, sf_dir) -> DataFrame:
    events = Tables(spark, sf_dir).events
    which = F.col("event_id") % 3
    answer = F.when(which == 0, F.col("props")).when(
        which == 1, F.concat(F.lit("Sure: "), "props", F.lit(" done."))).otherwise(
        F.concat(F.lit("{broken "), F.col("event_type")))
    parsed = events.select("event_id", "user_id", t.extract_json(answer).alias("v"))
    return parsed.select(
        "event_id", "user_id", F.try_variant_get("v", "$.k", "bigint").alias("k"),
        F.col("v").isNotNull().alias("found"))


@query("prerequisite_sections", """
SELECT 'gloss:' || source AS from_id, 'page:' || doc_id AS to_id, 1::BIGINT AS n_prov
FROM documents WHERE n_chars > 1000
UNION ALL
SELECT 'page:' || (doc_id // 2), 'page:' || doc_id, 1 FROM documents
WHERE doc_id // 2 <= (SELECT max(doc_id) FROM documents)""")
def prerequisite_sections(spark, sf_dir) -> DataFrame:
    docs = Tables(spark, sf_dir).documents
    key = F.col("doc_id").cast("string")
    term = F.when(F.col("n_chars") > 1000, F.col("source")).otherwise(F.lit("unknown"))
    body = F.concat(
        F.lit("# Intro [no](/docs/0/)\n## Before you begin\n- {{< glossary_tooltip term_id=\""),
        term, F.lit("\" >}}\n- [that](/docs/"), F.floor(F.col("doc_id") / 2).cast("string"),
        F.lit("/)\n\n## Steps\n[no](/docs/1/)\n"), F.col("text"))
    pages = docs.select(
        F.concat(key, F.lit(".md")).alias("rel_path"), F.lit(None).cast("string").alias("url"),
        body.alias("body_raw"))
    terms = docs.select(F.col("source").alias("term_id"),
                        F.concat(F.lit("gloss:"), "source").alias("term_node")).distinct()
    found = before_you_begin_edges(pages, terms, pages)
    return refine.merge_edges(found).select("from_id", "to_id", "n_prov")
