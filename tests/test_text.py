"""Text functions against small cases and plain-Python expectations."""

import hashlib
import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from graphloom.functions import text as t
from graphloom.functions.front_matter import front_matter_fields
from graphloom.functions.render import grounded_context, render_card


def value(spark, column, **cells):
    row = spark.range(1)
    for name, cell in cells.items():
        row = row.withColumn(name, F.lit(cell))
    return row.select(column.alias("v")).first()["v"]


@pytest.mark.parametrize("body, wanted", [
    ('A {{< glossary_tooltip text="pod" term_id="pod" >}} runs.', "A [pod](#gloss:pod) runs."),
    ('{{< glossary_tooltip term_id="pod" />}}', "[pod](#gloss:pod)"),
    ("{{< note >}}Careful.{{< /note >}}", "\n> **Note:** Careful.\n"),
    ("{{% warning %}} hot {{% /warning %}}", "\n> **Warning:** hot\n"),
    ("{{< mermaid >}}graph TD; A-->B{{< /mermaid >}}", "\n```mermaid\ngraph TD; A-->B\n```\n"),
    ('{{< details summary="S" >}} in {{< /details >}}',
     "\n<details><summary>S</summary>\n\nin\n</details>\n"),
    ("{{< tabs >}} kept {{< /tabs >}}", " kept "),
    ('{{< figure src="a.png" alt="A" >}}', "\n![A](a.png)\n"),
    ('{{< figure src="a.png" alt="A" caption="C" >}}', "\n![A](a.png) — C\n"),
    ('{{< glossary_definition term_id="pod" length="all" >}}', "[definition:pod]"),
    ("a <!-- gone\n -->b", "a b"),
    ("x {{< heading >}} y", "x  y"),
    ("x {{< /note >}} y", "x  y"),
    ("{ {{ }} {a} {{< not a tag", "{ {{ }} {a} {{< not a tag"),
    ("{{< note >}}a{{< note >}}b{{< /note >}}c{{< /note >}}", "\n> **Note:** ab\nc"),
    ("", ""),
])
def test_shortcodes(spark, body, wanted):
    assert value(spark, t.normalize_shortcodes(F.col("b")), b=body) == wanted


def test_no_body_has_no_tokens(spark):
    body = F.lit(None).cast("string")
    assert value(spark, t.shortcode_tokens(body)) is None
    assert value(spark, t.normalize_shortcodes(body)) is None


def test_references_inside_blocks_are_not_seen(spark):
    body = ('{{< glossary_tooltip term_id="a" >}}{{< note >}}{{< glossary_tooltip term_id="b" >}}'
            '{{< /note >}}{{< glossary_definition term_id="c" >}}')
    refs = value(spark, t.extract_refs(F.col("b")), b=body)
    assert [(r["kind"], r["term_id"], r["text"]) for r in refs] == [
        ("glossary_tooltip", "a", "a"), ("glossary_definition", "c", None)]


def test_long_texts_do_not_overflow(spark):
    body = "word " * 400_000 + "{{< note >}}" + "line\n" * 200_000 + "{{< /note >}}{{< x"
    assert len(value(spark, t.normalize_shortcodes(F.col("b")), b=body)) > 2_900_000


def tokens_by_rule(text):
    """One pattern that looks for the closer at every opener, whether there is one or not."""
    tail = r"((?:\s+[^>]*?)?)(?:\s*/)?\s*>\}\}"
    inline = "|".join(t.INLINE_SHORTCODES)
    rule = re.compile(r"\{\{<\s*(" + inline + ")" + tail + r"|\{\{<\s*([a-zA-Z_]+)" + tail
                      + r"(?:.*?\{\{< /\3 >\}\})?|[^{]+|\{", re.DOTALL)
    text = text.replace("{{%", "{{<").replace("%}}", ">}}")
    return [m[0] for m in rule.finditer(re.sub("<!--.*?-->", "", text, flags=re.DOTALL))]


@pytest.mark.parametrize("few", [0, 4, t.FEW_OPENERS])
def test_tokens_equal_the_plain_rule(spark, monkeypatch, few):
    monkeypatch.setattr(t, "FEW_OPENERS", few)
    rng = random.Random(7)
    bits = ["{{< note >}}", "{{< /note >}}", "{{< tabs a=\"1\" >}}", "{{< /tabs >}}", "{{<x/>}}", "{{< /x >}}",
            "{{< glossary_tooltip term_id=\"t\" >}}", "{{< /figure >}}", "{{< figure >}}", "{{<", ">}}", "{", "}}", " ",
            "word", "{{<\x01note >}}", "{{<\x01\x01", "\x01", "{{% note %}}", "<!--", "-->", "{{< notes >}}", "\n", "ö",
            "{{<note", " >}}", "{{< a {{< b >}}"]
    bodies = ["".join(rng.choice(bits) for _ in range(rng.randrange(0, 25))) for _ in range(1500)]
    frame = spark.createDataFrame(list(enumerate(bodies)), "k INT, b STRING")
    got = {r["k"]: r["v"] for r in frame.select(
        "k", t.shortcode_tokens(F.col("b")).alias("v")).collect()}

    def shortcodes(tokens):
        return [x for x in tokens if x.startswith("{{<") and ">}}" in x]

    for k, body in enumerate(bodies):
        wanted = tokens_by_rule(body)
        assert "".join(got[k]) == "".join(wanted)
        assert shortcodes(got[k]) == shortcodes(wanted)


@pytest.mark.parametrize("piece", ["{{< note >}}x ", "{{< /tabs >}}{{< note >}}{{< tabs >}}", "{{<a b ", "<!-- "])
def test_unclosed_openers_cost_linear_time(spark, piece):
    def seconds(n):
        frame = spark.createDataFrame([(piece * n,)] * 8, "b STRING").coalesce(1)
        best = math.inf
        for _ in range(3):
            start = time.perf_counter()
            frame.select(F.sum(F.length(t.normalize_shortcodes(F.col("b"))))).collect()
            best = min(best, time.perf_counter() - start)
        return best

    assert seconds(10_000) < 4 * seconds(2_500) + 0.5


def test_attribute_in_a_value_is_no_attribute(spark):
    raw = 'alt="text=" text = "real"'
    assert value(spark, t.shortcode_attr(F.col("r"), "text"), r=raw) == "real"
    assert value(spark, t.shortcode_attrs(F.col("r")), r='a="1" b="2" a="3"') == {
        "a": "3", "b": "2"}


@pytest.mark.parametrize("text, front, body", [
    ("---\ntitle: X\n---\nHello", "title: X", "Hello"),
    ("\n ---  \na: 1\nb: 2\n---\n", "a: 1\nb: 2", ""),
    ("no front", None, "no front"),
    ("---\nnever closed", None, "---\nnever closed"),
])
def test_front_matter_split(spark, text, front, body):
    parts = value(spark, t.split_front_matter(F.col("x")), x=text)
    assert (parts["front_matter"], parts["body"]) == (front, body)


def test_front_matter_fields(spark):
    rows = spark.createDataFrame([
        (1, 'title: "T"\nweight: 3\ntags: [a, b]\ndescription: >\n  one\n  two'),
        (2, "title: [broken"), (3, None), (4, "- just\n- a list"), (5, "title: 12\nweight: x"),
    ], "k INT, fm STRING")
    got = {r["k"]: r["f"] for r in rows.select(
        "k", front_matter_fields(F.col("fm")).alias("f")).collect()}
    assert (got[1]["title"], got[1]["weight"], got[1]["tags"]) == ("T", 3, ["a", "b"])
    assert got[1]["description"] == "one two"
    assert all(got[k]["title"] is None for k in (2, 3, 4))
    assert (got[5]["title"], got[5]["weight"]) == ("12", None)


@pytest.mark.parametrize("text, slug", [
    ("Hello World!", "hello-world"), ("--", "untitled"), ("a_b  c", "a-b-c"), ("Ä1", "1")])
def test_slugify(spark, text, slug):
    assert value(spark, t.slugify(F.col("x")), x=text) == slug


def test_headings_second_level_first(spark):
    body = "### C\n## A  \ntext\n## B\n####no\n##no\n"
    assert value(spark, t.extract_headings(F.col("x")), x=body) == ["A", "B", "C"]


@pytest.mark.parametrize("body, snippet, line", [
    ("a\nb\nc", "c", 3), ("a\nb", "a", 1), ("a", "z", None), ("ü\nö ö", "ö", 2)])
def test_line_of(spark, body, snippet, line):
    assert value(spark, t.line_of(F.col("b"), F.col("s")), b=body, s=snippet) == line


def test_trim_counts_characters(spark):
    assert value(spark, t.trim_body(F.col("x"), 3), x="äöü") == "äöü"
    assert value(spark, t.trim_body(F.col("x"), 3), x="äöüß") == "äöü\n…(trimmed)"


def test_content_hash(spark):
    assert value(spark, t.content_hash(F.col("x")), x="grüße") == hashlib.sha256(
        "grüße".encode()).hexdigest()


@pytest.mark.parametrize("path, section", [
    ("docs/tasks/a.md", "tasks"), ("docs", "root"), ("x/docs/y", "y"), ("a/b", "root")])
def test_section(spark, path, section):
    assert value(spark, t.section_from_path(F.col("p")), p=path) == section


@pytest.mark.parametrize("path, kind", [
    ("/apis/apps/v1/{ns}/deployments", "Deployments"), ("/api/v1/pods/{name}/status", "Status"),
    ("/a/daemonSets.x-y(z)", "Daemonsets"), ("/{a}/{b}", "get"), ("/", "get")])
def test_path_kind(spark, path, kind):
    assert value(spark, t.infer_path_kind(F.col("p"), F.lit("get")), p=path) == kind


@pytest.mark.parametrize("name, parts", [
    ("io.k8s.api.apps.v1.Deployment", ("Deployment", "apps", "v1")),
    ("a.B", ("B", "core", "v1")), ("B", ("B", "core", "v1"))])
def test_api_name(spark, name, parts):
    assert tuple(value(spark, t.split_api_name(F.col("n")), n=name)) == parts


@pytest.mark.parametrize("target, path", [
    ("/docs/a/b/", "a/b.md"), ("/docs/a/b", "a/b.md"), ("/docs/a/b.md", "a/b.md"),
    ("/docs/docs/x/", "docs/x.md")])
def test_link_path(spark, target, path):
    assert value(spark, t.link_rel_path(F.col("x")), x=target) == path


@pytest.mark.parametrize("text, found", [
    ('{"a": 1}', '{"a":1}'), ('so: {"a": {"b": 2}} end', '{"a":{"b":2}}'), ("none", None),
    ("{broken", None), (None, None)])
def test_extract_json(spark, text, found):
    assert value(spark, F.to_json(t.extract_json(F.col("x").cast("string"))), x=text) == found


def test_card(spark):
    row = spark.sql("""SELECT named_struct('overview', ' O ', 'why_it_matters', 'W',
        'key_facts', array('a', '', 'b'), 'pitfalls', CAST(array() AS array<string>),
        'related', array('x', 'y')) AS c""")
    assert row.select(render_card(F.col("c")).alias("v")).first()["v"] == (
        "O\n\n**Why it matters**\nW\n\n**Key facts**\n- a\n- b\n\n**Related**\nx, y")


def test_grounding_falls_back(spark):
    row = spark.sql("""SELECT 'T' AS t, b, CAST(array(named_struct('source', 's', 'url', NULL,
        'line_start', NULL, 'line_end', NULL, 'quote', q)) AS array<struct<source:string,
        url:string, line_start:int, line_end:int, quote:string>>) AS p
        FROM VALUES ('', 'Q'), ('B', ''), ('', '') AS v(b, q)""")
    got = [r["v"] for r in row.select(
        grounded_context(F.col("t"), F.col("b"), F.col("p")).alias("v")).collect()]
    assert got[0].endswith('\n- "Q" - from s')
    assert got[1:] == ["Text to rely on:\nB", "Only the title is known: T"]
