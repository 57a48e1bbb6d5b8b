"""Text extraction as Catalyst expressions.

Everything here runs inside the JVM, shortcode rewriting included. Regex notes:
``(?d)`` makes only ``\\n`` a line break, ``(?U)`` makes ``\\s`` and ``\\w``
Unicode-aware; character-class loops (``[^{]+``) are used instead of repeated
groups so that long texts do not exhaust the regex stack.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Source formats.
FRONT_MATTER = r"(?sU)^\s*---\s*\n(.*?)\n---\s*\n?(.*)$"
SHORTCODE_ATTR = r'(?U)(\w+)\s*=\s*"([^"]*)"'
RESIDUAL_SHORTCODE = r"\{\{<[^>]*?(?:/>|>)\}\}"
HTML_COMMENT = r"(?s)<!--.*?-->"
DOC_LINK = r"\]\((/docs/[^)#?]+)"
HTML_LINK = r'href="(/[^"#?]+)"'
HEADING_2 = r"(?mdU)^##\s+(.+?)\s*$"
HEADING_3 = r"(?mdU)^###\s+(.+?)\s*$"
TRIM_MARK = "\n…(trimmed)"
# Shortcodes that stand alone; every other name may wrap a block.
INLINE_SHORTCODES = ["glossary_tooltip", "glossary_definition", "figure"]
ADMONITIONS = ["note", "warning", "caution", "tip"]

_TAIL = r"((?:\s+[^>]*?)?)(?:\s*/)?\s*>\}\}"
_INLINE = r"\{\{<\s*(" + "|".join(INLINE_SHORTCODES) + ")" + _TAIL
_OPENER = r"\{\{<\s*([a-zA-Z_]+)" + _TAIL
_CLOSER = r"\{\{< /([a-zA-Z_]+) >\}\}"
# Put behind the ``{{<`` of an opener that no closer follows. ``\\s`` does not match it,
# and one that a text brings along is doubled first.
_MARK = "\x01"
# So few openers are searched for their closers without marks: a bounded number of scans.
FEW_OPENERS = 32
_ALONE = r"\{\{<\x01\s*[a-zA-Z_]+" + _TAIL
# One token: a standalone shortcode, an opener known to have no closer, an opener with its
# block, a run of plain text, a mark or a lone brace. Group 4 names the block being closed.
_TOKEN = (r"(?sU)" + _INLINE.replace("<", r"<\x01?", 1) + "|" + _ALONE + "|" + _OPENER
          + r"(?:.*?\{\{< /\4 >\}\})?|[^{]+|\{\{<\x01+|\{")

_EDGE_SPACE = r"(?U)^\s+|\s+$"


def strip(text: Column) -> Column:
    """Trim all white space at both ends (not only blanks)."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def split_front_matter(text: Column) -> Column:
    """Struct (front_matter, body); front_matter is NULL when there is none."""
    found = F.rlike(text, F.lit(FRONT_MATTER))
    return F.struct(
        F.when(found, F.regexp_extract(text, FRONT_MATTER, 1)).alias("front_matter"),
        F.when(found, F.regexp_extract(text, FRONT_MATTER, 2)).otherwise(text).alias("body"),
    )


def shortcode_attr(raw: Column, name: str) -> Column:
    """The value of attribute ``name``; NULL if absent, the last one if repeated."""
    pairs = F.arrays_zip(
        F.regexp_extract_all(raw, F.lit(SHORTCODE_ATTR), 1).alias("k"),
        F.regexp_extract_all(raw, F.lit(SHORTCODE_ATTR), 2).alias("v"),
    )
    return F.try_element_at(F.filter(pairs, lambda p: p["k"] == name), F.lit(-1))["v"]


def shortcode_attrs(raw: Column) -> Column:
    """All attributes as a map, the last value of a repeated key winning."""
    keys = F.array_distinct(F.regexp_extract_all(raw, F.lit(SHORTCODE_ATTR), 1))
    pairs = F.arrays_zip(
        F.regexp_extract_all(raw, F.lit(SHORTCODE_ATTR), 1).alias("k"),
        F.regexp_extract_all(raw, F.lit(SHORTCODE_ATTR), 2).alias("v"),
    )

    def last(key: Column) -> Column:
        return F.element_at(F.filter(pairs, lambda p: p["k"] == key), -1)["v"]

    return F.map_from_arrays(keys, F.transform(keys, last))


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _cut_after_last(text: Column, end: str | Column,
                    use: Callable[[Column, Column], Column]) -> Column:
    """``use(head, tail)``: the text up to its last ``end``, and what follows.

    A pattern that must finish with ``end`` cannot begin in the tail. Searching there
    would run to the end of the text from every possible beginning.
    """
    end = F.lit(end) if isinstance(end, str) else end
    return _let(F.call_function("substring_index", text, end, F.lit(-1)), lambda tail: use(
        F.substring(text, F.lit(1), F.length(text) - F.length(tail)), tail))


def clean_delimiters(body: Column) -> Column:
    """Unify both shortcode delimiters and drop HTML comments."""
    body = F.replace(F.replace(body, F.lit("{{%"), F.lit("{{<")), F.lit("%}}"), F.lit(">}}"))
    return _let(body, lambda x: F.when(~F.contains(x, F.lit("<!--")), x).otherwise(
        _cut_after_last(x, "-->", lambda head, tail: F.concat(
            F.regexp_replace(head, HTML_COMMENT, ""), tail))))


def _mark_alone(text: Column) -> Column:
    """Mark the openers that no closer of their name follows.

    Found once per name, so that the tokenizer never looks for a closer in vain: the
    work grows with the length of the text, times the number of different block names.
    """
    doubled = F.replace(text, F.lit("{{<" + _MARK), F.lit("{{<" + 2 * _MARK))
    opener = r"(?U)\{\{<(?=\s*+"

    def mark(x: Column) -> Column:
        closed = F.array_intersect(
            F.regexp_extract_all(x, F.lit(_CLOSER), 1),
            F.regexp_extract_all(x, F.lit(r"(?U)\{\{<\s*+([a-zA-Z_]+)"), 1))
        return _let(closed, lambda names: F.aggregate(
            names,
            F.regexp_replace(x, F.concat(
                F.lit(opener + "(?!(?:"), F.array_join(names, "|"),
                F.lit(")(?![a-zA-Z_]))[a-zA-Z_])")), F.lit("{{<" + _MARK)),
            lambda acc, name: _cut_after_last(
                acc, F.concat(F.lit("{{< /"), name, F.lit(" >}}")),
                lambda head, tail: F.concat(head, F.regexp_replace(
                    tail, F.concat(F.lit(opener), name, F.lit("(?![a-zA-Z_]))")),
                    F.lit("{{<" + _MARK))))))

    openers = F.length(text) - F.length(F.replace(text, F.lit("{{<"), F.lit("{{")))
    return F.when(openers > FEW_OPENERS, _let(doubled, mark)).otherwise(doubled)


def shortcode_tokens(body: Column) -> Column:
    """The body cut into shortcodes (blocks whole) and plain text, in order."""
    def cut(text: Column) -> Column:
        tokens = _cut_after_last(text, ">}}", lambda head, tail: F.array_append(F.transform(
            F.regexp_extract_all(_mark_alone(head), F.lit(_TOKEN), 0),
            lambda token: F.regexp_replace(token, r"\{\{<\x01(\x01?)", "{{<$1")), tail))
        plain = F.when(text.isNotNull(), F.array(text))
        return F.when(F.contains(text, F.lit("{{<")), tokens).otherwise(plain)

    return _let(clean_delimiters(body), cut)


def _or_empty(value: Column) -> Column:
    return F.coalesce(value, F.lit(""))


def render_block(name: Column, attrs: Column, inner: Column) -> Column:
    """Markdown for the inside of a paired shortcode."""
    text = strip(inner)
    title = F.concat(F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 1 << 30))
    return (
        F.when(name == "mermaid", F.concat(F.lit("\n```mermaid\n"), text, F.lit("\n```\n")))
        .when(name == "details", F.concat(
            F.lit("\n<details><summary>"), _or_empty(shortcode_attr(attrs, "summary")),
            F.lit("</summary>\n\n"), text, F.lit("\n</details>\n")))
        .when(name.isin(ADMONITIONS), F.concat(
            F.lit("\n> **"), title, F.lit(":** "), text, F.lit("\n")))
        .otherwise(inner)
    )


def _render_token(token: Column) -> Column:
    opener = F.regexp_extract(token, "(?sU)^" + _OPENER, 0)
    name = F.regexp_extract(token, "(?sU)^" + _OPENER, 1)
    attrs = F.regexp_extract(token, "(?sU)^" + _OPENER, 2)
    term = _or_empty(shortcode_attr(attrs, "term_id"))
    image = F.concat(
        F.lit("\n!["), _or_empty(shortcode_attr(attrs, "alt")), F.lit("]("),
        _or_empty(shortcode_attr(attrs, "src")), F.lit(")"))
    caption = _or_empty(shortcode_attr(attrs, "caption"))
    closer_length = F.length(name) + F.lit(len("{{< / >}}"))
    inner = F.substring(
        token, F.length(opener) + 1, F.length(token) - F.length(opener) - closer_length)
    return (
        F.when(opener == "", token)
        .when(name == "glossary_tooltip", F.concat(
            F.lit("["), F.coalesce(shortcode_attr(attrs, "text"), term),
            F.lit("](#gloss:"), term, F.lit(")")))
        .when(name == "glossary_definition",
              F.concat(F.lit("[definition:"), term, F.lit("]")))
        .when(name == "figure", F.concat(
            image, F.when(caption != "", F.concat(F.lit(" — "), caption)).otherwise(F.lit("")),
            F.lit("\n")))
        .when(F.length(token) == F.length(opener), F.lit(""))
        .otherwise(render_block(name, attrs, inner))
    )


def strip_residual(text: Column) -> Column:
    """Remove shortcode fragments that malformed input leaves behind."""
    return _let(text, lambda x: F.when(~F.contains(x, F.lit("{{<")), x).otherwise(
        _cut_after_last(x, ">}}", lambda head, tail: F.concat(
            F.regexp_replace(head, RESIDUAL_SHORTCODE, ""), tail))))


def normalize_tokens(tokens: Column) -> Column:
    """Portable Markdown from :func:`shortcode_tokens`."""
    return strip_residual(F.array_join(F.transform(tokens, _render_token), ""))


def normalize_shortcodes(body: Column) -> Column:
    return normalize_tokens(shortcode_tokens(body))


def refs_of_tokens(tokens: Column) -> Column:
    """Term references ``ARRAY<STRUCT<kind, term_id, text>>`` in reading order.

    Shortcodes inside a paired block belong to the block's token and yield none.
    """
    pattern = r"(?sU)^\{\{<\s*(glossary_tooltip|glossary_definition)" + _TAIL

    def ref(token: Column) -> Column:
        kind = F.regexp_extract(token, pattern, 1)
        attrs = F.regexp_extract(token, pattern, 2)
        term = _or_empty(shortcode_attr(attrs, "term_id"))
        text = F.when(kind == "glossary_tooltip",
                      F.coalesce(shortcode_attr(attrs, "text"), term))
        return F.struct(kind.alias("kind"), term.alias("term_id"), text.alias("text"))

    hits = F.filter(tokens, lambda t: F.rlike(t, F.lit(pattern)))
    return F.transform(hits, ref)


def extract_refs(body: Column) -> Column:
    return refs_of_tokens(shortcode_tokens(body))


def extract_links(body: Column, pattern: str = DOC_LINK) -> Column:
    """Link targets in reading order, repeats included."""
    return F.regexp_extract_all(body, F.lit(pattern), 1)


def link_rel_path(target: Column) -> Column:
    """``/docs/a/b/`` and ``/docs/a/b.md`` both name the document ``a/b.md``."""
    path = F.trim(F.regexp_replace(target, "^/docs/", ""), F.lit("/"))
    return F.when(F.endswith(path, F.lit(".md")), path).otherwise(F.concat(path, F.lit(".md")))


def extract_headings(body: Column) -> Column:
    """All second-level headings, then all third-level ones."""
    both = F.concat(
        F.regexp_extract_all(body, F.lit(HEADING_2), 1),
        F.regexp_extract_all(body, F.lit(HEADING_3), 1),
    )
    return F.transform(both, strip)


def slugify(text: Column) -> Column:
    dashed = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    trimmed = F.trim(dashed, F.lit("-"))
    return F.when(trimmed == "", F.lit("untitled")).otherwise(trimmed)


def section_from_path(path: Column) -> Column:
    """The path segment after ``docs``; ``root`` when there is none."""
    parts = F.split(path, "/")
    at = F.array_position(parts, "docs").cast("int")
    following = F.when(at > 0, F.get(parts, at))
    return F.coalesce(following, F.lit("root"))


def file_stem(path: Column) -> Column:
    name = F.substring_index(path, "/", -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def line_of(body: Column, snippet: Column) -> Column:
    """1-based line of the first occurrence of ``snippet``; NULL if absent."""
    at = F.position(snippet, body)
    before = F.substring(body, F.lit(1), at - 1)
    breaks = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit("")))
    return F.when(at > 0, breaks + 1)


def trim_body(body: Column, limit: int = 4000) -> Column:
    """The text cut to ``limit`` characters plus a mark, if it is longer."""
    cut = F.concat(F.substring(body, 1, limit), F.lit(TRIM_MARK))
    return F.when(F.length(body) > limit, cut).otherwise(body)


def content_hash(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def row_hash(*columns: Column | str) -> Column:
    """SHA-256 over the JSON form of the given columns (NULL members are kept)."""
    return F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256)


def node_slug(node_id: Column) -> Column:
    """URL-safe form of a node id."""
    dashed = F.regexp_replace(node_id, r"(?U)\s+|[:/]", "-")
    return F.translate(dashed, "{}", "")


def split_api_name(name: Column) -> Column:
    """Struct (kind, group, version) of a dotted definition name."""
    parts = F.split(name, r"\.")
    full = F.size(parts) >= 3
    return F.struct(
        F.element_at(parts, -1).alias("kind"),
        F.when(full, F.try_element_at(parts, F.lit(-3))).otherwise("core").alias("group"),
        F.when(full, F.try_element_at(parts, F.lit(-2))).otherwise("v1").alias("version"),
    )


def infer_path_kind(path: Column, method: Column) -> Column:
    """The kind an API path is about: its last fixed segment, capitalised."""
    fixed = F.filter(F.split(path, "/"), lambda s: (s != "") & ~F.contains(s, F.lit("{")))
    word = F.regexp_extract(F.try_element_at(fixed, F.lit(-1)), r"^[^.\-(]*", 0)
    capital = F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 1 << 30)))
    return F.when(F.size(fixed) > 0, capital).otherwise(method)


def excerpt(text: Column, n: int) -> Column:
    return F.substring(text, 1, n)


def xml_escape(text: Column) -> Column:
    for raw, escaped in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(escaped))
    return text


def extract_json(text: Column) -> Column:
    """VARIANT of the whole text, else of its outermost braces, else NULL."""
    braces = F.regexp_extract(text, r"(?s)\{.*\}", 0)
    return F.coalesce(
        F.try_parse_json(text), F.try_parse_json(F.when(braces != "", braces)))
