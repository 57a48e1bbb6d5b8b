"""Secret scanning with a guess-cost model of credential values.

Three fixed patterns give the base spans: assignments of a credential word, access
keys and long hexadecimal runs. The method adds values in a wider credential context
(``pwd: ...``, ``secret_key = "..."``, ``Authorization: Bearer ...``) that no base span
covers: a value is a secret when it is hard to guess. Its cost is that of the cheapest
segmentation into ranked words, unlisted but pronounceable words, dates, repeats,
keyboard walks and brute-force spans, found by dynamic programming; costs are decimal
logarithms of guesses. A value of the base patterns has its cost too, so that
placeholders can be told from keys.

Words are ranked by :func:`common_words`, which counts the documents of every word of
the corpus, behind the fixed list ``WORDS``. The ranked list is bounded by a parameter,
as a guesser's list is; words beyond it cost what an unlisted word costs.

Texts are read whole, one by one in Arrow batches; scanning shuffles nothing, counting
words one row per word and task, so hot keys do not arise. Defined cases: a null text is
empty and has no spans; offsets are code points, ends exclusive; rows repeated get equal
results; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.text import blocks
from graphloom.operators.skew import top_per_group

# Fixed patterns; letters of the assignment count in either case, ASCII only.
ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # maximal runs: the shorter ones fail anyway
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

#: The wider context: a credential word, a separator, perhaps the name of an
#: authentication scheme, and a value up to its quote or a delimiter.
CONTEXT = re.compile(
    r"""(?<![A-Za-z0-9])
    (?:(?:api|secret|private|access|auth|signing|encryption)[_-]?key|client[_-]?secret
      |(?:login|user)[_-]?pass|pass(?:word|wd|phrase|code)|pwd|secret|token|credentials?
      |authorization|bearer)
    ["']?\x20*(?::=|=>|[:=])\x20*
    (?:["']?(?:bearer|basic|digest|token|negotiate|apikey)\x20+)?
    (?:"(?P<double>[^"\s]{6,})"|'(?P<single>[^'\s]{6,})'
      |["']?(?P<bare>(?:(?!&\w+=)[^\s"',;<>|]){6,}))""", re.ASCII | re.IGNORECASE | re.VERBOSE)
CONTEXT_TRIGGERS = ("key", "secret", "pass", "pwd", "token", "credential", "authorization", "bearer")
#: What a sentence puts behind a bare value.
CLOSING = ".)]}"

KINDS = ("assign", "access", "hex", "guess")
#: Values that take more guesses than this (decimal logarithm) are secrets.
HARD = 8.0

#: Common words in passwords and placeholders, in order of rank.
WORDS = (
    "password", "admin", "user", "test", "example", "secret", "token", "key", "changeme",
    "welcome", "letmein", "default", "login", "master", "hello", "monkey", "dragon", "love",
    "sunshine", "princess", "football", "baseball", "shadow", "superman", "michael", "summer",
    "winter", "spring", "autumn", "placeholder", "your", "my", "the", "here", "value", "none",
    "null", "true", "false", "dummy", "sample", "demo", "guest", "root", "system", "server",
    "public", "private", "access", "code", "data", "pass", "word", "name", "and", "for", "this",
    "required", "include", "config", "configuration", "enabled", "disabled", "optional", "string",
    "undefined", "unknown", "redacted", "hidden", "missing", "invalid", "credential", "credentials",
    "bearer", "basic", "authorization", "authentication", "environment", "variable", "header",
    "same", "origin", "omit",
)
ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm", "abcdefghijklmnopqrstuvwxyz")
DATE = re.compile(r"(?:19|20)\d\d(?:[-/._]?(?:0[1-9]|1[0-2])(?:[-/._]?(?:0[1-9]|[12]\d|3[01]))?)?")
SEGMENT = math.log10(2)  # each further segment
UNLISTED = math.log10(200_000)  # a word that is on no list
MOST_WORDS, LEAST_DOCUMENTS = 20_000, 20
PIECES = 32
_NEXT = {(a, b) for row in ROWS for a, b in zip(row, row[1:], strict=False)}
_NEXT |= {(b, a) for a, b in _NEXT}
RANKS = {w: k + 2 for k, w in enumerate(WORDS)}
LONGEST = 20
_LETTERS = re.compile(r"[^\W\d_]+")
_MUTE = re.compile(r"[bcdfghjklmnpqrstvwxz]{5}")
_VOWEL = re.compile(r"[aeiouyàâäáèéêëìíîïòóôöùúûü]")


def common_words(texts: Column, docs: DataFrame, most: int = MOST_WORDS,
                 least: int = LEAST_DOCUMENTS) -> dict[str, int]:
    """Ranks of the words (4 to 20 letters, lower-cased) that most documents have.

    At most ``most`` words, each in ``least`` documents or more, ties by the word; they
    follow the fixed list.
    """
    words = F.array_distinct(F.regexp_extract_all(
        F.lower(texts), F.lit(r"(?<!\p{L})\p{L}{4," + str(LONGEST) + r"}(?!\p{L})"), 0))
    counted = docs.select(F.explode(words).alias("w")).groupBy("w").agg(
        F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
    # Ranked in pieces first: the driver receives the list alone, however many tasks count.
    first = top_per_group(counted, [], [F.desc("n"), F.asc("w")], most, salts=PIECES)
    ranked = first.orderBy("rank").collect()
    new = [r["w"] for r in ranked if r["w"] not in RANKS]
    return {**RANKS, **{w: k + 2 for k, w in enumerate(new, len(RANKS))}}


def _brute(c: str) -> float:
    """Decimal logarithm of the alphabet a character comes from."""
    if c.isdigit():
        return 1.0
    return math.log10(26) if c.isascii() and c.isalpha() else math.log10(33)


def _varied(value: str, low: str) -> float:
    """Cost of the capital letters of a word."""
    n = sum(a != b for a, b in zip(value, low, strict=True))
    return min(n, len(value) - n + 1) * math.log10(2)


def pronounceable(word: str) -> bool:
    """Whether lower-case letters look like a word: vowels, and no five consonants together."""
    return 4 <= len(word) <= LONGEST and bool(_VOWEL.search(word)) and not _MUTE.search(word)


def guess_cost(value: str, ranks: Mapping[str, int] = RANKS) -> float:
    """Decimal logarithm of the guesses that the cheapest segmentation takes.

    ``best[i]`` is the least cost of the first i characters; ``brute[i]`` that of those
    whose last span is a brute-force one, which goes on without a new segment.
    """
    n = len(value)
    low = "".join(c.lower() if len(c.lower()) == 1 else c for c in value)
    inf = math.inf
    best, brute = [0.0] + [inf] * n, [inf] * (n + 1)
    dates = {m.start(): m.end() for m in DATE.finditer(value)}
    letters = {m.start(): m.end() for m in _LETTERS.finditer(value)}
    last = 0  # where the current run of letters ends
    run = walk = 0  # first characters of the current repeat and walk
    for i in range(n):
        here = min(best[i], brute[i])
        # Spans that begin at i; each end is reached with the cost of the whole span.
        last = max(last, letters.get(i, 0))
        for end in range(i + 3, min(i + LONGEST, last) + 1):
            rank = ranks.get(low[i:end])
            if rank:
                cost = math.log10(rank) + _varied(value[i:end], low[i:end])
                best[end] = min(best[end], here + cost + SEGMENT)
        if i in letters and pronounceable(low[i:last]):
            cost = UNLISTED + _varied(value[i:last], low[i:last])
            best[last] = min(best[last], here + cost + SEGMENT)
        if i in dates:
            best[dates[i]] = min(best[dates[i]], here + math.log10(365 * 60) + SEGMENT)
        brute[i + 1] = min(brute[i + 1], best[i] + _brute(value[i]) + SEGMENT,
                           brute[i] + _brute(value[i]))
        # Repeats and walks that end at i + 1. What precedes a late beginning lies in the run
        # itself, so that only a word, no longer than LONGEST, can make one worth it.
        if i and value[i] != value[i - 1]:
            run = i
        if i and (low[i - 1], low[i]) not in _NEXT:
            walk = i
        for start, alphabet in ((run, _brute(value[run])), (walk, math.log10(47))):
            for s in range(start, min(start + LONGEST + 1, i - 1)):
                cost = alphabet + math.log10(i - s + 1)
                best[i + 1] = min(best[i + 1], min(best[s], brute[s]) + cost + SEGMENT)
    return min(best[n], brute[n])


Span = tuple[int, int, str, float | None]


def scan(text: str, hard: float = HARD, ranks: Mapping[str, int] = RANKS) -> list[Span]:
    """All spans (start, end, kind, cost of the value) by start, then kind as listed."""
    found: list[Span] = []
    low = text.lower() if ":" in text or "=" in text else ""
    if low and any(w in low for w in ASSIGN_WORDS):
        found += [(m.start(), m.end(), "assign", guess_cost(m[2], ranks))
                  for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", None) for m in ACCESS.finditer(text)
                  if m.end() - m.start() >= ACCESS_LEAST]
    found += [(m.start(), m.end(), "hex", None) for m in HEX.finditer(text)]
    if low and any(w in low for w in CONTEXT_TRIGGERS):
        taken = [(s, e) for s, e, _, _ in found]
        for m in CONTEXT.finditer(text):
            start, end = m.span(m.lastgroup)
            if m.lastgroup == "bare":
                end = start + len(text[start:end].rstrip(CLOSING))
            if end - start >= 6 and not any(s <= start and end <= e for s, e in taken):
                cost = guess_cost(text[start:end], ranks)
                if cost > hard:
                    found.append((start, end, "guess", cost))
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))


def joined(spans: Sequence[Span]) -> str:
    return ",".join(f"{kind}:{start}:{end}" for start, end, kind, _ in spans)


RESULT = ("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string, "
          "n_guess bigint, n_easy bigint, hardest double")


def secrets_of(text: Column, hard: float = HARD, ranks: Mapping[str, int] = RANKS) -> Column:
    """A struct column ``RESULT`` of a text column: counts, base digest and all spans;
    n_easy counts assigned values below ``hard``, hardest is the highest cost. ``ranks``
    comes from :func:`common_words`."""

    @F.arrow_udf(f"struct<{RESULT.replace(' ', ':').replace(',:', ',')}>")
    def find(column: pa.Array) -> pa.Array:
        rows = []
        for i, j in blocks(column):
            for value in column[i:j].to_pylist():
                spans = scan(value or "", hard, ranks)
                base = [s for s in spans if s[2] != "guess"]
                costs = [s[3] for s in spans if s[3] is not None]
                rows.append((
                    *[sum(s[2] == k for s in base) for k in KINDS[:3]],
                    hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans),
                    len(spans) - len(base),
                    sum(s[2] == "assign" and s[3] <= hard for s in base),
                    max(costs) if costs else None))
        kinds = [pa.int64()] * 3 + [pa.string()] * 2 + [pa.int64()] * 2 + [pa.float64()]
        names = [c.split()[0] for c in RESULT.split(", ")]
        columns = zip(*rows, strict=True) if rows else [()] * len(kinds)
        return pa.StructArray.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return find(text)
