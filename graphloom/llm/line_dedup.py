"""Near-duplicate line removal by a deletion-neighbourhood join.

Two lines are similar when one insertion, deletion or substitution of a character, or
none, makes them equal. Then they share a variant: both become equal by deleting the
same position, or one is the other with one character deleted. Every line emits its
variants as hashed keys, equal keys are joined, the edit distance is verified, and of
similar lines the earliest stays: a line is dropped when an earlier one (by doc_id, then
line number) is similar to it, itself dropped or not.

Emitting the variants of all lines would multiply the corpus by its line length, so a
necessary condition goes first. A line is cut into ``PIECES`` pieces; an edit touches one
piece, so similar lines agree on everything outside some piece. Only lines that agree so
with a different line emit variants, and only those of the piece in question. No pair is
lost by that. Hashes come from prefix sums of a polynomial, so a line of n characters
costs O(n) however long it is.

Pairs within a key are never expanded. Lines that are equal after deleting the same
position all differ in that position only, so the key's earliest line is similar to each
of them. A key for an insertion holds one shorter line and its longer ones, which are
compared with that one only. Hot keys cost one partial row per task, and joins of hot
lines with their first place have an exchange on both sides, which AQE splits.

Lines are compared without ASCII white space at their ends. Those under ``LEAST_CHARS``
code points are compared exactly; blank lines always stay. Defined cases: a null text
stays null and has no lines; an empty text has one blank line; lines at the same place of
rows that repeat an id count as one place, so rows repeated in full are cleaned alike;
rows without an id come last and lose lines only to rows with one; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import broadcast_if_small, pick, prepare
from graphloom.llm.text import blocks, mix, powers
from graphloom.session import stage

PIECES = 4
LEAST_CHARS = 16

_BASE = np.uint64(0x5851F42D4C957F2D)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLANKS = np.array([9, 11, 12, 13, 32], dtype=np.uint32)


class Lines:
    """The trimmed lines of a block of texts, with hashes of any of their parts."""

    def __init__(self, texts: list[str | None]):
        sizes = np.fromiter((len(t or "") for t in texts), dtype=np.int64, count=len(texts))
        # A newline after every text keeps its last line apart from the next text.
        joined = "".join((t or "") + "\n" for t in texts)
        points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        end = np.flatnonzero(points == 10)
        start = np.append(0, end[:-1] + 1)[:len(end)]
        text_start = np.cumsum(sizes + 1) - (sizes + 1)
        self.row = np.searchsorted(text_start, start, side="right") - 1
        self.number = np.arange(len(start)) - np.searchsorted(start, text_start)[self.row]
        solid = np.flatnonzero(~np.isin(points, _BLANKS) & (points != 10))
        if len(solid):
            first = np.searchsorted(solid, start)
            last = np.searchsorted(solid, end) - 1
            blank = first > last
            self.start = np.where(blank, start, solid[np.minimum(first, len(solid) - 1)])
            self.end = np.where(blank, start, solid[np.maximum(last, 0)] + 1)
        else:
            self.start, self.end = start, start.copy()
        self.points = points
        self.sums = np.zeros(len(points) + 1, dtype=np.uint64)
        np.cumsum(mix((points.astype(np.uint64) + np.uint64(1)) * _ODD)
                  * powers(_BASE, len(points)), out=self.sums[1:])
        self.unit = powers(_INVERSE, len(points) + 1)
        self.length = self.end - self.start
        self.hash = mix(self.part(self.start, self.end) + self.length.astype(np.uint64) * _ODD)

    def part(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return (self.sums[end] - self.sums[start]) * self.unit[start]

    def outside(self, line: np.ndarray, shorter: np.ndarray, piece: int) -> np.ndarray:
        """Hash of lines without one piece, for pairs whose shorter line has that length."""
        begin, stop = piece_bounds(shorter, piece)
        s, e = self.start[line], self.end[line]
        tail = e - (shorter - stop)
        out = mix(self.part(s, s + begin) + shorter.astype(np.uint64) * _ODD + np.uint64(piece))
        return mix(out + self.part(tail, e))

    def text(self, line: int) -> str:
        return self.points[self.start[line]:self.end[line]].tobytes().decode(
            "utf-32-le", "surrogatepass")


def piece_bounds(length: np.ndarray, piece: int) -> tuple[np.ndarray, np.ndarray]:
    return length * piece // PIECES, length * (piece + 1) // PIECES


def signed(x: np.ndarray) -> pa.Array:
    return pa.array(np.ascontiguousarray(x).view(np.int64))


def describe_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text) to a row per line that is not blank: doc_id, line, hash, keys."""
    for batch in batches:
        for i, j in blocks(batch.column(1)):
            ids = batch.column(0)[i:j]
            lines = Lines(batch.column(1)[i:j].to_pylist())
            held = np.flatnonzero(lines.length > 0)
            long = lines.length[held] >= LEAST_CHARS
            of_long = held[long]
            keys = np.empty((len(of_long), 2 * PIECES), dtype=np.uint64)
            for k in range(2 * PIECES):
                keys[:, k] = lines.outside(of_long, lines.length[of_long] - k // PIECES, k % PIECES)
            offsets = np.append(0, np.cumsum(long * 2 * PIECES)).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [ids.take(pa.array(lines.row[held])), pa.array(lines.number[held].astype(np.int32)),
                 signed(lines.hash[held]),
                 pa.ListArray.from_arrays(pa.array(offsets), signed(keys.ravel()))],
                ["doc_id", "line", "hash", "keys"])


def candidate_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, [(line, hash, slot)]) to the wanted lines: hash, slot, value."""
    schema = pa.schema([("hash", pa.int64()), ("slot", pa.int32()), ("value", pa.string())])
    for batch in batches:
        for text, wanted in zip(batch.column(0), batch.column(1), strict=True):
            pieces = (text.as_py() or "").split("\n")
            rows = [(w["hash"], w["slot"], pieces[w["line"]].strip(" \t\x0b\x0c\r"))
                    for w in wanted.as_py() if w["line"] < len(pieces)]
            columns = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def deletion_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(hash, slot, value) to the variants of the slot's piece: hash, key, role.

    Role 0 is a substitution: the key holds the deleted position. Role 1 is a line with
    one character deleted, role 2 the shorter line itself; both have the same kind of key.
    """
    np.seterr(over="ignore")  # numbers wrap on purpose
    for batch in batches:
        slots = batch.column(1).to_numpy()
        for i, j in blocks(batch.column(2)):
            lines = Lines(batch.column(2)[i:j].to_pylist())
            hashes, keys, roles = [], [], []
            own = batch.column(0)[i:j].to_numpy()
            for k in range(j - i):
                shorter = int(lines.length[k]) - slots[i + k] // PIECES
                begin, stop = piece_bounds(np.int64(shorter), slots[i + k] % PIECES)
                s, e = lines.start[k], lines.end[k]
                one_less = slots[i + k] >= PIECES
                at = s + np.arange(begin, stop + one_less)
                at = at[at < e]
                left = (lines.sums[at] - lines.sums[s]) * lines.unit[s]
                right = (lines.sums[e] - lines.sums[at + 1]) * lines.unit[s + 1]
                variant = mix(left + right + np.uint64(shorter if one_less else shorter - 1) * _ODD)
                if one_less:
                    variant = np.unique(variant)
                    role = np.ones(len(variant), dtype=np.int32)
                else:
                    whole = mix(lines.part(s, e) + np.uint64(shorter) * _ODD)
                    variant = np.append(mix(variant + (at - s + 1).astype(np.uint64) * _ODD), whole)
                    role = np.append(np.zeros(len(at), np.int32), np.int32(2))
                hashes.append(np.full(len(variant), own[k]))
                keys.append(variant)
                roles.append(role)
            if hashes:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(hashes)), signed(np.concatenate(keys)),
                     pa.array(np.concatenate(roles))], ["hash", "key", "role"])


def earliest(rows: DataFrame, key: str) -> DataFrame:
    """The earliest (doc_id, line) per key, with its line hash.

    Three aggregates with buffers of fixed width, which Spark hashes and combines in the
    tasks; a minimum of structs would sort.
    """
    per_doc = rows.groupBy(key, "doc_id").agg(
        F.min("line").alias("line"), F.min_by("hash", "line").alias("hash"))
    return per_doc.groupBy(key).agg(
        F.min_by("line", "doc_id").alias("line"), F.min_by("hash", "doc_id").alias("hash"),
        F.min("doc_id").alias("doc_id"))


def before(a_doc: Column, a_line: Column, b_doc: Column, b_line: Column) -> Column:
    return (a_doc < b_doc) | ((a_doc == b_doc) & (a_line < b_line))


def within_one_edit(a: str, b: str) -> bool:
    """Whether one edit or none makes two texts equal, in near-linear time."""
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    low, high = 0, len(a)  # the common prefix ends between them
    while low < high:
        half = (low + high + 1) // 2
        if a[low:half] == b[low:half]:
            low = half
        else:
            high = half - 1
    return a[low + (len(a) == len(b)):] == b[low + 1:]


def similar_values(a: pa.Array, b: pa.Array) -> pa.Array:
    return pa.array([within_one_edit(x, y) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)],
                    pa.bool_())


def near_lines(docs: DataFrame, lines: DataFrame, firsts: DataFrame) -> DataFrame:
    """Hashes of the distinct lines that are similar to an earlier, different one."""
    slots = lines.select("hash", F.posexplode("keys").alias("slot", "key"))
    shared = slots.groupBy("key").agg(F.min("hash").alias("low"), F.max("hash").alias("high")) \
        .filter(F.col("low") != F.col("high")).select("key")
    shared = stage(shared, "line-keys")
    wanted = slots.join(broadcast_if_small(shared), "key", "left_semi").select(
        "hash", "slot").distinct()
    per_doc = wanted.join(firsts, "hash").groupBy("doc_id").agg(
        F.collect_list(F.struct("line", "hash", "slot")).alias("wanted"))  # lines of one text
    per_doc = stage(per_doc, "line-candidates")
    held = per_doc.agg(F.count(F.lit(1)), F.sum(F.size("wanted"))).first()
    few = broadcast_if_small(per_doc, rows=held[0] + (held[1] or 0), row_bytes=32)
    found = stage(
        docs.filter(F.col("text").isNotNull()).join(few, "doc_id").select("text", "wanted")
        .mapInArrow(candidate_lines, "hash bigint, slot int, value string"), "line-texts")
    keyed = found.mapInArrow(deletion_keys, "hash bigint, key bigint, role int").distinct()
    placed = stage(keyed.join(firsts, "hash"), "line-variants")
    same_place = placed.filter("role = 0")
    least = earliest(same_place, "key").select("key", F.col("hash").alias("other"))
    pairs = same_place.join(least, "key").filter("hash != other").select("hash", "other")
    whole = placed.filter("role = 2").select("key", F.col("hash").alias("other"))
    pairs = pairs.union(
        placed.filter("role = 1").join(whole, "key").select("hash", "other"))
    # Of the longer lines of a shorter one only the earliest can drop it.
    longest = earliest(placed.filter("role = 1"), "key").select("key", F.col("hash").alias("other"))
    pairs = pairs.union(
        placed.filter("role = 2").join(longest, "key").select("hash", "other")).distinct()
    values = found.groupBy("hash").agg(F.first("value").alias("value"))
    places = firsts.select("hash", "doc_id", "line")

    def side(name: str) -> DataFrame:
        return values.join(places, "hash").select(
            F.col("hash").alias(name), F.struct("value", "doc_id", "line").alias(f"{name}_at"))

    checked = pairs.join(side("hash"), "hash").join(side("other"), "other")
    mine, its = "hash_at", "other_at"
    return checked.filter(
        before(F.col(f"{its}.doc_id"), F.col(f"{its}.line"), F.col(f"{mine}.doc_id"), F.col(f"{mine}.line"))
    ).filter(F.arrow_udf(similar_values, "boolean")(f"{mine}.value", f"{its}.value")).select(
        "hash").distinct()


def without_lines(text: pa.Array, dropped: pa.Array) -> pa.Array:
    """Texts without the listed (line, hash) places; a hash tells rows that share an id apart."""
    out = []
    for i, j in blocks(text):
        values = text[i:j].to_pylist()
        lines, at = Lines(values), 0
        for value, gone in zip(values, dropped[i:j].to_pylist(), strict=True):
            pieces = (value or "").split("\n")
            if gone and value is not None:
                gone = {(g["line"], g["hash"]) for g in gone}
                hashes = lines.hash[at:at + len(pieces)].view(np.int64).tolist()
                value = "\n".join(p for k, p in enumerate(pieces) if (k, hashes[k]) not in gone)
            out.append(value)
            at += len(pieces)
    return pa.array(out, pa.string())


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per input row: doc_id, n_lines, n_dropped, near_dropped, text without them."""
    prepare(docs.sparkSession)
    docs = pick(docs, [doc_id, text]).toDF("doc_id", "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    lines = stage(docs.filter(F.col("text").isNotNull()).mapInArrow(
        describe_lines, f"doc_id {kind}, line int, hash bigint, keys array<bigint>"), "lines")
    firsts = stage(earliest(lines.select(F.col("hash").alias("value"), "hash", "doc_id", "line"),
                            "value").select("hash", "doc_id", "line"), "line-firsts")
    near = near_lines(docs, lines, firsts).withColumn("near", F.lit(True))
    verdict = stage(firsts.toDF("hash", "first_doc", "first_line").join(near, "hash", "left"),
                    "line-verdicts")
    # Not before the first place, and either another place or a similar earlier line.
    gone = lines.join(verdict, "hash").filter(
        F.col("near") | ~F.col("doc_id").eqNullSafe(F.col("first_doc"))
        | (F.col("line") != F.col("first_line")))
    per_doc = gone.groupBy("doc_id").agg(
        F.collect_set(F.struct("line", "hash")).alias("gone"),  # lines of one text
        F.countDistinct(F.when(F.col("near"), F.col("line"))).alias("near"))
    size = F.coalesce(F.size(F.split("text", "\n")), F.lit(0))
    joined = docs.join(per_doc.withColumnRenamed("doc_id", "_id"),
                       F.col("doc_id").eqNullSafe(F.col("_id")), "left")
    cleaned = F.arrow_udf(without_lines, "string")("text", "gone")
    return joined.select(
        F.col("doc_id").alias(doc_id), F.when(F.col("text").isNull(), 0).otherwise(size)
        .cast("bigint").alias("n_lines"),
        F.coalesce(F.size("gone"), F.lit(0)).cast("bigint").alias("n_dropped"),
        F.coalesce("near", F.lit(0)).cast("bigint").alias("near_dropped"),
        cleaned.alias(text))
