"""Language identification with language-bitmask n-gram filters.

Learning counts the letter trigrams of every labelled text per language. A trigram
belongs to each language in which it is frequent, by itself and against the language
that has it most. All (trigram, languages) facts go into one bit-sliced Bloom filter:
a slot holds one bit per language, and the AND of a trigram's slots names all the
languages that contain it. A text is decided by its popcounts per language, each
corrected for that language's rate of false positives.

The filter has a fixed number of slots, whatever the corpus; what reaches the driver
is one row per filled slot. Counting is partial in the tasks before the shuffle, so a
language that holds most rows does not gather in one task.

Defined cases: a text that is null or has no letters is ``und`` with score 0; a text
none of whose trigrams is known gets the language with the most training text, with
score 0; without labelled rows everything is ``und``; repeated rows are rows of their
own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import pick, prepare
from graphloom.llm.text import blocks, mix
from graphloom.session import stage

SLOTS = 1 << 19
HASHES = 3
#: A trigram belongs to a language where it has this share of its highest frequency,
SHARE = 0.2
#: and this frequency at least.
LEAST = 1e-6
UNKNOWN = "und"
MOST_LANGUAGES = 63  # bits of a slot
_BUFFERED_ROWS = 400_000


def letter_table() -> np.ndarray:
    """Whether each code point is a letter."""
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def trigrams(texts: list[str | None], letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the trigrams around every letter of every text, and n + 1 offsets.

    Other characters count as spaces, so a trigram also says where words begin and end.
    """
    padded = [f" {t.lower()} " if t else "" for t in texts]
    ends = np.cumsum([0, *map(len, padded)])
    points = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    is_letter = letters[points]
    points = np.where(is_letter, points, np.uint32(32)).astype(np.int64)
    middle = np.flatnonzero(is_letter)
    codes = points[middle - 1] | points[middle] << 21 | points[middle + 1] << 42
    return codes, np.searchsorted(middle, ends)


def slots_of(codes: np.ndarray, slots: int, hashes: int) -> np.ndarray:
    """The slots of each code, one row per hash function."""
    base = codes.astype(np.uint64)
    return np.stack([
        (mix(base + np.uint64((i + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(slots))
        for i in range(hashes)
    ]).astype(np.int64)


@dataclass
class LanguageFilter:
    """The learned filter: ``masks`` has a bit per language in every slot."""

    languages: list[str]
    masks: np.ndarray
    false_positives: np.ndarray
    hashes: int
    letters: np.ndarray

    def classify(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        codes, offsets = trigrams(texts, self.letters)
        counts = np.diff(offsets).astype(float)
        if not self.languages:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        which, distinct = pd.factorize(codes)
        found = np.full(len(distinct), -1, dtype=np.int64)
        for row in slots_of(distinct, len(self.masks), self.hashes):
            found &= self.masks[row]
        shares = np.zeros((len(self.languages), len(texts)))
        for bit, rate in enumerate(self.false_positives):
            hits = np.zeros(len(codes) + 1, dtype=np.int64)
            np.cumsum((found >> bit & 1)[which], out=hits[1:])
            got = hits[offsets[1:]] - hits[offsets[:-1]]
            shares[bit] = (got - counts * rate) / np.maximum(counts * (1 - rate), 1e-9)
        shares = np.clip(shares, 0.0, 1.0)
        best = shares.argmax(axis=0)
        names = [self.languages[b] if n else UNKNOWN for b, n in zip(best, counts, strict=True)]
        scores = np.where(counts > 0, shares[best, np.arange(len(texts))], 0.0)
        return names, scores.tolist()


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", slots: int = SLOTS,
          hashes: int = HASHES, share: float = SHARE, least: float = LEAST) -> LanguageFilter:
    """Fit the filter on every row of ``labelled`` that has a language."""
    spark = labelled.sparkSession
    prepare(spark)
    letters = spark.sparkContext.broadcast(letter_table())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0

        def flush() -> pa.RecordBatch:
            frame = pd.concat(held).groupby(["lang", "gram"], as_index=False)["n"].sum()
            held.clear()
            return pa.RecordBatch.from_pandas(frame, preserve_index=False, schema=pa.schema(
                [("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())]))

        for batch in batches:
            for i, j in blocks(batch.column(0)):
                codes, offsets = trigrams(batch.column(0)[i:j].to_pylist(), letters.value)
                number, names = pd.factorize(np.array(batch.column(1)[i:j].to_pylist(), object))
                of_code = np.repeat(number, np.diff(offsets))
                for k, name in enumerate(names):
                    which, grams = pd.factorize(codes[of_code == k])
                    held.append(pd.DataFrame({
                        "lang": name, "gram": grams, "n": np.bincount(which, minlength=len(grams))}))
                    rows += len(grams)
                if rows > _BUFFERED_ROWS:
                    yield flush()
                    rows = 0
        if held:
            yield flush()

    known = pick(labelled, [text, lang]).filter(F.col(lang).isNotNull())
    grams = known.mapInArrow(count, "lang string, gram bigint, n bigint").groupBy(
        "lang", "gram").agg(F.sum("n").alias("n"))
    grams = stage(grams, "trigrams")
    totals = grams.groupBy("lang").agg(F.sum("n").alias("total")).limit(MOST_LANGUAGES + 1).collect()
    if len(totals) > MOST_LANGUAGES:
        raise ValueError(f"a slot has bits for {MOST_LANGUAGES} languages")
    totals = sorted(totals, key=lambda r: (-r["total"], r["lang"]))
    languages = [r["lang"] for r in totals]
    masks = np.zeros(slots, dtype=np.int64)
    if languages:
        bits = spark.createDataFrame(
            [(r["lang"], 1 << k, float(r["total"])) for k, r in enumerate(totals)],
            "lang string, bit bigint, total double")
        # At most one entry per language: a short list.
        by_gram = grams.join(F.broadcast(bits), "lang").groupBy("gram").agg(
            F.collect_list(F.struct("bit", (F.col("n") / F.col("total")).alias("p"))).alias("has"),
            F.max(F.col("n") / F.col("total")).alias("top"))
        member = F.filter("has", lambda x: (x["p"] >= F.col("top") * share) & (x["p"] >= least))
        mask = F.aggregate(member, F.lit(0).cast("bigint"), lambda a, x: a.bitwiseOR(x["bit"]))

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows = slots_of(batch.column(0).to_numpy(), slots, hashes).ravel()
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), pa.array(np.tile(batch.column(1).to_numpy(), hashes))],
                    ["slot", "mask"])

        filled = (by_gram.select("gram", mask.alias("mask"))
                  .mapInArrow(place, "slot bigint, mask bigint")
                  .groupBy("slot").agg(F.bit_or("mask").alias("mask")).toArrow())
        masks[filled["slot"].to_numpy()] = filled["mask"].to_numpy()
    fill = np.array([(masks >> k & 1).mean() for k in range(len(languages))])
    return LanguageFilter(languages, masks, fill ** hashes, hashes, letters.value)


def language_of(model: LanguageFilter, text: Column, docs: DataFrame) -> Column:
    """A struct column (lang_pred, score) of a text column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def classify(column: pa.Array) -> pa.Array:
        names, scores = [], []
        learned = LanguageFilter(**shared.value)
        for i, j in blocks(column):
            some = learned.classify(column[i:j].to_pylist())
            names += some[0]
            scores += some[1]
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores, pa.float64())], ["lang_pred", "score"])

    return classify(text)
