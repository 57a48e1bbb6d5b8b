"""Language-model scores: a bigram model with Katz backoff, trained on the corpus.

Words are lower-cased (A-Z) runs outside ``[\\x20\\x09-\\x0D]``; every text ends with one end
token and begins after a begin mark, which is never predicted. With c counts of the
training texts:

* p(w) = d(c) c / Z, the unknown words together have the mass that discounting left;
* p(w | h) = d(c(h,w)) c(h,w) / c(h) for a pair that was seen, else a(h) p(w), where a(h)
  makes the probabilities after h sum to one exactly.

d are Good-Turing discounts for counts up to ``SMALL``; larger counts give up ``LARGE_GIVES``
of one occurrence, so that every history can back off.

Tables, all spread over the cluster: ``words`` (count of every word), ``encoded`` (the texts
as codes of words, in batches), ``rare`` (training counts of the unranked words of each batch),
``counted`` (counts of every pair, in buckets by history). Every word has pair counts and a
backoff weight of its own. The code of a word is short for the ``VOCABULARY`` most frequent
words, whose ranks are known to every task, and its 64-bit hash otherwise; what is known of
those comes by joins, so the ranks bound a broadcast and not the model.

Pairs are counted and looked up in one exchange: a batch sends its distinct pairs with its
training counts, and gets the totals back, with the sums for a(h) of the unranked histories
that back off. A bucket holds whole histories, except that histories frequent enough to fill
buckets are cut by their next word; their sums for a(h) are added up afterwards. A batch sends
a pair once, so a hot pair costs one entry per batch.

Defined cases: null and empty texts have the end token only; words that training never saw
share the unknown mass each; without training texts everything is unknown; repeated rows are
scored (and counted) one by one; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import prepare
from graphloom.llm.text import blocks, mix, word_hashes
from graphloom.session import stage

VOCABULARY = 1 << 19
SMALL = 5
LARGE_GIVES = 0.1
BATCH_BYTES = 4 << 20
BUCKETS_PER_PARTITION = 8
_HELD_WORDS = 1 << 20
_HASHED = np.uint64(1 << 63)  # marks codes that are hashes
_STEPS = 8  # of a doubling of the count, where the vocabulary is cut


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as compressed byte planes: the high bytes are mostly zero."""
    values = np.ascontiguousarray(values)
    planes = values.view(np.uint8).reshape(-1, values.itemsize).T
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = pa.decompress(data, decompressed_size=n * size, codec="zstd", asbytes=True)
    planes = np.frombuffer(raw, dtype=np.uint8).reshape(size, n).T
    return np.ascontiguousarray(planes).view(dtype).ravel()


def discounts(of_count: np.ndarray) -> np.ndarray:
    """d(0..SMALL) from how many things have each count 0..SMALL+1.

    Good-Turing with Katz's rescaling, where it falls between 0 and 1; else half an
    occurrence is taken off.
    """
    n = np.asarray(of_count, dtype=float)
    d = np.ones(SMALL + 1)
    common = (SMALL + 1) * n[SMALL + 1] / n[1] if n[1] else 1.0
    for r in range(1, SMALL + 1):
        d[r] = (r - 0.5) / r
        if n[r] and n[r + 1] and common < 1:
            turing = ((r + 1) * n[r + 1] / n[r] / r - common) / (1 - common)
            if 0 < turing < 1:
                d[r] = turing
    return d


def discounted(counts: np.ndarray, d: np.ndarray) -> np.ndarray:
    """d(c) c for every count."""
    small = np.minimum(counts, SMALL).astype(np.int64)
    return np.where(counts > SMALL, counts - LARGE_GIVES, d[small] * counts)


@dataclass
class Pairs:
    """Distinct pairs of a batch, those of a bucket together; for words without a rank, which
    have the rare class in ``keys``, their hashes and training counts."""

    keys: np.ndarray  # (history, word)
    history: np.ndarray  # hash
    history_n: np.ndarray
    word: np.ndarray  # hash
    word_n: np.ndarray
    bucket: np.ndarray


@dataclass
class Vocabulary:
    """Ranked words, by hash; then the class of rare words, the end token and the begin mark."""

    hashes: np.ndarray  # sorted
    counts: np.ndarray  # of ranks, the rare class, the end, the begin mark
    unigram: np.ndarray  # p of ranks, the rare class (0) and the end
    total: int  # N
    distinct: int  # V
    discount: np.ndarray
    unknown: float  # the mass of unknown words times Z
    z: float
    buckets: int

    @property
    def rare(self) -> int:
        return len(self.hashes)

    def codes(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranks, or from ``rare + 3`` on the places in the second result: the sorted hashes
        of all words without a rank."""
        distinct, which = np.unique(hashes, return_inverse=True)
        at = np.minimum(np.searchsorted(self.hashes, distinct), max(self.rare - 1, 0))
        ranked = self.hashes[at] == distinct if self.rare else np.zeros(len(distinct), dtype=bool)
        code = np.where(ranked, at, self.rare + 2 + np.cumsum(~ranked))
        return code.astype(np.uint32)[which], distinct[~ranked]

    def pairs(self, codes: np.ndarray, lengths: np.ndarray, rare: np.ndarray,
              rare_n: np.ndarray) -> tuple[Pairs, np.ndarray, np.ndarray]:
        """The pairs of all tokens of all texts, where each token's pair is, and n + 1 offsets
        of the texts. ``rare`` are the hashes that codes refer to, with training counts."""
        ends = np.cumsum(lengths)
        word = np.insert(codes.astype(np.int64), ends, self.rare + 1)
        offsets = np.append(0, ends + np.arange(1, len(lengths) + 1))
        history = np.empty_like(word)
        history[1:] = word[:-1]
        history[offsets[:-1]] = self.rare + 2
        first = self.rare + 3
        distinct, which = np.unique(history * (first + len(rare)) + word, return_inverse=True)
        hashes, counts = np.append(rare, np.uint64(0)), np.append(rare_n, 0)

        def side(code: np.ndarray) -> tuple[np.ndarray, ...]:
            at = np.where(code >= first, code - first, len(rare))
            return np.where(code >= first, self.rare, code), hashes[at], counts[at]

        history, history_hash, history_n = side(distinct // (first + len(rare)))
        word, word_hash, word_n = side(distinct % (first + len(rare)))
        keys = history * (self.rare + 2) + word
        bucket = self.bucket(keys, history_hash)
        order = np.argsort(bucket, kind="stable")
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        pairs = Pairs(*(x[order] for x in (keys, history_hash, history_n, word_hash, word_n, bucket)))
        return pairs, place[which], offsets

    def split(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return keys // (self.rare + 2), keys % (self.rare + 2)

    def bucket(self, keys: np.ndarray, history_hash: np.ndarray) -> np.ndarray:
        """A history goes to one bucket, or to as many as its share of all tokens."""
        history, word = self.split(keys)
        cuts = 1 + self.counts[history] * self.buckets // max(self.total, 1)
        cuts[history == self.rare] = 1
        part = mix(word.astype(np.uint64)) % cuts.astype(np.uint64)
        return (mix(history.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + part + history_hash)
                % np.uint64(self.buckets)).astype(np.int64)

    def probability(self, words: np.ndarray, rare_n: np.ndarray) -> np.ndarray:
        """p(w) of ranks and, by their training counts, of words of the rare class."""
        rare = np.where(rare_n > 0, discounted(rare_n, self.discount), self.unknown) / self.z
        return np.where(words == self.rare, rare, self.unigram[words])

    def count(self, words: np.ndarray, rare_n: np.ndarray) -> np.ndarray:
        return np.where(words == self.rare, rare_n, self.counts[words])


def word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts to (word, n), combined within the task as far as memory is bounded."""
    np.seterr(over="ignore")
    words, counts = [], []

    def flush() -> pa.RecordBatch:
        distinct, which = np.unique(np.concatenate(words), return_inverse=True)
        n = np.bincount(which, weights=np.concatenate(counts)).astype(np.int64)
        words.clear()
        counts.clear()
        return pa.RecordBatch.from_arrays(
            [pa.array(distinct.view(np.int64)), pa.array(n)], ["word", "n"])

    for batch in batches:
        for i, j in blocks(batch.column(0)):
            distinct, n = np.unique(word_hashes(batch.column(0)[i:j])[0], return_counts=True)
            words.append(distinct)
            counts.append(n)
        if sum(map(len, words)) > _HELD_WORDS:
            yield flush()
    if sum(map(len, words)):
        yield flush()


def small_count(column: Column, d: np.ndarray) -> Column:
    """d(c) c as a column."""
    out = column - LARGE_GIVES
    for r in range(1, SMALL + 1):
        out = F.when(column == r, float(d[r] * r)).otherwise(out)
    return out


def vocabulary(words: DataFrame, texts: int, size: int, buckets: int) -> Vocabulary:
    """Count statistics of the words, and the ``size`` most frequent ones at most.

    The cut is at a count, so words with equal counts are treated alike.
    """
    step = F.floor(F.log2("n") * _STEPS)
    shares = words.groupBy(step.alias("step")).agg(
        F.count(F.lit(1)).alias("words"), F.sum("n").alias("tokens")).collect()
    least, room = 0.0, size
    for r in sorted(shares, key=lambda r: -r["step"]):
        room -= r["words"]
        if room < 0:
            least = r["step"] + 1
            break
    few = words.filter(F.col("n") <= SMALL + 1).groupBy("n").count().collect()
    of_count = np.zeros(SMALL + 2)
    for r in few:
        of_count[r["n"]] = r["count"]
    if 0 < texts <= SMALL + 1:
        of_count[texts] += 1  # the end token
    d = discounts(of_count)
    top = words.filter(step >= least).toArrow()
    hashes = top["word"].to_numpy().view(np.uint64)
    order = np.argsort(hashes)
    hashes, counts = hashes[order], top["n"].to_numpy()[order].astype(np.int64)
    left = words.filter(step < least).agg(
        F.sum("n"), F.sum(small_count(F.col("n"), d))).first()
    total = sum(r["tokens"] for r in shares) + texts
    distinct = sum(r["words"] for r in shares) + (texts > 0)
    mass = np.append(discounted(counts, d), [left[1] or 0.0, discounted(np.array([texts]), d)[0]])
    unknown = max(total - mass.sum(), 0.5)
    z = mass.sum() + unknown
    mass[-2] = 0.0  # its words have probabilities of their own
    return Vocabulary(hashes, np.append(counts, [left[0] or 0, texts, texts]), mass / z,
                      total, distinct, d, unknown, z, buckets)


ENCODED = ("batch bigint, doc_id array<bigint>, train array<boolean>, lengths array<bigint>, "
           "n bigint, codes binary, rare array<bigint>")


def encode(shared) -> object:
    """(doc_id, train, text) to batches of texts as codes, with the hashes of unranked words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        known = Vocabulary(**shared.value)
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j in blocks(batch.column(2), BATCH_BYTES):
                hashes, offsets = word_hashes(batch.column(2)[i:j])
                codes, rare = known.codes(hashes)
                yield pa.RecordBatch.from_arrays([
                    pa.array([number]), pa.array([batch.column(0)[i:j].to_pylist()], pa.list_(pa.int64())),
                    pa.array([batch.column(1)[i:j].to_pylist()], pa.list_(pa.bool_())),
                    pa.array([np.diff(offsets)], pa.list_(pa.int64())), pa.array([len(codes)]),
                    pa.array([pack(codes)], pa.binary()),
                    pa.array([rare.view(np.int64)], pa.list_(pa.int64())),
                ], [c.split()[0] for c in ENCODED.split(", ")])
                number += 1

    return run


def _rare_counts(rare: list[int], words: list[int] | None, n: list[int] | None) -> np.ndarray:
    """Training counts of the sorted hashes ``rare``, 0 for those that are not in ``words``."""
    rare = np.array(rare, dtype=np.int64).view(np.uint64)
    counts = np.zeros(len(rare), dtype=np.int64)
    if words:
        counts[np.searchsorted(rare, np.array(words, dtype=np.int64).view(np.uint64))] = n
    return counts


def _pairs_of(known: Vocabulary, batch: dict, words: list[int] | None, n: list[int] | None):
    rare = np.array(batch["rare"], dtype=np.int64).view(np.uint64)
    return known.pairs(unpack(batch["codes"], batch["n"], np.uint32),
                       np.array(batch["lengths"], dtype=np.int64), rare,
                       _rare_counts(batch["rare"], words, n))


ASKED = ("bucket int, batch bigint, n bigint, keys binary, counts binary, n_history bigint, "
         "history binary, n_word bigint, word binary, word_n binary")


def ask(shared) -> object:
    """Encoded batches to their distinct pairs by bucket, with training counts."""
    kinds = {"int": pa.int32(), "bigint": pa.int64(), "binary": pa.binary()}
    schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in ASKED.split(", ")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        known = Vocabulary(**shared.value)
        for some in batches:
            for batch in some.to_pylist():
                pairs, which, offsets = _pairs_of(known, batch, batch["word"], batch["word_n"])
                train = np.repeat(np.array(batch["train"], dtype=bool), np.diff(offsets))
                counts = np.bincount(which[train], minlength=len(pairs.keys)).astype(np.uint32)
                history, word = known.split(pairs.keys)
                cut = np.flatnonzero(np.diff(pairs.bucket, prepend=-1))
                rows = []
                for s, e in zip(cut, np.append(cut[1:], len(pairs.bucket)), strict=True):
                    h = pairs.history[s:e][history[s:e] == known.rare]
                    at = s + np.flatnonzero(word[s:e] == known.rare)
                    # Gaps wrap around where keys fall.
                    rows.append((
                        int(pairs.bucket[s]), batch["batch"], e - s,
                        pack(np.diff(pairs.keys[s:e], prepend=0).astype(np.uint64)),
                        pack(counts[s:e]), len(h), pack(np.diff(h, prepend=np.uint64(0))), len(at),
                        pack(pairs.word[at]), pack(pairs.word_n[at].astype(np.uint32))))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
                    schema=schema)

    return run


COUNTED = ("batch bigint, bucket int, n bigint, totals binary, n_sums bigint, sums binary, "
           "history array<bigint>, unigram array<double>, large array<double>, "
           "large_n array<bigint>, "
           + ", ".join(f"small_{r} array<bigint>" for r in range(1, SMALL + 2)))
_SUMS = SMALL + 4  # numbers per history: unigram, large, large_n and small_1 to small_(SMALL + 1)


def answer(shared) -> object:
    """All requests of a bucket to totals for each batch, and sums for each history; those of
    unranked histories go to the batches that back off from them."""
    names = [c.split()[0] for c in COUNTED.split(", ")]
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.int64(), pa.binary(),
             pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.float64()),
             pa.list_(pa.int64()), *[pa.list_(pa.int64())] * (SMALL + 1)]
    schema = pa.schema(list(zip(names, kinds, strict=True)))

    def settle(known: Vocabulary, bucket: int, asked: list[dict]) -> pa.RecordBatch:
        keys = np.concatenate([np.cumsum(unpack(r["keys"], r["n"], np.uint64)).astype(np.int64)
                               for r in asked])
        counts = np.concatenate([unpack(r["counts"], r["n"], np.uint32) for r in asked])
        history, word = known.split(keys)
        history_hash, word_hash = np.zeros((2, len(keys)), dtype=np.uint64)
        word_n = np.zeros(len(keys), dtype=np.int64)
        rare_history, rare_word = history == known.rare, word == known.rare
        history_hash[rare_history] = np.concatenate(
            [np.cumsum(unpack(r["history"], r["n_history"], np.uint64)) for r in asked])
        word_hash[rare_word] = np.concatenate(
            [unpack(r["word"], r["n_word"], np.uint64) for r in asked])
        word_n[rare_word] = np.concatenate(
            [unpack(r["word_n"], r["n_word"], np.uint32) for r in asked])
        pair = keys.astype(np.uint64)
        hashed = rare_history | rare_word
        pair[hashed] = mix(mix(mix(pair[hashed]) + history_hash[hashed]) + word_hash[hashed]) | _HASHED
        distinct, which = np.unique(pair, return_inverse=True)
        totals = np.bincount(which, weights=counts).astype(np.int64)
        one = np.empty(len(distinct), dtype=np.int64)  # a place of each pair
        one[which] = np.arange(len(which))
        one, n = one[totals > 0], totals[totals > 0]
        code = np.where(rare_history, history_hash | _HASHED, history.astype(np.uint64))
        histories, of = np.unique(code[one], return_inverse=True)
        large = n > SMALL + 1
        sums = np.stack([np.bincount(of, weights=x, minlength=len(histories)) for x in (
            known.probability(word[one], word_n[one]), np.where(large, n, 0), large,
            *(n == r for r in range(1, SMALL + 2)))], axis=1)
        rows = []
        at = np.append(0, np.cumsum([r["n"] for r in asked]))
        for r, s, e in zip(asked, at[:-1], at[1:], strict=True):
            got = totals[which[s:e]]
            wanted = np.unique(code[s:e][rare_history[s:e] & (got == 0)])
            found = np.zeros((len(wanted), _SUMS))
            if len(histories):
                place = np.minimum(np.searchsorted(histories, wanted), len(histories) - 1)
                met = histories[place] == wanted
                found[met] = sums[place[met]]
            rows.append((r["batch"], bucket, r["n"], pack(got.astype(np.uint32)), len(wanted),
                         pack(found.T.ravel()), *[None] * (SMALL + 5)))
        if len(histories):
            # All unranked histories as one, for the counts of counts.
            ranked = int(np.searchsorted(histories, _HASHED))
            names, table = histories[:ranked].astype(np.int64), sums[:ranked]
            if ranked < len(histories):
                names = np.append(names, known.rare)
                table = np.vstack([table, sums[ranked:].sum(axis=0)])
            rows.append((*[None, bucket], *[None] * 4, names, table[:, 0], table[:, 1],
                         *table[:, 2:].T.astype(np.int64)))
        return pa.RecordBatch.from_arrays(
            [pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)],
            schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        known = Vocabulary(**shared.value)
        asked: list[dict] = []
        for batch in batches:
            for row in batch.to_pylist():
                if asked and row["bucket"] != asked[0]["bucket"]:
                    yield settle(known, asked[0]["bucket"], asked)
                    asked = []
                asked.append(row)
        if asked:
            yield settle(known, asked[0]["bucket"], asked)

    return run


@dataclass
class Backoff:
    """c(h) and a(h) of ranks, and the discounts of pairs."""

    counts: np.ndarray
    weights: np.ndarray
    discount: np.ndarray

    def weight(self, sums: np.ndarray) -> np.ndarray:
        """a(h) from sums as ``answer`` gives them, 1 for a history that was not seen."""
        unigram, large, large_n, *small = sums
        taken, kept = large.copy(), large - LARGE_GIVES * large_n
        for r, n in enumerate(small, 1):
            taken += r * n
            kept += discounted(np.array([r]), self.discount)[0] * n
        out = (1 - kept / np.maximum(taken, 1)) / np.maximum(1 - unigram, 1e-12)
        return np.where(taken > 0, out, 1.0)

    def log_probability(self, known: Vocabulary, pairs: Pairs, totals: np.ndarray,
                        sums: np.ndarray) -> np.ndarray:
        """``sums`` are those of the unranked histories that back off, by bucket and hash."""
        history, word = known.split(pairs.keys)
        weight = self.weights[history]
        at = np.flatnonzero((history == known.rare) & (totals == 0))
        if len(at):
            code, bucket = pairs.history[at] | _HASHED, pairs.bucket[at]
            order = np.lexsort((code, bucket))
            code, bucket = code[order], bucket[order]
            fresh = np.append(False, (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1]))
            weight[at[order]] = self.weight(sums)[np.cumsum(fresh)]
        taken = np.where(history == known.rare, pairs.history_n, self.counts[history])
        seen = discounted(totals, self.discount) / np.maximum(taken, 1)
        return np.log10(np.where(
            totals > 0, seen, weight * known.probability(word, pairs.word_n)))


def backoff(counted: DataFrame, known: Vocabulary) -> Backoff:
    """Sums per ranked history, all others counting as one, and a(h) from them."""
    small = [f"small_{r}" for r in range(1, SMALL + 2)]
    names = ["history", "unigram", "large", "large_n", *small]
    sums = stage(
        counted.filter("history IS NOT NULL")
        .select(F.explode(F.arrays_zip(*names)).alias("x")).select("x.*")
        .groupBy("history").agg(*[F.sum(c).alias(c) for c in names[1:]]), "histories")
    of_count = sums.agg(*[F.coalesce(F.sum(c), F.lit(0)) for c in small]).first()
    d = discounts(np.array([0, *of_count]))
    # The counts up to SMALL + 1 come by how many pairs have them, the larger ones as sums.
    taken, kept = F.col("large"), F.col("large") - LARGE_GIVES * F.col("large_n")
    for r, column in enumerate(small, 1):
        taken = taken + r * F.col(column)
        kept = kept + float(discounted(np.array([r]), d)[0]) * F.col(column)
    # Where all words were seen, nothing backs off and the weight is never used.
    weight = (1 - kept / taken) / F.greatest(1 - F.col("unigram"), F.lit(1e-12))
    table = sums.select("history", taken.alias("taken"), weight.alias("weight")).toArrow()
    counts, weights = np.zeros(known.rare + 3), np.ones(known.rare + 3)
    counts[table["history"].to_numpy()] = table["taken"].to_numpy()
    weights[table["history"].to_numpy()] = table["weight"].to_numpy()
    return Backoff(counts, weights, d)


SCORED = ("doc_id bigint, train boolean, n_tokens bigint, n_known bigint, base_score double, "
          "score double")


def score(shared, weights) -> object:
    """Each encoded batch, followed by its rare words and the answers to it, to sums per text."""
    names = [c.split()[0] for c in SCORED.split(", ")]

    def settle(known: Vocabulary, model: Backoff, rows: list[dict]) -> pa.RecordBatch:
        batch, answers = rows[0], [r for r in rows if r["bucket"] >= 0]
        words = next((r for r in rows if r["bucket"] == -1), {"word": None, "word_n": None})
        pairs, which, offsets = _pairs_of(known, batch, words["word"], words["word_n"])
        totals = np.concatenate(
            [unpack(r["totals"], r["n"], np.uint32) for r in answers]).astype(np.int64)
        sums = np.concatenate(
            [unpack(r["sums"], r["n_sums"] * _SUMS, np.float64).reshape(_SUMS, -1) for r in answers],
            axis=1)
        logs = model.log_probability(known, pairs, totals, sums)
        word = known.split(pairs.keys)[1]
        count = known.count(word, pairs.word_n)
        base = np.log10((count + 0.5) / (known.total + 0.5 * (known.distinct + 1)))
        seen = (count > 0).astype(np.int64)
        sums = [np.add.reduceat(x[which], offsets[:-1]) for x in (seen, base, logs)]
        return pa.RecordBatch.from_arrays([
            pa.array(batch["doc_id"], pa.int64()), pa.array(batch["train"], pa.bool_()),
            pa.array(np.diff(offsets)), *map(pa.array, sums)], names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        known, model = Vocabulary(**shared.value), Backoff(**weights.value)
        held: list[dict] = []
        for some in batches:
            for row in some.to_pylist():
                if row["bucket"] == -2 and held:
                    yield settle(known, model, held)
                    held = []
                held.append(row)
        if held:
            yield settle(known, model, held)

    return run


def score_texts(docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text",
                size: int = VOCABULARY) -> DataFrame:
    """One row per input row: doc_id, train, n_tokens, n_known, train_tokens, base_score, score.

    ``train`` says which rows the model learns from; all rows are scored.
    """
    spark = docs.sparkSession
    prepare(spark)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    docs = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"),
                       F.coalesce(train, F.lit(False)).alias("train"), F.col(text).alias("text"))
    learned = docs.filter("train")
    words = stage(learned.select("text").mapInArrow(word_counts, "word bigint, n bigint")
                  .groupBy("word").agg(F.sum("n").alias("n")), "words")
    known = vocabulary(words, learned.count(), size, parts * BUCKETS_PER_PARTITION)
    shared = spark.sparkContext.broadcast(vars(known))
    encoded = stage(docs.mapInArrow(encode(shared), ENCODED), "encoded")
    # One list per batch, no longer than the batch.
    rare = stage(
        encoded.select("batch", F.explode("rare").alias("word")).join(words, "word")
        .groupBy("batch").agg(F.collect_list("word").alias("word"), F.collect_list("n").alias("word_n")),
        "rare")
    asked = encoded.join(rare, "batch", "left").select(
        "batch", "lengths", "train", "n", "codes", "rare", "word", "word_n").mapInArrow(
        ask(shared), ASKED)
    counted = stage(
        asked.repartition(parts, "bucket").sortWithinPartitions("bucket", "batch")
        .mapInArrow(answer(shared), COUNTED), "counted")
    weights = spark.sparkContext.broadcast(vars(backoff(counted, known)))
    kinds = dict(c.split() for c in f"batch bigint, bucket int, {ENCODED[14:]}, word array<bigint>, "
                 "word_n array<bigint>, totals binary, n_sums bigint, sums binary".split(", "))

    def row(df: DataFrame) -> DataFrame:
        return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast(t).alias(c)
                           for c, t in kinds.items()])

    rows = row(encoded.withColumn("bucket", F.lit(-2))).union(
        row(rare.withColumn("bucket", F.lit(-1)))).union(row(counted.filter("batch IS NOT NULL")))
    scored = rows.repartition(parts, "batch").sortWithinPartitions("batch", "bucket").mapInArrow(
        score(shared, weights), SCORED)
    return scored.select(
        F.col("doc_id").alias(doc_id), "train", "n_tokens", "n_known",
        F.lit(known.total).cast("bigint").alias("train_tokens"), "base_score", "score")
