"""A quality classifier by positive-unlabelled learning.

Trusted positives are the rows labelled good; the unlabelled rows are web text of
unknown quality. With the class prior p, the risk of a scorer f is
``p E_P[l(f)] + max(0, E_U[l(-f)] - p E_P[l(-f)])`` with the logistic loss l: the
estimate of the negative part is unbiased, and is kept from going below zero. Bad
rows are never shown to the scorer; the prior is estimated as the share of good rows
among the labelled ones.

The scorer is additive: every feature of the whole text goes through a piecewise
linear function with knots at quantiles. It is fitted on at most ``MOST_POSITIVE``
and ``MOST_UNLABELLED`` rows, picked by a hash of their id, so the driver holds that
many rows of ``len(FEATURES)`` numbers; the prior counts all labels, and every row is
scored.

Defined cases: null and empty texts have features of their own (all zero) and a score;
without positives or unlabelled rows every score is the prior (1/2 without labels);
labels of unknown ids count for the prior only; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import pick, prepare
from graphloom.llm.text import blocks, string_bytes, word_hashes

MOST_POSITIVE = 8_000
MOST_UNLABELLED = 16_000
SEED = 7
KNOTS = 8
STEPS = 400
RATE = 0.05
DECAY = 1e-4

FEATURES = (
    "log_words", "word_length", "distinct_words", "repeated_neighbours", "upper", "digits",
    "bars", "bangs", "marks", "commas", "stops", "other_ascii", "high_bytes", "line_length",
    "words_per_stop", "upper_pairs", "mark_ends", "common_word",
)


def _class_table() -> np.ndarray:
    """For each byte: 0 space, 1 lower case, 2 upper case, 3 digit, 4 bar, 5 bang,
    6 mark, 7 comma, 8 full stop, 9 other ASCII, 10 part of a longer character, 11 newline."""
    out = np.full(256, 9, dtype=np.uint8)
    out[128:] = 10
    for chars, k in ((b" \t\x0b\x0c\r", 0), (bytes(range(97, 123)), 1), (bytes(range(65, 91)), 2),
                     (b"0123456789", 3), (b"|", 4), (b"!", 5), (b"#$%&*@^~<>{}[]\\/+=_", 6),
                     (b",;:", 7), (b".?", 8), (b"\n", 11)):
        out[list(chars)] = k
    return out


_CLASS = _class_table()


def features(column: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` per text."""
    data, offsets = string_bytes(column)
    n = len(column)
    kinds = _CLASS[data]
    size = np.maximum(np.diff(offsets), 1).astype(float)
    hashes, at = word_hashes(column)
    words = np.diff(at)
    some = np.maximum(words, 1).astype(float)

    def per_row(flags: np.ndarray, where: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, dtype=np.int64)
        np.cumsum(flags, out=total[1:])
        return (total[where[1:]] - total[where[:-1]]).astype(float)

    counts = {k: per_row(kinds == k, offsets) for k in range(12)}
    row = np.repeat(np.arange(n), words)
    same = np.zeros(len(hashes), dtype=bool)
    if len(hashes) > 1:
        same[1:] = (hashes[1:] == hashes[:-1]) & (row[1:] == row[:-1])
    order = np.lexsort((hashes, row))
    first = np.ones(len(hashes), dtype=bool)
    if len(hashes) > 1:
        first[1:] = (hashes[order][1:] != hashes[order][:-1]) | (row[order][1:] != row[order][:-1])
    runs = np.flatnonzero(first)
    length = np.diff(np.append(runs, len(hashes)))
    most = np.zeros(n)
    if len(runs):
        np.maximum.at(most, row[order][runs], length)
    pairs = np.zeros(len(kinds), dtype=bool)
    ends = np.zeros(len(kinds), dtype=bool)
    if len(kinds) > 1:
        pairs[1:] = (kinds[1:] == 2) & (kinds[:-1] == 2)
        ends[:-1] = (kinds[:-1] == 6) & ((kinds[1:] == 0) | (kinds[1:] == 11))
    letters = np.maximum(counts[1] + counts[2] + counts[10], 1)
    return np.stack([
        np.log1p(words), np.minimum((size - counts[0] - counts[11]) / some, 40),
        per_row(first, at) / np.sqrt(some), per_row(same, at) / some, counts[2] / letters,
        counts[3] / size, counts[4] / some, counts[5] / some, counts[6] / some, counts[7] / some,
        counts[8] / some, counts[9] / some, counts[10] / size,
        np.log1p(size / (counts[11] + 1)), np.log1p(some / (counts[8] + 1)),
        per_row(pairs, offsets) / letters, per_row(ends, offsets) / some, most / some,
    ], axis=1) * (words > 0)[:, None]


@dataclass
class QualityModel:
    knots: np.ndarray  # one row of knots per feature
    scale: np.ndarray
    weights: np.ndarray
    bias: float

    def basis(self, x: np.ndarray) -> np.ndarray:
        """Every feature and its hinges at the knots, scaled."""
        hinges = np.maximum(x[:, :, None] - self.knots[None], 0.0).reshape(len(x), -1)
        return np.concatenate([x, hinges], axis=1) / self.scale

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.weights):
            return np.full(len(x), self.bias)
        return _sigmoid(self.basis(x) @ self.weights + self.bias)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -30, 30)))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, knots: int = KNOTS,
        steps: int = STEPS, rate: float = RATE, decay: float = DECAY) -> QualityModel:
    """Minimise the non-negative risk by full-batch steps with momentum (Adam)."""
    if not len(positive) or not len(unlabelled):
        return QualityModel(np.zeros((0, 0)), np.zeros(0), np.zeros(0), prior)
    both = np.concatenate([positive, unlabelled])
    at = np.quantile(both, np.linspace(0.02, 0.98, knots), axis=0).T
    model = QualityModel(at, np.ones(1), np.zeros(1), 0.0)
    model.scale = np.maximum(model.basis(both).std(axis=0), 1e-6)
    p, u = model.basis(positive), model.basis(unlabelled)
    mean_p = p.mean(axis=0)
    w, b = np.zeros(p.shape[1]), 0.0
    first, second = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    for step in range(1, steps + 1):
        fp, fu = _sigmoid(p @ w + b), _sigmoid(u @ w + b)
        # The slope of l(f) is s - 1 and that of l(-f) is s, with s the sigmoid of f.
        minus = np.append(u.T @ fu / len(u), fu.mean()) - prior * np.append(
            p.T @ fp / len(p), fp.mean())
        risk = -np.log1p(-np.minimum(fu, 1 - 1e-12)).mean() + prior * np.log1p(
            -np.minimum(fp, 1 - 1e-12)).mean()
        plus = prior * (np.append(p.T @ fp / len(p), fp.mean()) - np.append(mean_p, 1.0))
        slope = plus + minus if risk >= 0 else -minus
        slope[:-1] += decay * w
        first = 0.9 * first + 0.1 * slope
        second = 0.999 * second + 0.001 * slope ** 2
        move = rate * (first / (1 - 0.9 ** step)) / (
            np.sqrt(second / (1 - 0.999 ** step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    model.weights, model.bias = w, float(b)
    return model


def sample_features(docs: DataFrame, ids: DataFrame, text: str, doc_id: str) -> np.ndarray:
    """Features of the documents with the given ids, a limited number of rows."""

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j in blocks(batch.column(0)):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(features(batch.column(0)[i:j])), pa.list_(pa.float64()))], ["x"])

    rows = (docs.join(F.broadcast(ids), doc_id, "left_semi").select(text)
            .mapInArrow(describe, "x array<double>").toArrow())["x"].combine_chunks()
    return np.asarray(rows.values).reshape(-1, len(FEATURES))


def learn(docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
          quality: str = "quality", most_positive: int = MOST_POSITIVE,
          most_unlabelled: int = MOST_UNLABELLED) -> QualityModel:
    """Fit on documents and the labels of some; bad labels only count for the prior."""
    prepare(docs.sparkSession)
    docs, labels = pick(docs, [doc_id, text]), pick(labels, [doc_id, quality])
    share = labels.filter(F.col(quality).isNotNull()).agg(
        F.avg((F.col(quality) == 1).cast("double"))).first()[0]
    prior = 0.5 if share is None else min(max(share, 0.01), 0.99)

    def some(ids: DataFrame, most: int) -> DataFrame:
        return ids.orderBy(F.xxhash64(F.lit(SEED), doc_id), doc_id).limit(most)

    good = some(labels.filter(F.col(quality) == 1).select(doc_id), most_positive)
    return fit(sample_features(docs, good, text, doc_id),
               sample_features(docs, some(docs.select(doc_id), most_unlabelled), text, doc_id),
               prior)


def quality_of(model: QualityModel, text: Column, docs: DataFrame) -> Column:
    """The probability of good quality, 0 to 1, of a text column of ``docs``."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        learned = QualityModel(**shared.value)
        parts = [learned.score(features(column[i:j])) for i, j in blocks(column)]
        return pa.array(np.concatenate(parts) if parts else np.zeros(0), pa.float64())

    return score(text)
