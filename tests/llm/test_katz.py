import collections
import math

import pytest
from pyspark.sql import functions as F

from graphloom.llm.katz import LARGE_GIVES, SMALL, discounts, score_texts

SCHEMA = "doc_id bigint, text string, train string, n string, score int"


def tokens(text):
    return (text or "").encode().lower().split() + ["</s>"]


def curve(counts):
    d = discounts([0, *(sum(c == r for c in counts) for r in range(1, SMALL + 2))])
    return lambda k: k - LARGE_GIVES if k > SMALL else d[k] * k


class Model:
    """The same model by plain counting."""

    def __init__(self, texts):
        self.c, self.pairs, self.follow = collections.Counter(), collections.Counter(), collections.Counter()
        for t in texts:
            w = tokens(t)
            self.c.update(w)
            for pair in zip(["<s>", *w], w):
                self.pairs[pair] += 1
                self.follow[pair[0]] += 1
        self.n, self.v = sum(self.c.values()), len(self.c)
        one, self.two = curve(self.c.values()), curve(self.pairs.values())
        self.mass = {w: one(k) for w, k in self.c.items()}
        self.unknown = max(self.n - sum(self.mass.values()), 0.5)
        self.z = sum(self.mass.values()) + self.unknown
        after = collections.defaultdict(list)
        for (h, w), k in self.pairs.items():
            after[h].append((w, k))
        self.alpha = {h: (1 - sum(self.two(k) for _, k in f) / self.follow[h])
                      / (1 - sum(self.p(w) for w, _ in f)) for h, f in after.items()}

    def p(self, w):
        return self.mass.get(w, self.unknown) / self.z

    def after(self, h, w):
        k = self.pairs[h, w]
        return self.two(k) / self.follow[h] if k else self.alpha.get(h, 1.0) * self.p(w)

    def score(self, text):
        w = tokens(text)
        return sum(math.log10(self.after(h, x)) for h, x in zip(["<s>", *w], w))

    def base(self, text):
        return sum(math.log10((self.c[x] + 0.5) / (self.n + 0.5 * (self.v + 1))) for x in tokens(text))


ROWS = [(i, f"the cat number{i % 7} sat on the mat the cat ran {'and then ' * (i % 3)}it slept") for i in range(40)] + [
    (100, None), (101, ""), (102, "The unseen thing"), (103, "\t\n"), (104, "mat the cat " * 20_000),
    (105, "the cat"), (105, "the cat")]


@pytest.mark.parametrize("size", [1 << 20, 4, 0])
def test_against_plain_counting(spark, size):
    """Whatever the size of the ranked vocabulary; with pairs only of ranked words otherwise."""
    train = F.pmod("doc_id", F.lit(3)) != 1
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in ROWS], SCHEMA)
    got = score_texts(df, train, size=size).collect()
    model = Model([t for d, t in ROWS if d % 3 != 1])
    assert len(got) == len(ROWS)
    texts = dict(ROWS)
    for r in got:
        words = tokens(texts[r["doc_id"]])
        assert r["n_tokens"] == len(words) and r["train_tokens"] == model.n
        assert r["n_known"] == sum(model.c[w] > 0 for w in words)
        assert r["base_score"] == pytest.approx(model.base(texts[r["doc_id"]]))
        assert r["score"] < 0
        if size == 1 << 20:
            assert r["score"] == pytest.approx(model.score(texts[r["doc_id"]]))


@pytest.mark.parametrize("size", [4, 0])
def test_words_without_a_rank_keep_their_pairs(spark, size):
    """The model is the same whatever the number of ranked words."""
    rows = [*ROWS, (106, "cat number3 number5 sat number3 sat slept mat unseen number3"),
            (107, "number3 number5"), (108, "slept and cat")]
    df = spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)
    model = Model([t for d, t in rows if d % 3 != 1])
    texts = dict(rows)
    for r in score_texts(df, F.pmod("doc_id", F.lit(3)) != 1, size=size).collect():
        assert r["score"] == pytest.approx(model.score(texts[r["doc_id"]]))


def test_probabilities_after_each_history_sum_to_one():
    model = Model([t for _, t in ROWS])
    for h in model.follow:
        assert sum(model.after(h, w) for w in [*model.c, "never seen"]) == pytest.approx(1)


def test_nothing_to_learn_from(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    row = score_texts(df, F.lit(False)).first()
    assert (row["n_known"], row["train_tokens"]) == (0, 0) and row["score"] <= 0
    assert score_texts(df.filter("false"), F.lit(True)).collect() == []
