import random

from pyspark.sql import functions as F

from graphloom.llm import quality

SCHEMA = "doc_id bigint, text string, quality int, score double, x string"


def test_learns_from_positives_and_unlabelled_rows(spark):
    rng = random.Random(9)

    def good():
        return ". ".join(" ".join(rng.choice(["the", "house", "is", "green", "and", "old", "we", "saw"])
                                  for _ in range(9)).capitalize() for _ in range(rng.randrange(2, 9))) + "."

    def bad():
        return rng.choice([lambda: " ".join(["SPAM!!"] * 40), lambda: "buy " * 60,
                           lambda: " | ".join(f"item{rng.randrange(99)}" for _ in range(40))])()

    rows = [(i, *((good(), 1) if rng.random() < 0.8 else (bad(), 0))) for i in range(600)]
    rows += [(1000, None, None), (1001, "", None), (1002, good() * 2_000, None)]
    df = spark.createDataFrame([(d, t, q, 0.1, "y") for d, t, q in rows], SCHEMA)
    labels = df.select("doc_id", "quality", F.lit("z").alias("text")).filter("doc_id % 2 = 0")
    model = quality.learn(df.select("doc_id", "text", "x"), labels)
    got = {r["doc_id"]: r["s"] for r in df.select("doc_id", quality.quality_of(
        model, F.col("text"), df).alias("s")).collect()}
    held = [(q, got[d]) for d, _, q in rows if d % 2 and q is not None]
    assert sum((s >= 0.7) == (q == 1) for q, s in held) / len(held) > 0.95
    assert all(0 <= s <= 1 for s in got.values()) and len(got) == len(rows)
    # Bad labels only move the prior: without them the scorer still ranks.
    assert df.filter("false").select(quality.quality_of(model, F.col("text"), df)).collect() == []
    empty = quality.learn(df.filter("false"), labels.filter("false"))
    row = df.limit(1).select(quality.quality_of(empty, F.col("text"), df).alias("s")).first()
    assert row["s"] == 0.5
