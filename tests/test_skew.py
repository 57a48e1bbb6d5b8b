"""Building blocks on inputs where one key holds a third of the rows and more."""

import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom import seeds, session
from graphloom.harness import base
from graphloom.operators import refine, select, skew
from graphloom.operators.search import keyword_walk


@pytest.fixture(scope="module")
def hot(spark):
    """3,000 rows, half of them with key 0."""
    rng = random.Random(7)
    rows = [(0 if i % 2 else rng.randrange(1, 200), i, f"v{rng.randrange(50)}") for i in
            range(3000)]
    rng.shuffle(rows)
    return rows, spark.createDataFrame(rows, "k INT, o LONG, v STRING").repartition(6)


@pytest.mark.parametrize("partitions", [1, 3, 16])
def test_exact_rank(hot, partitions):
    rows, df = hot
    got = {(r["k"], r["o"]): r["rank"] for r in
           skew.exact_rank(df, ["k"], ["o"], partitions=partitions).collect()}
    seen = {}
    for k, o, _ in sorted(rows):
        seen[k] = seen.get(k, 0) + 1
        assert got[(k, o)] == seen[k]
    assert len(got) == len(rows)


def test_exact_rank_over_everything(hot):
    rows, df = hot
    ranks = sorted((r["o"], r["rank"]) for r in skew.exact_rank(df, [], ["o"]).collect())
    assert ranks == [(o, o + 1) for o in range(len(rows))]


@pytest.mark.parametrize("width", [1, 7, 400, 10_000])
def test_previous_in_order(hot, width):
    rows, df = hot
    got = {r["o"]: r["p"] for r in skew.previous_in_order(
        df, ["k"], F.col("o"), F.floor(F.col("o") / width), "v", "p").collect()}
    last = {}
    for k, o, v in sorted(rows, key=lambda r: r[1]):
        assert got[o] == last.get(k)
        last[k] = v


@pytest.mark.parametrize("partitions", [1, 5, 40])
def test_lag_in_order_with_a_hot_key_and_repeated_steps(spark, partitions):
    """One key has nine tenths of the rows; a step occurs several times, values may be null."""
    rows = [(None if i % 10 else i % 7, i // 3, None if i % 5 == 0 else f"v{i % 4}") for i in range(900)]
    df = spark.createDataFrame(rows, "k INT, o INT, v STRING")
    got = sorted(map(tuple, skew.lag_in_order(df, ["k"], ["o"], "v", "p", partitions).collect()), key=str)
    want, last = [], {}
    for k, o, v in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or "")):
        want.append((k, o, v, last.get(k)))
        last[k] = v
    assert got == sorted(want, key=str)
    pieces = df.repartitionByRange(partitions, "k", "o", "v").withColumn("p", F.spark_partition_id())
    if partitions == 40:
        assert max(r["count"] for r in pieces.groupBy("p").count().collect()) < 900 / 8


@pytest.mark.parametrize("salts", [None, 1, 5])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_skewed_join(spark, hot, how, salts):
    _, df = hot
    dim = spark.createDataFrame([(k, f"d{k}") for k in range(0, 150)], "k INT, d STRING")
    got = skew.skewed_join(df, dim, "k", how, salts, ["o"])
    want = df.join(dim, "k", how)
    assert sorted(got.select(want.columns).collect(), key=str) == sorted(
        want.collect(), key=str)


def test_top_per_group_cuts_before_the_shuffle(hot):
    _, df = hot
    top = skew.top_per_group(df, ["k"], [F.asc("o")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2
    assert top.filter("k = 0").count() == 3


def test_few_groups_are_ranked_by_many_tasks(spark):
    df = spark.range(4000, numPartitions=64).select(F.lit("one").alias("k"), (F.col("id") * 7919 % 4000).alias("o"))
    plain = skew.top_per_group(df, ["k"], [F.asc("o")], 20).collect()
    salted = skew.top_per_group(df, ["k"], [F.asc("o")], 20, salts=8)
    assert sorted(salted.collect()) == sorted(plain) == [("one", i, i + 1) for i in range(20)]
    # 64 tasks send 20 rows each; the last exchange carries 20 rows of each of 8 salts.
    inner = salted._jdf.queryExecution().executedPlan().toString()
    assert inner.count("WindowGroupLimit") >= 4


def test_substring_pairs_against_brute_force(spark):
    rng = random.Random(3)
    letters = "abcd "
    texts = [(i, "".join(rng.choice(letters) for _ in range(rng.randrange(0, 30)))) for i in
             range(120)]
    patterns = sorted({"".join(rng.choice(letters) for _ in range(rng.randrange(1, 7)))
                       for _ in range(80)} | {"abcdabcdabcd", texts[5][1], texts[7][1]} - {""})
    left = spark.createDataFrame(texts, "i INT, t STRING")
    right = spark.createDataFrame([(p,) for p in patterns], "p STRING")
    want = {(i, p) for i, t in texts for p in patterns if p in t}
    for how in ((1_000,), (5, 4), (5, 2)):
        got = [(r["i"], r["p"]) for r in
               skew.substring_pairs(left, "t", right, "p", *how).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_only_proven_small_sides_are_broadcast(spark, hot):
    _, df = hot
    assert skew.row_bound(seeds.ownership(spark)) == 10
    assert skew.row_bound(df.limit(5)) == 5
    assert skew.row_bound(df.repartition(2)) is None


def test_spread_leaves_large_inputs_alone(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(1000).coalesce(1).write.parquet(path)
    df = spark.read.parquet(path)
    assert skew.spread(df).rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1b")
    try:
        assert skew.spread(df) is df
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def _edges(spark, rows):
    return spark.createDataFrame(
        rows, "from_id STRING, to_id STRING, type STRING, label STRING, weight DOUBLE, "
        "confidence DOUBLE, derived_by STRING, prov STRUCT<source: STRING>, "
        "ord STRUCT<phase: INT, doc: STRING, pos: LONG>")


def test_merge_against_a_sequential_merge(spark):
    rng = random.Random(11)
    rows = []
    for i in range(2000):
        key = ("hub", "x", "t") if i % 3 == 0 else (
            f"a{rng.randrange(20)}", f"b{rng.randrange(5)}", "t")
        prov = ("s",) if rng.random() < 0.8 else None
        rows.append((*key, f"l{i}", float(i), round(rng.random(), 1), f"d{i}", prov,
                     (1, f"{i:05}", 0)))
    want = {}
    for f, t_, ty, label, weight, conf, by, prov, _ in rows:
        if (f, t_, ty) not in want:
            want[(f, t_, ty)] = [label, weight, conf, by, 0]
        entry = want[(f, t_, ty)]
        if conf > entry[2]:
            entry[2:4] = [conf, by]
        entry[4] += prov is not None
    shuffled = rows[:]
    rng.shuffle(shuffled)
    df = _edges(spark, shuffled).repartition(7)
    got = {(r["from_id"], r["to_id"], r["type"]): [
        r["label"], r["weight"], r["confidence"], r["derived_by"], r["n_prov"]]
        for r in refine.merge_edges(df).collect()}
    assert got == want
    assert refine.edge_evidence(df).count() == sum(e[4] for e in want.values())
    # Merging is associative: three random parts, merged one by one, come to the same.
    part = F.pmod(F.xxhash64("label"), F.lit(3))
    merged = [refine.merge_edges(df.filter(part == i)) for i in range(3)]
    twice = refine.merge_edges(refine.merge_edges(merged[2].unionByName(merged[0])).unionByName(
        merged[1]))
    assert {(r["from_id"], r["to_id"], r["type"]): [
        r["label"], r["weight"], r["confidence"], r["derived_by"], r["n_prov"]]
        for r in twice.collect()} == want


def test_related_topk_of_a_hub(spark):
    rows = [("hub", f"n{i:04}", "t", "", 1.0, (i % 10) / 10, "d", None, (1, "", i))
            for i in range(500)] + [("hub", "hub", "t", "", 1.0, 0.95, "d", None, (1, "", 500))]
    top = select.related_topk(_edges(spark, rows), 25).filter("id = 'hub'").collect()
    assert len(top) == 25
    ordered = sorted(top, key=lambda r: r["rank"])
    # The self-loop is seen from both ends.
    assert [(r["other_id"], r["direction"]) for r in ordered[:2]] == [("hub", "in"), ("hub", "out")]
    assert [r["confidence"] for r in ordered[2:]] == [0.9] * 23


def test_many_questions_share_one_hub(spark):
    nodes = spark.createDataFrame(
        [("hub", "page", "Central", "", "s"), ("x", "page", "Other", "", "s")]
        + [(f"n{i:03}", "concept", f"N{i}", "", "s") for i in range(60)],
        "id STRING, type STRING, title STRING, summary STRING, section STRING")
    edges = _edges(spark, [("hub", f"n{i:03}", "t", "", 1.0, 1.0, "d", None, (1, "", i))
                           for i in range(60)])
    asked = spark.createDataFrame([(i, "central") for i in range(40)],
                                  "question_id INT, question STRING")
    walk = keyword_walk(nodes, edges, asked).collect()
    assert len(walk) == 40 * 25 and {r["hit_title"] for r in walk} == {"Central"}


def test_hot_partitions_are_split_at_run_time(spark):
    """With thresholds scaled down to the test's size, AQE splits the hot key."""
    options = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "20KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20KB",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {name: spark.conf.get(name, None) for name in options}
    for name, setting in options.items():
        spark.conf.set(name, setting)
    try:
        key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id"))
        fact = spark.range(0, 150_000, 1, 8).select(key.alias("k"), F.col("id").alias("o"))
        dim = spark.range(0, 150_000, 1, 8).select(
            F.col("id").alias("k"), (F.col("id") * 2).alias("d")).filter("d >= 0")
        for how in ("inner", "left_semi", "left_anti"):
            joined = skew.skewed_join(fact, dim, "k", how)
            assert len(joined.collect()) == (0 if how == "left_anti" else 150_000)
            assert "skew=true" in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        for name, setting in before.items():
            if setting is None:
                spark.conf.unset(name)
            else:
                spark.conf.set(name, setting)


def test_many_patterns_through_the_gram_index(spark):
    rng = random.Random(4)
    texts = ["".join(rng.choice("abc é") for _ in range(rng.randint(0, 120))) for _ in range(60)]
    texts += [texts[0], None, "", "hot " * 50]
    patterns = list({t[i:i + n] for t in texts if t for i in range(0, 100, 9) for n in (1, 3, 4, 9)} - {""})
    patterns += [f"absent{i}" for i in range(2000 - len(patterns))] + ["", None, texts[3], texts[3]]
    assert len(patterns) >= 2000
    left = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    right = spark.createDataFrame(list(enumerate(patterns)), "j INT, p STRING")
    got = sorted((r["i"], r["j"]) for r in skew.substring_pairs(left, "t", right, "p").collect())
    assert got == sorted((i, j) for i, t in enumerate(texts) for j, p in enumerate(patterns)
                         if t is not None and p and p in t)


def test_exploded_grams_carry_no_text(spark):
    left = spark.createDataFrame([(1, "a text")], "i INT, t STRING")
    grams = spark.createDataFrame([("a te",)], "_gram STRING")
    plan = skew.gram_index(left, "t", grams, [4])._jdf.queryExecution().optimizedPlan().toString()
    lines = plan.splitlines()
    at = next(i for i, x in enumerate(lines) if "Generate explode(_grams" in x)
    assert re.search(r"explode\(_grams#\d+\), \[1\]", lines[at]), lines[at]  # drops the list
    above = "\n".join(lines[:at + 1])
    assert "md5" not in above and not re.search(r"\bt#", above), above


def test_order_lines_are_dealt_out_by_their_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(base, "LINE_BYTES", 1 << 12, raising=False)
    lines = spark.range(20_000).select(
        F.col("id").alias("l_orderkey"), (F.xxhash64("id") % 997).alias("l_partkey"),
        (F.xxhash64("id") % 89).alias("l_suppkey"), F.lit(1).alias("l_linenumber"),
        (F.rand(1) * 50).alias("l_quantity"), F.rand(2).alias("l_discount"),
        F.lit("N").alias("l_returnflag"), F.lit("O").alias("l_linestatus"))
    lines.coalesce(1).write.parquet(f"{tmp_path}/lineitem.parquet")
    found = base.supply_candidates(base.Tables(spark, str(tmp_path)))
    assert found.rdd.getNumPartitions() > 2 * spark.sparkContext.defaultParallelism
    assert found.count() == 20_000


def test_shuffled_partitions_are_put_together_up_to_a_size_that_sorts_in_memory(spark):
    before = spark.conf.get(session.ADVISORY)
    try:
        spark.conf.set(session.ADVISORY, "64m")
        session.configure(spark)
        assert session.bytes_of(spark.conf.get(session.ADVISORY)) == 16 << 20
        spark.conf.set(session.ADVISORY, "8m")
        session.configure(spark)
        assert spark.conf.get(session.ADVISORY) == "8m"
    finally:
        spark.conf.set(session.ADVISORY, before)
