import random

from pyspark.sql import functions as F

from graphloom.llm.decontaminate import (
    RADIUS, blocks_of, decontaminate, leaks, neighbour_blocks)

DOCS = "doc_id bigint, text string, item_id string, size string, words string"


def shingles(words, k=5):
    words = words + [""] * (k - len(words)) if words else []
    return [tuple(words[i:i + k]) for i in range(len(words) - k + 1)]


def brute_force(docs, items, k=5, least=0.8):
    """All windows of all texts against all items."""
    sets = {i: set(shingles((t or "").lower().split())) for i, t in items}
    owners = {}
    for i, s in sets.items():
        for x in s:
            owners.setdefault(x, set()).add(i)
    found = {}
    for d, t in docs:
        words = (t or "").lower().split()
        words += [""] * (k - len(words)) if words else []
        for i, text in items:
            size = max(len((text or "").split()), k) if (text or "").split() else 0
            for s in range(-size + k, len(words) - k + 1) if size else ():
                window = set(shingles(words[max(s, 0):s + size]))
                common = window & sets[i]
                weight = lambda xs: sum(1 / len(owners[x]) for x in xs)
                more = len(window) - len(common)
                value = max(weight(common) / (weight(sets[i]) + more),
                            len(common) / (len(sets[i]) + more))
                if common and value >= least - 1e-9:
                    found[d, i] = max(found.get((d, i), 0), value)
    return found


def fixture():
    rng = random.Random(3)
    word = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choice(word) for _ in range(rng.randrange(12, 40)))) for i in range(12)]
    items += [(50, items[0][1]), (51, "short one"), (52, ""), (53, None)]
    docs = []
    for d in range(60):
        text = [rng.choice(word) for _ in range(rng.randrange(0, 60))]
        if d % 3 == 0:
            passage = rng.choice(items[:12])[1].split()
            if d % 2:
                passage[rng.randrange(len(passage))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = passage
        docs.append((d, rng.choice([" ", "\n", "\t"]).join(text).upper() if d % 5 == 0 else " ".join(text)))
    docs += [(100, None), (101, ""), (102, "Short  ONE"), (103, items[1][1]), (103, items[1][1]),
             (104, " ".join(word * 2_000) + " " + items[2][1])]
    return docs, items


def test_against_brute_force(spark):
    docs, items = fixture()
    df = spark.createDataFrame([(d, t, "x", "y", "z") for d, t in docs], DOCS)
    bench = spark.createDataFrame([(i, t, "q") for i, t in items], "item_id bigint, text string, size string")
    got = {(r["doc_id"], r["item_id"]): r["similarity"] for r in leaks(df, bench).collect()}
    want = brute_force([d for d in docs if d[0] != 104], items)
    assert set(want) <= set(got) | {k for k, v in want.items() if v < 0.9}
    assert len(set(want) & set(got)) >= 0.95 * len(want)
    assert all(k in want or k[0] == 104 for k in got)
    assert (104, 2) in got and (102, 51) in got
    kept = {r["doc_id"] for r in decontaminate(df, bench).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in got}
    assert decontaminate(df, bench).columns == df.columns
    plan = leaks(df, bench)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def signed(bits):
    return bits - (1 << 64) if bits >> 63 else bits


def test_index_finds_all_within_the_radius(spark):
    """Against all pairs, with 0 to 20 bits flipped, spread evenly over the blocks or not."""
    rng = random.Random(11)
    items = [rng.getrandbits(64) for _ in range(30)]
    probes = [rng.getrandbits(64) for _ in range(200)]
    for flips in range(21):
        for spread in (True, False):
            bits = ([16 * (i % 4) + i // 4 for i in range(flips)] if spread
                    else rng.sample(range(64), flips))
            probes.append(rng.choice(items) ^ sum(1 << b for b in bits))
    left = spark.createDataFrame([(i, signed(p)) for i, p in enumerate(probes)], "p bigint, f bigint")
    right = spark.createDataFrame([(i, signed(p)) for i, p in enumerate(items)], "i bigint, g bigint")
    met = left.withColumn("block", F.explode(blocks_of(F.col("f")))).join(
        right.withColumn("block", F.explode(neighbour_blocks(F.col("g"), RADIUS))), "block")
    met = met.select("p", "i", F.bit_count(F.col("f").bitwiseXOR(F.col("g"))).alias("distance")).distinct()
    got = {(r["p"], r["i"]): r["distance"] for r in met.collect()}
    every = {(p, i): (x ^ y).bit_count() for p, x in enumerate(probes) for i, y in enumerate(items)}
    assert {k for k, d in every.items() if d <= RADIUS} == {k for k, d in got.items() if d <= RADIUS}
    assert all(every[k] == d for k, d in got.items())
    assert len(got) < 0.15 * len(every)  # unrelated fingerprints rarely meet


def test_an_edited_copy_of_a_repeated_item(spark):
    """One word of 60 changed leaves 51 of 61 shingles, however often the item is repeated."""
    item = [f"w{i}" for i in range(60)]
    text = " ".join([*"some words before".split(), *item[:30], "changed", *item[31:], "after"])
    df = spark.createDataFrame([(1, text, "x", "y", "z")], DOCS)
    for copies in (1, 2, 10):
        bench = spark.createDataFrame([(i, " ".join(item)) for i in range(copies)],
                                      "item_id bigint, text string")
        got = {r["item_id"]: round(r["similarity"], 4) for r in leaks(df, bench).collect()}
        assert got == {i: round(51 / 61, 4) for i in range(copies)}
        assert decontaminate(df, bench).collect() == []


def test_empty_tables(spark):
    df = spark.createDataFrame([], DOCS)
    bench = spark.createDataFrame([(1, "a b c d e f")], "item_id bigint, text string")
    some = spark.createDataFrame([(1, "a b c d e f", "", "", "")], DOCS)
    assert leaks(df, bench).collect() == [] and leaks(some, bench.filter("false")).collect() == []
    assert [r["item_id"] for r in leaks(some, bench).collect()] == [1]
