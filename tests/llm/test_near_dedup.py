import random

import pytest

from graphloom.llm.graph import components
from graphloom.llm import near_dedup
from graphloom.llm.near_dedup import near_groups

SCHEMA = "doc_id bigint, text string, component_id string, node int, a string"


def sets(text, words=2):
    w = (text or "").encode().lower().split()
    if 0 < len(w) < words:
        return {tuple(w)}
    return set(zip(*(w[i:] for i in range(words))))


def brute_force(rows):
    """(n_shingles, component) per id, by union-find over all pairs."""
    parent = {d: d for d, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    known = [(d, sets(t)) for d, t in rows]
    for i, (d, x) in enumerate(known):
        for e, y in known[:i]:
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                a, b = sorted((find(d), find(e)))
                parent[b] = a
    return {d: (len(x), find(d)) for d, x in known}


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", 1, "y") for d, t in rows], SCHEMA)
    return near_groups(df).collect()


def test_against_brute_force(spark):
    rng = random.Random(11)
    word = [f"w{i}" for i in range(400)]
    rows = []
    for _ in range(6):  # groups from two to many copies, some far from each other
        base = [rng.choice(word) for _ in range(rng.choice([12, 60, 150]))]
        for _ in range(rng.choice([2, 5, 60])):
            copy = [rng.choice(word) if rng.random() < rng.choice([0, 0.02, 0.05]) else x for x in base]
            rows.append(" ".join(copy))
    passage = [rng.choice(word) for _ in range(60)]  # shared by many documents that are not copies
    rows += [" ".join(passage + [rng.choice(word) for _ in range(40)]) for _ in range(40)]
    rows += [" ".join(rng.choice(word) for _ in range(30)) for _ in range(20)]
    rows += ["", " \t\n", None, "One", "one ", "ONE TWO", "one\x0btwo", "one two"]
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = brute_force(rows)
    got = {r["doc_id"]: r for r in run(spark, rows)}
    assert {d: (r["n_shingles"], r["component_id"]) for d, r in got.items()} == want
    assert all(r["kept"] == (d == r["component_id"]) for d, r in got.items())


def test_pairs_among_many_that_are_nearly_similar(spark):
    """A template leaves all pairs at about 0.73; planted ones are just above 0.8."""
    rng = random.Random(5)
    template = [f"t{i}" for i in range(170)]
    rows = []
    for k in range(300):
        own = [f"u{k}x{i}" for i in range(30)]
        rows.append(" ".join(template + own))
        if k % 6 == 0:
            same = rng.randint(10, 12)
            rows.append(" ".join(template + own[:same] + [f"v{k}x{i}" for i in range(30 - same)]))
    rng.shuffle(rows)
    rows = list(enumerate(rows))
    want = brute_force(rows)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in run(spark, rows)}
    missed = sum(got[d] != want[d] for d in want)
    assert missed == 0, f"{missed} of {sum(c != d for d, (_, c) in want.items())} pairs missed"


def template_pairs(spark, n):
    """Candidate pairs, each with its joined rows, of n documents of one template."""
    rng = random.Random(n)
    sets = []
    for k in range(n):
        own = [rng.getrandbits(62) for _ in range(30)]
        sets.append((2 * k, sorted([*range(170), *own])))
        if k % 6 == 0:
            near = own[:20] + [rng.getrandbits(62) for _ in range(10)]
            sets.append((2 * k + 1, sorted([*range(170), *near])))
    df = spark.createDataFrame(sets, "node bigint, members array<bigint>")
    none = spark.createDataFrame([], "node bigint, component bigint")
    return near_dedup.crowded_pairs(df, none, 80).collect(), dict(sets)


def test_joined_rows_of_a_template_grow_with_its_documents(spark):
    rows = {}
    for n in (300, 600):
        pairs, sets = template_pairs(spark, n)
        rows[n] = sum(r["weight"] for r in pairs)
        found = {(r["a"], r["b"]) for r in pairs}
        assert {(2 * k, 2 * k + 1) for k in range(0, n, 6)} <= found  # 190 of 210
        assert len(found) <= 2 * n  # and hardly any other pair
    assert rows[600] <= 2.5 * rows[300]


@pytest.mark.parametrize("percent", [50, 80, 95])
def test_positions_lose_no_similar_pair(spark, percent):
    rng = random.Random(percent)
    sets = []
    for k in range(60):
        base = rng.sample(range(400), rng.randint(3, 60))
        for _ in range(4):
            some = [x for x in base if rng.random() > rng.choice([0, 0.03, 0.1])]
            some += rng.sample(range(400), rng.choice([0, 0, 1, 3]))
            sets.append((len(sets), sorted(set(some)) or [k]))
    df = spark.createDataFrame(sets, "node bigint, members array<bigint>")
    none = spark.createDataFrame([], "node bigint, component bigint")
    found = {(r["a"], r["b"]) for r in near_dedup.crowded_pairs(df, none, percent).collect()}
    similar = {(a, b) for a, x in sets for b, y in sets if a < b
               and 100 * len({*x} & {*y}) >= percent * len({*x} | {*y})}
    assert similar and not similar - found


def test_odd_rows(spark):
    long = " ".join(f"x{i}" for i in range(50_000))
    rows = [(5, long), (4, long + " end"), (7, "same text here"), (7, "same text here"), (9, None),
            (8, "same text here")]
    got = sorted((r["doc_id"], r["component_id"], r["kept"]) for r in run(spark, rows))
    assert got == [(4, 4, True), (5, 4, False), (7, 7, True), (7, 7, True), (8, 7, False), (9, 9, True)]
    assert run(spark, []) == []


def test_components_of_a_chain_and_a_hub(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "a bigint, b bigint")).collect()))
    assert got == {**{i: 0 for i in range(41)}, **{i: 100 for i in range(100, 160)}}
