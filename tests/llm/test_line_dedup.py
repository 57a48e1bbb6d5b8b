import random

from graphloom.llm.line_dedup import LEAST_CHARS, dedup_lines

DOCS = "doc_id bigint, text string, n_lines string, hash string"


def similar(a, b):
    if a == b:
        return True
    if min(len(a), len(b)) < LEAST_CHARS or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    same = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    return a[same + (len(a) == len(b)):] == b[same + 1:]


def brute_force(rows):
    places = sorted((d, k, x.strip(" \t\x0b\x0c\r")) for d, t in rows if t is not None
                    for k, x in enumerate(t.split("\n")))
    gone = {(d, k) for i, (d, k, x) in enumerate(places) if x
            and any(similar(x, y) for e, m, y in places[:i] if (e, m) != (d, k))}
    return {(d, None if t is None else "\n".join(
        x for k, x in enumerate(t.split("\n")) if (d, k) not in gone)) for d, t in rows}


def run(spark, rows):
    df = spark.createDataFrame([(d, t, "x", "y") for d, t in rows], DOCS)
    return dedup_lines(df).collect()


def test_against_brute_force(spark):
    rng = random.Random(5)
    base = ["".join(rng.choice("ab é") for _ in range(rng.choice([1, 8, 15, 16, 17, 30, 60])))
            for _ in range(12)]

    def line():
        x = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2])):
            i = rng.randrange(len(x) + 1)
            x[i:i + rng.choice([0, 1, 1])] = rng.choice(["", "a", "b", "é"])
        return rng.choice(["", " ", "\t"]) + "".join(x) + rng.choice(["", "  ", "\r"])

    rows = [(d, "\n".join(line() for _ in range(rng.randrange(0, 9)))) for d in range(60)]
    got = run(spark, rows)
    assert {(r["doc_id"], r["text"]) for r in got} == brute_force(rows)
    assert any(r["near_dropped"] for r in got)
    for r in got:
        text = dict(rows)[r["doc_id"]]
        assert r["n_lines"] == len(text.split("\n"))
        if r["n_dropped"] < r["n_lines"]:
            assert r["n_lines"] - r["n_dropped"] == len(r["text"].split("\n"))


def test_odd_rows(spark):
    long = "word " * 30_000 + "end"
    rows = [(1, None), (2, ""), (3, "\n\n"), (4, long), (5, long[:70_000] + "x" + long[70_000:]),
            (6, "b"), (7, "b")]
    got = {r["doc_id"]: r["text"] for r in run(spark, rows)}
    assert got == {1: None, 2: "", 3: "\n\n", 4: long, 5: "", 6: "b", 7: ""}
    assert run(spark, []) == []


def test_null_and_repeated_rows(spark):
    got = run(spark, [(1, None), (2, "b"), (2, "b"), (3, "b"), (None, "some other text here")])
    assert sorted(map(str, ((r["doc_id"], r["text"]) for r in got))) == sorted(map(str, [
        (1, None), (2, "b"), (2, "b"), (3, ""), (None, "some other text here")]))
