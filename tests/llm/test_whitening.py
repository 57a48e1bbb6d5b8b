"""Whitening against numpy on the whole table."""

import math

import numpy as np
import pytest

from graphloom.llm import whitening as wh
from graphloom.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, digest string, x int, n int"
SF_DIR = "/root/testdata/sf0.001"


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "d", 1, 2) for i, v in rows], SCHEMA)


def wanted(rows, components=4, weights="one"):
    """{(vec_id, component)}: values, by one covariance of all distinct vectors."""
    kept = [(i, tuple(math.floor(256 * float(np.float32(c))) for c in v)) for i, v in rows
            if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    distinct = sorted({x for _, x in kept})
    counts = np.array([sum(y == x for _, y in kept) if weights == "counts" else 1 for x in distinct])
    table = np.array(distinct, dtype=np.int64)
    n, sums = int(counts.sum()), (table * counts[:, None]).sum(axis=0)
    y = table - sums / n
    values, vectors = np.linalg.eigh((y * counts[:, None]).T @ y / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = []
    for i, x in kept:
        deviation = sum((n * v - int(s)) ** 2 for v, s in zip(x, sums))
        white = (np.array(x) - sums / n) @ vectors[:, :components] / np.sqrt(values[:components])
        for k in range(min(components, len(values))):
            out.append((i, k + 1, n, deviation, float(white[k]), float(values[k] / values.sum())))
    return out


def check(got, want):
    assert len(got) == len(want)
    key = lambda r: (r[0] is not None, r[0] or 0, r[1], r[3])
    got, want = sorted((tuple(r) for r in got), key=key), sorted(want, key=key)
    for component in {w[1] for w in want}:
        pairs = [(g, w) for g, w in zip(got, want) if w[1] == component]
        sign = np.sign(sum(g[4] * w[4] for g, w in pairs)) or 1
        for g, w in pairs:
            assert g[:4] == w[:4]
            assert g[4] == pytest.approx(sign * w[4], abs=1e-9)
            assert g[5] == pytest.approx(w[5], rel=1e-9)
    assert len({g[6] for g in got}) == 1 and got[0][6] < 1e-9


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(2)
    table = (rng.normal(size=(300, 6)) * [3, 2, 1, .7, .5, .2]).astype(np.float32)
    found = [(i, [float(c) for c in v]) for i, v in enumerate(table)]
    found += [(1000 + i, found[7][1]) for i in range(200)]  # a vector of many rows
    found += [(5, found[5][1]), (None, found[6][1]), (None, found[6][1])]
    found += [(2000, None), (2001, [1.0, None, 1.0, 1.0, 1.0, 1.0]), (2002, [math.nan] * 6),
              (2003, [math.inf, 0.0, 0.0, 0.0, 0.0, 0.0]), (2004, [1.0]), (2005, []),
              (2006, [-0.0, 0.0, -0.001, 0.001, 0.0, 0.0])]
    return found


@pytest.mark.parametrize("weights", ["one", "counts"])
def test_against_numpy(spark, rows, weights):
    got = wh.whitened_rows(frame(spark, rows), weights=weights).collect()
    plain = [(i, v) for i, v in rows if v is None or len(v) == 6]
    check(got, wanted(plain, weights=weights))


def test_copies_do_not_move_the_fit_of_weight_one(spark, rows):
    plain = [(i, v) for i, v in rows if i is not None and i < 300]
    more = plain + [(9000 + k, plain[3][1]) for k in range(500)]
    one, two = (wh.whitened_rows(frame(spark, r)).filter("vec_id = 3").orderBy("component").collect()
                for r in (plain, more))
    assert [r["whitened"] for r in one] == pytest.approx([r["whitened"] for r in two], abs=1e-9)
    assert one[0]["n"] == two[0]["n"]


def test_degenerate_tables(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(1, [1.0, 2.0])] * 5, [(1, [])]):
        assert wh.whitened_rows(frame(spark, rows)).collect() == []
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(10)]  # one direction only
    got = wh.whitened_rows(frame(spark, line)).collect()
    assert len(got) == 10 and {r["component"] for r in got} == {1}
    assert got[0]["explained"] == pytest.approx(1)


def test_large_entries_stay_exact(spark):
    rows = [(i, [float(v), float(-v * 3), 1.0]) for i, v in enumerate([3e15, -5e14, 7e12, 1.0])]
    rows += [(9, [3e38, 0.0, 0.0])]
    got = {r["vec_id"]: r for r in wh.whitened_rows(frame(spark, rows[:4])).filter("component = 1").collect()}
    xs = [[math.floor(256 * float(np.float32(c))) for c in v] for _, v in rows[:4]]
    sums = [sum(c) for c in zip(*xs)]
    for i, x in enumerate(xs):
        exact = sum((4 * v - s) ** 2 for v, s in zip(x, sums))
        assert got[i]["deviation"] == (exact if exact < 1 << 63 else None)
    assert wh.whitened_rows(frame(spark, rows)).count() > 0  # clipped, not a failure


def test_query_against_numpy(spark):
    rows = [(r["vec_id"], r["embedding"]) for r in
            spark.read.parquet(f"{SF_DIR}/embeddings.parquet").collect()]
    df = QUERIES["op12_whitening"](spark, SF_DIR)
    assert dict(df.dtypes) == {
        "vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint",
        "whitened": "double", "explained": "double", "identity_error": "double"}
    check(df.collect(), wanted(rows))
