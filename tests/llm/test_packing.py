"""Sharding and mixing."""

import collections

from graphloom.llm.mixing import mix, source_targets, with_copies
from graphloom.llm.sharding import shard

SCHEMA = "doc_id bigint, text string, source string, shard string, n string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], SCHEMA)


def test_shards_match_the_mixture(spark):
    rows = [(i, f"t{i}", "hot" if i % 3 else ("cold" if i % 2 else None)) for i in range(400)]
    rows += [(5, "t5", "hot")] * 7 + [(500, None, "hot"), (None, "t", None), (None, "", None)]
    df = frame(spark, rows)
    got = shard(df, shards=8).collect()
    assert sorted(df.columns) == sorted(c for c in shard(df).columns if c != "slot")
    assert collections.Counter((r["doc_id"], r["text"], r["source"]) for r in got) == collections.Counter(rows)
    by_shard = collections.defaultdict(list)
    for r in got:
        by_shard[r["shard"]].append(r)
    assert sorted(by_shard) == list(range(8))
    sizes = {len(v) for v in by_shard.values()}
    assert max(sizes) - min(sizes) <= 1
    for part in by_shard.values():
        assert sorted(r["slot"] for r in part) == list(range(len(part)))
    for source, n in collections.Counter(r[2] for r in rows).items():
        for part in by_shard.values():
            assert abs(sum(r["source"] == source for r in part) - n / 8) <= 2
    again = {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in shard(df).collect()}
    assert again == {(r["doc_id"], r["text"], r["shard"], r["slot"]) for r in got}
    assert shard(df.filter("false")).collect() == []


def fill(sizes, most=3):
    """Targets by the stated rule, one round after the other."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, fixed, open_ = sum(sizes.values()), {}, set(names)
    while open_:
        rest = total - sum(fixed.values())
        share = {s: rest * weight[s] / sum(weight[t] for t in open_) for s in open_}
        over = {s for s in open_ if share[s] > most * sizes[s]}
        if not over:
            return {**fixed, **share}
        fixed |= {s: most * sizes[s] for s in over}
        open_ -= over
    return fixed


def test_targets_follow_the_rule(spark):
    for sizes in ({"a": 900, "b": 5, "c": 40, "d": 0, None: 55}, {"a": 10}, {None: 3, "é": 1000, "z": 1},
                  {f"s{i}": (i * i * 37) % 101 for i in range(30)}):
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size bigint")
        got = {r["source"]: r["target"] for r in source_targets(df).collect()}
        want = fill(sizes)
        assert got.keys() == want.keys()
        assert all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_copies(spark):
    rows = [(i, "w " * (i % 9 + 1), "big" if i % 4 else "small") for i in range(2_000)]
    rows += [(9_000, None, "big"), (9_001, "", None), (9_002, "x", None), (9_002, "x", None)]
    df = frame(spark, rows)
    got = with_copies(df).collect()
    taken, target = collections.Counter(), {}
    for r in got:
        m = r["_mix"]
        assert 0 <= m["copies"] <= 3 and m["size"] == len((r["text"] or "").split())
        taken[r["source"]] += m["size"] * m["copies"]
        target[r["source"]] = m["target"]
    assert all(abs(taken[s] - t) <= 0.1 * t + 3 for s, t in target.items())
    mixed = mix(df).collect()
    assert collections.Counter((r["doc_id"], r["text"]) for r in mixed) == sum(
        (collections.Counter({(r["doc_id"], r["text"]): r["_mix"]["copies"]}) for r in got), collections.Counter())
    assert mix(df).columns == df.columns and mix(df.filter("false")).collect() == []
    plan = mix(df)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
