"""Walks, checks, pruning, slugs and the model layer on hand-made graphs."""

import json
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom import schema as s
from graphloom.harness.base import as_facts
from graphloom.operators import builders, check, inference, paths, refine, rules, select, stats
from graphloom.schema import Graph
from graphloom.session import checkpoint_dir, release, stage, staged


def nodes_of(spark, rows):
    """Node candidates of (id, type, title, body, tags, quote)."""
    df = spark.createDataFrame(
        [(i, *r) for i, r in enumerate(rows)],
        "i LONG, id STRING, type STRING, title STRING, body STRING, tags ARRAY<STRING>, q STRING")
    return s.node_candidates(
        df, id=F.col("id"), type=F.col("type"), title=F.col("title"), body=F.col("body"),
        tags=F.col("tags"), prov=s.provenance(F.lit("src.md"), quote=F.col("q")),
        ord=s.ordinal(1, s.sortable("i")))


def edges_of(spark, pairs, edge_type="prerequisite_of"):
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i LONG, f STRING, t STRING")
    return as_facts(s.edge_candidates(
        df, from_id=F.col("f"), to_id=F.col("t"), type=F.lit(edge_type),
        prov=s.provenance(F.lit("src.md")), ord=s.ordinal(1, s.sortable("i"))))


DIAMOND = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("d", "d")]


def test_chain_and_levels(spark):
    edges = edges_of(spark, DIAMOND)
    chain = {(r["id"], r["ancestor"]): r["depth"] for r in
             paths.prerequisite_chain(edges, everything(edges)).collect()}
    assert {k: v for k, v in chain.items() if k[0] == "e"} == {
        ("e", "d"): 1, ("e", "b"): 2, ("e", "c"): 2, ("e", "a"): 3}
    levels = {r["id"]: r["level"] for r in paths.learning_levels(edges).collect()}
    assert levels == {"a": 0, "b": 1, "c": 1, "d": 2, "e": 3}


def everything(edges):
    return edges.select(F.col("to_id").alias("id"))


def test_cycles_end_and_share_a_level(spark):
    edges = edges_of(spark, [("a", "b"), ("b", "c"), ("c", "b"), ("c", "d"), ("a", "x")])
    chain = {(r["id"], r["ancestor"]) for r in
             paths.prerequisite_chain(edges, everything(edges)).collect()}
    assert ("b", "b") in chain and ("d", "a") in chain and len(chain) == 10
    levels = {r["id"]: r["level"] for r in paths.learning_levels(edges).collect()}
    assert levels == {"a": 0, "x": 1, "b": 1, "c": 1, "d": 2}


def brute_components(pairs):
    nodes = {x for p in pairs for x in p}
    reach = {n: {n} for n in nodes}
    while True:
        size = sum(map(len, reach.values()))
        for a, b in pairs:
            for n in nodes:
                if a in reach[n]:
                    reach[n].add(b)
        if size == sum(map(len, reach.values())):
            return {n: frozenset(m for m in reach[n] if n in reach[m]) for n in nodes}


@pytest.mark.parametrize("seed", [1, 2])
def test_components_and_levels_of_cyclic_graphs(spark, seed):
    rng = random.Random(seed)
    pairs = list({(f"n{rng.randrange(14)}", f"n{rng.randrange(14)}") for _ in range(16)})
    pairs = [p for p in pairs if p[0] != p[1]] + [("p", "q"), ("q", "n1")]
    want = brute_components(pairs)
    df = spark.createDataFrame(pairs, "src string, dst string")
    groups = {}
    for r in paths.strong_components(df).collect():
        groups.setdefault(r["component"], set()).add(r["id"])
    assert {frozenset(g) for g in groups.values()} == set(want.values())
    assert all(name in members for name, members in groups.items())
    level = dict.fromkeys(want.values(), 0)
    for _ in level:  # longest ways on the condensation
        for a, b in pairs:
            if want[a] != want[b]:
                level[want[b]] = max(level[want[b]], level[want[a]] + 1)
    got = {r["id"]: r["level"] for r in paths.learning_levels(edges_of(spark, pairs)).collect()}
    assert got == {n: level[g] for n, g in want.items()}


def test_paths(spark):
    edges = edges_of(spark, DIAMOND)
    there = paths.path_between(edges, "e", "a").first()
    assert (there["hops"], there["path"]) == (3, ["e", "d", "b", "a"])
    assert paths.path_between(edges, "e", "a", directed=True).isEmpty()
    assert paths.path_between(edges, "a", "e", max_hops=2).isEmpty()
    line = edges_of(spark, [(f"n{i:02}", f"n{i + 1:02}") for i in range(12)])
    trace = []
    assert paths.path_between(line, "n00", "n12", trace=trace).first()["hops"] == 12
    assert len(trace) == 12 and {side for side, _ in trace} == {True, False}


def test_both_ends_search_and_the_smaller_one_expands(spark):
    """A hub's leaves are not expanded, and the smallest of equal paths is found."""
    pairs = [("hub", f"leaf{i}") for i in range(200)] + [("hub", "m1"), ("hub", "m2"), ("m1", "end"), ("m2", "end")]
    trace = []
    found = paths.path_between(edges_of(spark, pairs), "leaf7", "end", trace=trace).first()
    assert (found["hops"], found["path"]) == (3, ["leaf7", "hub", "m1", "end"])
    assert [side for side, _ in trace] == [True, False, True]
    rng = random.Random(3)
    some = list({(f"v{rng.randrange(30):02}", f"v{rng.randrange(30):02}") for _ in range(45)})
    edges = edges_of(spark, some)
    for directed in (True, False):
        want = {r["id"]: (r["hops"], r["path"]) for r in
                paths.shortest_paths_from(edges, "v00", directed=directed).collect()}
        for end in ("v00", "v07", "v19", "none"):
            row = paths.path_between(edges, "v00", end, directed=directed).first()
            assert (row and (row["hops"], row["path"])) == want.get(end)


def test_pruning(spark):
    rows = [("a", "page", "A", "", [], None), ("b", "page", "B", "", [], None),
            ("long", "page", "L", "x" * 41, [], None), ("short", "page", "S", "x" * 40, [], None)]
    candidates = nodes_of(spark, rows)
    nodes = as_facts(candidates)
    edges = refine.drop_dangling_edges(edges_of(spark, [("a", "b"), ("a", "gone")]), nodes)
    assert [(r["from_id"], r["to_id"]) for r in edges.collect()] == [("a", "b")]
    kept = refine.drop_orphans(nodes, edges, refine.node_evidence(candidates))
    assert {r["id"] for r in kept.collect()} == {"a", "b", "long"}


def test_validation_finds_everything(spark):
    rows = [("a", "page", "A", "", [], None), ("a", "page", "A2", "", [], None),
            ("a", "page", "A3", "", [], None), ("b", None, "B", "", [], None)]
    nodes = as_facts(nodes_of(spark, rows)).withColumn(
        "confidence", F.when(F.col("title") == "A", -0.1).otherwise(0.5))
    edges = edges_of(spark, [("a", "b"), ("a", "q"), ("p", "b")]).withColumn(
        "confidence", F.when(F.col("to_id") == "q", 1.1).otherwise(1.0))
    got = {(r["rule"], r["item"]): r["occurrences"] for r in check.validate(nodes, edges).collect()}
    assert got == {
        ("missing_id_or_type", "b"): 1, ("duplicate_node", "a"): 2, ("node_confidence", "a"): 1,
        ("edge_confidence", "a|prerequisite_of|q"): 1,
        ("edge_to_unknown", "a|prerequisite_of|q"): 1,
        ("edge_from_unknown", "p|prerequisite_of|b"): 1}


def test_diff(spark):
    old = spark.createDataFrame([("a", "1"), ("b", None), ("c", "3")], "id STRING, t STRING")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "4")], "id STRING, t STRING")
    got = {r["id"]: r["status"] for r in check.diff(old, new, compare=["t"]).collect()}
    assert got == {"b": "changed", "c": "removed", "d": "added"}


def test_slugs_of_colliding_ids(spark):
    ids = ["x:1", "x/1", "y", "x 1", "x{:}1"]
    nodes = nodes_of(spark, [(i, "page", i, "", [], None) for i in ids])
    got = {r["id"]: r["href"] for r in select.hrefs(nodes).collect()}
    assert got == {"x:1": "/docs/x-1/", "x/1": "/docs/x-1-1/", "y": "/docs/y/",
                   "x 1": "/docs/x-1-2/", "x{:}1": "/docs/x-1-3/"}


def test_rules_on_titles(spark):
    kinds = spark.createDataFrame([("Pod", 3), ("PodSpec", 1), ("Job", 0)], "kind STRING, def_ord INT")
    titles = spark.createDataFrame([("1", "About podspecs and jobs"), ("2", "My POD"), ("3", "x")],
                                   "id STRING, title STRING")
    got = {r["id"]: r["kind"] for r in builders.title_kinds(titles, kinds).collect()}
    assert got == {"1": "Job", "2": "Pod"}
    tagged = rules.tag_by_keywords(as_facts(nodes_of(
        spark, [("a", "page", "ServiceAccount secret", "", ["security"], None)])))
    assert tagged.first()["tags"] == ["security", "networking"]


def test_all_fields_of_a_definition_are_kept(spark):
    spec = json.dumps({"properties": {f"f{i:02}": {} for i in range(60)}})
    rows = spark.createDataFrame([(0, "io.k8s.Big", spec)], "def_ord INT, name STRING, definition STRING")
    meta = builders.api_object_nodes(rows).first()["meta"]
    assert len(meta["fields"]) == meta["field_count"] == 60


def test_degrees_of_self_loop(spark):
    row = stats.degree_counts(edges_of(spark, [("a", "a")])).first()
    assert (row["prerequisites"], row["unlocks"]) == (1, 1)


# -- model layer -------------------------------------------------------------


def one_node_graph(spark, body=""):
    rows = nodes_of(spark, [("gloss:pod", "glossary", "Pod", body, [], "Smallest unit.")])
    return Graph(nodes=as_facts(rows), edges=spark.createDataFrame([], s.EDGES),
                 node_evidence=refine.node_evidence(rows),
                 edge_evidence=spark.createDataFrame([], s.EDGE_EVIDENCE))


def answer(prompt):
    if "id=gloss:pod" not in prompt:
        return "not json"
    return json.dumps({"cards": [{
        "id": "gloss:pod", "overview": "A pod runs containers.", "why_it_matters": "It is the unit.",
        "key_facts": ["one"], "pitfalls": [], "related": ["Node"]}, {"id": "gloss:other"}]})


def test_synthesis_fills_the_body(spark):
    done = inference.model_passes(answer, "m").run(one_node_graph(spark), True, "synthesis")
    row = done.nodes.first()
    assert "Why it matters" in row["body"] and row["summary"] == "A pod runs containers."
    assert (row["derived_by"], row["confidence"]) == ("ai:m", 0.82)


def test_synthesis_skips_long_bodies(spark):
    done = inference.model_passes(answer, "m").run(one_node_graph(spark, "X" * 900), True)
    row = done.nodes.first()
    assert (len(row["body"]), row["derived_by"]) == (900, "deterministic")


def test_every_prompt_is_asked_once(spark, tmp_path):
    """However often the graph is read, and not at all with the answers of an earlier run."""
    log = str(tmp_path / "calls")

    def model(prompt):
        with open(log, "a") as out:
            out.write(repr(prompt) + "\n")
        return answer(prompt)

    def calls():
        with open(log) as lines:
            return list(lines)

    cache = inference.AnswerCache(spark)
    done = inference.model_passes(model, "m", cache=cache).run(one_node_graph(spark), True)
    for _ in range(2):
        done.nodes.collect()
        done.edges.collect()
    assert len(calls()) == len(set(calls())) == 2  # a card and a label; nothing precedes the term
    known = inference.AnswerCache(spark, cache.rows)
    again = inference.model_passes(model, "m", cache=known).run(one_node_graph(spark), True)
    assert again.nodes.first()["derived_by"] == "ai:m" and len(calls()) == 2


def test_bad_answers_change_nothing(spark):
    for bad in (lambda p: None, lambda p: "{", lambda p: '{"cards": [{"id": ""}]}', lambda p: 1 / 0):
        done = inference.model_passes(bad, "m").run(one_node_graph(spark), True)
        assert done.nodes.first()["derived_by"] == "deterministic" and done.edges.isEmpty()


def test_pass_names():
    registry = inference.model_passes(answer, "m")
    assert registry.resolve(False) == []
    assert registry.resolve(True) == ["synthesis", "prerequisites", "clusters"]
    assert registry.resolve(True, "synthesis") == ["synthesis"]
    assert registry.resolve(True, "synthesis, bogus") == ["synthesis"]


def test_batches_follow_the_node_order(spark):
    rows = nodes_of(spark, [(f"n{9 - i}", "page", f"N{i}", "", [], None) for i in range(10)])
    cited = select.with_evidence(as_facts(rows), refine.node_evidence(rows), 3)
    for limit in (None, 4000):
        got = inference.synthesis_batches(cited, "m", 4, limit).orderBy("batch").collect()
        assert [r["size"] for r in got] == [4, 4, 2]
        assert "id=n9\n" in got[0]["prompt"] and "id=n0\n" in got[2]["prompt"]
    assert inference.synthesis_batches(cited, "m", 4, 5).count() == 2


# -- session -----------------------------------------------------------------


class FakeSession:
    """A session as the checkpoint helper sees it."""

    def __init__(self, master, configured=None):
        self.conf = {"spark.checkpoint.dir": configured} if configured else {}
        self.sparkContext = self
        self.master = master
        self.folder = None

    def getCheckpointDir(self):  # noqa: N802
        return self.folder

    def setCheckpointDir(self, folder):  # noqa: N802
        self.folder = folder


def test_checkpoint_folder_comes_from_the_session(spark):
    cluster = FakeSession("yarn", "hdfs:///shared/ckpt")
    assert checkpoint_dir(cluster) == cluster.folder == "hdfs:///shared/ckpt"
    with pytest.raises(ValueError):
        checkpoint_dir(FakeSession("yarn"))
    assert checkpoint_dir(spark) in spark.sparkContext.getCheckpointDir()


def test_staged_tables_can_be_released(spark):
    before = staged()
    df = stage(spark.range(3), "x")
    path = df.inputFiles()[0].removeprefix("file://")
    assert df.count() == 3 and staged() == before + 1
    assert release(spark, before) == before and not os.path.exists(path)


def test_dangling_edges_are_dropped_in_one_scan_of_each_side(spark):
    rows = nodes_of(spark, [(i, "page", i, "", [], None) for i in "ab"])
    edges = edges_of(spark, [("a", "b")]).unionByName(edges_of(spark, [("a", "x")], "owns"))
    kept = refine.drop_dangling_edges(edges, as_facts(rows))
    plan = kept._jdf.queryExecution().optimizedPlan().toString()
    assert kept.count() == 1 and plan.count("parquet") <= 3


def test_unknown_columns_are_refused(spark):
    with pytest.raises(ValueError):
        s.edge_candidates(spark.range(1), from_to=F.lit("x"))


def test_diff_digests_reads_what_differs(spark, tmp_path):
    n = 20_000
    old = spark.range(n).select(F.col("id").cast("string").alias("id"), (F.col("id") % 7).alias("t"))
    changed = F.col("id").isin([str(k) for k in range(0, n, 200)])
    new = old.withColumn("t", F.when(changed, F.lit(None)).otherwise(F.col("t"))).filter("id <> '77'").unionByName(
        spark.createDataFrame([("new", 1)], old.schema))
    one = old.withColumn("t", F.when(F.col("id") == "5", F.lit(99)).otherwise(F.col("t")))
    versions = {"old": old, "new": new, "one": one, "none": old.filter("false")}
    for name, rows in versions.items():
        check.write_digests(rows, f"{tmp_path}/{name}", compare=["t"], folders=16)

    def answers(df):
        return sorted((r["id"], r["status"]) for r in df.collect())

    for a, b in (("old", "new"), ("new", "old"), ("old", "old"), ("old", "none"), ("none", "old"), ("none", "none")):
        got = check.diff_digests(spark, f"{tmp_path}/{a}", f"{tmp_path}/{b}")
        assert answers(got) == answers(check.diff(versions[a], versions[b], compare=["t"]))

    def rows_of(other):
        differing = check.differing_buckets(spark, f"{tmp_path}/old", f"{tmp_path}/{other}")
        return check.rows_to_compare(spark, f"{tmp_path}/old", differing)

    assert rows_of("old").count() == 0
    assert 101 <= rows_of("new").count() <= 300
    assert rows_of("one").count() < 10
    plan = rows_of("one")._jdf.queryExecution().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_folder", plan)
    with pytest.raises(ValueError, match="buckets"):
        check.write_digests(old, f"{tmp_path}/many", folders=1 << 10, buckets=1 << 11)
