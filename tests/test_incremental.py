"""State tables over many batches, and the maintained graph against the batch compile."""

import random

import pytest
from pyspark.sql import types as T

from graphloom.plans.compile import CompileOptions, compile_graph
from graphloom.plans.incremental import IncrementalGraph, graph_stream
from graphloom.sources.api_spec import read_api_spec
from graphloom.sources.corpus import docs_from_texts
from graphloom.sources.state import StateTable
from graphloom.streaming import ingest

LAYOUT = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.LongType())])
TEXTS = "rel_path STRING, text STRING, url STRING, section STRING"
SPEC = ('{"definitions": {"io.x.apps.v1.Widget": {"description": "d"}, '
        '"io.x.v1.Gadget": {"properties": {"w": {"$ref": "#/definitions/io.x.apps.v1.Widget"}}}}, '
        '"paths": {"/apis/apps/v1/widgets": {"get": {"operationId": "list"}}}}')


def table(spark, path, **options):
    return StateTable(spark, str(path), LAYOUT, ["k"], buckets=3, **options)


def put(spark, state, batch, rows, keys):
    state.write(batch, spark.createDataFrame(rows, LAYOUT), spark.createDataFrame([(k,) for k in keys], "k string"))


def rows_of(df):
    return sorted((r["k"], r["v"]) for r in df.collect())


def test_what_a_run_reads_does_not_grow(spark, tmp_path):
    state, want, read = table(spark, tmp_path / "s", most_deltas=4), {}, []
    rng = random.Random(1)
    for batch in range(20):
        keys = {f"k{rng.randrange(30)}" for _ in range(10)}
        fresh = {k: [batch, batch + 100] for k in keys if rng.random() < 0.8}
        put(spark, state, batch, [(k, v) for k, vs in fresh.items() for v in vs], keys)
        want = {k: v for k, v in {**want, **fresh}.items() if k not in keys or k in fresh}
        base, deltas = state.parts()
        names = [*([f"base={base}"] if base is not None else []), *[f"delta={n}" for n in deltas]]
        read.append(sum(spark.read.parquet(f"{tmp_path}/s/rows/{n}").count() for n in names))
        assert len(deltas) < 4
    assert rows_of(state.read()) == sorted((k, v) for k, vs in want.items() for v in vs)
    live = sum(map(len, want.values()))
    assert max(read[10:]) <= 60 + 4 * 20 and len(list((tmp_path / "s/rows").iterdir())) <= 12, (read, live)
    some = spark.createDataFrame([("k3",), ("k4",), ("no",)], "k string")
    assert rows_of(state.read(wanted=some)) == sorted((k, v) for k in ("k3", "k4") for v in want.get(k, []))


@pytest.mark.parametrize("most_deltas", [1, 2, 9])
def test_a_batch_that_runs_again_has_the_same_effect(spark, tmp_path, most_deltas):
    state = table(spark, tmp_path / "s", most_deltas=most_deltas)
    put(spark, state, 0, [("a", 1), ("b", 2)], ["a", "b"])
    put(spark, state, 1, [("a", 3)], ["a", "b"])
    assert rows_of(state.read()) == [("a", 3)]
    put(spark, state, 1, [("b", 9)], ["b"])  # run again with another outcome
    assert rows_of(state.read()) == [("a", 1), ("b", 9)]
    assert rows_of(state.read(before=1)) == [("a", 1), ("b", 2)]
    assert rows_of(table(spark, tmp_path / "none").read()) == []


def page(title, body):
    return f"---\ntitle: {title}\ndescription: about {title}\n---\n{body}"


def term(name):
    return f"---\nid: {name}\ntitle: {name}\nshort_description: {name}.\n---\nBody of {name}.\n"


def uses(*names):
    return " ".join(f'{{{{< glossary_tooltip text="{n}" term_id="{n}" >}}}}' for n in names)


BATCHES = [
    {"a/one.md": page("Widget one", f"{uses('pod', 'late')} [x](/docs/a/two/)\n## Shared\n"),
     "a/two.md": page("two", "## Shared\n### Only two\n[y](/docs/a/three/)"),
     "reference/glossary/pod.md": term("pod")},
    {"reference/glossary/late.md": term("late"), "a/three.md": page("three", uses("pod"))},  # targets come
    {"a/one.md": page("one again", f"{uses('late')} [x](/docs/a/two/)\n## Fresh\n")},  # first use of a heading goes
    {"reference/glossary/pod.md": None, "a/two.md": None, "never.md": None},  # targets go
    {"a/two.md": page("two is back", "## Shared\n"), "a/three.md": page("Gadget", uses("pod", "late"))},
]


def same(got, want):
    for name in ("nodes", "edges", "node_evidence", "edge_evidence"):
        columns = sorted(getattr(got, name).columns)
        a, b = (sorted(map(str, getattr(g, name).select(*columns).collect())) for g in (got, want))
        assert a == b, (name, set(a) ^ set(b))


@pytest.mark.parametrize("with_spec", [True])
def test_maintained_graph_equals_the_batch_compile(spark, tmp_path, with_spec):
    spec = None
    if with_spec:
        (tmp_path / "spec.json").write_text(SPEC)
        spec = read_api_spec(spark, f"{tmp_path}/spec.json")
    opt = CompileOptions(version="v")
    graph = IncrementalGraph(spark, f"{tmp_path}/g", opt, spec, buckets=2, most_deltas=3)
    current = {}
    for batch, texts in enumerate(BATCHES):
        df = spark.createDataFrame([(p, x, None, "a") for p, x in texts.items()], TEXTS)
        changed, paths = ingest.write_batch(df, batch, f"{tmp_path}/docs", buckets=2)
        graph.apply(batch, changed, paths)
        if batch == 2:  # fails after the tables were written, and runs again
            changed, paths = ingest.write_batch(df, batch, f"{tmp_path}/docs", buckets=2)
            graph.apply(batch, changed, paths)
        current = {p: x for p, x in {**current, **texts}.items() if x is not None}
        if batch in (1, 3, 4):
            now = spark.createDataFrame([(p, x, None, "a") for p, x in current.items()], TEXTS)
            same(graph.graph(), compile_graph(spark, docs_from_texts(now), spec, opt))


def test_graph_stream_and_options(spark, tmp_path):
    graph = IncrementalGraph(spark, f"{tmp_path}/g", buckets=2)
    for texts in BATCHES[:2]:
        spark.createDataFrame([(p, x, None, "a") for p, x in texts.items()], TEXTS).write.mode(
            "append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(TEXTS).parquet(f"{tmp_path}/in")
        graph_stream(stream, f"{tmp_path}/docs", f"{tmp_path}/p", graph, buckets=2).awaitTermination()
    now = spark.createDataFrame([(p, x, None, "a") for t in BATCHES[:2] for p, x in t.items()], TEXTS)
    same(graph.graph(), compile_graph(spark, docs_from_texts(now)))
    with pytest.raises(ValueError, match="begin sections"):
        IncrementalGraph(spark, f"{tmp_path}/h", CompileOptions(begin_sections=True))


def test_several_versions_need_an_order(spark, tmp_path):
    df = spark.createDataFrame([("a.md", "x", None, "s"), ("a.md", "y", None, "s")], TEXTS)
    with pytest.raises(Exception, match="column seq"):
        ingest.write_batch(df, 0, f"{tmp_path}/d", buckets=2)
    ordered = spark.createDataFrame([("a.md", "y", None, "s", 1), ("a.md", "x", None, "s", 2)], TEXTS + ", seq int")
    ingest.write_batch(ordered, 0, f"{tmp_path}/d", buckets=2)
    assert [r["body_raw"] for r in ingest.read_latest_docs(spark, f"{tmp_path}/d").collect()] == ["x"]
