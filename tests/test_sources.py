"""Readers on real files, and the stream over them."""

import os

from pyspark.sql import functions as F

from graphloom.operators import builders
from graphloom.sources.api_spec import read_api_spec, spec_definitions, spec_operations
from graphloom.sources.corpus import read_fixture_corpus, read_markdown_corpus
from graphloom.streaming import ingest
from tests.sample import write_sample


def put(root, rel, text, newline=""):
    path = os.path.join(root, rel)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w", encoding="utf-8", newline=newline) as f:
        f.write(text)


def test_markdown_corpus(spark, tmp_path):
    root = str(tmp_path / "my docs")
    put(root, "tasks/a+b c%20.md", "---\ntitle: A\n---\r\nbody\r\n")
    put(root, "contribute/x.md", "no")
    put(root, "tasks/y.txt", "no")
    put(root, "top.md", "\n")
    rows = {r["rel_path"]: r for r in read_markdown_corpus(spark, root).collect()}
    assert set(rows) == {"tasks/a+b c%20.md", "top.md"}
    one = rows["tasks/a+b c%20.md"]
    assert (one["front_matter"], one["body_raw"]) == ("title: A", "body\n")
    assert one["section"] == "tasks" and rows["top.md"]["section"] == "top.md"
    assert one["url"] == "https://kubernetes.io/docs/tasks/a+b c%20/"
    assert read_fixture_corpus(spark, root).filter("url IS NULL").count() == 3


def test_api_spec(spark, tmp_path):
    _, spec_path = write_sample(str(tmp_path))
    spec = read_api_spec(spark, spec_path)
    definitions = spec_definitions(spec).orderBy("def_ord").collect()
    assert [d["name"].rsplit(".", 1)[1] for d in definitions][:3] == [
        "Deployment", "DeploymentSpec", "Pod"]
    paths = builders.api_paths(spec_operations(spec))
    got = {r["id"]: r["tag"] for r in paths.collect()}
    assert len(got) == 5
    assert got["apipath:post /apis/apps/v1/namespaces/{namespace}/deployments"] == "apps"
    literal = builders.api_paths(spec_operations(spec), literal_group_tag=True)
    assert {r["tag"] for r in literal.collect()} == {"apis", "core"}
    nodes = builders.api_path_nodes(paths).filter(F.col("title").startswith("get "))
    assert nodes.first()["title"] == "get /api/v1/namespaces/{namespace}/pods"


def test_missing_spec_gives_no_rows(spark, tmp_path):
    assert read_api_spec(spark, str(tmp_path / "none.json")).isEmpty()
    assert read_api_spec(spark, None).isEmpty()


def test_stream_ingests_only_changes(spark, tmp_path):
    root, out, progress = (str(tmp_path / n) for n in ("in", "out", "progress"))
    put(root, "a/one.md", "1")
    put(root, "a/two.md", "2")

    def run():
        ingest.ingest_stream(ingest.markdown_stream(spark, root), out, progress).awaitTermination()
        rows = ingest.read_latest_docs(spark, out)
        return {r["rel_path"]: r["body_raw"] for r in rows.collect()}

    assert run() == {"a/one.md": "1", "a/two.md": "2"}
    put(root, "a/three.md", "3")
    assert run() == {"a/one.md": "1", "a/two.md": "2", "a/three.md": "3"}
    assert ingest.docs_table(spark, out).parts() == (None, [0, 1])


def test_sync_carries_rewritten_and_deleted_files(spark, tmp_path):
    root, out = str(tmp_path / "in"), str(tmp_path / "out")

    def run():
        batch = ingest.sync_corpus(spark, root, out)
        rows = ingest.read_latest_docs(spark, out).collect()
        return batch, {r["rel_path"]: r["body_raw"] for r in rows}

    put(root, "a/one.md", "1")
    put(root, "a/two.md", "2")
    put(root, "three.md", "3")
    assert run() == (0, {"a/one.md": "1", "a/two.md": "2", "three.md": "3"})
    put(root, "a/one.md", "1 again")
    os.remove(f"{root}/a/two.md")
    assert run() == (1, {"a/one.md": "1 again", "three.md": "3"})
    assert spark.read.parquet(f"{out}/docs/rows/delta=1").count() == 1
    put(root, "a/two.md", "2")
    os.utime(f"{root}/a/two.md", (1e9, 1e9))  # moved in with an old time
    assert run() == (2, {"a/one.md": "1 again", "a/two.md": "2", "three.md": "3"})


def test_a_replayed_batch_has_one_effect(spark, tmp_path):
    out = str(tmp_path / "out")
    layout = "rel_path STRING, text STRING, url STRING, section STRING, seq INT"
    first = spark.createDataFrame([("a", "1", None, "s", 1), ("b", "2", None, "s", 1)], layout)
    second = spark.createDataFrame(
        [("a", "1", None, "s", 1), ("b", "3", None, "s", 1), ("b", "4", None, "s", 2)], layout)
    ingest.write_batch(first, 0, out)
    for _ in range(3):
        ingest.write_batch(second, 1, out)
    assert {r["rel_path"]: r["body_raw"] for r in ingest.read_latest_docs(spark, out).collect()} == {
        "a": "1", "b": "4"}
    assert sum(spark.read.parquet(f"{out}/docs/rows/delta={n}").count() for n in (0, 1)) == 3
    assert ingest.read_manifest(spark, out).count() == 2
