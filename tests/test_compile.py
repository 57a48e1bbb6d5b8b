"""The whole job on the sample corpus: known counts and invariants."""

import os
import xml.dom.minidom

import pytest
from pyspark.sql import functions as F

from graphloom.operators import check, manifest, refine, search, select, stats
from graphloom.plans.compile import CompileOptions, compile_graph
from graphloom.sinks import exports
from graphloom.sources.api_spec import read_api_spec
from graphloom.sources.corpus import read_fixture_corpus
from graphloom.sources.tables import read_edges_by_to, read_graph, write_graph
from tests.sample import write_sample


@pytest.fixture(scope="module")
def sample(tmp_path_factory):
    return write_sample(str(tmp_path_factory.mktemp("sample")))


def build(spark, sample):
    docs_root, spec = sample
    return compile_graph(spark, read_fixture_corpus(spark, docs_root), read_api_spec(spark, spec),
                         CompileOptions(version="fixture", source_label="fixtures"))


@pytest.fixture(scope="module")
def graph(spark, sample):
    return build(spark, sample)


def test_known_counts(graph):
    nodes = {r["type"]: r["n"] for r in stats.node_type_counts(graph.nodes).collect()}
    assert nodes == {"glossary": 5, "page": 1, "concept": 5, "api_object": 10, "api_path": 5,
                     "role": 16, "controller": 5}
    edges = {r["type"]: r["n"] for r in stats.edge_type_counts(graph.edges).collect()}
    assert edges == {"references": 4, "part_of": 1, "api_for": 1, "related_to": 8, "requires": 3,
                     "controls": 4, "prerequisite_of": 5}


def test_stats_row(graph):
    row = stats.graph_stats(graph.nodes, graph.edges).first()
    assert (row["nodes"], row["edges"], row["pages"], row["roles"]) == (47, 26, 1, 16)
    assert row["graph_density"] == pytest.approx(26 / (47 * 46))
    assert row["edge_types"]["related_to"] == 8 and "owns" not in row["edge_types"]
    assert row["duplicate_removed"] == 0


def test_valid_and_covered(graph):
    assert check.validate(graph.nodes, graph.edges).isEmpty()
    covered = {r["item"]: r["without"] for r in
               check.provenance_coverage(graph.nodes, graph.edges).collect()}
    assert covered == {"nodes": 0, "edges": 0}


def test_no_model_facts_by_default(graph):
    assert stats.ai_count(graph.nodes).first()["ai_nodes"] == 0


def test_page_node(graph):
    page = graph.nodes.filter(F.col("type") == "page").first()
    assert page["id"] == "page:concepts/workloads/run-deployment"
    assert page["title"] == "Deployments"
    assert page["summary"] == "Running replicas and making them reachable."
    assert page["section"] == "concepts" and page["meta"]["weight"] == 20
    assert "[Pods](#gloss:pod)" in page["body"]


def test_reference_evidence(graph):
    refs = graph.edge_evidence.filter(F.col("type") == "references").collect()
    assert {(r["to_id"], r["line_start"]) for r in refs} == {
        ("gloss:deployment", 3), ("gloss:pod", 3), ("gloss:service", 7), ("gloss:ingress", 8)}


def test_flow_self_loop_keeps_all_evidence(graph):
    edge = graph.edges.filter("from_id = 'flow:kubectl' AND to_id = 'flow:kubectl'").first()
    assert edge["n_prov"] == 2
    found = graph.edge_evidence.filter("from_id = 'flow:kubectl' AND to_id = 'flow:kubectl'")
    assert found.count() == 2


def test_domain_tags(graph):
    tags = {r["id"]: r["tags"] for r in graph.nodes.select("id", "tags").collect()}
    assert tags["gloss:service"] == ["networking", "fundamental"]
    assert tags["api:Service"] == ["core", "networking"]
    assert tags["role:roles"] == ["rbac", "rbac.authorization.k8s.io", "security"]
    assert tags["flow:kubelet"] == ["kubectl", "flow"]


def test_hash_is_reproducible(spark, sample, graph):
    first = manifest.graph_hash(graph).first()["ir_hash"]
    assert manifest.graph_hash(build(spark, sample)).first()["ir_hash"] == first
    shuffled = graph.with_(nodes=graph.nodes.repartition(7), edges=graph.edges.repartition(3))
    assert manifest.graph_hash(shuffled).first()["ir_hash"] == first
    fewer = graph.with_(edges=graph.edges.filter("type != 'controls'"))
    assert manifest.graph_hash(fewer).first()["ir_hash"] != first


def test_merge_and_dedupe_are_idempotent(graph):
    again = refine.merge_edges(graph.edges)
    assert sorted(again.collect()) == sorted(graph.edges.select(again.columns).collect())
    twice = refine.dedupe_nodes(graph.nodes.unionByName(graph.nodes))
    assert twice.count() == 47
    assert twice.agg(F.sum("duplicates")).first()[0] == 47


def test_round_trips(spark, graph, tmp_path):
    stored = str(tmp_path / "graph")
    write_graph(graph, stored)
    back = read_graph(spark, stored)
    assert manifest.graph_hash(back).first() == manifest.graph_hash(graph).first()
    assert back.meta == graph.meta
    assert read_edges_by_to(spark, stored).count() == 26
    exported = str(tmp_path / "json")
    exports.write_dataset_json(graph, exported)
    again = read_graph(spark, exported, "json")
    assert manifest.graph_hash(again).first() == manifest.graph_hash(graph).first()


def test_edge_view(spark, graph):
    exports.register_edge_view(graph)
    rows = spark.sql("SELECT from_title, to_title FROM edge_view WHERE type = 'api_for'").collect()
    assert [tuple(r) for r in rows] == [("Deployments", "Deployment")]


def _text(path):
    parts = sorted(p for p in os.listdir(path) if p.startswith("part-"))
    return "".join(open(os.path.join(path, p), encoding="utf-8").read() for p in parts)


def test_gexf_is_well_formed(graph, tmp_path):
    out = str(tmp_path / "gexf")
    exports.write_gexf(graph.nodes, graph.edges, out)
    document = xml.dom.minidom.parseString(_text(out))
    assert len(document.getElementsByTagName("node")) == 47
    assert len(document.getElementsByTagName("edge")) == 26


def test_text_dumps(graph, tmp_path):
    out = str(tmp_path / "dumps")
    exports.write_text_dumps(graph.nodes, graph.node_evidence, out)
    text = _text(f"{out}/type=glossary")
    assert text.startswith("# Kubernetes knowledge — glossary (5 entries)\n\n# Container  [glossary]")
    assert text.count("\n\n---\n\n") == 4
    assert "sources: reference/glossary/pod.md" in text
    concepts = _text(f"{out}/type=concept")
    assert concepts.startswith("# Kubernetes knowledge — concept headings (sample of 5/5)\n\n")


def test_jsonl_and_index(spark, graph, tmp_path):
    exports.write_jsonl(graph.nodes, str(tmp_path / "lines"))
    assert spark.read.json(str(tmp_path / "lines")).count() == 47
    exports.write_search_index(graph.nodes, str(tmp_path / "index"))
    assert spark.read.json(str(tmp_path / "index/count")).first()["count"] == 47
    exports.write_sitemap(graph.nodes, "https://example.test/", str(tmp_path / "map"))
    urls = _text(str(tmp_path / "map")).split()
    assert "https://example.test/docs/gloss-pod/" in urls and len(urls) == 14 + 47


def test_questions(graph):
    related = search.related_to_term(graph.nodes, graph.edges, "deployment").collect()
    assert [r["type"] for r in related] == ["references"]
    depends = search.depends_on(graph.nodes, graph.edges, "Deployment").collect()
    assert [tuple(r) for r in depends] == [("Deployments", "api_for")]
    fallback = search.depends_on(graph.nodes, graph.edges, "DeploymentSpec").collect()
    assert [tuple(r) for r in fallback] == [("Deployment", "related_to")]
    outgoing = search.depends_on(graph.nodes, graph.edges, "pod").collect()
    assert {r["title"] for r in outgoing} == {"ObjectMeta", "PodSpec"}
    roles = search.permissions(graph.nodes).collect()
    assert len(roles) == 16
    assert roles[-1].asDict() == {"id": "role:statefulsets", "title": "permissions:statefulsets",
                                  "api_group": "apps", "verbs": "get,list,watch,create,update,patch"}
    flow = [r["id"] for r in select.flow_listing(graph.nodes).collect()]
    assert flow == ["flow:kubectl", "flow:kube-apiserver",
                    "flow:kube-controller-manager_scheduler", "flow:kubelet"]


def test_keyword_question(spark, graph):
    asked = spark.createDataFrame([(1, "What needs an ingress?"), (2, "Zzz???")],
                                  "question_id INT, question STRING")
    hits = search.keyword_matches(graph.nodes, asked).filter("question_id = 1").collect()
    assert {"gloss:ingress", "role:ingresses"} <= {r["id"] for r in hits}
    walk = search.keyword_walk(graph.nodes, graph.edges, asked).filter("question_id = 1").collect()
    assert [(r["id"], r["other_id"]) for r in walk] == [
        ("gloss:ingress", "page:concepts/workloads/run-deployment")]


def test_manifest(graph, spark, sample):
    docs = read_fixture_corpus(spark, sample[0])
    row = manifest.build_manifest(graph, docs).first()
    assert (row["node_count"], row["edge_count"], row["version"]) == (47, 26, "fixture")
    known = manifest.document_manifest(docs)
    assert not manifest.changed_since(known, docs)
    assert manifest.changed_since(None, docs)
    edited = docs.withColumn("content_hash", F.when(
        F.contains("rel_path", F.lit("pod")), F.lit("x")).otherwise(F.col("content_hash")))
    assert manifest.changed_since(known, edited)
    assert [r["rel_path"] for r in manifest.changed_docs(known, edited).collect()] == [
        "reference/glossary/pod.md"]
