"""What a task holds and what is shuffled or written does not outgrow the tables."""

import glob
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from graphloom import schema as s
from graphloom import session
from graphloom.harness import storage_queries
from graphloom.operators import matching, rules, skew
from graphloom.schema import Graph
from graphloom.sinks.exports import write_dataset_json
from graphloom.sources import corpus, listing
from graphloom.sources.api_spec import read_api_spec
from graphloom.sources.state import StateTable
from graphloom.sources.tables import read_edges_by_to, read_graph, write_graph
from graphloom.streaming import ingest

TEXTS = "rel_path STRING, text STRING, url STRING, section STRING"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_shuffles_begin_with_many_partitions(spark):
    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    parts = re.findall(r"hashpartitioning\([^)]*, (\d+)\)", plan(
        spark.range(10).groupBy((F.col("id") % 3).alias("k")).count()))
    assert parts and int(parts[0]) >= 256 > few


def test_few_rules_shuffle_no_text(spark):
    nodes = spark.createDataFrame(
        [(1, "Red rod", None, ["x", "red"]), (2, None, "a rod", []), (3, "none", "", None), (1, "Red rod", None, ["x", "red"])],
        "id INT, title STRING, summary STRING, tags ARRAY<STRING>")
    table = spark.createDataFrame(
        [("late", 9, "rod"), ("late", 2, "ro"), ("red", 1, "red"), ("mid", 3, "od"), ("null", None, "rod"),
         ("late", None, "rod"), (None, 1, "rod"), ("all", 1, "")], "domain STRING, rank INT, keyword STRING")
    tagged = rules.tag_by_rules(nodes, table)
    assert "Exchange hashpartitioning" not in plan(tagged)  # the list of rules alone is gathered
    got = sorted((r["id"], r["tags"]) for r in tagged.collect() if r["id"] != 3)
    assert got == [(1, ["x", "red", "null", "late", "mid"])] * 2 + [(2, ["null", "late", "mid"])]
    assert [r["tags"] for r in tagged.collect() if r["id"] == 3] == [None]


def test_many_rules_are_grouped_by_digests(spark):
    nodes = spark.createDataFrame([(i, f"title {i % 7}", None, ["own"]) for i in range(20)],
                                  "id INT, title STRING, summary STRING, tags ARRAY<STRING>")
    table = spark.createDataFrame([(f"d{k}", k, f"title {k}") for k in range(1500)],
                                  "domain STRING, rank INT, keyword STRING")
    tagged = rules.tag_by_rules(nodes, table)
    assert not re.search(r"Exchange hashpartitioning\(_text", plan(tagged))
    assert sorted((r["id"], r["tags"]) for r in tagged.collect()) == [
        (i, ["own", f"d{i % 7}"]) for i in range(20)]


def test_single_deliveries_and_first_batches_move_no_text_twice(spark, tmp_path):
    rows = [(f"p{i}", f"text {i}", None, "s") for i in range(9)] + [(None, "no path", None, "s")]
    texts = spark.createDataFrame(rows, TEXTS)
    assert "Exchange" not in plan(ingest.one_per_path(texts))
    out = str(tmp_path / "out")
    for batch in range(3):
        changed, keys = ingest.write_batch(texts, batch, out, buckets=2)
        # A document without a path is never known.
        assert changed.count() == keys.count() == (10 if batch == 0 else 1)
    twice = texts.union(texts)
    assert ingest.one_per_path(twice).count() == 10
    differ = texts.withColumn("text", F.lit("other")).union(texts).filter("rel_path IS NOT NULL")
    with pytest.raises(Exception, match="several versions"):
        ingest.one_per_path(differ).collect()


def test_the_oldest_part_of_a_state_is_read_without_a_join(spark, tmp_path):
    layout = spark.createDataFrame([], "k STRING, v INT").schema
    table = StateTable(spark, str(tmp_path / "t"), layout, ["k"], buckets=2)
    for batch, rows in enumerate([[("a", 1), ("a", 2), ("b", 3), (None, 4)], [("a", 5)], [("b", 6), ("a", 7)]]):
        df = spark.createDataFrame(rows, layout)
        table.write(batch, df, df.select("k"))
        if batch == 0:
            assert "Join" not in plan(table.read())
    assert sorted(map(tuple, table.read().collect()), key=str) == [("a", 7), ("b", 6), (None, 4)]
    assert sorted(map(tuple, table.read(before=2).collect()), key=str) == [("a", 5), ("b", 3), (None, 4)]


@pytest.fixture
def small_graph(spark):
    def empty(layout):
        return spark.createDataFrame([], layout)

    edges = spark.range(40).select(
        F.concat(F.lit("a"), F.col("id").cast("string")).alias("from_id"), F.lit("b").alias("to_id"),
        F.lit("t").alias("type"), F.expr("uuid()").alias("label"))
    for field in s.EDGES.fields:
        if field.name not in edges.columns:
            edges = edges.withColumn(field.name, F.lit(None).cast(field.dataType))
    return Graph(nodes=empty(s.NODES), edges=edges.select(*s.EDGES.fieldNames()),
                 node_evidence=empty(s.NODE_EVIDENCE), edge_evidence=empty(s.EDGE_EVIDENCE), meta={"version": "1"})


def test_edges_are_computed_once_for_both_copies(spark, small_graph, tmp_path):
    path = str(tmp_path / "g")
    write_graph(small_graph, path)

    def labels(df):
        return sorted((r["from_id"], r["label"]) for r in df.collect())

    assert labels(read_graph(spark, path).edges) == labels(read_edges_by_to(spark, path))
    write_graph(small_graph, path, mode="append")
    assert read_edges_by_to(spark, path).count() == read_graph(spark, path).edges.count() == 80


def test_json_lines_are_compressed(spark, small_graph, tmp_path):
    path = str(tmp_path / "j")
    write_dataset_json(small_graph, path)
    assert glob.glob(f"{path}/edges/*.json.gz") and not glob.glob(f"{path}/edges/*.json")
    assert read_graph(spark, path, "json").edges.count() == 40


@pytest.mark.parametrize("few_left", [4_000, 0])
def test_patterns_with_an_absent_gram_are_ruled_out(spark, monkeypatch, few_left):
    monkeypatch.setattr(skew, "FEW_LEFT", few_left)
    texts = ["the red rod", "é😀 the", None, "", "a", "the red rod"]
    patterns = ["the", "red rod", "a", "😀 t", "é", "the", "thered", None, ""] + [f"customer#{i}" for i in range(1500)]
    left = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    right = spark.createDataFrame(list(enumerate(patterns)), "j INT, p STRING")
    got = sorted((r["i"], r["j"]) for r in skew.substring_pairs(left, "t", right, "p").collect())
    assert got == sorted((i, j) for i, x in enumerate(texts) for j, p in enumerate(patterns) if x and p and p in x)
    some = right.filter("p <> ''").select(F.col("p").alias("_pattern")).distinct()
    assert skew.possible_patterns(left, "t", some, 4).count() < 20


def test_small_files_are_read_without_a_configuration_each(spark, tmp_path):
    texts = {"a/one 1+%.md": b"line\r\nnext\rlast\n", "b/deep/two.md": b"\xef\xbb\xbfmark \xff\xfe \xc3\xa9",
             "three.md": b"", "a/four.txt": b"other"}
    for name, data in texts.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)

    def files():
        return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md")

    bytes_of = F.col("value").cast("binary").alias("value")
    read = corpus.whole_texts(files(), str(tmp_path)).select(bytes_of)
    plain = files().text(str(tmp_path), wholetext=True).select(bytes_of)
    assert sorted(bytes(r["value"]) for r in read.collect()) == sorted(bytes(r["value"]) for r in plain.collect())
    docs = corpus.read_fixture_corpus(spark, str(tmp_path))
    assert "FileScan binaryFile" in plan(docs) and "FileScan text" not in plan(docs)
    assert sorted(r["rel_path"] for r in docs.collect()) == ["a/one 1+%.md", "b/deep/two.md"]
    (tmp_path / "spec.json").write_text('{"definitions": {"x.K": {"a": 1}}, "paths": {}}')
    spec = read_api_spec(spark, str(tmp_path / "spec.json"))
    assert "FileScan binaryFile" in plan(spec) and spec.first()["definitions"] == {"x.K": '{"a":1}'}


def test_many_small_files_share_tasks(spark):
    assert int(spark.conf.get("spark.sql.files.maxPartitionNum")) <= 1 << 13


@pytest.mark.parametrize(("piece", "table"), [(1 << 17, 1 << 22), (16, 1)])
def test_many_patterns_are_found_in_one_reading(monkeypatch, piece, table):
    monkeypatch.setattr(matching, "PIECE", piece)
    monkeypatch.setattr(matching, "TABLE", table)
    long = "0123456789" * 60
    texts = [None, "", "the red rod", "é😀 the", f"x{long}y{long[:-1]}", "aab" * 30, "customer#000000012 x", "od", "t"]
    names = ["the", "e red", "red rod", "é😀", "😀 t", "a", "aab" * 30, "ba" * 9, long, long + "y", long[:-1] + "1", "rodé",
             "01234567", "012345678", "1234567890123456", "customer#000000012", "customer#000000012 x", "customer#00000001x"]
    found = matching.Patterns(pa.array(names))
    again = matching.Patterns.of(found.tables())
    want = [[i for i, name in enumerate(names) if name in (x or "")] for x in texts]
    for column in (pa.array(texts), pa.array(["the", *texts], pa.large_string()).slice(1)):
        assert found.within(column).to_pylist() == again.within(column).to_pylist() == want
    assert matching.Patterns(pa.array([], pa.string())).within(pa.array(["a"])).to_pylist() == [[]]


@pytest.mark.parametrize("ruled_out_from", [0, 200_000])
def test_more_patterns_than_four_thousand_are_found_in_place(spark, monkeypatch, ruled_out_from):
    monkeypatch.setattr(skew, "RULED_OUT_FROM", ruled_out_from)
    monkeypatch.setattr(skew, "FEW_LEFT", 2_500)
    texts = [" ".join(f"w{k}x" for k in range(i, 5000, 50)) for i in range(40)] + [None, "", "none"]
    patterns = [f"w{k}x" for k in range(5000)] + ["x w", "w7x", None, ""]
    left = spark.createDataFrame(list(enumerate(texts)), "i INT, t STRING")
    right = spark.createDataFrame(list(enumerate(patterns)), "j INT, p STRING")
    pairs = skew.substring_pairs(left, "t", right, "p")
    # Read in place, in rounds, and not by an index of grams.
    assert plan(pairs).count("ArrowEvalPython") >= 2 and "gram-index" not in plan(pairs)
    got = sorted((r["i"], r["j"]) for r in pairs.collect())
    assert got == sorted((i, j) for i, x in enumerate(texts) for j, p in enumerate(patterns) if x and p and p in x)


def test_stored_edges_send_the_best_place_only_where_it_differs(spark, small_graph, tmp_path):
    def place(n):
        return F.struct(F.lit(5).alias("phase"), F.concat(F.lit("d"), n.cast("string")).alias("doc"),
                        n.cast("bigint").alias("pos"))

    n = F.substring("from_id", 2, 9).cast("int")
    edges = small_graph.edges.withColumns({
        "ord": F.when(n % 5 > 0, place(n)),
        "best_ord": F.when(n % 3 == 0, place(n)).when(n % 3 == 1, place(n + 1))}).select(*s.EDGES.fieldNames())
    before = {key: spark.conf.get(key, None) for key in (session.SPLIT, session.CLEANUP)}
    write_graph(small_graph.with_(edges=edges), str(tmp_path / "g"))
    assert {key: spark.conf.get(key, None) for key in before} == before
    want = sorted(map(str, edges.drop("label").collect()))
    for found in (read_graph(spark, str(tmp_path / "g")).edges, read_edges_by_to(spark, str(tmp_path / "g"))):
        assert sorted(map(str, found.drop("label").collect())) == want
    assert glob.glob(f"{tmp_path}/g/edges/*.zstd.parquet") and glob.glob(f"{tmp_path}/g/edges_by_to/*.zstd.parquet")


def test_tasks_are_small_while_tables_are_sorted(spark):
    before = spark.conf.get(session.SPLIT)
    with pytest.raises(KeyError), session.sorting(spark):
        assert session.bytes_of(spark.conf.get(session.SPLIT)) == 8 << 20
        raise KeyError
    assert spark.conf.get(session.SPLIT) == before


def test_order_lines_of_a_stored_graph_are_shuffled_once(spark, tmp_path):
    tables = {
        "region": [(0, "r")], "nation": [(0, "n", 0)], "customer": [(0, "c", 0, "m")], "orders": [(0, 0, "p")],
        "supplier": [(0, "s", 0)], "part": [(0, "p", "t", "b")],
        "lineitem": [(0, 0, 0, 1, 2.0, 0.1, "A", "F"), (0, 0, 0, 2, 3.0, None, "B", "O"), (1, 0, 0, 1, 4.0, 0.0, "C", "F"),
                     (None, None, 0, None, 5.0, 0.0, None, None)]}
    layouts = {
        "region": "r_regionkey LONG, r_name STRING", "nation": "n_nationkey LONG, n_name STRING, n_regionkey LONG",
        "customer": "c_custkey LONG, c_name STRING, c_nationkey LONG, c_mktsegment STRING",
        "orders": "o_orderkey LONG, o_custkey LONG, o_orderpriority STRING",
        "supplier": "s_suppkey LONG, s_name STRING, s_nationkey LONG",
        "part": "p_partkey LONG, p_name STRING, p_type STRING, p_brand STRING",
        "lineitem": "l_orderkey LONG, l_partkey LONG, l_suppkey LONG, l_linenumber INT, l_quantity DOUBLE,"
                    " l_discount DOUBLE, l_returnflag STRING, l_linestatus STRING"}
    for name, rows in tables.items():
        spark.createDataFrame(rows, layouts[name]).write.parquet(f"{tmp_path}/{name}.parquet")
    graph = storage_queries._entity_graph(spark, str(tmp_path))
    assert "Exchange" not in plan(graph.edge_evidence) and graph.edge_evidence.count() == 4
    merged = graph.edges.filter("type = 'related_to'")
    # Shuffled by key alone; what is kept of a key holds the order it was chosen by once.
    assert plan(merged).count("Exchange") == 1 and "min_by" not in plan(merged)
    found = {(r["from_id"], r["to_id"]): (r["label"], r["weight"], r["confidence"], r["derived_by"], r["n_prov"],
                                          r["ord"] and r["ord"]["pos"], r["best_ord"]["pos"]) for r in merged.collect()}
    assert found == {("part:0", "supplier:0"): ("A", 2.0, 1.0, "line:O", 3, 1, 2),
                     (None, "supplier:0"): (None, 5.0, 1.0, None, 1, None, None)}


@pytest.mark.parametrize("many", [0, 10_000])
def test_folders_of_very_many_files_are_listed_and_read_by_tasks(spark, tmp_path, monkeypatch, many):
    monkeypatch.setattr(listing, "MANY_FILES", many)
    monkeypatch.setattr(listing, "_BATCH_BYTES", 8)
    monkeypatch.setattr(listing, "_BATCH_ROWS", 3)
    root = tmp_path / "my docs"
    texts = {"a/one 1+%.md": b"line\r\nnext\rlast\n", "b/deep/er/two é.md": b"\xef\xbb\xbfmark \xff\xfe \xc3\xa9", "top.md": b"x",
             "zero.md": b"", "a/four.txt": b"other", "_hidden/five.md": b"5", ".hidden/six.md": b"6", "a/.seven.md": b"7",
             "a/_eight.md": b"8", "_k=v/nine.md": b"9", "contribute/ten.md": b"10", "a/eleven.md._COPYING_": b"11",
             "folder.md/twelve.md": b"12", **{f"many/n{i}.md": b"%d" % i for i in range(20)}}
    for name, data in texts.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_bytes(data)
    (root / "empty").mkdir()
    docs = corpus.read_fixture_corpus(spark, str(root))
    assert ("FileScan binaryFile" in plan(docs)) == (many > 0)
    # The same rows as Spark's own listing gives.
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.md")
    plain = corpus.docs_from_texts(corpus.markdown_texts(corpus.whole_texts(files, str(root)), str(root)).withColumn(
        "url", F.lit(None).cast("string")))
    assert docs.schema == plain.schema
    rows = sorted(map(str, docs.collect()))
    assert rows == sorted(map(str, plain.collect())) and len(rows) == 26
    public = corpus.read_markdown_corpus(spark, f"file://{root}")
    assert public.count() == 25 and "contribute" not in {r["section"] for r in public.collect()}
    # Patterns and stores that only Spark reads are left to it.
    assert listing.folder_of(spark, f"{root}/a*") is listing.folder_of(spark, f"{root}/none") is None
    assert corpus.read_fixture_corpus(spark, str(root / "[ab]")).select("content_hash").count() == 2
