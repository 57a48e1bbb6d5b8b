"""The registered queries on the smallest tables, and the pipeline by its stages."""

import collections
import hashlib
import os
import zlib

import pytest

import corpus_pipeline
from graphloom.llm.queries import ORACLES, QUERIES
from tests.llm.test_decontaminate import brute_force as leak_brute_force
from tests.llm.test_decontaminate import shingles
from tests.llm.test_near_dedup import brute_force as near_brute_force
from tests.llm.test_packing import fill
from tests.oracle import compare, duck

SF_DIR = os.environ.get("ORACLE_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def con():
    if not os.path.isdir(SF_DIR):
        pytest.skip(f"no test tables in {SF_DIR}")
    return duck(SF_DIR)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, con, name):
    assert compare(name, spark, SF_DIR, con, QUERIES, ORACLES)[0] is None


def test_one_query_per_operator():
    assert [int(name[2:].split("_")[0]) for name in QUERIES] == list(range(1, 14))


def answers(spark, name, types):
    """(documents, answers) by id, one each; the answers' columns have these types."""
    found = QUERIES[name](spark, SF_DIR)
    kinds = dict(found.dtypes)
    assert {c: kinds.get(c) for c in types} == types
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()}
    rows = found.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    return docs, {r["doc_id"]: r for r in rows}


def crc(text):
    return zlib.crc32(text.encode())


def test_op3_contract(spark):
    docs, found = answers(spark, "op3_language_id", {
        "doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"})
    known = {d["lang"] for d in docs.values() if d["lang"] and crc(str(d["doc_id"])) % 4 != 2}
    for i, r in found.items():
        assert r["held_out"] == (crc(str(i)) % 4 == 2) and 0 <= r["score"] <= 1
        lettered = any(c.isalpha() for c in docs[i]["text"] or "")
        assert r["lang_pred"] in known if lettered else r["lang_pred"] == "und"


def test_op7_contract(spark):
    _, found = answers(spark, "op7_quality_pu", {
        "doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"})
    for i, r in found.items():
        assert r["held_out"] == (crc(str(i)) % 4 == 2) and 0 <= r["score"] <= 1
        assert r["predicted"] == (r["score"] >= 0.7)


def test_op8_contract(spark):
    docs, found = answers(spark, "op8_sharding", {
        "doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int",
        "slot": "bigint", "grown_shard": "int"})
    slots = collections.defaultdict(list)
    for i, r in found.items():
        text = docs[i]["text"] or ""
        assert (r["size"], r["text_crc32"]) == (len(text.encode()) + 1, crc(text))
        assert (r["law"], r["grown_shard"]) == ("rows", None)
        slots[r["shard"]].append(r["slot"])
    assert set(slots) == set(range(8))
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    assert all(sorted(s) == list(range(min(s), min(s) + len(s))) for s in slots.values())


def kept_by_brute_force(docs, items):
    """What each stage keeps, by plain Python: ids after the first three, copies after mixing."""
    letters = [r for r in docs if any(c.isalpha() for c in r["text"] or "")]
    component = near_brute_force([(r["doc_id"], r["text"]) for r in letters])
    single = [r for r in letters if component[r["doc_id"]][1] == r["doc_id"]]
    shared = {i: set(shingles(t.lower().split())) for i, t in items}
    leaked = set()
    for r in single:
        own = set(shingles((r["text"] or "").lower().split()))
        some = [(i, t) for i, t in items if shared[i] & own]
        if some and leak_brute_force([(r["doc_id"], r["text"])], some):
            leaked.add(r["doc_id"])
    clean = [r for r in single if r["doc_id"] not in leaked]
    sizes = collections.Counter()
    for r in clean:
        sizes[r["source"]] += len(r["text"].encode().split())
    targets = fill(sizes)
    copies = collections.Counter()
    for r in clean:
        rate = targets[r["source"]] / sizes[r["source"]] if sizes[r["source"]] else 0
        draw = int(hashlib.md5(f"mix-1:{r['doc_id']}".encode()).hexdigest()[:13], 16) / 2 ** 52
        copies[r["doc_id"]] = int(rate) + (draw < rate - int(rate))
    ids = [sorted(r["doc_id"] for r in rows) for rows in (letters, single, clean)]
    return [*ids, sorted(copies.elements()), sorted(copies.elements())]


def test_pipeline_against_brute_force(spark, con, tmp_path):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = docs.columns
    items = con.execute("SELECT item_id, text FROM benchmark").fetchall()
    want = kept_by_brute_force(docs.collect(), items)
    assert len({tuple(ids) for ids in want}) == 4  # near copies, leaks and mixing take effect
    for k, (name, apply) in enumerate(corpus_pipeline.STAGES):
        apply(spark, docs, SF_DIR).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert sorted(r["doc_id"] for r in docs.select("doc_id").collect()) == want[k], name
        last = k == len(corpus_pipeline.STAGES) - 1
        assert docs.columns == columns + (["shard", "slot"] if last else [])
    shards = collections.Counter(r["shard"] for r in docs.collect())
    assert len(shards) == 8 and max(shards.values()) - min(shards.values()) <= 1


def test_pipeline_runs_all_stages(spark, tmp_path):
    spark.createDataFrame(
        [(i, f"some words number {i} of a plain text", "en", f"s{i % 3}", 9) for i in range(12)]
        + [(50, "some words number 3 of a plain text", "en", None, 9), (51, None, None, None, None),
           (52, "12 34", "en", "s1", 5)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint",
    ).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, "some words number 7 of a plain text")], "item_id bigint, text string") \
        .write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in rows} <= set(range(12)) - {7} and rows


def test_stages_keep_columns_with_clashing_names(spark, tmp_path):
    names = ["_source", "_target", "_mix", "_copy", "_key", "_hash", "_leaked", "_found", "_Copy_"]
    docs = spark.createDataFrame(
        [(i, f"some plain words of text number {i} and a few more {i * 7}", "en", f"s{i % 2}", 40,
          *[f"{n}{i}" for n in names]) for i in range(12)],
        "doc_id bigint, text string, lang string, source string, n_chars bigint, "
        + ", ".join(f"{n} string" for n in names))
    spark.createDataFrame([(1, "nothing of it is here at all")], "item_id bigint, text string") \
        .write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, apply in corpus_pipeline.STAGES:
        before = docs
        apply(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns[:len(before.columns)] == before.columns, name
        rows = docs.collect()
        assert rows and all(r[n] == f"{n}{r['doc_id']}" for r in rows for n in names), name
