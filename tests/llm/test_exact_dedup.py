import hashlib

from graphloom.llm.exact_dedup import DigestIndex, exact_dedup

SCHEMA = "doc_id bigint, text string, digest string, n string, keep_id int"


def frame(spark, rows):
    return spark.createDataFrame([(d, t, "x", "y", 1) for d, t in rows], SCHEMA)


def test_keeps_the_longest_original(spark):
    rows = [(3, "a b"), (1, "ab"), (2, "a  b"), (4, "a\tb "), (9, None), (8, ""), (7, " \r\n"), (5, "é\xa0"),
            (6, "é\xa0"), (6, "é\xa0"), (10, "x" * 200_000)]
    got = {r["doc_id"]: r for r in exact_dedup(frame(spark, rows)).collect()}
    assert {d: (r["keep_id"], r["group_size"], r["kept"]) for d, r in got.items()} == {
        1: (2, 4, False), 2: (2, 4, True), 3: (2, 4, False), 4: (2, 4, False), 7: (7, 3, True),
        8: (7, 3, False), 9: (7, 3, False), 5: (5, 3, True), 6: (5, 3, False), 10: (10, 1, True)}
    assert got[3]["text_sha256"] == hashlib.sha256(b"ab").hexdigest()
    assert exact_dedup(frame(spark, [])).collect() == []


def test_index_persists_and_appends_only_new_digests(spark, tmp_path):
    path = str(tmp_path / "index")
    index = DigestIndex(spark, path, buckets=4)
    index.add(frame(spark, [(1, "one"), (2, "two"), (3, "o n e")]))
    again = DigestIndex(spark, path, buckets=4)  # as a later session opens it
    assert again.rows().count() == 2
    decided = again.decide(again.add(frame(spark, [(10, "one  "), (11, "three"), (12, "thr ee")])))
    got = {r["doc_id"]: (r["keep_id"], r["kept"]) for r in decided.collect()}
    # What the index had stays, even where a later text is longer.
    assert got == {10: (3, False), 11: (12, False), 12: (12, True)}
    assert again.rows().count() == 3
    plan = again.rows().join(again.rows().hint("merge"), "digest")._jdf.queryExecution().toString()
    assert "Bucketed: true" in plan


def test_main_path_is_native(spark):
    plan = exact_dedup(frame(spark, [(1, "a")]))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
