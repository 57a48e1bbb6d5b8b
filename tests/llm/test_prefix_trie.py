"""The conversation trie against plain Python, and its radix tree."""

import collections
import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from graphloom.llm import prefix_trie as pt
from graphloom.llm.queries import QUERIES
from graphloom.llm.radix import Direct, Indexed, RadixTree, Sorted, shared, summaries

SCHEMA = "conv_id bigint, turn bigint, role string, text string, depth int, path string"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
           "saved_tokens", "ends_sha256"]


def turns_of(rows):
    convs = collections.defaultdict(list)
    for conv, turn, role, text, *_ in rows:
        if conv is not None:
            convs[conv].append((turn is not None, turn or 0, role or "", text or ""))
    return {c: [t[2:] for t in sorted(v)] for c, v in convs.items()}


def rebuild(convs):
    out = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6
        out[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    return out


def brute_force(convs):
    members = collections.defaultdict(list)
    for c, seq in convs.items():
        for d in range(len(seq) + 1):
            members[tuple(seq[:d])].append(c)
    below = collections.defaultdict(list)
    for node in members:
        for d in range(len(node) + 1):
            below[node[:d]].append(node)
    children = collections.Counter(node[:-1] for node in members if node)
    out = []
    for node, found in members.items():
        ends = sorted(c for c in found if len(convs[c]) == len(node))
        out.append((
            min(found), len(node), min(members[node[:-1]]) if node else None, len(found),
            children[node], sum(not children[x] for x in below[node]),
            sum((len(members[x]) - 1) * len(x[-1][1]) for x in below[node] if x),
            hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()))
    return sorted(out, key=repr)


def nodes(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=repr)


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], SCHEMA)


@pytest.mark.parametrize("piece_bytes", [400, 1 << 22])
def test_trie_against_brute_force(spark, monkeypatch, piece_bytes):
    rng = random.Random(5)
    rows = []
    for c in range(250):
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", None]), rng.choice(["a", "b", "long text", "ü", ""])))
    rows += [(1000 + c, 0, "user", "hot") for c in range(300)]  # one sequence of many
    rows += [(2000, t, "user", f"deep {t}") for t in range(300)]
    rows += [(2001, t, "user", f"deep {t}") for t in range(299)]
    rows += [(c, 0, "user", "no head") for c in range(4101, 4120)]
    rows += [(3000, None, None, None), (3000, 2, "b", "y"), (3000, 2, "a", "z"), (None, 1, "a", "b")]
    monkeypatch.setattr(pt, "PIECE_BYTES", piece_bytes)
    lists = pt.turn_lists(frame(spark, rows))
    want = brute_force(turns_of(rows))
    assert nodes(pt.prefix_trie(pt.paths(lists))) == want
    again = brute_force(rebuild(turns_of(rows)))
    assert nodes(pt.prefix_trie(pt.paths(pt.rebuilt(lists)))) == again
    assert any(n[1] == 0 and n[7] != pt.NO_ENDS for n in again)  # turnless ones


def test_last_turns_and_empty_tables(spark):
    rows = [(1, 0, "u", "hi"), (1, 1, "a", "yo"), (2, 0, "u", "hi"), (2, 1, None, "no")]
    df = frame(spark, rows)
    lists = pt.turn_lists(df)
    got = pt.last_turns(pt.prefix_trie(pt.paths(lists)), df, lists)
    assert sorted((r["conv_id"], r["depth"], r["role"] or "", r["text"] or "") for r in got.collect()) == [
        (1, 0, "", ""), (1, 1, "u", "hi"), (1, 2, "a", "yo"), (2, 2, "", "no")]
    assert pt.prefix_trie(pt.paths(pt.turn_lists(df.filter("false")))).collect() == []


def test_query_against_brute_force(spark):
    sf_dir = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select(
        "conv_id", "turn", "role", "text").collect()]
    df = QUERIES["op11_prefix_trie"](spark, sf_dir)
    assert all(kind == ("string" if name == "ends_sha256" else "bigint") for name, kind in df.dtypes)
    assert nodes(df) == brute_force(rebuild(turns_of(rows)))


def test_nodes_grow_through_all_layouts():
    tree, layouts = RadixTree(), []
    for byte in random.Random(1).sample(range(256), 256):
        tree.insert(bytes([byte, 7, 7, 7]), (1, byte))
        layouts.append((type(tree.root.children), tree.root.children.room))
    assert list(dict.fromkeys(layouts)) == [(Sorted, 4), (Sorted, 16), (Indexed, 48), (Direct, 256)]
    assert [b for b, _ in tree.root.pairs()] == list(range(256))
    assert tree.walk(bytes([9, 7, 7, 7]))[-1].ends == (1, 9)


def test_only_aligned_depths_are_reported():
    tree = RadixTree()
    for i, key in enumerate([b"aaab", b"aaac", b"aaacdddd", b""]):  # items of two bytes
        tree.insert(key, (1, i))
    rows = summaries(tree, 2, lambda item: item[1], lambda node, d: True, lambda node, d: False)
    assert sorted((r[0], r[2], r[3], r[4], r[5]) for r in rows) == [
        (0, 4, 0, 1, 2), (1, 3, 0, 2, 2), (2, 1, 0, 0, 1), (2, 2, 1, 1, 1), (3, 1, 2, 1, 1), (4, 1, 2, 0, 1)]
    assert shared(b"abc" * 9, b"abc" * 8 + b"abd") == 26 and shared(b"", b"a") == 0


def test_hot_sequence_spans_pieces(spark):
    df = frame(spark, [(c, 0, "u", "same") for c in range(4000)])
    keys = pt.paths(pt.turn_lists(df)).repartitionByRange(4, "path", "conv_id")
    sizes = [r["n"] for r in keys.groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
    assert max(sizes) < 2000
