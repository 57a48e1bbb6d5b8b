"""The trie of conversations that share their first turns, by adaptive radix trees.

A turn is known by 20 bytes, big-endian: the MD5 of role and text, then the text's length in
code points. A conversation is the string of its turns, and every distinct string of first
turns is a node of the trie. Strings are range-partitioned in byte order together with their
conversation's id, so a sequence that a third of all conversations have spans many pieces.
Each task builds an adaptive radix tree (:mod:`graphloom.llm.radix`) of its piece, of about
``PIECE_BYTES``, and walks it once; only turn-aligned byte depths become nodes.

A node lies in several pieces only if it is a prefix of the last string of one piece and of
the first string of the next. The length of those common prefixes, one number per pair of
neighbouring pieces, tells each task which of its nodes are whole; all measures are sums over
pieces, so the others, at most the depth of two strings per piece, are added up by key.

Defined cases: turns of a conversation are ordered by number, null first, then by role and the
turn's digest; a null role or text is empty; rows without a conversation id are left out; an
empty table has no node; other columns are ignored. A conversation is one row of the key table
(20 bytes a turn), as a document is one row of its table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import broadcast_if_small
from graphloom.llm.radix import RadixTree, shared, summaries
from graphloom.session import checkpoint, stage

WIDTH = 20
PIECE_BYTES = 4 << 20
NO_ENDS = hashlib.sha256(b"").hexdigest()

#: What a task says of a node; ``digest`` is set for nodes that other pieces share, and
#: ``parent_digest`` where the parent is such a node.
PARTS = ("digest binary, parent_digest binary, piece int, conv_id bigint, depth bigint, "
         "parent_conv_id bigint, n_convs bigint, n_children bigint, n_leaves bigint, "
         "saved_tokens decimal(38,0), ends_sha256 string, ends string")


def turn_key(role: Column, text: Column) -> Column:
    """The fixed-width id of a turn; the role's length keeps role and text apart."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    framed = F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)
    return F.concat(F.unhex(F.md5(framed)), F.unhex(F.lpad(F.hex(F.char_length(text)), 8, "0")))


def turn_lists(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn",
               role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turns): the turn ids of every conversation in order. Texts stay in place."""
    rows = turns.select(
        F.col(f"`{conv_id}`").alias("conv_id"), F.col(f"`{turn}`").alias("turn"),
        F.coalesce(F.col(f"`{role}`"), F.lit("")).alias("role"),
        turn_key(F.col(f"`{role}`"), F.col(f"`{text}`")).alias("id"),
    ).filter(F.col("conv_id").isNotNull())
    return rows.groupBy("conv_id").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "id"))).getField("id").alias("turns"))


def paths(lists: DataFrame) -> DataFrame:
    """(conv_id, path): the turn ids in one byte string."""
    joined = F.array_join(F.transform("turns", F.hex), "")
    return lists.select("conv_id", F.unhex(joined).alias("path"))


def prefix_trie(keys: DataFrame) -> DataFrame:
    """All nodes of the trie of (conv_id, path).

    conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves,
    saved_tokens (code points that copies of shared turns take), ends_sha256 (of the ids of
    the conversations that are this sequence). A node's turns are the first ``depth`` turns
    of conversation ``conv_id``.
    """
    spark = keys.sparkSession
    size = keys.agg(F.sum(F.octet_length("path") + 16)).first()[0]
    if size is None:
        return spark.createDataFrame([], (
            "conv_id bigint, depth bigint, parent_conv_id bigint, n_convs bigint, n_children bigint, "
            "n_leaves bigint, saved_tokens bigint, ends_sha256 string"))
    pieces = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1 + size // PIECE_BYTES)
    dealt = checkpoint(keys.select("path", F.col("conv_id").cast("bigint")).repartitionByRange(
        pieces, "path", "conv_id").sortWithinPartitions("path", "conv_id"))
    parts = stage(dealt.mapInArrow(piece_nodes(borders(dealt)), PARTS), "trie-parts")
    joint = stage(parts.filter(F.col("digest").isNotNull()).repartition("digest").sortWithinPartitions(
        "digest", "piece").mapInArrow(add_up, PARTS), "trie-joint")
    nodes = parts.filter(F.col("digest").isNull()).union(joint)
    top = joint.select(F.col("digest").alias("parent_digest"), F.col("conv_id").alias("above"))
    below = nodes.filter(F.col("parent_digest").isNotNull()).join(
        broadcast_if_small(top), "parent_digest", "left").withColumn("parent_conv_id", F.col("above"))
    whole = nodes.filter(F.col("parent_digest").isNull())
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves",
               F.col("saved_tokens").cast("bigint").alias("saved_tokens"), "ends_sha256"]
    return whole.select(*columns).union(below.select(*columns))


def borders(dealt: DataFrame) -> dict[int, tuple[int, int]]:
    """For each piece with rows: the turns that its first string shares with the string before
    and its last one with the string after, -1 where there is none. One pair per piece."""
    ends = dealt.groupBy(F.spark_partition_id().alias("piece")).agg(
        F.min("path").alias("first"), F.max("path").alias("last"))
    # One row per piece.
    after = ends.select("piece", "last", F.lead("first").over(Window.orderBy("piece")).alias("next"))

    @F.pandas_udf("long")
    def common(last, following):
        return last.combine(following, lambda a, b: -1 if b is None else shared(a, b) // WIDTH)

    found = after.select("piece", common("last", "next").alias("common")).orderBy("piece").collect()
    out, before = {}, -1
    for row in found:
        out[row["piece"]] = (before, row["common"])
        before = row["common"]
    return out


def piece_nodes(known: dict[int, tuple[int, int]]):
    """The task that turns one piece into its nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, keys = RadixTree(), []
        for path, ids in sequences(batches):
            keys.append(path)
            tree.insert(path, (len(ids), ids[0], ",".join(map(str, ids))))
        if not keys:
            return
        piece = TaskContext.get().partitionId()
        before, after = known[piece]
        shares = {}  # (tree node, depth) to the digest of the prefix
        on_first = set(map(id, tree.walk(keys[0])))
        on_last = set(map(id, tree.walk(keys[-1])))

        def shared_by(node, depth: int) -> bool:
            return id(node) in on_first and depth <= before or id(node) in on_last and depth <= after

        rows, nodes = [], []

        def begins(node, depth):
            nodes.append((node, depth))
            return not (id(node) in on_first and depth <= before)

        rows = summaries(tree, WIDTH, lambda item: int.from_bytes(item[-4:], "big"), begins,
                         lambda node, depth: id(node) in on_last and depth <= after)
        digests = {0: prefix_digests(keys[0], before), 1: prefix_digests(keys[-1], after)}
        shares = [digests[id(n) not in on_first or d > before][d] if shared_by(n, d) else None
                  for n, d in nodes]
        yield from batches_of(rows, shares, piece)

    return run


def sequences(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[bytes, list[int]]]:
    """Each distinct path of sorted rows with its conversations in order."""
    path, ids = None, []
    for batch in batches:
        for p, i in zip(batch.column("path").to_pylist(), batch.column("conv_id").to_pylist()):
            if p != path:
                if ids:
                    yield path, ids
                path, ids = p, []
            ids.append(i)
    if ids:
        yield path, ids


def prefix_digests(path: bytes, depth: int) -> list[bytes]:
    """Digests of the first 0 to ``depth`` turns."""
    running, out = hashlib.sha256(), []
    for d in range(depth + 1):
        if d:
            running.update(path[(d - 1) * WIDTH:d * WIDTH])
        out.append(running.digest())
    return out


def batches_of(rows: list, shares: list, piece: int, size: int = 10_000) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([
        ("digest", pa.binary()), ("parent_digest", pa.binary()), ("piece", pa.int32()),
        ("conv_id", pa.int64()), ("depth", pa.int64()), ("parent_conv_id", pa.int64()),
        ("n_convs", pa.int64()), ("n_children", pa.int64()), ("n_leaves", pa.int64()),
        ("saved_tokens", pa.decimal128(38, 0)), ("ends_sha256", pa.string()), ("ends", pa.string())])
    for i in range(0, len(rows), size):
        out = []
        for k in range(i, min(i + size, len(rows))):
            depth, ends, count, least, children, leaves, total, parent, _ = rows[k]
            above = shares[parent] if parent is not None else None
            listed = ends[2] if ends else None
            out.append((
                shares[k], above, piece, least, depth,
                rows[parent][3] if parent is not None and above is None else None,
                count, children, leaves, total,
                None if shares[k] else hashlib.sha256(listed.encode()).hexdigest() if listed else NO_ENDS,
                listed if shares[k] else None))
        yield pa.record_batch([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per digest from its parts, sorted by digest and piece; the members that end at
    the node are hashed as they come."""
    now, running, empty = None, None, True

    def closed() -> pa.RecordBatch:
        now["ends_sha256"] = running.hexdigest()
        return pa.RecordBatch.from_pylist([now], schema=schema)

    schema = None
    for batch in batches:
        schema = batch.schema
        for row in batch.to_pylist():
            if now is None or row["digest"] != now["digest"]:
                if now is not None:
                    yield closed()
                now, running, empty = dict(row, ends=None), hashlib.sha256(), True
            else:
                for name in ("n_convs", "n_children", "n_leaves", "saved_tokens"):
                    now[name] += row[name]
                now["conv_id"] = min(now["conv_id"], row["conv_id"])
            if row["ends"] is not None:
                running.update((row["ends"] if empty else "," + row["ends"]).encode())
                empty = False
    if now is not None:
        yield closed()


def last_turns(nodes: DataFrame, turns: DataFrame, lists: DataFrame) -> DataFrame:
    """``nodes`` with the role and text of each node's last turn (null for the root).

    ``lists`` are the turn lists the trie was built from, ``turns`` the table with the texts.
    """
    at = lists.select("conv_id", F.posexplode("turns").alias("pos", "turn_id")).select(
        "conv_id", (F.col("pos") + 1).cast("bigint").alias("depth"), "turn_id")
    texts = turns.select(turn_key(F.col("role"), F.col("text")).alias("turn_id"),
                         F.struct(F.coalesce("role", F.lit("")).alias("role"),
                                  F.coalesce("text", F.lit("")).alias("text")).alias("t"))
    one = texts.groupBy("turn_id").agg(F.min("t").alias("t"))
    return nodes.join(at, ["conv_id", "depth"], "left").join(one, "turn_id", "left").select(
        *nodes.columns, "t.role", "t.text")


def rebuilt(lists: DataFrame, every: int = 100, modulus: int = 6) -> DataFrame:
    """Turn lists in which conversation c begins with the first h turns of the first of its
    ``every`` neighbours, in place of its own first h; h = crc32(c) % ``modulus``.

    ``lists`` should be staged, as it is read twice.
    """
    own = lists.withColumn("head_of", F.col("conv_id") - F.pmod("conv_id", F.lit(every))).withColumn(
        "h", F.pmod(F.crc32(F.col("conv_id").cast("string").cast("binary")), F.lit(modulus)).cast("int"))
    heads = lists.filter(F.pmod("conv_id", F.lit(every)) == 0).select(
        F.col("conv_id").alias("head_of"), F.slice("turns", 1, modulus - 1).alias("head"))
    none = F.array().cast("array<binary>")
    return own.join(heads, "head_of", "left").select("conv_id", F.concat(
        F.coalesce(F.slice("head", F.lit(1), F.col("h")), none),
        F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns") - F.col("h"), F.lit(0))),
    ).alias("turns"))
