"""Near-duplicate documents by a MinHash LSH forest.

A document is the set of its distinct word shingles. Equal sets become one node. Each
node has ``VALUES`` MinHash values, and each of ``TREES`` trees is one order of them: its
nodes are sorted by ``DEPTH`` values beginning at the tree's own offset, so that nodes
with a long common prefix are neighbours. The depth adapts to each region: a node meets
the nodes that share its first d values, with the smallest d from ``LEAST_DEPTH`` on for
which these are ``REACH`` nodes at most, and the next node in order anyway. So where
nodes are dense, the ones that meet share many values, where they are sparse few. In a
region with more than ``REACH`` nodes, at several depths, every node also meets the
region's centre, the node that agrees most with the region's commonest values: copies of
one original meet the original, however many there are; and each node meets the one that
agrees best with it among the next, and the previous, ``WINDOW`` nodes. Pairs of a large
region are never all expanded.

What these miss in regions with more than ``REACH`` nodes is found exactly, on full sets: in
one fixed order of all shingles, about the rarest first, similar sets share one of their first
n - ceil(n * percent / 100) + 1. Nodes of crowded regions are joined on these when their sizes
allow the similarity and they are not linked yet. Rarity comes from ``SKETCH`` counters, which
bound a broadcast; any order is exact, so collisions only make lists longer.

Trees are range-partitioned by their order, so a region of any size spans tasks; what
adjoins at a cut is compared in a second pass. Candidates are confirmed on full shingle
sets, best ones first; a pair whose ends are linked already needs no proof. Components are
computed on the cluster.

The chance to miss: similar nodes with similarity s share the first three values of a tree
with s**3; at 0.8 none of 16 trees does so with a chance of 1e-5, at 0.9 of 3e-10.

Words are lower-cased (A-Z) runs outside ``[\\x20\\x09-\\x0D]``. Defined cases: fewer words
than a shingle make one shingle; without words (or text) the set is empty and linked with
nothing; rows that share an id are one document, whose sets are linked; rows without an id
are left alone; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.llm.common import broadcast_if_small, pick, prepare
from graphloom.llm.graph import components
from graphloom.llm.text import blocks, mix, pair_hash, word_hashes
from graphloom.session import stage

WORDS = 2
PERCENT = 80
VALUES = 128
TREES = 16
DEPTH = 16
LEAST_DEPTH = 3
CENTRE_DEPTHS = (3, 6, 10)
REACH = 8
WINDOW = 32
#: Of the DEPTH values so many must agree: similarity 0.8 has 12.8, with deviation 1.6.
LEAST_AGREEING = 8
CHUNK_ROWS = 1 << 16
SKETCH = 1 << 20

_ONE = np.uint64(0x9E3779B97F4A7C15)


def shingles(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of every row, and n + 1 offsets of the rows."""
    hashes, at = word_hashes(column)
    joined = hashes
    for k in range(1, words):
        joined = pair_hash(joined[:-1], hashes[k:]) if len(joined) > 1 else joined[:0]
    sets = []
    for s, e in zip(at[:-1], at[1:], strict=True):
        if e - s >= words:
            sets.append(np.unique(joined[s:e - words + 1]))
        elif e > s:
            whole = mix(hashes[s:s + 1] + _ONE)
            for h in range(s + 1, e):
                whole = pair_hash(whole, hashes[h:h + 1])
            sets.append(whole)
        else:
            sets.append(hashes[:0])
    offsets = np.cumsum([0, *map(len, sets)])
    return (np.concatenate(sets) if sets else hashes[:0]), offsets


def signatures(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """VALUES MinHash values of 16 bits per row; rows must not be empty."""
    seeds = mix(np.arange(1, 2 * VALUES + 1, dtype=np.uint64) * _ONE).astype(np.uint32)
    x = (values >> np.uint64(32)).astype(np.uint32)
    out = np.empty((len(offsets) - 1, VALUES), dtype=np.uint16)
    for k in range(VALUES):
        least = np.minimum.reduceat(x * (seeds[k] | np.uint32(1)) + seeds[VALUES + k], offsets[:-1])
        out[:, k] = (mix(least.astype(np.uint64) + seeds[k].astype(np.uint64) * _ONE)
                     >> np.uint64(48)).astype(np.uint16)
    return out


def describe(words: int):
    """(doc_id, text) to doc_id, n_shingles, a digest of the set and its signature."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for i, j in blocks(batch.column(1)):
                values, offsets = shingles(batch.column(1)[i:j], words)
                size = np.diff(offsets)
                filled = np.flatnonzero(size)
                digests = np.zeros((2, j - i), dtype=np.uint64)
                packed = [None] * (j - i)
                if len(filled):
                    starts = np.append(offsets[:-1][filled], len(values))
                    digests[0, filled] = np.add.reduceat(mix(values), starts[:-1])
                    digests[1, filled] = np.add.reduceat(mix(values ^ _ONE), starts[:-1])
                    digests[1] += size.astype(np.uint64)
                    rows = signatures(values, starts).astype(">u2")
                    for k, row in zip(filled, rows, strict=True):
                        packed[k] = row.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.array(size.astype(np.int64)),
                     *(pa.array(d.view(np.int64)) for d in digests), pa.array(packed, pa.binary())],
                    ["doc_id", "n_shingles", "a", "b", "signature"])

    return run


def full_sets(words: int):
    """(doc_id, text) to node and its whole shingle set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        np.seterr(over="ignore")
        for batch in batches:
            for i, j in blocks(batch.column(1)):
                values, offsets = shingles(batch.column(1)[i:j], words)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0)[i:j], pa.ListArray.from_arrays(
                        pa.array(offsets.astype(np.int32)), pa.array(values.view(np.int64)))],
                    ["node", "members"])

    return run


class Tree:
    """Consecutive rows of the sorted forest: tree, key values, node, set size, part."""

    def __init__(self, tree, keys, node, size, part):
        self.tree, self.keys, self.node, self.size, self.part = tree, keys, node, size, part

    @classmethod
    def of(cls, batch: pa.RecordBatch) -> Tree:
        keys = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=">u2").reshape(-1, DEPTH)
        part = batch.column(4) if batch.num_columns > 4 else np.zeros(batch.num_rows, np.int32)
        return cls(np.asarray(batch.column(0)), keys, np.asarray(batch.column(2)),
                   np.asarray(batch.column(3)), np.asarray(part))

    def rows(self, which) -> Tree:
        return Tree(self.tree[which], self.keys[which], self.node[which], self.size[which],
                    self.part[which])

    def then(self, other: Tree) -> Tree:
        return Tree(*(np.concatenate([getattr(self, n), getattr(other, n)])
                      for n in ("tree", "keys", "node", "size", "part")))

    def common_prefix(self) -> np.ndarray:
        """Values that each row shares with the next one from the start."""
        same = (self.keys[1:] == self.keys[:-1]) & (self.tree[1:] == self.tree[:-1])[:, None]
        return np.minimum.accumulate(same, axis=1).sum(axis=1)

    def alike(self, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which pairs may be similar, by set sizes and agreeing values; and how many agree."""
        agree = (self.keys[i] == self.keys[j]).sum(axis=1)
        low, high = np.minimum(self.size[i], self.size[j]), np.maximum(self.size[i], self.size[j])
        return (agree >= LEAST_AGREEING) & (100 * low >= PERCENT * high) & (
            self.node[i] != self.node[j]), agree

    def pairs(self, first: int = 0, across: bool = False) -> tuple[np.ndarray, ...]:
        """Candidate pairs and their agreement; at least one end from row ``first`` on.
        ``across``: only between different parts."""
        n = len(self.node)
        shared = self.common_prefix()
        i = np.flatnonzero(shared >= LEAST_DEPTH)
        found = [(i, i + 1)]
        depth = self.region_depth(shared)
        reached = shared.copy()
        for step in range(2, min(REACH, n)):
            reached = np.minimum(reached[:-1], shared[step - 1:])
            i = np.flatnonzero(reached >= depth[:n - step])
            if not len(i):
                break
            found.append((i, i + step))
        if not across:
            found += self._best_in_window(shared, depth > LEAST_DEPTH)
            for depth in CENTRE_DEPTHS:
                cut = np.flatnonzero(np.append(shared < depth, True))
                begin = np.append(0, cut[:-1] + 1)
                for s, e in zip(begin, cut + 1, strict=True):
                    if e - s > REACH:
                        found.append(self._star(s, e))
        i = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
        j = np.concatenate([f[1] for f in found]) if found else i
        fresh = np.maximum(i, j) >= first
        if across:
            fresh &= self.part[i] != self.part[j]
        i, j = i[fresh], j[fresh]
        ok, agree = self.alike(i, j)
        a, b = self.node[i[ok]], self.node[j[ok]]
        return np.minimum(a, b), np.maximum(a, b), agree[ok]

    def _best_in_window(self, shared: np.ndarray, dense: np.ndarray) -> list[tuple]:
        """Of the next and of the previous WINDOW rows the one that agrees best, in dense regions."""
        n = len(self.node)
        best = np.zeros((2, n), dtype=np.int64)
        where = np.zeros((2, n), dtype=np.int64)
        reached = shared.copy()
        for step in range(1, min(WINDOW, n - 1) + 1):
            if step > 1:
                reached = np.minimum(reached[:-1], shared[step - 1:])
            i = np.flatnonzero((reached >= LEAST_DEPTH) & dense[:n - step])
            if not len(i):
                break
            ok, agree = self.alike(i, i + step)
            agree = np.where(ok, agree, 0)
            for side, (own, other) in enumerate(((i, i + step), (i + step, i))):
                better = agree > best[side, own]
                best[side, own[better]] = agree[better]
                where[side, own[better]] = other[better]
        return [(own, where[side, own]) for side in (0, 1)
                for own in [np.flatnonzero(best[side])]]

    def region_depth(self, shared: np.ndarray) -> np.ndarray:
        """For each row the smallest depth at which REACH rows or fewer share its prefix."""
        n = len(self.node)
        out = np.full(n, DEPTH + 1)
        for depth in range(DEPTH, LEAST_DEPTH - 1, -1):
            ends = np.flatnonzero(np.append(shared < depth, True))
            size = np.diff(ends, prepend=-1)
            out[np.repeat(size <= REACH, size)] = depth
        return out

    def _star(self, s: int, e: int) -> tuple[np.ndarray, np.ndarray]:
        keys = self.keys[s:e]
        score = np.zeros(e - s, dtype=np.int64)
        for column in keys.T:
            _, which, count = np.unique(column, return_inverse=True, return_counts=True)
            score += which == count.argmax()
        centre = s + int(score.argmax())
        return np.full(e - s, centre), np.arange(s, e)


_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("agree", pa.int32()),
                    ("tree", pa.int32()), ("key", pa.binary()), ("node", pa.int64()),
                    ("size", pa.int64()), ("part", pa.int32())])
PAIRS = "a bigint, b bigint, agree int, tree int, key binary, node bigint, size bigint, part int"


def _pair_batch(pairs: tuple[np.ndarray, ...]) -> pa.RecordBatch:
    n = len(pairs[0])
    return pa.RecordBatch.from_arrays(
        [pa.array(pairs[0]), pa.array(pairs[1]), pa.array(pairs[2].astype(np.int32)),
         *(pa.nulls(n, f.type) for f in list(_PAIRS)[3:])], schema=_PAIRS)


def _edge_batch(rows: Tree) -> pa.RecordBatch:
    n = len(rows.node)
    keys = [k.tobytes() for k in rows.keys.astype(">u2")]
    return pa.RecordBatch.from_arrays(
        [*(pa.nulls(n, f.type) for f in list(_PAIRS)[:3]), pa.array(rows.tree.astype(np.int32)),
         pa.array(keys, pa.binary()), pa.array(rows.node), pa.array(rows.size),
         pa.array(rows.part.astype(np.int32))], schema=_PAIRS)


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Tree]:
    held, rows = [], 0
    for batch in batches:
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            yield Tree.of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
            held, rows = [], 0
    if rows:
        yield Tree.of(pa.Table.from_batches(held).combine_chunks().to_batches()[0])


def neighbours(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One sorted part of the forest to its candidate pairs and its first and last rows."""
    last: Tree | None = None
    for chunk in _chunks(batches):
        if last is None:
            yield _edge_batch(chunk.rows(slice(0, REACH)))
            yield _pair_batch(chunk.pairs())
            joined = chunk
        else:
            joined = last.then(chunk)
            yield _pair_batch(joined.pairs(first=len(last.node)))
        last = joined.rows(slice(max(0, len(joined.node) - WINDOW), None))
    if last is not None:
        yield _edge_batch(last.rows(slice(max(0, len(last.node) - REACH), None)))


def across_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The first and last rows of all parts of some trees to pairs between parts."""
    last: Tree | None = None
    for chunk in _chunks(batches):
        joined = chunk if last is None else last.then(chunk)
        yield _pair_batch(joined.pairs(first=0 if last is None else len(last.node), across=True))
        last = joined.rows(slice(max(0, len(joined.node) - REACH), None))


def forest_of(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(node, n_shingles, signature) to a row per tree, with ``depth`` values as key."""
    doubled = F.concat("signature", "signature")
    step = 2 * VALUES // TREES
    return nodes.select(
        F.explode(F.array(*[F.struct(F.lit(t).alias("tree"), F.substring(
            doubled, step * t + 1, 2 * depth).alias("key")) for t in range(TREES)])).alias("x"),
        "node", F.col("n_shingles").alias("size"),
    ).select("x.tree", "x.key", "node", "size")


def candidates(nodes: DataFrame) -> DataFrame:
    """(node, n_shingles, signature) to distinct pairs a < b and their summed agreement."""
    spark = nodes.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    forest = forest_of(nodes)
    order = ["tree", "key", "node"]
    met = (forest.repartitionByRange(parts, *order).sortWithinPartitions(*order)
           .withColumn("part", F.spark_partition_id()).mapInArrow(neighbours, PAIRS))
    met = stage(met, "forest")
    edges = met.filter("node IS NOT NULL").select(*order, "size", "part").distinct()
    # At most 2 REACH rows a part and tree.
    cut = (edges.repartition(TREES, "tree").sortWithinPartitions(*order)
           .select("tree", "key", "node", "size", "part").mapInArrow(across_parts, PAIRS))
    pairs = met.filter("node IS NULL").select("a", "b", "agree").union(
        cut.filter("node IS NULL").select("a", "b", "agree"))
    return stage(pairs.groupBy("a", "b").agg(F.sum("agree").alias("weight")), "candidates")


def crowded(nodes: DataFrame) -> DataFrame:
    """The nodes in regions with more than REACH nodes, which candidates() does not all pair."""
    rows = forest_of(nodes, LEAST_DEPTH).select("tree", "key", "node")
    many = stage(rows.groupBy("tree", "key").agg(F.count(F.lit(1)).alias("n")).filter(
        F.col("n") > REACH).select("tree", "key"), "regions")
    return stage(rows.join(broadcast_if_small(many, row_bytes=48), ["tree", "key"], "left_semi")
                 .select(F.col("node").alias("doc_id")).distinct(), "crowded")


def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Member lists to (slot, n): how many members fall in each slot of the sketch."""
    counts = np.zeros(SKETCH, dtype=np.int64)
    for batch in batches:
        members = np.asarray(batch.column(0).flatten()).view(np.uint64)
        counts += np.bincount((members % np.uint64(SKETCH)).astype(np.int64), minlength=SKETCH)
    slots = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(slots), pa.array(counts[slots])], ["slot", "n"])


def rarest(shared, percent: int):
    """(node, members) to the members of which similar sets share one: their position in the
    set's order, the set's size, and whether a set of this size or larger must meet it there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shared.value
        for batch in batches:
            keys, sizes, short = [], [], []
            for row in batch.column(1):
                members = np.asarray(row.values).view(np.uint64)
                n = len(members)
                order = np.lexsort((members, counts[(members % np.uint64(SKETCH)).astype(np.int64)]))
                keys.append(members[order[:n + 1 + (-n * percent) // 100]].view(np.int64))
                sizes.append(n)
                short.append(n + 1 + (-2 * n * percent) // (100 + percent))
            times = [len(k) for k in keys]
            at = np.concatenate([np.arange(t) for t in times])
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(keys)), pa.array(np.repeat(np.asarray(batch.column(0)), times)),
                 pa.array(np.repeat(sizes, times)), pa.array(at), pa.array(at < np.repeat(short, times))],
                ["key", "node", "size", "at", "short"])

    return run


def crowded_pairs(sets: DataFrame, labels: DataFrame, percent: int) -> DataFrame:
    """All pairs of (node, members) that may be similar and are in different components, with
    the count of rare members on which they met.

    Of two similar sets the smaller one has a common member among its short list of rarest
    ones, the larger one among its longer list. At the first common one the members that
    follow must still suffice for the similarity. What a template's documents share comes
    late in their order and so pairs nothing.
    """
    spark = sets.sparkSession
    sketch = sets.select("members").mapInArrow(tally, "slot bigint, n bigint").groupBy("slot").agg(
        F.sum("n").alias("n")).toArrow()
    counts = np.zeros(SKETCH, dtype=np.int64)
    counts[sketch["slot"].to_numpy()] = sketch["n"].to_numpy()
    shared = spark.sparkContext.broadcast(counts)
    keyed = sets.select("node", "members").mapInArrow(
        rarest(shared, percent), "key bigint, node bigint, size bigint, at bigint, short boolean")
    keyed = stage(keyed.join(labels, "node", "left").select(
        "key", "node", "size", "at", "short", F.coalesce("component", "node").alias("component")), "rarest")
    # A shingle of one component only, or in no short list, pairs nothing.
    mixed = keyed.groupBy("key").agg(
        F.min("component").alias("low"), F.max("component").alias("high"),
        F.max("short").alias("any_short")).filter("low < high AND any_short").select("key")
    keyed = stage(keyed.join(mixed, "key", "left_semi"), "shared-rarest")
    columns = ("node", "size", "at", "component")
    a = keyed.filter("short").select("key", *[F.col(c).alias(f"{c}_a") for c in columns])
    b = keyed.select(F.col("key").alias("key_b"), *[F.col(c).alias(f"{c}_b") for c in columns])
    size = F.col("size_a") + F.col("size_b")
    most = 1 + F.least(F.col("size_a") - 1 - F.col("at_a"), F.col("size_b") - 1 - F.col("at_b"))
    smaller = (F.col("size_a") < F.col("size_b")) | (
        (F.col("size_a") == F.col("size_b")) & (F.col("node_a") < F.col("node_b")))
    met = a.join(b, (F.col("key") == F.col("key_b")) & smaller
                 & (F.col("component_a") != F.col("component_b"))
                 & (F.col("size_a") * 100 >= F.col("size_b") * percent)
                 & (most * (100 + percent) >= size * percent))
    return met.groupBy(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).agg(
        F.count(F.lit(1)).alias("weight"))


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar."""
    def side(name: str) -> DataFrame:
        return sets.select(F.col("node").alias(name), F.col("members").alias(f"of_{name}"))

    both = F.size(F.array_intersect("of_a", "of_b"))
    met = pairs.join(side("a"), "a").join(side("b"), "b").select(
        "a", "b", both.alias("both"), (F.size("of_a") + F.size("of_b") - both).alias("all"))
    return stage(met.filter(F.col("both") * 100 >= F.col("all") * percent)
                 .select("a", "b").distinct(), "confirmed")


def link(pairs: DataFrame, sets: DataFrame, labels: DataFrame | None, repeated: DataFrame,
         percent: int) -> DataFrame:
    """Components after all ``pairs`` (a, b, weight): best ones are confirmed first, one for
    each node and component and then a few, and pairs that are linked by then need no proof."""
    for most in (1, 4, None):
        left = pairs
        for end in ("a", "b"):
            if labels is None:
                left = left.withColumn(f"c{end}", F.col(end))
                continue
            named = labels.select(F.col("node").alias(end), F.col("component").alias(f"c{end}"))
            left = left.join(broadcast_if_small(named, row_bytes=32), end, "left").withColumn(
                f"c{end}", F.coalesce(f"c{end}", end))
        if labels is not None:
            left = stage(left.filter("ca != cb"), "pairs-left")
        chosen = best_pairs(left, most, by_component=labels is not None) if most else left
        chosen = stage(chosen.select("a", "b"), "chosen")
        if chosen.isEmpty():
            break
        pairs = left.select("a", "b", "weight").join(chosen, ["a", "b"], "left_anti")
        fresh = confirm(chosen, sets, percent)
        if labels is None:
            labels = stage(components(fresh.union(repeated)), "labels")
        elif not fresh.isEmpty():
            # What was linked before comes back as stars, which need few turns.
            labels = stage(components(fresh.union(labels.toDF("a", "b"))), "labels")
    return stage(components(repeated), "labels") if labels is None else labels


def near_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS,
                percent: int = PERCENT) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    spark = docs.sparkSession
    prepare(spark)
    docs = pick(docs, [doc_id, text]).toDF("doc_id", "text").withColumn(
        "doc_id", F.col("doc_id").cast("bigint"))
    described = stage(docs.mapInArrow(
        describe(words), "doc_id bigint, n_shingles bigint, a bigint, b bigint, signature binary"),
        "signatures")
    filled = described.filter("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = stage(filled.groupBy("a", "b", "n_shingles").agg(
        F.min("doc_id").alias("node"), F.first("signature").alias("signature")), "nodes")
    pairs = candidates(nodes.select("node", "n_shingles", "signature"))
    involved = stage(pairs.select("a").union(pairs.select("b")).distinct().toDF("doc_id"), "involved")
    sets = stage(docs.join(broadcast_if_small(involved, row_bytes=16), "doc_id", "left_semi")
                 .select("doc_id", "text")
                 .mapInArrow(full_sets(words), "node bigint, members array<bigint>"), "sets")
    # Sets that share an id are linked by it.
    linked = filled.join(nodes.select("a", "b", "n_shingles", "node"), ["a", "b", "n_shingles"]) \
        .filter("doc_id != node").select(F.col("doc_id").alias("a"), F.col("node").alias("b"))
    repeated = linked.join(nodes.select(F.col("node").alias("a")), "a", "left_semi")
    labels = link(pairs, sets, None, repeated, percent)
    crowd = crowded(nodes.select("node", "n_shingles", "signature"))
    if not crowd.isEmpty():
        sets = stage(docs.join(broadcast_if_small(crowd, row_bytes=16), "doc_id", "left_semi")
                     .select("doc_id", "text")
                     .mapInArrow(full_sets(words), "node bigint, members array<bigint>")
                     .filter(F.size("members") > 0), "crowded-sets")
        labels = link(stage(crowded_pairs(sets, labels, percent), "crowded-pairs"), sets, labels,
                      repeated, percent)
    found = described.join(
        nodes.select("a", "b", "n_shingles", "node"), ["a", "b", "n_shingles"], "left")
    found = found.join(labels, "node", "left")
    component = F.coalesce("component", "node", "doc_id")
    return found.select(
        F.col("doc_id").alias(doc_id), "n_shingles", component.alias("component_id"),
        F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def best_pairs(pairs: DataFrame, most: int, by_component: bool) -> DataFrame:
    """For every node the pairs that agree best, ``most`` per component it may join."""
    ends = pairs.select(F.col("a").alias("node"), F.col("cb").alias("to"), "a", "b", "weight").union(
        pairs.select(F.col("b").alias("node"), F.col("ca").alias("to"), "a", "b", "weight"))
    keys = ["node", "to"] if by_component else ["node"]
    # Spark cuts every group to ``most`` rows in the tasks, before the shuffle.
    order = Window.partitionBy(*keys).orderBy(F.desc("weight"), "a", "b")
    return ends.withColumn("_n", F.row_number().over(order)).filter(
        F.col("_n") <= most).select("a", "b").distinct()
