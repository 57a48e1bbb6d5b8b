"""Walks over many hops: chains, levels, cycles, shortest paths.

Each hop is one equi-join of the current frontier with the edges; the frontier is
checkpointed to the shared folder, so a lost executor never replays the walk and
plans stay small. The driver only asks how large a frontier is.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.session import checkpoint


def _pairs(edges: DataFrame, edge_types: Sequence[str]) -> DataFrame:
    """Distinct (src, dst) without self-loops."""
    typed = edges.filter(F.col("type").isin(list(edge_types)))
    return typed.filter(F.col("from_id") != F.col("to_id")).select(
        F.col("from_id").alias("src"), F.col("to_id").alias("dst")).distinct()


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def prerequisite_chain(edges: DataFrame, targets: DataFrame,
                       edge_types: Sequence[str] = ("prerequisite_of",),
                       max_depth: int | None = None) -> DataFrame:
    """(id, ancestor, depth): everything to learn before each of ``targets`` (id), back to the
    roots.

    The result has a row for every pair, so name the targets whose chains are wanted. Depth
    is the smallest hop count; pairs seen before are not walked again, so cycles end.
    """
    pairs = checkpoint(_pairs(edges, edge_types))
    start = pairs.join(targets.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi")
    frontier = checkpoint(start.select(
        F.col("dst").alias("id"), F.col("src").alias("ancestor"), F.lit(1).alias("depth")))
    found = [frontier]
    depth = 1
    steps = pairs.select(F.col("dst").alias("ancestor"), F.col("src").alias("_next"))
    while not frontier.isEmpty() and (max_depth is None or depth < max_depth):
        depth += 1
        reached = frontier.join(steps, "ancestor").select(
            "id", F.col("_next").alias("ancestor")).distinct()
        seen = _union([f.select("id", "ancestor") for f in found])
        fresh = reached.join(seen, ["id", "ancestor"], "left_anti")
        frontier = checkpoint(fresh.withColumn("depth", F.lit(depth)))
        found.append(frontier)
    return _union(found)


# -- levels ------------------------------------------------------------------


def _peel(pairs: DataFrame, first: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Topological levels of what is not on or behind a cycle.

    ``pairs`` (src, dst) are all edges, ``first`` (id, level) the nodes without edges to
    them, with a level of their own. Returns (id, level) and what could not be reached that
    way with its level so far. A node waits until as many edges have arrived as lead to it;
    a turn touches the edges of the nodes that just got their level and those that wait.
    """
    needed = checkpoint(pairs.groupBy("dst").agg(F.count(F.lit(1)).alias("needed")))
    frontier, found = checkpoint(first), []
    waiting = first.sparkSession.createDataFrame([], "id string, arrived bigint, level int")
    while not frontier.isEmpty():
        found.append(frontier)
        arrived = frontier.join(pairs, F.col("id") == F.col("src")).select(
            F.col("dst").alias("id"), F.lit(1).cast("bigint").alias("arrived"),
            (F.col("level") + 1).alias("level"))
        counted = arrived.union(waiting.select("id", "arrived", "level")).groupBy("id").agg(
            F.sum("arrived").alias("arrived"), F.max("level").alias("level"))
        counted = checkpoint(counted.join(needed, F.col("id") == F.col("dst")).drop("dst"))
        frontier = counted.filter("arrived = needed").select("id", "level")
        waiting = counted.filter("arrived < needed")
    return _union([f.select("id", "level") for f in found or [first]]), waiting.select("id", "level")


def learning_levels(edges: DataFrame, edge_types: Sequence[str] = ("prerequisite_of",)
                    ) -> DataFrame:
    """(id, level): the longest way from a node without prerequisites; those have level 0.

    Nodes of one cycle share a level: cycles count as one node each, see
    :func:`strong_components`.
    """
    pairs = checkpoint(_pairs(edges, edge_types))
    nodes = checkpoint(pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct())
    roots = nodes.join(pairs.select(F.col("dst").alias("id")).distinct(), "id", "left_anti")
    levels, waiting = _peel(pairs, roots.withColumn("level", F.lit(0)))
    levels = checkpoint(levels)
    rest = checkpoint(nodes.join(levels.select("id"), "id", "left_anti"))
    if rest.isEmpty():
        return levels
    # Only what is left has cycles: condense it, and start from the levels it has been given.
    inner = checkpoint(pairs.join(rest.select(F.col("id").alias("src")), "src", "left_semi"))
    group = checkpoint(strong_components(inner, rest))
    src = group.select(F.col("id").alias("src"), F.col("component").alias("a"))
    dst = group.select(F.col("id").alias("dst"), F.col("component").alias("b"))
    between = checkpoint(inner.join(src, "src").join(dst, "dst").filter("a != b").select(
        F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    least = group.join(waiting, "id", "left").groupBy("component").agg(
        F.coalesce(F.max("level"), F.lit(0)).cast("int").alias("floor"))
    # A component's floor reaches it as one more edge, from a node of its own.
    floors = least.select(F.concat(F.lit("\u0000"), "component").alias("id"),
                          (F.col("floor") - 1).alias("level"), "component")
    floors = checkpoint(floors)
    steps = between.union(floors.select(F.col("id").alias("src"), F.col("component").alias("dst")))
    of_groups, _ = _peel(checkpoint(steps), floors.select("id", "level"))
    of_groups = of_groups.filter(~F.col("id").startswith("\u0000")).withColumnRenamed("id", "component")
    return levels.union(group.join(of_groups, "component").select("id", "level"))


def strong_components(pairs: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """(id, component): the strongly connected components of (src, dst), named by one member.

    Nodes from which no edge leads on, or to which none leads, are components of their own
    and go first, turn by turn. Of the rest every node takes the largest name that reaches
    it; a node that keeps its own name is the root of a component, whose members are the
    nodes of that name from which the root is reached. What is left is coloured again.
    """
    if nodes is None:
        nodes = pairs.select(F.explode(F.array("src", "dst")).alias("id")).distinct()
    left = checkpoint(pairs.filter("src != dst").distinct())
    nodes = checkpoint(nodes.select("id").distinct())
    found = []
    while not nodes.isEmpty():
        # Trim: both ends of a node are needed for a cycle.
        while True:
            inside = left.select(F.col("src").alias("id")).distinct().join(
                left.select(F.col("dst").alias("id")).distinct(), "id", "left_semi")
            alone = checkpoint(nodes.join(inside, "id", "left_anti"))
            if alone.isEmpty():
                break
            found.append(alone.select("id", F.col("id").alias("component")))
            nodes = checkpoint(nodes.join(alone, "id", "left_anti"))
            left = checkpoint(_within(left, nodes))
        if nodes.isEmpty():
            break
        colour = checkpoint(nodes.select("id", F.col("id").alias("colour")))
        active = colour
        while not active.isEmpty():
            sent = active.join(left, F.col("id") == F.col("src")).groupBy(F.col("dst").alias("id")).agg(
                F.max("colour").alias("sent"))
            better = checkpoint(sent.join(colour, "id").filter("sent > colour").select(
                "id", F.col("sent").alias("colour")))
            active = better
            colour = checkpoint(colour.join(better.withColumnRenamed("colour", "new"), "id", "left").select(
                "id", F.coalesce("new", "colour").alias("colour")))
        # Backwards from the roots, inside one colour.
        a = colour.select(F.col("id").alias("src"), F.col("colour").alias("ca"))
        b = colour.select(F.col("id").alias("dst"), F.col("colour").alias("cb"))
        same = checkpoint(left.join(a, "src").join(b, "dst").filter("ca = cb").select("src", "dst", "ca"))
        frontier = checkpoint(colour.filter("id = colour"))
        members = frontier
        while not frontier.isEmpty():
            back = same.join(frontier.select(F.col("id").alias("dst")), "dst").select(
                F.col("src").alias("id"), F.col("ca").alias("colour")).distinct()
            frontier = checkpoint(back.join(members.select("id"), "id", "left_anti"))
            members = checkpoint(members.union(frontier))
        found.append(members.select("id", F.col("colour").alias("component")))
        nodes = checkpoint(nodes.join(members.select("id"), "id", "left_anti"))
        left = checkpoint(_within(left, nodes))
    return _union(found) if found else nodes.select("id", F.col("id").alias("component"))


def _within(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """The pairs whose both ends are among ``nodes``."""
    return pairs.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(
        nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


# -- shortest paths ----------------------------------------------------------


def _steps(edges: DataFrame, edge_types: Sequence[str] | None, directed: bool) -> DataFrame:
    used = edges if edge_types is None else edges.filter(F.col("type").isin(list(edge_types)))
    steps = used.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"))
    if not directed:
        steps = steps.unionByName(steps.select(F.col("dst").alias("src"),
                                               F.col("src").alias("dst")))
    return checkpoint(steps.filter(F.col("src") != F.col("dst")).distinct())


def shortest_paths_from(edges: DataFrame, start: str, edge_types: Sequence[str] | None = None,
                        max_hops: int | None = None, directed: bool = False) -> DataFrame:
    """(id, hops, path): a shortest path from ``start`` to every node in reach.

    Among equally short paths the smallest one is kept, so every node has one
    path. ``max_hops`` ends the search after that many hops; without it it ends where
    nothing new is in reach.
    """
    steps = _steps(edges, edge_types, directed)
    spark = edges.sparkSession
    frontier = spark.range(1).select(
        F.lit(start).alias("id"), F.lit(0).alias("hops"),
        F.array(F.lit(start)).alias("path"))
    found = [frontier]
    hop = 0
    while max_hops is None or hop < max_hops:
        hop += 1
        reached = frontier.join(steps, frontier["id"] == steps["src"]).groupBy("dst").agg(
            F.min("path").alias("path"))
        seen = _union([f.select("id") for f in found])
        fresh = reached.join(seen, F.col("dst") == F.col("id"), "left_anti")
        frontier = checkpoint(fresh.select(
            F.col("dst").alias("id"), F.lit(hop).alias("hops"),
            F.concat("path", F.array("dst")).alias("path")))
        if frontier.isEmpty():
            break
        found.append(frontier)
    return _union(found)


class _Side:
    """One of two searches that meet: its nodes by hops, the newest last."""

    def __init__(self, steps: DataFrame, origin: str) -> None:
        self.steps = steps  # (src, dst) in the direction of this search
        self.levels = [steps.sparkSession.range(1).select(F.lit(origin).alias("id"))]
        self.size = 1

    def expand(self) -> None:
        reached = self.levels[-1].join(self.steps, F.col("id") == F.col("src")).select(
            F.col("dst").alias("id")).distinct()
        fresh = checkpoint(reached.join(_union(self.levels), "id", "left_anti"))
        self.levels.append(fresh)
        self.size = fresh.count()


def path_between(edges: DataFrame, start: str, end: str,
                 edge_types: Sequence[str] | None = None, max_hops: int | None = None,
                 directed: bool = False, trace: list | None = None) -> DataFrame:
    """(id, hops, path) with the smallest shortest path from ``start`` to ``end``; empty if none.

    Both ends search at once, the smaller frontier expanding, until a join of the newest
    frontiers finds nodes in common, so each side goes about half the way. Frontiers carry
    ids only. The path is then read off hop by hop: of the nodes on shortest paths the
    smallest is taken. ``trace`` collects (side, frontier size) of every expansion.
    """
    spark = edges.sparkSession
    none = spark.createDataFrame([], "id string, hops int, path array<string>")
    if start == end:
        return spark.range(1).select(F.lit(end).alias("id"), F.lit(0).alias("hops"),
                                     F.array(F.lit(start)).alias("path"))
    steps = _steps(edges, edge_types, directed)
    back = steps.select(F.col("dst").alias("src"), F.col("src").alias("dst")) if directed else steps
    ahead, behind = _Side(steps, start), _Side(back, end)
    while True:
        hops = len(ahead.levels) + len(behind.levels) - 2
        if max_hops is not None and hops >= max_hops:
            return none
        # Of equal frontiers the one that is not as far yet.
        side = min(ahead, behind, key=lambda x: (x.size, len(x.levels)))
        side.expand()
        if trace is not None:
            trace.append((side is ahead, side.size))
        if not side.size:
            return none
        met = checkpoint(ahead.levels[-1].join(behind.levels[-1], "id", "left_semi"))
        if not met.isEmpty():
            break
    # On the forward half only nodes from which a meeting node is reached lie on a shortest
    # path; on the other half every node does that the one before leads to.
    useful = [met]
    for level in reversed(ahead.levels[:-1]):
        before = useful[0].join(steps, F.col("id") == F.col("dst")).select(F.col("src").alias("id")).distinct()
        useful.insert(0, checkpoint(level.join(before, "id", "left_semi")))
    path = [start]
    for level in [*useful[1:], *reversed(behind.levels[:-1])]:
        following = steps.filter(F.col("src") == path[-1]).select(F.col("dst").alias("id"))
        path.append(level.join(following, "id", "left_semi").agg(F.min("id")).first()[0])
    return spark.createDataFrame([(end, len(path) - 1, path)], "id string, hops int, path array<string>")
