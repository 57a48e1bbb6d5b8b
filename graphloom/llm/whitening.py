"""Whitening of embeddings through the covariance of their distinct vectors.

Vectors are scaled and rounded down to integers, x = floor(scale * c), and equal x are merged
by a hash aggregate, which adds up copies in the tasks before the shuffle, so a vector that a
third of all rows have is one row per task. The distinct vectors carry their multiplicity; the
fit weighs each by it (``weights="counts"``) or by one (``weights="one"``).

The covariance is a weighted centred product: every task subtracts the mean from its vectors
and multiplies them in blocks; the partial matrices are added row by row, a row of the matrix
being a key, in a fixed order. Only sums, matrices of dims x dims numbers and the components
reach the driver. Each distinct vector is whitened once and joined back to its rows by a digest
of x; AQE splits the join's partition of a hot vector.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped, and
so are those whose length is not the most frequent one (of equally frequent ones the larger).
Entries beyond a 64-bit integer after scaling are clipped to it. Null and repeated ids are
ordinary rows. Components whose eigenvalue is zero but for rounding are left out, as whitening
divides by it, so equal vectors and single vectors give no rows, as does an empty table. A
deviation beyond a 64-bit integer is null. Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import broadcast_if_small
from graphloom.session import stage

SCALE = 256
COMPONENTS = 4
#: Numbers multiplied at once.
BLOCK = 1 << 20


@dataclass
class Fit:
    n: int  # total weight
    sums: list[int]  # per dimension, exact
    values: np.ndarray  # eigenvalues, falling
    vectors: np.ndarray  # unit eigenvectors as columns
    trace: float


def scaled(vector: Column, scale: int = SCALE) -> Column:
    """The integer vector; null where the vector is to be dropped."""
    entry = lambda c: F.floor(c.cast("double") * F.lit(float(scale)))
    bad = F.exists(vector, lambda c: F.coalesce(
        c.isNull() | F.isnan(c) | (F.abs(c.cast("double")) == float("inf")), F.lit(True)))
    return F.when(vector.isNotNull() & ~bad, F.transform(vector, entry))


def integer_rows(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding",
                 scale: int = SCALE) -> DataFrame:
    """(vec_id, x, digest) of the rows that remain."""
    x = rows.select(F.col(f"`{vec_id}`").alias("vec_id"),
                    scaled(F.col(f"`{vector}`"), scale).alias("x")).filter(F.col("x").isNotNull())
    lengths = x.groupBy(F.size("x").alias("dims")).count()
    best = lengths.agg(F.max_by("dims", F.struct("count", "dims")).alias("dims")).first()["dims"]
    return x.filter(F.size("x") == F.lit(best if best is not None else -1)).withColumn(
        "digest", F.unhex(F.md5(F.array_join(F.col("x").cast("array<string>"), ","))))


def distinct_vectors(rows: DataFrame, weights: str = "one") -> DataFrame:
    """(digest, x, copies, weight) of the distinct x."""
    if weights not in ("one", "counts"):
        raise ValueError(f"unknown weights: {weights}")
    found = rows.groupBy("digest", "x").agg(F.count(F.lit(1)).alias("copies"))
    return found.withColumn("weight", F.lit(1).cast("bigint") if weights == "one" else F.col("copies"))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    return column.flatten().to_numpy().reshape(len(column), -1)


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    for batch in batches:
        if batch.num_rows:
            dims = len(batch.column("x")[0])
            step = max(1, BLOCK // max(dims, 1))
            for i in range(0, batch.num_rows, step):
                part = batch.slice(i, step)
                yield part, matrix(part.column("x"))


def weighted_sums(distinct: DataFrame) -> tuple[int, list[int]]:
    """Total weight and the exact sum of each dimension."""
    if wide(distinct):  # decimals are exact to 38 digits
        each = distinct.select("weight", F.posexplode("x").alias("pos", "v"))
        product = F.col("v").cast("decimal(19,0)") * F.col("weight").cast("decimal(19,0)")
        found = each.groupBy("pos").agg(F.sum(product).alias("v")).orderBy("pos").collect()
        total = distinct.agg(F.sum("weight")).first()[0]
        return int(total or 0), [int(r["v"]) for r in found]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = 0, None
        for part, x in blocks(batches):
            w = part.column("weight").to_numpy()
            total += int(w.sum())
            own = (x * w[:, None]).sum(axis=0)
            sums = own if sums is None else sums + own
        if sums is not None:
            yield pa.record_batch([pa.array(np.arange(-1, len(sums), dtype=np.int32)),
                                   pa.array(np.append(total, sums).astype(np.int64))], ["pos", "v"])

    parts = distinct.select("x", "weight").mapInArrow(run, "pos int, v bigint")
    found = parts.groupBy("pos").agg(F.sum(F.col("v").cast("decimal(38,0)")).alias("v"))
    by = {r["pos"]: int(r["v"]) for r in found.collect()}  # dims + 1 rows
    return by.get(-1, 0), [by[i] for i in range(len(by) - 1)]


def wide(distinct: DataFrame) -> bool:
    """Whether sums of a task could pass 64 bits."""
    largest = F.greatest(F.abs(F.array_max("x").cast("decimal(20,0)")),
                         F.abs(F.array_min("x").cast("decimal(20,0)")))
    found = distinct.agg(F.max(largest).alias("x"), F.sum("weight").alias("w")).first()
    return int(found["x"] or 0) * int(found["w"] or 0) >= 1 << 62


def covariance(distinct: DataFrame, n: int, sums: list[int]) -> np.ndarray:
    """Sum of weight * (x - mean) (x - mean)^T over n, for dims x dims numbers."""
    dims = len(sums)
    mean = np.array([float(s) / n for s in sums])

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for part, x in blocks(batches):
            y = x - mean
            own = y.T @ (y * part.column("weight").to_numpy().astype(np.float64)[:, None])
            total = own if total is None else total + own
        if total is not None:
            task = TaskContext.get().partitionId()
            yield pa.record_batch(
                [pa.array(np.arange(dims, dtype=np.int32)), pa.array(np.full(dims, task, np.int32)),
                 pa.ListArray.from_arrays(pa.array(np.arange(dims + 1, dtype=np.int32) * dims),
                                          pa.array(total.reshape(-1)))], ["i", "task", "row"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, total = None, None
        for batch in batches:
            rows = matrix(batch.column("row"))
            for k, i in enumerate(batch.column("i").to_pylist()):
                if i == now:
                    total = total + rows[k]
                    continue
                if now is not None:
                    yield pa.record_batch([pa.array([now], pa.int32()), pa.array([total])], ["i", "row"])
                now, total = i, rows[k]
        if now is not None:
            yield pa.record_batch([pa.array([now], pa.int32()), pa.array([total])], ["i", "row"])

    parts = distinct.select("x", "weight").mapInArrow(multiply, "i int, task int, row array<double>")
    summed = parts.repartition("i").sortWithinPartitions("i", "task").mapInArrow(
        add, "i int, row array<double>")
    rows = {r["i"]: r["row"] for r in summed.collect()}  # dims rows of dims numbers
    found = np.array([rows[i] for i in range(dims)]) / n
    return (found + found.T) / 2


def fit(distinct: DataFrame) -> Fit | None:
    """The mean and the components; None without vectors. ``distinct`` should be staged."""
    n, sums = weighted_sums(distinct)
    if not n or not sums:
        return None
    values, vectors = np.linalg.eigh(covariance(distinct, n, sums))
    values, vectors = values[::-1], vectors[:, ::-1]
    largest = np.abs(vectors).argmax(axis=0)
    vectors = vectors * np.sign(vectors[largest, np.arange(len(sums))])
    return Fit(n, sums, values, vectors, float(values.sum()))


def usable(model: Fit, components: int) -> int:
    """How many of the first components have a variance beyond rounding."""
    if model.values[0] <= 0:
        return 0
    least = model.values[0] * len(model.sums) * np.finfo(float).eps
    return int((model.values[:components] > least).sum())


def whiten(distinct: DataFrame, model: Fit, components: int = COMPONENTS) -> DataFrame:
    """(digest, weight, deviation, whitened) of each distinct vector."""
    k = usable(model, components)
    n, sums = model.n, model.sums
    mean = np.array([float(s) / n for s in sums])
    project = model.vectors[:, :k] / np.sqrt(model.values[:k])

    def deviations(x: np.ndarray) -> list[int | None]:
        most = max(abs(int(x.max())), abs(int(x.min())))
        if len(sums) * (n * most + max(map(abs, sums))) ** 2 < 1 << 62:
            return ((x * n - np.array(sums, dtype=np.int64)) ** 2).sum(axis=1).tolist()
        exact = [sum((n * v - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
        return [v if v < 1 << 63 else None for v in exact]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, x in blocks(batches):
            w = ((x - mean) @ project).reshape(-1)
            yield pa.record_batch(
                [part.column("digest"), part.column("weight"), pa.array(deviations(x), pa.int64()),
                 pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * k), pa.array(w))],
                ["digest", "weight", "deviation", "whitened"])

    return distinct.select("digest", "x", "weight").mapInArrow(
        run, "digest binary, weight bigint, deviation bigint, whitened array<double>")


def identity_error(white: DataFrame, k: int) -> float:
    """Largest absolute entry of the whitened vectors' weighted covariance minus the identity."""
    at = lambda i: F.col("whitened")[i]
    w = F.col("weight").cast("double")
    means = white.agg(F.sum(w).alias("n"), *[F.sum(w * at(i)).alias(f"m{i}") for i in range(k)]).first()
    mean = [means[f"m{i}"] / means["n"] for i in range(k)]
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    found = white.agg(*[F.sum(w * (at(i) - mean[i]) * (at(j) - mean[j])).alias(f"c{i}_{j}")
                        for i, j in pairs]).first()
    return max(abs(found[f"c{i}_{j}"] / means["n"] - (i == j)) for i, j in pairs)


def whitened_rows(rows: DataFrame, components: int = COMPONENTS, weights: str = "one",
                  scale: int = SCALE, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """One row per remaining row and component: vec_id, component, n, deviation, whitened,
    explained, identity_error."""
    spark = rows.sparkSession
    empty = spark.createDataFrame([], (
        f"vec_id {dict(rows.dtypes)[vec_id]}, component int, n bigint, deviation bigint, whitened double, "
        "explained double, identity_error double"))
    kept = integer_rows(rows, vec_id, vector, scale)
    distinct = stage(distinct_vectors(kept, weights), "distinct-vectors")
    model = fit(distinct)
    k = usable(model, components) if model else 0
    if not k:
        return empty
    white = stage(whiten(distinct, model, components), "white-vectors")
    error = identity_error(white, k)
    explained = F.array(*[F.lit(float(v / model.trace)) for v in model.values[:k]])
    back = kept.select("vec_id", "digest").join(
        broadcast_if_small(white.select("digest", "deviation", "whitened"), row_bytes=48 + 8 * k), "digest")
    return back.select("vec_id", "deviation", F.posexplode("whitened").alias("pos", "whitened")).select(
        "vec_id", (F.col("pos") + 1).alias("component"), F.lit(model.n).cast("bigint").alias("n"),
        "deviation", "whitened", explained[F.col("pos")].alias("explained"),
        F.lit(error).alias("identity_error"))
