"""A table of the latest rows of each key, brought forward batch by batch.

A batch names the keys it changes and gives their new rows; a key without rows is deleted.
Nothing that was written before is touched: a batch adds a *delta*, and readers put the
newest rows of every key together. When enough deltas have gathered they are folded into a
new *base*, so what a reader reads is bounded by the live rows and a fixed number of deltas,
however many batches there were.

* ``rows/base=N`` holds all rows after batch N, ``rows/delta=N`` the new rows of batch N.
* ``marks/delta=N`` holds the keys that batch N changed; it is what replaces older rows.

Both are partitioned by a hash of ``bucket_by``, so a reader who looks for some values reads
their buckets only. A batch that is run again overwrites its own delta and reads only what
was there before it, so it has the same effect once; the base before the newest one and the
deltas after it are kept for that.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphloom.operators.skew import skewed_join

BUCKETS = 64
#: Deltas that readers merge before they are folded into a base.
MOST_DELTAS = 8


def bucket_of(columns: Sequence[str], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(buckets)).cast("int")


class StateTable:
    """The table under ``path`` with the columns of ``layout``.

    ``key`` are the columns whose rows a batch replaces together; several rows may share a
    key. ``bucket_by`` (the key if not given) are the columns readers look for.
    """

    def __init__(self, spark: SparkSession, path: str, layout: T.StructType, key: Sequence[str],
                 bucket_by: Sequence[str] | None = None, buckets: int = BUCKETS,
                 most_deltas: int = MOST_DELTAS) -> None:
        self.spark, self.path, self.layout = spark, path, layout
        self.key, self.bucket_by = list(key), list(bucket_by or key)
        self.buckets, self.most_deltas = buckets, most_deltas

    # -- files

    def _numbers(self, part: str, kind: str) -> list[int]:
        """The batches whose ``kind`` is complete, in order."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        root = hadoop.Path(f"{self.path}/{part}")
        fs = root.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(root):
            return []
        names = [status.getPath() for status in fs.listStatus(root)]
        return sorted(int(p.getName().split("=")[1]) for p in names
                      if p.getName().startswith(f"{kind}=") and fs.exists(hadoop.Path(p, "_SUCCESS")))

    def _delete(self, name: str) -> None:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

    def _load(self, names: list[str], layout: T.StructType) -> DataFrame:
        """All rows of some folders with the number of their batch."""
        found = None
        for name in names:
            number = int(name.split("=")[1])
            df = self.spark.read.schema(T.StructType([*layout.fields, T.StructField(
                "_bucket", T.IntegerType())])).parquet(f"{self.path}/{name}").withColumn(
                "_batch", F.lit(number).cast("bigint"))
            found = df if found is None else found.unionByName(df)
        return found

    def _save(self, df: DataFrame, name: str, bucket_by: Sequence[str]) -> None:
        """One file per bucket at most: rows are dealt by bucket, a hot bucket is split by AQE."""
        df.withColumn("_bucket", bucket_of(bucket_by, self.buckets)).hint(
            "rebalance", "_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(
            f"{self.path}/{name}")

    # -- reading

    def last_batch(self) -> int | None:
        numbers = self._numbers("marks", "delta") + self._numbers("rows", "base")
        return max(numbers, default=None)

    def parts(self, before: int | None = None) -> tuple[int | None, list[int]]:
        """The base and the later deltas that make up the state before a batch."""
        within = (lambda n: True) if before is None else (lambda n: n < before)
        base = max(filter(within, self._numbers("rows", "base")), default=None)
        deltas = [n for n in self._numbers("marks", "delta")
                  if within(n) and (base is None or n > base)]
        return base, deltas

    def read(self, before: int | None = None, wanted: DataFrame | None = None) -> DataFrame:
        """The rows after all batches, or those before batch ``before``.

        ``wanted`` (the columns of ``bucket_by``) restricts the result to some values and the
        files to their buckets.
        """
        base, deltas = self.parts(before)
        kept = None
        rows = self._load([*([f"rows/base={base}"] if base is not None else []),
                           *[f"rows/delta={n}" for n in deltas]], self.layout)
        if rows is None:
            return self.spark.createDataFrame([], self.layout)
        if wanted is not None:
            found = wanted.select(bucket_of(self.bucket_by, self.buckets).alias("b")).distinct().collect()
            rows = rows.filter(F.col("_bucket").isin([r["b"] for r in found]))  # at most ``buckets``
            rows = skewed_join(rows, wanted.select(*self.bucket_by).distinct(), self.bucket_by, "left_semi")
        # The oldest part replaces nothing.
        later = deltas if base is not None else deltas[1:]
        if later:
            marks = self._load([f"marks/delta={n}" for n in later], self._key_layout())
            newest = marks.groupBy(*self.key).agg(F.max("_batch").alias("_newest"))
            kept = rows.join(newest, self.key, "left").filter(
                F.col("_newest").isNull() | (F.col("_newest") <= F.col("_batch")))
        return (rows if kept is None else kept).select(*self.layout.fieldNames())

    def delta(self, batch: int) -> DataFrame:
        """The rows that a batch wrote."""
        return self._load([f"rows/delta={batch}"], self.layout).select(*self.layout.fieldNames())

    def _key_layout(self) -> T.StructType:
        return T.StructType([self.layout[c] for c in self.key])

    # -- writing

    def write(self, batch: int, rows: DataFrame, keys: DataFrame) -> None:
        """Replace the rows of ``keys`` by ``rows``, as batch number ``batch``."""
        for number in self._numbers("rows", "base"):
            if number >= batch:  # of an earlier try of this batch
                self._delete(f"rows/base={number}")
        self._save(rows.select(*self.layout.fieldNames()), f"rows/delta={batch}", self.bucket_by)
        # Marks come last: a delta without complete marks is not there.
        self._save(keys.select(*self.key).distinct(), f"marks/delta={batch}", self.key)
        if len(self.parts()[1]) >= self.most_deltas:
            self.compact()

    def compact(self) -> None:
        """Fold the deltas into a new base and delete what no reader needs any more."""
        older, deltas = self.parts()
        if not deltas:
            return
        self._save(self.read(), f"rows/base={deltas[-1]}", self.bucket_by)
        for number in self._numbers("rows", "base"):
            if older is not None and number < older:
                self._delete(f"rows/base={number}")
        for number in self._numbers("marks", "delta"):
            if older is not None and number <= older:
                self._delete(f"marks/delta={number}")
                self._delete(f"rows/delta={number}")
