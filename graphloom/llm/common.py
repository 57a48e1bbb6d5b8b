"""Small helpers that several operators share."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import configure

#: A side of a join is broadcast only when its counted rows times this width stay below the bound.
BROADCAST_BYTES = 8 << 20
ROW_BYTES = 64


def prepare(spark: SparkSession) -> None:
    """Session options for jobs that hand texts to Python: few rows to an Arrow batch,
    since a text can be long."""
    configure(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(16 << 20))


def broadcast_if_small(df: DataFrame, rows: int | None = None,
                       row_bytes: int = ROW_BYTES) -> DataFrame:
    """Hint a broadcast when the counted rows are few; otherwise the join shuffles and AQE
    splits its hot partitions. ``df`` should be staged, as counting it is an action."""
    n = df.count() if rows is None else rows
    return F.broadcast(df) if n * row_bytes <= BROADCAST_BYTES else df


def crc(column: Column) -> Column:
    """Unsigned CRC-32 of a value's text; null counts as empty."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary"))


def fresh(df: DataFrame, name: str) -> str:
    """A column name like ``name`` that ``df`` does not have; names ignore case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pick(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Only the named columns, so that columns the caller adds cannot clash."""
    return df.select(*[F.col(f"`{c}`") for c in columns])
