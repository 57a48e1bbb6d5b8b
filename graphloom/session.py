"""Session settings and durable cut points.

Nothing here starts a cluster; the caller owns the session. ``configure`` only
sets runtime SQL options, and the staging helpers write to the shared folder the
cluster names in ``spark.checkpoint.dir``.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

# Runtime options the library relies on. AQE re-plans from measured shuffle
# sizes: it splits the partitions of a hot join key and turns a join into a
# broadcast join only when the measured side is small.
RUNTIME_OPTIONS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    # Shuffles begin with this many partitions, and AQE puts small ones together: a task's
    # share of a large table is then set by its size, not by spark.sql.shuffle.partitions.
    "spark.sql.adaptive.coalescePartitions.initialPartitionNum": "512",
    # Small files count as 4 MB each when tasks are made, 32 files a task; many of them get
    # more a task beyond this number. Files of 128 MB and more reach it at half a terabyte.
    "spark.sql.files.maxPartitionNum": "4096",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


# AQE puts shuffled partitions together up to this size. Rows in a sort take some 30 times
# their shuffled bytes, so that Spark's own 64 MB would spill; smaller settings are kept.
ADVISORY = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
ADVISORY_MOST = "16m"

# While tables are sorted and written: their readers make tasks of this many stored bytes, so that
# what a task sends fits its memory, and shuffled files go once the table they were for is there.
SPLIT = "spark.sql.files.maxPartitionBytes"
SPLIT_MOST = "8m"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_STAGED: list[str] = []


def configure(spark: SparkSession) -> SparkSession:
    for key, value in RUNTIME_OPTIONS.items():
        spark.conf.set(key, value)
    if bytes_of(spark.conf.get(ADVISORY)) > bytes_of(ADVISORY_MOST):
        spark.conf.set(ADVISORY, ADVISORY_MOST)
    return spark


def bytes_of(text: str) -> int:
    """A size as Spark's settings write it, such as ``64m``."""
    units = {"b": 1, "k": 1 << 10, "kb": 1 << 10, "m": 1 << 20, "mb": 1 << 20,
             "g": 1 << 30, "gb": 1 << 30}
    digits = text.rstrip("bBkKmMgG")
    return int(digits) * units.get(text[len(digits):].lower(), 1)


@contextmanager
def sorting(spark: SparkSession) -> Iterator[None]:
    """Settings for steps that sort and write one large table after another."""
    before = {key: spark.conf.get(key, None) for key in (SPLIT, CLEANUP)}
    if bytes_of(spark.conf.get(SPLIT)) > bytes_of(SPLIT_MOST):
        spark.conf.set(SPLIT, SPLIT_MOST)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder for durable intermediate data.

    It comes from the session. Only a local-mode session without the setting gets
    a private temporary folder; on a cluster a missing setting is an error, since
    a machine-local folder is lost together with its executor.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = context.getCheckpointDir()
    if configured:
        if not current:
            context.setCheckpointDir(configured)
        return configured
    if current:
        return current
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="graphloom-ckpt-")
    context.setCheckpointDir(folder)
    return context.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably and cut its lineage (for iterative operators)."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder and read it back.

    Unlike a checkpoint the result is columnar: every later reader prunes to the
    columns it needs, so wide text columns are not read for narrow questions.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark).rstrip('/')}/stage-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _STAGED.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession, since: int = 0) -> int:
    """Delete what was staged after the first ``since`` tables; returns how many remain.

    For callers that have written their results: frames read from the deleted tables are
    of no use any more.
    """
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    while len(_STAGED) > since:
        path = spark._jvm.org.apache.hadoop.fs.Path(_STAGED.pop())
        path.getFileSystem(conf).delete(path, True)
    return len(_STAGED)


def staged() -> int:
    """How many staged tables there are now, to give to :func:`release` later."""
    return len(_STAGED)
