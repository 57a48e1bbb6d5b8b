"""Folders of very many files, listed and read by tasks.

Spark's file sources list a folder on the driver and keep about a kilobyte of its memory for
every file. Here tasks list the folders, level by level, through ``pyarrow.fs``; paths are
staged as a table, and no path reaches the driver.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.session import stage
from graphloom.sinks.files import place

#: A folder with more files is read by :func:`read_files`; others are left to Spark's sources.
MANY_FILES = 10_000
#: Files and folders that one task reads or lists, until there are 4,096 tasks.
FILES_A_TASK, FOLDERS_A_TASK = 2_000, 200
_BATCH_ROWS, _BATCH_BYTES = 10_000, 4 << 20


def _hidden(name: str) -> bool:
    """What Spark's file sources pass over."""
    if name.startswith(("_metadata", "_common_metadata")):
        return False
    return name.startswith(".") or (name.startswith("_") and "=" not in name) or name.endswith("._COPYING_")


def _entries(system: pa.fs.FileSystem, folder: str) -> Iterator[tuple[str, bool]]:
    """(name, whether a folder) of a folder's entries; a local folder is never held as a whole."""
    if isinstance(system, pa.fs.LocalFileSystem):
        with os.scandir(folder) as entries:
            for entry in entries:
                yield entry.name, entry.is_dir()
    else:
        for info in system.get_file_info(pa.fs.FileSelector(folder)):
            yield info.base_name, info.type == pa.fs.FileType.Directory


def _listed(folders: DataFrame, root: str) -> DataFrame:
    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = place(root)
        for batch in batches:
            paths: list[str] = []
            kinds: list[bool] = []
            for folder in batch.column(0).to_pylist():
                for name, inner in _entries(system, f"{base}/{folder}".rstrip("/")):
                    if _hidden(name):
                        continue
                    paths.append(f"{folder}/{name}" if folder else name)
                    kinds.append(inner)
                    if len(paths) == _BATCH_ROWS:
                        yield pa.record_batch([pa.array(paths, pa.string()), pa.array(kinds)], ["rel_path", "folder"])
                        paths, kinds = [], []
            yield pa.record_batch(
                [pa.array(paths, pa.string()), pa.array(kinds, pa.bool_())], ["rel_path", "folder"])

    return folders.mapInArrow(entries, "rel_path string, folder boolean")


def _dealt(paths: DataFrame, n: int, a_task: int) -> DataFrame:
    cores = paths.sparkSession.sparkContext.defaultParallelism
    return paths.repartition(max(1, min(n, max(cores, min(4096, -(-n // a_task))))), "rel_path")


def folder_of(spark: SparkSession, root: str) -> str | None:
    """The folder as ``pyarrow.fs`` knows it; None for patterns, files and stores it does not reach."""
    if re.search(r"[*?\[\]{}]", root):
        return None
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    try:
        uri = path.getFileSystem(conf).makeQualified(path).toString().rstrip("/")
        system, base = place(uri)
        return uri if system.get_file_info(base).type == pa.fs.FileType.Directory else None
    except (OSError, pa.ArrowException):
        return None


def list_files(spark: SparkSession, root: str, suffix: str) -> DataFrame:
    """(rel_path) of all files below a folder whose names end in ``suffix``, staged."""
    folders, n, levels = spark.createDataFrame([("",)], "rel_path string"), 1, []
    while n:
        found = stage(_listed(_dealt(folders, n, FOLDERS_A_TASK), root), "listing")
        levels.append(found.filter(~F.col("folder") & F.endswith("rel_path", F.lit(suffix))).select("rel_path"))
        folders = found.filter("folder").select("rel_path")
        n = folders.count()
    return reduce(DataFrame.union, levels)


def read_files(files: DataFrame, root: str, n: int) -> DataFrame:
    """(rel_path, content) of files that :func:`list_files` found; empty ones are left out."""
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = place(root)
        layout = pa.schema([("rel_path", pa.string()), ("content", pa.binary())])
        paths: list[str] = []
        contents: list[bytes] = []
        size = 0
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with system.open_input_stream(f"{base}/{path}", compression=None) as source:
                    content = source.read()
                if not content:
                    continue
                paths.append(path)
                contents.append(content)
                size += len(content)
                if size >= _BATCH_BYTES:
                    yield pa.record_batch([pa.array(paths), pa.array(contents, pa.binary())], layout)
                    paths, contents, size = [], [], 0
        yield pa.record_batch([pa.array(paths, pa.string()), pa.array(contents, pa.binary())], layout)

    return _dealt(files, n, FILES_A_TASK).mapInArrow(read, "rel_path string, content binary")
