"""Tables of texts as folders of files, one file per row.

Spark's own writers name their files themselves. Where the name matters, as in a folder of
Markdown documents or of API descriptions, every task writes its own rows through
``pyarrow.fs`` to the folder, which driver and executors must share.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WRITTEN = "rel_path string, n_bytes bigint"


def place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    """The file system of an address, and the path in it."""
    if "://" in uri:
        return pa.fs.FileSystem.from_uri(uri)
    return pa.fs.LocalFileSystem(), uri.removeprefix("file:")


def _checked(path: str | None) -> str:
    parts = (path or "").split("/")
    if not path or any(part in ("", ".", "..") for part in parts):
        raise ValueError(f"not a relative path of a file: {path!r}")
    return path


def write_text_files(rows: DataFrame, root: str, path: str = "rel_path",
                     text: str = "text") -> DataFrame:
    """One UTF-8 file per row under ``root``; returns (rel_path, n_bytes), lazily.

    The files are written when the result is computed. A file appears under its name only
    when it is whole, and a task that runs again writes the same files. A null text is an
    empty file; a null, empty, absolute or climbing path raises an error; paths must be
    unique, as of rows that share one the last one written stays. Other columns are ignored.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = place(root.rstrip("/"))
        made: set[str] = set()
        for batch in batches:
            paths, sizes = [], []
            for name, value in zip(*(column.to_pylist() for column in batch.columns), strict=True):
                folder, _, file = f"{base}/{_checked(name)}".rpartition("/")
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                data = (value or "").encode()
                part = f"{folder}/.{uuid.uuid4().hex}"
                with system.open_output_stream(part) as sink:
                    sink.write(data)
                system.move(part, f"{folder}/{file}")
                paths.append(name)
                sizes.append(len(data))
            yield pa.RecordBatch.from_arrays(
                [pa.array(paths, pa.string()), pa.array(sizes, pa.int64())], ["rel_path", "n_bytes"])

    return rows.select(F.col(f"`{path}`"), F.col(f"`{text}`")).mapInArrow(write, WRITTEN)


def write_files_now(rows: DataFrame, root: str, path: str = "rel_path",
                    text: str = "text") -> tuple[int, int]:
    """Write the files and return how many there are, and their bytes."""
    written = write_text_files(rows, root, path, text)
    files, size = written.agg(F.count(F.lit(1)), F.coalesce(F.sum("n_bytes"), F.lit(0))).first()
    return files, size
