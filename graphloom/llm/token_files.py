"""Token ids of all texts in binary files, and back.

``write_tokens`` cuts the documents into ranges of ascending ids, one file per range; each
task encodes its texts and appends their ids to its file, so a document's ids are one run of
the ids of all files in order. A file holds

* blocks of 128 ids as patched frames of reference (:mod:`graphloom.llm.pfor`), regardless of
  where documents end,
* the documents (id, count of ids) as a compressed Arrow stream,
* the first byte of every block (unsigned 64-bit), and a fixed-size tail that finds the rest.

A reader finds the block of any position from the index and decodes only what it needs;
``read_tokens`` reads all files, a bounded number of ids at a time.

A task writes under a name of its own and renames the file when it is whole, so a task that
runs again after an executor was lost replaces equal bytes by equal bytes. Files are reached
through ``pyarrow.fs`` under the given folder, which driver and executors must share.

Defined cases: a null text is empty and gives the end id alone; null document ids come
first; rows with equal ids follow each other in the order of their texts' hashes; an empty
table gives no file and no rows; columns besides id and text are ignored. Strings of special
tokens in a text are encoded as ordinary text.
"""

from __future__ import annotations

import io
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphloom.llm import pfor
from graphloom.llm.text import blocks
from graphloom.llm.token_coder import coder
from graphloom.session import checkpoint_dir, stage

END = 2
#: Bytes of input rows per file, roughly; and ids that are packed or unpacked at once.
FILE_BYTES = 128 << 20
CHUNK = 1 << 19
TAIL = "<QQQQ8s"  # ids, first byte of the documents, of the index, blocks, mark
MARK = b"PFORIDS1"
MANIFEST = "part int, file string, n_docs bigint, n_ids bigint, n_bytes bigint"


def place(uri: str) -> tuple[pa.fs.FileSystem, str]:
    if "://" in uri:
        return pa.fs.FileSystem.from_uri(uri)
    return pa.fs.LocalFileSystem(), uri.removeprefix("file:")


class Writer:
    """One file; ids are packed as soon as a chunk is full."""

    def __init__(self, sink):
        self.sink, self.at, self.n_ids = sink, 0, 0
        self.waiting: list[np.ndarray] = []
        self.waits = 0
        self.starts: list[np.ndarray] = []
        self.docs: list[pa.RecordBatch] = []

    def put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_ids: pa.Array, ids: list[np.ndarray]) -> None:
        sizes = np.array([len(x) for x in ids], dtype=np.int64)
        self.docs.append(pa.record_batch([doc_ids, pa.array(sizes)], ["doc_id", "n_ids"]))
        self.waiting += ids
        self.waits += int(sizes.sum())
        if self.waits >= CHUNK:
            self.pack(self.waits - self.waits % pfor.BLOCK)

    def pack(self, count: int) -> None:
        every = np.concatenate(self.waiting)
        for i in range(0, count, CHUNK):
            data, start = pfor.encode(every[i:min(i + CHUNK, count)])
            self.starts.append(start + self.at)
            self.put(data)
        self.n_ids += count
        self.waiting, self.waits = [every[count:]], len(every) - count

    def close(self) -> tuple[int, int, int]:
        if self.waits:
            self.pack(self.waits)
        docs_at, out = self.at, io.BytesIO()
        with pa.ipc.new_stream(out, self.docs[0].schema,
                               options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
            for batch in self.docs:
                stream.write_batch(batch)
        self.put(out.getvalue())
        index_at, index = self.at, np.concatenate(self.starts).astype("<u8")
        self.put(index.tobytes())
        self.put(struct.pack(TAIL, self.n_ids, docs_at, index_at, len(index), MARK))
        return sum(b.num_rows for b in self.docs), self.n_ids, self.at


class Reader:
    """Random access to the ids of one file."""

    def __init__(self, source):
        self.source = source
        size = source.size()
        length = struct.calcsize(TAIL)
        tail = struct.unpack(TAIL, source.read_at(length, size - length))
        self.n_ids, docs_at, index_at, count, mark = tail
        if mark != MARK:
            raise ValueError("not a file of token ids")
        self.docs = pa.ipc.open_stream(source.read_at(index_at - docs_at, docs_at)).read_all()
        index = np.frombuffer(source.read_at(8 * count, index_at), "<u8")
        self.starts = np.append(index, docs_at).astype(np.int64)

    def ids(self, first: int, last: int) -> np.ndarray:
        """The ids at positions first to last - 1."""
        i, j = first // pfor.BLOCK, -(-last // pfor.BLOCK)
        if i >= j:
            return np.zeros(0, np.uint32)
        begin = self.starts[i]
        data = np.frombuffer(self.source.read_at(self.starts[j] - begin, begin), np.uint8)
        return pfor.decode(data, self.starts[i:j] - begin)[first - i * pfor.BLOCK:last - i * pfor.BLOCK]


def write_tokens(docs: DataFrame, folder: str, tokenizer: str, end: int = END,
                 doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Write all texts' ids under ``folder``; returns the files (part, file, n_docs, n_ids, n_bytes).

    ``tokenizer`` is a file of the tokenizers library that is present on every machine.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_id}`").alias("doc_id"),
                       F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    size = int(str(rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    files = max(int(spark.conf.get("spark.sql.shuffle.partitions")),
                min(1 + size // FILE_BYTES, 1 << 20))
    # The hash lets rows of one repeated id spread over files.
    dealt = rows.withColumn("tie", F.xxhash64("text")).repartitionByRange(
        files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        part, code = context.partitionId(), coder(tokenizer)
        fs, base = place(folder)
        final = f"{base}/part-{part:06d}.ids"
        own = f"{base}/.part-{part:06d}-{context.taskAttemptId()}-{uuid.uuid4().hex}"
        writer, sink = None, None
        last = np.array([end], np.uint32)
        for batch in batches:
            for i, j in blocks(batch.column("text")):
                if writer is None:
                    fs.create_dir(base, recursive=True)
                    sink = fs.open_output_stream(own)
                    writer = Writer(sink)
                found = code.encode(batch.column("text")[i:j].to_pylist())
                writer.add(batch.column("doc_id")[i:j], [np.append(x, last) for x in found])
        if writer is not None:
            n_docs, n_ids, n_bytes = writer.close()
            sink.close()
            fs.move(own, final)
            yield pa.record_batch([pa.array([part], pa.int32()), pa.array([f"part-{part:06d}.ids"]),
                                   pa.array([n_docs]), pa.array([n_ids]), pa.array([n_bytes])],
                                  ["part", "file", "n_docs", "n_ids", "n_bytes"])

    return stage(dealt.select("doc_id", "text").mapInArrow(write, MANIFEST), "token-files")


def read_tokens(spark: SparkSession, files: DataFrame, folder: str,
                id_type: str = "bigint") -> DataFrame:
    """(doc_id, start, n_tokens, ids) of all documents; ``ids`` are little-endian unsigned
    32-bit numbers, ``start`` counts the ids of all documents before. ``files`` is what
    ``write_tokens`` returned."""
    # One row per file: the window is as long as the list of files.
    order = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = files.select("file", F.coalesce(F.sum("n_ids").over(order), F.lit(0)).alias("before"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = place(folder)
        for batch in batches:
            for row in batch.to_pylist():
                with fs.open_input_file(f"{base}/{row['file']}") as source:
                    yield from documents(Reader(source), row["before"])

    def documents(reader: Reader, before: int) -> Iterator[pa.RecordBatch]:
        doc_id = reader.docs.column("doc_id").combine_chunks()
        size = reader.docs.column("n_ids").to_numpy()
        stop = np.cumsum(size)
        start = stop - size
        i = 0
        while i < len(size):
            j = max(i + 1, int(np.searchsorted(stop, start[i] + CHUNK, side="right")))
            ids = reader.ids(int(start[i]), int(stop[j - 1])).astype("<u4")
            offsets = np.append(start[i:j], stop[j - 1]) - start[i]
            data = pa.LargeBinaryArray.from_buffers(
                pa.large_binary(), j - i, [None, pa.py_buffer(4 * offsets), pa.py_buffer(ids)])
            yield pa.record_batch(
                [doc_id[i:j], pa.array(start[i:j] + before), pa.array(size[i:j]), data.cast(pa.binary())],
                ["doc_id", "start", "n_tokens", "ids"])
            i = j

    count = max(files.count(), 1)
    return before.repartition(count).mapInArrow(
        read, f"doc_id {id_type}, start bigint, n_tokens bigint, ids binary")


def token_folder(spark: SparkSession) -> str:
    """A new folder for token files in the session's shared folder."""
    return f"{checkpoint_dir(spark).rstrip('/')}/tokens-{uuid.uuid4().hex}"
