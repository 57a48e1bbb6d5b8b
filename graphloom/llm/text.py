"""Word and hash kernels on Arrow string columns.

The functions run inside tasks on one record batch at a time. A column is cut
into blocks of bounded size first (``blocks``), so the memory of a task follows
the block and its longest text, never the partition.

Words are maximal runs of bytes outside ``[\\x20\\x09-\\x0D]`` with A-Z lower-cased,
which is exactly ``text.encode().lower().split()``; a null text has no words.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 21

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser: every input bit reaches every output bit."""
    x = np.array(x, dtype=np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_BASE = np.uint64(0x2545F4914F6CDD1D)  # odd, hence invertible modulo 2**64
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _GOLDEN)
_LOWER_BYTE = _BYTE[_LOWER]


def powers(base: np.uint64, n: int) -> np.ndarray:
    """base**0 ... base**(n-1) modulo 2**64."""
    out = np.full(max(n, 1), base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)[:n]


def string_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its n + 1 offsets into them; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    n = len(column)
    buffers = column.buffers()
    if n == 0 or buffers[2] is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    offsets = np.frombuffer(buffers[1], dtype=np.int64)[column.offset:column.offset + n + 1]
    data = np.frombuffer(buffers[2], dtype=np.uint8)[offsets[0]:offsets[-1]]
    return data, offsets - offsets[0]


def blocks(column: pa.Array, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [i, j) whose texts hold about ``size`` bytes, one row at least."""
    _, offsets = string_bytes(column)
    n = len(column)
    i = 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + size, side="right")) - 1
        j = min(max(j, i + 1), n)
        yield i, j
        i = j


def word_hashes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words of all rows, and n + 1 offsets of the rows into them."""
    data, offsets = string_bytes(column)
    rows = len(offsets) - 1
    if len(data) == 0:
        return np.zeros(0, np.uint64), np.zeros(rows + 1, np.int64)
    word = ~_SPACE[data]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    ends = word.copy()
    ends[:-1] &= ~word[1:]
    first = offsets[:-1][offsets[:-1] < offsets[1:]]  # first bytes of non-empty rows
    begins[first] = word[first]
    before = first[first > 0] - 1
    ends[before] = word[before]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    weighted = np.zeros(len(data) + 1, dtype=np.uint64)
    np.multiply(_LOWER_BYTE[data], powers(_BASE, len(data)), out=weighted[1:])
    np.add.accumulate(weighted, out=weighted)
    hashes = (weighted[end] - weighted[start]) * powers(_INVERSE, len(data))[start]
    return mix(hashes + _GOLDEN), np.searchsorted(start, offsets)


def pair_hash(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """A hash of an ordered pair of hashes."""
    return mix(left * np.uint64(0xD6E8FEB86659FD93) + (right ^ _GOLDEN))
