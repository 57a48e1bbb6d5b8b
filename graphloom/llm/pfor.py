"""Patched frame-of-reference blocks of unsigned 32-bit numbers.

A block holds ``BLOCK`` numbers: an 8-byte head (least number, bit width, count of
outliers), the differences to the least number packed at the width, then the outliers'
positions and differences. The width is the cheapest of those that ``PERCENTILES`` of the
differences fit. All blocks of a call are worked on together, those of one width at a time.
"""

from __future__ import annotations

import numpy as np

BLOCK = 128
PERCENTILES = (50, 75, 90, 95, 98, 100)
HEAD = np.dtype([("least", "<u4"), ("width", "u1"), ("outliers", "u1"), ("unused", "<u2")])


def bit_length(x: np.ndarray) -> np.ndarray:
    exponent = x.astype(np.float64).view(np.uint64) >> np.uint64(52)  # 0 for 0
    return np.maximum(exponent.astype(np.int16) - 1022, 0).astype(np.uint8)


def encode(values: np.ndarray, percentiles: tuple[int, ...] = PERCENTILES) -> tuple[bytes, np.ndarray]:
    """The bytes of the blocks and the first byte of each; the last block is filled up."""
    if not len(values):
        return b"", np.zeros(0, np.int64)
    count = -(-len(values) // BLOCK)
    full = np.zeros(count * BLOCK, np.uint32)
    full[:len(values)] = values
    full[len(values):] = values[-1:]
    full = full.reshape(count, BLOCK)
    least = full.min(axis=1)
    above = full - least[:, None]
    bits = bit_length(above)
    ordered = np.sort(bits, axis=1)
    width, best = np.zeros(count, np.int64), np.full(count, np.iinfo(np.int64).max)
    for percent in percentiles:
        w = ordered[:, -(-percent * BLOCK // 100) - 1]
        left_out = (ordered > w[:, None]).sum(axis=1)
        cost = w.astype(np.int64) * (BLOCK // 8) + 5 * left_out
        width, best = np.where(cost < best, w, width), np.minimum(cost, best)
    outlier = bits > width[:, None]
    outliers = outlier.sum(axis=1)
    size = HEAD.itemsize + width * (BLOCK // 8) + 5 * outliers
    start = np.cumsum(size) - size
    out = np.zeros(int(size.sum()), np.uint8)
    head = np.zeros(count, HEAD)
    head["least"], head["width"], head["outliers"] = least, width, outliers
    out[start[:, None] + np.arange(HEAD.itemsize)] = head.view(np.uint8).reshape(count, -1)
    packed = np.where(outlier, 0, above)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        columns = np.ascontiguousarray(packed[rows].T).astype(np.uint64)
        words = np.zeros((BLOCK * w // 64, len(rows)), np.uint64)
        for j in range(BLOCK):
            k, shift = divmod(j * w, 64)
            words[k] |= columns[j] << np.uint64(shift)
            if shift + w > 64:
                words[k + 1] |= columns[j] >> np.uint64(64 - shift)
        data = np.ascontiguousarray(words.T).astype("<u8").view(np.uint8).reshape(len(rows), -1)
        out[(start[rows] + HEAD.itemsize)[:, None] + np.arange(data.shape[1])] = data
    row, column = np.nonzero(outlier)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(outliers) - outliers, outliers)
    first = start[row] + HEAD.itemsize + width[row] * (BLOCK // 8)
    out[first + rank] = column
    at = first + outliers[row] + 4 * rank
    out[at[:, None] + np.arange(4)] = above[row, column].astype("<u4").view(np.uint8).reshape(-1, 4)
    return out.tobytes(), start


def decode(data: np.ndarray, start: np.ndarray) -> np.ndarray:
    """All numbers of the blocks that begin at ``start`` in the bytes ``data``."""
    count = len(start)
    if not count:
        return np.zeros(0, np.uint32)
    start = start.astype(np.int64)
    head = np.ascontiguousarray(data[start[:, None] + np.arange(HEAD.itemsize)]).view(HEAD).reshape(count)
    width, outliers = head["width"].astype(np.int64), head["outliers"].astype(np.int64)
    out = np.zeros((count, BLOCK), np.uint32)
    for w in np.unique(width[width > 0]).tolist():
        rows = np.flatnonzero(width == w)
        where = (start[rows] + HEAD.itemsize)[:, None] + np.arange(BLOCK * w // 8)
        words = np.ascontiguousarray(np.ascontiguousarray(data[where]).view("<u8").T)
        mask = np.uint64((1 << w) - 1)
        columns = np.zeros((BLOCK, len(rows)), np.uint32)
        for j in range(BLOCK):
            k, shift = divmod(j * w, 64)
            x = words[k] >> np.uint64(shift)
            if shift + w > 64:
                x = x | words[k + 1] << np.uint64(64 - shift)
            columns[j] = x & mask
        out[rows] = columns.T
    row = np.repeat(np.arange(count), outliers)
    rank = np.arange(len(row)) - np.repeat(np.cumsum(outliers) - outliers, outliers)
    first = start[row] + HEAD.itemsize + width[row] * (BLOCK // 8)
    at = first + outliers[row] + 4 * rank
    values = np.ascontiguousarray(data[at[:, None] + np.arange(4)]).view("<u4").reshape(-1)
    out[row, data[first + rank]] = values
    return (out + head["least"][:, None]).reshape(-1)
