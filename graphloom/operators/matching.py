"""Many patterns looked for in many texts at once, as numpy arrays inside tasks.

Texts and patterns are UTF-8 bytes. Every place of a text is looked up, not every pattern: the
time is in proportion to the bytes of the texts and what they hold, hardly to the number of
patterns. Patterns of up to eight bytes are compared as numbers. Longer ones are found by their
first eight bytes and a hash of the whole, and then compared byte by byte.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa

#: Bytes of text that are looked at together, so that the arrays stay in a core's cache.
PIECE = 1 << 17
#: Texts and patterns found in a piece are marked in a table up to this size.
TABLE = 1 << 22

_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)
_MIX = np.uint64(0xD6E8FEB86659FD93)
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)


def bytes_and_bounds(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of an array of texts, with eight zeros behind them, and where each text begins and ends."""
    values = values.cast(pa.large_string()) if pa.types.is_string(values.type) else values
    if values.null_count:
        values = values.fill_null("")
    bounds = np.frombuffer(values.buffers()[1], np.int64)[values.offset:values.offset + len(values) + 1]
    data = values.buffers()[2]
    held = np.zeros(int(bounds[-1] - bounds[0]) + 8, np.uint8)
    if data is not None and len(held) > 8:
        held[:-8] = np.frombuffer(data, np.uint8)[bounds[0]:bounds[-1]]
    return held, bounds - bounds[0]


def words_at_every_byte(held: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number; ``held`` has eight more bytes at its end."""
    return np.ascontiguousarray(np.ndarray((len(held) - 8,), "<u8", held, strides=(1,)))


def gram_slots(words: np.ndarray, n: int, slots: int) -> np.ndarray:
    """The slots, of a power of two, of the first ``n`` bytes of numbers of eight bytes."""
    grams = ((words & _MASKS[n]) + np.uint64(n)) * np.uint64(_BASE)
    return ((grams ^ (grams >> np.uint64(29))) * _MIX >> np.uint64(65 - slots.bit_length())).view(np.int64)


class _Numbers:
    """Distinct 64-bit numbers, looked up in arrays: the place in the sorted numbers, or absent."""

    def __init__(self, numbers: np.ndarray) -> None:
        self.sorted = np.unique(numbers)
        bits = min(22, max(12, int(len(self.sorted) * 16).bit_length()))
        self.shift = np.uint64(64 - bits)
        self.marks = np.zeros(1 << bits, bool)
        self.marks[self._slot(self.sorted)] = True

    @classmethod
    def of(cls, tables: dict[str, Any]) -> _Numbers:
        out = cls.__new__(cls)
        vars(out).update(tables)
        return out

    def _slot(self, numbers: np.ndarray) -> np.ndarray:
        return ((numbers ^ (numbers >> np.uint64(29))) * _MIX >> self.shift).view(np.int64)

    def find(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places in ``numbers``, places in the sorted numbers) of those that are there."""
        at = np.flatnonzero(self.marks[self._slot(numbers)])
        wanted = numbers[at]
        found = np.searchsorted(self.sorted, wanted)
        there = self.sorted[np.minimum(found, len(self.sorted) - 1)] == wanted
        return at[there], found[there]


def _spans(starts: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each span its number, repeated, and the places of the span."""
    owner = np.repeat(np.arange(len(counts)), counts)
    first = np.cumsum(counts) - counts
    return owner, np.arange(len(owner)) - first[owner] + starts[owner]


class Patterns:
    """Distinct, non-empty patterns, known by their place in the array they came in."""

    def __init__(self, patterns: pa.Array) -> None:
        self.data, bounds = bytes_and_bounds(patterns)
        self.starts, self.lengths = bounds[:-1], np.diff(bounds)
        self.n, self.longest = len(self.lengths), int(self.lengths.max(initial=0))
        first = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))[self.starts]
        first = first & _MASKS[np.minimum(self.lengths, 8)]
        self.short: list[tuple[int, _Numbers, np.ndarray]] = []
        for n in range(1, 9):
            which = np.flatnonzero(self.lengths == n)
            if len(which):
                self.short.append((n, _Numbers(first[which]), which[np.argsort(first[which])]))
        # Places that may begin a pattern of more than four bytes, and of more than eight.
        self.heads = _Numbers(first[self.lengths > 4] & _MASKS[4])
        long = np.flatnonzero(self.lengths > 8)
        self.long = _Numbers(first[long])
        # The distinct lengths of the patterns that share their first eight bytes.
        pairs = np.unique(np.stack([np.searchsorted(self.long.sorted, first[long]), self.lengths[long]], 1), axis=0)
        self.of_head = np.searchsorted(pairs[:, 0], np.arange(len(self.long.sorted) + 1))
        self.long_lengths = pairs[:, 1]
        whole = self._hash_of_patterns(long)
        order = np.argsort(whole, kind="stable")
        self.whole, self.long_patterns = whole[order], long[order]

    def tables(self) -> dict[str, Any]:
        """The arrays alone, which workers can read without this module."""
        return {**vars(self), "short": [(n, vars(x), which) for n, x, which in self.short],
                "heads": vars(self.heads), "long": vars(self.long)}

    @classmethod
    def of(cls, tables: dict[str, Any]) -> Patterns:
        out = cls.__new__(cls)
        vars(out).update(tables, heads=_Numbers.of(tables["heads"]), long=_Numbers.of(tables["long"]),
                         short=[(n, _Numbers.of(x), which) for n, x, which in tables["short"]])
        return out

    def _hash_of_patterns(self, which: np.ndarray) -> np.ndarray:
        """The sum of (byte + 1) x base^place over a pattern, mixed with its length."""
        lengths, starts = self.lengths[which], self.starts[which]
        total, power = np.zeros(len(which), np.uint64), 1
        for k in range(int(min(lengths.max(initial=0), 64))):
            inside = np.flatnonzero(lengths > k)
            total[inside] += (self.data[starts[inside] + k].astype(np.uint64) + np.uint64(1)) * np.uint64(power)
            power = power * _BASE % (1 << 64)
        rest = np.flatnonzero(lengths > 64)
        if len(rest):
            powers = self._powers(_BASE, int(lengths.max()))
            for i in rest:
                tail = self.data[starts[i] + 64:starts[i] + lengths[i]].astype(np.uint64) + np.uint64(1)
                total[i:i + 1] += np.sum(tail * powers[64:lengths[i]], dtype=np.uint64)
        return total + lengths.astype(np.uint64) * _MIX

    @staticmethod
    def _powers(base: int, n: int) -> np.ndarray:
        out = np.full(n, base, np.uint64)
        if n:
            out[0] = 1
        return np.multiply.accumulate(out)

    def _places(self, held: np.ndarray, powers: np.ndarray, inverses: np.ndarray) -> Iterator[
            tuple[np.ndarray, np.ndarray]]:
        """(places, patterns): where patterns occur in ``held``, ends of texts aside."""
        words = words_at_every_byte(held)
        heads = None
        for n, numbers, which in self.short:
            if n <= 4:
                at, found = numbers.find(words & _MASKS[n])
                yield at, which[found]
                continue
            if heads is None:
                heads = self.heads.find(words & _MASKS[4])[0]
            at, found = numbers.find(words[heads] & _MASKS[n])
            yield heads[at], which[found]
        if not len(self.long_patterns):
            return
        if heads is None:
            heads = self.heads.find(words & _MASKS[4])[0]
        at, head = self.long.find(words[heads])
        at = heads[at]
        if not len(at):
            return
        owner, pair = _spans(self.of_head[head], self.of_head[head + 1] - self.of_head[head])
        at, lengths = at[owner], self.long_lengths[pair]
        inside = at + lengths <= len(words)
        at, lengths = at[inside], lengths[inside]
        sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum((held[:len(words)].astype(np.uint64) + np.uint64(1)) * powers[:len(words)], out=sums[1:])
        whole = (sums[at + lengths] - sums[at]) * inverses[at] + lengths.astype(np.uint64) * _MIX
        first = np.searchsorted(self.whole, whole)
        owner, found = _spans(first, np.searchsorted(self.whole, whole, "right") - first)
        at, which = at[owner], self.long_patterns[found]
        same = self.lengths[which] == lengths[owner]
        at, which = at[same], which[same]
        same = self._equal(held, at, which)
        yield at[same], which[same]

    def _equal(self, held: np.ndarray, at: np.ndarray, which: np.ndarray) -> np.ndarray:
        """Whether the pattern stands at the place, byte by byte."""
        starts, lengths = self.starts[which], self.lengths[which]
        texts = np.ndarray((len(held) - 7,), "<u8", held, strides=(1,))
        own = np.ndarray((len(self.data) - 7,), "<u8", self.data, strides=(1,))
        same = np.ones(len(at), bool)
        for k in range(0, int(min(lengths.max(initial=0), 256)), 8):
            left = np.flatnonzero(same & (lengths > k))
            mask = _MASKS[np.minimum(lengths[left] - k, 8)]
            same[left] = (texts[at[left] + k] & mask) == (own[starts[left] + k] & mask)
        for i in np.flatnonzero(same & (lengths > 256)):
            same[i] = np.array_equal(held[at[i]:at[i] + lengths[i]], self.data[starts[i]:starts[i] + lengths[i]])
        return same

    def within(self, texts: pa.Array) -> pa.Array:
        """For each text the patterns that occur in it, each once, in ascending order."""
        held, bounds = bytes_and_bounds(texts)
        piece = max(PIECE, 4 * self.longest)
        powers, inverses = self._powers(_BASE, piece), self._powers(_INVERSE, piece)
        owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        i = 0
        while self.n and i < len(texts):
            # Whole texts up to a piece, or the pieces of one long text, which overlap.
            end = max(i + 1, int(np.searchsorted(bounds, bounds[i] + piece, "right")) - 1)
            start, stop = int(bounds[i]), int(bounds[end])
            keys = []
            for begin in range(start, max(stop, start + 1), piece - self.longest + 1):
                part = held[begin:min(begin + piece, stop) + 8]
                for at, which in self._places(part, powers, inverses):
                    at = at + begin
                    text = np.searchsorted(bounds[i + 1:end + 1], at, "right")
                    fits = at + self.lengths[which] <= bounds[i + 1:end + 1][text]
                    keys.append((text * self.n + which)[fits])
                if begin + piece >= stop:
                    break
            keys = np.concatenate(keys) if keys else np.zeros(0, np.int64)
            if (end - i) * self.n <= max(TABLE, 8 * len(keys)):
                marks = np.zeros((end - i) * self.n, bool)
                marks[keys] = True
                keys = np.flatnonzero(marks)
            else:
                keys = np.unique(keys)
            owners.append(keys // self.n + i)
            found.append(keys % self.n)
            i = end
        counts = np.bincount(np.concatenate(owners), minlength=len(texts))
        ends = np.zeros(len(texts) + 1, np.int32)
        np.cumsum(counts, out=ends[1:])
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(found).astype(np.int32)))
