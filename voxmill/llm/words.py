"""Whole-batch word hashing in NumPy, shared by the operators that work on word n-grams.

Words are the maximal runs of bytes outside ``\\x20 \\x09-\\x0D``. Every function
works on a batch of UTF-8 texts laid end to end, never on one word at a time,
and cuts long texts into pieces so that memory is bounded by ``PIECE``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

PIECE = 1 << 20
BATCH_BYTES = 2 << 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
LAST = np.uint64(0xFFFFFFFFFFFFFFFF)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit integers with full avalanche."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def byte_values(lower: bool) -> np.ndarray:
    """A 64-bit value for each byte, 0 for white space; A-Z as a-z when ``lower``."""
    values = mix64(np.arange(1, 257, dtype=np.uint64) * MULTIPLIER)
    if lower:
        values[65:91] = values[97:123]
    values[white()] = 0
    return values


def white() -> np.ndarray:
    space = np.zeros(256, dtype=bool)
    space[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
    return space


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``len + 1`` byte offsets of a string column; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def slices(bounds: np.ndarray, most: int = BATCH_BYTES) -> Iterator[tuple[int, int]]:
    """Runs of texts of at most ``most`` bytes together, one text at least."""
    first, n = 0, len(bounds) - 1
    while first < n:
        last = int(np.searchsorted(bounds, bounds[first] + most, side="right")) - 1
        last = min(n, max(last, first + 1))
        yield first, last
        first = last


class Words:
    """Hash, byte span and text of each word of a batch. ``bounds[d]:bounds[d + 1]`` are the words of text d."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lower: bool, spans: bool = False):
        values, space = byte_values(lower), white()
        hashes, starts, ends = [], [], []
        marks = np.zeros(len(data) + 1, dtype=bool)
        marks[at] = True
        lo = 0
        while lo < len(data):
            hi = min(len(data), lo + PIECE)
            while hi < len(data) and not (marks[hi] or space[data[hi]]):
                ahead = data[hi : hi + PIECE]
                stop = np.flatnonzero(space[ahead] | marks[hi : hi + len(ahead)])
                hi += int(stop[0]) if len(stop) else len(ahead)
            part = data[lo:hi]
            word = ~space[part]
            before = np.empty_like(word)
            before[0], before[1:] = False, word[:-1]
            first = np.flatnonzero(word & (~before | marks[lo:hi]))
            if len(first):
                after = np.empty_like(word)
                after[-1], after[:-1] = False, word[1:]
                last = np.flatnonzero(word & (~after | marks[lo + 1 : hi + 1])) + 1
                size = last - first
                powers = np.full(int(size.max()), MULTIPLIER, dtype=np.uint64)
                powers[0] = 1
                powers = np.multiply.accumulate(powers)
                run = np.diff(np.append(first, len(part)))
                away = np.arange(len(part) - first[0]) - np.repeat(first - first[0], run)
                value = values[part[first[0] :]] * powers[np.minimum(away, len(powers) - 1)]
                hashes.append(mix64(np.add.reduceat(value, first - first[0]) + size.astype(np.uint64) * MULTIPLIER))
                starts.append(first + lo)
                if spans:
                    ends.append(last + lo)
            lo = hi
        none = np.zeros(0, np.int64)
        self.hash = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
        self.start = np.concatenate(starts) if starts else none
        self.end = np.concatenate(ends) if ends else none
        self.bounds = np.searchsorted(self.start, at).astype(np.int64)
        self.bounds[-1] = len(self.hash)


def ngrams(word: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each position on (position i of the result: words i..i+n-1), ignoring text bounds."""
    if len(word) < n:
        return np.zeros(0, np.uint64)
    done, width, total = None, 0, n
    block, size = word * MULTIPLIER + np.uint64(1), 1
    while total:  # windows of a doubled width from two halves
        if total & 1:
            if done is None:
                done, width = block, size
            else:
                shift = np.uint64(pow(int(MULTIPLIER), size, 1 << 64))
                m = len(word) - width - size + 1
                done, width = done[:m] * shift + block[width : width + m], width + size
        total >>= 1
        if total:
            shift = np.uint64(pow(int(MULTIPLIER), size, 1 << 64))
            m = len(block) - size
            block, size = block[:m] * shift + block[size : size + m], size * 2
    return mix64(done + np.uint64(n))


def shingles(word: np.ndarray, bounds: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's n-word shingles, repeats included, and their bounds.

    A text of fewer words has one shingle of all its words; one without words has none.
    """
    size = np.diff(bounds)
    count = np.where(size >= n, size - n + 1, (size > 0).astype(np.int64))
    at = np.concatenate(([0], np.cumsum(count)))
    out = np.zeros(int(at[-1]), dtype=np.uint64)
    long = size >= n
    if long.any():
        every = ngrams(word, n)
        take = np.repeat(bounds[:-1][long] - at[:-1][long], count[long])
        where = np.flatnonzero(np.repeat(long, count))
        out[where] = every[where + take]
    for d in np.flatnonzero(~long & (size > 0)):
        out[at[d]] = ngrams(word[bounds[d] : bounds[d + 1]], int(size[d]))[0]
    return out, at


def signed(x: np.ndarray) -> np.ndarray:
    """The same bits as Spark's long."""
    return x.view(np.int64)


def list_column(values: np.ndarray, at: np.ndarray, kind: pa.DataType | None = None) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(values, type=kind))
