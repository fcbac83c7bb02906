"""Words and their hashes for whole Arrow batches, in numpy: no loop over words or rows."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
#: Bytes handled at once. A longer document is handled alone, whole.
CHUNK = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.Generator(np.random.PCG64(20240229)).integers(1, 1 << 63, 256, dtype=np.int64).astype(U64)


class _Powers:
    """Powers of an odd number modulo 2^64, and of its inverse, grown as needed."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, U64)

    def of(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.up) < n:
            k = len(self.up)
            self.up = np.concatenate([self.up, self.up * U64(pow(self.base, k, 1 << 64))])
            self.down = np.concatenate([self.down, self.down * U64(pow(self.inverse, k, 1 << 64))])
        return self.up[:n], self.down[:n]


_bytes_powers = _Powers(0x9E3779B97F4A7C15)
_word_powers = (_Powers(0xD6E8FEB86659FD93), _Powers(0xA0761D6478BD642F))


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: equal in, equal out, and all bits depend on all bits."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def spans_hash(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, powers: _Powers) -> np.ndarray:
    """A polynomial hash of values[start:end] for every span, by prefix sums modulo 2^64."""
    up, down = powers.of(len(values) + 1)
    total = np.zeros(len(values) + 1, U64)
    np.cumsum(values * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64) * U64(0x2545F4914F6CDD1D))


def window_hash(words: np.ndarray, starts: np.ndarray, n: int, second: bool = False) -> np.ndarray:
    """The hash of the n words from every start."""
    return spans_hash(words, starts, starts + n, _word_powers[second])


class Chunk:
    """The words of some whole documents. first: the row number of the first document; bounds: of its documents, in words."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.first, self.n, self.data = first, len(offsets) - 1, data
        self.byte_offsets = offsets
        solid = ~SPACE[data]
        cut = np.zeros(len(data) + 1, bool)
        cut[offsets] = True
        begin, stop = solid.copy(), solid.copy()
        begin[1:] &= ~solid[:-1] | cut[1:-1]
        stop[:-1] &= ~solid[1:] | cut[1:-1]
        self.starts, self.ends = np.flatnonzero(begin), np.flatnonzero(stop) + 1
        self.bounds = np.searchsorted(self.starts, offsets)
        self.counts = np.diff(self.bounds)

    def doc(self) -> np.ndarray:
        """The document of every word."""
        return np.repeat(np.arange(self.n), self.counts)

    def hashes(self, lower: bool = False, ends: np.ndarray | None = None, starts: np.ndarray | None = None) -> np.ndarray:
        data = LOWER[self.data] if lower else self.data
        return spans_hash(_BYTE[data], self.starts if starts is None else starts, self.ends if ends is None else ends, _bytes_powers)


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a string column, without a copy; null is empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8) if offsets is not None else np.zeros(len(column) + 1, np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), offsets


def chunks(column: pa.Array, size: int = CHUNK) -> Iterator[Chunk]:
    """Cut a column of texts into runs of whole documents of about `size` bytes."""
    data, offsets = text_buffers(column)
    n, at = len(offsets) - 1, 0
    while at < n:
        stop = max(at + 1, int(np.searchsorted(offsets, offsets[at] + size, "right")) - 1)
        yield Chunk(data[offsets[at] : offsets[stop]], offsets[at : stop + 1] - offsets[at], at)
        at = stop


def first_of_each(group: np.ndarray, feature: np.ndarray, buckets: int) -> np.ndarray:
    """Mask of the first occurrence of every feature in every group (features in 0..buckets-1)."""
    key = group.astype(np.int64) * buckets + feature
    order = np.argsort(key, kind="stable")
    keep = np.zeros(len(key), bool)
    s = key[order]
    if len(s):
        keep[order] = np.concatenate([[True], s[1:] != s[:-1]])
    return keep


def group_sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of values (or rows) of the given lengths; 0 for empty runs."""
    total = np.zeros((len(values) + 1, *values.shape[1:]), np.float64)
    np.cumsum(values, axis=0, out=total[1:])
    ends = np.cumsum(counts)
    return total[ends] - total[ends - counts]
