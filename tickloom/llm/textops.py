"""Vectorised byte-level text primitives used inside Arrow tasks.

A task sees a column of texts as one UTF-8 byte buffer plus offsets.  ``pieces``
walks the buffer in slices of a quarter megabyte (never splitting a text), so the
temporary arrays stay small, and in the processor's cache, however large the Arrow
batch is.
"""

from __future__ import annotations

import ctypes
import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text per slice; one longer text makes a slice of its own.
SLICE_BYTES = 1 << 18
#: Longest word whose polynomial hash is used as it is.
LONG_WORD = 256

_BASE = 0x9E3779B97F4A7C15 | 1
_MASK = (1 << 64) - 1


def _word_table(excluded) -> np.ndarray:
    table = np.ones(256, bool)
    for lo, hi in excluded:
        table[lo : hi + 1] = False
    return table


#: Words are runs of anything but ASCII white space.
SPACED = _word_table([(0x20, 0x20), (0x09, 0x0D)])
#: Words are runs of ASCII digits, lower-case letters and all of U+0080 upward.
ALNUM = _word_table([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
#: A-Z to a-z, everything else unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def text_buffers(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (one more than rows) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type)
    raw = column.buffers()
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(raw[1], np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(raw[2], np.uint8) if raw[2] is not None else np.zeros(0, np.uint8)
    return data, offsets


def pieces(column, limit: int = SLICE_BYTES):
    """Yield (first row, last row + 1, bytes, offsets) for consecutive runs of rows."""
    data, offsets = text_buffers(column)
    row, rows = 0, len(offsets) - 1
    while row < rows:
        end = int(np.searchsorted(offsets, offsets[row] + limit, side="right")) - 1
        end = min(max(end, row + 1), rows)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    release()


def release() -> None:
    """Give free memory back to the system: Spark keeps its Python workers, and those of several stages add up."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray):
    """Start, end (byte positions) and row of every word; words never span rows."""
    n = len(data)
    if n == 0:
        return (np.zeros(0, np.int64),) * 3
    inside = table[data]
    before = np.empty(n, bool)
    before[0], before[1:] = False, inside[:-1]
    first = offsets[:-1]
    before[first[first < n]] = False
    after = np.empty(n, bool)
    after[-1], after[:-1] = False, inside[1:]
    last = offsets[1:]
    after[last[last > 0] - 1] = False
    start = np.flatnonzero(inside & ~before)
    end = np.flatnonzero(inside & ~after) + 1
    return start, end, np.searchsorted(offsets, start, side="right") - 1


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


class _Powers(dict):
    """Tables of hash powers by base: built where they are used, shipped empty."""

    #: Places up to which a table is kept for the next slice.
    KEPT = 1 << 19

    def __reduce__(self):
        return (_Powers, ())

    def upto(self, n: int, base: int):
        """Powers of a base and of its inverse, at least n of each."""
        have = self.get(base)
        if have is None or len(have[0]) < n:
            made = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(max(n, self.KEPT), b, np.uint64)
                p[0] = 1
                made.append(np.multiply.accumulate(p))
            have = tuple(made)
            if n <= self.KEPT:
                self[base] = have
        return have


_POWERS = _Powers()


class Rolling:
    """64-bit hashes of arbitrary spans of a sequence from one prefix sum."""

    def __init__(self, values: np.ndarray, base: int = _BASE):
        n = len(values)
        up, self.down = _POWERS.upto(n + 1, base)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * up[:n], out=self.sums[1:])

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def byte_values() -> np.ndarray:
    """A fixed random 64-bit value for every byte."""
    return mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))


def word_hashes(data, start, end) -> np.ndarray:
    """A 64-bit hash of every word.

    Polynomials modulo a power of two have known collisions of some thousand bytes,
    so long words are hashed by a cryptographic function instead.
    """
    out = Rolling(byte_values()[data]).spans(start, end)
    for i in np.flatnonzero(end - start > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def windows(hashes: np.ndarray, row: np.ndarray, k: int):
    """Index of the first word of every k-word window inside one row, and its hash."""
    n = len(hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    first = np.flatnonzero(row[:n] == row[k - 1 :])
    rolled = Rolling(hashes, 0xD6E8FEB86659FD93)
    return first, rolled.spans(first, first + k)


def covered(n: int, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Which of n places lie in any of the half-open spans."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, start, 1)
    np.add.at(delta, end, -1)
    return np.cumsum(delta[:-1]) > 0
