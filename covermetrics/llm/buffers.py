"""Texts of an Arrow column as bytes in numpy: words, lines and rolling hashes without Python strings.

Hashes are polynomials modulo 2**64 over (byte + 1), scrambled per word. Equal texts always hash alike; where a wrong
match would change a result, callers compare the bytes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BYTE_BASE = 0x9E3779B97F4A7C15 | 1
WORD_BASE = 0xC2B2AE3D27D4EB4F | 1
SPACES = b" \t\n\x0b\x0c\r"


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; a null row is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offs = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[offs[0]:offs[-1]], offs - offs[0]


def blocks(offsets: np.ndarray, limit: int = 2 << 20):
    """Row ranges (i, j) of at most `limit` bytes each, one row at least."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


def block_arrays(column: pa.Array, limit: int = 2 << 20):
    """(bytes, offsets) of one block after the other."""
    data, offsets = text_bytes(column)
    for i, j in blocks(offsets, limit):
        yield data[offsets[i]:offsets[j]], offsets[i:j + 1] - offsets[i]


def byte_table(members: bytes) -> np.ndarray:
    table = np.zeros(256, bool)
    table[list(members)] = True
    return table


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; a run never crosses a row's end."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1]
    last[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(inside))]
    first[cut] = inside[cut]
    last[cut - 1] = inside[cut - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


def row_of(starts: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """The row that each position lies in."""
    return np.searchsorted(offsets, starts, "right") - 1


def scramble(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Rolling:
    """Prefix sums of a polynomial, from which the hash of any range comes in O(1)."""

    def __init__(self):
        self.tables = {}

    def _powers(self, base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        if base not in self.tables or len(self.tables[base][0]) < n:
            size = max(n, 1 << 16)
            both = []
            for b in (base, pow(base, -1, 1 << 64)):
                p = np.full(size, b, np.uint64)
                p[0] = 1
                both.append(np.cumprod(p, dtype=np.uint64))
            self.tables[base] = tuple(both)
        up, down = self.tables[base]
        return up[:n], down

    def ranges(self, values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
        up, down = self._powers(base, len(values) + 1)
        sums = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * up[:len(values)], out=sums[1:])
        return scramble((sums[ends] - sums[starts]) * down[starts])

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return self.ranges(data.astype(np.uint64) + np.uint64(1), starts, ends, BYTE_BASE)

    def grams(self, words: np.ndarray, n: int) -> np.ndarray:
        """Hash of each n consecutive words, also across rows; callers mask those."""
        if len(words) < n:
            return np.zeros(0, np.uint64)
        at = np.arange(len(words) - n + 1)
        return self.ranges(words, at, at + n, WORD_BASE)


def covered(n: int, starts: np.ndarray, width: int | np.ndarray) -> np.ndarray:
    """Which of n positions lie in a range [start, start + width)."""
    delta = np.zeros(n + 1, np.int32)
    np.add.at(delta, starts, 1)
    np.add.at(delta, starts + width, -1)
    return np.cumsum(delta[:-1]) > 0


def sums_by_row(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]
