"""Numpy kernels over Arrow string columns: byte-level words, rolling hashes, window minima.

Words are the matches of ``[^\\x20\\x09-\\x0D]+``. All separators are ASCII, so
UTF-8 bytes can be scanned directly and no Python string is made per word.
Memory follows ``BLOCK_BYTES``: a record batch is cut into blocks of whole rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Text bytes that one numpy pass covers; a longer row makes a block of its own.
BLOCK_BYTES = 1_000_000

#: Class of each byte: 0 parts words, and a word is a run of bytes of one other class.
NOT_SPACE = np.ones(256, np.uint8)
NOT_SPACE[[0x20, *range(0x09, 0x0E)]] = 0

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32

#: Odd multipliers of the two rolling hashes (bytes in a word, words in a window).
BYTE_BASE = 0x9E3779B97F4A7C15
WORD_BASE = 0xD1B54A32D192ED03


def lower_latin(data: np.ndarray) -> np.ndarray:
    """UTF-8 bytes with A-Z and the capitals from U+00C0 to U+00DE in lower case."""
    out = _LOWER[data]
    if len(out):
        after = out[:-1] == 0xC3
        small = out[1:]
        small[after & (small >= 0x80) & (small <= 0x9E) & (small != 0x97)] += 0x20
    return out


class _Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int) -> None:
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n + n // 8, 1 << 16)
            for name, b in (("up", self.base), ("down", self.inverse)):
                x = np.full(size, b, np.uint64)
                x[0] = 1
                setattr(self, name, np.cumprod(x))
        return self.up[:n], self.down[:n]


_BYTES, _WORDS = _Powers(BYTE_BASE), _Powers(WORD_BASE)


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, in place."""
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


@dataclass
class Block:
    """Rows ``lo`` to ``hi`` of a batch: their bytes and each row's byte offsets."""

    lo: int
    hi: int
    data: np.ndarray
    offsets: np.ndarray

    def words(self, classes: np.ndarray = NOT_SPACE) -> "Words":
        return Words(self.data, self.offsets, classes)


class Words:
    """Word spans of a block. ``first[r]:first[r + 1]`` are the words of row r."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, classes: np.ndarray = NOT_SPACE) -> None:
        self.data, self.offsets = data, offsets
        kind = classes[data]
        edge = np.ones(len(data) + 1, bool)  # whether a run may begin here
        np.not_equal(kind[1:], kind[:-1], out=edge[1:-1])
        edge[offsets] = True  # no word crosses a row
        self.inside = kind > 0
        self.starts = np.flatnonzero(edge[:-1] & self.inside)
        self.ends = np.flatnonzero(edge[1:] & self.inside) + 1
        self.first = np.searchsorted(self.starts, offsets)

    def __len__(self) -> int:
        return len(self.starts)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def rows(self) -> np.ndarray:
        """The row of each word."""
        return np.repeat(np.arange(len(self.offsets) - 1), self.counts)

    def hashes(self, longest: int | None = None) -> np.ndarray:
        """A 64-bit hash of each word's bytes, or of its first ``longest`` bytes."""
        ends = self.ends if longest is None else np.minimum(self.ends, self.starts + longest)
        up, down = _BYTES.get(len(self.data) + 1)
        total = np.zeros(len(self.data) + 1, np.uint64)
        np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=total[1:])
        h = (total[ends] - total[self.starts]) * down[self.starts]
        h += (ends - self.starts).astype(np.uint64) * np.uint64(0x9E6C63D0876A9A47)
        return mix(h)

    def joined(self) -> tuple[bytes, np.ndarray, np.ndarray]:
        """Words with one space after each, and each word's start and end there."""
        size = self.ends - self.starts
        end = np.cumsum(size + 1)
        out = np.full(int(end[-1]) if len(end) else 0, 0x20, np.uint8)
        flat = self.data[self.inside]
        out[np.arange(len(flat)) + np.repeat(np.arange(len(size)), size)] = flat
        return out.tobytes(), end - size - 1, end - 1


def window_hashes(word_hash: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of k words; the caller drops runs that cross rows."""
    n = len(word_hash)
    if n < k:
        return np.zeros(0, np.uint64)
    up, down = _WORDS.get(n + 1)
    total = np.zeros(n + 1, np.uint64)
    np.cumsum(word_hash * up[:-1], out=total[1:])
    return mix((total[k:] - total[:-k]) * down[: n - k + 1])


def window_starts(first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Word index and row of each window of k words that lies in one row."""
    n = np.maximum(np.diff(first) - k + 1, 0)
    rows = np.repeat(np.arange(len(n)), n)
    at = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[:-1], n)
    return at, rows


def sliding_min(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, by doubling."""
    span, out = 1, x
    while span * 2 <= w:
        out = np.minimum(out[:-span], out[span:])
        span *= 2
    return np.minimum(out[: len(out) - (w - span)], out[w - span :]) if w > span else out


def text_buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_string(col.type):
        col = pc.cast(col, pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    _, off, data = col.buffers()
    offsets = np.frombuffer(off, np.int32)[col.offset : col.offset + len(col) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(col: pa.Array, limit: int = BLOCK_BYTES) -> Iterator[Block]:
    """The rows of a string column in blocks of about ``limit`` bytes."""
    if not len(col):
        return
    data, offsets = text_buffers(col)
    lo = 0
    while lo < len(col):
        hi = int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1
        hi = min(max(hi, lo + 1), len(col))
        yield Block(lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo])
        lo = hi
