"""Vectorised word hashing over Arrow string columns, shared by the text operators.

Everything here works on a *slab*: the concatenated UTF-8 bytes of a few consecutive
rows of an Arrow batch, cut by bytes (never by rows) so that memory stays bounded
whatever the row count.  A single text larger than the slab size is a slab of its own.

Word hashes are 64-bit: a polynomial over byte codes, taken from prefix sums, then
mixed.  They depend on the (optionally ASCII-lower-cased) bytes of the word alone, so
they agree between tasks and runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U64 = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
SLAB_BYTES = 1 << 21


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64, elementwise on uint64."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_CODES = mix(np.arange(1, 257, dtype=U64))
_CODES_LOWER = _CODES.copy()
_CODES_LOWER[65:91] = _CODES[97:123]


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int = _BASE) -> None:
        self.base = base
        self.up = np.ones(1, U64)
        self.down = np.ones(1, U64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            up = np.full(n, U64(self.base), U64)
            up[0] = 1
            down = np.full(n, U64(pow(self.base, -1, 1 << 64)), U64)
            down[0] = 1
            np.cumprod(up, out=up)
            np.cumprod(down, out=down)
            if n > 2 * SLAB_BYTES:  # a huge text: used once, not kept
                return up, down
            self.up, self.down = up, down
        return self.up[:n], self.down[:n]


_powers = _Powers()
#: A second family: other codes of the bytes, another base.
_CODES_2, _powers_2 = mix(np.arange(5001, 5257, dtype=U64)), _Powers(0xC2B2AE3D27D4EB4F)


def span_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = False, second: bool = False) -> np.ndarray:
    """Hash of data[start:end] for every span; lower: ASCII capitals count as small.

    second: by a family of its own, so that spans of equal hash in both are equal but for
    one case in 2**128."""
    up, down = (_powers_2 if second else _powers).upto(len(data) + 1)
    codes = _CODES_2 if second else _CODES_LOWER if lower else _CODES
    sums = np.zeros(len(data) + 1, U64)
    np.cumsum(codes[data] * up[: len(data)], out=sums[1:])
    return mix((sums[end] - sums[start]) * down[start])


def separators(keep: str) -> np.ndarray:
    """Boolean table over bytes: True where a byte separates words.

    keep: 'space' - words are runs of anything but [\\x20\\x09-\\x0D];
          'alnum' - words are runs of [0-9A-Za-z] and non-ASCII bytes.
    """
    sep = np.zeros(256, bool)
    if keep == "space":
        sep[[0x20, *range(0x09, 0x0E)]] = True
    elif keep == "alnum":
        sep[:128] = True
        for a, b in ((0x30, 0x3A), (0x41, 0x5B), (0x61, 0x7B)):
            sep[a:b] = False
    else:
        raise ValueError(keep)
    return sep


class Slab:
    """Words of some consecutive rows.

    rows: (first, last) row of the batch; word arrays are ordered by row, then position.
    word_lo[i]:word_lo[i + 1] are the words of row first + i.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int, sep: np.ndarray, lower: bool) -> None:
        self.first, self.n_rows = first, len(offsets) - 1
        self.data, self.offsets = data, offsets - offsets[0]
        n = len(data)
        word = np.zeros(n + 1, bool)
        word[:n] = ~sep[data]
        row_start = np.zeros(n + 1, bool)
        row_start[self.offsets] = True  # a word never runs on into the next row
        starts = word.copy()
        starts[1:] &= ~word[:-1] | row_start[1:]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | row_start[1:]
        self.start = np.flatnonzero(starts)
        self.end = np.flatnonzero(ends) + 1
        self.hash = span_hash(data, self.start, self.end, lower)
        self.word_lo = np.searchsorted(self.start, self.offsets)

    @property
    def n_words(self) -> np.ndarray:
        return np.diff(self.word_lo)

    def text(self, a: int, b: int) -> bytes:
        """Bytes from word a to the end of word b - 1."""
        return self.data[self.start[a] : self.end[b - 1]].tobytes() if b > a else b""

    def words(self, a: int, b: int) -> list[bytes]:
        return [self.data[s:e].tobytes() for s, e in zip(self.start[a:b], self.end[a:b], strict=True)]

    def row_of_word(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_rows), self.n_words)


def gram_hash(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; shorter than the input by k - 1."""
    n = len(words) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    total = np.zeros(n, U64)
    factor = 1
    for j in range(k):
        total += words[j : j + n] * U64(factor)
        factor = factor * 0xD6E8FEB86659FD93 % (1 << 64)
    return mix(total)


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column, nulls as empty texts."""
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    return (np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)), offsets


def slabs(column: pa.Array, sep: np.ndarray, lower: bool, size: int = SLAB_BYTES) -> Iterator[Slab]:
    if not len(column):
        return
    data, offsets = string_buffers(column)
    first = 0
    while first < len(column):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1)
        last = min(last, len(column))
        yield Slab(data[offsets[first] : offsets[last]], offsets[first : last + 1], first, sep, lower)
        first = last


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """Position of the rightmost minimum in each window of w values."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best = np.arange(len(values))
    span = 1
    while span * 2 <= w:  # doubling, then one overlap: log2(w) passes
        a, b = best[:-span], best[span:]
        best = np.where(values[b] <= values[a], b, a)
        span *= 2
    if span < w:
        a, b = best[: n], best[w - span : w - span + n]
        best = np.where(values[b] <= values[a], b, a)
    return best[:n]
