"""Whole texts as blocks of bytes: words, their hashes and code points by NumPy, inside Arrow tasks.

Spark splits the documents; a task gets Arrow batches and cuts them into blocks of
documents whose texts have about ``BLOCK_BYTES`` together. One document is never cut,
so the memory of a task follows its longest text (some 60 bytes for a byte of it).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

BLOCK_BYTES = 1 << 20
MASK = np.uint64(0xFFFFFFFFFFFFFFFF)
_RNG = np.random.default_rng(20240607)
#: For each byte a fixed random value, so that short words spread over 64 bits.
_BYTE_VALUE = _RNG.integers(0, 2**64, 256, dtype=np.uint64)
_R = np.uint64(0x9E3779B97F4A7C15 | 1)
_R_INVERSE = np.uint64(pow(int(_R), -1, 2**64))
IS_BREAK = np.zeros(256, dtype=bool)
IS_BREAK[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True

_powers: dict[int, np.ndarray] = {}


def powers(r: np.uint64, n: int) -> np.ndarray:
    """r**0 .. r**(n-1) modulo 2**64."""
    have = _powers.get(int(r))
    if have is None or len(have) < n:
        a = np.full(max(n, BLOCK_BYTES + 1), r, dtype=np.uint64)
        a[0] = 1
        have = np.cumprod(a, dtype=np.uint64)
        if len(have) <= 4 * BLOCK_BYTES:
            _powers[int(r)] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values under which nearby inputs part."""
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    h = h ^ (h >> np.uint64(32))
    h = h * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


class Block:
    """Texts of consecutive rows: ``data`` bytes, ``offs`` offsets of the rows in them."""

    def __init__(self, data: np.ndarray, offs: np.ndarray):
        self.data, self.offs, self.n = data, offs, len(offs) - 1
        brk = IS_BREAK[data]
        word = ~brk
        first = np.empty(len(data), dtype=bool)
        if len(data):
            first[0] = True
            first[1:] = brk[:-1]
            first[offs[:-1][offs[:-1] < len(data)]] = True
            last = np.empty(len(data), dtype=bool)
            last[-1] = True
            last[:-1] = brk[1:]
            ends = offs[1:][offs[1:] > offs[:-1]] - 1
            last[ends] = True
            self.starts = np.flatnonzero(word & first)
            self.ends = np.flatnonzero(word & last) + 1
        else:
            self.starts = self.ends = np.zeros(0, dtype=np.int64)
        self.is_word = word
        #: Words of row i: word_offs[i]:word_offs[i + 1].
        self.word_offs = np.searchsorted(self.starts, offs)

    def span_hashes(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans, by prefix sums of a polynomial."""
        n = len(self.data)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(_BYTE_VALUE[self.data] * powers(_R, n + 1)[:n], out=sums[1:])
        h = (sums[ends] - sums[starts]) * powers(_R_INVERSE, n + 1)[starts]
        return mix(h ^ (ends - starts).astype(np.uint64))

    def word_hashes(self) -> np.ndarray:
        return self.span_hashes(self.starts, self.ends)

    def per_row(self, values: np.ndarray, offs: np.ndarray | None = None) -> np.ndarray:
        """Sums of values (one a byte, or one for each of the items that offs counts) by row."""
        offs = self.offs if offs is None else offs
        sums = np.zeros(len(values) + 1, dtype=np.int64)
        np.cumsum(values, out=sums[1:])
        return sums[offs[1:]] - sums[offs[:-1]]

    def code_starts(self) -> np.ndarray:
        """True where a byte begins a code point."""
        return (self.data & 0xC0) != 0x80

    def code_points(self) -> tuple[np.ndarray, np.ndarray]:
        """The code points and the offsets of the rows in them."""
        points = np.frombuffer(self.data.tobytes().decode("utf-8", "replace").encode("utf-32-le"), dtype=np.uint32)
        sums = np.zeros(len(self.data) + 1, dtype=np.int64)
        np.cumsum(self.code_starts(), out=sums[1:])
        return points, sums[self.offs]

    def text(self, i: int) -> bytes:
        return self.data[self.offs[i] : self.offs[i + 1]].tobytes()


def text_arrays(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of an Arrow string array without nulls."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if len(texts) == 0:
        return np.zeros(0, dtype=np.uint8), np.zeros(1, dtype=np.int64)
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offs, data = texts.buffers()
    offs = np.frombuffer(offs, dtype=np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, dtype=np.uint8)
    return raw[offs[0] : offs[-1]], offs - offs[0]


def blocks(texts: pa.Array, most: int = BLOCK_BYTES) -> Iterator[tuple[int, int, Block]]:
    """(first row, end row, block) over an Arrow string array."""
    data, offs = text_arrays(texts)
    lo, n = 0, len(offs) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offs, offs[lo] + most, side="right")) - 1)
        yield lo, hi, Block(data[offs[lo] : offs[hi]], offs[lo : hi + 1] - offs[lo])
        lo = hi


def repeated_windows(hashes: np.ndarray, offs: np.ndarray, width: int) -> np.ndarray:
    """For each item whether it lies in a run of ``width`` items that is found twice or more in its row.

    ``offs`` are the offsets of the rows in the items. Runs may overlap.
    """
    n = len(hashes)
    inside = np.zeros(n, dtype=bool)
    if n < width:
        return inside
    k = n - width + 1
    h = np.zeros(k, dtype=np.uint64)
    for j in range(width):
        h = h * np.uint64(0x9E3779B97F4A7C15) + hashes[j : j + k]
        h ^= h >> np.uint64(29)
    row = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
    valid = row[:k] == row[width - 1 :]
    key = mix(h ^ mix(row[:k].astype(np.uint64) + np.uint64(1)))
    seen = np.sort(key[valid])
    twice = np.unique(seen[1:][seen[1:] == seen[:-1]])
    if not len(twice):
        return inside
    at = np.minimum(np.searchsorted(twice, key), len(twice) - 1)
    start = np.flatnonzero(valid & (twice[at] == key))
    change = np.zeros(n + 1, dtype=np.int64)
    np.add.at(change, start, 1)
    np.add.at(change, start + width, -1)
    return np.cumsum(change[:-1]) > 0
