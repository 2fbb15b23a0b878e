"""Array kernels over Arrow text columns: words, word hashes, windows.

A word is ``[^\\x20\\x09-\\x0D]+``. All kernels work on the bytes of a whole
batch at once, in chunks of rows of about a MB, so no Python object is made
for a word. Hashes are 64 bits wide.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

CHUNK_BYTES = 1 << 20
U = np.uint64
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of letters and digits: ASCII ones and all of longer UTF-8 characters.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32
_MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=np.uint64)
#: Words longer than this many 8-byte lanes are hashed one by one.
_LANES = 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (in place)."""
    x ^= x >> U(33)
    x *= U(0xFF51AFD7ED558CCD)
    x ^= x >> U(33)
    x *= U(0xC4CEB9FE1A85EC53)
    x ^= x >> U(33)
    return x


def chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of consecutive rows; a null is empty.

    A chunk holds rows of about ``most`` bytes, or one longer row.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    if not len(column):
        return
    wide = pa.types.is_large_binary(column.type) or pa.types.is_large_string(column.type)
    _, off, body = column.buffers()
    offsets = np.frombuffer(off, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(column):
        last = max(row + 1, int(np.searchsorted(offsets, offsets[row] + most, "right")) - 1)
        yield row, data[offsets[row] : offsets[last]], offsets[row : last + 1] - offsets[row]
        row = last


def lowered(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


class Words:
    """The words of a chunk: byte ranges, hashes, and each row's first word.

    ``solid`` says for each byte value whether it is part of a word.
    """

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lower: bool = False, solid: np.ndarray = ~_SPACE):
        n = len(data)
        self.data = _LOWER[data] if lower else data
        solid = solid[data]
        edge = np.empty(n + 1, bool)  # a word may start here: the byte before is no part of it
        edge[0] = edge[n] = True
        np.logical_not(solid[:-1], out=edge[1:n])
        edge[offsets] = True
        self.starts = np.flatnonzero(solid & edge[:n])
        gap = np.empty(n + 1, bool)
        gap[n] = True
        np.logical_not(solid, out=gap[:n])
        gap[offsets] = True
        self.ends = np.flatnonzero(solid & gap[1:]) + 1
        self.first = np.searchsorted(self.starts, offsets)  # of each row, and the end
        self.counts = np.diff(self.first)

    def __len__(self) -> int:
        return len(self.starts)

    def _lanes(self) -> np.ndarray:
        """The eight bytes from each byte on."""
        padded = np.concatenate([self.data, np.zeros(8, np.uint8)])
        return np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))

    def prefixes(self, size: int) -> np.ndarray:
        """A hash of the first ``size`` bytes (up to 8) of each word."""
        head = self._lanes()[self.starts] & _MASK[np.minimum(self.ends - self.starts, size)]
        return mix(head + U(size * 0xD6E8FEB86659FD93 % 2**64))

    def hashes(self) -> np.ndarray:
        size = self.ends - self.starts
        lane = self._lanes()
        out = lane[self.starts] & _MASK[np.minimum(size, 8)]
        out += size.astype(np.uint64) * U(0x9E3779B97F4A7C15)
        mix(out)
        rest, at = np.flatnonzero(size > 8), 8
        while len(rest) and at < 8 * _LANES:
            more = lane[self.starts[rest] + at] & _MASK[np.minimum(size[rest] - at, 8)]
            out[rest] = mix(out[rest] * U(0x9FB21C651E98DF25) + more)
            at += 8
            rest = rest[size[rest] > at]
        for i in rest:
            out[i] = int.from_bytes(hashlib.blake2b(self.data[self.starts[i] : self.ends[i]].tobytes(), digest_size=8).digest(), "little")
        return out

    def rows(self) -> np.ndarray:
        """The row in the chunk of each word."""
        return np.repeat(np.arange(len(self.counts)), self.counts)


def fold(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash of each run of ``size`` consecutive items, rows disregarded."""
    n = max(0, len(hashes) - size + 1)
    out = hashes[:n].copy()
    for k in range(1, size):
        out *= U(0x9FB21C651E98DF25)
        out += hashes[k : n + k]
    return mix(out)


def whole(counts: np.ndarray, size: int) -> np.ndarray:
    """Which runs of ``size`` words lie within one row (for ``fold``'s result)."""
    total = int(counts.sum())
    ok = np.zeros(total, bool)
    first = np.cumsum(counts) - counts
    n = np.maximum(counts - size + 1, 0)
    mark = np.zeros(total + 1, np.int32)
    mark[first[n > 0]] += 1
    mark[(first + n)[n > 0]] -= 1
    ok = np.cumsum(mark[:-1]) > 0
    return ok[: max(0, total - size + 1)]


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` consecutive values, by doubling."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = np.minimum(x[: len(x) - step], x[step:])
        have += step
    return x
