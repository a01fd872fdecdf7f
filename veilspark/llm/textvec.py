"""Vectorised words, spans and hashes over Arrow string columns.

All functions work on the UTF-8 bytes of many documents at once. A word is a
run of bytes outside ``[\\x20\\x09-\\x0D]``; as those are ASCII, byte runs and
character runs are the same. Chunks bound the working memory whatever the
batch size; a document is never cut.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
CHUNK_BYTES = 3 << 20

_STEP = U(0xD6E8FEB86659FD93)
_SEEDS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F], U)
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], U)
LONG = 128
IS_WS = np.zeros(256, bool)
IS_WS[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser, in place on a uint64 array."""
    h ^= h >> U(33)
    h *= U(0xFF51AFD7ED558CCD)
    h ^= h >> U(33)
    h *= U(0xC4CEB9FE1A85EC53)
    h ^= h >> U(33)
    return h


@dataclass
class Chunk:
    """Rows ``lo:hi`` of a batch: bytes and the documents' byte offsets."""

    lo: int
    hi: int
    data: np.ndarray
    off: np.ndarray

    @property
    def n(self) -> int:
        return self.hi - self.lo


def chunks(col: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[Chunk]:
    """Slices of a string column of about ``limit`` bytes; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not pa.types.is_large_string(col.type):
        col = col.cast(pa.large_string())
    if col.null_count:
        col = pc.fill_null(col, "")
    n = len(col)
    if not n:
        return
    _, offs, data = col.buffers()
    off = np.frombuffer(offs, np.int64)[col.offset : col.offset + n + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = min(n, max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1))
        yield Chunk(i, j, raw[off[i] : off[j]], (off[i : j + 1] - off[i]).astype(np.int64))
        i = j


@dataclass
class Words:
    """Byte spans of the words of a chunk; ``first[d]:first[d+1]`` are document d's."""

    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def count(self) -> np.ndarray:
        return np.diff(self.first)


def words(c: Chunk) -> Words:
    ws = IS_WS[c.data]
    n = len(ws)
    before = np.empty(n + 1, bool)
    before[0] = True
    before[1:] = ws
    after = before[1:].copy()
    before = before[:n]
    after[: n - 1] = ws[1:]
    if n:
        after[n - 1] = True
    full = c.off[:-1] < c.off[1:]
    before[c.off[:-1][full]] = True
    after[c.off[1:][full] - 1] = True
    start = np.flatnonzero(~ws & before)
    end = np.flatnonzero(~ws & after) + 1
    return Words(start, end, np.searchsorted(start, c.off))


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes that begin at each byte (zeros behind the end), as little-endian numbers."""
    padded = np.zeros(len(data) + 8, np.uint8)
    padded[: len(data)] = data
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray, seed: int = 0) -> np.ndarray:
    """64-bit hashes of byte spans, equal for equal bytes anywhere; another ``seed`` gives an independent hash.

    Eight bytes at a time go through the bijective mixer, so spans of up to eight
    bytes never collide with others of their length. Spans beyond ``LONG`` bytes
    take a keyed BLAKE2b digest.
    """
    eight, size = words_at(data), end - start
    h = mix(size.astype(U) * _STEP + _SEEDS[seed])
    h = mix(h ^ (eight[start] & _MASK[np.minimum(size, 8)]))
    at, k = np.flatnonzero((size > 8) & (size <= LONG)), 8
    while len(at):
        h[at] = mix(h[at] * _SEEDS[seed] ^ (eight[start[at] + k] & _MASK[np.minimum(size[at] - k, 8)]))
        k += 8
        at = at[size[at] > k]
    for i in np.flatnonzero(size > LONG):
        h[i] = digest(data[start[i] : end[i]], seed)
    return h


def digest(values: np.ndarray, seed: int = 0) -> int:
    """64-bit BLAKE2b of an array's bytes."""
    return int.from_bytes(hashlib.blake2b(values.tobytes(), digest_size=8, salt=bytes([seed])).digest(), "little")


def rolling(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """Hash of every k (a few) consecutive entries, also across documents (see starts_of)."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, U)
    out = h[:n].copy()
    for j in range(1, k):
        out *= _STEP if not seed else _SEEDS[seed]
        out += h[j : j + n]
    return mix(out)


def starts_of(first: np.ndarray, k: int) -> np.ndarray:
    """Word positions at which a window of k words lies in one document."""
    ends = np.repeat(first[1:], np.diff(first))
    at = np.arange(len(ends))
    return at[at + k <= ends]


def owner(first: np.ndarray) -> np.ndarray:
    """For each word the index of its document."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def cover(positions: np.ndarray, k: int, n: int) -> np.ndarray:
    """Mask of the n words that lie in a k-window starting at one of the (distinct) positions."""
    d = np.zeros(n + 1, np.int32)
    d[positions] += 1
    d[positions + k] -= 1
    return np.cumsum(d[:n]) > 0


def per_document(mask: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Number of set entries in each document's range ``off[d]:off[d+1]``."""
    total = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=total[1:])
    return total[off[1:]] - total[off[:-1]]
