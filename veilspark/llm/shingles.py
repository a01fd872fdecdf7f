"""Distinct word-shingle sets of whole texts, as 64-bit hashes.

Null and blank texts have an empty set; repeated shingles count once; texts of any
length are taken whole; an empty column gives no sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from . import textvec as tv

WIDTH = 5


def shingle_lists(col: pa.Array, width: int = WIDTH, seed: int = 0) -> Iterator[tuple[tv.Chunk, np.ndarray, np.ndarray]]:
    """For each chunk its shingle hashes (with repeats) and the documents' offsets in them.

    Words are lower-cased in A-Z. A text with fewer words than ``width`` has its
    whole sequence as one shingle; without words it has none. ``seed`` 1 gives a
    second, independent hash.
    """
    for c in tv.chunks(col):
        low = tv.Chunk(c.lo, c.hi, tv.LOWER[c.data], c.off)
        w = tv.words(low)
        h = tv.spans(low.data, w.start, w.end, seed)
        count = w.count
        at = tv.starts_of(w.first, width)
        doc, values = tv.owner(w.first)[at], tv.rolling(h, width, seed)[at] if len(at) else np.zeros(0, tv.U)
        short = np.flatnonzero((count > 0) & (count < width))
        if len(short):
            whole = np.empty(len(short), tv.U)
            for k in range(1, width):
                mine = count[short] == k
                if mine.any():
                    whole[mine] = tv.rolling(h, k, seed)[w.first[short[mine]]]
            doc, values = np.concatenate([doc, short]), np.concatenate([values, whole])
            order = np.argsort(doc, kind="stable")
            doc, values = doc[order], values[order]
        yield c, values, np.searchsorted(doc, np.arange(c.n + 1))


def shingle_sets(col: pa.Array, width: int = WIDTH) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of every text."""
    out = []
    for _, values, first in shingle_lists(col, width):
        out += [np.unique(values[a:b]) for a, b in zip(first[:-1], first[1:])]
    return out
