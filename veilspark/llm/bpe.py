"""Encoding with a public tokenizer, each distinct unit of text once.

Both supported pre-tokenizers cut a text at places that depend only on its
ASCII white space, so a text's ids are the ids of its units in order. Arrow's
dictionary encoding finds the distinct units of a chunk by their bytes; only
units not met before go through the tokenizer. The memory of past units knows
them by two independent 64-bit hashes and is bounded (``MEMO_UNITS``); beyond it
units are encoded again, with the same ids.

- ``byte``: byte-level BPE whose words carry one leading space. A white-space
  run gives all but its last character as one unit; the last joins the word if
  it is a space. A text with non-ASCII white space is encoded as a whole.
- ``word``: BPE with word ends whose pre-tokenizer drops white space.

A text that holds an added token of the file (such as ``<|endoftext|>``) is
encoded as a whole, as the plain library call gives that token's one id there
and splits the white space before it differently.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np
import pyarrow as pa

from . import textvec as tv

#: Bound of the memory: about 50 bytes a unit.
MEMO_UNITS = 1_000_000
#: Bytes of text that callers hand over at a time (a longer text as a whole).
CHUNK_BYTES = 1 << 20
_BATCH = 2048
_loaded: dict[str, Encoder] = {}


def _odd_space(b: np.ndarray) -> np.ndarray:
    """Positions of bytes that begin a non-ASCII white-space character."""
    if not (b >= 0xC2).any():
        return np.zeros(0, np.int64)
    n = len(b)
    one, two = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    one[: n - 1], two[: max(0, n - 2)] = b[1:], b[2:]
    hit = (b == 0xC2) & ((one == 0x85) | (one == 0xA0))
    hit |= (b == 0xE1) & (one == 0x9A) & (two == 0x80)
    hit |= (b == 0xE2) & (((one == 0x80) & ((two <= 0x8A) | (two == 0xA8) | (two == 0xA9) | (two == 0xAF))) | ((one == 0x81) & (two == 0x9F)))
    hit |= (b == 0xE3) & (one == 0x80) & (two == 0x80)
    return np.flatnonzero(hit)


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The positions start..start+size-1 of every entry, one after the other."""
    before = np.cumsum(size) - size
    return np.repeat(start - before, size) + np.arange(int(size.sum()))


def _grown(a: np.ndarray, n: int) -> np.ndarray:
    """At least ``n`` entries, the old ones first."""
    if n <= len(a):
        return a
    out = np.zeros(max(n, len(a) + (len(a) >> 1)), a.dtype)
    out[: len(a)] = a
    return out


class Memory:
    """Ids of units by the pair of their hashes: an open table of slots, filled in batches."""

    def __init__(self):
        self.table = np.full(1 << 16, -1, np.int32)
        self.one, self.two = np.zeros(0, tv.U), np.zeros(0, tv.U)
        self.off, self.flat = np.zeros(1, np.int64), np.zeros(0, np.uint32)
        self.n = 0

    def find(self, one: np.ndarray, two: np.ndarray) -> np.ndarray:
        """The slot of each unit, -1 for unknown ones."""
        out = np.full(len(one), -1, np.int64)
        mask, left = tv.U(len(self.table) - 1), np.arange(len(one))
        at = one & mask
        while len(left):
            slot = self.table[at]
            met = slot >= 0
            left, at, slot = left[met], at[met], slot[met]
            same = (self.one[slot] == one[left]) & (self.two[slot] == two[left])
            out[left[same]] = slot[same]
            left, at = left[~same], at[~same] + tv.U(1) & mask
        return out

    def _place(self, slots: np.ndarray) -> None:
        mask = tv.U(len(self.table) - 1)
        at = self.one[slots] & mask
        while len(slots):
            free = self.table[at] < 0
            self.table[at[free]] = slots[free]
            out = self.table[at] != slots
            slots, at = slots[out], at[out] + tv.U(1) & mask

    def add(self, one: np.ndarray, two: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        """Keep new distinct units while there is room; arrays grow by half."""
        k = min(len(one), MEMO_UNITS - self.n)
        if k <= 0:
            return
        a, b = self.n, self.n + k
        ends = self.off[a] + np.cumsum(counts[:k])
        self.one, self.two, self.off, self.flat = _grown(self.one, b), _grown(self.two, b), _grown(self.off, b + 1), _grown(self.flat, int(ends[-1]))
        self.one[a:b], self.two[a:b], self.off[a + 1 : b + 1] = one[:k], two[:k], ends
        self.flat[self.off[a] : ends[-1]] = ids[: int(ends[-1] - self.off[a])]
        self.n = b
        if 2 * b > len(self.table):
            self.table = np.full(1 << (4 * b).bit_length(), -1, np.int32)
            self._place(np.arange(b, dtype=np.int32))
        else:
            self._place(np.arange(a, b, dtype=np.int32))


class Encoder:
    """One tokenizer file with the memory of its units, kept for the life of a worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            conf = json.load(f)
        self.added = [t["content"].encode() for t in conf.get("added_tokens") or () if t["content"]]
        self.byte = (conf.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
        self.memory = Memory()

    def _units(self, c: tv.Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        w = tv.words(c)
        if not self.byte:
            return w.start, w.end, w.first
        b, n = c.data, len(c.data)
        if not n:
            return w.start, w.end, w.first
        ws = tv.IS_WS[b]
        edge = np.zeros(n + 1, bool)
        edge[c.off] = True
        head = edge[:n].copy()  # starts of units
        prev = np.empty(n, bool)
        prev[0], prev[1:] = False, ws[:-1]
        head |= ws & ~prev  # a run begins
        last = np.zeros(n, bool)  # last of a run, with a word behind it
        last[:-1] = ws[:-1] & ~ws[1:] & ~edge[1:n]
        head |= last
        after = np.zeros(n, bool)
        after[1:] = last[:-1] & (b[:-1] != 0x20)
        head |= after
        start = np.flatnonzero(head)
        end = np.append(start[1:], n)
        return start, end, np.searchsorted(start, c.off)

    def _added_at(self, b: np.ndarray) -> list[int]:
        """Positions where the bytes of an added token begin."""
        raw = b.tobytes()
        return [m.start() for t in self.added for m in re.finditer(re.escape(t), raw)]

    def _learn(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Number of ids of each unit, and the ids."""
        counts, ids = [], []
        for i in range(0, len(texts), _BATCH):
            part = texts[i : i + _BATCH]
            e = self.tok.encode(part, is_pretokenized=True, add_special_tokens=False)
            counts.append(np.bincount(np.array(e.word_ids, np.int64), minlength=len(part)))
            ids.append(np.array(e.ids, np.uint32))
        return (np.concatenate(counts), np.concatenate(ids)) if counts else (np.zeros(0, np.int64), np.zeros(0, np.uint32))

    def encode(self, c: tv.Chunk) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk, and the offsets of its documents in them."""
        start, end, first = self._units(c)
        own = np.ascontiguousarray(c.data if self.byte else c.data[~tv.IS_WS[c.data]])
        offsets = np.concatenate([[0], np.cumsum(end - start)]).astype(np.int64)
        coded = pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(offsets), pa.py_buffer(own)).dictionary_encode()
        codes, units, memory = coded.indices.to_numpy(), coded.dictionary, self.memory
        at = np.frombuffer(units.buffers()[1], np.int64)[: len(units) + 1]
        raw = np.frombuffer(units.buffers()[2], np.uint8) if len(units) else np.zeros(0, np.uint8)
        one, two = tv.spans(raw, at[:-1], at[1:]), tv.spans(raw, at[:-1], at[1:], 1)
        slots = memory.find(one, two)
        known, new = np.flatnonzero(slots >= 0), np.flatnonzero(slots < 0)
        counts, ids = self._learn(units.take(pa.array(new)).to_pylist())
        sizes = np.zeros(len(units), np.int64)
        sizes[known], sizes[new] = memory.off[slots[known] + 1] - memory.off[slots[known]], counts
        begin = np.cumsum(sizes) - sizes
        flat = np.empty(int(sizes.sum()), np.uint32)
        flat[_ranges(begin[known], sizes[known])] = memory.flat[_ranges(memory.off[slots[known]], sizes[known])]
        flat[_ranges(begin[new], sizes[new])] = ids
        memory.add(one[new], two[new], counts, ids)
        total = np.zeros(len(codes) + 1, np.int64)
        np.cumsum(sizes[codes], out=total[1:])
        ids = flat[_ranges(begin[codes], sizes[codes])]
        docs = total[first]
        odd = np.append(_odd_space(c.data) if self.byte else np.zeros(0, np.int64), self._added_at(c.data)).astype(np.int64)
        if len(odd):
            parts = [ids[docs[i] : docs[i + 1]] for i in range(c.n)]
            for i in np.unique(np.searchsorted(c.off, odd, "right") - 1):
                text = c.data[c.off[i] : c.off[i + 1]].tobytes().decode("utf-8")
                parts[i] = np.array(self.tok.encode(text, add_special_tokens=False).ids, np.uint32)
            ids = np.concatenate(parts)
            docs = np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, docs


def encoder(path: str) -> Encoder:
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def with_end(ids: np.ndarray, docs: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` behind every document, and the new offsets."""
    return np.insert(ids, docs[1:], np.uint32(end)).astype("<u4"), docs + np.arange(len(docs))
