"""Exact substring dedup with fixed-block anchors.

A window of 13 words that also starts in a document with a smaller doc_id is
removed. Any 13 words hold a whole block of 7 words that begins at a multiple
of 7 in the other document. So:

1. Anchors. The non-overlapping 7-word blocks of every document are the index,
   every rolling 7-word window is a probe. They meet by hash part; a window is a
   hit if some document has it as a block and another document has it too.
2. Extension. Around its hits each document extends to the 13-word windows that
   hold one. These meet by two independent 64-bit hashes, and a window is covered
   if a smaller doc_id has it. A maximal exact repeat is a run of covered windows.
3. Removal of covered words.

Nothing is sent per word: map tasks send packed rows (see :mod:`exchange`), and
combine first. Of the documents in a task's buffer that share a window which is
certain to be a hit (step 1) or the same 13 words (step 2) only the one with the
smallest doc_id goes on to the judgement; what the others are is known, so their
answers are just passed on. So a passage that a third of all documents share costs
its part a few entries for each buffer of text, not one for each document.

Edge cases: null text is empty (no words, the hash of the empty string; it stays
null in :func:`deduplicated`); documents with fewer than 13 words lose nothing;
rows without a doc_id neither remove nor lose anything; rows that share a doc_id
do not remove each other's words, and each is judged by its own text; an empty
table gives an empty result; further input columns are ignored by
:func:`removals` and kept by :func:`deduplicated`, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .exchange import PACKED, Answers, Plan, answered, buffered, deal, judged, pack
from .workspace import Space, pick, written

WINDOW = 13
BLOCK = (WINDOW + 1) // 2
#: So many entries of a window in one buffer are hits even if none of them is a block (one of another buffer almost surely is).
MANY = 32
#: Keys that a map task gathers at a time, about 100 bytes each at the peak.
KEYS = 1_000_000


def _windows(w: tv.Words, h: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start word and hash of every k-window of documents that have a full window of WINDOW."""
    at = tv.starts_of(w.first, k)
    at = at[(w.count >= WINDOW)[tv.owner(w.first)[at]]] if len(at) else at
    return at, tv.rolling(h, k)[at] if len(at) else np.zeros(0, tv.U)


def _probe(plan: Plan) -> Callable:
    """Packed 7-word windows: marked where they are blocks, and those with a partner in the buffer already."""

    def entries(ids: np.ndarray, texts: pa.Array) -> Iterator[tuple]:
        for c in tv.chunks(texts):
            w = tv.words(c)
            at, keys = _windows(w, tv.spans(c.data, w.start, w.end), BLOCK)
            doc = tv.owner(w.first)[at] if len(at) else at
            yield keys, ids[c.lo : c.hi][doc], (at - w.first[doc]) % BLOCK == 0

    def flush(keys: np.ndarray, docs: np.ndarray, block: np.ndarray) -> Iterator[tuple]:
        order, start, low, high = _runs(keys, docs)
        # In a group of two documents with a block, or of many, all are hits, and one entry speaks for them to the others.
        size = np.diff(np.append(start, len(keys)))
        marked = np.logical_or.reduceat(block[order], start)
        sure = np.repeat(marked | (size >= MANY), size) & (low < high)
        head = _heads(order, start, docs[order] == low)
        lead, hit, block = np.ones(len(keys), bool), np.zeros(len(keys), bool), block.copy()
        block[head] = marked
        hit[order[sure]], lead[order[sure]], lead[head] = True, False, True
        yield from pack(plan.parts_of(keys[lead]), keys[lead], docs[lead], plan, marks=block[lead], narrow=True)
        yield from pack(plan.parts_of(keys[hit]), keys[hit], docs[hit], plan, known=True, narrow=True)

    return _lean(buffered(entries, flush, KEYS))


def _lean(run: Callable) -> Callable:
    """The map function in a worker that first gives back what earlier stages left in Arrow's memory."""

    def lean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pa.default_memory_pool().release_unused()
        yield from run(batches)

    return lean


def _runs(keys: np.ndarray, docs: np.ndarray, more: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Order by key (and ``more``), starts of the runs, and each entry's smallest and largest document of its run."""
    order = np.argsort(keys, kind="stable") if more is None else np.lexsort((more, keys))
    s = keys[order]
    new = s[1:] != s[:-1]
    if more is not None:
        new |= more[order][1:] != more[order][:-1]
    start = np.flatnonzero(np.append(True, new))
    size = np.diff(np.append(start, len(s)))
    d = docs[order]
    return order, start, np.repeat(np.minimum.reduceat(d, start), size), np.repeat(np.maximum.reduceat(d, start), size)


def _heads(order: np.ndarray, start: np.ndarray, lowest: np.ndarray) -> np.ndarray:
    """Of every run the first entry that is marked in ``lowest`` (in sorted order)."""
    return order[np.minimum.reduceat(np.where(lowest, np.arange(len(order)), len(order)), start)]


def _hits(keys: np.ndarray, docs: np.ndarray, marks: np.ndarray) -> np.ndarray:
    order, start, low, high = _runs(keys, docs)
    size = np.diff(np.append(start, len(keys)))
    block = np.repeat(np.logical_or.reduceat(marks[order], start), size)
    return order[block & (low < high)]


def _covered(keys: np.ndarray, docs: np.ndarray, seconds: np.ndarray) -> np.ndarray:
    order, _, low, _ = _runs(keys, docs, seconds)
    return order[docs[order] > low]


_EXTENDED = [("_id", pa.int64()), ("n_words", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string()), ("windows", pa.binary())]


def _extend(plan: Plan, keep_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """Rows without a hit are done; others get a bit for each 13-word window, set if it holds a hit."""

    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        known, out = Answers(found), []
        ids = rows.column("_id").to_pylist()
        given = rows.column("text").combine_chunks()
        for c in tv.chunks(given):
            w = tv.words(c)
            h = tv.spans(c.data, w.start, w.end)
            seven = plan.short(tv.rolling(h, BLOCK))
            raw = c.data.tobytes()
            texts, sums, windows = [], [], []
            for i in range(c.n):
                a, b = w.first[i], w.first[i + 1]
                mine = known.of(ids[c.lo + i]) if b - a >= WINDOW else known.keys[:0]
                x = raw[c.off[i] : c.off[i + 1]]
                if len(mine):
                    hit = np.isin(seven[a : b - BLOCK + 1], mine)
                    total = np.concatenate([[0], np.cumsum(hit)])
                    n = b - a - WINDOW + 1
                    holds = total[WINDOW - BLOCK + 1 : WINDOW - BLOCK + 1 + n] > total[:n]
                    texts.append(x.decode())
                    sums.append(None)
                    windows.append(np.packbits(holds).tobytes())
                else:
                    texts.append(given[c.lo + i].as_py() if keep_text else None)
                    sums.append(None if keep_text else hashlib.sha256(b" ".join(x.split())).hexdigest())
                    windows.append(None)
            cols = [rows.column("_id").slice(c.lo, c.n).combine_chunks(), pa.array(w.count.astype(np.int64)), pa.array(sums, pa.string()), pa.array(texts, pa.string()), pa.array(windows, pa.binary())]
            out.append(pa.table([*cols, rows.column("rest").slice(c.lo, c.n).combine_chunks()], names=[n for n, _ in _EXTENDED] + ["rest"]))
        return pa.concat_tables(out) if out else pa.schema([*_EXTENDED, ("rest", rows.schema.field("rest").type)]).empty_table()

    return run


def _spread(plan: Plan) -> Callable:
    """Packed 13-word windows; of a buffer's documents with a window all but the smallest are covered."""

    def entries(ids: np.ndarray, rows: pa.StructArray) -> Iterator[tuple]:
        marks = rows.field("windows")
        for c in tv.chunks(rows.field("text")):
            w = tv.words(c)
            one, two = [tv.rolling(tv.spans(c.data, w.start, w.end, seed), WINDOW, seed) for seed in (0, 1)]
            mask = np.zeros(len(one), bool)
            for i, n in enumerate(w.count - WINDOW + 1):
                mask[w.first[i] : w.first[i] + n] = np.unpackbits(np.frombuffer(marks[c.lo + i].as_py(), np.uint8), count=int(n))
            at = np.flatnonzero(mask)
            yield one[at], ids[c.lo : c.hi][tv.owner(w.first)[at]], two[at]

    def flush(keys: np.ndarray, docs: np.ndarray, seconds: np.ndarray) -> Iterator[tuple]:
        order, start, low, _ = _runs(keys, docs, seconds)
        lead, covered = np.zeros(len(keys), bool), np.zeros(len(keys), bool)
        lead[_heads(order, start, docs[order] == low)], covered[order[docs[order] > low]] = True, True
        yield from pack(plan.parts_of(keys[lead]), keys[lead], docs[lead], plan, seconds=seconds[lead])
        yield from pack(plan.parts_of(keys[covered]), keys[covered], docs[covered], plan, known=True)

    return _lean(buffered(entries, flush, KEYS))


_REMOVED = [("_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("text", pa.string())]


def _remove(keep_text: bool) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(rows: pa.Table, found: pa.Table) -> pa.Table:
        known, out = Answers(found), []
        ids = rows.column("_id").to_pylist()
        for c in tv.chunks(rows.column("text")):
            w = tv.words(c)
            thirteen = tv.rolling(tv.spans(c.data, w.start, w.end), WINDOW)
            raw = c.data.tobytes()
            removed, sums, texts = [], [], []
            for i in range(c.n):
                a, b = w.first[i], w.first[i + 1]
                mine = known.of(ids[c.lo + i])
                at = np.flatnonzero(np.isin(thirteen[a : b - WINDOW + 1], mine)) if len(mine) and b - a >= WINDOW else np.zeros(0, np.int64)
                mask = tv.cover(at, WINDOW, b - a)
                x = raw[c.off[i] : c.off[i + 1]]
                kept = b" ".join(compress(x.split(), ~mask))
                removed.append(int(mask.sum()))
                sums.append(hashlib.sha256(kept).hexdigest())
                texts.append((kept if mask.any() else x).decode() if keep_text else None)
            cols = [rows.column("_id").slice(c.lo, c.n).combine_chunks(), pa.array(w.count.astype(np.int64)), pa.array(removed, pa.int64()), pa.array(sums, pa.string()), pa.array(texts, pa.string())]
            out.append(pa.table([*cols, rows.column("rest").slice(c.lo, c.n).combine_chunks()], names=[n for n, _ in _REMOVED] + ["rest"]))
        return pa.concat_tables(out) if out else pa.schema([*_REMOVED, ("rest", rows.schema.field("rest").type)]).empty_table()

    return run


def _run(docs: DataFrame, keep: list[str] | None, plan: Plan | None = None) -> DataFrame:
    """_id, n_words, n_removed, kept_sha256, text (if kept) and ``rest``, the struct of the columns to keep, of every row."""
    rest = F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(keep)]) if keep else F.struct(F.lit(None).cast("int").alias("c"))
    rows = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text"), rest.alias("rest"))
    plan = plan or Plan.for_bytes(rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0)
    known = rows.select("_id", "text").where("_id IS NOT NULL AND text IS NOT NULL")
    hits = judged(deal(known.mapInArrow(_probe(plan), PACKED), plan.parts, plan, narrow=True), plan, _hits)
    extended = written(answered(rows, hits, plan, _extend(plan, keep is not None), "_id long, n_words long, kept_sha256 string, text string, windows binary"), "extended")
    with_hits = extended.where("windows IS NOT NULL")
    windows = with_hits.select("_id", F.struct("text", "windows").alias("w"))
    covered = judged(deal(windows.mapInArrow(_spread(plan), PACKED), plan.parts, plan), plan, _covered)
    out = answered(with_hits.select("_id", "text", "rest"), covered, plan, _remove(keep is not None), "_id long, n_words long, n_removed long, kept_sha256 string, text string")
    plain = extended.where("windows IS NULL").select("_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256", "text", "rest")
    return plain.unionByName(out)


def removals(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """doc_id, n_words, n_removed and kept_sha256 of every row."""
    return _run(docs, None, plan).select(F.col("_id").alias("doc_id"), "n_words", "n_removed", "kept_sha256")


def deduplicated(docs: DataFrame, plan: Plan | None = None) -> DataFrame:
    """The documents (all columns) with covered words removed from ``text``.

    Texts that lose nothing stay as they are; others become their kept words
    joined by one space, with ``n_chars``, if there is such a column, renewed.
    Rows carry all their columns through the stages, so none is matched again. The result is stored.
    """
    keep = [c for c in docs.columns if c != "text"]

    def column(name: str) -> Column:
        if name == "text":
            return F.col("text")
        value = F.col(f"rest.c{keep.index(name)}")
        if name == "n_chars":
            value = F.when(F.col("n_removed") > 0, F.length("text").cast(docs.schema[name].dataType)).otherwise(value)
        return value.alias(name)

    with Space() as space:
        out = _run(docs, keep, plan)
        return space.keep(written(out.select(*[column(c) for c in docs.columns]), "deduplicated"))


def query(spark, sf_dir: str) -> DataFrame:
    return removals(pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), g AS (
  SELECT doc_id, i, array_to_string(ws[i:i+12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM w WHERE len(ws) >= 13)
), c AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY k) AS lo FROM g) WHERE lo < doc_id
), r AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 13)) AS p FROM c) GROUP BY doc_id
), e AS (
  SELECT w.doc_id, ws, coalesce(ps, []) AS ps FROM w LEFT JOIN r ON w.doc_id = r.doc_id
), x AS (
  SELECT doc_id, n, list_filter(list_transform(range(1, n + 1), lambda i: CASE WHEN m[i] THEN NULL ELSE ws[i] END), lambda x: x IS NOT NULL) AS kept, gone
  FROM (SELECT doc_id, ws, len(ws) AS n, len(ps) AS gone, list_transform(range(1, len(ws) + 1), lambda i: list_contains(ps, i)) AS m FROM e)
)
SELECT doc_id, n::BIGINT AS n_words, gone::BIGINT AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM x
"""
