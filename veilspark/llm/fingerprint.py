"""Context-triggered piecewise hashing of whole texts, and likeness of two texts.

A rolling hash over the last 7 bytes ends a chunk where it is -1 modulo the
block size; each chunk gives one of 64 characters. A fingerprint holds the
block size and the signatures at it and at twice it, as ``size:one:two``. The
block size is the smallest ``3 * 2**k`` that needs at most 64 characters by
length, halved while the first signature has fewer than 32. Two fingerprints
are compared at the block size they share by the edit distance (insertions
and deletions) of their signatures; signatures without a common run of 7
characters (or equality) have likeness 0.

Signatures end at 64 and 32 characters: what is behind the last boundary that fits
is one chunk, as usual for the method, so a change there alters one character.

The ``next`` document is the one with the next smaller doc_id (after the
smallest: the largest). Rows are dealt to at most ``MOST_RANGES`` ranges of (doc_id,
hash of the text), sorted in each, so equal or null doc_ids are no hot key. Within a
range a row's next is the row behind it; the last row of a range waits for the first
of the range behind, and those rows, two a range, meet by a join.

Edge cases: null text is empty, its fingerprint ``3::``, and two empty texts
have likeness 1; repeated doc_ids follow each other in the order of a
hash of their texts; a null doc_id is smallest; with a single row the next document is that
row; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .workspace import pick, written

ROLL = 7
LEAST_BLOCK = 3
LENGTH = 64
COMMON = 7
RANGE_BYTES = 16 << 20
MOST_RANGES = 16_384
_CHARS = np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", np.uint8)
_NULL = -(1 << 63)
_BYTE = np.random.default_rng(0x5EED).integers(0, 1 << 63, 256, dtype=np.int64).view(tv.U) * tv.U(2) + tv.U(1)
_P = 0x9E3779B97F4A7C15
_P_INV = pow(_P, -1, 1 << 64)


def _roll(data: np.ndarray) -> np.ndarray:
    """32-bit hash of the 7 bytes that end at each position (zeros before the text)."""
    mixed = (_BYTE[data] >> tv.U(32)).astype(np.uint32)
    out = np.zeros(len(data), np.uint32)
    factor = 1
    for j in range(min(ROLL, len(data))):
        out[j:] += mixed[: len(data) - j] * np.uint32(factor)
        factor = factor * 0x9E3779B1 & 0xFFFFFFFF
    out ^= out >> np.uint32(15)
    out *= np.uint32(0x85EBCA6B)
    out ^= out >> np.uint32(13)
    return out


@lru_cache(2)
def _table(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, tv.U)
    out[0] = 1
    return np.cumprod(out, dtype=tv.U)


def _powers(base: int, n: int) -> np.ndarray:
    return _table(base, max(1 << 16, 1 << (n - 1).bit_length()))[:n]


def _sums(data: np.ndarray) -> np.ndarray:
    """Running polynomial sums of the bytes: six bits of a chunk's sum are its character."""
    total = np.zeros(len(data) + 1, tv.U)
    np.cumsum(_BYTE[data] * _powers(_P, len(data)), dtype=tv.U, out=total[1:])
    return total


def _characters(total: np.ndarray, start: np.ndarray, stop: np.ndarray) -> str:
    h = tv.mix((total[stop] - total[start]) * _powers(_P_INV, len(total))[start])
    return _CHARS[(h >> tv.U(58)).astype(np.int64)].tobytes().decode()


def fingerprint(data: np.ndarray) -> str:
    """Fingerprint of the bytes of one text."""
    n = len(data)
    if not n:
        return f"{LEAST_BLOCK}::"
    roll, total = _roll(data), _sums(data)
    block = LEAST_BLOCK
    while block * LENGTH < n:
        block *= 2

    def ends(size: int, among: np.ndarray | None = None) -> np.ndarray:
        at = np.flatnonzero(roll % np.uint32(size) == size - 1) if among is None else among[roll[among] % np.uint32(size) == size - 1]
        return at

    least = block
    while least > LEAST_BLOCK:
        at = ends(least)
        if len(at) >= LENGTH // 2:
            break
        least //= 2
    one = ends(least)
    parts = []
    for at, most in ((one, LENGTH), (ends(least * 2, one), LENGTH // 2)):
        stop = np.append(at[: most - 1] + 1, n)
        stop = stop[:-1] if len(stop) > 1 and stop[-2] == n else stop
        start = np.append(0, stop[:-1])
        parts.append(_characters(total, start, stop))
    return f"{least}:{parts[0]}:{parts[1]}"


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, one bit per character of ``a``."""
    rows: dict[str, int] = {}
    for i, x in enumerate(a):
        rows[x] = rows.get(x, 0) | 1 << i
    full = (1 << len(a)) - 1
    v = full
    for x in b:
        u = v & rows.get(x, 0)
        v = (v + u | v - u) & full
    return len(a) - v.bit_count()


def _alike(a: str, b: str) -> float:
    if a == b:
        return 1.0
    shorter = min(len(a), len(b))
    if shorter < COMMON:
        return 0.0
    grams = {a[i : i + COMMON] for i in range(len(a) - COMMON + 1)}
    if not any(b[i : i + COMMON] in grams for i in range(len(b) - COMMON + 1)):
        return 0.0
    return 2.0 * _common(a, b) / (len(a) + len(b))


def likeness(x: str, y: str) -> float:
    """0 to 1: 1 - edit distance over the sum of lengths, at a shared block size."""
    if x == y:
        return 1.0
    bx, x1, x2 = x.split(":")
    by, y1, y2 = y.split(":")
    bx, by = int(bx), int(by)
    if not (x1 and y1):
        return 0.0
    if bx == by:
        return max(_alike(x1, y1), _alike(x2, y2))
    if bx == 2 * by:
        return _alike(x1, y2)
    if by == 2 * bx:
        return _alike(x2, y1)
    return 0.0


def edited(text: str, other: str) -> str:
    """``text`` with its last half replaced by as much of the start of ``other``."""
    half = len(text) // 2
    return text[: len(text) - half] + other[:half]


def _bytes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode(), np.uint8)


_FIELDS = [("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64())]
_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _compared(ident: int, text: str, fp: str, other: str, other_fp: str) -> tuple:
    new = edited(text, other)
    raw = new.encode()
    new_fp = fingerprint(np.frombuffer(raw, np.uint8))
    return None if ident == _NULL else ident, len(text), hashlib.sha256(raw).hexdigest(), fp, new_fp, likeness(fp, new_fp), likeness(fp, other_fp)


#: Kinds of rows of a range: compared with their next, the first of the range, the last of the range.
_DONE, _FIRST, _LAST = 0, 1, 2
_RANGED = "range int, kind int, key long, text string, "


def _rows(rows: list[tuple], fields: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, fields)], names=[n for n, _ in fields])


def _pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted; each is compared with the one behind it."""
    here, last, none = TaskContext.get().partitionId(), None, (None,) * len(_FIELDS)
    fields = [("range", pa.int32()), ("kind", pa.int32()), ("key", pa.int64()), ("text", pa.string()), *_FIELDS]
    for batch in batches:
        out = []
        for key, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            text = text.as_py()
            fp = fingerprint(_bytes(text))
            if last is None:
                out.append((here, _FIRST, key, text, *none))
            else:
                out.append((here, _DONE, None, None, *_compared(*last, text, fp)))
            last = key, text, fp
        yield _rows(out, fields)
    if last is not None:
        yield _rows([(here, _LAST, *last[:2], *none)], fields)


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(k, t, fingerprint(_bytes(t)), o, fingerprint(_bytes(o))) for k, t, o in zip(*[batch.column(j).to_pylist() for j in range(3)])]
        yield _rows([_compared(*r) for r in rows], _FIELDS)


def compare_edits(docs: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Fingerprints of every row's text and edited text, and their likenesses."""
    text = F.coalesce("text", F.lit(""))
    keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(_NULL)).alias("key"), text.alias("text"), F.xxhash64(text).alias("h"))
    size = keyed.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    ranges = min(MOST_RANGES, int(size // range_bytes) + 1)
    ordered = keyed.repartitionByRange(ranges, F.desc("key"), "h").sortWithinPartitions(F.desc("key"), "h", "text").select("key", "text")
    done = written(ordered.mapInArrow(_pairs, _RANGED + _SCHEMA), "pairs")
    first = done.where(F.col("kind") == _FIRST)
    # One row per range that has rows: which range comes behind it.
    order = Window.orderBy("range")
    behind = first.select("range", F.coalesce(F.lead("range").over(order), F.min("range").over(Window.partitionBy())).alias("behind"))
    others = first.select(F.col("range").alias("behind"), F.col("text").alias("other"))
    met = done.where(F.col("kind") == _LAST).select("range", "key", "text").join(behind, "range").join(others, "behind").select("key", "text", "other")
    names = [n for n, _ in _FIELDS]
    return done.where(F.col("kind") == _DONE).select(*names).unionByName(met.mapInArrow(_across, _SCHEMA))


def query(spark, sf_dir: str) -> DataFrame:
    return compare_edits(pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
