"""Packed exchange of hash keys between documents, with answers that go back to them.

Map tasks send a packed row (keys and documents as binary arrays) to each part of
the key space, a part judges all its keys together, and what it picks goes back
as packed rows to buckets of documents. Parts and buckets grow in number with the
text, not in size, so the memory of a task is bounded.

Were every buffer cut into all parts at once, the number of packed rows would grow
with the square of the input. Beyond ``fan`` destinations rows are therefore dealt
in two steps, like a radix sort: first to groups of ``fan`` destinations, where
they are gathered again in large buffers, then to the destinations. The number of
packed rows then grows in proportion to the input.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textvec as tv

PART_BYTES = 16 << 20
BUFFER = 2_000_000
FAN = 2048
SALTS = 64
TASKS = 64
_SHIFT, _LOW = tv.U(32), tv.U(0xFFFFFFFF)

#: ``known`` rows need no judgement: they are answers to pass on.
PACKED = "dest int, known boolean, keys binary, marks binary, seconds binary, docs binary, counts binary"
_NAMES = [x.split()[0] for x in PACKED.split(", ")]
_KINDS = [pa.int32(), pa.bool_(), *[pa.binary()] * 5]


@dataclass(frozen=True)
class Plan:
    """Numbers of parts (of the key space) and buckets (of documents), and how many a single step deals to."""

    parts: int
    buckets: int
    fan: int = FAN
    salts: int = SALTS

    @staticmethod
    def for_bytes(size: int, fan: int = FAN) -> Plan:
        parts = int(size // PART_BYTES) + 1
        return Plan(parts, max(32, 2 * parts), fan)

    def parts_of(self, keys: np.ndarray) -> np.ndarray:
        return ((keys >> _SHIFT) * tv.U(self.parts) >> _SHIFT).astype(np.int64)

    def short(self, keys: np.ndarray) -> np.ndarray:
        """Part and low half of each key, as answers to 32-bit keys give it."""
        return self.parts_of(keys).astype(tv.U) << _SHIFT | keys & _LOW


def bucket_of(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (ids ^ (ids >> 17)) % buckets


def bucket_column(ident: Column, other: Column, buckets: int) -> Column:
    """The same as :func:`bucket_of`; rows without an id spread by ``other``, as no answers await them."""
    return F.coalesce(F.pmod(ident.bitwiseXOR(F.shiftright(ident, 17)), F.lit(buckets).cast("long")), F.pmod(F.xxhash64(other), F.lit(buckets))).cast("int")


def _coarse(dest: np.ndarray, plan: Plan, dests: int) -> np.ndarray:
    return dest // plan.fan if dests > plan.fan else dest


def pack(dest: np.ndarray, keys: np.ndarray, docs: np.ndarray, plan: Plan, marks: np.ndarray | None = None, seconds: np.ndarray | None = None, known: bool = False, dests: int | None = None, narrow: bool = False) -> Iterator[tuple]:
    """One row per destination (or group of them): keys in order of their documents, marks as bits, runs of documents.

    ``narrow`` keys are cut to 32 bits (their part says most of the rest) once they are on the way to their part.
    """
    dests = dests or plan.parts
    dest = _coarse(dest, plan, dests)
    wide = not narrow or dests > plan.fan
    order = np.argsort(dest.astype(np.uint16) if dests < 1 << 16 else dest, kind="stable")
    cut = np.flatnonzero(np.append(True, dest[order][1:] != dest[order][:-1]))[: len(order)]
    for a, b in zip(cut, np.append(cut[1:], len(order))):
        rows = order[a:b]
        d = docs[rows]
        run = np.flatnonzero(np.append(True, d[1:] != d[:-1]))
        yield (
            int(dest[rows[0]]), known, keys[rows].astype("<u8").tobytes() if wide else (keys[rows] & _LOW).astype("<u4").tobytes(),
            np.packbits(marks[rows]).tobytes() if marks is not None else b"", seconds[rows].astype("<u8").tobytes() if seconds is not None else b"",
            d[run].astype("<i8").tobytes(), np.diff(np.append(run, len(d))).astype("<u4").tobytes(),
        )


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [()] * len(_KINDS)
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, _KINDS)], names=_NAMES)


def _emit(rows: Iterator[tuple], size: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    held, bytes_held = [], 0
    for r in rows:
        held.append(r)
        bytes_held += len(r[2])
        if bytes_held >= size:
            yield _batch(held)
            held, bytes_held = [], 0
    if held:
        yield _batch(held)


def buffered(entries: Callable, flush: Callable, limit: int = BUFFER) -> Callable:
    """A map function over (id, value) rows: ``entries`` gives (keys, docs, third) arrays, ``flush`` packs a buffer of them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def out() -> Iterator[pa.RecordBatch]:
            yield from _emit(flush(*[np.concatenate(x) for x in zip(*held)]))
            held.clear()

        for batch in batches:
            if not batch.num_rows:
                continue
            for got in entries(batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)):
                if len(got[0]):
                    held.append(got)
                    n += len(got[0])
                if n >= limit:
                    yield from out()
                    n = 0
        if held:
            yield from out()

    return run


def _opened(cols: list, i: int, dest: int, wide: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, documents and third values (second hashes or marks) of one packed row."""
    raw, marks, seconds, docs, counts = [c[i].as_py() for c in cols[2:]]
    keys = np.frombuffer(raw, "<u8" if wide else "<u4").astype(tv.U)
    if not wide:
        keys |= tv.U(dest) << _SHIFT
    third = np.frombuffer(seconds, "<u8") if seconds else np.unpackbits(np.frombuffer(marks, np.uint8), count=len(keys)).astype(bool) if marks else np.zeros(len(keys), bool)
    return keys, np.repeat(np.frombuffer(docs, "<i8"), np.frombuffer(counts, "<u4")), third


def _regroup(plan: Plan, dests: int, of_docs: bool, narrow: bool) -> Callable:
    """Rows of groups, sorted by group, gathered in buffers and dealt to the group's destinations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, list] = {}
        now, n = None, 0

        def out() -> Iterator[tuple]:
            for (known, two), parts in held.items():
                keys, docs, third = [np.concatenate(x) for x in zip(*parts)]
                dest = bucket_of(docs, dests) if of_docs else plan.parts_of(keys)
                one = Plan(plan.parts, plan.buckets, 1 << 31)
                args = {"seconds": third} if two else {} if known else {"marks": third}
                yield from pack(dest, keys, docs, one, known=known, dests=dests, narrow=narrow, **args)
            held.clear()

        for batch in batches:
            cols = [batch.column(j) for j in range(7)]
            for i, group in enumerate(cols[0].to_pylist()):
                if group != now or n >= 8 * BUFFER:
                    yield from _emit(out())
                    now, n = group, 0
                got = _opened(cols, i, group, True)
                held.setdefault((cols[1][i].as_py(), bool(cols[4][i].as_py())), []).append(got)
                n += len(got[0])
        yield from _emit(out())

    return run


def _tasks(dests: int) -> int:
    """Destinations share tasks once there are many of them; each is still judged on its own."""
    return min(dests, max(TASKS, dests // 8))


def deal(packed: DataFrame, dests: int, plan: Plan, of_docs: bool = False, narrow: bool = False) -> DataFrame:
    """Packed rows with those of a destination together, sorted by destination."""
    if dests > plan.fan:
        groups = -(-dests // plan.fan)
        salt = F.pmod(F.xxhash64("keys"), F.lit(plan.salts))
        grouped = packed.repartitionById(groups * plan.salts, (F.col("dest") * plan.salts + salt).cast("int")).sortWithinPartitions("dest")
        packed = grouped.mapInArrow(_regroup(plan, dests, of_docs, narrow), PACKED)
    if of_docs:
        return packed
    n = _tasks(dests)
    return packed.repartitionById(n, F.pmod("dest", F.lit(n)).cast("int")).sortWithinPartitions("dest")


def judged(dealt: DataFrame, plan: Plan, judge: Callable) -> DataFrame:
    """What ``judge(keys, docs, third)`` finds in each part (positions, or keys and documents), and what is known, as packed answers by bucket of documents."""

    def answers(keys: np.ndarray, docs: np.ndarray) -> Iterator[tuple]:
        order = np.lexsort((keys, docs))
        keys, docs = keys[order], docs[order]
        fresh = np.append(True, (keys[1:] != keys[:-1]) | (docs[1:] != docs[:-1]))[: len(keys)]
        keys, docs = keys[fresh], docs[fresh]
        yield from pack(bucket_of(docs, plan.buckets), keys, docs, plan, known=True, dests=plan.buckets)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, asked, passed, n = None, [], [], 0

        def done() -> Iterator[tuple]:
            keys, docs = [x[0] for x in passed], [x[1] for x in passed]
            if asked:
                k, d, third = [np.concatenate(x) for x in zip(*asked)]
                hit = judge(k, d, third)
                found = hit if isinstance(hit, tuple) else (k[hit], d[hit])
                keys, docs = [*keys, found[0]], [*docs, found[1]]
            asked.clear()
            passed.clear()
            if keys:
                yield from answers(np.concatenate(keys), np.concatenate(docs))

        for batch in batches:
            cols = [batch.column(j) for j in range(7)]
            for i, part in enumerate(cols[0].to_pylist()):
                if part != now:
                    yield from _emit(done())
                    now, n = part, 0
                known = cols[1][i].as_py()
                wide = len(cols[2][i].as_py()) == 8 * int(np.frombuffer(cols[6][i].as_py(), "<u4").sum())
                got = _opened(cols, i, part, wide)
                (passed if known else asked).append(got)
                n += len(got[0]) if known else 0
                if n >= BUFFER:
                    # Known answers need no gathering: they go on as they come.
                    yield from _emit(answers(np.concatenate([x[0] for x in passed]), np.concatenate([x[1] for x in passed])))
                    passed.clear()
                    n = 0
        yield from _emit(done())

    return dealt.mapInArrow(run, PACKED)


class Answers:
    """The answers of one bucket by document."""

    def __init__(self, table: pa.Table):
        keys, docs = [np.zeros(0, tv.U)], [np.zeros(0, np.int64)]
        for raw, ids, counts in zip(*[table.column(n).to_pylist() for n in ("keys", "docs", "counts")]):
            keys.append(np.frombuffer(raw, "<u8"))
            docs.append(np.repeat(np.frombuffer(ids, "<i8"), np.frombuffer(counts, "<u4")))
        keys, docs = np.concatenate(keys), np.concatenate(docs)
        order = np.argsort(docs, kind="stable")
        self.keys, self.docs = keys[order], docs[order]

    def of(self, doc: int | None) -> np.ndarray:
        if doc is None:
            return self.keys[:0]
        return self.keys[np.searchsorted(self.docs, doc) : np.searchsorted(self.docs, doc, "right")]


def answered(rows: DataFrame, answers: DataFrame, plan: Plan, fn: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """``fn`` over the rows (``_id``, ``text``, ``rest``) and the answers of each bucket (a bounded share of the text).

    ``schema`` names its columns but for ``rest``, which goes through with its type.
    """
    n = _tasks(plan.buckets)
    left = rows.withColumn("bucket", bucket_column(F.col("_id"), F.col("text"), plan.buckets)).repartition(n, "bucket")
    right = deal(answers, plan.buckets, plan, of_docs=True).withColumnRenamed("dest", "bucket").repartition(n, "bucket")
    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(fn, StructType.fromDDL(schema).add("rest", rows.schema["rest"].dataType))
