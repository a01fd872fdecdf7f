"""Best-fit packing by minimum bin slack over the histogram of piece lengths.

Texts become token ids and pieces of at most ``size`` tokens. What decides the
packing is how many pieces have each length: at most ``size`` numbers. For
each bin the longest piece left is taken and a bitset subset-sum over the
lengths left finds the fullest combination with it; that combination is then
taken as often as the counts allow. So the plan's work is bounded by ``size``,
not by the number of pieces. Pieces find their place by their rank among the
pieces of their length, counted in salted buckets, so a length that a third of
all pieces share is never ordered in one task.

Edge cases: null or empty text is one piece with the end id alone; repeated
rows are packed as often as they occur; a null doc_id is kept; an empty table
gives an empty result; further input columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from . import textvec as tv
from .workspace import pick, written

SIZE = 1024
END_ID = 2
TOKENIZER = "byte_bpe_50k.json"
BUCKET_ROWS = 50_000


def fullest(counts: list[int], size: int) -> dict[int, int]:
    """The longest available length and the combination that leaves least room beside it.

    ``counts[n]`` pieces of length n are left. Bit s of ``reach`` says that some
    of the lengths seen so far sum to s.
    """
    top = max(n for n in range(1, size + 1) if counts[n])
    room = size - top
    mask = (1 << (room + 1)) - 1
    reach, steps = 1, []
    for n in range(min(room, top), 0, -1):
        left = min(counts[n] - (n == top), room // n)
        part = 1
        while left > 0 and not reach >> room & 1:
            part = min(part, left)
            steps.append((n, part, reach))
            reach |= (reach << n * part) & mask
            left -= part
            part *= 2
        if reach >> room & 1:
            break
    target, found = reach.bit_length() - 1, {top: 1}
    for n, part, before in reversed(steps):
        if not before >> target & 1:
            found[n] = found.get(n, 0) + part
            target -= n * part
    return found


def bin_plan(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, int, int, int, int]]:
    """Segments (length, lo, hi, sequence, offset): the pieces of a length with ranks
    lo..hi-1 begin at ``offset`` of the sequences ``sequence``, ``sequence + 1``, ..."""
    counts = [0] * (size + 1)
    for n, k in histogram.items():
        counts[n] = k
    used, out, sequence = [0] * (size + 1), [], 0
    while any(counts):
        combo = fullest(counts, size)
        times = min(counts[n] // k for n, k in combo.items())
        offset = 0
        for n in sorted(combo, reverse=True):
            for _ in range(combo[n]):
                out.append((n, used[n], used[n] + times, sequence, offset))
                used[n] += times
                counts[n] -= times
                offset += n
        sequence += times
    return out


def _cutter(path: str, size: int, end: int, keep_ids: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = bpe.encoder(path)
        for batch in batches:
            for c in tv.chunks(batch.column(1), bpe.CHUNK_BYTES):
                ids, docs = bpe.with_end(*enc.encode(c), end)
                n = np.diff(docs)
                pieces = (n + size - 1) // size
                doc = np.repeat(np.arange(c.n), pieces)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
                head = (n - (pieces - 1) * size)[doc]
                start = np.where(piece == 0, 0, head + (piece - 1) * size)
                length = np.where(piece == 0, head, size)
                raw = memoryview(ids.tobytes())
                at = (docs[doc] + start) * 4
                blobs = [raw[a:b] for a, b in zip(at, at + length * 4)]
                cols = [batch.column(0).slice(c.lo, c.n).take(pa.array(doc)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array([zlib.crc32(x) for x in blobs], pa.int64())]
                names = ["doc_id", "piece", "start", "length", "ids_crc32"]
                if keep_ids:
                    cols.append(pa.array([bytes(x) for x in blobs], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(cols, names=names)

    return cut


def pieces(docs: DataFrame, tokenizer_path: str, size: int = SIZE, end: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked, the ids (little-endian uint32)."""
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * keep_ids
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return narrow.mapInArrow(_cutter(tokenizer_path, size, end, keep_ids), schema)


def _placer(plan: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]) -> Callable:
    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column("length").to_numpy(zero_copy_only=False)
            rank = batch.column("rank").to_numpy(zero_copy_only=False)
            seq, off = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                lo, base, offset = plan[int(n)]
                rows = np.flatnonzero(length == n)
                at = np.searchsorted(lo, rank[rows], "right") - 1
                seq[rows], off[rows] = base[at] + rank[rows] - lo[at], offset[at]
            keep = [i for i, name in enumerate(batch.schema.names) if name not in ("rank",)]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in keep], pa.array(seq), pa.array(off)], names=[*[batch.schema.names[i] for i in keep], "sequence_id", "offset"])

    return place


def pack(docs: DataFrame, tokenizer_path: str | None = None, size: int = SIZE, end: int = END_ID, keep_ids: bool = False) -> DataFrame:
    """Every piece of every row with its sequence and its offset there."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    # The number of a row, fixed as it is written, spreads equal rows as well as others.
    table = written(pieces(docs, tokenizer_path, size, end, keep_ids).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    # At most `size` rows come to the driver.
    histogram = {r["length"]: r["count"] for r in table.groupBy("length").count().collect()}
    segments = bin_plan(histogram, size)
    plan = {}
    for n in histogram:
        own = np.array(sorted(s[1:] for s in segments if s[0] == n), np.int64)
        plan[n] = (own[:, 0], own[:, 2], own[:, 3])
    buckets = max(64, -(-sum(histogram.values()) // BUCKET_ROWS))
    salted = table.withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(buckets)))
    local = Window.partitionBy("length", "salt").orderBy("doc_id", "piece", "ids_crc32", "_row")
    ranked = salted.withColumn("r", F.row_number().over(local) - 1)
    sizes = salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("salt")) - F.col("n")
    ranked = ranked.join(sizes.select("length", "salt", before.alias("before")), ["length", "salt"])
    own = [c for c in table.columns if c != "_row"]
    placed = ranked.select(*own, (F.col("before") + F.col("r")).alias("rank"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema if f.name in own) + ", sequence_id long, offset long"
    return placed.mapInArrow(_placer(plan), schema)


def sequences(packed: DataFrame, size: int = SIZE) -> DataFrame:
    """The packed id sequences themselves, from :func:`pack` with ``keep_ids``."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    joined = F.aggregate(parts, F.lit(b""), lambda a, x: F.concat(a, x["ids"]))
    return packed.groupBy("sequence_id").agg(joined.alias("ids"), F.sum("length").alias("length"))


def query(spark, sf_dir: str) -> DataFrame:
    return pack(pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
