"""Token ids in shard files with a minimal perfect hash index.

A store is a folder with two files for each shard, and a catalog table. The payload
file holds the raw ids (little-endian, 2 or 4 bytes each) of consecutive documents
in ascending doc_id order; the index file holds a minimal perfect hash over the
shard's keys. The hash goes by levels of bits: at each level a key takes the bit it
hashes to if no other key left hashes there; its number is that bit's rank. A number
leads to a 32-bit fingerprint (so absent keys are refused) and to the place of its
documents in the payload. So a key costs a few hashes and array reads whatever the
shard's size, and its ids one read of just their bytes (a shard of which many keys
are wanted is read through once).

Tasks write files under names of their own and Spark commits the catalog, so what a
lost or repeated task left behind is never referred to. Rows are dealt to at most
``MOST_RANGES`` ranges of (doc_id, hash of the text), so equal or null doc_ids are no
hot key. Shards are cut from the sorted rows of a range when they reach
``SHARD_BYTES``, so memory is bounded. The driver only gets the first and last key of
each range. Files go through ``pyarrow.fs``: the folder may be a local path that all
share or any store that it knows.

Edge cases: null text counts as empty (the end id alone); a null doc_id is a
key of its own, first in order; rows with the same doc_id share a key and come
back as often as they were stored, in the order of a hash of their texts; an empty
table gives an empty store; texts of any length are encoded whole; further input
columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe
from . import textvec as tv
from .workspace import file_system, new_path, pick

TOKENIZER = "word_bpe_49k.json"
END_ID = 1
SHARD_BYTES = 8 << 20
RANGE_BYTES = 16 << 20
MOST_RANGES = 16_384
NULL_KEY = -(1 << 63)
#: Of a shard of which this share of the keys is wanted, or more, the payload is read as a whole.
WHOLE = 1 / 8
_GAMMA = 2
_SCHEMA = "rng int, part int, first_key long, last_key long, n_docs long, n_tokens long, width int, file string"
_SECTIONS = (("level_sizes", "<i8"), ("level_bits", "u1"), ("prints", "<u4"), ("entries", "<u4"), ("ends", "<i8"))


def _hash(keys: np.ndarray, seed: int) -> np.ndarray:
    return tv.mix(tv.mix(keys.astype(np.int64).view(tv.U) ^ tv.U(0xA0761D6478BD642F)) + tv.U(seed * 0xE7037ED1A0B428DB % (1 << 64)))


def build_index(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """Bit levels, number of each (distinct) key, and its fingerprint by number."""
    left, number, levels, base = np.arange(len(keys)), np.empty(len(keys), np.int64), [], 0
    while len(left):
        m = max(64, _GAMMA * len(left))
        at = (_hash(keys[left], len(levels) + 1) % tv.U(m)).astype(np.int64)
        bits = np.bincount(at, minlength=m) == 1
        rank = np.cumsum(bits)
        hit = bits[at]
        number[left[hit]] = base + rank[at[hit]] - 1
        base += int(rank[-1])
        levels.append(bits)
        left = left[~hit]
    prints = np.empty(len(keys), np.uint32)
    prints[number] = (_hash(keys, 0) >> tv.U(32)).astype(np.uint32)
    return levels, number, prints


def index_bytes(keys: np.ndarray, sizes: np.ndarray) -> bytes:
    """The index file of a shard: sorted keys and the number of ids of every document.

    Five section lengths in bytes, then the sections: sizes and bits of the levels, fingerprints, first document and number of documents of each key, ends of the documents.
    """
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    levels, number, prints = build_index(keys[first])
    entries = np.empty((2, len(first)), "<u4")
    entries[0, number], entries[1, number] = first, np.diff(np.append(first, len(keys)))
    parts = [
        np.array([len(x) for x in levels], "<i8").tobytes(), b"".join(np.packbits(x).tobytes() for x in levels), prints.astype("<u4").tobytes(),
        entries.tobytes(), np.concatenate([[0], np.cumsum(sizes)]).astype("<i8").tobytes(),
    ]
    return np.array([len(x) for x in parts], "<i8").tobytes() + b"".join(parts)


class Shard:
    """One shard, opened for keyed access."""

    def __init__(self, index: bytes, width: int):
        cut = np.concatenate([[0], np.cumsum(np.frombuffer(index[:40], "<i8"))]) + 40
        sizes, packed, self.prints, entries, self.ends = [np.frombuffer(index[a:b], t) for a, b, (_, t) in zip(cut[:-1], cut[1:], _SECTIONS)]
        self.entries, self.width = entries.reshape(2, -1), width
        self.levels, at, base = [], 0, 0
        for m in sizes:
            bits = np.unpackbits(packed[at : at + (int(m) + 7) // 8], count=int(m)).astype(bool)
            rank = np.cumsum(bits)
            self.levels.append((int(m), bits, rank - 1 + base))
            base += int(rank[-1])
            at += (int(m) + 7) // 8

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Number of each key, -1 for those that the shard does not hold."""
        out = np.full(len(keys), -1, np.int64)
        left = np.arange(len(keys))
        for i, (m, bits, rank) in enumerate(self.levels):
            at = (_hash(keys[left], i + 1) % tv.U(m)).astype(np.int64)
            hit = bits[at]
            out[left[hit]] = rank[at[hit]]
            left = left[~hit]
        got = np.flatnonzero(out >= 0)
        wrong = self.prints[out[got]] != (_hash(keys[got], 0) >> tv.U(32)).astype(np.uint32)
        out[got[wrong]] = -1
        return out

    def rows(self, keys: np.ndarray, payload) -> Iterator[tuple[int, int, np.ndarray]]:
        """(position in keys, token offset, ids) of every stored document of the keys; ``payload`` is the open file."""
        numbers = self.find(keys)
        many = (numbers >= 0).sum() >= WHOLE * len(self.prints)
        whole = np.frombuffer(payload.read_at(payload.size(), 0), f"<u{self.width}") if many else None
        for i in np.flatnonzero(numbers >= 0):
            first, n = self.entries[:, numbers[i]]
            for e in range(first, first + n):
                a, b = int(self.ends[e]), int(self.ends[e + 1])
                yield i, a, whole[a:b] if many else np.frombuffer(payload.read_at((b - a) * self.width, a * self.width), f"<u{self.width}")


def _writer(folder: str, tokenizer_path: str, end: int, limit: int) -> Callable:
    """Encode sorted (key, text) rows of a range and write its shards; gives their rows of the catalog."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, rng, part = bpe.encoder(tokenizer_path), TaskContext.get().partitionId(), 0
        width = 4 if enc.tok.get_vocab_size() > 1 << 16 else 2
        fs, base = file_system(folder)
        keys, sizes, payload, held = [], [], [], 0

        def flush() -> pa.RecordBatch:
            nonlocal part, held
            k, n = np.concatenate(keys), np.concatenate(sizes)
            name = f"{rng:05d}-{part:05d}-{uuid.uuid4().hex}"
            for suffix, body in (("ids", b"".join(payload)), ("idx", index_bytes(k, n))):
                with fs.open_output_stream(f"{base}/{name}.{suffix}") as f:
                    f.write(body)
            row = [rng, part, int(k[0]), int(k[-1]), len(k), int(n.sum()), width, name]
            for x in (keys, sizes, payload):
                x.clear()
            part, held = part + 1, 0
            return pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, (pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.string()))], names=[x.split()[0] for x in _SCHEMA.split(", ")])

        for batch in batches:
            mine = batch.column(0).to_numpy(zero_copy_only=False)
            for c in tv.chunks(batch.column(1), bpe.CHUNK_BYTES):
                ids, docs = bpe.with_end(*enc.encode(c), end)
                keys.append(mine[c.lo : c.hi])
                sizes.append(np.diff(docs))
                payload.append(ids.astype(f"<u{width}").tobytes())
                held += len(payload[-1])
                if held >= limit:
                    yield flush()
        if keys:
            yield flush()

    return run


def _key():
    return F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_KEY))


def _with_base(shards: DataFrame) -> DataFrame:
    """The shards with the number of ids before each: sums within ranges, within blocks of ranges, and over the few blocks."""
    block = F.floor(F.col("rng") / 128)
    ranges = shards.groupBy("rng").agg(F.sum("n_tokens").alias("t"))
    blocks = ranges.groupBy(block.alias("block")).agg(F.sum("t").alias("t"))
    of_block = blocks.select("block", (F.sum("t").over(Window.orderBy("block")) - F.col("t")).alias("b"))  # at most MOST_RANGES / 128 rows
    of_range = ranges.withColumn("block", block).withColumn("r", F.sum("t").over(Window.partitionBy("block").orderBy("rng")) - F.col("t")).join(of_block, "block")
    own = F.sum("n_tokens").over(Window.partitionBy("rng").orderBy("part")) - F.col("n_tokens")
    return shards.withColumn("own", own).join(of_range.select("rng", (F.col("b") + F.col("r")).alias("before")), "rng").select(*shards.columns, (F.col("before") + F.col("own")).alias("base"))


def write_store(docs: DataFrame, path: str, tokenizer_path: str | None = None, end: int = END_ID, shard_bytes: int = SHARD_BYTES, range_bytes: int = RANGE_BYTES) -> None:
    """Encode every row and write the store."""
    if tokenizer_path is None:
        import public_tokenizers

        tokenizer_path = public_tokenizers.path(TOKENIZER)
    size = docs.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0
    ranges = min(MOST_RANGES, int(size // range_bytes) + 1)
    keyed = docs.select(_key().alias("key"), F.col("text"), F.xxhash64("text").alias("h"))
    ordered = keyed.repartitionByRange(ranges, "key", "h").sortWithinPartitions("key", "h", "text").select("key", "text")
    fs, base = file_system(f"{path}/shards")
    fs.create_dir(base, recursive=True)
    ordered.mapInArrow(_writer(f"{path}/shards", tokenizer_path, end, shard_bytes), _SCHEMA).write.parquet(f"{path}/shard-list")
    _with_base(docs.sparkSession.read.schema(_SCHEMA).parquet(f"{path}/shard-list")).write.parquet(f"{path}/catalog")


def open_store(spark, path: str) -> DataFrame:
    """The catalog: one row per shard."""
    return spark.read.schema(_SCHEMA + ", base long").parquet(f"{path}/catalog")


def _range_of(first: np.ndarray, last: np.ndarray, ranges: np.ndarray) -> Callable:
    """Each key with the ranges that may hold it (several only for a key that crosses their border)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy(zero_copy_only=False)
            lo = np.searchsorted(last, keys, "left")
            n = np.maximum(0, np.searchsorted(first, keys, "right") - lo)
            at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(keys, n)), pa.array(ranges[at])], names=["key", "rng"])

    return run


_WANTED = "file string, width int, base long, keys binary"


def _assign(keys: pa.Table, shards: pa.Table) -> pa.Table:
    """The shards of a range with the wanted keys that each may hold."""
    wanted = np.sort(keys.column("key").to_numpy())
    out = []
    for s in shards.to_pylist():
        mine = wanted[np.searchsorted(wanted, s["first_key"]) : np.searchsorted(wanted, s["last_key"], "right")]
        if len(mine):
            out.append((s["file"], s["width"], s["base"], mine.astype("<i8").tobytes()))
    cols = list(zip(*out)) if out else [()] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int64(), pa.binary()))], names=[x.split()[0] for x in _WANTED.split(", ")])


def _reader(folder: str, keep_ids: bool) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = file_system(folder)
        for batch in batches:
            for s in batch.to_pylist():
                keys = np.frombuffer(s["keys"], "<i8")
                with fs.open_input_file(f"{base}/{s['file']}.idx") as f:
                    shard = Shard(f.read(), s["width"])
                found, starts, sizes, sums, blobs = [], [], [], [], []
                with fs.open_input_file(f"{base}/{s['file']}.ids") as f:
                    for at, offset, ids in shard.rows(keys, f):
                        raw = ids.astype("<u4").tobytes()
                        found.append(None if keys[at] == NULL_KEY else int(keys[at]))
                        starts.append(s["base"] + offset)
                        sizes.append(len(ids))
                        sums.append(zlib.crc32(raw))
                        if keep_ids:
                            blobs.append(raw)
                cols, out = [pa.array(x, pa.int64()) for x in (found, starts, sizes, sums)], ["doc_id", "start", "n_tokens", "ids_crc32"]
                if keep_ids:
                    cols, out = [*cols, pa.array(blobs, pa.binary())], [*out, "ids"]
                yield pa.RecordBatch.from_arrays(cols, names=out)

    return run


def lookup(spark, path: str, wanted: DataFrame, keep_ids: bool = False) -> DataFrame:
    """The stored documents of the distinct doc_ids of ``wanted``, through the index.

    Only keys are shuffled, to the range that holds them; tasks read the files.
    """
    catalog = open_store(spark, path)
    # At most MOST_RANGES rows come to the driver and go to the tasks.
    ranges = catalog.groupBy("rng").agg(F.min("first_key").alias("first"), F.max("last_key").alias("last")).orderBy("rng").toPandas()
    bounds = [ranges[c].to_numpy(t) for c, t in (("first", np.int64), ("last", np.int64), ("rng", np.int32))]
    keys = wanted.select(_key().alias("key")).distinct().mapInArrow(_range_of(*bounds), "key long, rng int")
    n = max(1, min(len(ranges), 4096))
    lists = keys.repartition(n, "rng").groupBy("rng").cogroup(catalog.repartition(n, "rng").groupBy("rng")).applyInArrow(_assign, _WANTED)
    return lists.mapInArrow(_reader(f"{path}/shards", keep_ids), "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids)


def query(spark, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    path = new_path(spark, "tokens")
    write_store(docs, path)
    return lookup(spark, path, docs)
