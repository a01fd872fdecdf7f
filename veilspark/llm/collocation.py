"""Collocations per language by position bitmaps: frequent phrases of two to four words, scored by their weakest cut.

Texts are cut into shards of one language (about ``SHARD_WORDS`` words). In a shard every word has a bitmap of its
positions, kept as its non-empty blocks of ``BITS`` positions. A phrase's bitmap (of its last words) without the ends
of pieces, shifted by one, and ANDed with a word's gives the longer phrase's; the bits set are its occurrences in
the shard. Prefixes are extended depth first, a group of first words after the other, so memory is bounded.

A phrase is frequent only if its parts are, but no shard can tell that alone. Shards send keys (hashes) and counts of
their words and pairs to parts of the key space, which sum them and answer the frequent ones; triples and
quadruples are then grown from frequent pairs only, and asked for in the same way. Hashes only prune: a collision
lets a rare phrase through to the last step, where counts are summed by the words themselves: first over the
shards that a task has (several, chosen by hash), then over tasks.

Edge cases: a null text is empty, a null language ``und`` (one with that name); a text without words, an empty table or a language without a frequent
phrase gives no row; a piece is never cut, whatever its length; repeated rows count as often as they occur; words of any
length are kept whole; ties go by count, then by the phrase's bytes; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import textvec as tv
from .exchange import PACKED, Answers, Plan, _batch, _emit, _tasks, bucket_column, deal, judged, pack
from .workspace import Space, pick, written

LONGEST, LEAST = 4, 30
#: A phrase goes if a longer one has at least so many hundredths of its occurrences.
SHARE = 80
TOP = 2000
SCALE = 2_000_000
UNKNOWN = "und"
SHARD_WORDS, HELD_WORDS = 1_000_000, 4_000_000
BITS, PAIRED = 32, 2_000_000
SALTS = 64

_WHITE, _BREAK = np.zeros(256, bool), np.zeros(256, bool)
_WHITE[[0x20, 0x09]] = True
_BREAK[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_STEP = tv.U(0xD6E8FEB86659FD93)
_SHARD = "shard long, lang string, words binary, sizes binary, ids binary, ends binary"
_SHARD_NAMES = [x.split()[0] for x in _SHARD.split(", ")]
_PHRASES = "lang string, size int, phrase string, f long"
_MINED = f"{PACKED}, {_PHRASES}"


@dataclass
class Shard:
    """Words of one language: the distinct ones (bytes), each position's word, and whether a piece ends there."""

    ident: int
    lang: str
    words: list[bytes]
    ids: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray


# --- texts to shards


def _tokens(texts: pa.Array) -> Iterator[tuple[pa.DictionaryArray, np.ndarray]]:
    """For each chunk of texts its words (dictionary-encoded) and whether each is the last of its piece."""
    for c in tv.chunks(texts):
        data = tv.LOWER[c.data]
        stop = _BREAK[data]
        inside = ~(stop | _WHITE[data])
        before, after = np.append(False, inside[:-1]), np.append(inside[1:], False)
        full = c.off[:-1] < c.off[1:]
        before[c.off[:-1][full]], after[c.off[1:][full] - 1] = False, False
        start, end = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
        if not len(start):
            continue
        piece = np.cumsum(stop)[start] + np.searchsorted(c.off, start, "right")
        last = np.append(piece[1:] != piece[:-1], True)
        off = np.append(0, np.cumsum(end - start)).astype(np.int64)
        values = pa.Array.from_buffers(pa.large_binary(), len(start), [None, pa.py_buffer(off), pa.py_buffer(np.ascontiguousarray(data[inside]))])
        yield values.dictionary_encode(), last


def _cut(ends: np.ndarray, most: int) -> np.ndarray:
    """Where to cut, at ends of pieces, so that parts hold about ``most`` words."""
    stops = np.flatnonzero(ends) + 1
    wanted = np.arange(most, len(ends), most)
    return np.unique(np.concatenate([[0], stops[np.searchsorted(stops, wanted)], [len(ends)]])).astype(np.int64)


class _Held:
    """Words of each language that wait for a shard."""

    def __init__(self, shard_words: int):
        self.parts: dict[str, list] = {}
        self.count: dict[str, int] = {}
        self.made, self.most = 0, shard_words

    def add(self, lang: str, coded: pa.DictionaryArray, last: np.ndarray) -> Iterator[tuple]:
        self.parts.setdefault(lang, []).append((coded, last))
        self.count[lang] = self.count.get(lang, 0) + len(last)
        if self.count[lang] >= self.most:
            yield from self.out(lang)
        if sum(self.count.values()) >= 4 * self.most:
            for name in list(self.parts):
                yield from self.out(name)

    def out(self, lang: str) -> Iterator[tuple]:
        parts = self.parts.pop(lang)
        self.count.pop(lang)
        joined = pa.chunked_array([x for x, _ in parts]).unify_dictionaries()
        words = joined.chunk(0).dictionary
        ids, ends = np.concatenate([x.indices.to_numpy() for x in joined.chunks]), np.concatenate([x for _, x in parts])
        at = _cut(ends, self.most)
        for a, b in zip(at[:-1], at[1:]):
            used, own = np.unique(ids[a:b], return_inverse=True)
            order = np.argsort(-np.bincount(own), kind="stable")  # frequent words have small numbers
            rank = np.empty(len(order), np.uint32)
            rank[order] = np.arange(len(order))
            mine = words.take(pa.array(used[order]))
            sizes = pc.binary_length(mine).to_numpy().astype("<u4")
            place = TaskContext.get().partitionId() << 32 | self.made
            self.made += 1
            ident = int(tv.mix(np.array([place], tv.U))[0] >> tv.U(1))
            yield ident, lang, b"".join(mine.to_pylist()), sizes.tobytes(), rank[own].astype("<u4").tobytes(), np.packbits(ends[a:b]).tobytes()


def _shards(shard_words: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = _Held(shard_words)

        def rows(found: Iterator[tuple]) -> Iterator[pa.RecordBatch]:
            for row in found:
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, (pa.int64(), pa.string(), *[pa.binary()] * 4))], names=_SHARD_NAMES)

        for batch in batches:
            langs = batch.column(0)
            for lang in langs.unique().to_pylist():
                for coded, last in _tokens(batch.column(1).filter(pc.equal(langs, lang))):
                    yield from rows(held.add(lang, coded, last))
        for lang in list(held.parts):
            yield from rows(held.out(lang))

    return run


def _opened(table: pa.Table | pa.RecordBatch) -> Iterator[Shard]:
    cols = [table.column(n) for n in _SHARD_NAMES]
    for i in range(table.num_rows):
        ident, lang, data, sizes, ids, ends = [c[i].as_py() for c in cols]
        off = np.append(0, np.cumsum(np.frombuffer(sizes, "<u4").astype(np.int64)))
        ids = np.frombuffer(ids, "<u4").astype(np.int64)
        raw = np.frombuffer(data, np.uint8)
        hashes = tv.mix(tv.spans(raw, off[:-1], off[1:]) * _STEP + tv.U(tv.digest(np.frombuffer(lang.encode(), np.uint8))))
        yield Shard(ident, lang, [data[a:b] for a, b in zip(off[:-1], off[1:])], ids, np.unpackbits(np.frombuffer(ends, np.uint8), count=len(ids)).astype(bool), hashes)


# --- bitmaps


@dataclass
class Bitmaps:
    """Non-empty blocks of the owners' position bitmaps."""

    owner: np.ndarray
    block: np.ndarray
    mask: np.ndarray

    def take(self, rows: np.ndarray) -> Bitmaps:
        return Bitmaps(self.owner[rows], self.block[rows], self.mask[rows])


def word_bitmaps(ids: np.ndarray, positions: np.ndarray) -> Bitmaps:
    """The bitmaps of the words at these positions, ordered by block, then word."""
    block, width = positions // BITS, int(ids.max(initial=0)) + 1
    key = block * width + ids[positions]
    order = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1]))[: len(order)]
    bits = np.uint32(1) << (positions[order] % BITS).astype(np.uint32)
    mask = np.bitwise_or.reduceat(bits, new) if len(new) else bits
    found = key[order[new]]
    return Bitmaps(found % width, found // width, mask)


def shifted(maps: Bitmaps, ends: np.ndarray) -> Bitmaps:
    """Each bitmap moved on by one position; bits at ends of pieces (``ends`` by block) go."""
    mask = maps.mask & ~ends[maps.block]
    within, over = mask << np.uint32(1), mask >> np.uint32(BITS - 1)
    a, b = np.flatnonzero(within), np.flatnonzero(over)
    return Bitmaps(np.concatenate([maps.owner[a], maps.owner[b]]), np.concatenate([maps.block[a], maps.block[b] + 1]), np.concatenate([within[a], over[b]]))


def _paired(maps: Bitmaps, words: Bitmaps, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Owner, word, block and mask of all non-empty ANDs of a bitmap with a word's."""
    n = first[maps.block + 1] - first[maps.block]
    source = np.repeat(np.arange(len(n)), n)
    other = np.arange(len(source)) + np.repeat(first[maps.block] - (np.cumsum(n) - n), n)
    both = maps.mask[source] & words.mask[other]
    hit = np.flatnonzero(both)
    source, other = source[hit], other[hit]
    return maps.owner[source], words.owner[other], maps.block[source], both[hit]


@dataclass
class Level:
    """Phrases of one length: their words' numbers, hashes, occurrences, and bitmaps with the phrase's row as owner."""

    words: np.ndarray
    hashes: np.ndarray
    count: np.ndarray
    maps: Bitmaps

    def kept(self, keep: np.ndarray) -> Level:
        number = np.cumsum(keep) - 1
        rows = np.flatnonzero(keep[self.maps.owner])
        maps = self.maps.take(rows)
        return Level(self.words[keep], self.hashes[keep], self.count[keep], Bitmaps(number[maps.owner], maps.block, maps.mask))


def joined_hash(prefix: np.ndarray, word: np.ndarray) -> np.ndarray:
    return tv.mix(prefix * _STEP + word)


class Miner:
    """Extends the phrases of a shard at the given positions (all, if none are given)."""

    def __init__(self, shard: Shard, positions: np.ndarray | None = None):
        self.shard = shard
        n = len(shard.ids)
        self.words = word_bitmaps(shard.ids, np.arange(n) if positions is None else positions)
        blocks = -(-n // BITS) + 1
        self.first = np.searchsorted(self.words.block, np.arange(blocks + 1))
        stops = np.flatnonzero(shard.ends)
        self.ends = np.zeros(blocks, np.uint32)
        np.bitwise_or.at(self.ends, stops // BITS, np.uint32(1) << (stops % BITS).astype(np.uint32))

    def roots(self) -> Iterator[Level]:
        """Groups of single words whose extensions fit into memory."""
        order = np.argsort(self.words.owner, kind="stable")
        owner = self.words.owner[order]
        new = np.append(True, owner[1:] != owner[:-1])[: len(order)]
        cost = np.cumsum((self.first[1:] - self.first[:-1])[self.words.block[order]])
        starts = np.flatnonzero(new)
        group = np.zeros(0, np.int64) if not len(starts) else cost[np.append(starts[1:], len(order)) - 1] // PAIRED
        for g in np.unique(group):
            own = np.flatnonzero(group == g)
            a, b = starts[own[0]], np.append(starts, len(order))[own[-1] + 1]
            maps = self.words.take(order[a:b])
            words, number = np.unique(maps.owner, return_inverse=True)
            yield Level(words[:, None], self.shard.hashes[words], np.bincount(number, np.bitwise_count(maps.mask)).astype(np.int64), Bitmaps(number, maps.block, maps.mask))

    def extended(self, level: Level) -> Level:
        """All phrases with one more word that occur."""
        moved = shifted(level.maps, self.ends)
        width = len(self.shard.words)
        cost = np.cumsum(self.first[moved.block + 1] - self.first[moved.block])
        parts = [_paired(moved.take(slice(a, b)), self.words, self.first) for a, b in _slices(cost)]
        owner, word, block, mask = [np.concatenate(x) for x in zip(*parts)] if parts else [np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint32)]
        key = owner * width + word
        order = np.argsort(key, kind="stable")
        key, block, mask = key[order], block[order], mask[order]
        new = np.append(True, key[1:] != key[:-1])[: len(key)]
        start = np.flatnonzero(new)
        prefix, word = key[start] // width, key[start] % width
        count = np.add.reduceat(np.bitwise_count(mask).astype(np.int64), start) if len(start) else np.zeros(0, np.int64)
        return Level(np.column_stack([level.words[prefix], word]), joined_hash(level.hashes[prefix], self.shard.hashes[word]), count, Bitmaps(np.cumsum(new) - 1, block, mask))


def _slices(cost: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of entries whose costs (given as running sums) stay near ``PAIRED``."""
    at = np.unique(np.concatenate([[0], np.searchsorted(cost, np.arange(PAIRED, cost[-1] if len(cost) else 0, PAIRED)) + 1, [len(cost)]])).astype(np.int64)
    return zip(at[:-1].tolist(), at[1:].tolist())


# --- passes over the shards


def _asked(level: Level, shard: Shard, plan: Plan) -> Iterator[tuple]:
    keys = level.hashes
    if len(keys):
        # More than LEAST is never needed to tell that a sum reaches it.
        yield from pack(plan.parts_of(keys), keys, np.full(len(keys), shard.ident), plan, seconds=np.minimum(level.count, LEAST).astype(tv.U), narrow=True)


def _small(plan: Plan) -> Callable:
    """Keys and counts of the words and pairs of every shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard in _opened(batch):
                miner = Miner(shard)
                held = []
                for root in miner.roots():
                    held += [root, miner.extended(root)]
                if held:
                    none = Bitmaps(*[np.zeros(0, t) for t in (np.int64, np.int64, np.uint32)])
                    yield from _emit(_asked(Level(held[0].words[:0], np.concatenate([x.hashes for x in held]), np.concatenate([x.count for x in held]), none), shard, plan))

    return run


def _frequent(keys: np.ndarray, docs: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Entries whose key has at least ``LEAST`` occurrences in all shards together."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    start = np.flatnonzero(np.append(True, s[1:] != s[:-1]))
    total = np.add.reduceat(counts[order].astype(np.int64), start)
    return order[np.repeat(total >= LEAST, np.diff(np.append(start, len(s))))]


def _member(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among the sorted ones."""
    if not len(known):
        return np.zeros(len(values), bool)
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


class _Counts:
    """Phrases in words, and their counts, of the shards of a task."""

    def __init__(self) -> None:
        self.parts: list[pa.Table] = []

    def add(self, shard: Shard, level: Level) -> None:
        words = [b" ".join([shard.words[i] for i in row]).decode() for row in level.words.tolist()]
        self.put(shard.lang, level.words.shape[1], words, level.count)

    def put(self, lang: str, size: int, words: list[str], count: np.ndarray) -> None:
        if words:
            self.parts.append(pa.table([pa.array([lang] * len(words), pa.string()), pa.array(np.full(len(words), size, np.int32)), pa.array(words, pa.string()), pa.array(count, pa.int64())], names=["lang", "size", "phrase", "f"]))

    def rows(self) -> list[pa.RecordBatch]:
        """One row for each language and phrase; the packed columns are null."""
        if not self.parts:
            return []
        merged = pa.concat_tables(self.parts).group_by(["lang", "size", "phrase"]).aggregate([("f", "sum")]).rename_columns({"f_sum": "f"})
        return [_filled({n: b.column(n) for n in b.schema.names}, b.num_rows) for b in merged.to_batches()]


def _filled(columns: dict, n: int) -> pa.RecordBatch:
    kinds = {"dest": pa.int32(), "known": pa.bool_(), **dict.fromkeys(("keys", "marks", "seconds", "docs", "counts"), pa.binary()), "lang": pa.string(), "size": pa.int32(), "phrase": pa.string(), "f": pa.int64()}
    return pa.RecordBatch.from_arrays([columns.get(k, pa.nulls(n, t)) for k, t in kinds.items()], names=list(kinds))


def _grown(shard: Shard, plan: Plan, small: np.ndarray, large: np.ndarray | None, collect: Callable[[Level], None]) -> None:
    """Phrases of two to four words whose pairs are all in ``small`` and, if given, which are in ``large``; both sorted."""
    pair = joined_hash(shard.hashes[shard.ids[:-1]], shard.hashes[shard.ids[1:]])
    starts = _member(plan.short(pair), small) & ~shard.ends[:-1]
    # Bits outside of frequent pairs are cleared before anything is extended.
    here = np.append(starts, False) | np.append(False, starts)
    miner = Miner(shard, np.flatnonzero(here))
    for root in miner.roots():
        level = root
        for size in range(2, LONGEST + 1):
            level = miner.extended(level)
            last = joined_hash(shard.hashes[level.words[:, -2]], shard.hashes[level.words[:, -1]])
            keep = _member(plan.short(last), small)
            if large is not None and size > 2:
                keep &= _member(plan.short(level.hashes), large)
            level = level.kept(keep)
            if not len(level.hashes):
                break
            collect(level)


def _middle(plan: Plan) -> Callable:
    """With the frequent words and pairs known: their counts, and keys of the triples and quadruples to ask for."""

    def run(store: pa.Table, found: pa.Table) -> pa.Table:
        known, counts, out = Answers(found), _Counts(), [_filled({}, 0)]
        for shard in _opened(store):
            small = np.sort(known.of(shard.ident))
            counts.put(shard.lang, 0, [""], np.array([len(shard.ids)]))
            own = np.flatnonzero(_member(plan.short(shard.hashes), small))
            counts.add(shard, Level(own[:, None], shard.hashes[own], np.bincount(shard.ids, minlength=len(shard.words))[own].astype(np.int64), None))
            asked: list[Level] = []
            _grown(shard, plan, small, None, lambda level: counts.add(shard, level) if level.words.shape[1] == 2 else asked.append(level))
            if asked:
                merged = Level(asked[0].words[:0], np.concatenate([x.hashes for x in asked]), np.concatenate([x.count for x in asked]), None)
                packed = _batch(list(_asked(merged, shard, plan)))
                out.append(_filled({n: packed.column(n) for n in packed.schema.names}, packed.num_rows))
        return pa.Table.from_batches([*out, *counts.rows()])

    return run


def _last(plan: Plan) -> Callable:
    """Counts of the frequent triples and quadruples."""

    def run(store: pa.Table, found: pa.Table) -> pa.Table:
        known, counts = Answers(found), _Counts()
        for shard in _opened(store):
            mine = np.sort(known.of(shard.ident))
            if len(mine):
                _grown(shard, plan, mine, mine, lambda level: counts.add(shard, level) if level.words.shape[1] > 2 else None)
        return pa.Table.from_batches([_filled({}, 0), *counts.rows()])

    return run


def _meet(store: DataFrame, answers: DataFrame, plan: Plan, fn: Callable, schema: str) -> DataFrame:
    """``fn`` over the shards and answers of each bucket of shards."""
    n = _tasks(plan.buckets)
    left = store.withColumn("bucket", bucket_column(F.col("shard"), F.col("lang"), plan.buckets)).repartition(n, "bucket")
    right = deal(answers, plan.buckets, plan, of_docs=True).withColumnRenamed("dest", "bucket").repartition(n, "bucket")
    return left.groupBy("bucket").cogroup(right.groupBy("bucket")).applyInArrow(fn, schema)


def counted(docs: DataFrame, plan: Plan | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, size, phrase and f of all words and phrases up to four words with at least ``LEAST`` occurrences; size 0 has a language's words."""
    rows = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    if plan is None:
        plan = Plan.for_bytes(rows.agg(F.sum(F.octet_length("text")).alias("b")).first()["b"] or 0)
        # Fewer buckets than parts would have: a task sums several shards before rows leave it.
        plan = Plan(plan.parts, max(32, plan.parts), plan.fan)
    names = [x.split()[0] for x in PACKED.split(", ")]
    phrases = [x.split()[0] for x in _PHRASES.split(", ")]
    with Space() as space:
        store = written(rows.mapInArrow(_shards(shard_words), _SHARD), "shards")
        small = written(judged(deal(store.mapInArrow(_small(plan), PACKED), plan.parts, plan, narrow=True), plan, _frequent), "frequent")
        middle = written(_meet(store, small, plan, _middle(plan), _MINED), "mined")
        large = judged(deal(middle.where("phrase IS NULL").select(*names), plan.parts, plan, narrow=True), plan, _frequent)
        last = _meet(store, small.unionByName(large), plan, _last(plan), _MINED)
        parts = middle.where("phrase IS NOT NULL").select(*phrases).unionByName(last.where("phrase IS NOT NULL").select(*phrases))
        summed = parts.groupBy("lang", "phrase").agg(F.max("size").alias("size"), F.sum("f").alias("f"))
        return space.keep(written(summed.where((F.col("size") == 0) | (F.col("f") >= LEAST)), "phrases"))


def mine(docs: DataFrame, top: int = TOP, plan: Plan | None = None, shard_words: int = SHARD_WORDS) -> DataFrame:
    """lang, rank, phrase, a, l, r, n and score of each language's best phrases; see the module."""
    phrases = counted(docs, plan, shard_words)
    wide = "decimal(20,0)"
    found = phrases.where("size >= 2").withColumn("words", F.split("phrase", " "))
    part = phrases.where("size BETWEEN 1 AND 3")
    cuts = found.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"))
    joined = [F.array_join(x, " ") for x in (F.slice("words", F.lit(1), F.col("k")), F.slice("words", F.col("k") + 1, F.size("words")))]
    cuts = cuts.select("lang", "phrase", "a", "k", joined[0].alias("left"), joined[1].alias("right"))
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("left"), F.col("f").alias("l")), ["lang", "left"])
    cuts = cuts.join(part.select("lang", F.col("phrase").alias("right"), F.col("f").alias("r")), ["lang", "right"])
    score = F.expr(f"(CAST({SCALE} AS decimal(7,0)) * CAST(a AS {wide})) div (CAST(l AS {wide}) + CAST(r AS {wide}))")
    scored = cuts.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut"))
    # A phrase inside a much longer frequent one is inside one that is a word longer, which is at least as frequent.
    ends = F.array(F.slice("words", F.lit(1), F.col("size") - 1), F.slice("words", F.lit(2), F.col("size") - 1))
    longer = found.where("size >= 3").select("lang", F.explode(ends).alias("inner"), "f").groupBy("lang", F.array_join("inner", " ").alias("phrase")).agg(F.max("f").alias("around"))
    scored = scored.join(longer, ["lang", "phrase"], "left").where(F.expr(f"around IS NULL OR CAST(around AS {wide}) * 100 < CAST(a AS {wide}) * {SHARE}"))
    totals = phrases.where("size = 0").select("lang", F.col("f").alias("n"))
    out = scored.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    salted = out.withColumn("salt", F.pmod(F.xxhash64("phrase"), F.lit(SALTS)))
    # A language's best are among the best of its salted parts, so no task orders a whole language.
    few = salted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "salt")
    best = few.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return mine(pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "lang", "text"))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), w AS (
  SELECT lang, regexp_extract_all(s, '[^\x20\x09]+') AS ws FROM (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS s FROM d)
), g AS (
  SELECT lang, k, array_to_string(ws[i:i + k - 1], ' ') AS phrase FROM (SELECT lang, ws, k, unnest(range(1, len(ws) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(ws) >= k)
), f AS (
  SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL HAVING count(*) >= 30
), n AS (
  SELECT lang, sum(len(ws)) AS n FROM w GROUP BY lang
), c AS (
  SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1
), x AS (
  SELECT lang, phrase, a, j, array_to_string(ws[1:j], ' ') AS p, array_to_string(ws[j + 1:], ' ') AS q FROM (SELECT *, unnest(range(1, k)) AS j FROM c)
), s AS (
  SELECT x.lang, x.phrase, a, j, l.f AS l, r.f AS r, (2000000::HUGEINT * a) // (l.f + r.f) AS score
  FROM x JOIN f l ON l.lang = x.lang AND l.phrase = p JOIN f r ON r.lang = x.lang AND r.phrase = q
  QUALIFY row_number() OVER (PARTITION BY x.lang, x.phrase ORDER BY score, j) = 1
), inner_ AS (
  SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS around
  FROM (SELECT lang, ws, a, m, unnest(range(1, k - m + 2)) AS i FROM c, (SELECT unnest([2, 3]) AS m) WHERE k > m) GROUP BY ALL
), kept AS (
  SELECT s.* FROM s LEFT JOIN inner_ USING (lang, phrase) WHERE around IS NULL OR 100 * around < 80 * a
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept
)
SELECT lang, rank, phrase, a, l, r, n::BIGINT AS n, score::BIGINT AS score FROM ranked JOIN n USING (lang) WHERE rank <= 2000
"""
