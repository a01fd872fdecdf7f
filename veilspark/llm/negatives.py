"""Hard negatives by blocked dense products of anchors with all vectors.

Anchors go to the tasks in rounds of a bounded size (``ANCHOR_BYTES``, broadcast); each task
multiplies blocks of them with chunks of its rows in float64. Components are integers, so products
are exact while the largest possible sum is below 2^53; a block beyond that is multiplied in
64-bit integers, beyond 2^63 in Python's. The first pass keeps the best ``TOP`` rows of the
anchor's label for each anchor and task; the tasks' lists are merged by Spark. The second pass
keeps the best ``TOP`` rows of other labels inside each positive's window of scores. A task's
state is a list for each anchor of the round, whatever the number of rows, so ties and
repeated vectors cost no memory.

Edge cases: rows with a null id, label or vector, or a null or non-finite component take no part;
vectors of unequal lengths are compared over the shorter one (as if padded with zeros), an empty one
scores 0; rows with an anchor's own id are not its positives; other repeated rows count as often
as they occur, repeated anchors answer once; ties go by the smaller id; an anchor without a positive,
or a positive without a negative, gives no row; an empty table gives no row; a score beyond 64 bits
is an error; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .workspace import pick, written

TOP = 5
#: A negative scores between so many hundredths of the positive's score and all of it.
LOW, WHOLE = 80, 100
ANCHOR_EVERY = 100
#: Bytes of anchors in a round; each Python worker holds them.
ANCHOR_BYTES = 32 << 20
BLOCK, CHUNK, FIRST = 512, 2048, 64
NONE_SCORE, NONE_ID = np.iinfo(np.int64).min, np.iinfo(np.int64).max
_FOUND = "anchor int, slot int, id long, score long"
_RESULT = "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"


@dataclass
class Vectors:
    """Ids, labels and integer components (as float64, padded with zeros) of rows that take part."""

    ids: np.ndarray
    labels: np.ndarray
    parts: np.ndarray

    def __len__(self) -> int:
        return len(self.ids)


def vectors_of(batch: pa.RecordBatch | pa.Table) -> Vectors:
    """The rows of (vec_id, label, embedding) without a null or non-finite component."""
    ids, labels = [np.asarray(batch.column(i).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch.column(i).to_numpy(), np.int64) for i in (0, 1)]
    lists = batch.column(2)
    if isinstance(lists, pa.ChunkedArray):
        lists = lists.combine_chunks()
    size = lists.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lists.flatten()
    x = flat.to_numpy(zero_copy_only=False).astype(np.float64)  # nulls become NaN
    row = np.repeat(np.arange(len(ids)), size)
    bad = np.bincount(row[~np.isfinite(x)], minlength=len(ids)) > 0
    whole = np.floor(256 * x)
    out = np.zeros((len(ids), int(size.max(initial=0))))
    out[row, np.arange(len(x)) - np.repeat(np.cumsum(size) - size, size)] = whole
    if bad.any():
        ids, labels, out = ids[~bad], labels[~bad], out[~bad]
    if not np.isfinite(out).all():
        raise ArithmeticError("a component times 256 is beyond a double")
    return Vectors(ids, labels, out)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of two integer-valued matrices, as int64."""
    width = min(a.shape[1], b.shape[1])
    a, b = a[:, :width], b[:, :width]
    if not a.size or not b.size:
        return np.zeros((len(a), len(b)), np.int64)
    bound = int(np.abs(a).max()) * int(np.abs(b).max()) * width
    if bound < 1 << 53:
        return (a @ b.T).astype(np.int64)
    if bound < 1 << 63:
        return a.astype(np.int64) @ b.astype(np.int64).T
    whole = np.frompyfunc(int, 1, 1)
    exact = np.dot(whole(a), whole(b).T)
    if (abs(exact) >= 1 << 63).any():
        raise ArithmeticError("a score is beyond 64 bits")
    return exact.astype(np.int64)


class Best:
    """For each group the ``k`` best (score descending, id ascending) of all that was offered; lists merge by offering one to another."""

    def __init__(self, groups: int, k: int = TOP):
        self.score = np.full((groups, k), NONE_SCORE)
        self.ids = np.full((groups, k), NONE_ID)

    def offer(self, base: int, scores: np.ndarray, ids: np.ndarray, allowed: np.ndarray) -> None:
        """Scores of groups ``base``, ``base + 1``, ... against the rows ``ids``."""
        held, named = self.score[base : base + len(scores)], self.ids[base : base + len(scores)]
        worst, last, k = held[:, -1:], named[:, -1:], held.shape[1]
        group, row = np.nonzero(allowed & ((scores > worst) | ((scores == worst) & (ids < last))))
        if not len(group):
            return
        touched = np.unique(group)
        groups = np.concatenate([group, np.repeat(touched, k)])
        score = np.concatenate([scores[group, row], held[touched].ravel()])
        ids = np.concatenate([ids[row], named[touched].ravel()])
        order = np.lexsort((ids, ~score, groups))
        first = np.searchsorted(groups[order], touched)
        best = order[first[:, None] + np.arange(k)]
        held[touched], named[touched] = score[best], ids[best]

    def rows(self, slots: int) -> pa.RecordBatch:
        """What is held, as (anchor, slot, id, score); ``slots`` groups belong to an anchor."""
        group, at = np.nonzero(self.ids != NONE_ID)
        values = [group // slots, group % slots, self.ids[group, at], self.score[group, at]]
        return pa.RecordBatch.from_arrays([pa.array(v.astype(t)) for v, t in zip(values, (np.int32, np.int32, np.int64, np.int64))], names=["anchor", "slot", "id", "score"])


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[Vectors]:
    """Chunks of rows, small ones first, so that most rows already meet full lists."""
    size = FIRST
    for batch in batches:
        v = vectors_of(batch)
        at = 0
        while at < len(v):
            yield Vectors(*[x[at : at + size] for x in (v.ids, v.labels, v.parts)])
            at += size
            size = min(CHUNK, 2 * size)


def _scan(anchors, windows=None):
    """A map function over rows: the best of the anchor's label, or of other labels in each of its windows (low, high)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine: Vectors = anchors.value
        bounds = windows.value if windows is not None else None
        slots = 1 if bounds is None else TOP
        best = [Best(len(mine)) for _ in range(slots)]
        for rows in _chunks(batches):
            for a in range(0, len(mine), BLOCK):
                block = slice(a, a + BLOCK)
                scores = products(mine.parts[block], rows.parts)
                same = mine.labels[block, None] == rows.labels
                if bounds is None:
                    best[0].offer(a, scores, rows.ids, same & (mine.ids[block, None] != rows.ids))
                    continue
                for i, (low, high) in enumerate(bounds):
                    best[i].offer(a, scores, rows.ids, ~same & (scores >= low[block, None]) & (scores <= high[block, None]))
        out = Best(len(mine) * slots)
        for i, b in enumerate(best):
            out.score[i::slots], out.ids[i::slots] = b.score, b.ids
        yield out.rows(slots)

    return run


def _top(found: DataFrame) -> DataFrame:
    """The best ``TOP`` of all tasks, with their rank from 1; tasks' lists are cut before they meet."""
    order = Window.partitionBy("anchor", "slot").orderBy(F.col("score").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP)


def relabelled(label: Column, vec_id: Column) -> Column:
    return F.when(vec_id % 7 == 0, (label + 1) % 10).otherwise(label)


def mine(vectors: DataFrame, label: Column | None = None, anchor: Column | None = None) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id and the two scores; see the module.

    ``vectors`` has vec_id, label and embedding; ``label`` and ``anchor`` say which label a row has
    and whether it is an anchor (every hundredth id).
    """
    spark = vectors.sparkSession
    number = F.col("vec_id").cast("long")
    kind = F.col("label").cast("long") if label is None else label.cast("long")
    asks = F.coalesce(number % ANCHOR_EVERY == 0 if anchor is None else anchor, F.lit(False))
    rows = vectors.select(number.alias("vec_id"), kind.alias("label"), F.col("embedding").cast("array<double>").alias("embedding"), asks.alias("asks")).where("vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL")
    asked = written(rows.where("asks").select("vec_id", "label", "embedding").dropDuplicates(), "anchors")
    size = asked.agg(F.sum(8 * F.size("embedding") + 16)).first()[0] or 0
    rounds = -(-size // ANCHOR_BYTES)
    rows = rows.select("vec_id", "label", "embedding")
    parts = []
    for i in range(rounds):
        # A round's anchors, and five scores for each of them, come to the driver: about ANCHOR_BYTES.
        own = vectors_of(asked.where(F.pmod(F.xxhash64("vec_id", "label", "embedding"), F.lit(rounds)) == i).toArrow())
        if not len(own):
            continue
        anchors = spark.sparkContext.broadcast(own)
        positives = _top(rows.mapInArrow(_scan(anchors), _FOUND)).toArrow()
        who, rank, ids, score = [positives.column(n).to_numpy().astype(np.int64) for n in ("anchor", "rank", "id", "score")]
        high = np.full((TOP, len(own)), NONE_SCORE)
        low = np.full((TOP, len(own)), NONE_ID)
        high[rank - 1, who], low[rank - 1, who] = score, _lowest(score)
        windows = spark.sparkContext.broadcast(list(zip(low, high)))
        names = pa.table([pa.array(own.ids[who]), pa.array(who.astype(np.int32)), pa.array((rank - 1).astype(np.int32)), pa.array(ids), pa.array(score)], names=["anchor_id", "anchor", "slot", "positive_id", "positive_score"])
        negatives = _top(rows.mapInArrow(_scan(anchors, windows), _FOUND))
        joined = negatives.join(F.broadcast(spark.createDataFrame(names)), ["anchor", "slot"])
        parts.append(written(joined.select("anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "negatives"))
        windows.unpersist()
        anchors.unpersist()
    out = parts[0] if parts else spark.createDataFrame([], _RESULT)
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _lowest(score: np.ndarray) -> np.ndarray:
    """The least whole score s with LOW * score <= WHOLE * s."""
    return np.array([-(-LOW * int(s) // WHOLE) for s in score], np.int64)


def query(spark, sf_dir: str) -> DataFrame:
    vectors = pick(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), "vec_id", "label", "embedding")
    return mine(vectors, relabelled(F.col("label").cast("long"), F.col("vec_id")))


ORACLE = """
WITH r AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label::BIGINT + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, a.label = b.label AS same, b.vec_id AS id, list_inner_product(a.v, b.v)::BIGINT AS score
  FROM r a JOIN r b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), p AS (
  SELECT anchor_id, id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, id) <= 5
)
SELECT anchor_id, positive_id, rank, id AS negative_id, positive_score, score AS negative_score FROM (
  SELECT p.*, s.id, s.score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, id)::INTEGER AS rank
  FROM p JOIN s ON p.anchor_id = s.anchor_id AND NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score)
WHERE rank <= 5
"""
