"""Near-duplicates by min-max hashing with confirmed links and components.

Each distinct set of word shingles gets, from one hash per permutation, both
the minimum and the maximum: 64 evaluations give 128 values, banded by four.

1. Rows with equal sets (by a 128-bit digest of the whole set) are one class. A
   class is a node, named by its smallest doc_id and half of its digest.
2. In every bucket each class is compared with the bucket's smallest one
   (confirmed on full sets). That is linear in the bucket however large.
3. Classes that share a bucket but are not yet in one component are the rest.
   For them an exact prefix filter (rarest shingles first, by their counts over
   the rest, with the size and position bounds) finds every pair that can still
   reach the threshold, without writing out a bucket's pairs; those pairs are
   confirmed too.
4. Components over the confirmed links.

At a similarity of 0.75 two sets of n shingles miss all 32 bands with a
probability that falls with n: 7e-6 for 25 shingles, 5e-6 for many. For smaller sets it would be larger
(1e-4 for 3 of 4), so sets of at most ``SMALL`` shingles also meet in one bucket for
each of their first shingles in hash order, as many as make a common one certain.

Edge cases: null or blank texts have an empty set and are linked with nothing;
texts with fewer words than a shingle have their whole sequence as one; rows
without a doc_id are linked with nothing and have a null component; repeated
rows fall into one class; rows that share a doc_id are judged each by its own
text, and a component has the smallest doc_id in it; an empty table gives an empty
result; further input columns are ignored by :func:`classes` and kept by
:func:`keep_one`.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shingles
from . import textvec as tv
from .components import components
from .workspace import Space, drop_written, joined_by, pick, with_row, written

PERMUTATIONS = 64
PER_BAND = 2
LINK, OF = 75, 100
SMALL = 24

_rng = np.random.default_rng(0xD0C5)
_MUL = _rng.integers(0, 1 << 62, PERMUTATIONS, dtype=np.int64).view(tv.U) * tv.U(2) + tv.U(1)
_XOR = _rng.integers(0, 1 << 62, PERMUTATIONS, dtype=np.int64).view(tv.U) * tv.U(3)


def min_max(values: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Per document (row) the minimum and maximum under each permutation; no document may be empty."""
    out = np.empty((len(first), 2 * PERMUTATIONS), tv.U)
    for p in range(PERMUTATIONS):
        x = values ^ _XOR[p]
        x *= _MUL[p]
        out[:, 2 * p] = np.minimum.reduceat(x, first)
        out[:, 2 * p + 1] = np.maximum.reduceat(x, first)
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of ``2 * PER_BAND`` signature values."""
    bands = PERMUTATIONS // PER_BAND
    grouped = signature.reshape(len(signature), bands, 2 * PER_BAND)
    key = np.broadcast_to(np.arange(bands, dtype=tv.U), (len(signature), bands)).copy()
    for j in range(2 * PER_BAND):
        key = tv.mix(key * tv.U(0x9E3779B97F4A7C15) + grouped[:, :, j])
    return key


def prefix_length(n: int) -> int:
    """With this many first shingles of an n-set, in a fixed order, any partner must share one."""
    return n - -(-LINK * n // OF) + 1


def _sign(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1)
            for (c, values, first), (_, more, _) in zip(shingles.shingle_lists(texts, width), shingles.shingle_lists(texts, width, 1)):
                size, a, b = np.zeros(c.n, np.int64), np.zeros(c.n, np.int64), np.zeros(c.n, np.int64)
                full = np.flatnonzero(first[1:] > first[:-1])
                keys = band_keys(min_max(values, first[:-1][full])) if len(full) else np.zeros((0, 1), tv.U)
                lists = []
                for k, i in enumerate(full):
                    s, at = np.unique(values[first[i] : first[i + 1]], return_index=True)
                    size[i] = len(s)
                    both = hashlib.blake2b(s.tobytes() + more[first[i] : first[i + 1]][at].tobytes(), digest_size=16).digest()
                    a[i], b[i] = np.frombuffer(both, "<i8")
                    lists.append(np.append(keys[k], tv.mix(s[: prefix_length(len(s))] + tv.U(1))) if len(s) <= SMALL else keys[k])
                offsets = np.zeros(c.n + 1, np.int32)
                offsets[full + 1] = [len(x) for x in lists]
                flat = np.concatenate(lists) if lists else np.zeros(0, tv.U)
                bands = pa.ListArray.from_arrays(pa.array(np.cumsum(offsets, dtype=np.int32)), pa.array(flat.view(np.int64)))
                own = [x.slice(c.lo, c.n) for x in batch.columns[:-1]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(size), pa.array(a), pa.array(b), bands], names=[*batch.schema.names[:-1], "n_shingles", "set_a", "set_b", "bands"])

    return run


def signatures(docs: DataFrame, width: int = shingles.WIDTH, carried: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, the carried columns, number of distinct shingles, 128-bit digest of the set, band keys."""
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *carried, F.col("text"))
    own = ", ".join(f"{c} {narrow.schema[c].dataType.simpleString()}" for c in ("doc_id", *carried))
    return narrow.mapInArrow(_sign(width), f"{own}, n_shingles long, set_a long, set_b long, bands array<long>")


def _confirm(width: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            left, right = shingles.shingle_sets(batch.column(2), width), shingles.shingle_sets(batch.column(3), width)
            for x, y in zip(left, right):
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(OF * both >= LINK * (len(x) + len(y) - both))
            mask = pa.array(keep, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(mask), batch.column(1).filter(mask)], names=["a", "b"])

    return run


_NODE = "struct<doc_id:bigint,set_a:bigint>"


def _node():
    return F.struct("doc_id", "set_a")


def confirmed(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """The pairs (a, b) of nodes whose full shingle sets reach the threshold."""
    left = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a"))
    right = texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
    both = pairs.join(right, "b").join(left, "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(_confirm(width), f"a {_NODE}, b {_NODE}")


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = shingles.shingle_sets(batch.column(2), width)
        row = pa.array(np.repeat(np.arange(batch.num_rows), [len(s) for s in sets]))
        flat = np.concatenate(sets) if sets else np.zeros(0, tv.U)
        yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(flat.view(np.int64))], names=["nid", "cid", "shingle"])


def rest_pairs(rest: DataFrame, width: int) -> DataFrame:
    """Every pair (a > b) of ``rest`` (node, comp, text) in different components that the exact bounds allow.

    Each shingle's count comes by a join, so the order, rarest first, is exact
    however many frequent shingles there are. Rows are numbered to keep that narrow.
    """
    numbered = written(rest.select(F.monotonically_increasing_id().alias("nid"), F.xxhash64("comp").alias("cid"), "node", "text"), "rest")
    each = written(numbered.select("nid", "cid", "text").mapInArrow(lambda b: _sets(b, width), "nid long, cid long, shingle long"), "sets")
    counts = each.groupBy("shingle").agg(F.count(F.lit(1)).alias("df"), F.min("cid").alias("lo"), F.max("cid").alias("hi")).where("df > 1")
    # Shingles of a single row come first in the order and join nothing, so their number is all that matters of them.
    sizes = each.groupBy("nid").agg(F.count(F.lit(1)).alias("n"))
    known = each.join(counts.select("shingle", "df", (F.col("lo") != F.col("hi")).alias("joins")), "shingle")
    ordered = known.groupBy("nid", "cid").agg(F.array_sort(F.collect_list(F.struct("df", "shingle", "joins"))).alias("all")).join(sizes, "nid")
    single = F.col("n") - F.size("all")
    length = F.greatest(F.lit(0), F.col("n") - F.ceil(F.col("n") * LINK / F.lit(OF)).cast("int") + 1 - single)
    heads = ordered.select("nid", "cid", "n", single.alias("single"), F.posexplode(F.slice("all", 1, length.cast("int"))).alias("k", "s")).where("s.joins")
    heads = written(heads.select("nid", "cid", "n", (F.col("single") + F.col("k")).alias("k"), "s.shingle"), "prefixes")
    x = heads.select("shingle", F.col("nid").alias("ia"), F.col("cid").alias("ca"), F.col("n").alias("na"), F.col("k").alias("ka"))
    y = heads.select("shingle", F.col("nid").alias("ib"), F.col("cid").alias("cb"), F.col("n").alias("nb"), F.col("k").alias("kb"))
    # With o common shingles: OF * o >= LINK * (na + nb - o). What follows the first common one bounds o.
    most = F.least(F.col("na") - F.col("ka"), F.col("nb") - F.col("kb"))
    fits = (F.col("ia") > F.col("ib")) & (F.col("ca") != F.col("cb")) & (OF * F.least("na", "nb") >= LINK * F.greatest("na", "nb"))
    pairs = written(x.join(y, (x["shingle"] == y["shingle"]) & fits & ((OF + LINK) * most >= LINK * (F.col("na") + F.col("nb")))).select("ia", "ib").distinct(), "pairs")
    names = numbered.select("nid", "node")
    out = written(pairs.join(names.toDF("ia", "a"), "ia").join(names.toDF("ib", "b"), "ib").select("a", "b"), "pairs")
    for table in (numbered, each, heads, pairs):
        drop_written(table)
    return out


def _components(rows: DataFrame, ident: tuple[str, ...], signed: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """Classes (node, set_a, set_b, n_shingles), and (node, label) of those with a link.

    A class is seen through one of its rows, that of its smallest doc_id.
    """
    own = ["set_a", "set_b", "n_shingles"]
    full = signed.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = full.groupBy(*own).agg(F.min(F.struct("doc_id", *ident)).alias("r")).select("r.*", *own)
    reps = written(first.select(_node().alias("node"), *ident, *own), "classes")
    members = full.select(*ident, "bands").join(reps.select("node", *ident), list(ident)).select("node", *ident, F.explode("bands").alias("key"))
    hubs = members.groupBy("key").agg(F.min("node").alias("hub"), F.max("node").alias("other")).where("hub < other").select("key", "hub")
    shared = written(members.join(hubs, "key"), "buckets")
    texts = written(rows.select(*ident, "text").join(shared.select("node", *ident).distinct(), list(ident)).select("node", "text"), "texts")
    stars = shared.where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    links = written(confirmed(stars, texts, width), "links")
    found = components(links)
    placed = shared.select("key", "node").join(found, "node", "left").select("key", "node", F.coalesce("label", "node").alias("comp"))
    mixed = placed.groupBy("key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("key")
    rest = placed.join(mixed, "key", "left_semi").select("node", "comp").distinct()
    more = written(confirmed(rest_pairs(texts.join(rest, "node"), width), texts, width), "links")
    if more.limit(1).count():
        drop_written(found)
        found = components(links.unionByName(more))
    for table in (shared, texts, links, more):
        drop_written(table)
    return reps, found


def _judged(rows: DataFrame, ident: tuple[str, ...], width: int) -> DataFrame:
    full = written(signatures(rows, width, ident), "signatures")
    own = ["set_a", "set_b", "n_shingles"]
    signed = written(full.select("doc_id", *ident, *own), "sets")
    reps, found = _components(rows, ident, full, width)
    drop_written(full)
    labelled = reps.join(found, "node", "left").select(*own, F.coalesce("label", "node").alias("label"))
    out = signed.select("doc_id", *ident, *own).join(labelled, own, "left")
    # Without a set, or without a link to others, a row's group has its own doc_id.
    group = F.when(F.col("doc_id").isNotNull(), F.coalesce("label", F.struct("doc_id", F.lit(0).cast("long").alias("set_a")))).alias("group")
    return out.select("doc_id", *ident, "n_shingles", group).withColumn("component_id", F.col("group.doc_id")).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def classes(docs: DataFrame, width: int = shingles.WIDTH) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row."""
    rows, ident = with_row(docs.select("doc_id", "text"))
    return _judged(rows, ident, width).drop(*ident, "group")


def keep_one(docs: DataFrame, width: int = shingles.WIDTH) -> DataFrame:
    """The documents (all columns), one row of each group.

    It is the group's first row with its smallest doc_id. Rows of one doc_id with texts
    that are not linked are of different groups; those without any word are one group.
    Rows without a doc_id stay. Of the working tables only the places of the rows that stay are kept.
    """
    with Space() as space:
        rows, ident = with_row(docs)
        good = _judged(rows, ident, width).where("kept")
        one = good.where("doc_id IS NOT NULL").groupBy("group").agg(F.min(F.struct(*ident)).alias("r")).select("r.*")
        stay = space.keep(written(one.unionByName(good.where("doc_id IS NULL").select(*ident)), "stay"))
    return rows.join(joined_by(stay), list(ident), "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return classes(pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_transform(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: translate(x, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS ws FROM documents
), s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i+4], ' ')) END) AS g FROM w
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.doc_id > b.doc_id GROUP BY ALL
), l AS (SELECT a, b FROM o JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 75 * (x.n + y.n - o)
), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l
), r AS (SELECT doc_id AS node, doc_id AS root FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.node WHERE r.root < e.b)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(root) AS component_id FROM r GROUP BY node) c ON c.node = d.doc_id
"""
