"""Mixing sources to target weights by pivotal dependent rounding.

A source's target is its share of all words, at most ``MOST_COPIES`` times its
own size, with the excess reshared by weight. Target over size is the number
of copies that each of its documents should have; the whole part is given and
the fraction is rounded dependently: two fractional documents exchange words,
in a random direction that keeps both expectations, until one of them is
integral. As words (not probabilities) are what is exchanged, a source's total
never changes, and ends within one document of its target. Blocks of about
``BLOCK`` documents of one source are rounded on their own and leave at most
one fractional document; a tree of fan-in ``FAN_IN`` combines those. The random
numbers depend on source and block only, so reruns agree.

Edge cases: null text has size 0 (and takes 0 words); null sources are one
source, the last in order; repeated rows are rounded row by row; rows without a doc_id are told apart by their place in
the input; with no words at all every target is 0; an empty table gives an empty result; further
columns are ignored by :func:`mix` and kept by :func:`mixed_documents`.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import numbered
from .workspace import Space, drop_written, joined_by, pick, with_row, written

WORD = r"[^\x20\x09-\x0D]+"
MOST_COPIES = 3
BLOCK = 4096
#: A block with so many times BLOCK rows is dealt again.
CROWDED = 4
FAN_IN = 64
WEIGHTS = (1, 2, 3)

_SCHEMA = "file long, place long, doc_id long, source string, size long, source_size long, target double, whole int, part double, block long, extra int"


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES) -> DataFrame:
    """From (source, source_size, n) the target of each source and its copies per document.

    Every source gets words by weight up to a common level, or its cap. A source whose cap is below the level
    is capped, which raises the level of the others; a few rounds of sums over all sources settle it. Sources are numbered in
    sorted ranges, so they may be as many as documents. Sums are of whole numbers, the same in any order.
    """
    ordered = numbered(sources.withColumn("_order", F.struct(F.col("source").isNull().alias("last"), "source")), [], "_order")
    index = F.pmod(F.col("number") - 1, F.lit(len(weights)))
    s = ordered.withColumn("w", F.element_at(F.array(*map(F.lit, weights)), (index + 1).cast("int")).cast("long")).withColumn("cap", F.col("source_size") * most)
    s = written(s.select("source", "source_size", "n", "w", "cap"), "sources")
    drop_written(ordered)
    level, before = 0.0, None
    while level != before:
        capped = F.col("cap") < F.lit(level) * F.col("w")
        got = s.agg(F.sum("source_size").alias("all"), F.sum(F.when(capped, F.col("cap"))).alias("capped"), F.sum(F.when(~capped, F.col("w"))).alias("open")).first()
        before = level
        if got["open"]:
            level = max(level, (got["all"] - (got["capped"] or 0)) / got["open"])
    target = F.least(F.col("cap").cast("double"), F.lit(level) * F.col("w"))
    return s.withColumn("target", target).select("source", "source_size", "n", "target", F.coalesce(F.try_divide("target", "source_size"), F.lit(0.0)).alias("copies"))


def pivot(part: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, int, float]:
    """Round fractions ``part`` of documents of ``size`` words in order.

    Returns 0/1 for each document, the index of the one left fractional (-1 if
    none) and its fraction. The sum of part * size is kept but for that one.
    """
    out = np.zeros(len(part), np.int64)
    draws = rng.random(len(part))
    at, p = -1, 0.0
    for j in range(len(part)):
        q = float(part[j])
        if q <= 0.0:
            continue
        if q >= 1.0:
            out[j] = 1
            continue
        if at < 0:
            at, p = j, q
            continue
        si, sj = float(size[at]), float(size[j])
        to_j, to_i = min(p * si, (1 - q) * sj), min(q * sj, (1 - p) * si)
        if draws[j] * (to_j + to_i) < to_i:  # words go from the document at hand to j
            if p * si <= (1 - q) * sj:
                q = q + to_j / sj
                at, p = (j, q) if q < 1 - 1e-12 else (-1, 0.0)
                if at < 0:
                    out[j] = 1
            else:
                out[j] = 1
                p -= to_j / si
        elif q * sj <= (1 - p) * si:
            p += to_i / si
            if p >= 1 - 1e-12:
                out[at], at, p = 1, -1, 0.0
        else:
            out[at] = 1
            at, p = j, q - to_i / sj
        if at >= 0 and p <= 1e-12:
            at, p = -1, 0.0
    return out, at, p


def _rounder(seed: int, level: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        # Large documents first: small ones then use up what is left of them, so the last one left is small.
        pdf = pdf.sort_values(["size", "doc_id", "file", "place"], ascending=False, kind="stable").reset_index(drop=True)
        source = pdf["source"].iloc[0]
        name = "\0" if source is None or source != source else source
        rng = np.random.default_rng([seed, level, zlib.crc32(name.encode()), int(pdf["block"].iloc[0])])
        size = pdf["size"].to_numpy(np.float64)
        part = pdf["part"].to_numpy(np.float64).copy()
        empty = size == 0
        got = np.zeros(len(pdf), np.int64)
        got[empty] = rng.random(int(empty.sum())) < part[empty]
        full = np.flatnonzero(~empty)
        rounded, left, p = pivot(part[full], size[full], rng)
        got[full] = rounded
        extra = pd.array(got, dtype="Int32")
        if left >= 0:
            extra[full[left]] = pd.NA
            part[full[left]] = p
        pdf["part"], pdf["extra"] = part, extra
        pdf["block"] = pdf["block"] // FAN_IN
        return pdf

    return run


def mix(docs: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 7) -> DataFrame:
    """doc_id, size, source_size, target, taken and copies of every row."""
    rows, ident = with_row(docs.select("doc_id", "text", F.col(f"`{source}`").alias("source")))
    return _mixed(rows, ident, "source", weights, most, seed).drop("file", "place")


def _mixed(rows: DataFrame, ident: tuple[str, ...], source: str, weights: tuple[int, ...], most: int, seed: int) -> DataFrame:
    place = [F.col(c).alias(n) for c, n in zip(ident, ("file", "place"))]
    sized = written(rows.select(*place, F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{source}`").cast("string").alias("source"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size")), "sizes")
    sources = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n")), weights, most)
    goal = sources.select(F.col("source").alias("s"), "source_size", "n", "target", "copies")
    whole = F.least(F.floor("copies"), F.lit(most)).cast("int")
    blocks = F.ceil(F.col("n") / F.lit(BLOCK))
    dealt = sized.join(goal, F.col("source").eqNullSafe(F.col("s"))).select(
        "file", "place", "doc_id", "source", "size", "source_size", "target", whole.alias("whole"),
        F.when(whole < most, F.col("copies") - whole).otherwise(0.0).alias("part"),
        F.pmod(F.xxhash64(F.coalesce("doc_id", F.xxhash64("file", "place")), "size"), blocks).cast("long").alias("block"), F.lit(None).cast("int").alias("extra"),
    )
    largest = sources.agg(F.max("n")).first()[0] or 0
    crowded = written(dealt.groupBy("source", "block").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > CROWDED * BLOCK).select(F.col("source").alias("s"), F.col("block").alias("b")), "crowded")
    if crowded.limit(1).count():
        # Rows of one id and size share a block; where they are too many, they are dealt by their places to as many blocks again.
        full = F.col("source").eqNullSafe(F.col("s")) & (F.col("block") == F.col("b"))
        other = goal.select(F.col("s").alias("_source"), blocks.cast("long").alias("_blocks"))
        dealt = dealt.join(joined_by(crowded), full, "left").join(other, F.col("source").eqNullSafe(F.col("_source")))
        dealt = dealt.withColumn("block", F.when(F.col("b").isNotNull(), F.col("_blocks") + F.pmod(F.xxhash64("file", "place"), F.col("_blocks"))).otherwise(F.col("block"))).drop("s", "b", "_source", "_blocks")
        largest *= 2
    levels = 1 + math.ceil(math.log(max(1, largest / BLOCK), FAN_IN))
    if FAN_IN ** (levels - 1) * BLOCK < largest:
        levels += 1
    done = None
    for level in range(levels):
        rounded = written(dealt.groupBy("source", "block").applyInPandas(_rounder(seed, level), _SCHEMA), f"rounded{level}")
        ready = rounded.where("extra IS NOT NULL")
        done = ready if done is None else done.unionByName(ready)
        dealt = rounded.where("extra IS NULL")
    chance = F.pmod(F.xxhash64("source", F.lit(seed)), F.lit(1 << 30)) / float(1 << 30)
    last = dealt.withColumn("extra", (chance < F.col("part")).cast("int"))
    done = done.unionByName(last)
    return done.select("file", "place", "doc_id", "size", "source_size", "target", ((F.col("whole") + F.col("extra")) * F.col("size")).cast("long").alias("taken"), (F.col("whole") + F.col("extra")).alias("copies"))


def mixed_documents(docs: DataFrame, source: str = "source", weights: tuple[int, ...] = WEIGHTS, most: int = MOST_COPIES, seed: int = 7) -> DataFrame:
    """The documents (all columns), each row as often as the mix takes it."""
    with Space() as space:
        rows, ident = with_row(docs)
        copies = _mixed(rows, ident, source, weights, most, seed).where("copies > 0")
        taken = space.keep(written(copies.select(*[F.col(n).alias(c) for c, n in zip(ident, ("file", "place"))], F.col("copies").alias("_veil_copies")), "copies"))
    again = rows.join(joined_by(taken), list(ident)).withColumn("_veil_k", F.explode(F.sequence(F.lit(1), F.col("_veil_copies"))))
    return again.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark, sf_dir: str) -> DataFrame:
    return mix(pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source"))
