"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame functions only.

Keys hash to one of ``RING`` positions; every shard owns the arcs before its
virtual nodes. A shard's capacity is its even share of the rows (shares differ
by one row at most: the ``rows`` law). Keys of its own arcs fill a shard
first; those beyond its capacity continue clockwise to the next virtual node
whose shard has room. The plan is made from the row count of each ring
position, a table of at most ``RING`` rows whatever the data; rows find their
place by their rank within their ring position (1/16384 of the keys). A position
with far more rows, as of one repeated or null key, is ranked in salted pieces, so
it is not ordered in one task.

One more shard takes over the arcs of its virtual nodes and, as all shares shrink,
some rows beyond the new shares: with even positions 8.6 % of the rows move (5.9 % is
the least), of them 2.7 % between old shards.

Edge cases: null text has size 1 and crc 0; null keys share one position;
repeated rows are placed one by one; an empty table gives an empty result;
extra columns of the input are left out (``assign``) or kept (``write_shards``).
"""

from __future__ import annotations

import hashlib
import json
from bisect import bisect_left

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .workspace import pick, written

RING = 16384
VIRTUAL_NODES = 64
SHARDS = 16
#: A position is hot with more rows than this and than HOT_SHARE times the mean, so at most RING / HOT_SHARE are.
HOT_ROWS, HOT_SHARE, SALTS = 100_000, 16, 64


def ring_nodes(shards: int, virtual: int = VIRTUAL_NODES, ring: int = RING) -> list[tuple[int, int]]:
    """Sorted (position, shard) of the virtual nodes; a shard's nodes never depend on the others."""
    nodes = []
    for s in range(shards):
        for v in range(virtual):
            h = int.from_bytes(hashlib.blake2b(f"{s}/{v}".encode(), digest_size=8).digest(), "big")
            nodes.append((h % ring, h, s))
    return [(p, s) for p, _, s in sorted(nodes)]


def ring_plan(counts: dict[int, int], shards: int, virtual: int = VIRTUAL_NODES, ring: int = RING) -> list[dict]:
    """Segments (position, lo, hi, shard, base): ranks lo..hi-1 of a position take the
    places base.. of a shard."""
    nodes = ring_nodes(shards, virtual, ring)
    places = [p for p, _ in nodes]
    total = sum(counts.values())
    room = [total // shards + (s < total % shards) for s in range(shards)]
    used = [0] * shards
    out: list[dict] = []
    over: list[tuple[int, int, int, int]] = []

    def put(pos: int, lo: int, n: int, s: int) -> None:
        out.append({"pos": pos, "lo": lo, "hi": lo + n, "shard": s, "base": used[s]})
        used[s] += n
        room[s] -= n

    for pos in sorted(counts):
        n, at = counts[pos], bisect_left(places, pos) % len(nodes)
        own = min(n, room[nodes[at][1]])
        if own:
            put(pos, 0, own, nodes[at][1])
        if own < n:
            over.append((pos, own, n - own, at))
    for pos, lo, n, at in over:
        while n:
            at = (at + 1) % len(nodes)
            take = min(n, room[nodes[at][1]])
            if take:
                put(pos, lo, take, nodes[at][1])
                lo, n = lo + take, n - take
    return out


def assign(df: DataFrame, key: str, payload: list, shards: int = SHARDS) -> DataFrame:
    """``key``, the payload columns, and each row's shard and gapless slot in it."""
    spark = df.sparkSession
    pos = F.pmod(F.xxhash64(F.col(f"`{key}`")), F.lit(RING)).cast("int")
    counted = df.select(pos.alias("pos")).groupBy("pos").count()
    # At most RING rows come to the driver.
    counts = {r["pos"]: r["count"] for r in counted.collect()}
    segments = ring_plan(counts, shards)
    schema = "array<struct<pos:int,lo:long,hi:long,shard:int,base:long>>"
    plan = spark.range(1).select(F.explode(F.from_json(F.lit(json.dumps(segments)), schema)).alias("s")).select("s.*")
    placed = df.select(F.col(f"`{key}`"), *payload, pos.alias("pos"))
    names = [c for c in placed.columns if c != "pos"]
    order = [F.xxhash64(F.col(f"`{key}`"), F.lit(1)), *[F.col(f"`{c}`") for c in names]]
    hot = [p for p, n in counts.items() if n > max(HOT_ROWS, HOT_SHARE * sum(counts.values()) // RING)]
    if hot:
        few = F.broadcast(spark.createDataFrame([(p, True) for p in hot], "pos int, hot boolean"))
        # Rows of hot positions are written with a number each, so that equal rows are spread as well.
        fixed = written(placed.join(few.select("pos"), "pos", "left_semi").withColumn("_row", F.monotonically_increasing_id()), "hot").withColumn("salt", F.pmod(F.xxhash64("_row"), F.lit(SALTS)))
        # At most SALTS rows for each hot position: a bounded table.
        pieces = fixed.groupBy("pos", "salt").count()
        before = pieces.select("pos", "salt", (F.sum("count").over(Window.partitionBy("pos").orderBy("salt")) - F.col("count")).alias("before"))
        local = F.row_number().over(Window.partitionBy("pos", "salt").orderBy(*order, "_row")) - 1
        spread = fixed.withColumn("local", local).join(F.broadcast(before), ["pos", "salt"]).withColumn("rank", F.col("local") + F.col("before")).select(*placed.columns, "rank")
        cold = placed.join(few.select("pos"), "pos", "left_anti")
        ranked = cold.withColumn("rank", F.row_number().over(Window.partitionBy("pos").orderBy(*order)) - 1).select(*placed.columns, "rank").unionByName(spread)
    else:
        ranked = placed.withColumn("rank", F.row_number().over(Window.partitionBy("pos").orderBy(*order)) - 1)
    # The plan has RING rows plus one per split position: a bounded broadcast.
    hit = ranked.join(F.broadcast(plan.withColumnRenamed("pos", "p")), (F.col("pos") == F.col("p")) & (F.col("rank") >= F.col("lo")) & (F.col("rank") < F.col("hi")))
    return hit.select(*[F.col(f"`{c}`") for c in names], "shard", (F.col("base") + F.col("rank") - F.col("lo")).alias("slot"))


def write_shards(df: DataFrame, key: str, path: str, shards: int = SHARDS) -> None:
    """Write the rows, all columns, into one folder ``_shard=n`` per shard, in slot order within each file."""
    payload = [F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row")]
    out = assign(df, key, payload, shards).select(F.col("shard").alias("_shard"), F.col("slot").alias("_slot"), "row.*")
    out.repartition(shards, "_shard").sortWithinPartitions("_shard", "_slot").write.partitionBy("_shard").parquet(path)


def query(spark, sf_dir: str) -> DataFrame:
    docs = pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text")
    text = F.coalesce(F.col("text"), F.lit(""))
    payload = [(F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32")]
    out = assign(docs, "doc_id", payload)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
