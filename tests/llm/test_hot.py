"""A hundred thousand equal rows: no group, window or block holds them all."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspark.llm import langid, mixing, packing, sharding
from veilspark.llm.workspace import written

N = 100_000


@pytest.fixture(scope="module")
def equal(spark):
    """Equal rows without an id and with one, and a few others, in files."""
    rows = spark.range(N).select(F.when(F.col("id") % 2 == 0, 7).cast("long").alias("doc_id"), F.lit("one two three").alias("text"), F.lit("en").alias("lang"), F.lit("s").alias("source"))
    few = spark.range(50).select(F.col("id").alias("doc_id"), F.concat_ws(" ", F.lit("word"), F.col("id").cast("string")).alias("text"), F.lit("de").alias("lang"), F.lit("t").alias("source"))
    return written(rows.unionByName(few).repartition(5), "equal")


def test_mixing_deals_a_crowded_block_again(spark, equal, monkeypatch):
    sizes = []
    rounder = mixing._rounder

    def seen(seed, level):
        run = rounder(seed, level)

        def counted(pdf):
            assert len(pdf) <= mixing.CROWDED * mixing.BLOCK
            return run(pdf)

        sizes.append(level)
        return counted

    monkeypatch.setattr(mixing, "_rounder", seen)
    out = mixing.mix(equal).cache()
    assert out.count() == N + 50 and len(sizes) >= 2
    for r in out.groupBy("source_size").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("size"), F.max(F.col("taken") / F.col("size")).alias("most")).collect():
        assert abs(r.taken - r.target) <= 2 * r.size and r.most <= mixing.MOST_COPIES


def test_packing_spreads_equal_pieces(spark, equal):
    out = packing.pack(equal).cache()
    used = out.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("places"), F.count(F.lit(1)).alias("rows")).agg(F.max("n").alias("n"), F.sum((F.col("places") != F.col("rows")).cast("int")).alias("clash"), F.sum("rows").alias("rows")).first()
    assert used.n <= 1024 and used.clash == 0 and used.rows == N + 50
    table = written(packing.pieces(equal, __import__("public_tokenizers").path(packing.TOKENIZER)).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    groups = table.groupBy("length", F.pmod(F.xxhash64("_row"), F.lit(64)).alias("salt")).count().agg(F.max("count")).first()[0]
    assert groups < 2 * N / 64


def test_sharding_spreads_equal_rows(spark, equal, monkeypatch):
    monkeypatch.setattr(sharding, "HOT_ROWS", 1000)
    out = sharding.assign(equal.select("doc_id", "text"), "doc_id", [F.length("text").alias("size")]).select("shard", "slot").collect()
    counts = Counter(r.shard for r in out)
    assert len(out) == N + 50 and max(counts.values()) - min(counts.values()) <= 1
    assert all(sorted(r.slot for r in out if r.shard == s) == list(range(n)) for s, n in counts.items())


def test_a_repeated_row_does_not_fill_the_driver(spark, equal, monkeypatch):
    fetched = []
    monkeypatch.setattr(langid, "train", lambda x, y, classes: fetched.append(len(x)))
    langid.fit(equal, 500)
    assert fetched == [] or fetched[0] <= 1000


def test_targets_of_many_sources(spark):
    sources = spark.range(3000).select(F.when(F.col("id") > 0, F.format_string("s%05d", "id")).alias("source"), (F.col("id") * F.col("id") % 997).alias("source_size"), F.lit(1).cast("long").alias("n"))
    got = {r.source: r.target for r in mixing.source_targets(sources).collect()}
    rows = sorted(((r.source, r.source_size) for r in sources.collect()), key=lambda r: (r[0] is None, r[0] or ""))
    w = [(1, 2, 3)[i % 3] for i in range(len(rows))]
    total, capped = sum(n for _, n in rows), set()
    while True:
        level = (total - sum(3 * rows[i][1] for i in capped)) / sum(w[i] for i in range(len(rows)) if i not in capped)
        more = {i for i in range(len(rows)) if i not in capped and 3 * rows[i][1] < level * w[i]}
        if not more:
            break
        capped |= more
    for i, (name, n) in enumerate(rows):
        assert abs(got[name] - (3 * n if i in capped else level * w[i])) < 1e-6 * max(1, total)
    assert abs(sum(got.values()) - total) < 1e-6 * total
