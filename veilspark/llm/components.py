"""Connected components of a link table, without a driver-side graph.

Null ends are no links; repeated links count once; an empty table gives an empty
result. Nodes may be of any type that has an order, also structs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .workspace import drop_written, written

#: A key with more rows than this and than a ten-thousandth of all rows is hot; so there are fewer than ten thousand of them.
HOT_ROWS, HOT_SHARE = 100_000, 10_000


def _hot(rows: DataFrame, key: str) -> DataFrame | None:
    """The hot keys, a table of fewer than HOT_SHARE rows; counted before the shuffle."""
    counts = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))
    total = rows.count()
    if total <= HOT_ROWS:
        return None
    hot = written(counts.where(F.col("n") > max(HOT_ROWS, total // HOT_SHARE)).select(key), "hot")
    return hot if hot.limit(1).count() else None


def _looked_up(rows: DataFrame, key: str, labels: DataFrame, hot: DataFrame | None) -> DataFrame:
    """``rows`` joined with one label per key. Labels of hot keys are broadcast (a bounded table), so their rows are not shuffled."""
    if hot is None:
        return rows.join(labels, key)
    cold = rows.join(F.broadcast(hot), key, "left_anti").join(labels, key)
    few = labels.join(F.broadcast(hot), key, "left_semi")
    return cold.unionByName(rows.join(F.broadcast(few), key))


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the undirected edges (a, b).

    Every round each node takes the least label among its neighbours, then the
    label of that label, so long chains halve. Labels are written to the shared
    folder each round. Minima are combined before the shuffle. The two joins are by
    neighbour and by label, of which a hub or a large component has very many rows:
    those keys are found first and joined by broadcast.
    """
    edges = edges.where("a IS NOT NULL AND b IS NOT NULL")
    both = written(edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct(), "edges")
    hubs = _hot(both, "v")
    labels = written(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("label")), "labels")
    while True:
        seen = _looked_up(both, "v", labels.select(F.col("node").alias("v"), "label"), hubs).groupBy("u").agg(F.min("label").alias("near"))
        near = labels.join(seen.withColumnRenamed("u", "node"), "node").select("node", "label", F.least("label", "near").alias("next"))
        # A label is a node of the same component, so it has a label of its own.
        hop = labels.select(F.col("node").alias("next"), F.col("label").alias("far"))
        large = _hot(labels.select(F.col("label").alias("next")), "next")
        new = written(_looked_up(near, "next", hop, large).select("node", F.least("next", "far").alias("label"), (F.least("next", "far") < F.col("label")).alias("moved")), "labels")
        moved = new.where("moved").limit(1).count()
        drop_written(labels)
        path = new._veil_path
        labels = new.select("node", "label")
        labels._veil_path = path
        if not moved:
            drop_written(both)
            return labels
