"""When a frame may be captured and kept: spacing of captures, foreground and stability over attempts."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from .geometry import rects_stable

# Least microseconds between captures, attempts, and the first pause after one that moved (it grows by itself).
SPACING, ATTEMPTS, PAUSE_MS = 550_000, 4, 150


def spaced(requests: DataFrame, key: str, at: str, order: str, gap: int = SPACING) -> DataFrame:
    """``wait`` before each request of a key starts, so that starts lie at least the gap apart (same unit as ``at``).

    A start is the later of its request and the last start plus the gap. Unrolled,
    that is a running maximum of request time less rank times gap: one window,
    no state passed from row to row.
    """
    by = Window.partitionBy(key).orderBy(at, order)
    ranked = requests.withColumn("_rank", F.row_number().over(by).cast("long") * gap)
    latest = F.max(F.col(at) - F.col("_rank")).over(by.rowsBetween(Window.unboundedPreceding, 0))
    return ranked.withColumn("wait", latest + F.col("_rank") - F.col(at)).drop("_rank")


def spaced_stream(requests: DataFrame, gap: int = SPACING) -> DataFrame:
    """The same over a stream of (key, at, seq), the last start kept per key."""

    def run(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        rows = pd.concat(list(batches)).sort_values(["at", "seq"], kind="stable")
        waits = []
        for at in rows["at"]:
            last = at if last is None else max(at, last + gap)
            waits.append(last - at)
        state.update((int(last),))
        yield rows[["key", "seq"]].assign(wait=waits)

    return requests.select(F.col("key").cast("string"), F.col("at").cast("long"), F.col("seq").cast("long")).groupBy("key").applyInPandasWithState(run, "key string, seq long, wait long", "last long", "append", GroupStateTimeout.NoTimeout)


def same_content(a: Column, b: Column) -> Column:
    """Two perceptions show the same: url, number of media and canvases, and findings with value, class and place."""
    same = F.zip_with(a["findings"], b["findings"], lambda x, y: x["value"].eqNullSafe(y["value"]) & x["pii_class"].eqNullSafe(y["pii_class"]) & rects_stable(x["rects"], y["rects"]))
    sizes = [F.size(a[k]) == F.size(b[k]) for k in ("findings", "media", "canvas")]
    return a["url"].eqNullSafe(b["url"]) & sizes[0] & sizes[1] & sizes[2] & F.forall(same, lambda x: F.coalesce(x, F.lit(False)))


def stable(a: Column, b: Column) -> Column:
    """Nothing scrolled, changed or moved between two perceptions; null counts as moved."""
    return F.coalesce((a["scroll_x"] == b["scroll_x"]) & (a["scroll_y"] == b["scroll_y"]) & same_content(a, b) & rects_stable(a["probe"], b["probe"]), F.lit(False))


def outcomes(attempts: DataFrame, key: list[str], steady: Column, front: Column, attempt: str = "attempt") -> DataFrame:
    """One row per step: the attempt that decides, ``captured``, ``not in front`` or ``kept moving``, and the pauses before.

    The first four attempts count (from 0). A tab that is not in front, or switched,
    ends the step at once, also where an attempt has several rows; an attempt that
    moved is tried again after a pause.
    """
    n, seen = F.col(attempt), F.col(attempt) < ATTEMPTS
    first = F.min(F.when(seen & (steady | ~front), F.struct(n.alias("n"), front.alias("front"))))
    out = attempts.groupBy(*key).agg(first.alias("_first"), F.count_if(seen).alias("_tried")).withColumn("attempt", F.col("_first.n"))
    failed = F.coalesce(F.col("attempt"), F.col("_tried"))
    return out.select(*key, "attempt", F.when(F.col("attempt").isNull(), "kept moving").when(F.col("_first.front"), "captured").otherwise("not in front").alias("outcome"), (F.lit(PAUSE_MS) * failed * (failed + 1) / 2).cast("long").alias("pause_ms"))
