"""Rectangles: planning, overlap, suppression, matching, covered area.

A rectangle is ``struct<x, y, w, h>`` of doubles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PAD, LEAST_FONT, MOST_FONT, ADVANCE, FIT = 2.0, 11.0, 28.0, 0.62, 0.72
ON_MEDIA = 0.45


def rect(x: Column, y: Column, w: Column, h: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"), w.cast("double").alias("w"), h.cast("double").alias("h"))


def intersection(a: Column, b: Column) -> Column:
    x = F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"])
    y = F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"])
    return F.greatest(F.lit(0.0), x) * F.greatest(F.lit(0.0), y)


def _or_one(x: Column) -> Column:
    return F.when(x == 0, 1.0).otherwise(x)


def iou(a: Column, b: Column) -> Column:
    both = intersection(a, b)
    return both / _or_one(a["w"] * a["h"] + b["w"] * b["h"] - both)


def overlap_share(a: Column, b: Column) -> Column:
    return intersection(a, b) / _or_one(a["w"] * a["h"])


def clamp(r: Column, width: Column, height: Column) -> Column:
    """Whole pixels inside the frame; null if nothing is left."""
    x0, y0 = F.greatest(F.lit(0.0), F.floor(r["x"]).cast("double")), F.greatest(F.lit(0.0), F.floor(r["y"]).cast("double"))
    x1, y1 = F.least(width.cast("double"), F.ceil(r["x"] + r["w"]).cast("double")), F.least(height.cast("double"), F.ceil(r["y"] + r["h"]).cast("double"))
    return F.when((x1 > x0) & (y1 > y0), rect(x0, y0, x1 - x0, y1 - y0))


def map_to_viewport(x: Column, y: Column, sent_w: Column, sent_h: Column, view_w: Column, view_h: Column) -> Column:
    inside = (x >= 0) & (y >= 0) & (x < sent_w) & (y < sent_h)
    return F.when(inside, F.struct((x / sent_w * view_w).alias("x"), (y / sent_h * view_h).alias("y")))


def rects_stable(before: Column, after: Column, tolerance: float = 1.0) -> Column:
    """Same number of rectangles and none moved or grew by more than the tolerance."""
    near = F.zip_with(before, after, lambda a, b: F.greatest(*[F.abs(a[k] - b[k]) for k in "xywh"]) <= tolerance)
    return (F.size(before) == F.size(after)) & F.forall(near, lambda x: F.coalesce(x, F.lit(False)))


def plan(items: DataFrame, key: str, scale: Column, width: Column, height: Column) -> DataFrame:
    """Draw operations of (key, ordinal, rect, kind, label): boxes only grow, repeats go, masks come last."""
    token = (F.col("kind") == "token") & (F.coalesce(F.length("label"), F.lit(0)) > 0)
    r = F.col("rect")
    x, y, w, h = r["x"] * scale - PAD, r["y"] * scale - PAD, r["w"] * scale + 2 * PAD, r["h"] * scale + 2 * PAD
    size = F.length("label") * ADVANCE
    font = F.when(token, F.greatest(F.lit(LEAST_FONT), F.least(h * FIT, w / size, F.lit(MOST_FONT))))
    # Generators of one row keep each step's values from being written into the next step's expressions again and again.
    first = F.struct("ordinal", "kind", "label", x.alias("x"), y.alias("y"), w.alias("w"), h.alias("h"), font.alias("font"), width.alias("_w"), height.alias("_h"), size.alias("_size"))
    base = items.select(F.col(key), F.inline(F.array(first)))
    need_w = F.greatest(F.col("w"), F.coalesce(F.col("_size") * F.col("font") + 4, F.lit(0.0)))
    need_h = F.greatest(F.col("h"), F.coalesce(F.col("font") / FIT, F.lit(0.0)))
    grown = rect(F.col("x") - (need_w - F.col("w")) / 2, F.col("y") - (need_h - F.col("h")) / 2, need_w, need_h)
    token_op = (F.col("kind") == "token") & (F.coalesce(F.col("label"), F.lit("")) != "")
    op = F.struct(F.when(token_op, 0).otherwise(1).alias("late"), "ordinal", clamp(grown, F.col("_w"), F.col("_h")).alias("box"), "kind", F.coalesce("label", F.lit("")).alias("label"), "font")
    boxed = base.select(key, F.inline(F.array(F.struct(op.alias("o"))))).where("o.box IS NOT NULL")
    # All ops of a page in drawing order; of equal ones the first stays.
    ordered = boxed.groupBy(key).agg(F.array_sort(F.collect_list("o")).alias("all"))
    same = lambda o: F.struct(o["box"], o["kind"], o["label"])
    firsts = F.transform(F.array_distinct(F.transform("all", same)), lambda d: F.element_at(F.filter("all", lambda o: same(o) == d), 1))
    out = ordered.select(key, F.posexplode(firsts).alias("op", "o"))
    return out.select(key, "op", *[F.col(f"o.box.{c}").alias(c) for c in "xywh"], F.when(F.col("o.late") == 0, "token").otherwise("solid").alias("kind"), "o.label", "o.font")


def on_media(boxes: DataFrame, media: DataFrame, key: str) -> DataFrame:
    """Boxes (key, rect) that lie on a media rectangle of the same page."""
    m = media.select(F.col(key).alias("_page"), F.col("rect").alias("_media"))
    return boxes.join(m, (F.col(key) == F.col("_page")) & (overlap_share(F.col("rect"), F.col("_media")) >= ON_MEDIA), "left_semi")


def _box() -> Column:
    return F.struct("x", "y", "w", "h")


def nms(boxes: DataFrame, keys: list[str], threshold: float = 0.45) -> DataFrame:
    """Greedy suppression per group of rows (ordinal, score, x, y, w, h, ...), best score first.

    A fold over the group's boxes in the JVM. Groups are the boxes of one image
    (and class), so their size is bounded by what a detector emits.
    """
    rest = [c for c in boxes.columns if c not in keys]
    ordered = F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_o"), F.col("ordinal").alias("_i"), _box().alias("_r"), F.struct(*rest).alias("row"))))
    grouped = boxes.groupBy(*keys).agg(ordered.alias("all"))
    none = F.slice(F.col("all"), 1, 0)

    def step(kept: Column, b: Column) -> Column:
        return F.when(F.forall(kept, lambda k: iou(k["_r"], b["_r"]) < threshold), F.array_append(kept, b)).otherwise(kept)

    return grouped.select(*keys, F.explode(F.aggregate("all", none, step)).alias("b")).select(*keys, "b.row.*").select(*boxes.columns)


def match(detections: DataFrame, truth: DataFrame, keys: list[str], threshold: float = 0.5) -> DataFrame:
    """Greedy one-to-one matches per group in order of score; ``hit`` tells true from false positives.

    A detection takes the free truth of largest overlap (the later one on ties).
    """
    rest = [c for c in detections.columns if c not in keys]
    dets = detections.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("_o"), F.col("ordinal").alias("_i"), _box().alias("_r"), F.struct(*rest).alias("row")))).alias("dets"))
    free = truth.groupBy(*keys).agg(F.collect_list(_box()).alias("free"))
    none = F.array().cast("array<boolean>")
    start = F.struct(F.coalesce("free", F.array().cast("array<struct<x:double,y:double,w:double,h:double>>")).alias("free"), none.alias("hits"))

    def step(state: Column, d: Column) -> Column:
        best = F.array_max(F.transform(state["free"], lambda g, i: F.struct(iou(d["_r"], g).alias("v"), i.alias("i"))))
        hit = F.coalesce(best["v"] >= threshold, F.lit(False))
        return F.struct(F.when(hit, F.filter(state["free"], lambda g, i: i != best["i"])).otherwise(state["free"]).alias("free"), F.array_append(state["hits"], hit).alias("hits"))

    hits = F.aggregate("dets", start, step, lambda s: s["hits"])
    both = dets.join(free, keys, "left").withColumn("hits", hits)
    return both.select(*keys, F.explode(F.arrays_zip("dets", "hits")).alias("b")).select(*keys, "b.dets.row.*", F.col("b.hits").alias("hit"))


def covered_area(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Area of the union of a group's rectangles (x, y, w, h); groups without any are left out.

    The distinct edges in y cut a group's boxes into slabs; within a slab the boxes'
    runs in x are merged by a running maximum. Two folds in the JVM over what one page
    holds, whatever the resolution.
    """
    box = F.struct("x", "y", (F.col("x") + F.col("w")).alias("x1"), (F.col("y") + F.col("h")).alias("y1"))
    grouped = boxes.where("w > 0 AND h > 0").groupBy(*keys).agg(F.array_sort(F.collect_set(box)).alias("b"))
    edges = F.array_sort(F.array_distinct(F.concat(F.transform("b", lambda r: r["y"]), F.transform("b", lambda r: r["y1"]))))
    slabs = grouped.withColumn("e", edges).withColumn("slabs", F.zip_with("e", F.slice("e", 2, F.size("e")), lambda a, z: F.struct(a.alias("a"), z.alias("z"))))
    side = (F.col("b")[0]["x"] - F.col("b")[0]["x"])  # a zero of the coordinates' type

    def wide(slab: Column) -> Column:
        inside = F.filter("b", lambda r: (r["y"] <= slab["a"]) & (r["y1"] >= slab["z"]))
        start = F.struct(F.col("b")[0]["x"].alias("at"), side.alias("sum"))
        step = lambda s, r: F.struct(F.greatest(s["at"], r["x1"]).alias("at"), (s["sum"] + F.greatest(side, r["x1"] - F.greatest(r["x"], s["at"]))).alias("sum"))
        return F.aggregate(inside, start, step, lambda s: s["sum"] * (slab["z"] - slab["a"]))

    parts = F.transform(F.filter("slabs", lambda s: s["z"].isNotNull()), wide)
    return slabs.select(*keys, F.aggregate(parts, side, lambda s, x: s + x).alias("area"))


def clipped(r: Column, by: Column) -> Column:
    """The common rectangle of two, null if there is none."""
    x0, y0 = F.greatest(r["x"], by["x"]), F.greatest(r["y"], by["y"])
    x1, y1 = F.least(r["x"] + r["w"], by["x"] + by["w"]), F.least(r["y"] + r["h"], by["y"] + by["h"])
    return F.when((x1 > x0) & (y1 > y0), F.struct(x0.alias("x"), y0.alias("y"), (x1 - x0).alias("w"), (y1 - y0).alias("h")))
