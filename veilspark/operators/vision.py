"""Detections of a vision model as rows: decoding, padding, redaction items, scores.

The model itself is an input: its raw boxes and logits are columns.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .geometry import ON_MEDIA, overlap_share, rect
from .metrics import item_coverage

# Classes masked wherever found, those masked only on media, and default thresholds and margins.
ALWAYS_MASKED = ("FACE", "QR", "BARCODE", "ID_DOCUMENT", "SIGNATURE", "TEXT")
ONLY_ON_MEDIA = ("TEXT", "ID_DOCUMENT")
THRESHOLD, CODE_MARGIN = 0.5, 0.12
FACE_MARGINS = (0.25, 0.35, 1.5, 1.6)


def decode(box: Column, logits: Column, classes: list[str], thresholds: dict[str, float], width: Column, height: Column) -> Column:
    """``struct<pii_class, score, rect>`` of one query (centre box in shares of the frame), null below its class's threshold."""
    best = F.array_max(F.transform(logits, lambda v, i: F.struct(v.alias("v"), (-i).alias("i"))))
    name = F.get(F.array(*map(F.lit, classes)), -best["i"])
    score = 1 / (1 + F.exp(-best["v"]))
    least = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in thresholds.items() for x in kv]), name), F.lit(THRESHOLD)) if thresholds else F.lit(THRESHOLD)
    cx, cy, w, h = (F.get(box, i) for i in range(4))
    area = rect((cx - w / 2) * width, (cy - h / 2) * height, w * width, h * height)
    return F.when(name.isNotNull() & (name != "") & (score >= least), F.struct(name.alias("pii_class"), score.alias("score"), area.alias("rect")))


def decode_with(meta: dict, box: Column, logits: Column, width: Column, height: Column) -> Column:
    """:func:`decode` with the classes and thresholds of a model's metadata (see :func:`veilspark.sources.formats.read_model_meta`)."""
    return decode(box, logits, [c or "" for c in meta["classes"]], meta["thresholds"], width, height)


def pad_face(r: Column) -> Column:
    """Hair and ears too."""
    left, top, wide, high = FACE_MARGINS
    return rect(r["x"] - r["w"] * left, r["y"] - r["h"] * top, r["w"] * wide, r["h"] * high)


def pad_code(r: Column) -> Column:
    """The quiet zone of a code too."""
    m = F.greatest(r["w"], r["h"]) * CODE_MARGIN
    return rect(r["x"] - m, r["y"] - m, r["w"] + 2 * m, r["h"] + 2 * m)


def redaction_items(findings: DataFrame, areas: DataFrame, detections: DataFrame, media: DataFrame, key: str, strict: bool = False, face_model: bool = True) -> DataFrame:
    """(key, kind, label, pii_class, rect): what must be masked on each page.

    ``findings``: key, token (null: solid), pii_class, rects; ``areas``: key,
    pii_class, rect of canvases, opaque frames and forged tokens; ``detections``:
    key, pii_class, rect; ``media``: key, rect.
    """
    each = findings.select(key, "token", "pii_class", F.posexplode("rects").alias("i", "rect"))
    first = F.col("token").isNotNull() & (F.col("i") == 0)
    found = each.select(key, F.when(first, "token").otherwise("solid").alias("kind"), F.when(first, F.col("token")).alias("label"), "pii_class", "rect")
    solid = lambda df, cls: df.select(key, F.lit("solid").alias("kind"), F.lit(None).cast("string").alias("label"), cls.alias("pii_class"), "rect")
    pages = media.select(F.col(key).alias("_page"), F.col("rect").alias("_media"))
    near = (F.col(key) == F.col("_page")) & (overlap_share(F.col("rect"), F.col("_media")) >= ON_MEDIA)
    masked = detections.where(F.col("pii_class").isin(*ALWAYS_MASKED))
    free = masked.where(~F.col("pii_class").isin(*ONLY_ON_MEDIA))
    held = masked.where(F.col("pii_class").isin(*ONLY_ON_MEDIA)).join(pages, near, "left_semi")
    cls = F.when(F.col("pii_class") == "BARCODE", "QR").otherwise(F.col("pii_class"))
    out = found.unionByName(solid(areas, F.col("pii_class"))).unionByName(solid(free.unionByName(held), cls))
    return out.unionByName(solid(media, F.lit("MEDIA"))) if strict or not face_model else out


def uncovered(items: DataFrame, ops: DataFrame, key: str) -> DataFrame:
    """Items (key, rect) that the page's drawn operations (key, x, y, w, h) together do not cover whole: the frame is then refused."""
    numbered = items.withColumn("_item", F.monotonically_increasing_id())
    boxes = numbered.select(F.col(key), "_item", "rect.*")
    kept = item_coverage(boxes, ops, key, "_item").where("masked_px < px").select(F.col("_item"))
    return numbered.join(kept, "_item", "left_semi").select(*items.columns)


def precision_recall(matched: DataFrame, truth: DataFrame) -> DataFrame:
    """Per class precision, recall and F1 from hits (pii_class, hit) and truth rows (pii_class)."""
    got = matched.groupBy("pii_class").agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fp"))
    n = truth.groupBy("pii_class").agg(F.count(F.lit(1)).alias("n"))
    both = got.join(n, "pii_class", "full").na.fill(0, ["tp", "fp", "n"])
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", "n"), F.lit(0.0))
    both = both.withColumn("precision", p).withColumn("recall", r)
    return both.withColumn("f1", F.coalesce(F.try_divide(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")), F.lit(0.0)))
