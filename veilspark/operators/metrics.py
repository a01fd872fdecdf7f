"""Roll-ups of recall, leakage, precision and retained context; quantiles; thresholds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import running

from .geometry import clipped, covered_area, overlap_share

COVERED, ON_TRUTH = 0.9, 0.5
# Grid of thresholds and the floors of recall and precision.
GRID = tuple(round(0.2 + 0.05 * i, 2) for i in range(14))
# Classes a detection may have for a true class (none listed: any), and classes that any detection satisfies.
SAME_AS, ANY, OVERLAP = {"AADHAAR_VID": ("AADHAAR_VID", "AADHAAR", "CARD")}, ("OPAQUE", "FACE", "QR"), 0.3
LEAST_RECALL, LEAST_PRECISION = 0.95, 0.70


def percent(part: Column, whole: Column) -> Column:
    return F.coalesce(100.0 * F.try_divide(part, whole), F.lit(0.0))


def quantiles(rows: DataFrame, keys: list[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key, for each name its share p: the entry at index floor(p * n) of the sorted values, at most the last; and the ``peak``.

    Values are counted first (combined before the shuffle), then the distinct ones are sorted into ranges
    whose counts are carried on, so a key with very many values is not ordered in one task. Nulls do not count.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    before = running(counts, keys, [value], F.col("_n"), "_before", "sum")
    totals = before.groupBy(*keys).agg(F.sum("_n").alias("_all")).select(*[F.col(k).alias(f"_t{i}") for i, k in enumerate(keys)], "_all")
    on = F.lit(True)
    for i, k in enumerate(keys):
        on &= F.col(k).eqNullSafe(F.col(f"_t{i}"))
    placed = before.join(totals, on).withColumn("_upto", F.col("_before") + F.col("_n"))
    at = lambda p: F.least(F.floor(F.lit(p) * F.col("_all")), F.col("_all") - 1)
    picked = [F.min(F.when(F.col("_upto") > at(p), F.col(value))).alias(name) for name, p in shares.items()]
    return placed.groupBy(*keys).agg(*picked, F.max(value).alias("peak"))


def tally(items: DataFrame, mode: str = "mode", template: str = "template") -> DataFrame:
    """Totals per mode and per (mode, template) in one pass.

    ``items``: mode, template, coverage (0 to 1), class_ok, leak_px, gt_px,
    context_px, context_hidden_px.
    """
    g = items.groupingSets([[mode], [mode, template]], mode, template)
    return g.agg(
        F.count(F.lit(1)).alias("items"),
        F.count_if(F.col("coverage") >= COVERED).alias("covered"),
        F.round(percent(F.count_if(F.col("coverage") >= COVERED), F.count(F.lit(1))), 1).alias("recall"),
        F.round(percent(F.sum("leak_px"), F.sum("gt_px")), 1).alias("leakage"),
        F.round(100.0 - percent(F.sum("context_hidden_px"), F.sum("context_px")), 1).alias("context"),
        F.round(percent(F.count_if("class_ok"), F.count_if(F.col("coverage") >= COVERED)), 1).alias("class_accuracy"),
    )


def item_coverage(items: DataFrame, masks: DataFrame, page: str, item: str) -> DataFrame:
    """(page, item, px, masked_px, coverage): how much of an item's rectangles (a row each: page, item, x, y, w, h) the page's masks cover.

    Rectangles count one by one, as overlapping ones of an item are seen twice; within
    a rectangle overlapping masks count once. Pages meet by equality.
    """
    each = items.withColumn("_rect", F.monotonically_increasing_id())
    m = masks.select(F.col(page).alias("_page"), F.struct("x", "y", "w", "h").alias("_mask"))
    met = each.join(m, F.col(page) == F.col("_page")).withColumn("_both", clipped(F.struct("x", "y", "w", "h"), F.col("_mask"))).where("_both IS NOT NULL")
    hidden = covered_area(met.select(page, item, "_rect", "_both.*"), [page, item, "_rect"]).groupBy(page, item).agg(F.sum("area").alias("masked_px"))
    total = items.groupBy(page, item).agg(F.sum(F.col("w") * F.col("h")).alias("px"))
    out = total.join(hidden, [page, item], "left").withColumn("masked_px", F.coalesce("masked_px", F.lit(0)))
    return out.select(page, item, "px", "masked_px", F.coalesce(F.try_divide("masked_px", "px"), F.lit(0.0)).alias("coverage"))


def page_pixels(truth: DataFrame, masks: DataFrame, context: DataFrame, page: str) -> DataFrame:
    """Per page the pixels of true values, of masks and of both, of context (text around the true values), and of context left visible.

    Each input has a rectangle a row (page, x, y, w, h). All follow from the areas of
    five unions: of truth T, masks M, and T with M, with context C, and with both.
    """
    sets = {"T": ("t", "tm", "tc", "tmc"), "M": ("m", "tm", "tmc"), "C": ("tc", "tmc")}
    box = ["x", "y", "w", "h"]
    parts = [df.select(page, *box, F.explode(F.array(*map(F.lit, sets[k]))).alias("_set")) for k, df in (("T", truth), ("M", masks), ("C", context))]
    areas = covered_area(parts[0].unionByName(parts[1]).unionByName(parts[2]), [page, "_set"])
    of = lambda s: F.coalesce(F.max(F.when(F.col("_set") == s, F.col("area"))), F.lit(0))
    a = areas.groupBy(page).agg(*[of(s).alias(s) for s in ("t", "m", "tm", "tc", "tmc")])
    return a.select(
        page, F.col("t").alias("truth_px"), F.col("m").alias("mask_px"), (F.col("t") + F.col("m") - F.col("tm")).alias("mask_on_truth_px"),
        (F.col("tc") - F.col("t")).alias("context_px"), (F.col("tmc") - F.col("tm")).alias("context_kept_px"),
    )


def mask_scores(pages: DataFrame, by: list[str]) -> DataFrame:
    """Share of true pixels that masks cover, and of mask pixels on true values, from :func:`page_pixels`; 1 where there are none."""
    share = lambda part, whole: F.round(F.coalesce(F.try_divide(F.sum(part), F.sum(whole)), F.lit(1.0)), 6)
    return pages.groupBy(*by).agg(share("mask_on_truth_px", "truth_px").alias("coverage"), share("mask_on_truth_px", "mask_px").alias("mask_precision"))


def report(items: DataFrame, pages: DataFrame, detections: DataFrame, by: list[str]) -> DataFrame:
    """Recall, leakage, detection precision, redaction precision and retained context by columns that all three inputs have.

    ``items``: by, px, masked_px, coverage; ``pages``: by and the columns of
    :func:`page_pixels`; ``detections``: by, coverage (of the detection by true
    values). Without detections their precision is null.
    """
    i = items.groupBy(*by).agg(
        F.count(F.lit(1)).alias("items"), F.round(percent(F.count_if(F.col("coverage") >= COVERED), F.count(F.lit(1))), 1).alias("recall"),
        F.round(percent(F.sum("px") - F.sum("masked_px"), F.sum("px")), 2).alias("leakage"),
    )
    d = detections.groupBy(*by).agg(F.round(percent(F.count_if(F.col("coverage") >= ON_TRUTH), F.count(F.lit(1))), 1).alias("detection_precision"))
    p = pages.groupBy(*by).agg(F.round(percent(F.sum("mask_on_truth_px"), F.sum("mask_px")), 1).alias("redaction_precision"), F.round(percent(F.sum("context_kept_px"), F.sum("context_px")), 1).alias("context_retained"))
    return i.join(d, by, "left").join(p, by, "left").select(*by, "items", "recall", "leakage", "detection_precision", "redaction_precision", "context_retained")


def choose_threshold(scored: DataFrame, sensitive: list[str]) -> DataFrame:
    """Per class the threshold of the grid: among those with enough recall and precision
    the lowest (sensitive classes) or highest; else the one with the best F1.

    One histogram: each score counts at the number of thresholds that it reaches, and a threshold's hits
    are those of the counts above its place. Null scores reach none, null hits do not count.
    """
    reached = sum((F.when(F.col("score") >= t, 1).otherwise(0) for t in GRID[1:]), F.when(F.col("score") >= GRID[0], 1).otherwise(0))
    counts = scored.groupBy("pii_class", reached.alias("at")).agg(F.count_if("hit").alias("hits"), F.count_if(~F.col("hit")).alias("misses"))
    # At most one entry for each threshold, and one for none.
    each = counts.groupBy("pii_class").agg(F.collect_list(F.struct("at", "hits", "misses")).alias("bars"), F.sum("hits").alias("n"))
    above = lambda name, i: F.aggregate(F.filter("bars", lambda b: b["at"] > i), F.lit(0).cast("long"), lambda a, b: a + b[name])
    share = lambda part, whole: F.coalesce(F.try_divide(part, whole), F.lit(0.0))
    tally = F.transform(F.array(*map(F.lit, GRID)), lambda t, i: F.struct(t.alias("t"), above("hits", i).alias("tp"), above("misses", i).alias("fp")))
    rates = F.transform(tally, lambda x: F.struct(x["t"].alias("t"), share(x["tp"], x["tp"] + x["fp"]).alias("p"), share(x["tp"], F.col("n")).alias("r")))
    judged = F.transform(rates, lambda x: F.struct(share(2 * x["p"] * x["r"], x["p"] + x["r"]).alias("f"), x["r"].alias("r"), x["p"].alias("p"), x["t"].alias("t")))
    good = F.transform(F.filter("judged", lambda x: (x["r"] >= LEAST_RECALL) & (x["p"] >= LEAST_PRECISION)), lambda x: x["t"])
    chosen = F.when(F.col("pii_class").isin(*sensitive), F.array_min(good)).otherwise(F.array_max(good))
    return each.withColumn("judged", judged).select("pii_class", F.coalesce(chosen, F.array_max("judged")["t"]).alias("threshold"))


def class_hits(truth: DataFrame, items: DataFrame, page: str, value: str) -> DataFrame:
    """Per true value (page, value, pii_class): ``class_ok``, whether the first item on it has a class that counts.

    ``truth`` has a row per rectangle (page, value, pii_class, rect), ``items``
    (page, ordinal, pii_class, rect). An item lies on a value from 0.3 of one of its
    rectangles. Pages meet by equality; values that nothing overlaps stay, with false.
    """
    found = items.select(F.col(page).alias("_page"), F.struct(F.col("ordinal"), F.col("pii_class").alias("got")).alias("_item"), F.col("rect").alias("_rect"))
    on = (F.col(page) == F.col("_page")) & (overlap_share(F.col("rect"), F.col("_rect")) > OVERLAP)
    first = truth.join(found, on, "left").groupBy(page, value, "pii_class").agg(F.min("_item").alias("_item"))
    got, want = F.col("_item.got"), F.col("pii_class")
    same = F.lit(False)
    for cls, others in SAME_AS.items():
        same = same | ((want == cls) & got.isin(*others))
    ok = F.col("_item").isNotNull() & (want.isin(*ANY) | F.coalesce(got == want, F.lit(False)) | F.coalesce(same, F.lit(False)))
    return first.select(page, value, "pii_class", ok.alias("class_ok"))


def item_scores(items: DataFrame, key: list[str], item: str) -> DataFrame:
    """Per key the share of covered items and the mean coverage; an item counts by its best rectangle (a row each)."""
    best = items.groupBy(*key, item).agg(F.max("coverage").alias("coverage"))
    return best.groupBy(*key).agg(F.count(F.lit(1)).alias("items"), F.avg((F.col("coverage") >= COVERED).cast("int")).alias("recall"), F.avg("coverage").alias("coverage"))


def mode_means(scores: DataFrame, mode: str, value: str = "recall") -> DataFrame:
    """Mean over pages of a page's value, per mode."""
    return scores.groupBy(mode).agg(F.count(F.lit(1)).alias("pages"), F.round(F.avg(value), 3).alias("mean"))


def step_summary(items: DataFrame, key: str) -> DataFrame:
    """Per step what was drawn: tokens, solid masks, and the classes masked, in name order."""
    return items.groupBy(key).agg(F.count_if(F.col("kind") == "token").alias("tokens"), F.count_if(F.col("kind") == "solid").alias("solids"), F.concat_ws(",", F.array_sort(F.collect_set("pii_class"))).alias("classes"))


def report_lines(table: DataFrame) -> DataFrame:
    """A roll-up as lines of a Markdown table, the head first: ``line_no``, ``line``. Ordered by the table's columns."""
    cell = lambda c: F.coalesce(F.replace(F.col(f"`{c}`").cast("string"), F.lit("|"), F.lit("\\|")), F.lit(""))
    row = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(c) for c in table.columns]), F.lit(" |"))
    body = table.select(F.row_number().over(Window.orderBy(*[F.col(f"`{c}`") for c in table.columns])).alias("n"), row.alias("line")).select((F.col("n") + 2).alias("line_no"), "line")
    heads = ["| " + " | ".join(table.columns) + " |", "|" + "---|" * len(table.columns)]
    return table.sparkSession.createDataFrame(list(enumerate(heads, 1)), "line_no int, line string").unionByName(body)
