"""Queries of pages, rectangles, metrics, and streams."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import checks
from ..functions.tables import new_path
from ..operators import geometry, metrics, protocol, vision
from ..sources import pages, synth
from ..streaming import ordered, steps
from .detection import read, spread

QUERIES, ORACLE = {}, {}


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    scanned = pages.scan(spread(read(spark, sf_dir, "pages").select("page_id", "html")), only=("text", "segments"))
    return scanned.select("page_id", F.length("text").alias("n_chars"), F.size("segments").alias("n_segments"), F.md5("text").alias("digest"))


def html_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A form added to every page: its controls come back with classes."""
    form = '<form><label for="e">Email id</label><input id="e" type="text"><input type="password" value="x"><textarea placeholder="Street address"></textarea><button>Send</button></form>'
    src = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit(form), F.coalesce("html", F.lit(""))).alias("html"))
    return pages.field_rows(pages.scan(spread(src), only=("fields",)), "page_id").select("page_id", "ordinal", "pii_class", "source", "empty")


QUERIES["html_text"] = html_text
QUERIES["html_fields"] = html_fields
ORACLE["html_fields"] = "SELECT page_id, i AS ordinal, c AS pii_class, s AS source, e AS empty FROM pages, LATERAL (VALUES (0, 'EMAIL', 'keyword', true), (1, 'PASSWORD', 'type', false), (2, 'ADDRESS', 'keyword', true)) AS t(i, c, s, e)"


def submit_buttons(spark: SparkSession, sf_dir: str) -> DataFrame:
    src = read(spark, sf_dir, "pages").select("page_id", F.concat(F.lit('<button aria-label="Save draft">x</button><button>Next</button>'), F.coalesce("html", F.lit(""))).alias("html"))
    return pages.submit_buttons(pages.scan(spread(src), only=("buttons",)), "page_id")


QUERIES["submit_buttons"] = submit_buttons
ORACLE["submit_buttons"] = "SELECT page_id, 'Save draft' AS name FROM pages"


def locate_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans over segments of ten characters: an interval join by page."""
    k = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page_id"))
    seg = k.select("page_id", F.explode(F.sequence(F.lit(0), F.lit(4))).alias("segment")).select("page_id", "segment", (F.col("segment") * 10).alias("start"), F.lit(10).alias("length"))
    span = k.select("page_id", F.lit(0).alias("ordinal"), (F.col("page_id") % 10).cast("int").alias("start"), (F.col("page_id") % 10 + 12).cast("int").alias("end"))
    return pages.locate_spans(span, seg, "page_id")


QUERIES["locate_spans"] = locate_spans
ORACLE["locate_spans"] = """SELECT page_id, 0 AS ordinal, segment, (greatest(s, segment * 10) - segment * 10)::INT AS "from", (least(s + 12, segment * 10 + 10) - segment * 10)::INT AS "to"
FROM (SELECT o_orderkey AS page_id, o_orderkey % 10 AS s, unnest(range(0, 5))::INT AS segment FROM orders) WHERE segment * 10 < s + 12 AND segment * 10 + 10 > s"""

# --- rectangles from line items ----------------------------------------------------------------

_BOX = ("l_orderkey AS page", "l_linenumber AS ordinal", "CAST(l_partkey % 400 AS double) AS x", "CAST(l_suppkey % 300 AS double) AS y", "CAST(20 + l_partkey % 90 AS double) AS w", "CAST(10 + l_suppkey % 60 AS double) AS h")
_BOX_SQL = "SELECT l_orderkey AS page, l_linenumber AS ordinal, (l_partkey % 400)::DOUBLE AS x, (l_suppkey % 300)::DOUBLE AS y, (20 + l_partkey % 90)::DOUBLE AS w, (10 + l_suppkey % 60)::DOUBLE AS h, l_quantity::DOUBLE AS q FROM lineitem"


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "lineitem").selectExpr(*_BOX, "CAST(l_quantity AS double) AS q")


_R = lambda: geometry.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h"))


def rect_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = _boxes(spark, sf_dir).select("page", "ordinal", _R().alias("rect"), F.expr("CASE WHEN ordinal % 2 = 0 THEN 'solid' ELSE 'token' END").alias("kind"), F.expr("CASE WHEN ordinal % 2 = 0 THEN NULL ELSE '[EMAIL_1]' END").alias("label"))
    out = geometry.plan(items, "page", F.lit(1.0), F.lit(420), F.lit(320))
    return out.groupBy("page").agg(F.count(F.lit(1)).alias("n_ops"), F.sum(F.col("w") * F.col("h")).alias("area"), F.coalesce(F.min(F.when(F.col("kind") == "solid", F.col("op"))), F.lit(-1)).alias("first_solid"))


QUERIES["rect_plan"] = rect_plan
ORACLE["rect_plan"] = f"""WITH b AS (SELECT page, ordinal, ordinal % 2 = 1 AS tok, x - 2 AS x, y - 2 AS y, w + 4 AS w, h + 4 AS h FROM ({_BOX_SQL})
), f AS (SELECT *, CASE WHEN tok THEN greatest(11.0, least(h * 0.72, w / (9 * 0.62), 28.0)) END AS font FROM b
), n AS (SELECT *, greatest(w, coalesce(9 * 0.62 * font + 4, 0)) AS nw, greatest(h, coalesce(font / 0.72, 0)) AS nh FROM f
), g AS (SELECT DISTINCT page, tok, greatest(0, floor(x - (nw - w) / 2)) AS x0, greatest(0, floor(y - (nh - h) / 2)) AS y0, least(420, ceil(x - (nw - w) / 2 + nw)) AS x1, least(320, ceil(y - (nh - h) / 2 + nh)) AS y1 FROM n)
SELECT page, count(*) AS n_ops, sum((x1 - x0) * (y1 - y0))::DOUBLE AS area, CASE WHEN count_if(NOT tok) > 0 THEN count_if(tok) ELSE -1 END::INT AS first_solid FROM g WHERE x1 > x0 AND y1 > y0 GROUP BY page"""
QUERIES["rect_union_area"] = lambda spark, sf_dir: geometry.covered_area(_boxes(spark, sf_dir).selectExpr("page", *[f"CAST({c} AS long) AS {c}" for c in "xywh"]), ["page"])
ORACLE["rect_union_area"] = f"""SELECT page, sum(greatest(0, x1 - greatest(x0, coalesce(b, x0))))::BIGINT AS area FROM (
  SELECT page, r, x0, x1, max(x1) OVER (PARTITION BY page, r ORDER BY x0, x1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM (
    SELECT page, unnest(range(y::BIGINT, (y + h)::BIGINT)) AS r, x::BIGINT AS x0, (x + w)::BIGINT AS x1 FROM ({_BOX_SQL}))) GROUP BY page"""


def on_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir)
    media = b.where("ordinal = 1").select("page", geometry.rect(F.col("x"), F.col("y"), F.col("w") * 3, F.col("h") * 3).alias("rect"))
    return geometry.on_media(b.where("ordinal > 1").select("page", "ordinal", _R().alias("rect")), media, "page").select("page", "ordinal")


QUERIES["on_media"] = on_media
ORACLE["on_media"] = f"""WITH b AS ({_BOX_SQL}) SELECT a.page, a.ordinal FROM b a WHERE a.ordinal > 1 AND EXISTS (SELECT 1 FROM b m WHERE a.page = m.page AND m.ordinal = 1
AND greatest(0, least(a.x + a.w, m.x + 3 * m.w) - greatest(a.x, m.x)) * greatest(0, least(a.y + a.h, m.y + 3 * m.h) - greatest(a.y, m.y)) / (a.w * a.h) >= 0.45)"""


def iou_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = _boxes(spark, sf_dir).select("page", "ordinal", _R().alias("r"))
    a = b.where("ordinal = 1").select("page", F.col("r").alias("a"))
    return b.where("ordinal > 1").join(a, "page").select("page", "ordinal", F.round(geometry.iou(F.col("r"), F.col("a")), 6).alias("iou"))


QUERIES["iou_pairs"] = iou_pairs
ORACLE["iou_pairs"] = f"""WITH b AS ({_BOX_SQL}), i AS (SELECT b.page, b.ordinal, b.w * b.h + a.w * a.h AS s, greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x)) * greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y)) AS v FROM b JOIN b a ON a.page = b.page AND a.ordinal = 1 AND b.ordinal > 1)
SELECT page, ordinal, round(v / (s - v), 6) AS iou FROM i"""


def nms_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as boxes in ten columns per order: within a column only the best score stays."""
    b = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page", "l_linenumber AS ordinal", "CAST(l_linenumber % 2 * 100 AS double) AS x", "0.0D AS y", "50.0D AS w", "20.0D AS h", "CAST(l_quantity AS double) AS score")
    return geometry.nms(b, ["page"]).select("page", "ordinal")


QUERIES["nms_boxes"] = nms_boxes
ORACLE["nms_boxes"] = "SELECT l_orderkey AS page, l_linenumber AS ordinal FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber % 2 ORDER BY l_quantity DESC, l_linenumber) = 1"


def iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each order's boxes against a truth box equal to the first: the best-scored box at it is the hit."""
    b = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page", "l_linenumber AS ordinal", "CAST(l_linenumber % 2 * 100 AS double) AS x", "0.0D AS y", "50.0D AS w", "20.0D AS h", "CAST(l_quantity AS double) AS score")
    truth = b.where("ordinal = 1").select("page", "x", "y", "w", "h").distinct()
    return geometry.match(b, truth, ["page"]).groupBy("page").agg(F.count_if("hit").alias("tp"), F.count_if(~F.col("hit")).alias("fp"))


QUERIES["iou_match"] = iou_match
ORACLE["iou_match"] = "SELECT l_orderkey AS page, max((l_linenumber = 1)::BIGINT) AS tp, (count(*) - max((l_linenumber = 1)::BIGINT))::BIGINT AS fp FROM lineitem GROUP BY l_orderkey"


def frames_stable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangles before and after: moved by 0, 1 or 2 pixels."""
    o = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"))
    one = lambda d: F.array(geometry.rect(F.lit(1), F.lit(2), F.lit(3), F.lit(4)), geometry.rect(F.lit(5) + d, F.lit(6), F.lit(7), F.lit(8)))
    point = geometry.map_to_viewport(F.col("k") % 1000, F.lit(10), F.lit(800), F.lit(600), F.lit(1600), F.lit(900))
    return o.select("k", geometry.rects_stable(one(F.lit(0)), one(F.col("k") % 3)).alias("stable"), point["x"].alias("x"), point["y"].alias("y"))


QUERIES["rects_stable"] = frames_stable
ORACLE["rects_stable"] = "SELECT o_orderkey AS k, o_orderkey % 3 <= 1 AS stable, CASE WHEN o_orderkey % 1000 < 800 THEN (o_orderkey % 1000) * 2.0 END::DOUBLE AS x, CASE WHEN o_orderkey % 1000 < 800 THEN 15.0 END::DOUBLE AS y FROM orders"

# --- metrics --------------------------------------------------------------------------------------


def metrics_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as annotated values: modes by return flag, templates by line status."""
    items = read(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag AS mode", "l_linestatus AS template", "CAST(l_linenumber % 10 / 9.0 + 0.2 AS double) AS coverage", "l_partkey % 3 > 0 AS class_ok", "CAST(l_partkey % 5 AS long) AS leak_px", "100L AS gt_px", "50L AS context_px", "CAST(l_suppkey % 7 AS long) AS context_hidden_px"
    )
    return metrics.tally(items)


QUERIES["metrics_rollup"] = metrics_rollup
ORACLE["metrics_rollup"] = """WITH i AS (SELECT l_returnflag AS mode, l_linestatus AS template, l_linenumber % 10 / 9.0 + 0.2 >= 0.9 AS cov, l_partkey % 3 > 0 AS ok, l_partkey % 5 AS leak, l_suppkey % 7 AS hid FROM lineitem)
SELECT mode, template, count(*) AS items, count_if(cov)::BIGINT AS covered, round(100.0::DOUBLE * count_if(cov) / count(*), 1) AS recall, round(100.0::DOUBLE * sum(leak) / (100 * count(*)), 1) AS leakage, round(100.0 - 100.0::DOUBLE * sum(hid) / (50 * count(*)), 1) AS context,
  round(coalesce(100.0::DOUBLE * count_if(ok) / nullif(count_if(cov), 0), 0), 1) AS class_accuracy FROM i GROUP BY GROUPING SETS ((mode), (mode, template))"""


def threshold_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = read(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS pii_class", "CAST(l_quantity / 50.0 AS double) AS score", "l_quantity > 12 AND l_partkey % 10 > 0 AS hit")
    return metrics.choose_threshold(scored, ["A", "R"])


QUERIES["threshold_choice"] = threshold_choice
ORACLE["threshold_choice"] = """WITH s AS (SELECT l_returnflag AS c, (l_quantity / 50.0)::DOUBLE AS score, l_quantity > 12 AND l_partkey % 10 > 0 AS hit FROM lineitem
), g AS (SELECT round(0.2 + 0.05 * i, 2)::DOUBLE AS t FROM range(0, 14) AS x(i)
), a AS (SELECT c, t, count_if(score >= t AND hit)::DOUBLE AS tp, count_if(score >= t AND NOT hit)::DOUBLE AS fp, count_if(hit)::DOUBLE AS n FROM s, g GROUP BY c, t
), m AS (SELECT c, t, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN n > 0 THEN tp / n ELSE 0 END AS r FROM a
), f AS (SELECT *, CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END AS f FROM m)
SELECT c AS pii_class, coalesce(CASE WHEN c IN ('A', 'R') THEN min(CASE WHEN r >= 0.95 AND p >= 0.7 THEN t END) ELSE max(CASE WHEN r >= 0.95 AND p >= 0.7 THEN t END) END, arg_max(t, [f, r, p, t])) AS threshold FROM f GROUP BY c"""

# --- metrics from rectangles ----------------------------------------------------------------------

_PX = ("l_orderkey AS page", "l_linenumber AS ordinal", "CAST(l_partkey % 12 AS long) AS x", "CAST(l_suppkey % 10 AS long) AS y", "CAST(2 + l_partkey % 7 AS long) AS w", "CAST(2 + l_suppkey % 5 AS long) AS h", "l_linenumber % 3 AS role")


def _pixel_report(spark: SparkSession, sf_dir: str, rows: str) -> DataFrame:
    """Line items as true values, masks and context of their order's page; masks are also the detections. One row per page group."""
    b = read(spark, sf_dir, "lineitem").selectExpr(*_PX).where(rows)
    truth, masks, context = [b.where(F.col("role") == k).select("page", "ordinal", "x", "y", "w", "h") for k in (1, 0, 2)]
    by = lambda df: df.withColumn("grp", F.col("page") % 10)
    items = metrics.item_coverage(truth, masks, "page", "ordinal")
    found = metrics.item_coverage(masks, truth, "page", "ordinal")
    pixels = metrics.page_pixels(truth, masks, context, "page")
    return metrics.report(by(items), by(pixels), by(found), ["grp"])


QUERIES["pixel_report"] = lambda spark, sf_dir: _pixel_report(spark, sf_dir, "true")
ORACLE["pixel_report"] = """WITH b AS (SELECT l_orderkey AS page, l_linenumber AS ordinal, l_partkey % 12 AS x, l_suppkey % 10 AS y, 2 + l_partkey % 7 AS w, 2 + l_suppkey % 5 AS h, l_linenumber % 3 AS role FROM lineitem
), p AS (SELECT page, ordinal, role, px, unnest(range(y, y + h)) AS py FROM (SELECT *, unnest(range(x, x + w)) AS px FROM b)
), d AS (SELECT page, px, py, bool_or(role = 1) AS t, bool_or(role = 0) AS m, bool_or(role = 2) AS c FROM p GROUP BY page, px, py
), i AS (SELECT page, ordinal, role, count(*) AS n, count_if(CASE role WHEN 1 THEN m ELSE t END) AS k FROM p JOIN d USING (page, px, py) WHERE role < 2 GROUP BY page, ordinal, role
), a AS (SELECT page % 10 AS grp, count(*) AS items, round(100.0::DOUBLE * count_if(k / n >= 0.9) / count(*), 1) AS recall, round(100.0::DOUBLE * (sum(n) - sum(k)) / sum(n), 2) AS leakage FROM i WHERE role = 1 GROUP BY 1
), e AS (SELECT page % 10 AS grp, round(100.0::DOUBLE * count_if(k / n >= 0.5) / count(*), 1) AS detection_precision FROM i WHERE role = 0 GROUP BY 1
), g AS (SELECT page % 10 AS grp, round(100.0::DOUBLE * count_if(m AND t) / count_if(m), 1) AS redaction_precision, round(100.0::DOUBLE * count_if(c AND NOT t AND NOT m) / count_if(c AND NOT t), 1) AS context_retained FROM d GROUP BY 1)
SELECT grp, items, recall, leakage, detection_precision, redaction_precision, context_retained FROM a JOIN e USING (grp) JOIN g USING (grp)"""

# Groups 0 to 2 have no masks, so no detections: their precision is null, their recall zero.
QUERIES["pixel_report_undetected"] = lambda spark, sf_dir: _pixel_report(spark, sf_dir, "role > 0 OR page % 10 > 2")
ORACLE["pixel_report_undetected"] = (
    ORACLE["pixel_report"].replace("l_linenumber % 3 AS role FROM lineitem", "l_linenumber % 3 AS role FROM lineitem WHERE l_linenumber % 3 > 0 OR l_orderkey % 10 > 2")
    .replace("count_if(m AND t) / count_if(m), 1)", "coalesce(count_if(m AND t) / nullif(count_if(m), 0), 0), 1)").replace("FROM a JOIN e USING (grp)", "FROM a LEFT JOIN e USING (grp)")
)

# --- streams, run to completion over stored tables ---------------------------------------------------


def _drained(df: DataFrame, mode: str) -> DataFrame:
    """Run a stream over what is stored; its batches are written to the shared folder and read again (of complete results the last batch)."""
    spark, path = df.sparkSession, new_path(df.sparkSession, "stream")

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}" if mode == "append" else f"{path}/result")

    query = df.writeStream.outputMode(mode).option("checkpointLocation", f"{path}-state").foreachBatch(put).trigger(availableNow=True).start()
    query.awaitTermination()
    try:
        return spark.read.schema(df.schema).parquet(path if mode == "append" else f"{path}/result").select(*df.columns)
    except AnalysisException:  # no batch at all
        return spark.createDataFrame([], df.schema)


def _stream(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.readStream.schema(read(spark, sf_dir, table).schema).option("pathGlobFilter", f"{table}.parquet" if _single(spark, sf_dir, table) else "*.parquet").parquet(sf_dir if _single(spark, sf_dir, table) else f"{sf_dir}/{table}.parquet")


def _single(spark: SparkSession, sf_dir: str, table: str) -> bool:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{table}.parquet")
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(path).isFile()


def step_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _drained(steps.counters(_stream(spark, sf_dir, "conversations")), "complete")


QUERIES["step_counters"] = step_counters
ORACLE["step_counters"] = """SELECT count(*) AS steps, count_if(regexp_matches(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\\.[A-Za-z0-9-]+)*\\.[A-Za-z]{2,}'))::BIGINT AS leaks_blocked FROM conversations"""


def event_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    # The stored times have no zone; the stream needs one, and it is dropped again.
    src = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = _drained(steps.windowed(src), "complete")
    return out.select(F.col("window_start").cast("timestamp_ntz").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


QUERIES["event_windows"] = event_windows
ORACLE["event_windows"] = "SELECT date_trunc('hour', ts) AS window_start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"


def vault_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User ids of events as values of a class, one vault per event type, numbered in order of event."""
    src = _stream(spark, sf_dir, "events").selectExpr("event_type AS vault_id", "'USERNAME' AS pii_class", "CAST(user_id AS string) AS canonical", "event_id AS seq")
    return _drained(steps.vault_stream(src), "append")


QUERIES["vault_stream"] = vault_stream
ORACLE["vault_stream"] = "SELECT event_type AS vault_id, 'USERNAME' AS pii_class, user_id::VARCHAR AS canonical, '[USERNAME_' || row_number() OVER (PARTITION BY event_type ORDER BY min(event_id)) || ']' AS token FROM events GROUP BY event_type, user_id"

#: Steps of a task, and the hours after which a task without a further step ends.
STEP_LIMIT, PATIENCE = 12, 48


def ordered_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as steps of their users' tasks: in order of time, with a limit and a timeout."""
    src = _stream(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    return _drained(ordered.ordered_steps(src, "user_id", "ts", "event_id", STEP_LIMIT, PATIENCE * 3_600_000), "append").withColumn("seq", F.coalesce("seq", F.lit(-1)))


QUERIES["ordered_steps"] = ordered_steps
ORACLE["ordered_steps"] = f"""WITH w AS (SELECT epoch_ms(max(ts)) - 600000 AS mark FROM events
), o AS (SELECT user_id::VARCHAR AS task, event_id AS seq, epoch_us(ts) AS us, mark FROM events, w WHERE epoch_us(ts) <= mark * 1000
), p AS (SELECT *, row_number() OVER (PARTITION BY task ORDER BY us, seq) AS n, us - lag(us) OVER (PARTITION BY task ORDER BY us, seq) > {PATIENCE} * 3600000000 AS gap FROM o
), e AS (SELECT task, coalesce(least(min(CASE WHEN gap THEN n END), {STEP_LIMIT + 1}), {STEP_LIMIT + 1}) AS stop_n, min(CASE WHEN gap THEN n END) AS silent, max(n) AS all_n, max(us) AS latest, max(mark) AS mark FROM p GROUP BY task)
SELECT task, n, seq, 'step' AS state FROM p JOIN e USING (task) WHERE n < stop_n
UNION ALL SELECT task, stop_n, CASE WHEN silent IS NULL OR silent > stop_n THEN seq ELSE -1 END, CASE WHEN silent IS NULL OR silent > stop_n THEN 'stopped' ELSE 'timed out' END FROM e JOIN p USING (task) WHERE p.n = e.stop_n
UNION ALL SELECT task, all_n + 1, -1, 'timed out' FROM e WHERE all_n < stop_n AND e.mark * 1000 - latest > {PATIENCE} * 3600000000"""

# --- vision rows, generators, messages ------------------------------------------------------------------


def vision_decode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as queries of a model with three classes."""
    q = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS page", "l_linenumber AS ordinal", "array(0.5D, 0.25D, CAST(l_partkey % 10 / 20.0 AS double), 0.2D) AS box", "array(CAST(l_suppkey % 5 AS double) - 2, CAST(l_partkey % 7 AS double) - 3, 0.5D) AS logits")
    got = vision.decode(F.col("box"), F.col("logits"), ["FACE", "TEXT", "QR"], {"TEXT": 0.8}, F.lit(1000.0), F.lit(800.0))
    padded = F.when(F.col("d.pii_class") == "FACE", vision.pad_face(F.col("d.rect"))).when(F.col("d.pii_class") == "QR", vision.pad_code(F.col("d.rect"))).otherwise(F.col("d.rect"))
    return q.select("page", "ordinal", got.alias("d")).where("d IS NOT NULL").select("page", "ordinal", "d.pii_class", F.round("d.score", 6).alias("score"), padded.alias("r")).groupBy("pii_class", "score").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("r.w"), 3).alias("w"), F.round(F.min("r.x"), 3).alias("x"))


QUERIES["vision_decode"] = vision_decode
ORACLE["vision_decode"] = """WITH q AS (SELECT l_partkey % 10 / 20.0::DOUBLE * 1000 AS w, (l_suppkey % 5 - 2)::DOUBLE AS a, (l_partkey % 7 - 3)::DOUBLE AS b, 0.5::DOUBLE AS c FROM lineitem
), k AS (SELECT w, CASE WHEN a >= b AND a >= c THEN 'FACE' WHEN b >= c THEN 'TEXT' ELSE 'QR' END AS cls, 1 / (1 + exp(-greatest(a, b, c))) AS score FROM q
), d AS (SELECT cls, round(score, 6) AS score, CASE cls WHEN 'FACE' THEN w * 1.5 WHEN 'QR' THEN w + 2 * greatest(w, 160) * 0.12 ELSE w END AS w, CASE cls WHEN 'FACE' THEN 500 - w / 2 - w * 0.25 WHEN 'QR' THEN 500 - w / 2 - greatest(w, 160) * 0.12 ELSE 500 - w / 2 END AS x FROM k WHERE score >= CASE cls WHEN 'TEXT' THEN 0.8 ELSE 0.5 END)
SELECT cls AS pii_class, score, count(*) AS n, round(sum(w), 3) AS w, round(min(x), 3) AS x FROM d GROUP BY cls, score"""


def redaction_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pages: a token over two rectangles, a canvas, a face off the media and text on it."""
    k = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("page"))
    box = lambda x, y, w, h: geometry.rect(F.lit(x), F.lit(y), F.lit(w), F.lit(h))
    findings = k.select("page", F.lit("[EMAIL_1]").alias("token"), F.lit("EMAIL").alias("pii_class"), F.array(box(0, 0, 9, 9), box(9, 0, 9, 9)).alias("rects"))
    areas = k.where("page % 2 = 0").select("page", F.lit("MEDIA").alias("pii_class"), box(50, 50, 10, 10).alias("rect"))
    media = k.where("page % 3 = 0").select("page", box(100, 100, 50, 50).alias("rect"))
    found = k.select("page", F.lit("FACE").alias("pii_class"), box(0, 60, 5, 5).alias("rect")).unionByName(k.select("page", F.lit("TEXT").alias("pii_class"), box(90, 100, 20, 20).alias("rect"))).unionByName(k.select("page", F.lit("BUTTON").alias("pii_class"), box(1, 1, 2, 2).alias("rect")))
    return vision.redaction_items(findings, areas, found, media, "page").groupBy("page", "kind", "pii_class").agg(F.count(F.lit(1)).alias("n"))


QUERIES["redaction_items"] = redaction_items
ORACLE["redaction_items"] = """SELECT page, kind, c AS pii_class, 1::BIGINT AS n FROM (SELECT o_orderkey AS page FROM orders), LATERAL (VALUES ('token', 'EMAIL', 1), ('solid', 'EMAIL', 1), ('solid', 'MEDIA', 2), ('solid', 'FACE', 1), ('solid', 'TEXT', 3)) AS t(kind, c, m) WHERE page % m = 0"""


def class_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS pii_class", "l_partkey % 4 > 0 AS hit")
    truth = read(spark, sf_dir, "lineitem").where("l_suppkey % 10 > 0").selectExpr("l_returnflag AS pii_class")
    got = vision.precision_recall(rows, truth)
    return got.select("pii_class", "tp", "fp", "n", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")])


QUERIES["class_scores"] = class_scores
ORACLE["class_scores"] = """WITH c AS (SELECT l_returnflag AS pii_class, count_if(l_partkey % 4 > 0)::BIGINT AS tp, count_if(l_partkey % 4 = 0)::BIGINT AS fp, count_if(l_suppkey % 10 > 0)::BIGINT AS n FROM lineitem GROUP BY l_returnflag)
SELECT pii_class, tp, fp, n, round(tp / (tp + fp), 6) AS precision, round(tp / n, 6) AS recall, round(2 * (tp / (tp + fp)) * (tp / n) / (tp / (tp + fp) + tp / n), 6) AS f1 FROM c"""


def generated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of the seeded generator."""
    k = read(spark, sf_dir, "orders").select(F.col("o_orderkey").cast("long").alias("k"))
    return k.select("k", F.round(synth.mulberry32(F.col("k"), F.lit(0).cast("long")), 9).alias("a"), F.round(synth.mulberry32(F.col("k"), F.lit(7).cast("long")), 9).alias("b"))


def _mulberry_sql(k: int) -> str:
    m = 1 << 32
    return f"""(SELECT round((xor(v, v >> 14))::DOUBLE / {m}, 9) FROM (SELECT xor(t, ((t + ((xor(t, t >> 7))::HUGEINT * (t | 61)::HUGEINT % {m})::BIGINT) % {m})) AS v FROM (SELECT ((xor(s, s >> 15))::HUGEINT * (s | 1)::HUGEINT % {m})::BIGINT AS t FROM (SELECT (k + {(k + 1) * 0x6D2B79F5}) % {m} AS s))))"""


QUERIES["generator_draws"] = generated
ORACLE["generator_draws"] = f"SELECT k, {_mulberry_sql(0)} AS a, {_mulberry_sql(7)} AS b FROM (SELECT o_orderkey::BIGINT AS k FROM orders)"


def generated_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every generated identifier is valid."""
    k = spread(read(spark, sf_dir, "customer").select(F.col("c_custkey").cast("long").alias("k")))
    f = lambda kind, check: synth.let(synth.fake(kind, F.col("k")), check)
    return k.select("k", f("AADHAAR", checks.aadhaar_valid).alias("aadhaar"), f("AADHAAR_VID", checks.verhoeff_valid).alias("vid"), f("CARD", checks.luhn_valid).alias("card"), f("PAN", checks.pan_valid).alias("pan"), f("GSTIN", checks.gstin_valid).alias("gstin"), f("PHONE", lambda c: c.rlike("^[6-9][0-9]{9}$")).alias("phone"), f("IFSC", lambda c: c.rlike("^[A-Z]{4}0[A-Z0-9]{6}$")).alias("ifsc"), f("PINCODE", lambda c: c.rlike("^[1-9][0-9]{5}$")).alias("pincode"))


QUERIES["generated_ids"] = generated_ids
ORACLE["generated_ids"] = "SELECT c_custkey AS k, true AS aadhaar, true AS vid, true AS card, true AS pan, true AS gstin, true AS phone, true AS ifsc, true AS pincode FROM customer"


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as trajectories: user turns have images, others a note."""
    t = read(spark, sf_dir, "conversations").where("text IS NOT NULL").select("conv_id", "turn", F.lit("task").alias("instruction"), F.lit("").alias("url"), F.when(F.col("role") != "user", F.col("text")).alias("text_observation"), F.lit(None).cast("string").alias("user_response"), (F.col("role") == "user").alias("has_image"))
    out = protocol.observation_texts(t, "conv_id", "turn")
    return out.select("conv_id", "turn", F.length("text").alias("length"), "image")


QUERIES["observation_texts"] = messages
ORACLE["observation_texts"] = """WITH t AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1 AS first, role = 'user' AND sum((role = 'user')::INT) OVER (PARTITION BY conv_id ORDER BY turn DESC) <= 3 AS image FROM conversations WHERE text IS NOT NULL
), m AS (SELECT conv_id, turn, image, CASE WHEN first THEN 4 WHEN role <> 'user' AND length(text) > 0 THEN CASE WHEN length(text) <= 1000 THEN length(text) ELSE 1000 + length(chr(10) || '... [truncated ' || (length(text) - 1000)::VARCHAR || ' chars] ...' || chr(10)) END WHEN image THEN 28 END AS l FROM t)
SELECT conv_id, turn, l::INT AS length, image FROM m WHERE l IS NOT NULL"""
