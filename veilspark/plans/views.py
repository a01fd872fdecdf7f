"""Queries of shown values, controls and generated text on pages, captures, origins and step requests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import capture, geometry, metrics, protocol
from ..sources import formats, pages
from .detection import read, spread
from .screens import _BOX_SQL, _boxes, _drained, _stream

QUERIES, ORACLE = {}, {}

# --- pages made of customers ----------------------------------------------------------------

_PAGE = """concat('<style>.k', c_custkey % 3, '::after{content:"mail u', c_custkey, '@b.com"}</style><dl><dt>Passenger name<dd>Zed ', c_custkey, '<dt>Seat<dd>12A</dl>',
'<table><tr><th>Segment</th><th>Account holder</th></tr><tr><td>', c_mktsegment, '</td><td>Zed ', c_custkey, '</td></tr></table><div><b>Mobile</b> <i>XXXX', c_custkey, '</i></div><hr><p class="k1">note</p>',
'<form><p><label for="o">One time code</label><input id="o" value="', c_custkey, '"></p><p><input name="notes" value="u', c_custkey, '@b.com"></p><p><select multiple><option>none</option><option>v', c_custkey, '@b.com</option></select></p>',
'<p><input placeholder="w', c_custkey, '@b.com"></p><p><input type="file"></p></form><iframe src="u"></iframe>')"""


def _made(spark: SparkSession, sf_dir: str, *only: str) -> DataFrame:
    return pages.scan(spread(read(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")).selectExpr("c_custkey AS page_id", f"{_PAGE} AS html"), only=only)


def label_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The term of a description and the header of a column; the first cell takes the row above as its label."""
    return pages.label_spans(_made(spark, sf_dir, "segments", "labelled"), "page_id").select("page_id", "start", "end", "pii_class", "score", "rule")


QUERIES["label_spans"] = label_spans
ORACLE["label_spans"] = """WITH c AS (SELECT c_custkey AS page_id, length('Zed ' || c_custkey) AS n, length(c_mktsegment) AS m FROM customer)
SELECT page_id, 15 AS start, (15 + n)::INT AS "end", 'PERSON' AS pii_class, 0.75::DOUBLE AS score, 'label.PERSON' AS rule FROM c
UNION ALL SELECT page_id, (48 + n)::INT, (48 + n + m)::INT, 'PERSON', 0.75, 'label.PERSON' FROM c
UNION ALL SELECT page_id, (15 + n + 1 + 4 + 1 + 3 + 1 + 7 + 1 + 14 + 1 + m + 1)::INT, (15 + n + 1 + 4 + 1 + 3 + 1 + 7 + 1 + 14 + 1 + m + 1 + n)::INT, 'PERSON', 0.75, 'label.PERSON' FROM c"""


def field_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.field_findings(_made(spark, sf_dir, "fields"), "page_id")


QUERIES["field_findings"] = field_findings
ORACLE["field_findings"] = """SELECT c_custkey AS page_id, o::INT AS ordinal, i::INT AS item, c AS pii_class, p || c_custkey || s AS value, k AS kind, f AS source, r AS rule
FROM customer, (VALUES (0, 0, 'OTP', '', '', 'solid', 'field', 'field.secret'), (1, 0, 'EMAIL', 'u', '@b.com', 'token', 'field', 'field.email'), (2, 1, 'EMAIL', 'v', '@b.com', 'token', 'field', 'option.email'), (3, 0, 'EMAIL', 'w', '@b.com', 'token', 'placeholder', 'placeholder.email')) AS t(o, i, c, p, s, k, f, r)"""


def generated_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.generated_findings(_made(spark, sf_dir, "generated"), "page_id")


QUERIES["generated_findings"] = generated_findings
ORACLE["generated_findings"] = "SELECT c_custkey AS page_id, 0 AS ordinal, 'EMAIL' AS pii_class, 'mail u' || c_custkey || '@b.com' AS value, 'solid' AS kind, 'pseudo.email' AS rule, false AS forged FROM customer WHERE c_custkey % 3 = 1"


def opaque_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.opaque_frames(_made(spark, sf_dir, "opaque"), "page_id")


QUERIES["opaque_frames"] = opaque_frames
ORACLE["opaque_frames"] = "SELECT c_custkey AS page_id, 'iframe' AS tag, 'u' AS source FROM customer"


def page_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the pages themselves, labelled values included, one row each."""
    scanned = pages.scan(spread(read(spark, sf_dir, "pages").select("page_id", "html")), only=("text", "segments", "labelled"))
    return pages.page_spans(scanned, "page_id").select("page_id", F.posexplode_outer("spans").alias("ordinal", "s")).where("s IS NOT NULL").select("page_id", "ordinal", "s.start", "s.end", "s.pii_class", "s.rule")


QUERIES["page_spans"] = page_spans

# --- captures -------------------------------------------------------------------------------


def capture_waits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as capture requests of users, five minutes apart at least."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at"))
    return capture.spaced(e, "user_id", "at", "event_id", 300_000_000).select("event_id", "wait")


QUERIES["capture_waits"] = capture_waits
ORACLE["capture_waits"] = """WITH RECURSIVE e AS (SELECT event_id, user_id, epoch_us(ts) AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events
), s AS (SELECT event_id, user_id, i, t, t AS start FROM e WHERE i = 1 UNION ALL SELECT e.event_id, e.user_id, e.i, e.t, greatest(e.t, s.start + 300000000) FROM s JOIN e ON e.user_id = s.user_id AND e.i = s.i + 1)
SELECT event_id, start - t AS wait FROM s"""


def capture_waits_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _stream(spark, sf_dir, "events").select(F.col("event_type").alias("key"), F.unix_micros(F.col("ts").cast("timestamp")).alias("at"), F.col("event_id").alias("seq"))
    return _drained(capture.spaced_stream(e, 300_000_000), "append")


QUERIES["capture_waits_stream"] = capture_waits_stream
ORACLE["capture_waits_stream"] = """WITH RECURSIVE e AS (SELECT event_id, event_type, epoch_us(ts) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events
), s AS (SELECT event_id, event_type, i, t, t AS start FROM e WHERE i = 1 UNION ALL SELECT e.event_id, e.event_type, e.i, e.t, greatest(e.t, s.start + 300000000) FROM s JOIN e ON e.event_type = s.event_type AND e.i = s.i + 1)
SELECT event_type AS key, event_id AS seq, start - t AS wait FROM s"""


def capture_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as attempts: a probe that grows by up to 1.6 pixels, a tab that is in front nine times in ten."""
    view = lambda grown: F.struct(
        F.lit("u").alias("url"), F.lit(0).alias("scroll_x"), F.lit(0).alias("scroll_y"), F.array(geometry.rect(F.lit(0.0), F.lit(0.0), F.lit(9.0) + grown, F.lit(9.0))).alias("probe"),
        F.array(F.struct(F.lit("v").alias("value"), F.lit("PAN").alias("pii_class"), F.array(geometry.rect(*[F.lit(1.0)] * 4)).alias("rects"))).alias("findings"), F.array().alias("media"), F.array().alias("canvas"),
    )
    a = read(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("step"), (F.col("l_linenumber") - 1).alias("attempt"), view(F.lit(0.0)).alias("a"), view(F.col("l_partkey") % 3 * 0.8).alias("b"), (F.col("l_suppkey") % 10 != 0).alias("front"))
    return capture.outcomes(a, ["step"], capture.stable(F.col("a"), F.col("b")), F.col("front"))


QUERIES["capture_outcomes"] = capture_outcomes
ORACLE["capture_outcomes"] = """WITH a AS (SELECT l_orderkey AS step, l_linenumber - 1 AS n, l_suppkey % 10 <> 0 AS front, l_partkey % 3 < 2 AS steady FROM lineitem
), d AS (SELECT step, min(n) FILTER (n < 4 AND (steady OR NOT front)) AS attempt, count(*) FILTER (n < 4) AS tried FROM a GROUP BY step)
SELECT d.step, d.attempt, CASE WHEN d.attempt IS NULL THEN 'kept moving' WHEN bool_and(a.front) THEN 'captured' ELSE 'not in front' END AS outcome, (75 * coalesce(d.attempt, d.tried) * (coalesce(d.attempt, d.tried) + 1))::BIGINT AS pause_ms
FROM d LEFT JOIN a ON a.step = d.step AND a.n = d.attempt GROUP BY d.step, d.attempt, d.tried"""

# --- server ---------------------------------------------------------------------------------

_ORIGIN = """CASE k % 8 WHEN 0 THEN 'http://localhost:' || k WHEN 1 THEN 'http://127.0.0.1' WHEN 2 THEN 'https://localhost' WHEN 3 THEN 'chrome-extension://' || repeat(chr(97 + CAST(k % 26 AS INT)), 32)
WHEN 4 THEN 'http://localhost:' || (k * 1000) WHEN 5 THEN 'https://a.test' WHEN 6 THEN 'http://localhost, x' END"""


def allowed_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = read(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS bigint) AS k").selectExpr("k", f"{_ORIGIN} AS origin")
    return o.select("k", protocol.allowed_origin(F.col("origin"), ("https://a.test",)).alias("allowed"))


QUERIES["allowed_origins"] = allowed_origins
ORACLE["allowed_origins"] = f"""SELECT k, CASE k % 8 WHEN 0 THEN CASE WHEN k BETWEEN 1 AND 65535 THEN o END WHEN 1 THEN o WHEN 3 THEN CASE WHEN k % 26 < 16 THEN o END WHEN 4 THEN CASE WHEN k * 1000 BETWEEN 1 AND 65535 THEN o END WHEN 5 THEN o END AS allowed
FROM (SELECT k, {_ORIGIN} AS o FROM (SELECT o_orderkey::BIGINT AS k FROM orders))"""


def step_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as step requests, some broken in one way or another."""
    k = F.col("c_custkey")
    body = F.to_json(F.struct(
        F.col("c_name").alias("task_id"), F.when(k % 7 != 0, "go").otherwise("").alias("instruction"), F.array(F.struct(F.when(k % 5 != 0, "[PAN_1]").otherwise("PAN_1").alias("token"), F.lit("PAN").alias("cls"))).alias("legend"),
        F.struct((k % 4 * 4000).alias("width"), F.lit(800).alias("height")).alias("viewport"), F.array_repeat(F.struct(F.lit("u").alias("url")), (k % 3).cast("int")).alias("observations"), F.array_repeat(F.lit("t"), 1).alias("assistant_turns"),
    ))
    lines = read(spark, sf_dir, "customer").select("c_custkey", F.when(k % 11 != 0, body).otherwise("{broken").alias("value"))
    return formats.step_requests(lines).select("c_custkey", F.concat_ws(",", "faults").alias("faults"))


QUERIES["step_requests"] = step_requests
ORACLE["step_requests"] = """SELECT c_custkey, CASE WHEN c_custkey % 11 = 0 THEN 'json' ELSE concat_ws(',', CASE WHEN c_custkey % 7 = 0 THEN 'instruction' END, CASE WHEN c_custkey % 5 = 0 THEN 'legend' END,
CASE WHEN c_custkey % 4 IN (0, 3) THEN 'viewport' END, CASE WHEN c_custkey % 3 = 0 THEN 'observations' END, CASE WHEN c_custkey % 3 <> 2 THEN 'assistant_turns' END) END AS faults FROM customer"""

# --- scores ---------------------------------------------------------------------------------


def class_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Odd line items as true values, even ones as detections."""
    b = _boxes(spark, sf_dir).withColumn("rect", geometry.rect(F.col("x"), F.col("y"), F.col("w"), F.col("h")))
    truth = b.where("ordinal % 2 = 1").withColumn("pii_class", F.expr("CASE ordinal WHEN 1 THEN 'AADHAAR_VID' WHEN 3 THEN 'FACE' WHEN 5 THEN 'OPAQUE' ELSE 'PAN' END"))
    found = b.where("ordinal % 2 = 0").withColumn("pii_class", F.expr("CASE ordinal WHEN 2 THEN 'CARD' WHEN 4 THEN 'PAN' ELSE 'EMAIL' END"))
    return metrics.class_hits(truth, found, "page", "ordinal").groupBy("pii_class").agg(F.count(F.lit(1)).alias("n"), F.count_if("class_ok").alias("n_ok"))


QUERIES["class_hits"] = class_hits
ORACLE["class_hits"] = f"""WITH b AS ({_BOX_SQL}), m AS (
  SELECT t.page, t.ordinal, min(i.ordinal) AS o FROM b AS t LEFT JOIN b AS i ON i.page = t.page AND i.ordinal % 2 = 0
    AND greatest(0, least(t.x + t.w, i.x + i.w) - greatest(t.x, i.x)) * greatest(0, least(t.y + t.h, i.y + i.h) - greatest(t.y, i.y)) / (t.w * t.h) > 0.3::DOUBLE
  WHERE t.ordinal % 2 = 1 GROUP BY t.page, t.ordinal)
SELECT CASE ordinal WHEN 1 THEN 'AADHAAR_VID' WHEN 3 THEN 'FACE' WHEN 5 THEN 'OPAQUE' ELSE 'PAN' END AS pii_class, count(*) AS n,
  count_if(o IS NOT NULL AND CASE ordinal WHEN 1 THEN o = 2 WHEN 3 THEN true WHEN 5 THEN true ELSE o = 4 END)::BIGINT AS n_ok FROM m GROUP BY 1"""


def item_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as items with a rectangle per line; modes by return flag."""
    rows = read(spark, sf_dir, "lineitem").selectExpr("l_returnflag AS mode", "l_suppkey % 50 AS page", "l_orderkey AS item", "CAST(l_partkey % 11 / 10.0 AS double) AS coverage")
    return metrics.mode_means(metrics.item_scores(rows, ["mode", "page"], "item"), "mode")


QUERIES["item_scores"] = item_scores
ORACLE["item_scores"] = """WITH i AS (SELECT l_returnflag AS mode, l_suppkey % 50 AS page, l_orderkey AS item, max(l_partkey % 11 / 10.0::DOUBLE) AS c FROM lineitem GROUP BY ALL
), p AS (SELECT mode, page, avg((c >= 0.9)::INT) AS r FROM i GROUP BY ALL) SELECT mode, count(*) AS pages, round(avg(r), 3) AS mean FROM p GROUP BY mode"""


def step_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = read(spark, sf_dir, "lineitem").selectExpr("l_orderkey AS step", "CASE WHEN l_linenumber % 3 = 0 THEN 'solid' ELSE 'token' END AS kind", "l_returnflag AS pii_class")
    return metrics.step_summary(items, "step")


QUERIES["step_summary"] = step_summary
ORACLE["step_summary"] = "SELECT l_orderkey AS step, count_if(l_linenumber % 3 <> 0)::BIGINT AS tokens, count_if(l_linenumber % 3 = 0)::BIGINT AS solids, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS classes FROM lineitem GROUP BY l_orderkey"


def scripted_replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as requests whose page has two open fields, a filled one and a button."""
    k = read(spark, sf_dir, "orders").selectExpr("CAST(o_orderkey AS bigint) AS k")
    note = F.concat(F.lit("Slots: field PAN empty 100,400; field EMAIL empty "), F.col("k") % 1440, F.lit(",200; field PHONE filled 5,5; button SUBMIT empty 720,450."))
    legend = F.array(*[F.struct(F.lit(t).alias("token"), F.lit(c).alias("pii_class")) for t, c in (("[EMAIL_1]", "EMAIL"), ("[EMAIL_2]", "EMAIL"), ("[PHONE_1]", "PHONE"))])
    got = protocol.scripted_steps(protocol.parse_slots(note), legend, F.col("k") % 2 == 0, F.lit(1440.0), F.lit(900.0))
    reply = k.select("k", protocol.scripted_reply(got, (F.col("k") % 5).cast("int")).alias("r"))
    return reply.select("k", "r.action", "r.x", "r.y", "r.text")


QUERIES["scripted_replies"] = scripted_replies
ORACLE["scripted_replies"] = """WITH o AS (SELECT o_orderkey::BIGINT AS k, least(o_orderkey % 5, CASE WHEN o_orderkey % 2 = 0 THEN 3 ELSE 2 END) AS n FROM orders
), s AS (SELECT k, CASE n WHEN 0 THEN 'c' WHEN 1 THEN 't' WHEN 2 THEN CASE WHEN k % 2 = 0 THEN 'b' ELSE 'e' END ELSE 'e' END AS s FROM o)
SELECT k, CASE s WHEN 't' THEN 'type' WHEN 'e' THEN 'terminate' ELSE 'left_click' END AS action, CASE WHEN s IN ('c', 't') THEN round_even((k % 1440) / 1440.0::DOUBLE * 1000, 0) WHEN s = 'b' THEN 500 END::INT AS x, CASE WHEN s IN ('c', 't') THEN 222 WHEN s = 'b' THEN 500 END::INT AS y, CASE s WHEN 't' THEN '[EMAIL_1]' END AS text FROM s"""
