"""Queries of single operators over customers and line items, each with SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import new_path
from ..operators import metrics, native, policy, protocol, sanitize, spans, vault, vision
from ..operators.spans import SPAN
from ..sources import formats, pages
from .detection import read, spread
from .screens import _PX

QUERIES, ORACLE = {}, {}


def _customers(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read(spark, sf_dir, "customer").selectExpr("c_custkey AS k").selectExpr("k", *columns)


# --- texts -----------------------------------------------------------------------------


def normalized_digits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers in Devanagari digits and back."""
    rows = _customers(spark, sf_dir, "translate(CAST(k AS string), '0123456789', '०१२३४५६७८९') AS text")
    return rows.select("k", spans.normalize_digits(F.concat(F.lit("क्र "), "text", F.lit(" end"))).alias("text"))


QUERIES["normalized_digits"] = normalized_digits
ORACLE["normalized_digits"] = "SELECT c_custkey AS k, 'क्र ' || c_custkey || ' end' AS text FROM customer"

_TWO = "'mail u' || CAST(k AS string) || '@mail.example or call 98765' || lpad(CAST(k % 100000 AS string), 5, '0')"
_TWO_SQL = "SELECT c_custkey AS k, 'u' || c_custkey || '@mail.example' AS mail, '98765' || lpad((c_custkey % 100000)::VARCHAR, 5, '0') AS phone FROM customer"


def excluded_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without the class EMAIL only the phone number is found."""
    rows = spread(_customers(spark, sf_dir, f"{_TWO} AS text"))
    return native.spans_table(rows, ["k"], exclude=("EMAIL",)).select("k", "rule", "start", "value")


QUERIES["excluded_classes"] = excluded_classes
ORACLE["excluded_classes"] = f"SELECT k, 'phone.in' AS rule, (14 + length(mail))::INT AS start, phone AS value FROM ({_TWO_SQL})"


def extra_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stronger span from elsewhere over the first word and the address cuts the address out."""
    rows = spread(_customers(spark, sf_dir, f"{_TWO} AS text"))
    one = F.struct(F.lit(0).alias("start"), (F.instr("text", " or ") - 1).cast("int").alias("end"), F.lit("USERNAME").alias("pii_class"), F.lit(1.0).alias("score"), F.lit("given").alias("rule"), F.lit(50).alias("rule_idx"))
    found = native.with_spans(rows, name="s", extra=F.array(one).cast(f"array<{SPAN}>"))
    return found.select("k", F.posexplode_outer("s").alias("i", "s")).select("k", "i", "s.rule", "s.start", "s.end")


QUERIES["extra_spans"] = extra_spans
ORACLE["extra_spans"] = f"""SELECT k, 0 AS i, 'given' AS rule, 0 AS start, (5 + length(mail))::INT AS "end" FROM ({_TWO_SQL})
UNION ALL SELECT k, 1, 'phone.in', (14 + length(mail))::INT, (24 + length(mail))::INT FROM ({_TWO_SQL})"""


def contact_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A name line above a line that is an address."""
    rows = spread(_customers(spark, sf_dir, "'Contact us' || chr(10) || 'Tarun ' || chr(65 + CAST(k % 26 AS int)) || 'ebbar' || chr(10) || 'u' || CAST(k AS string) || '@mail.example' AS text"))
    return native.spans_table(rows, ["k"]).select("k", "ordinal", "rule", "start", "value")


QUERIES["contact_cards"] = contact_cards
ORACLE["contact_cards"] = """SELECT c_custkey AS k, 0 AS ordinal, 'person.contact_card' AS rule, 11 AS start, 'Tarun ' || chr((65 + c_custkey % 26)::INT) || 'ebbar' AS value FROM customer
UNION ALL SELECT c_custkey, 1, 'email', 24, 'u' || c_custkey || '@mail.example' FROM customer"""

# --- vault and sanitising ------------------------------------------------------------------


def vault_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values seen on pages, a third of them given by the user too: those are the user's."""
    rows = _customers(spark, sf_dir, "'v' AS vault_id", "'PERSON' AS pii_class", "'Name ' || CAST(k % 60 AS string) AS value", "'https://a.example' AS origin", "CASE WHEN k % 60 < 20 AND k % 7 = 0 THEN 'user' ELSE 'page' END AS source")
    return vault.build(rows, ["k"]).select("canonical", "token", "source")


QUERIES["vault_sources"] = vault_sources
ORACLE["vault_sources"] = """SELECT 'name ' || u AS canonical, '[PERSON_' || row_number() OVER (ORDER BY first) || ']' AS token, CASE WHEN mine THEN 'user' ELSE 'page' END AS source
FROM (SELECT c_custkey % 60 AS u, min(c_custkey) AS first, bool_or(c_custkey % 60 < 20 AND c_custkey % 7 = 0) AS mine FROM customer GROUP BY 1)"""


def sanitized_instructions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a user says: their values become tokens, token-shaped words are made harmless and not reported."""
    rows = spread(_customers(spark, sf_dir, "CAST(k AS string) AS vault", f"{_TWO} || ' as [PAN_1]' AS text"))
    out, _ = sanitize.sanitize(rows, "k", "vault", source="user")
    return out.select("k", "text", F.size("forged").alias("n_forged"))


QUERIES["sanitized_instructions"] = sanitized_instructions
ORACLE["sanitized_instructions"] = "SELECT c_custkey AS k, 'mail [EMAIL_1] or call [PHONE_1] as (PAN-1)' AS text, 0 AS n_forged FROM customer"


def sanitized_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spread(_customers(spark, sf_dir, "CAST(k AS string) AS vault", "'Photo of u' || CAST(k AS string) || '@mail.example.png' AS text"))
    return sanitize.sanitize_attr(rows, "k", "vault")


QUERIES["sanitized_attributes"] = sanitized_attributes
ORACLE["sanitized_attributes"] = "SELECT c_custkey AS k, 'Photo of [EMAIL_1]' AS text FROM customer"


def tokenized_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Single values of a known class: equal ones in other writing share a token."""
    rows = _customers(spark, sf_dir, "'v' AS vault_id", "'PHONE' AS pii_class", "CASE WHEN k % 2 = 0 THEN '+91 98765 ' || lpad(CAST(k DIV 2 % 50 AS string), 5, '0') ELSE '98765' || lpad(CAST(k DIV 2 % 50 AS string), 5, '0') END AS value", "'' AS origin", "'page' AS source")
    table = vault.build(rows, ["k"]).select("canonical", "token")
    return rows.withColumn("canonical", vault.canonical(F.col("pii_class"), F.col("value"))).join(table, "canonical").select("k", "canonical", "token")


QUERIES["tokenized_values"] = tokenized_values
ORACLE["tokenized_values"] = """WITH c AS (SELECT c_custkey AS k, '98765' || lpad((c_custkey // 2 % 50)::VARCHAR, 5, '0') AS canonical FROM customer), f AS (SELECT canonical, row_number() OVER (ORDER BY min(k)) AS n FROM c GROUP BY canonical)
SELECT k, canonical, '[PHONE_' || n || ']' AS token FROM c JOIN f USING (canonical)"""

# --- actions, targets, instructions ------------------------------------------------------------


def search_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    args = "CASE k % 4 WHEN 0 THEN '{\"action\": \"web_search\", \"query\": \"a b ' || CAST(k AS string) || '\"}' WHEN 1 THEN '{\"action\": \"visit_url\", \"url\": \"https://a.example/' || CAST(k AS string) || '\"}' WHEN 2 THEN '{\"action\": \"visit_url\", \"url\": \"a.example\"}' ELSE '{\"action\": \"visit_url\", \"url\": \"two words\"}' END AS args"
    rows = _customers(spark, sf_dir, args)
    return rows.select("k", protocol.to_action(F.col("args"), F.lit(100), F.lit(100)).alias("a")).select("k", "a.type", F.col("a.text").alias("url"))


QUERIES["search_urls"] = search_urls
ORACLE["search_urls"] = f"""SELECT c_custkey AS k, 'navigate' AS type, CASE c_custkey % 4 WHEN 0 THEN '{protocol.SEARCH}a+b+' || c_custkey || '&FORM=QBLH' WHEN 1 THEN 'https://a.example/' || c_custkey WHEN 2 THEN 'https://a.example' ELSE '{protocol.SEARCH}two+words&FORM=QBLH' END AS url FROM customer"""


def target_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A target before and after approval: the same unless one of its parts changed; null and empty parts are alike."""
    rows = _customers(spark, sf_dir)
    target = lambda name, role, opaque: F.struct(F.lit("button").alias("tag"), role.alias("role"), F.lit(None).cast("string").alias("input_type"), F.lit(None).cast("string").alias("field_class"), name.alias("name"), F.lit("https://a.example").alias("origin"), F.lit(None).cast("string").alias("href"), F.lit(False).alias("editable"), F.lit(False).alias("occluded"), opaque.alias("opaque"))
    before = policy.target_fingerprint(target(F.lit("Pay"), F.lit(None).cast("string"), F.lit(None).cast("boolean")))
    after = policy.target_fingerprint(target(F.when(F.col("k") % 3 == 0, "Pay now").otherwise("Pay"), F.lit(""), F.col("k") % 5 == 0))
    return rows.select("k", before.eqNullSafe(after).alias("same"))


QUERIES["target_changes"] = target_changes
ORACLE["target_changes"] = "SELECT c_custkey AS k, c_custkey % 3 > 0 AND c_custkey % 5 > 0 AS same FROM customer"


def submit_wishes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _customers(spark, sf_dir, "CASE k % 4 WHEN 0 THEN 'Fill it and SUBMIT, please' WHEN 1 THEN 'resubmitted forms' WHEN 2 THEN 'send it' ELSE 'only fill' END AS t")
    return rows.select("k", protocol.wants_submit(F.col("t")).alias("submit"))


QUERIES["submit_wishes"] = submit_wishes
ORACLE["submit_wishes"] = "SELECT c_custkey AS k, c_custkey % 2 = 0 AS submit FROM customer"

# --- pages, files ------------------------------------------------------------------------------


def page_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True values and the context around them, from marked pages."""
    html = "'<p>Dear <b data-gt=\"PERSON\">Ravi ' || CAST(k AS string) || '</b>, write</p><p>to <i data-gt=\"EMAIL\">r' || CAST(k AS string) || '@m.example</i></p>' AS html"
    scanned = pages.scan(spread(_customers(spark, sf_dir, html)))
    each = scanned.select("k", "context", F.posexplode_outer("truth").alias("i", "t"))
    return each.select("k", "i", "t.pii_class", "t.value", F.regexp_replace("context", r"\s+", " ").alias("context"))


QUERIES["page_truth"] = page_truth
ORACLE["page_truth"] = """SELECT c_custkey AS k, 0 AS i, 'PERSON' AS pii_class, 'Ravi ' || c_custkey AS value, 'Dear , write to' AS context FROM customer
UNION ALL SELECT c_custkey, 1, 'EMAIL', 'r' || c_custkey || '@m.example', 'Dear , write to' FROM customer"""


def coco_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of line items written as COCO files and read back."""
    boxes = read(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey AS image_id", "concat(l_orderkey, '.png') AS file_name", "400L AS width", "300L AS height", "CASE WHEN l_linenumber % 2 = 0 THEN 'FACE' ELSE 'TEXT' END AS pii_class",
        "CAST(l_partkey % 90 AS double) AS x", "CAST(l_suppkey % 70 AS double) AS y", "CAST(l_linenumber AS double) AS w", "CAST(l_quantity AS double) AS h",
    )
    path = new_path(spark, "coco")
    formats.write_coco(boxes, path, ["TEXT", "FACE"], 2_000)
    return formats.read_coco(spark, path)


QUERIES["coco_files"] = coco_files
ORACLE["coco_files"] = """SELECT l_orderkey AS image_id, l_orderkey || '.png' AS file_name, 400::BIGINT AS width, 300::BIGINT AS height, CASE WHEN l_linenumber % 2 = 0 THEN 'FACE' ELSE 'TEXT' END AS pii_class,
  (l_partkey % 90)::DOUBLE AS x, (l_suppkey % 70)::DOUBLE AS y, l_linenumber::DOUBLE AS w, l_quantity::DOUBLE AS h FROM lineitem"""


def manifest_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A corpus manifest (one document) of the first nations' pages, written and read back."""
    path = new_path(spark, "manifest")
    page = F.struct(F.concat("n_name", F.lit(".html")).alias("file"), F.concat(F.lit("t"), (F.col("n_regionkey")).cast("string")).alias("template"), F.array("n_name").alias("tags"))
    doc = read(spark, sf_dir, "nation").groupBy().agg(F.lit(42).alias("seed"), F.array_sort(F.collect_list(page)).alias("pages"))
    doc.coalesce(1).write.json(path)
    return formats.read_manifest(spark, path).select("seed", "file", "template", F.array_join("tags", ",").alias("tags"))


QUERIES["manifest_pages"] = manifest_pages
ORACLE["manifest_pages"] = "SELECT 42::BIGINT AS seed, n_name || '.html' AS file, 't' || n_regionkey AS template, n_name AS tags FROM nation"

# --- figures -------------------------------------------------------------------------------------


def _roles(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    b = read(spark, sf_dir, "lineitem").selectExpr(*_PX)
    return [b.where(F.col("role") == k).select("page", "ordinal", "x", "y", "w", "h") for k in (1, 0, 2)]


def mask_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    truth, masks, context = _roles(spark, sf_dir)
    return metrics.mask_scores(metrics.page_pixels(truth, masks, context, "page").withColumn("grp", F.col("page") % 100), ["grp"])


QUERIES["mask_scores"] = mask_scores
ORACLE["mask_scores"] = """WITH b AS (SELECT l_orderkey AS page, l_partkey % 12 AS x, l_suppkey % 10 AS y, 2 + l_partkey % 7 AS w, 2 + l_suppkey % 5 AS h, l_linenumber % 3 AS role FROM lineitem
), d AS (SELECT page, px, py, bool_or(role = 1) AS t, bool_or(role = 0) AS m FROM (SELECT page, role, px, unnest(range(y, y + h)) AS py FROM (SELECT *, unnest(range(x, x + w)) AS px FROM b)) GROUP BY page, px, py)
SELECT page % 100 AS grp, round(coalesce(count_if(m AND t)::DOUBLE / nullif(count_if(t), 0), 1), 6) AS coverage, round(coalesce(count_if(m AND t)::DOUBLE / nullif(count_if(m), 0), 1), 6) AS mask_precision FROM d GROUP BY 1"""


def uncovered_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True values of which the page's masks together leave something open (a value may have several boxes)."""
    truth, masks, _ = _roles(spark, sf_dir)
    items = truth.select("page", "ordinal", F.struct("x", "y", "w", "h").alias("rect"))
    return vision.uncovered(items, masks.drop("ordinal"), "page").select("page", "ordinal").distinct()


QUERIES["uncovered_items"] = uncovered_items
ORACLE["uncovered_items"] = """WITH b AS (SELECT l_orderkey AS page, l_linenumber AS ordinal, l_partkey % 12 AS x, l_suppkey % 10 AS y, 2 + l_partkey % 7 AS w, 2 + l_suppkey % 5 AS h, l_linenumber % 3 AS role FROM lineitem
), p AS (SELECT page, ordinal, role, px, unnest(range(y, y + h)) AS py FROM (SELECT *, unnest(range(x, x + w)) AS px FROM b)
), m AS (SELECT DISTINCT page, px, py FROM p WHERE role = 0)
SELECT DISTINCT page, ordinal FROM p LEFT JOIN m USING (page, px, py) WHERE role = 1 AND m.page IS NULL"""


def mode_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = read(spark, sf_dir, "orders").selectExpr("o_orderstatus AS mode", "CAST(o_orderkey % 101 / 100.0D AS double) AS recall")
    return metrics.mode_means(scores, "mode")


QUERIES["mode_means"] = mode_means
ORACLE["mode_means"] = "SELECT o_orderstatus AS mode, count(*) AS pages, round(avg((o_orderkey % 101) / 100.0::DOUBLE), 3) AS mean FROM orders GROUP BY 1"
