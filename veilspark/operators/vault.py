"""Token vault as a table: equal canonical values of a class get one token.

``vault`` rows: vault_id, pii_class, canonical, token, value, source, origin,
first_seen. Numbers follow first sight within (vault_id, pii_class). Canonical
values are aggregated first (combined before the shuffle); the distinct ones are
numbered in ranges, so a vault that holds a third of all values is no hot key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import digits_only
from ..functions.tables import numbered
from .rules import BLANK, CLASSES, NEVER_RELEASE
from .spans import normalize_digits

#: A token, anywhere in a text (fixed values): as :func:`build` numbers them, and as the reference reads them, up to 9,999.
TOKEN = r"\[([A-Z][A-Z_]*?)_([0-9]+)\]"
REFERENCE_TOKEN = r"\[([A-Z][A-Z_]*?)_([0-9]{1,4})\]"

# The field classes that a token of each class may be typed into.
FILL = {
    "EMAIL": ("EMAIL", "USERNAME"), "PHONE": ("PHONE", "USERNAME"), "USERNAME": ("USERNAME", "EMAIL"), "PERSON": ("PERSON",), "DOB": ("DOB",), "ADDRESS": ("ADDRESS",),
    "PINCODE": ("PINCODE", "ADDRESS"), "AADHAAR": ("AADHAAR",), "AADHAAR_VID": ("AADHAAR_VID", "AADHAAR"), "PAN": ("PAN",), "GSTIN": ("GSTIN",), "IFSC": ("IFSC",),
    "BANK_ACCOUNT": ("BANK_ACCOUNT",), "CARD": ("CARD",), "CARD_EXPIRY": ("CARD_EXPIRY",), "UPI": ("UPI",), "PASSPORT": ("PASSPORT",), "VOTER_ID": ("VOTER_ID",),
    "DRIVING_LICENCE": ("DRIVING_LICENCE",),
}
# Classes by the way their values are compared.
LOWER, DIGITS = ("EMAIL", "UPI"), ("AADHAAR", "AADHAAR_VID", "CARD", "BANK_ACCOUNT")
CODES = ("PAN", "GSTIN", "IFSC", "PASSPORT", "VOTER_ID", "DRIVING_LICENCE")


def canonical(pii_class: Column, value: Column) -> Column:
    """What must be equal for two values to share a token. Devanagari digits count as digits."""
    v = F.regexp_replace(normalize_digits(value), f"^[{BLANK}]+|[{BLANK}]+\\z", "")
    return (
        F.when(pii_class.isin(*LOWER), F.lower(v))
        .when(pii_class == "PHONE", F.right(digits_only(v), F.lit(10)))
        .when(pii_class.isin(*DIGITS), digits_only(v))
        .when(pii_class.isin(*CODES), F.upper(F.regexp_replace(v, f"[{BLANK}-]", "")))
        .otherwise(F.lower(F.regexp_replace(v, f"[{BLANK}]+", " ")))
    )


def distinct_values(values: DataFrame, order: list[str]) -> DataFrame:
    """One row for each canonical value: ``first`` (where it was seen first, its value and origin), ``by_user`` and ``_seen``."""
    keyed = values.withColumn("canonical", canonical(F.col("pii_class"), F.col("value"))).withColumn("_seen", F.struct(*order))
    distinct = keyed.groupBy("vault_id", "pii_class", "canonical").agg(F.min(F.struct("_seen", "value", "origin")).alias("first"), F.coalesce(F.max(F.col("source") == "user"), F.lit(False)).alias("by_user"))
    return distinct.withColumn("_seen", F.struct("first._seen", "canonical"))


def token(pii_class: Column, number: Column) -> Column:
    return F.concat(F.lit("["), pii_class, F.lit("_"), number.cast("string"), F.lit("]"))


def build(values: DataFrame, order: list[str]) -> DataFrame:
    """The vault of (vault_id, pii_class, value, origin, source) rows seen in ``order``."""
    ordered = numbered(distinct_values(values, order), ["vault_id", "pii_class"], "_seen")
    return ordered.select(
        "vault_id", "pii_class", "canonical", token(F.col("pii_class"), F.col("number")).alias("token"), F.col("first.value").alias("value"),
        F.when(F.col("by_user"), "user").otherwise("page").alias("source"), F.col("first.origin").alias("origin"), F.col("first._seen").alias("first_seen"),
    )


def legend(vault: DataFrame) -> DataFrame:
    """Tokens and classes, without values."""
    return vault.select("vault_id", "token", "pii_class", "first_seen")


def parse_tokens(text: Column, pattern: str = TOKEN) -> Column:
    """``array<struct<literal, token>>``: the parts of a text in order."""
    gaps, tokens = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    null = F.lit(None).cast("string")
    parts = F.transform(gaps, lambda g, i: F.array(F.struct(g.alias("literal"), null.alias("token")), F.struct(null.alias("literal"), F.get(tokens, i).alias("token"))))
    return F.filter(F.flatten(parts), lambda p: F.coalesce(F.length(p["literal"]), F.length(p["token"]), F.lit(0)) > 0)


def forged(text: Column, pattern: str = TOKEN) -> Column:
    """``array<struct<start, end>>`` of token-shaped strings in a text."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("out"))

    def step(s: Column, p: Column) -> Column:
        end = s["at"] + F.length(F.coalesce(p["literal"], p["token"]))
        one = F.struct(s["at"].alias("start"), end.alias("end"))
        return F.struct(end.alias("at"), F.when(p["token"].isNotNull(), F.array_append(s["out"], one)).otherwise(s["out"]).alias("out"))

    return F.aggregate(parse_tokens(text, pattern), start, step, lambda s: s["out"])


def defang(text: Column, pattern: str = TOKEN) -> Column:
    """Token-shaped strings made harmless: ``[X_1]`` becomes ``(X-1)``."""
    return F.regexp_replace(text, pattern, "($1-$2)")


def fill_compatible(token_class: Column, field_class: Column) -> Column:
    allowed = F.create_map(*[x for k, v in FILL.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return F.coalesce(F.array_contains(F.try_element_at(allowed, token_class), field_class), F.lit(False))


def fill_decision(token: Column, pii_class: Column, source: Column, origin: Column, value: Column, target_origin: Column, field_class: Column) -> Column:
    """``struct<ok, value, reason>``; a null class means that the vault does not know the token."""
    reason = (
        F.when(pii_class.isNull(), F.concat(F.lit("unknown token "), token))
        .when(pii_class.isin(*NEVER_RELEASE), F.concat(pii_class, F.lit(" is never released")))
        .when(~fill_compatible(pii_class, field_class), F.concat(pii_class, F.lit(" cannot be typed into a "), F.coalesce(field_class, F.lit("unclassified")), F.lit(" field")))
        .when((source == "page") & ~origin.eqNullSafe(target_origin), F.concat(F.lit("value seen on "), origin, F.lit(" cannot be sent to "), target_origin))
    )
    return F.struct(reason.isNull().alias("ok"), F.when(reason.isNull(), value).alias("value"), reason.alias("reason"))


def reveal(texts: DataFrame, vault: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """Texts (with vault_id) whose known tokens are values again; unknown ones stay. Each row by itself, whatever its key."""
    own = F.struct(*key, "vault_id")
    rows = texts.select(F.monotonically_increasing_id().alias("_row"), own.alias("_own"), F.col(text).alias("_text"))
    parts = rows.select("_row", "_own", F.posexplode_outer(parse_tokens(F.col("_text"))).alias("i", "p"))
    known = vault.select(F.col("vault_id").alias("_vault"), F.col("token").alias("_token"), "value")
    joined = parts.join(known, F.col("_own.vault_id").eqNullSafe(F.col("_vault")) & (F.col("p.token") == F.col("_token")), "left")
    piece = F.coalesce("value", "p.token", "p.literal", F.lit(""))
    ordered = F.array_sort(F.collect_list(F.struct("i", piece.alias("piece"))))
    whole = joined.groupBy("_row").agg(F.first("_own").alias("_own"), F.array_join(F.transform(ordered, lambda x: x["piece"]), "").alias(text))
    return whole.select("_own.*", text)


def class_table(spark) -> DataFrame:
    """The fixed dimension of classes."""
    rows = [(c, c in NEVER_RELEASE) for c in CLASSES]
    return spark.createDataFrame(rows, "pii_class string, never_release boolean")
