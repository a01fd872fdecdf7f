"""Replace detected values by vault tokens in texts and URLs."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from . import native
from . import vault as vaults
from .spans import SPAN
from .vault_store import VaultStore

# Fixed value: path segments that look like identifiers.
ID_SEGMENT = r"(?i)^(?:[0-9]{4,}|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[A-Za-z0-9_-]{20,}|[0-9a-f]{16,})\z"


def splice(text: Column, spans: Column, tokens: Column) -> Column:
    """The text with each span replaced by its token and what lies between defanged."""
    rows = F.arrays_zip(spans.alias("s"), tokens.alias("t"))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(a: Column, x: Column) -> Column:
        gap = F.substring(text, a["at"] + 1, x["s"]["start"] - a["at"])
        return F.struct(x["s"]["end"].alias("at"), F.concat(a["out"], vaults.defang(gap), x["t"]).alias("out"))

    rest = F.aggregate(rows, start, step)
    return F.concat(rest["out"], vaults.defang(F.substring(text, rest["at"] + 1, F.length(text))))


def sanitize(docs: DataFrame, key: str, vault_id: str, origin: Column | None = None, source: str = "page", text: str = "text", spans: Column | None = None, store: VaultStore | None = None, batch: str | None = None, keep: Callable[[Column], Column] | None = None) -> tuple[DataFrame, DataFrame]:
    """(key, vault_id, text, spans, tokens, forged) of every row, and the vault.

    With a ``store`` known values keep the tokens of earlier runs and new ones are added to it (``batch``
    names the run); without, the vault is of these rows alone.

    ``spans`` (over ``_text``) defaults to the full detector. It runs once: rows are
    written with their spans and a number of their own, by which tokens come back, so
    null and repeated keys are as good as others. Tokens are numbered by (key, start)
    within each vault. A null text stays null, without spans. ``keep`` (of a span, over ``_key`` and
    ``_text``) says which spans become tokens; without it all do. The values of others stay in the text.
    """
    narrow = docs.select(F.monotonically_increasing_id().alias("_row"), F.col(key).alias("_key"), F.col(vault_id).alias("vault_id"), F.col(text).alias("_text"), (origin if origin is not None else F.lit("")).alias("origin"))
    found = narrow.withColumn("spans", spans) if spans is not None else native.with_spans(narrow, "_text")
    base = written(found.withColumn("spans", F.filter("spans", keep)) if keep is not None else found, "spans")
    each = base.select("_row", "_key", "vault_id", "origin", "_text", F.posexplode("spans").alias("i", "s"))
    values = each.select("_row", "i", "_key", "vault_id", "origin", F.col("s.start").alias("start"), F.col("s.pii_class").alias("pii_class"), F.substring(F.col("_text"), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"), F.lit(source).alias("source"))
    values = values.withColumn("canonical", vaults.canonical(F.col("pii_class"), F.col("value")))
    vault = vaults.build(values, ["_key", "start"]) if store is None else store.update(values, ["_key", "start"], batch)
    known = vault.select(F.col("vault_id").alias("_vault"), F.col("pii_class").alias("_class"), F.col("canonical").alias("_canonical"), "token")
    same = F.col("vault_id").eqNullSafe(F.col("_vault")) & (F.col("pii_class") == F.col("_class")) & (F.col("canonical") == F.col("_canonical"))
    tokens = values.join(known, same).groupBy("_row").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "token"))), lambda x: x["token"]).alias("tokens"))
    joined = base.join(tokens, "_row", "left").withColumn("tokens", F.coalesce("tokens", F.array().cast("array<string>")))
    forged = vaults.forged(F.col("_text")) if source != "user" else F.array().cast("array<struct<start:int,end:int>>")
    out = joined.select(F.col("_key").alias(key), "vault_id", splice(F.col("_text"), F.col("spans"), F.col("tokens")).alias(text), "spans", "tokens", forged.alias("forged"))
    return out, vault


def sanitize_attr(docs: DataFrame, key: str, vault_id: str, origin: Column | None = None, text: str = "text") -> DataFrame:
    """(key, text) of short attribute-like strings (titles, labels, file names): the text of :func:`sanitize` alone."""
    return sanitize(docs, key, vault_id, origin, text=text)[0].select(key, text)


def sanitize_urls(pages: DataFrame, key: str, vault_id: str, url: str = "url") -> tuple[DataFrame, DataFrame]:
    """(key, vault_id, url) of every row, and the vault: :func:`sanitize_url`, with values in path segments replaced by tokens.

    Segments are decoded and detected as texts of their own; those with a value become
    its text with tokens, others follow the rules for identifiers. A null url stays null.
    """
    rows = written(pages.select(F.monotonically_increasing_id().alias("_url"), F.col(key).alias("_key"), F.col(vault_id).alias("_vault"), F.col(url).alias("url")), "urls")
    segments = rows.where(F.lower("url").rlike("^https?://")).select("_url", "_vault", F.posexplode(F.split(_path(F.col("url")), "/", -1)).alias("at", "segment")).where("segment <> ''")
    texts = segments.select(F.struct("_url", "at").alias("_place"), "_vault", _decoded(F.col("segment")).alias("text"))
    # Rows have their numbers, so their texts may be dealt out for the detector.
    parts = max(texts.sparkSession.sparkContext.defaultParallelism, rows.rdd.getNumPartitions())
    out, vault = sanitize(texts.repartition(parts), "_place", "_vault")
    found = out.where(F.size("spans") > 0).groupBy("_place._url").agg(F.map_from_entries(F.collect_list(F.struct("_place.at", "text"))).alias("tokens"))
    joined = rows.join(found, "_url", "left")
    return joined.select(F.col("_key").alias(key), F.col("_vault").alias("vault_id"), sanitize_url(F.col("url"), tokens=F.col("tokens")).alias(url)), vault


def empty_spans() -> Column:
    return F.array().cast(f"array<{SPAN}>")


def _path(url: Column) -> Column:
    return F.regexp_replace(F.regexp_extract(url, r"^[A-Za-z]+://[^/?#]*([^?#]*)", 1), "^\\z", "/")


def _decoded(segment: Column) -> Column:
    return F.coalesce(F.try_url_decode(F.regexp_replace(segment, r"\+", "%2B")), segment)


def sanitize_url(url: Column, segment_spans: bool = False, tokens: Column | None = None) -> Column:
    """Scheme, host and path shape only: no credentials, fragment or query values.

    Identifier-like segments become ``[ID]``, an unreadable URL ``[URL]``, other
    schemes ``scheme:[REDACTED]``. Personal data in segments needs the detector:
    :func:`sanitize_urls` gives its texts by position as ``tokens``. Without a vault,
    ``segment_spans`` makes such segments ``[ID]`` (by the pattern rules).
    """
    from .spans import all_rule_spans

    protocol = F.lower(F.regexp_extract(url, r"^([A-Za-z][A-Za-z0-9+.-]*):", 1))
    web = protocol.isin("http", "https")
    host = F.lower(F.try_parse_url(url, F.lit("HOST")))
    port = F.regexp_extract(url, r"^[A-Za-z]+://(?:[^/?#@]*@)?[^/?#:]*:([0-9]+)", 1)
    default = ((protocol == "http") & (port == "80")) | ((protocol == "https") & (port == "443"))
    origin = F.concat(protocol, F.lit("://"), host, F.when((port == "") | default, "").otherwise(F.concat(F.lit(":"), port)))

    def segment(s: Column, i: Column) -> Column:
        plain = _decoded(s)
        private = plain.rlike(ID_SEGMENT)
        if segment_spans:
            private = private | (F.size(all_rule_spans(plain)) > 0)
        known = F.when((s != "") & private, "[ID]").otherwise(s)
        return known if tokens is None else F.coalesce(F.try_element_at(tokens, i), known)

    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda p: p != "")
    keys = F.array_distinct(F.transform(pairs, lambda p: F.coalesce(F.try_url_decode(F.substring_index(p, "=", 1)), F.substring_index(p, "=", 1))))
    encoded = F.transform(keys, lambda k: F.concat(F.regexp_replace(F.url_encode(k), r"\+", "%20"), F.lit("=*")))
    tail = F.when(F.size(keys) > 0, F.concat(F.lit("?"), F.array_join(encoded, "&"))).otherwise("")
    clean = F.concat(origin, F.array_join(F.transform(F.split(_path(url), "/", -1), segment), "/"), tail)
    return F.when(url.isNull(), None).when(protocol == "", "[URL]").when(~web, F.concat(protocol, F.lit(":[REDACTED]"))).when(host.isNull(), "[URL]").otherwise(clean)
