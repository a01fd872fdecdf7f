"""Host-level quality rules with an empirical beta prior.

Every document gets surface counts and soft rule failures. The failures are
aggregated by host (pre-aggregated before the shuffle, so a host with a third
of all rows costs one row per map task). A beta prior fitted by moments over
all hosts shrinks each host's failure rate; small hosts move towards the
corpus mean. The host's verdict goes back to its documents as the limits they are
held to: from lenient ones (rates up to ``SOUND``) to strict ones (from ``FAILING``
on), in proportion between. A document that breaks no strict limit is kept whatever its host.

Edge cases: null text counts as empty (``base_failed``, not kept); a null host
is a host of its own; repeated rows count and stay as often as they occur; an
empty table gives an empty result; further input columns are ignored by
:func:`score` and kept by :func:`filter_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from . import textvec as tv
from .workspace import Space, fixed, pick, written

MIN_WORDS = 50
REPEAT_WINDOW = 3
#: Characters that count as symbols (fixed value).
SYMBOLS = "#*$%&|<>"
#: (symbols per 100 words, duplicate lines per 100 lines, longest mean word) for documents of sound and of failing hosts.
LENIENT = (60, 60, 20)
STRICT = (15, 35, 14)
#: Host rates up to SOUND have lenient limits, from FAILING on strict ones.
SOUND, FAILING = 0.10, 0.40
#: Host rates are broadcast up to this size, measured; a larger table is joined by a shuffle.
BROADCAST_BYTES = 64 << 20

_COUNTS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS]] = True


def _sorted_runs(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Stable order of the keys, and for each sorted entry whether a run begins there."""
    order = np.argsort(keys, kind="stable")
    s = keys[order]
    first = np.ones(len(s), bool)
    first[1:] = s[1:] != s[:-1]
    return order, first


def _repeat_words(c: tv.Chunk, w: tv.Words, h: np.ndarray) -> np.ndarray:
    at = tv.starts_of(w.first, REPEAT_WINDOW)
    if not len(at):
        return np.zeros(c.n, np.int64)
    doc = tv.owner(w.first)[at]
    keys = tv.rolling(h, REPEAT_WINDOW)[at] + doc.astype(tv.U) * tv.U(0x9E3779B97F4A7C15)
    order, first = _sorted_runs(keys)
    again = ~first
    twice = again.copy()
    twice[:-1] |= again[1:]
    found = np.sort(at[order[twice]])
    return tv.per_document(tv.cover(found, REPEAT_WINDOW, len(h)), w.first)


def _lines(c: tv.Chunk, w: tv.Words) -> tuple[np.ndarray, np.ndarray]:
    """Per document: lines with a word, and those equal to an earlier one."""
    breaks = np.flatnonzero(c.data == 10)
    start = np.concatenate([breaks + 1, c.off[:-1]])
    kind = np.concatenate([np.zeros(len(breaks)), np.ones(c.n)])
    doc = np.concatenate([np.searchsorted(c.off, breaks, "right") - 1, np.arange(c.n)])
    order = np.lexsort((kind, start, doc))
    start, doc = start[order], doc[order]
    end = np.empty_like(start)
    end[:-1] = np.where(doc[1:] == doc[:-1], start[1:] - 1, c.off[doc[:-1] + 1])
    if len(end):
        end[-1] = c.off[-1]
    worded = np.searchsorted(w.start, end) > np.searchsorted(w.start, start)
    start, end, doc = start[worded], end[worded], doc[worded]
    keys = tv.spans(c.data, start, end) + doc.astype(tv.U) * tv.U(0x9E3779B97F4A7C15)
    order, first = _sorted_runs(keys)
    return np.bincount(doc, minlength=c.n), np.bincount(doc[order[~first]], minlength=c.n)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        parts = []
        for c in tv.chunks(batch.column(1)):
            w = tv.words(c)
            h = tv.spans(c.data, w.start, w.end)
            lead = ~tv.IS_WS[c.data] & ((c.data & 0xC0) != 0x80)
            n_lines, dup = _lines(c, w)
            parts.append((w.count, tv.per_document(lead, c.off), tv.per_document(_IS_SYMBOL[c.data], c.off), dup, _repeat_words(c, w, h), n_lines))
        if parts:
            cols = [pa.array(np.concatenate(x).astype(np.int64)) for x in zip(*parts)]
            own = [i for i, name in enumerate(batch.schema.names) if name != "counted"]
            yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in own], *cols], names=[*[batch.schema.names[i] for i in own], *_NAMES])


_NAMES = [x.split()[0] for x in _COUNTS.split(", ")]


def counts(docs: DataFrame, host: str = "source", keep: bool = False) -> DataFrame:
    """Surface counts of every whole text: doc_id, host, if asked ``row`` (a struct of all columns), and the counts."""
    row = [F.struct(*[F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]).alias("row")] if keep else []
    narrow = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("counted"), F.col(f"`{host}`").cast("string").alias("host"), *row)
    schema = StructType([f for f in narrow.schema if f.name != "counted"] + StructType.fromDDL(_COUNTS).fields)
    return narrow.mapInArrow(_count, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def _soft(limits: tuple[int, int, int]) -> Column:
    symbols, dup, longest = limits
    return (
        (100 * F.col("n_symbols") > symbols * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > dup * F.col("n_lines"))
        | (F.col("word_chars") > longest * F.col("n_words"))
    )


def host_rates(scored: DataFrame) -> DataFrame:
    """One row per host: failures, documents, and the rate shrunk by the beta prior.

    The prior's mean m is the corpus rate and its strength s comes from the
    hosts' weighted variance v beyond the binomial: s = m(1-m)/v - 1, kept in
    [2, 1000]. With one host, or no spread, s is 1000.
    """
    hosts = scored.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("failed").cast("long")).alias("fails"))
    rate = F.col("fails") / F.col("n")
    total = hosts.agg(F.sum("n").alias("tn"), F.sum("fails").alias("tf"), F.sum(rate * rate * F.col("n")).alias("rr"), F.count(F.lit(1)).alias("hosts"))
    m = F.try_divide("tf", "tn")
    v = F.try_divide("rr", "tn") - m * m - m * (1 - m) * F.try_divide("hosts", "tn")
    strength = F.when(v > 1e-9, F.least(F.lit(1000.0), F.greatest(F.lit(2.0), m * (1 - m) / v - 1))).otherwise(1000.0)
    # Two numbers come to the driver.
    prior = total.select(m.alias("m"), strength.alias("s")).first()
    mean, weight = (prior["m"] or 0.0, prior["s"]) if prior else (0.0, 1000.0)
    return hosts.select("host", "n", "fails", ((F.col("fails") + mean * weight) / (F.col("n") + weight)).alias("rate"))


def _strictness(rate: Column) -> Column:
    """0 to 1, rounded so that it does not hang on the order of a sum."""
    return F.round(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (rate - SOUND) / (FAILING - SOUND))), 6)


def _breaks(strictness: Column) -> Column:
    """Whether a document breaks a limit between lenient (0) and strict (1)."""
    symbols, dup, longest = [low + strictness * (high - low) for low, high in zip(LENIENT, STRICT)]
    return (
        (100 * F.col("n_symbols") > symbols * F.col("n_words"))
        | (100 * F.col("n_dup_lines") > dup * F.col("n_lines"))
        | (F.col("word_chars") > longest * F.col("n_words"))
    )


def _flagged(counted: DataFrame) -> DataFrame:
    return counted.withColumn("base_failed", base_failed()).withColumn("failed", F.col("base_failed") | _soft(STRICT))


def _judged(table: DataFrame, flagged: DataFrame) -> DataFrame:
    """The rows of ``table`` with the verdict by the host rates of ``flagged``."""
    hosts = written(host_rates(flagged).select(F.col("host").alias("h"), F.col("rate").alias("host_rate")), "hosts")
    if space := Space.current():
        space.keep(hosts)
    size = hosts.agg(F.sum(F.coalesce(F.octet_length("h"), F.lit(0)) + 32)).first()[0] or 0
    rates = F.broadcast(hosts) if size <= BROADCAST_BYTES else hosts
    out = table.join(rates, F.col("host").eqNullSafe(F.col("h")), "left")
    return out.withColumn("kept", ~F.col("base_failed") & ~_breaks(_strictness(F.col("host_rate")))).withColumn("host_rate", F.round("host_rate", 9))


def score(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, counts, base_failed, host_rate and the verdict ``kept`` of every row."""
    table = written(_flagged(counts(docs, host)), "quality")
    return _judged(table, table).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "host_rate")


def filter_documents(docs: DataFrame, host: str = "source") -> DataFrame:
    """The documents (all columns) whose verdict is kept; each row by its own verdict.

    The counts of all rows are written for the host rates, without texts; the result counts again as it
    reads the rows, so they are neither copied nor shuffled.
    """
    with Space():
        rows = fixed(docs)
        table = written(_flagged(counts(rows, host)).select("host", "failed"), "failures")
        judged = _judged(_flagged(counts(rows, host, True)), table)
    return judged.where("kept").select(*[F.col(f"row.c{i}").alias(c) for i, c in enumerate(docs.columns)])


def query(spark, sf_dir: str) -> DataFrame:
    return score(pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text", "source"))


_W = r"[^\x20\x09-\x0D]+"
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(source, chr(1)) AS host, coalesce(text, '') AS t FROM documents
), w AS (
  SELECT *, regexp_extract_all(t, '{_W}') AS ws,
    list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_W}')) AS ls FROM d
), g AS (
  SELECT r, i, ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w WHERE len(ws) > 2)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, k) AS c FROM g) WHERE c > 1
), rep AS (
  SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM twice) GROUP BY r
), c AS (
  SELECT doc_id, host, len(ws)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
    length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(n, 0)::BIGINT AS n_repeat_words, len(ls)::BIGINT AS n_lines FROM w LEFT JOIN rep USING (r)
), b AS (
  SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    100 * n_symbols > {STRICT[0]} * n_words OR 100 * n_dup_lines > {STRICT[1]} * n_lines OR word_chars > {STRICT[2]} * n_words AS strict FROM c
), h AS (
  SELECT host, count(*) AS n, count_if(base_failed OR strict) AS fails FROM b GROUP BY host
), m AS (
  SELECT sum(fails) / sum(n) AS m, sum((fails / n) * (fails / n) * n) / sum(n) - (sum(fails) / sum(n)) ^ 2
    - (sum(fails) / sum(n)) * (1 - sum(fails) / sum(n)) * count(*) / sum(n) AS v FROM h
), p AS (
  SELECT m, CASE WHEN v > 1e-9 THEN least(1000, greatest(2, m * (1 - m) / v - 1)) ELSE 1000 END AS s FROM m
), rate AS (
  SELECT host, (fails + m * s) / (n + s) AS host_rate FROM h, p
), limits AS (
  SELECT host, host_rate, round(least(1.0::DOUBLE, greatest(0.0::DOUBLE, (host_rate - {SOUND}::DOUBLE) / ({FAILING}::DOUBLE - {SOUND}::DOUBLE))), 6) AS x FROM rate
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (100 * n_symbols > ({LENIENT[0]} + x * {STRICT[0] - LENIENT[0]}) * n_words OR 100 * n_dup_lines > ({LENIENT[1]} + x * {STRICT[1] - LENIENT[1]}) * n_lines
    OR word_chars > ({LENIENT[2]} + x * {STRICT[2] - LENIENT[2]}) * n_words) AS kept, round(host_rate, 9) AS host_rate
FROM b JOIN limits USING (host)
"""
