"""The detector: all pattern, layout and gazetteer rules with overlap resolution.

One Arrow stage runs everything over a batch, with the same rule table as the
DataFrame expressions in :mod:`spans`. Each rule's cheap test comes first.
Null text has no spans.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import checks
from . import layout, names
from .resolve import resolve_rows
from .rules import BLANK, HEADINGS, NOT_GREETED, RULES, Rule, fill
from .spans import SPAN

_SPANS = pa.list_(pa.struct({"start": pa.int32(), "end": pa.int32(), "pii_class": pa.string(), "score": pa.float64(), "rule": pa.string(), "rule_idx": pa.int32()}))
_DIGITS = str.maketrans("०१२३४५६७८९", "0123456789")
_TRAIL = re.compile(f"[{BLANK},.;:]+\\Z")
_RUN = re.compile("[0-9]+")
_NOT_DIGIT = re.compile("[^0-9]")
_GREETED = re.compile("(?:" + "|".join(NOT_GREETED) + ")(?![A-Za-z0-9_])")
_HEADING = re.compile("(?<![A-Za-z0-9_])(?:" + "|".join(HEADINGS) + ")(?![A-Za-z0-9_])")


def _digits(value: str) -> str:
    return _NOT_DIGIT.sub("", value)


VALIDATORS: dict[str, Callable[[str], bool]] = {
    "digit_and_letter": lambda v: bool(re.search("[0-9]", v) and re.search("[A-Za-z]", v)),
    "gstin": checks.py_gstin,
    "pan": lambda v: bool(re.match("[A-Z]{3}[ABCFGHJLPT][A-Z][0-9]{4}[A-Z]\\Z", v.upper())),
    "aadhaar": lambda v: len(_digits(v)) == 12 and _digits(v)[0] in "23456789" and checks.py_verhoeff(_digits(v)),
    "verhoeff": lambda v: checks.py_verhoeff(_digits(v)),
    "card": lambda v: 13 <= len(_digits(v)) <= 19 and checks.py_luhn(_digits(v)),
    "greeted": lambda v: not _GREETED.match(v),
    "no_heading": lambda v: not _HEADING.search(v),
}


@cache
def _compiled(index: int) -> tuple[re.Pattern, re.Pattern | None]:
    r = RULES[index]
    flags = re.ASCII | (re.IGNORECASE if r.ignore_case else 0)
    value = r.value if r.value.startswith("(?<!") and not r.before else r.value
    pattern = re.compile(fill(f"(?:{r.before})(?P<value>{value}){r.after}".replace("\\1", "(?P=sep)").replace("([ -]?)", "(?P<sep>[ -]?)"), r"\Z"), flags)
    context = re.compile(fill(r.context, r"\Z"), re.ASCII) if r.context else None
    return pattern, context


def _match(rule: Rule, index: int, text: str) -> Iterator[tuple]:
    pattern, context = _compiled(index)
    valid = VALIDATORS.get(rule.validator or "")
    for m in pattern.finditer(text):
        value = _TRAIL.sub("", m["value"])
        if not value or valid and not valid(value):
            continue
        if context and not context.search(text[max(0, m.start() - rule.window) : m.start()]):
            continue
        start = m.start("value")
        yield start, start + len(value), rule.pii_class, rule.score, rule.name, index


def _among(words: tuple[str, ...], text: str) -> bool:
    for w in words:
        if w in text:
            return True
    return not words


def raw_spans(text: str, exclude: frozenset[str] = frozenset(), given: frozenset[str] = names.GIVEN, surnames: frozenset[str] = names.SURNAMES) -> list[tuple]:
    """All spans in rule order, before resolution. Excluded classes are not looked for."""
    norm = text.translate(_DIGITS)
    low = norm.lower()
    out: list[tuple] = []
    run = max(map(len, _RUN.findall(norm)), default=0)
    for i, rule in enumerate(RULES):
        if rule.needs_digits <= run and rule.pii_class not in exclude and _among(rule.needs, low if rule.ignore_case else norm) and _among(rule.needs_low, low):
            out += _match(rule, i, norm)
    rest = layout.address_spans(norm) + layout.card_spans(norm) + layout.gazetteer_spans(norm, given, surnames)
    return out + [s for s in rest if s[2] not in exclude]


def detect_text(text: str | None, exclude: frozenset[str] = frozenset(), extra: list[tuple] = (), **lists) -> list[tuple]:
    if not text:
        return []
    found = raw_spans(text, exclude, **lists) + [s for s in extra if s[2] not in exclude]
    return resolve_rows(found, text)


def detector(exclude: tuple[str, ...] = (), raw: bool = False, **lists):
    """An Arrow UDF text (and, optionally, extra spans) -> array of spans."""
    out = frozenset(exclude)

    @F.arrow_udf(f"array<{SPAN}>")
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([raw_spans(t, out, **lists) if raw and t else detect_text(t, out, **lists) for t in (x.as_py() for x in texts)], _SPANS)

    return run


def detector_with_extra(exclude: tuple[str, ...] = (), **lists):
    out = frozenset(exclude)

    @F.arrow_udf(f"array<{SPAN}>")
    def run(texts: pa.Array, extra: pa.Array) -> pa.Array:
        def one(t, e):
            rows = [tuple(x[k] for k in ("start", "end", "pii_class", "score", "rule", "rule_idx")) for x in (e if e is not None else ())]
            return detect_text(t, out, rows, **lists)

        return pa.array([one(t.as_py(), e.as_py()) for t, e in zip(texts, extra)], _SPANS)

    return run


def detect(text: Column, exclude: tuple[str, ...] = (), extra: Column | None = None, **lists) -> Column:
    """Disjoint spans of a text column in text order."""
    return detector(exclude, **lists)(text) if extra is None else detector_with_extra(exclude, **lists)(text, extra)


def spans_table(df: DataFrame, key: list[str], text: str = "text", exclude: tuple[str, ...] = (), **lists) -> DataFrame:
    """One row per span: the key columns, the span's fields and its value.

    The outer generator keeps Catalyst from inferring a filter on the spans, which
    would run the detector a second time, below any repartitioning.
    """
    found = df.select(*key, text).withColumn("_spans", detect(F.col(text), exclude, **lists)).select(*key, text, F.posexplode_outer("_spans").alias("ordinal", "s")).where("s IS NOT NULL")
    return found.select(*key, "ordinal", "s.*", F.substring(F.col(text), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))
