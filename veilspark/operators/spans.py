"""Spans of one rule or of all, as ``array<struct>`` columns of DataFrame functions.

Spark has no function that gives the offsets of all matches. They follow from
the matches and the gaps between them: ``regexp_extract_all`` and ``split`` on
the same pattern. Offsets are code points, half open, counted from 0.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import checks
from .rules import BLANK, HEADINGS, INDEX, NOT_GREETED, RULES, Rule, by_name, fill, java_pattern

SPAN = "struct<start:int,end:int,pii_class:string,score:double,rule:string,rule_idx:int>"
_TRAIL = f"[{BLANK},.;:]+\\z"


def normalize_digits(text: Column) -> Column:
    """Devanagari digits as ASCII digits; lengths stay."""
    return F.translate(text, "०१२३४५६७८९", "0123456789")


def _valid(rule: Rule, value: Column) -> Column:
    digits = checks.digits_only(value)
    match rule.validator:
        case "digit_and_letter":
            return value.rlike("[0-9]") & value.rlike("[A-Za-z]")
        case "gstin":
            return checks.gstin_valid(value)
        case "pan":
            return checks.pan_valid(F.upper(value))
        case "aadhaar":
            return checks.aadhaar_valid(digits)
        case "verhoeff":
            return checks.verhoeff_valid(digits)
        case "card":
            return F.length(digits).between(13, 19) & checks.luhn_valid(digits)
        case "greeted":
            return ~value.rlike("^(?:" + "|".join(NOT_GREETED) + ")(?![A-Za-z0-9_])")
        case "no_heading":
            return ~value.rlike("(?<![A-Za-z0-9_])(?:" + "|".join(HEADINGS) + ")(?![A-Za-z0-9_])")
    return F.lit(True)


def _worth(rule: Rule, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    out = F.lit(True)
    if rule.needs:
        low = F.lower(text) if rule.ignore_case else text
        any_of = F.lit(False)
        for x in rule.needs:
            any_of = any_of | F.contains(low, F.lit(x))
        out = any_of
    if rule.needs_low:
        any_low = F.lit(False)
        for x in rule.needs_low:
            any_low = any_low | F.contains(F.lower(text), F.lit(x))
        out = out & any_low
    if rule.needs_digits:
        out = out & text.rlike(f"[0-9]{{{rule.needs_digits}}}")
    return out


def rule_spans(text: Column, name: str, checked: bool = True) -> Column:
    """``array<struct>`` of a rule's spans in text order; empty for null text.

    Without ``checked`` the text has ASCII digits and what the rule needs already.
    """
    rule = by_name(name)
    norm = normalize_digits(text) if checked else text
    pattern, grouped = java_pattern(rule)
    whole = F.regexp_extract_all(norm, F.lit(pattern), F.lit(0))
    before = F.regexp_extract_all(norm, F.lit(pattern), F.lit(1)) if grouped else F.transform(whole, lambda _: F.lit(""))
    value = F.regexp_extract_all(norm, F.lit(pattern), F.lit(2)) if grouped else whole
    gap = F.split(norm, pattern, -1)
    rows = F.arrays_zip(whole.alias("m"), before.alias("b"), value.alias("v"), F.slice(gap, 1, F.size(whole)).alias("g"))
    start = F.struct(F.lit(0).alias("pos"), F.array().cast("array<struct<at:int,start:int,value:string>>").alias("out"))

    def step(state: Column, x: Column) -> Column:
        at = state["pos"] + F.length(x["g"])
        one = F.struct(at.alias("at"), (at + F.length(x["b"])).alias("start"), F.regexp_replace(x["v"], _TRAIL, "").alias("value"))
        return F.struct((at + F.length(x["m"])).alias("pos"), F.array_append(state["out"], one).alias("out"))

    found = F.aggregate(rows, start, step, lambda s: s["out"])
    keep = F.filter(found, lambda s: (F.length(s["value"]) > 0) & _valid(rule, s["value"]))
    if rule.context:
        context = fill(rule.context, r"\z")
        keep = F.filter(keep, lambda s: F.substring(norm, F.greatest(F.lit(1), s["at"] - rule.window + 1), F.least(s["at"], F.lit(rule.window))).rlike(context))
    spans = F.transform(
        keep,
        lambda s: F.struct(
            s["start"].alias("start"), (s["start"] + F.length(s["value"])).alias("end"), F.lit(rule.pii_class).alias("pii_class"),
            F.lit(rule.score).alias("score"), F.lit(rule.name).alias("rule"), F.lit(INDEX[rule.name]).alias("rule_idx"),
        ),
    )
    # Most texts have no match: they cost one search, not the passes for matches, groups and gaps.
    found = norm.rlike(pattern)
    return F.when(text.isNotNull() & _worth(rule, norm) & found if checked else found, spans).otherwise(F.array().cast(f"array<{SPAN}>"))


def all_rule_spans(text: Column, exclude: tuple[str, ...] = ()) -> Column:
    """Spans of all pattern rules in rule order. Rules of excluded classes are not run."""
    return F.concat(*[rule_spans(text, r.name) for r in RULES if r.pii_class not in exclude])


def span_value(text: Column, span: Column) -> Column:
    return F.substring(text, span["start"] + 1, span["end"] - span["start"])
