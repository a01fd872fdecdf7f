"""The whole detector as DataFrame functions: pattern, layout and name rules, and the resolution of overlaps.

Equal to the Arrow stage of :mod:`detect`. A first pass takes what decides which rules can match at all: the text
with plain digits, its lower-cased form, its longest run of digits and its capitalised words. A rule's own pattern runs only
on texts that have what it needs; lines are looked at only where a text can have an address,
an e-mail address below a name, or a known name. Null and empty texts have no spans.
"""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark import SparkContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import layout, names
from .layout import ADDRESSEE, BLOCK, CARD, GAZETTEER
from .resolve import resolve
from .rules import BLANK, DEVANAGARI, RULES
from .spans import SPAN, normalize_digits, rule_spans

_NONE = f"array<{SPAN}>"
_NORM, _LOW, _RUN, _CAPS, _RAW = "_veil_norm", "_veil_low", "_veil_run", "_veil_caps", "_veil_raw"


def _whole(pattern: str) -> str:
    return f"^(?:{pattern})\\z"


def _strip_right(text: Column) -> Column:
    return F.regexp_replace(text, f"[{BLANK}]+\\z", "")


def _strip(text: Column) -> Column:
    return F.regexp_replace(_strip_right(text), f"^[{BLANK}]+", "")


def _none() -> Column:
    return F.array().cast(_NONE)


def _span(start: Column, size: Column, cls: str, score: Column | float, rule: str, index: int) -> Column:
    value = score if isinstance(score, Column) else F.lit(score)
    return F.struct(start.cast("int").alias("start"), (start + size).cast("int").alias("end"), F.lit(cls).alias("pii_class"), value.alias("score"), F.lit(rule).alias("rule"), F.lit(index).alias("rule_idx"))


def _at(lines: Column, i: Column) -> Column:
    """Where line ``i`` begins."""
    return F.length(F.array_join(F.slice(lines, F.lit(1), i), "\n")) + F.when(i > 0, 1).otherwise(0)


def _body(at: Column, text: Column, cls: str, score: float, rule: str, index: int) -> Column:
    """The span of a text without the blanks around it; an array of at most one."""
    own = _strip(text)
    lead = F.length(text) - F.length(F.regexp_replace(text, f"^[{BLANK}]+", ""))
    return F.when(own != "", F.array(_span(at + lead, F.length(own), cls, score, rule, index))).otherwise(_none())


def _is_name(line: Column) -> Column:
    return line.rlike(_whole(layout.NAME_LINE))


def _signals(line: Column) -> Column:
    bits = sum((F.when(line.rlike(p), b).otherwise(0) for b, p in ((2, layout.STREET), (4, layout.HOUSE), (8, layout.PIN))), F.when(line.rlike(layout.STATE), 1).otherwise(0))
    return F.when((F.length(line) > layout.ADDRESS_LINE) | line.rlike(layout.NOT_ADDRESS), 0).otherwise(bits)


def address_spans(text: Column) -> Column:
    """Address blocks and the name line above each: runs in a string of marks, one for each line."""
    lines = F.split(text, "\n", -1)

    def of_lines(x: Column) -> Column:
        lines, bits = x["lines"], x["bits"]
        has = lambda i: F.coalesce(F.get(bits, i), F.lit(0)) > 0

        def mark(b: Column, i: Column) -> Column:
            line = F.get(lines, i)
            bridge = has(i - 1) & has(i + 1) & (F.length(_strip(line)) <= layout.BRIDGE_LINE) & ~_is_name(line)
            return F.when(b > 0, "s").when(bridge, "b").otherwise(".")

        marks = F.array_join(F.transform(bits, mark), "")
        runs, gaps = F.regexp_extract_all(marks, F.lit("[sb]+"), F.lit(0)), F.split(marks, "[sb]+", -1)

        def block(run: Column, k: Column) -> Column:
            first = F.length(F.array_join(F.slice(gaps, F.lit(1), k + 1), "")) + F.length(F.array_join(F.slice(runs, F.lit(1), k), ""))
            kinds = F.aggregate(F.slice(bits, first + 1, F.length(run)), F.lit(0), lambda a, b: a.bitwiseOR(b))
            n_kinds, n_lines = F.bit_count(kinds), F.length(F.translate(run, "b", ""))
            good = (kinds.bitwiseAND(F.lit(3)) != 0) & (n_kinds >= 2) & ((n_lines >= 2) | (n_kinds >= 3))
            body = _body(_at(lines, first), F.array_join(F.slice(lines, first + 1, F.length(run)), "\n"), "ADDRESS", 0.7, "address.block", BLOCK)
            above = F.coalesce(F.get(lines, first - 1), F.lit(""))
            name = F.when((first > 0) & _is_name(above) & ~above.rlike(layout.HEADING), _body(_at(lines, first - 1), above, "PERSON", 0.7, "person.addressee", ADDRESSEE)).otherwise(_none())
            return F.when(good, F.concat(body, name)).otherwise(_none())

        return F.flatten(F.transform(runs, block))

    # A list of one entry holds what several steps read, so each is computed once.
    held = F.transform(F.array(lines), lambda x: F.struct(x.alias("lines"), F.transform(x, _signals).alias("bits")))
    return F.flatten(F.transform(held, of_lines))


def card_spans(text: Column) -> Column:
    """Name lines directly above a line that is an e-mail address."""

    def of_lines(lines: Column) -> Column:
        def name(line: Column, i: Column) -> Column:
            found = F.coalesce(F.get(lines, i + 1), F.lit("")).rlike(_whole(layout.EMAIL_LINE)) & _is_name(line) & ~line.rlike(layout.HEADING)
            return F.when(found, _body(_at(lines, i), line, "PERSON", 0.7, "person.contact_card", CARD)).otherwise(_none())

        return F.flatten(F.transform(lines, name))

    return F.flatten(F.transform(F.array(F.split(text, "\n", -1)), of_lines))


def _key(word: Column) -> Column:
    return F.lower(F.replace(F.regexp_replace(word, "\\.\\z", ""), F.lit("’"), F.lit("'")))


def _kind(word: Column, given: list[str], surnames: list[str]) -> Column:
    key = _key(word)
    return F.when(~word.rlike(_whole(layout.CAPITAL)), "x").when(word.rlike(_whole(layout.INITIAL)), "I").when(key.isin(given), "G").when(key.isin(surnames), "S").otherwise("U")


def line_spans(x: Column) -> Column:
    """The names of a line: ``x`` has at, line, words, gaps (what stands around the words) and kinds."""
    empty = F.array().cast("array<struct<first:int,last:int,score:double>>")
    shape = "(?<![IGS])(?:" + layout.NAMED + ")(?![IGS])"
    words, gaps, kinds, line = x["words"], x["gaps"], x["kinds"], x["line"]
    place = lambda i: F.length(F.array_join(F.slice(gaps, F.lit(1), i + 1), "")) + F.length(F.array_join(F.slice(words, F.lit(1), i), ""))
    beside = lambda i: (i > 0) & (F.translate(F.get(gaps, i), " \t", "") == "")
    marks = F.array_join(F.transform(kinds, lambda k, i: F.concat(F.when((i == 0) | beside(i), "").otherwise("|"), k)), "")
    found, around = F.regexp_extract_all(marks, F.lit(shape), F.lit(0)), F.split(marks, shape, -1)

    def named(run: Column, k: Column) -> Column:
        before = F.length(F.translate(F.concat(F.array_join(F.slice(around, F.lit(1), k + 1), ""), F.array_join(F.slice(found, F.lit(1), k), "")), "|", ""))
        return F.struct(before.cast("int").alias("first"), (before + F.length(run) - 1).cast("int").alias("last"), F.lit(layout.NAMED_SCORE).alias("score"))

    n = F.size(words)
    bare = lambda t: F.regexp_replace(t, f"{layout.CLOSING}\\z", "")
    run = F.substring(line, place(F.lit(0)) + 1, place(n - 1) + F.length(F.get(words, n - 1)) - place(F.lit(0)))
    tail = F.lower(F.regexp_replace(F.get(words, n - 1), "\\.\\z", ""))
    alone = marks.rlike(_whole(layout.ALONE)) & (bare(_strip(line)) == bare(run)) & ~(F.endswith(marks, F.lit("U")) & tail.isin(sorted(names.NOT_SURNAME)))
    only = F.when(alone, F.array(F.struct(F.lit(0).alias("first"), (n - 1).cast("int").alias("last"), F.lit(layout.ALONE_SCORE).alias("score")))).otherwise(empty)

    def span(f: Column) -> Column:
        start, word = place(f["first"]), F.get(words, f["last"])
        dot = F.when(F.endswith(word, F.lit(".")) & ~word.rlike(_whole(layout.INITIAL)), 1).otherwise(0)
        return _span(x["at"] + start, place(f["last"]) + F.length(word) - dot - start, "PERSON", f["score"], "person.gazetteer", GAZETTEER)

    return F.transform(F.concat(F.transform(found, named), only), span)


def gazetteer_spans(text: Column, given: frozenset[str] = names.GIVEN, surnames: frozenset[str] = names.SURNAMES) -> Column:
    """Known names, found as shapes in the kinds of the words of a line."""
    first_names, last_names = sorted(given), sorted(surnames)

    def of_lines(lines: Column) -> Column:
        numbered = F.filter(F.transform(lines, lambda t, i: F.struct(t.alias("line"), i.alias("i"))), lambda x: (F.length(x["line"]) <= layout.NAME_LINE_LIMIT) & x["line"].rlike("[A-Z]"))
        worded = F.transform(numbered, lambda x: F.struct(x["line"].alias("line"), x["i"].alias("i"), F.regexp_extract_all(x["line"], F.lit(layout.WORD), F.lit(0)).alias("words")))
        kinds = F.transform(worded, lambda x: F.struct(x["line"].alias("line"), x["i"].alias("i"), x["words"].alias("words"), F.transform(x["words"], lambda w: _kind(w, first_names, last_names)).alias("kinds")))
        known = F.filter(kinds, lambda x: F.exists(x["kinds"], lambda k: k.isin("G", "S")))
        ready = F.transform(known, lambda x: F.struct(_at(lines, x["i"]).alias("at"), x["line"].alias("line"), x["words"].alias("words"), F.split(x["line"], layout.WORD, -1).alias("gaps"), x["kinds"].alias("kinds")))
        return F.flatten(F.transform(ready, line_spans))

    return F.flatten(F.transform(F.array(F.split(text, "\n", -1)), of_lines))


def _needed(rule) -> Column:
    """Whether a text has what a rule needs, by the columns of the first pass."""
    out = F.col(_RUN) >= rule.needs_digits
    for words, text in ((rule.needs, _LOW if rule.ignore_case else _NORM), (rule.needs_low, _LOW)):
        if words:
            any_of = F.lit(False)
            for w in words:
                any_of = any_of | F.contains(F.col(text), F.lit(w))
            out = out & any_of
    return out


@lru_cache(maxsize=16)
def _parts(gateway: int, exclude: frozenset[str], given: frozenset[str], surnames: frozenset[str]) -> tuple[Column, ...]:
    """The spans of each rule over the columns of the first pass. Kept, as making so many expressions takes seconds."""
    own = F.col(_NORM)
    parts = [F.when(_needed(r), rule_spans(own, r.name, False)).otherwise(_none()) for r in RULES if r.pii_class not in exclude]
    if keep := [c for c in ("ADDRESS", "PERSON") if c not in exclude]:
        # A block has a state or street word, and a number or both; a state begins with one of a few words.
        states = sorted({x.split(" ")[0] for x in layout.STATES if x.isascii()})
        may = (F.col(_RUN) > 0) | own.rlike(f"[{DEVANAGARI}]") | F.exists(_CAPS, lambda w: w.isin(states))
        parts.append(F.when(may & own.rlike(f"{layout.STATE}|{layout.STREET}"), F.filter(address_spans(own), lambda s: s["pii_class"].isin(keep))).otherwise(_none()))
    if "PERSON" not in exclude:
        parts.append(F.when(F.contains(own, F.lit("@")) & F.contains(own, F.lit("\n")), card_spans(own)).otherwise(_none()))
        heads = sorted({re.split("['’-]", x)[0] for x in given | surnames})
        parts.append(F.when(F.exists(_CAPS, lambda w: F.lower(w).isin(heads)), gazetteer_spans(own, given, surnames)).otherwise(_none()))
    return tuple(parts)


def with_spans(df: DataFrame, text: str = "text", exclude: tuple[str, ...] = (), name: str = "spans", extra: Column | None = None, given: frozenset[str] = names.GIVEN, surnames: frozenset[str] = names.SURNAMES) -> DataFrame:
    """``df`` with the disjoint spans of its text column, in the JVM alone; ``extra`` spans take part in the resolution."""
    given_text = F.coalesce(F.col(text), F.lit(""))
    norm = F.when(given_text.rlike("[०-९]"), normalize_digits(given_text)).otherwise(given_text)
    run = F.aggregate(F.regexp_extract_all(norm, F.lit("[0-9]+"), F.lit(0)), F.lit(0), lambda a, d: F.greatest(a, F.length(d)))
    first = df.withColumns({_NORM: norm, _LOW: F.lower(norm), _RUN: run, _CAPS: F.regexp_extract_all(norm, F.lit("[A-Z][A-Za-z]*"), F.lit(0))})
    parts = _parts(id(SparkContext._gateway), frozenset(exclude), frozenset(given), frozenset(surnames))
    more = [F.filter(F.coalesce(extra, _none()), lambda s: ~s["pii_class"].isin(list(exclude)))] if extra is not None else []
    raw = first.withColumn(_RAW, F.concat(*parts, *more))
    return raw.withColumn(name, resolve(F.col(_RAW), F.col(text))).drop(_NORM, _LOW, _RUN, _CAPS, _RAW)


def spans_table(df: DataFrame, key: list[str], text: str = "text", exclude: tuple[str, ...] = (), **lists) -> DataFrame:
    """One row per span: the key columns, the span's fields and its value."""
    found = with_spans(df.select(*key, text), text, exclude, "_spans", **lists).select(*key, text, F.posexplode_outer("_spans").alias("ordinal", "s")).where("s IS NOT NULL")
    return found.select(*key, "ordinal", "s.*", F.substring(F.col(text), F.col("s.start") + 1, F.col("s.end") - F.col("s.start")).alias("value"))
