"""Overlap resolution: higher scores win, others take what room is left.

Order: score down, length down, then rule and start up. A span takes the free room inside it;
each piece loses blanks and punctuation at its ends and stays if it is at least three long, or the uncut span.
What is not taken stays free for spans behind.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import running
from .rules import BLANK
from .spans import SPAN

#: Trimmed off both ends of a piece.
EDGE = f"[{BLANK},.;:()\\-–]"
LEAST = 3
_EDGE = re.compile(EDGE)
_FAR = (1 << 31) - 1


def resolve(spans: Column, text: Column | None = None) -> Column:
    """Disjoint spans in text order, by a fold whose state is the free room and the spans that took of it.

    For the few spans of a text; :func:`resolve_table` takes any number.
    """

    def rank(s: Column) -> Column:
        return F.struct((-s["score"]).alias("a"), (s["start"] - s["end"]).alias("b"), s["rule_idx"].alias("c"), s["start"].alias("d"), s.alias("s"))

    def room(a: Column, b: Column) -> Column:
        return F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"))

    def trimmed(a: Column, b: Column) -> Column:
        if text is None:
            return room(a, b)
        body = F.substring(text, a + 1, b - a)
        tail = F.regexp_replace(body, f"{EDGE}+\\z", "")
        lead = F.length(tail) - F.length(F.regexp_replace(tail, f"^{EDGE}+", ""))
        return room(a + lead, a + F.length(tail))

    def step(state: Column, s: Column) -> Column:
        def use(g: Column) -> Column:
            """The room, and the piece of the span in it."""
            a, b = F.greatest(g["a"], s["start"]), F.least(g["b"], s["end"])
            return F.struct(g.alias("g"), F.when(a < b, trimmed(a, b)).alias("p"))

        def stays(x: Column) -> Column:
            return x["p"].isNotNull() & ((x["p"]["b"] - x["p"]["a"] >= LEAST) | ((x["p"]["a"] == s["start"]) & (x["p"]["b"] == s["end"])))

        used = F.transform(F.transform(state["free"], use), lambda x: F.struct(x["g"].alias("g"), F.when(stays(x), x["p"]).alias("p")))
        free = F.flatten(F.transform(used, lambda x: F.when(x["p"].isNull(), F.array(x["g"])).otherwise(F.filter(F.array(room(x["g"]["a"], x["p"]["a"]), room(x["p"]["b"], x["g"]["b"])), lambda r: r["a"] < r["b"]))))
        taken = F.transform(F.filter(used, lambda x: x["p"].isNotNull()), lambda x: F.struct(x["p"]["a"].alias("start"), x["p"]["b"].alias("end"), *[s[n].alias(n) for n in ("pii_class", "score", "rule", "rule_idx")]))
        return F.struct(free.alias("free"), F.concat(state["out"], taken).alias("out"))

    def alone(s: Column) -> Column:
        """A span without others has all the room."""
        a, b = F.greatest(s["start"], F.lit(0)), F.least(s["end"], F.lit(_FAR))
        return F.struct(s.alias("s"), F.when(a < b, trimmed(a, b)).alias("p"))

    fits = lambda x: x["p"].isNotNull() & ((x["p"]["b"] - x["p"]["a"] >= LEAST) | ((x["p"]["a"] == x["s"]["start"]) & (x["p"]["b"] == x["s"]["end"])))
    cut = lambda x: F.struct(x["p"]["a"].alias("start"), x["p"]["b"].alias("end"), *[x["s"][n].alias(n) for n in ("pii_class", "score", "rule", "rule_idx")])
    single = F.transform(F.filter(F.transform(spans, alone), fits), cut)
    ordered = F.transform(F.array_sort(F.transform(spans, rank)), lambda x: x["s"])
    start = F.struct(F.array(room(F.lit(0), F.lit(_FAR))).alias("free"), F.array().cast(f"array<{SPAN}>").alias("out"))
    return F.when(F.size(spans) == 1, single).when(F.size(spans) > 1, F.aggregate(ordered, start, step, lambda s: F.array_sort(s["out"]))).otherwise(F.array().cast(f"array<{SPAN}>"))


class _Room:
    """Free places of a text. Room of ``LEAST`` or more is kept in order; smaller room only serves spans that fit in whole."""

    def __init__(self) -> None:
        self.starts, self.ends = [0], [_FAR]
        self.small: dict[int, int] = {}

    def pieces(self, a: int, b: int) -> list[tuple[int, int]]:
        """What is free between ``a`` and ``b``, as far as a span that long may use it."""
        i = max(0, bisect_right(self.starts, a) - 1)
        out = [(max(a, self.starts[j]), min(b, self.ends[j])) for j in range(i, bisect_left(self.starts, b))]
        out = [(x, y) for x, y in out if x < y]
        if not out and b - a < LEAST:
            out = [(a, b) for at in (a, a - 1) if self.small.get(at, -1) >= b][:1]
        return out

    def take(self, a: int, b: int) -> None:
        i = bisect_right(self.starts, a) - 1
        if i >= 0 and self.ends[i] >= b:
            left, right = (self.starts[i], a), (b, self.ends[i])
            large = [r for r in (left, right) if r[1] - r[0] >= LEAST]
            self.starts[i : i + 1], self.ends[i : i + 1] = [r[0] for r in large], [r[1] for r in large]
        else:
            at = a if self.small.get(a, -1) >= b else a - 1
            left, right = (at, a), (b, self.small.pop(at))
        self.small |= {x: y for x, y in (left, right) if 0 < y - x < LEAST}


def resolve_rows(spans: list[tuple], text: str) -> list[tuple]:
    """The same for Arrow stages: spans are (start, end, class, score, rule, rule_idx). n log n, but for long pieces without a letter."""
    free, out = _Room(), []
    for s in sorted(spans, key=lambda s: (-s[3], s[0] - s[1], s[5], s[0])):
        for a, b in free.pieces(s[0], s[1]):
            while text and a < b and _EDGE.match(text[a]):
                a += 1
            while text and b > a and _EDGE.match(text[b - 1]):
                b -= 1
            if b - a >= LEAST or (a, b) == s[:2]:
                free.take(a, b)
                out.append((a, b, *s[2:]))
    return sorted(out)


def resolve_table(spans: DataFrame, key: list[str], value: str | None = None) -> DataFrame:
    """Disjoint spans of rows (key, start, end, pii_class, score, rule, rule_idx and, for trimming, the span's text ``value``).

    A sweep over each key's spans by start: spans that no others bridge cannot meet, so each group of spans
    that hang together is resolved by itself. The sweep is over sorted ranges whose last ends are carried
    on; one key with all spans is spread like many. A null key is a key.
    """
    names = ["start", "end", "pii_class", "score", "rule", "rule_idx"]
    rows = spans.select(F.struct(*key).alias("_key"), *names, (F.col(value) if value else F.lit(None).cast("string")).alias("_value"))
    swept = running(rows, ["_key"], ["start", "end"], F.col("end"), "_reach")
    opens = F.when(F.col("_reach").isNull() | (F.col("start") >= F.col("_reach")), F.col("start"))
    grouped = running(swept.withColumn("_opens", opens), ["_key"], ["start", "end", "_reach"], F.col("_opens"), "_before")
    group = F.coalesce("_opens", "_before").alias("_group")

    @F.pandas_udf(f"array<{SPAN}>")
    def resolved(each: pd.Series) -> pd.Series:
        return each.map(_resolve_group)

    packed = grouped.select("_key", group, F.struct(*names, "_value").alias("s")).groupBy("_key", "_group").agg(F.collect_list("s").alias("each"))
    return packed.select("_key.*", F.inline(resolved("each")))


def _resolve_group(each) -> list[tuple]:
    """The spans of a group; the text between them is pieced together from their own."""
    rows = [tuple(s[n] for n in ("start", "end", "pii_class", "score", "rule", "rule_idx")) for s in each]
    base, text = min(r[0] for r in rows), ""
    if all(s["_value"] is not None for s in each):
        chars = ["\0"] * (max(r[1] for r in rows) - base)
        for s in each:
            chars[s["start"] - base : s["end"] - base] = s["_value"]
        text = "".join(chars)
    moved = [(r[0] - base, r[1] - base, *r[2:]) for r in rows]
    return [(a + base, b + base, *rest) for a, b, *rest in resolve_rows(moved, text)]
