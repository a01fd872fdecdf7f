"""Names of a dictionary table of any size, found by a join.

The distinct capitalised words of each line meet the dictionary by their key, a shuffle join with runtime
filters as Spark sees fit; what comes back to a line is the kinds of its words, and the
shapes of names are those of the detector. Nothing is collected, and a common name is one key of many short rows that
adaptive execution splits.

Null texts and names are left out; a name of both kinds counts as a given one; repeated entries count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import written
from . import layout
from .native import _key, _whole, line_spans
from .spans import normalize_digits


def _lines(text: Column) -> Column:
    """(at, line) of the lines that may hold a name."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<at:int,line:string>>").alias("out"))
    may = lambda t: (F.length(t) <= layout.NAME_LINE_LIMIT) & t.rlike("[A-Z]")
    step = lambda s, t: F.struct((s["at"] + F.length(t) + 1).alias("at"), F.when(may(t), F.array_append(s["out"], F.struct(s["at"].alias("at"), t.alias("line")))).otherwise(s["out"]).alias("out"))
    return F.aggregate(F.split(text, "\n", -1), start, step, lambda s: s["out"])


def find(docs: DataFrame, key: list[str], dictionary: DataFrame, text: str = "text") -> DataFrame:
    """(key, start, end, pii_class, score, rule, rule_idx) of the names in a text; ``dictionary`` has name and kind (given or surname)."""
    kinds = dictionary.where("name IS NOT NULL AND kind IN ('given', 'surname')").groupBy(F.lower("name").alias("_name")).agg(F.min("kind").alias("_kind"))
    lines = docs.select(F.struct(*key).alias("_own"), F.inline(_lines(normalize_digits(F.col(text)))))
    lines = written(lines.withColumn("_line", F.monotonically_increasing_id()), "lines")
    words = F.regexp_extract_all("line", F.lit(layout.WORD), F.lit(0))
    names = F.filter(words, lambda w: w.rlike(_whole(layout.CAPITAL)) & ~w.rlike(_whole(layout.INITIAL)))
    asked = lines.select("_line", F.explode(F.array_distinct(F.transform(names, _key))).alias("_name"))
    known = asked.join(kinds, "_name").groupBy("_line").agg(F.map_from_entries(F.collect_list(F.struct("_name", F.when(F.col("_kind") == "given", "G").otherwise("S")))).alias("_known"))

    def kind(w: Column) -> Column:
        return F.when(~w.rlike(_whole(layout.CAPITAL)), "x").when(w.rlike(_whole(layout.INITIAL)), "I").otherwise(F.coalesce(F.try_element_at("_known", _key(w)), F.lit("U")))

    found = lines.join(known, "_line").withColumn("words", words)
    line = F.struct("at", "line", "words", F.split("line", layout.WORD, -1).alias("gaps"), F.transform("words", kind).alias("kinds"))
    spans = F.flatten(F.transform(F.array(line), line_spans))
    return found.select("_own", F.inline(spans)).select("_own.*", "start", "end", "pii_class", "score", "rule", "rule_idx")
