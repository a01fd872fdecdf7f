"""The audit of outgoing text by leak patterns of its own.

The patterns are stated here and not taken from the detector's rules, so a change
there does not change the audit. Both must find the same shapes, so several read
alike (GSTIN, AADHAAR, CARD, PHONE, most of SECRET): a value that such a shape does
not describe escapes both. What the audit adds is that it needs no context, no
priorities and no overlap resolution.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.checks import digits_only, luhn_valid, verhoeff_valid

# The leak patterns, in the order of the report.
PATTERNS = {
    "EMAIL": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}",
    "UPI": r"(?<![A-Za-z0-9_.@-])[A-Za-z0-9_.-]{2,256}@[A-Za-z][A-Za-z0-9]{1,63}(?![A-Za-z0-9_.@-])",
    "GSTIN": r"(?<![A-Z0-9])[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z](?![A-Z0-9])",
    "SECRET": r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}|(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|sk-[A-Za-z0-9_-]{20,}|gh[pousr]_[A-Za-z0-9]{36}|(?:sk|pk|rk)_(?:live|test)_[A-Za-z0-9]{16,})",
    "AADHAAR": r"(?<![0-9-])[2-9][0-9]{3}([ -]?)[0-9]{4}\1[0-9]{4}(?![0-9-])",
    "CARD": r"(?<![0-9-])[2-6](?:[ -]?[0-9]){12,18}(?![0-9-])",
    "PAN": r"(?<![A-Z0-9])[A-Z]{3}[ABCFGHJLPT][A-Z][0-9]{4}[A-Z](?![A-Z0-9])",
    "PHONE": r"(?<![0-9+])(?:(?:\+|00)?91[ -]?|0)?[6-9][0-9]{4}[ -]?[0-9]{5}(?![0-9])",
}
#: What every match of a pattern has, as words and as a run of digits: a cheap test before the pattern.
NEEDS = {
    "EMAIL": (("@",), 0), "UPI": (("@",), 0), "GSTIN": ((), 4), "SECRET": (("eyJ", "AKIA", "sk-", "gh", "_live_", "_test_"), 0), "AADHAAR": ((), 4),
    "CARD": ((), 1), "PAN": ((), 4), "PHONE": ((), 5),
}


def _may(text: Column, name: str, run: Column) -> Column:
    words, digits = NEEDS[name]
    out = run >= digits
    for i, w in enumerate(words):
        found = F.contains(text, F.lit(w))
        out = found if not i else out | found
    return out


def find_leaks(text: Column) -> Column:
    """``array<string>`` of the classes that a text leaks; an e-mail address is not also a UPI handle."""
    run = F.when(text.rlike("[0-9]{5}"), 5).when(text.rlike("[0-9]{4}"), 4).when(text.rlike("[0-9]"), 1).otherwise(0)
    has = {k: F.when(_may(text, k, run), text.rlike(p)).otherwise(False) for k, p in PATTERNS.items()}
    has["UPI"] = F.when(has["EMAIL"], False).otherwise(has["UPI"])
    for name, check in (("AADHAAR", verhoeff_valid), ("CARD", luhn_valid)):
        found = F.regexp_extract_all(text, F.lit(PATTERNS[name]), F.lit(0))
        valid = F.transform(F.transform(found, digits_only), check)
        has[name] = F.when(has[name], F.array_contains(valid, True)).otherwise(False)
    return F.filter(F.array(*[F.when(has[k], k) for k in PATTERNS]), lambda x: x.isNotNull())


def split_leaks(df: DataFrame, text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Rows that may go out, and the quarantine with their leak classes. Fails closed: null text stays in."""
    audited = df.withColumn("leaks", find_leaks(F.col(text)))
    good = F.col(text).isNotNull() & (F.size("leaks") == 0)
    return audited.where(good).drop("leaks"), audited.where(~good)
