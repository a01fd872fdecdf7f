"""Checksums and format validators as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The Verhoeff multiplication, permutation and inverse tables.
VERHOEFF_D = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (1, 2, 3, 4, 0, 6, 7, 8, 9, 5), (2, 3, 4, 0, 1, 7, 8, 9, 5, 6), (3, 4, 0, 1, 2, 8, 9, 5, 6, 7), (4, 0, 1, 2, 3, 9, 5, 6, 7, 8),
    (5, 9, 8, 7, 6, 0, 4, 3, 2, 1), (6, 5, 9, 8, 7, 1, 0, 4, 3, 2), (7, 6, 5, 9, 8, 2, 1, 0, 4, 3), (8, 7, 6, 5, 9, 3, 2, 1, 0, 4), (9, 8, 7, 6, 5, 4, 3, 2, 1, 0),
)
VERHOEFF_P = (
    (0, 1, 2, 3, 4, 5, 6, 7, 8, 9), (1, 5, 7, 6, 2, 8, 3, 0, 9, 4), (5, 8, 0, 3, 7, 9, 6, 1, 4, 2), (8, 9, 1, 6, 0, 4, 3, 5, 2, 7),
    (9, 4, 5, 3, 1, 2, 6, 8, 7, 0), (4, 2, 8, 6, 5, 7, 3, 9, 0, 1), (2, 7, 9, 3, 8, 0, 6, 4, 1, 5), (7, 0, 4, 6, 9, 1, 3, 2, 5, 8),
)
VERHOEFF_INV = (0, 4, 3, 2, 1, 5, 6, 7, 8, 9)
# The GSTIN alphabet, the shapes of GSTIN, PAN and Aadhaar, and the last state code.
GSTIN_ALPHABET = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ"
GSTIN_SHAPE = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][1-9A-Z]Z[0-9A-Z]\z"
PAN_SHAPE = r"^[A-Z]{3}[ABCFGHJLPT][A-Z][0-9]{4}[A-Z]\z"
AADHAAR_SHAPE = r"^[2-9][0-9]{11}\z"
LAST_STATE = 38

_DIGITS = r"^[0-9]+\z"


def _table(rows) -> Column:
    return F.array(*[F.lit(x) for row in rows for x in row])


def digits_only(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _fold(number: Column, shift: int) -> Column:
    """Verhoeff state after the digits from the right; characters that are no digits count as 0."""
    digits = F.transform(F.split(F.reverse(number), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    steps = F.transform(digits, lambda d, i: F.struct(d.alias("d"), i.alias("i")))
    d_table, p_table = _table(VERHOEFF_D), _table(VERHOEFF_P)

    def step(state: Column, x: Column) -> Column:
        p = F.element_at(p_table, ((x["i"] + shift) % 8 * 10 + x["d"] + 1).cast("int"))
        return F.element_at(d_table, (state * 10 + p + 1).cast("int"))

    return F.aggregate(steps, F.lit(0), step)


def verhoeff_valid(number: Column) -> Column:
    """False for an empty string or one with anything but digits; null for null."""
    return F.when(number.isNull(), None).when(~number.rlike(_DIGITS), False).otherwise(_fold(number, 0) == 0)


def verhoeff_check_digit(number: Column) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in VERHOEFF_INV]), _fold(number, 1) + 1)


def luhn_valid(number: Column) -> Column:
    return F.when(number.isNull(), None).when(~number.rlike(_DIGITS), False).otherwise(F.call_function("luhn_check", number))


def luhn_check_digit(number: Column) -> Column:
    """The digit that makes ``number`` with it Luhn-valid."""
    digits = F.transform(F.split(F.reverse(number), ""), lambda c: F.coalesce(c.try_cast("int"), F.lit(0)))
    doubled = F.transform(digits, lambda d, i: F.when(i % 2 == 0, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d))
    total = F.aggregate(doubled, F.lit(0), lambda a, x: a + x)
    return (10 - total % 10) % 10


def gstin_check_char(first14: Column) -> Column:
    """Check character of the first 14 characters; empty if one is outside the alphabet."""
    at = F.transform(F.sequence(F.lit(1), F.lit(14)), lambda i: F.instr(F.lit(GSTIN_ALPHABET), F.substring(first14, i, F.lit(1))) - 1)
    weighted = F.transform(at, lambda v, i: v * (1 + i % 2))
    total = F.aggregate(weighted, F.lit(0), lambda a, p: a + F.floor(p / 36).cast("int") + p % 36)
    char = F.substring(F.lit(GSTIN_ALPHABET), ((36 - total % 36) % 36 + 1).cast("int"), F.lit(1))
    return F.when(first14.rlike(r"^[0-9A-Z]{14}\z"), char).otherwise("")


def gstin_valid(value: Column) -> Column:
    state = F.coalesce(F.substring(value, 1, 2).try_cast("int"), F.lit(0))
    check = gstin_check_char(F.substring(value, 1, 14)) == F.substring(value, 15, 1)
    return F.when(value.isNull(), None).when(~value.rlike(GSTIN_SHAPE), False).otherwise((state >= 1) & (state <= LAST_STATE) & check)


def pan_valid(value: Column) -> Column:
    return value.rlike(PAN_SHAPE)


def aadhaar_valid(number: Column) -> Column:
    return F.when(number.isNull(), None).when(~number.rlike(AADHAAR_SHAPE), False).otherwise(verhoeff_valid(number))


def py_verhoeff(number: str) -> bool:
    """The same check for Arrow stages."""
    state = 0
    for i, c in enumerate(reversed(number)):
        if c not in "0123456789":
            return False
        state = VERHOEFF_D[state][VERHOEFF_P[i % 8][int(c)]]
    return bool(number) and state == 0


def py_luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        if c not in "0123456789":
            return False
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return bool(number) and total % 10 == 0


def py_gstin(value: str) -> bool:
    if len(value) != 15 or not 1 <= int(value[:2]) <= LAST_STATE:
        return False
    weighted = [GSTIN_ALPHABET.find(c) * (1 + i % 2) for i, c in enumerate(value[:14])]
    total = sum(p // 36 + p % 36 for p in weighted)
    return GSTIN_ALPHABET[-total % 36] == value[14]
