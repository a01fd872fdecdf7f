"""Seeded identifiers as Column expressions: the same row always gives the same value."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.checks import gstin_check_char, luhn_check_digit, verhoeff_check_digit

_32 = (1 << 32) - 1
_LETTERS, _CODES = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def let(value: Column, use) -> Column:
    """``use(value)`` with the value computed once, however often it is used."""
    return F.get(F.transform(F.array(value), use), 0)


def _times(a: Column, b: Column) -> Column:
    """Product modulo 2**32 of two numbers below 2**32, without leaving 64 bits."""
    high = F.shiftright(a, 16) * b
    return (F.shiftleft(high.bitwiseAND(F.lit(0xFFFF)), 16) + a.bitwiseAND(F.lit(0xFFFF)) * b).bitwiseAND(F.lit(_32))


def mulberry32(seed: Column, k: Column) -> Column:
    """Number k (from 0) of the public mulberry32 generator: its state is seed plus a multiple, so no draw needs the others."""
    a = (seed + (k + 1) * F.lit(0x6D2B79F5)).bitwiseAND(F.lit(_32))
    first = lambda a: _times(a.bitwiseXOR(F.shiftright(a, 15)), a.bitwiseOR(F.lit(1)))
    second = lambda t: t.bitwiseXOR((t + _times(t.bitwiseXOR(F.shiftright(t, 7)), t.bitwiseOR(F.lit(61)))).bitwiseAND(F.lit(_32)))
    last = lambda v: v.bitwiseXOR(F.shiftright(v, 14)) / float(1 << 32)
    return let(let(let(a, first), second), last)


def _draw(seed: Column, k: int, n: int) -> Column:
    return F.floor(mulberry32(seed.cast("long"), F.lit(k).cast("long")) * n).cast("int")


def digits(seed: Column, at: int, n: int) -> Column:
    return F.concat(*[_draw(seed, at + i, 10).cast("string") for i in range(n)])


def letters(seed: Column, at: int, n: int, alphabet: str = _LETTERS) -> Column:
    return F.concat(*[F.substring(F.lit(alphabet), _draw(seed, at + i, len(alphabet)) + 1, F.lit(1)) for i in range(n)])


def fake(kind: str, seed: Column) -> Column:
    """A valid value of a class for a row's seed."""
    one = lambda low, n: (_draw(seed, 0, n) + low).cast("string")
    if kind == "AADHAAR":
        body = F.concat(one(2, 8), digits(seed, 1, 10))
        return let(body, lambda b: F.concat(b, verhoeff_check_digit(b).cast("string")))
    if kind == "AADHAAR_VID":
        body = digits(seed, 0, 15)
        return let(body, lambda b: F.concat(b, verhoeff_check_digit(b).cast("string")))
    if kind == "CARD":
        body = F.concat(F.lit("4"), digits(seed, 0, 14))
        return let(body, lambda b: F.concat(b, luhn_check_digit(b).cast("string")))
    if kind == "PAN":
        return F.concat(letters(seed, 0, 3), F.lit("P"), letters(seed, 3, 1), digits(seed, 4, 4), letters(seed, 8, 1))
    if kind == "GSTIN":
        first = F.concat(F.lpad(one(1, 37), 2, "0"), letters(seed, 1, 3), F.lit("C"), letters(seed, 4, 1), digits(seed, 5, 4), letters(seed, 9, 1), (_draw(seed, 10, 9) + 1).cast("string"), F.lit("Z"))
        return let(first, lambda b: F.concat(b, gstin_check_char(b)))
    if kind == "PHONE":
        return F.concat(one(6, 4), digits(seed, 1, 9))
    if kind == "IFSC":
        return F.concat(letters(seed, 0, 4), F.lit("0"), letters(seed, 4, 6, _CODES))
    if kind == "PINCODE":
        return F.concat(one(1, 8), digits(seed, 1, 5))
    raise ValueError(kind)
