"""Classes of form fields, as an ordered CASE over their attributes."""

from __future__ import annotations

import re
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

from .rules import whole

# Autocomplete names, input types, and keywords in order of precedence.
AUTOCOMPLETE = {
    "name": "PERSON", "given-name": "PERSON", "additional-name": "PERSON", "family-name": "PERSON", "nickname": "PERSON", "cc-name": "PERSON", "email": "EMAIL", "tel": "PHONE",
    "tel-national": "PHONE", "tel-local": "PHONE", "bday": "DOB", "bday-day": "DOB", "bday-month": "DOB", "bday-year": "DOB", "street-address": "ADDRESS", "address-line1": "ADDRESS",
    "address-line2": "ADDRESS", "address-line3": "ADDRESS", "address-level1": "ADDRESS", "address-level2": "ADDRESS", "postal-code": "PINCODE", "cc-number": "CARD", "cc-csc": "CARD_CVV",
    "cc-exp": "CARD_EXPIRY", "cc-exp-month": "CARD_EXPIRY", "cc-exp-year": "CARD_EXPIRY", "one-time-code": "OTP", "current-password": "PASSWORD", "new-password": "PASSWORD", "username": "USERNAME",
}
INPUT_TYPES = {"password": "PASSWORD", "email": "EMAIL", "tel": "PHONE"}
_S, _E = "(?<![A-Za-z0-9_])", "(?![A-Za-z0-9_])"
KEYWORDS = (
    (f"pass(?:word|wd|code)?{_E}|{whole('pin')}(?![ \\t\\n]*code)|{whole('mpin')}|पासवर्ड", "PASSWORD"),
    (f"{whole('otp')}|one.?time|verification.?code|ओटीपी", "OTP"),
    (f"{_S}cvv|{_S}cvc|security.?code", "CARD_CVV"),
    (f"expir|valid.?(?:thru|till)|{whole('exp')}", "CARD_EXPIRY"),
    (f"card.?(?:no|num)|credit.?card|debit.?card|{_S}ccnum", "CARD"),
    (f"{whole('vid')}|virtual.?id", "AADHAAR_VID"),
    (f"aadha?ar|{whole('uid')}|आधार", "AADHAAR"),
    (f"{whole('pan')}|pan.?(?:no|num|card)|पैन", "PAN"),
    (f"gstin|{whole('gst')}", "GSTIN"),
    (f"{_S}ifsc", "IFSC"),
    ("acc(?:oun)?t.?(?:no|num)|a/c|bank.?acc|खाता", "BANK_ACCOUNT"),
    (f"{whole('upi')}|{whole('vpa')}", "UPI"),
    ("passport|पासपोर्ट", "PASSPORT"),
    (f"{whole('epic')}|voter|मतदाता", "VOTER_ID"),
    (f"driving|licen[cs]e|{_S}dl.?no", "DRIVING_LICENCE"),
    ("e-?mail|ईमेल", "EMAIL"),
    (f"mobile|phone|{whole('tel')}|{whole('mob')}|contact.?no|whatsapp|मोबाइल|फ़ोन|फोन", "PHONE"),
    (f"{whole('dob')}|birth|जन्म", "DOB"),
    (f"pin.?code|postal|{_S}zip|पिन", "PINCODE"),
    (f"{whole('ip')}|ip.?addr", "IP_ADDRESS"),
    (f"address|street|locality|{whole('house')}|{whole('flat')}|landmark|{whole('city')}|district|पता", "ADDRESS"),
    ("user.?(?:name|id)|login.?id", "USERNAME"),
    (f"(?:first|last|middle|full|given|family|sur|father|mother|spouse|applicant|guardian).?name|{whole('name')}|bill(?:ed)?.?to|ship.?to|consignee|(?:account|card).?holder|नाम", "PERSON"),
    (f"^(?!.*{_S}(?:id|no|number|code|type|care|support|count|status|class|quota){_E}).*{_S}(?:customer|passenger|patient|payee|payer|nominee|sender|recipient)s?{_E}", "PERSON"),
)
_COMPILED = tuple((re.compile(p), cls) for p, cls in KEYWORDS)
_SEPARATORS = re.compile(r"[_\-\[\]]+")
HAYSTACK = ("label", "aria_label", "placeholder", "name", "id")


def _plain(value: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[_\-\[\]]+", " ")


@lru_cache(1 << 16)
def label_class(label: str) -> str | None:
    """The class that a label alone gives, for Arrow stages; labels come again and again, so each is judged once a worker."""
    text = _SEPARATORS.sub(" ", label.lower())
    return next((cls for pattern, cls in _COMPILED if pattern.search(text)), None)


def classify(type_: Column, autocomplete: Column, **names: Column) -> Column:
    """``struct<pii_class, source>``: autocomplete (its last known word) before type before keywords."""
    known = F.create_map(*[F.lit(x) for pair in AUTOCOMPLETE.items() for x in pair])
    words = F.filter(F.split(F.lower(F.coalesce(autocomplete, F.lit(""))), r"\s+"), lambda w: F.array_contains(F.map_keys(known), w))
    by_auto = F.try_element_at(known, F.try_element_at(words, F.lit(-1)))
    by_type = F.try_element_at(F.create_map(*[F.lit(x) for pair in INPUT_TYPES.items() for x in pair]), F.lower(F.coalesce(type_, F.lit(""))))
    hay = F.concat_ws(" | ", *[_plain(names.get(n, F.lit(None).cast("string"))) for n in HAYSTACK])
    by_word = F.lit(None).cast("string")
    for pattern, cls in reversed(KEYWORDS):
        by_word = F.when(hay.rlike(pattern), cls).otherwise(by_word)
    source = F.when(by_auto.isNotNull(), "autocomplete").when(by_type.isNotNull(), "type").when(by_word.isNotNull(), "keyword").otherwise("none")
    return F.struct(F.coalesce(by_auto, by_type, by_word).alias("pii_class"), source.alias("source"))
