"""All leak classes and both sides of the split, against brute force on a small table."""

import re
from collections import Counter

import pytest

from veilspark.functions import checks
from veilspark.operators import detect, native, tripwire
from veilspark.plans import catalog

TEXTS = [
    "mail a@b.com", "card 4111 1111 1111 1111 and 4111 1111 1111 1112", "2345 6789 0124", "2345 6789 0125", "ABCPE1234F", "call 9876543210 or a@b.com", "pay ravi@okaxis",
    "27ABCDE1234F1Z5", "sk-abcdefghijklmnopqrstuvwx", "call +91 98765 43210, ABCPE1234F", "plain", "", None,
]


def leaks(text):
    """The classes of one text, with Python's own patterns."""
    if text is None:
        return []
    digits = lambda v: re.sub("[^0-9]", "", v)
    valid = {"AADHAAR": checks.py_verhoeff, "CARD": checks.py_luhn}
    out = [k for k, p in tripwire.PATTERNS.items() if any(k not in valid or valid[k](digits(m[0])) for m in re.finditer(p, text))]
    return [k for k in out if k != "UPI" or "EMAIL" not in out]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("leaks"))
    rows = [(i, f"s{i % 2}", t) for i, t in enumerate(TEXTS)]
    spark.createDataFrame(rows, "doc_id long, source string, text string").write.parquet(f"{at}/documents.parquet")
    return at


def test_every_class_is_reported(spark, docs):
    got = sorted((r.doc_id, r.leak) for r in catalog.QUERIES["tripwire_leaks"](spark, docs).collect())
    assert got == sorted((i, k) for i, t in enumerate(TEXTS) for k in leaks(t))
    assert {k for _, k in got} == set(tripwire.PATTERNS)


def test_both_sides_are_counted(spark, docs):
    got = {(r.source, r.side): r.n for r in catalog.QUERIES["quarantine_sides"](spark, docs).collect()}
    assert got == Counter((f"s{i % 2}", "quarantine" if t is None or leaks(t) else "out") for i, t in enumerate(TEXTS))


def test_what_sanitising_leaves_is_counted_in_every_class(spark, docs, monkeypatch):
    whole = native.with_spans
    monkeypatch.setattr(native, "with_spans", lambda df, text: whole(df, text, exclude=("PHONE",)))
    left = []
    for t in filter(None, TEXTS):
        for s in reversed(detect.detect_text(t, frozenset(["PHONE"]))):
            t = f"{t[: s[0]]}[{s[2]}_1]{t[s[1] :]}"
        left += leaks(t)
    assert set(left) == {"PHONE", "GSTIN"}  # the detector wants a right check digit of a GSTIN
    assert catalog.QUERIES["tripwire_after_sanitize"](spark, docs).first()["left"] == len(left)


def test_full_sanitising_of_documents(spark, docs):
    want = {i: len(found) for i, t in enumerate(TEXTS) if (found := detect.detect_text(t))}
    got = {r.doc_id: r.n_tokens for r in catalog.QUERIES["sanitize_documents_full"](spark, docs).collect()}
    assert got == want
    classes = {s[2] for t in TEXTS for s in detect.detect_text(t)}
    assert {r.pii_class for r in catalog.QUERIES["vault_tokens_full"](spark, docs).collect()} == classes and len(classes) > 5
