"""Secrets in whole texts: assignments, access keys, long hex runs, and random strings found by their tokens.

The base kinds are patterns. The method adds kind ``random``: a run of ``[A-Za-z0-9+/_-]`` (with up to two
``=`` behind it) of at least ``MIN_CHARS`` characters that mixes letters with digits or cases is taken if
``100 * characters < RATIO * tokens`` under a public tiktoken vocabulary. Words and names of things
are made of few long tokens, random strings of many short ones. Known digests (whole hex runs of
a digest's length) and identifiers (UUIDs, account numbers with right check digits, timestamps) are left out, and so are
strings inside a base span. Base spans always stay.

Runs of a class are found by array operations on the bytes of many texts; only such runs, which are few,
go through the tokenizer, each distinct one once a task (within a bound).

Edge cases: a null text is empty: no spans, the digest of the empty string; texts of any length are scanned whole; a pattern never
reaches into the next text; repeated rows answer alike, each for itself; an empty table gives an empty result; further
columns are ignored. Offsets are code points, ends exclusive.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textvec as tv
from .workspace import pick

#: Patterns and least lengths of the base kinds (fixed values); texts are lower-cased for the first.
ASSIGN = re.compile(rb"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([a-z0-9+/_.=-]+)""")
ASSIGN_CHARS, ACCESS_CHARS, HEX_CHARS = 8, 16, 32
KINDS = ("assign", "access", "hex", "random")
MIN_CHARS = 16
#: Characters for a hundred tokens below which a string counts as random.
RATIO = 220
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Distinct strings whose verdict a task remembers.
MEMO = 200_000

#: Hex lengths of common digests (MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512) (fixed values).
DIGESTS = frozenset([32, 40, 56, 64, 96, 128])
_HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_TIME = re.compile(r"\d{4}-?\d\d-?\d\dT\d{2,6}(-\d\d)*Z?")
_ACCOUNT = re.compile(r"[A-Z]{2}\d\d[A-Z0-9]{11,30}")


def _table(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_DIGITS, _LOWER, _UPPER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_IS_HEX, _IS_ACCESS, _IS_RANDOM = _table(_DIGITS + b"abcdef"), _table(_DIGITS + _UPPER), _table(_DIGITS + _LOWER + _UPPER + b"+/_-")


def _runs(c: tv.Chunk, member: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of a class, of ``least`` bytes or more, that stay within a text."""
    inside = np.zeros(len(c.data) + 2, bool)
    inside[1:-1] = member[c.data]
    start = inside[1:-1] & ~inside[:-2]
    end = inside[1:-1] & ~inside[2:]
    full = c.off[:-1] < c.off[1:]
    first, last = c.off[:-1][full], c.off[1:][full] - 1
    start[first] |= inside[1:-1][first]
    end[last] |= inside[1:-1][last]
    a, b = np.flatnonzero(start), np.flatnonzero(end) + 1
    long = b - a >= least
    return a[long], b[long]


class Judge:
    """Whether a string is random by its tokens, with a bounded memory of verdicts."""

    def __init__(self, path: str):
        import public_tokenizers
        import tiktoken

        with open(path) as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bool] = {}

    def tokens(self, text: str) -> int:
        return len(self.encoding.encode_ordinary(text))

    def random(self, text: str) -> bool:
        got = self.known.get(text)
        if got is None:
            got = mixed(text) and not known_identifier(text) and 100 * len(text) < RATIO * self.tokens(text)
            if len(self.known) < MEMO:
                self.known[text] = got
        return got


def mixed(text: str) -> bool:
    """Letters with digits, or small with capital letters."""
    kinds = [any(x.isdigit() for x in text), any(x.islower() for x in text), any(x.isupper() for x in text)]
    return sum(kinds) >= 2


def known_identifier(text: str) -> bool:
    """A digest, UUID, timestamp, or an account number whose check digits (mod 97) are right."""
    if len(text) in DIGESTS and _HEX_ONLY.fullmatch(text) or _UUID.fullmatch(text) or _TIME.fullmatch(text):
        return True
    return bool(_ACCOUNT.fullmatch(text)) and int("".join(str(int(x, 36)) for x in text[4:] + text[:4])) % 97 == 1


def _chunk_spans(c: tv.Chunk, judge: Judge) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Kinds, starts and ends (bytes) of all spans of a chunk, and their texts, in the order of the result."""
    raw, low = c.data.tobytes(), tv.LOWER[c.data].tobytes()
    found = []
    for a, b in zip(c.off[:-1].tolist(), c.off[1:].tolist()):
        if b > a:
            found += [(0, m.start(), m.end()) for m in ASSIGN.finditer(low, a, b) if m.end(1) - m.start(1) >= ASSIGN_CHARS]
    for a, b in zip(*_runs(c, _IS_ACCESS, ACCESS_CHARS)):
        at = raw.find(b"AKIA", a, b)
        if at >= 0 and b - at >= ACCESS_CHARS:
            found.append((1, at, int(b)))
    found += [(2, int(a), int(b)) for a, b in zip(*_runs(c, _IS_HEX, HEX_CHARS))]
    base = np.array(sorted((s, e) for _, s, e in found), np.int64).reshape(-1, 2)
    reach = np.maximum.accumulate(base[:, 1]) if len(base) else base[:, 1]
    limit = c.off[1:]
    for a, b in zip(*_runs(c, _IS_RANDOM, MIN_CHARS)):
        if not judge.random(raw[a:b].decode()):
            continue
        stop = limit[np.searchsorted(c.off, a, "right") - 1]
        end = b
        while end < min(stop, b + 2) and raw[end] == 0x3D:
            end += 1
        at = np.searchsorted(base[:, 0], a, "right")
        if not at or reach[at - 1] < b:
            found.append((3, int(a), int(end)))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, none, none
    kind, start, end = np.array(found, np.int64).T
    text = np.searchsorted(c.off, start, "right") - 1
    order = np.lexsort((kind, start, text))
    return kind[order], start[order], end[order], text[order]


_FOUND = "n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_random long"
_NONE = hashlib.sha256(b"").hexdigest()


def _scan(vocabulary: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Judge(vocabulary)
        for batch in batches:
            parts = []
            for c in tv.chunks(batch.column(1)):
                kind, start, end, text = _chunk_spans(c, judge)
                lead = np.zeros(len(c.data) + 1, np.int64)
                np.cumsum((c.data & 0xC0) != 0x80, out=lead[1:])
                zero = lead[c.off[text]] if len(text) else text
                counts = np.zeros((4, c.n), np.int64)
                np.add.at(counts, (kind, text), 1)
                sums, lists = [_NONE] * c.n, [""] * c.n
                cut = np.searchsorted(text, np.arange(c.n + 1))
                named = [f"{KINDS[k]}:{s}:{e}" for k, s, e in zip(kind.tolist(), (lead[start] - zero).tolist(), (lead[end] - zero).tolist())]
                for d in np.unique(text).tolist():
                    own = range(cut[d], cut[d + 1])
                    lists[d] = ",".join(named[i] for i in own)
                    sums[d] = hashlib.sha256(",".join(named[i] for i in own if kind[i] < 3).encode()).hexdigest()
                parts.append(pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(c.lo, c.n), *[pa.array(counts[i]) for i in range(3)], pa.array(sums, pa.string()), pa.array(lists, pa.string()), pa.array(counts[3])],
                    names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random"],
                ))
            yield from parts

    return run


def scan(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, base_sha256, ``spans`` (kind:start:end, comma-joined) and n_random of every row.

    ``vocabulary`` is a tiktoken rank file that every executor has at that path.
    """
    if vocabulary is None:
        import public_tokenizers

        vocabulary = public_tokenizers.path(VOCABULARY)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(_scan(vocabulary), f"doc_id long, {_FOUND}")


def query(spark, sf_dir: str) -> DataFrame:
    return scan(pick(spark.read.parquet(f"{sf_dir}/documents.parquet"), "doc_id", "text"))
