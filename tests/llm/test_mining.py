"""Secret scans, hard negatives and collocations against plain loops, and their edge cases."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from veilspark.llm import collocation, negatives, secretscan
from veilspark.llm.exchange import Plan

from .fixtures import documents, table, words

# --- secrets

KEY = "AKIA" + "ABCDEFGHIJKL"
HEX = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff"
RANDOM = "q7Xv9Lk2Zt4Rb8Wm3Np6"


def plain_spans(text, judge):
    """All spans of a text by plain regular expressions over its characters."""
    text = text or ""
    out = []
    for m in re.finditer(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text):
        if len(m[2]) >= 8:
            out.append(("assign", m.start(), m.end()))
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    base = list(out)
    for m in re.finditer("([A-Za-z0-9+/_-]{16,})={0,2}", text):
        if judge.random(m[1]) and not any(a <= m.start() and m.end(1) <= b for _, a, b in base):
            out.append(("random", m.start(), m.end()))
    kinds = ["assign", "access", "hex", "random"]
    return sorted(out, key=lambda x: (x[1], kinds.index(x[0])))


@pytest.fixture(scope="module")
def judge():
    import public_tokenizers

    return secretscan.Judge(public_tokenizers.path(secretscan.VOCABULARY))


def secret_texts():
    rng = random.Random(5)
    planted = [f'token = "{HEX}"', f"PassWord:{RANDOM}", f"key {KEY}", f"x{KEY}y", f"é {RANDOM}==", f"sha {HEX}", "api_key=short", "apikey= 'abcdefgh'", "token=token=abcdefgh", "AKIA", "AKIAAKIAAKIAAKIA",
               "id 123e4567-e89b-12d3-a456-426614174000", "IBAN DE89370400440532013000", "at 2024-01-02T10-20-30-40", "1234567890123456789", "secret", "ſecret=abcdefghij", "toKen=abcdefghij", "=" * 40, "INTERNATIONALIZATION", "internationalization2 handling_of_requests_2"]
    texts = [*planted, *[words(rng, 5) + " é " + p + ", " + words(rng, 4) for p in planted], "", None, "  \n", "pass", "word=abcdefghij", "tok", "en=" + HEX]
    return texts + [f"{words(rng, 150_000)} {RANDOM} {words(rng, 150_000)} token={HEX}" + "x" * 300_000]


def test_secrets_against_plain_patterns(spark, judge):
    texts = secret_texts()
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(3)
    got = {r["doc_id"]: r for r in secretscan.scan(rows).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        want = plain_spans(t, judge)
        count = Counter(k for k, _, _ in want)
        assert got[i]["spans"] == ",".join(f"{k}:{a}:{b}" for k, a, b in want), t and t[:200]
        assert [got[i][n] for n in ("n_assign", "n_access", "n_hex", "n_random")] == [count[k] for k in ("assign", "access", "hex", "random")]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in want if k != "random").encode()).hexdigest()


def test_random_strings_by_their_tokens(judge):
    rng = random.Random(1)
    alphabet = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    caught = [judge.random("".join(rng.choice(alphabet) for _ in range(24))) for _ in range(500)]
    assert sum(caught) >= 490
    for known in (HEX, "d41d8cd98f00b204e9800998ecf8427e", "123e4567-e89b-12d3-a456-426614174000", "DE89370400440532013000", "4111111111111111", "handling_of_requests_in_version_2", "InternationalBusinessMachines", "INTERNATIONALISATION"):
        assert not judge.random(known), known


def test_secrets_of_odd_rows(spark):
    docs = table(spark)
    assert secretscan.scan(docs).count() == len(documents())
    empty = secretscan.scan(docs.where("false"))
    assert empty.columns[:6] == ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"] and empty.count() == 0


# --- hard negatives


def plain_negatives(rows):
    """(anchor, positive, rank, negative, scores) by plain loops over (vec_id, label, vector)."""
    import math

    taken = [(i, (label + 1) % 10 if i % 7 == 0 else label, [math.floor(256 * x) for x in v]) for i, label, v in rows if i is not None and label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for anchor in {(i, c, tuple(v)) for i, c, v in taken if i % 100 == 0}:
        scored = sorted((-sum(a * b for a, b in zip(anchor[2], v)), i, c) for i, c, v in taken)
        positives = [(i, -s) for s, i, c in scored if c == anchor[1] and i != anchor[0]][:5]
        for p, high in positives:
            found = [(i, -s) for s, i, c in scored if c != anchor[1] and 80 * high <= -100 * s <= 100 * high][:5]
            out += [(anchor[0], p, k + 1, i, high, s) for k, (i, s) in enumerate(found)]
    return sorted(out)


VECTORS = "vec_id long, embedding array<{}>, label int, anchor int, slot int, score long, rank int"


def vector_rows(seed=2, n=420, scale=1.0):
    rng = np.random.default_rng(seed)
    common = rng.normal(size=6) * scale
    rows = []
    for i in range(n):
        v = (common if i % 3 == 0 else common + rng.normal(size=6) * scale * 0.4).astype(np.float32)
        rows.append((i, [float(x) for x in v], int(rng.integers(0, 4)) if i % 3 else 1, 1, 1, 1, 1))
    odd = [(1000, None, 1), (1001, [1.0, None], 1), (1002, [float("nan"), 1.0], 1), (1003, [float("inf")], 2), (1004, [1.0] * 6, None), (None, [1.0] * 6, 1), (1005, [], 1), (1006, [1.0, 2.0], 1), (1100, [0.5] * 9, 3), (-100, [1.0] * 6, 2), (-7, [1.0] * 6, -3)]
    rows += [(i, v, c, None, None, None, None) for i, v, c in odd]
    return [*rows, rows[3], rows[100], rows[201]]


def mined(rows, kind="float"):
    def run(spark):
        df = spark.createDataFrame(rows, VECTORS.format(kind)).repartition(3)
        from pyspark.sql import functions as F

        return sorted(tuple(r) for r in negatives.mine(df, negatives.relabelled(F.col("label").cast("long"), F.col("vec_id"))).collect())

    return run


@pytest.mark.parametrize("anchor_bytes", [1 << 20, 150])
def test_negatives_against_plain_loops(spark, monkeypatch, anchor_bytes):
    """Ties, repeated rows and one very common vector, in one round and in many."""
    monkeypatch.setattr(negatives, "ANCHOR_BYTES", anchor_bytes)
    rows = vector_rows()
    want = plain_negatives([(r[0], r[2], r[1]) for r in rows])
    assert len(want) > 50 and mined(rows)(spark) == want



@pytest.mark.parametrize("scale", [3e5, 2e6])
def test_negatives_of_large_components(spark, scale):
    """Sums beyond 2^53 are exact."""
    rows = [r for r in vector_rows(4, 300, scale) if r[0] is None or r[0] >= 0]
    want = plain_negatives([(r[0], r[2], r[1]) for r in rows])
    assert max(abs(x[4]) for x in want) > 1 << 50 and mined(rows, "double")(spark) == want


def test_products_in_every_width():
    rng = np.random.default_rng(1)
    for top in (10, 1 << 24, 1 << 29, 1 << 30):
        a, b = rng.integers(-top, top, (5, 4)).astype(float), rng.integers(-top, top, (7, 4)).astype(float)
        assert negatives.products(a, b).tolist() == [[sum(int(x) * int(y) for x, y in zip(p, q)) for q in b] for p in a]
    with pytest.raises(ArithmeticError):
        negatives.products(np.full((1, 4), float(1 << 40)), np.full((1, 4), float(1 << 40)))


def test_lists_merge():
    rng = np.random.default_rng(3)
    scores, ids = rng.integers(0, 9, (4, 300)), rng.permutation(300)
    whole, one, two = [negatives.Best(4) for _ in range(3)]
    whole.offer(0, scores, ids, np.ones_like(scores, bool))
    one.offer(0, scores[:, :120], ids[:120], np.ones((4, 120), bool))
    two.offer(0, scores[:, 120:], ids[120:], np.ones((4, 180), bool))
    for g in range(4):
        one.offer(g, two.score[g : g + 1], two.ids[g], np.ones((1, 5), bool))
    want = [sorted(zip(-scores[g], ids))[:5] for g in range(4)]
    assert whole.ids.tolist() == one.ids.tolist() == [[i for _, i in w] for w in want]


def test_negatives_of_no_rows(spark):
    df = spark.createDataFrame([], VECTORS.format("float"))
    out = negatives.mine(df)
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"] and out.count() == 0
    assert negatives.mine(spark.createDataFrame([(100, [1.0], 1)], "vec_id long, embedding array<float>, label int")).count() == 0


# --- collocations


def plain_collocations(rows, top=2000):
    f, n = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            ws = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(ws)
            for k in range(1, 5):
                for i in range(len(ws) - k + 1):
                    p = (lang, tuple(ws[i : i + k]))
                    f[p] = f.get(p, 0) + 1
    out = {}
    frequent = {p: a for p, a in f.items() if a >= 30 and len(p[1]) > 1}
    around = {}
    for (lang, ws), a in frequent.items():
        for k in range(2, len(ws)):
            for i in range(len(ws) - k + 1):
                key = (lang, ws[i : i + k])
                around[key] = max(around.get(key, 0), a)
    for (lang, ws), a in frequent.items():
        if 100 * around.get((lang, ws), 0) >= 80 * a and (lang, ws) in around:
            continue
        score, _, left, right = min((2_000_000 * a // (f[lang, ws[:k]] + f[lang, ws[k:]]), k, f[lang, ws[:k]], f[lang, ws[k:]]) for k in range(1, len(ws)))
        out.setdefault(lang, []).append((-score, -a, " ".join(ws).encode(), left, right))
    return sorted((lang, i + 1, p.decode(), -a, left, right, n[lang], -s) for lang, found in out.items() for i, (s, a, p, left, right) in enumerate(sorted(found)[:top]))


def phrase_rows():
    rng = random.Random(8)
    few = ["alpha", "Beta", "gamma", "é", "ÉÀ", "x" * 300, "日本", "b-c"]
    rows = []
    for i in range(260):
        parts = [rng.choice(few[: 2 + i % 7]) for _ in range(rng.randint(1, 60))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ". ", ",", "\n", "\x0b"]) for w in parts)
        rows.append((rng.choice(["en", "de", None, "und", ""]), text))
    return [*rows, *[("en", "one two three four five. six")] * 40, *[("en", "two three")] * 5, ("en", None), (None, ""), ("de", " \t.,;"), ("fr", "only once here"), *[("xx", "a a a a a a")] * 12]


def collocated(spark, rows, **more):
    df = spark.createDataFrame([(*r, 1, "p", 2, 3, "w") for r in rows], "lang string, text string, rank int, phrase string, size int, f int, words string").repartition(3)
    return sorted(tuple(r) for r in collocation.mine(df, **more).select("lang", "rank", "phrase", "a", "l", "r", "n", "score").collect())


@pytest.mark.parametrize("more", [{}, {"shard_words": 50, "plan": Plan(3, 5, fan=2, salts=2)}, {"shard_words": 700, "plan": Plan(2, 32)}])
def test_collocations_against_plain_counts(spark, monkeypatch, more):
    rows = phrase_rows()
    want = plain_collocations(rows)
    assert len({r[0] for r in want}) >= 4 and any(len(r[2].split(" ")) == 4 for r in want)
    if more:
        monkeypatch.setattr(collocation, "PAIRED", 64)
    assert collocated(spark, rows, **more) == want


def test_the_first_phrases_only(spark):
    rows = phrase_rows()
    assert collocated(spark, rows, top=3) == plain_collocations(rows, 3)


def test_one_long_text_of_one_language(spark):
    rng = random.Random(3)
    vocabulary = words(rng, 400).split()
    text = " ".join(rng.choices(vocabulary, [1 / (k + 1) for k in range(400)], k=260_000))
    text = "".join(w + ("," if i % 97 == 0 else " ") for i, w in enumerate(text.split()))
    assert len(text) > 1 << 20
    rows = [("en", text)]
    assert collocated(spark, rows, shard_words=20_000) == plain_collocations(rows)


def test_collocations_of_no_rows(spark):
    assert collocated(spark, [("en", None), (None, "")]) == []
    df = spark.createDataFrame([], "lang string, text string")
    assert collocation.mine(df).columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and collocation.mine(df).count() == 0


def test_shifting_crosses_blocks_and_stops_at_ends():
    ids = np.array([0, 1] * 40)
    ends = np.zeros(80, bool)
    ends[[31, 79]] = True
    shard = collocation.Shard(1, "en", [b"a", b"b"], ids, ends, np.array([1, 2], np.uint64))
    miner = collocation.Miner(shard)
    found = {}
    for root in miner.roots():
        level = miner.extended(root)
        found |= {tuple(w): int(c) for w, c in zip(level.words.tolist(), level.count)}
    assert found == {(0, 1): 40, (1, 0): 38}
