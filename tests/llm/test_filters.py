"""Quality rules, near-duplicates and substring dedup against brute force."""

import hashlib
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from veilspark.llm import bpe, components, neardup, quality, substring, textvec
from veilspark.llm.exchange import Plan

from .fixtures import documents, table

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_counts(text):
    t = text or ""
    w = WORD.findall(t)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    n = Counter(grams)
    hit = {i + j for i, g in enumerate(grams) if n[g] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_quality_counts(spark):
    rows = documents()
    got = Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.score(table(spark)).collect())
    want = Counter()
    for r in rows:
        c = brute_counts(r[1])
        want[(r[0], *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert got == want


def test_quality_verdicts(spark):
    rows = quality.score(table(spark)).collect()
    assert not any(r.kept for r in rows if r.base_failed)
    clean = [r for r in rows if not r.base_failed and not r.n_symbols and not r.n_dup_lines and r.word_chars < 10 * r.n_words]
    assert clean and all(r.kept for r in clean)
    kept = quality.filter_documents(table(spark))
    assert kept.columns == table(spark).columns and kept.count() == sum(r.kept for r in rows)


def brute_verdicts(rows):
    """Host rates with the prior by moments, then each document against its host's limits."""
    counted = [(r[3], *brute_counts(r[1]), len([x for x in (r[1] or "").split("\n") if WORD.search(x)])) for r in rows]

    def breaks(c, x):
        low, high = quality.LENIENT, quality.STRICT
        symbols, dup, longest = [a + x * (b - a) for a, b in zip(low, high)]
        return 100 * c[3] > symbols * c[1] or 100 * c[4] > dup * c[6] or c[2] > longest * c[1]

    base = [c[1] < 50 or 100 * c[5] > 50 * c[1] for c in counted]
    hosts = {}
    for c, b in zip(counted, base):
        n, k = hosts.get(c[0], (0, 0))
        hosts[c[0]] = n + 1, k + (b or breaks(c, 1.0))
    total, fails = sum(n for n, _ in hosts.values()), sum(k for _, k in hosts.values())
    m = fails / total
    v = sum((k / n) ** 2 * n for n, k in hosts.values()) / total - m * m - m * (1 - m) * len(hosts) / total
    s = min(1000, max(2, m * (1 - m) / v - 1)) if v > 1e-9 else 1000
    strict = {h: round(min(1, max(0, ((k + m * s) / (n + s) - quality.SOUND) / (quality.FAILING - quality.SOUND))), 6) for h, (n, k) in hosts.items()}
    return [not b and not breaks(c, strict[c[0]]) for c, b in zip(counted, base)]


def test_verdicts_against_brute_force(spark):
    assert Counter(zip((r[0] for r in documents()), brute_verdicts(documents()))) == Counter((r.doc_id, r.kept) for r in quality.score(table(spark)).collect())
    text = lambda i, k: " ".join(f"w{i}x{j}" + ("#" if j < k else "") for j in range(60))
    rows = [(i, text(i, i % 50), "en", f"h{i % 7 * (i % 50 > 9)}", 1) for i in range(400)]
    got = {r.doc_id: r.kept for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert [got[r[0]] for r in rows] == brute_verdicts(rows) and len(set(got.values())) == 2


def test_failing_hosts_are_held_to_strict_limits(spark):
    text = lambda i, k: " ".join(f"w{i}x{j}" + ("#" if j < k else "") for j in range(60))
    rows = [(i, text(i, 20), "en", "bad", 1) for i in range(60)] + [(100 + i, text(i, 0), "en", "good", 1) for i in range(60)]
    rows += [(500, text(500, 20), "en", "good", 1), (501, text(501, 0), "en", "bad", 1)]
    got = {r.doc_id: r.kept for r in quality.score(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")).collect()}
    assert not got[0] and got[500] and got[501] and got[100]


def test_filter_keeps_rows_by_their_own_verdict(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "short"
    df = spark.createDataFrame([(5, good), (5, bad), (None, good), (None, None)], "doc_id long, text string").selectExpr("*", "'s' AS source", "1 AS host", "2 AS row", "3 AS kept", "4 AS counted")
    got = quality.filter_documents(df)
    assert got.columns == df.columns and Counter((r.doc_id, r.text, r["row"], r.kept) for r in got.collect()) == Counter([(5, good, 2, 3), (None, good, 2, 3)])


def shingles(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_neardup_against_brute_force(spark):
    """Rows are the nodes; a component is named by its smallest doc_id."""
    rows = [r for r in documents() if r[0] is not None]
    sets = [shingles(r[1]) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= 75 * len(a | b):
                parent[find(i)] = find(j)
    low = {}
    for i, r in enumerate(rows):
        low[find(i)] = min(low.get(find(i), r[0]), r[0])
    want = Counter((r[0], len(sets[i]), low[find(i)], r[0] == low[find(i)]) for i, r in enumerate(rows))
    got = neardup.classes(table(spark)).collect()
    assert Counter(tuple(r) for r in got if r.doc_id is not None) == want
    assert all(r.component_id is None for r in got if r.doc_id is None)
    kept = neardup.keep_one(table(spark))
    assert kept.columns == table(spark).columns


def test_neardup_chain_is_one_component(spark):
    """Each text is near the next one only; the smallest id of the chain is found."""
    w = [f"w{i}" for i in range(400)]
    rows = [(i, " ".join(w[i * 12 : i * 12 + 160])) for i in range(15)]
    got = {r.doc_id: r.component_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0}


def test_many_texts_that_share_a_passage_are_not_linked(spark):
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(i, passage + " " + " ".join(f"u{i}x{j}" for j in range(40))) for i in range(120)] + [(500, rows_text := passage + " " + " ".join(f"u7x{j}" for j in range(40))), (501, rows_text + " end")]
    got = {r.doc_id: r.component_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[500] == got[501] == 7 and sum(1 for v in got.values() if v == 7) == 3 and len(set(got.values())) == 120


def brute_removal(rows):
    starts = {}
    ws = [(r[0], WORD.findall(r[1] or "")) for r in rows]
    for d, w in ws:
        if d is not None:
            for i in range(len(w) - 12):
                g = tuple(w[i : i + 13])
                starts[g] = min(starts.get(g, d), d)
    out = Counter()
    for d, w in ws:
        gone = {i + j for i in range(len(w) - 12) for j in range(13) if d is not None and starts[tuple(w[i : i + 13])] < d}
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out[(d, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    return out


@pytest.mark.parametrize("plan", [None, Plan(1, 1), Plan(7, 11), Plan(9, 10, fan=4, salts=2)])
def test_substring_against_brute_force(spark, plan):
    got = Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.removals(table(spark), plan).collect())
    assert got == brute_removal(documents())


def test_substring_keeps_every_text_of_a_repeated_id(spark):
    text = [" ".join(f"{p}{i}" for i in range(30)) for p in "abc"]
    rows = [(1, text[0]), (5, "x " + text[0] + " tail"), (5, text[1]), (5, None), (5, text[2] + " " + text[0]), (None, text[0]), (0, text[2])]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "7 AS rest", "'z' AS _id", "length(text) AS n_chars")
    got = Counter(tuple(r) for r in substring.deduplicated(df, Plan(3, 5)).collect())
    want = Counter()
    for d, t in rows:
        new = {"x " + text[0] + " tail": "x tail", text[2] + " " + text[0]: ""}.get(t, t)
        want[d, new, 7, "z", None if new is None else len(new)] += 1
    assert got == want


def colliding(n):
    """A word and its complement that a polynomial hash modulo a power of two takes for equal."""
    word = "a"
    while len(word) < n:
        word += word.translate(str.maketrans("ab", "ba"))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048, 4096])
def test_long_words_are_told_apart(spark, n):
    a, b = colliding(n)
    rows = [(i, " ".join(["q"] * 12 + [w] + ["r"] * 12)) for i, w in enumerate((a, b))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.n_removed for r in substring.removals(df).collect()} == {0}
    assert brute_removal(rows) == Counter((r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in substring.removals(df).collect())
    short = spark.createDataFrame([(0, a), (1, b), (2, a)], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in neardup.classes(short).collect()} == {0: 0, 1: 1, 2: 0}
    for name in ("byte_bpe_50k.json", "word_bpe_49k.json"):
        enc, plain = bpe.encoder(public_tokenizers.path(name)), Tokenizer.from_file(public_tokenizers.path(name))
        (c,) = textvec.chunks(pa.array([a, b, a]))
        ids, docs = enc.encode(c)
        assert [ids[docs[i] : docs[i + 1]].tolist() for i in range(3)] == [plain.encode(x, add_special_tokens=False).ids for x in (a, b, a)]


def test_span_hashes_are_those_of_the_bytes():
    rng = np.random.default_rng(4)
    data = rng.integers(97, 99, 3000).astype(np.uint8)
    start = rng.integers(0, 2700, 4000)
    end = start + rng.integers(1, 300, 4000) * rng.integers(0, 2, 4000) + rng.integers(0, 20, 4000)
    end = np.minimum(end, len(data))
    for seed in (0, 1):
        by = {}
        for h, s, e in zip(textvec.spans(data, start, end, seed).tolist(), start, end):
            by.setdefault(data[s:e].tobytes(), set()).add(h)
        assert all(len(v) == 1 for v in by.values()) and len({h for v in by.values() for h in v}) == len(by)


def test_small_sets_never_miss_a_link(spark):
    """3 of 4 shingles in common, 200 such pairs: bands alone would lose one in ten thousand, the prefix loses none."""
    rows = [(i * 2 + k, " ".join([f"{i}w{j}" for j in range(7)] + ["end"] * k)) for i in range(200) for k in (0, 1)]
    got = {r.doc_id: r.component_id for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(got[i * 2 + 1] == got[i * 2] == i * 2 for i in range(200))


def test_keep_one_judges_rows(spark):
    near, other = "one text of the first document here", "something else entirely in this text now"
    rows = [(1, near), (5, near), (5, other), (5, other), (7, other), (None, near), (None, None), (9, None), (9, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS set_a", "2 AS node", "3 AS bands")
    got = Counter((r.doc_id, r.text) for r in neardup.keep_one(df).collect())
    assert got in [Counter([(1, near), (5, other), (None, near), (None, None), (9, t)]) for t in (None, "")]


def test_components_with_hot_nodes(spark, monkeypatch):
    """Hubs and large components through the broadcast of their labels."""
    monkeypatch.setattr(components, "HOT_ROWS", 20)
    monkeypatch.setattr(components, "HOT_SHARE", 50)
    edges = [(0, i) for i in range(1, 200)] + [(i, i + 1) for i in range(300, 330)] + [(400, 401), (401, 400), (None, 5), (330, 150)]
    got = {r.node: r.label for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in [*range(200), *range(300, 331)]} | {400: 400, 401: 400}


def test_empty_tables(spark):
    none = table(spark, [])
    assert quality.score(none).count() == neardup.classes(none).count() == substring.removals(none).count() == 0
    assert quality.filter_documents(none).count() == neardup.keep_one(none).count() == substring.deduplicated(none).count() == 0
