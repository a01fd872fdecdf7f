"""Main text, language and fingerprints against plain loops; the pipeline's stages on odd rows."""

import importlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from veilspark.llm import fingerprint, htmltext, langid
from veilspark.llm.exchange import Plan

from .fixtures import documents, words


def common_prefix(a, b):
    n = 0
    while n < min(len(a), len(b)) and a[n] == b[n]:
        n += 1
    return n


def suffix_array_texts(pages):
    """Texts of pages without an article by a true suffix array of each host: sorted suffixes, common prefixes, pages of each run."""
    hosts = {}
    for ident, (host, blocks) in pages.items():
        hosts.setdefault(host, {}).setdefault(tuple(blocks), []).append(ident)
    out = {}
    for host, streams in hosts.items():
        tokens = [[t for b in blocks for t in [*b.split(" "), None]] for blocks in streams]
        array = sorted(((s, i) for s in range(len(tokens)) for i in range(len(tokens[s]))), key=lambda x: [str(t) for t in tokens[x[0]][x[1] :]])
        least = htmltext.PAGES
        covered = [set() for _ in tokens]
        at = 0
        while at < len(array):
            end = at + 1
            while end < len(array) and common_prefix(*[tokens[s][i:] for s, i in array[end - 1 : end + 1]]) >= htmltext.RUN:
                end += 1
            run = [(s, i) for s, i in array[at:end] if i + htmltext.RUN <= len(tokens[s])]
            if len({s for s, _ in run}) >= least:
                for s, i in run:
                    covered[s] |= set(range(i, i + htmltext.RUN))
            at = end
        for s, (blocks, idents) in enumerate(streams.items()):
            k, kept = 0, []
            for b in blocks:
                own = b.split(" ")
                gone = "".join("x" if k + j in covered[s] else "." for j in range(len(own)))
                if set(gone) != {"x"}:
                    gone = re.sub("x+", lambda m: m[0] if len(m[0]) >= htmltext.RUN else "." * len(m[0]), gone)
                kept.append(" ".join(w for w, g in zip(own, gone) if g == "."))
                k += len(own) + 1
            for ident in idents:
                out[ident] = "\n".join(t for t in kept if t)
    return out


@pytest.mark.parametrize("plan", [None, Plan(5, 7, fan=2, salts=2)])
def test_pages_against_a_suffix_array(spark, plan):
    rng = random.Random(8)
    menu, foot, common = words(rng, 9), words(rng, 14), words(rng, 30)
    pages = {}
    for i in range(60):
        host = rng.choice(["big.example", "big.example", "mid.example", f"one{i}.example"])
        text = [words(rng, rng.randint(3, 25)) for _ in range(rng.randint(1, 4))]
        if rng.random() < 0.4:
            text[0] += " " + " ".join(common.split()[rng.randrange(10) :])
        blocks = [b for b in [menu if rng.random() < 0.8 else None, *text, foot if rng.random() < 0.7 else None] if b]
        pages[i] = host, blocks
    for i in range(60, 66):
        pages[i] = pages[i - 60]
    rows = [(i, f"https://{h}/{i}", "".join(f"<div>{b}</div>" for b in blocks)) for i, (h, blocks) in pages.items()]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4), plan).collect()}
    want = suffix_array_texts(pages)
    assert got == want and any(len(want[i]) < len("\n".join(b)) for i, (_, b) in pages.items())


def test_weak_blocks_go_only_if_the_host_repeats_them(spark):
    page = lambda i: f"<article><p>Story {' '.join(f'u{i}x{j}' for j in range(20))}</p><div class=related-work>Read more about all this on our pages</div><p class=copyright-law>Law {' '.join(f'l{i}x{j}' for j in range(9))}</p></article>"
    rows = [(i, "http://h.example/", page(i)) for i in range(8)] + [(9, "http://z.example/", page(9))]
    got = {r.page_id: r.text for r in htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    own = lambda i: ["Story " + " ".join(f"u{i}x{j}" for j in range(20)), "Law " + " ".join(f"l{i}x{j}" for j in range(9))]
    assert all(got[i].split("\n") == own(i) for i in range(8))
    assert got[9].split("\n") == [own(9)[0], "Read more about all this on our pages", own(9)[1]]


M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def naive_mix(h):
    for k in (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53):
        h ^= h >> 33
        h = h * k & M64
    return h ^ h >> 33


def naive_fingerprint(text):
    data = text.encode()
    table = [int(x) for x in fingerprint._BYTE]
    if not data:
        return "3::"
    rolled = []
    for i in range(len(data)):
        h = sum((table[data[i - j]] >> 32) * pow(0x9E3779B1, j, 1 << 32) for j in range(min(7, i + 1))) & M32
        h ^= h >> 15
        h = h * 0x85EBCA6B & M32
        rolled.append(h ^ h >> 13)
    block = 3
    while block * 64 < len(data):
        block *= 2
    while block > 3 and sum(h % block == block - 1 for h in rolled) < 32:
        block //= 2
    out = []
    for size, most in ((block, 64), (2 * block, 32)):
        text, begin = "", 0
        for i, h in enumerate(rolled):
            last = i == len(data) - 1
            if last or h % size == size - 1 and h % block == block - 1 and len(text) < most - 1:
                total = sum(table[data[k]] * pow(0x9E3779B97F4A7C15, k - begin, 1 << 64) for k in range(begin, i + 1)) & M64
                text += "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"[naive_mix(total) >> 58]
                begin = i + 1
        out.append(text)
    return f"{block}:{out[0]}:{out[1]}"


def naive_alike(a, b):
    if a == b:
        return 1.0
    if not any(a[i : i + 7] in b for i in range(len(a) - 6)):
        return 0.0
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(row[j - 1] if x == y else 1 + min(row[j], new[-1]))
        row = new
    return 1 - row[-1] / (len(a) + len(b))


def naive_likeness(x, y):
    (bx, x1, x2), (by, y1, y2) = x.split(":"), y.split(":")
    pairs = {bx: (x1,), str(2 * int(bx)): (x2,)}, {by: (y1,), str(2 * int(by)): (y2,)}
    both = [naive_alike(a, b) for k in pairs[0] for a in pairs[0][k] for b in pairs[1].get(k, ()) if a and b or x == y]
    return max(both, default=0.0)


def test_fingerprints_against_plain_loops():
    rng = random.Random(3)
    texts = ["", "a", "abc def", words(rng, 30), words(rng, 300), words(rng, 900), "x" * 700, "\u00e9\u65e5" * 200] + [words(rng, rng.randint(1, 200)) for _ in range(10)]
    texts += [t[: len(t) // 2] + "Z" + t[len(t) // 2 :] for t in texts]
    made = [fingerprint.fingerprint(fingerprint._bytes(t)) for t in texts]
    assert made == [naive_fingerprint(t) for t in texts]
    for a in made:
        for b in made:
            assert abs(fingerprint.likeness(a, b) - naive_likeness(a, b)) < 1e-12, (a, b)


def naive_network(p, x):
    """One window through embedding, filters, maximum and softmax, value by value."""
    hidden, f = [], 0
    for width in langid.WIDTHS:
        for _ in range(langid.PER_WIDTH):
            peak = max(sum(float(p["embed"][x[at + k], e]) * float(p["conv"][k, e, f]) for k in range(width) for e in range(langid.EMBED)) for at in range(len(x) - max(langid.WIDTHS) + 1))
            hidden.append(max(0.0, peak + float(p["bias"][f])))
            f += 1
    z = [sum(h * float(p["out"][i, c]) for i, h in enumerate(hidden)) + float(p["out_bias"][c]) for c in range(p["out"].shape[1])]
    e = np.exp(np.array(z) - max(z))
    return e / e.sum()


def test_network_against_plain_loops():
    rng = np.random.default_rng(6)
    p, x = langid.start(3, rng), rng.integers(0, 256, (4, 20)).astype(np.uint8)
    model = langid.Model(["a", "b", "c"], **p)
    assert np.allclose(langid.probabilities(model, model.tables(), x), [naive_network(p, r) for r in x], atol=1e-4)


def test_gradients_are_those_of_small_steps():
    rng = np.random.default_rng(9)
    p = {k: v.astype(np.float64) for k, v in langid.start(3, rng).items()}
    x, y = rng.integers(0, 9, (6, 24)).astype(np.uint8), np.array([0, 1, 2, 0, 1, 2])

    def loss(q):
        return -np.mean([np.log(naive_network(q, r)[c]) for r, c in zip(x, y)])

    got = langid.gradients(p, x, y)
    for name in p:
        flat = np.flatnonzero(np.abs(got[name]).ravel() > 1e-3)
        for at in rng.choice(flat, min(3, len(flat)), replace=False):
            step = 1e-5
            ends = []
            for sign in (1, -1):
                q = {k: v.copy() for k, v in p.items()}
                q[name].ravel()[at] += sign * step
                ends.append(loss(q))
            # Tables are 32-bit numbers, so a little is lost.
            assert abs((ends[0] - ends[1]) / (2 * step) - got[name].ravel()[at]) < 2e-3, name


def pipeline():
    try:
        return importlib.import_module("corpus_pipeline")
    except ModuleNotFoundError:
        pytest.skip("no pipeline")


ODD = "doc_id long, text string, lang string, source string, n_chars long, _id int, host string, row string, file long, rest string"


def test_pipeline_on_odd_rows(spark):
    pipe = pipeline()
    long, other = " ".join(f"x{i}" for i in range(300)), " ".join(f"y{i}" for i in range(300))
    texts = [(None, None, None), (1, None, "s"), (2, "word " * 200, None), (2, long, "s"), (2, other, "s"), (3, other, None), (3, other, None), (None, other, None), (4, "z" * 2_000_000 + " " + long, "s"), (5, "", "s")]
    rows = [(d, t, "en", s, len(t or ""), 1, "h", "r", 7, "x") for d, t, s in texts]
    for docs in (spark.createDataFrame(rows, ODD), spark.createDataFrame([], ODD)):
        for name, stage in pipe.STAGES[:-1]:
            before, docs = docs, pipe.written(stage(spark, docs, None), "odd")
            assert docs.columns == before.columns
            if name == "quality rules":
                quality = Counter(r.doc_id for r in docs.collect())
            if name == "minhash near-dedup":
                near = Counter((r.doc_id, r.text[:3]) for r in docs.collect())
            if name == "substring dedup":
                got = sorted(((r.doc_id, r.n_chars == len(r.text)) for r in docs.collect()), key=str)
        packed = pipe.STAGES[-1][1](spark, docs, None).collect()
        if rows:
            assert quality == Counter([2, 2, 3, 3, None])
            assert near[2, "x0 "] == 1 and near[None, "y0 "] == 1 and sum(n for (_, t), n in near.items() if t == "y0 ") == 2
            assert all(same for _, same in got) and len(got) == sum(near.values())
            assert all(0 < r.length <= 1024 for r in packed)
        else:
            assert not quality and not near and not packed
        rows = []


def test_stages_that_are_not_stored_in_between(spark):
    """A stage over the unstored result of another still finds the tables that it reads."""
    pipe = pipeline()
    rows = [(r[0], r[1], r[2], r[3], r[4], 1, "h", "r", 7, "x") for r in documents()]
    one = pipe.STAGES[1][1](spark, pipe.STAGES[0][1](spark, spark.createDataFrame(rows, ODD), None), None)
    two = pipe.STAGES[2][1](spark, one, None)
    assert two.count() == one.count() > 0
