"""Main text, language, fingerprints; the pipeline and the registry."""

import hashlib
import importlib

import numpy as np
import pytest

from veilspark.llm import fingerprint, htmltext, langid, registry, textvec

from .fixtures import documents, table

PAGES = [
    ("<html><head><title>t</title><style>p{}</style></head><body><nav><ul><li>Home</ul></nav><article><h1>A &amp; B</h1><p>one <b>two</b>\n three<br>four<p>five</article><footer>f</footer></body>", "A & B\none two three four\nfive"),
    ("<body><header><h1>Site</h1></header><main><article><header><h1>T</h1></header><p>x &lt;y&gt; 5 < 6</p><form><input>q</form><div class='ad-slot'>buy</div></article><section id=comments><article class=comment>no</article></section></main>", "T\nx <y> 5 < 6"),
    ("<div id=wrap><div class=sidebar>x</div><div class=post><p>Hello world<ul><li>x<li>y</ul></div><div class=comments>c</div></div>", "Hello world\nx\ny"),
    ("<main><p>a</p><script>if (1 < 2) '</p>'</script><!-- <p>z</p> --><aside>b</aside><p hidden>c</p><p>d&nbsp;e&#x41;</p></main>", "a\nd eA"),
    ("plain text", "plain text"), ("", ""), (None, ""),
]


@pytest.mark.parametrize("html,want", PAGES)
def test_parse(html, want):
    text, blocks = htmltext.parse(html) if html else ("", [])
    assert (text if text is not None else "\n".join(t for k, t in blocks if k != "d")) == want


def test_extract_drops_runs_repeated_on_a_host(spark):
    soup = lambda i: f"<div>Home</div><div>About us now</div><div>Contact all people here</div><div><p>{' '.join(f'w{i}x{j}' for j in range(40))}</p></div><div>2020 h com all rights reserved forever</div>"
    rows = [(i, f"http://h.com/{i}", soup(i), "x") for i in range(6)] + [(6, "http://h.com/6", soup(5), "x"), (7, None, None, "x"), (8, "http://z", "<p>alone", "x"), (8, "http://z", "<p>alone", "x"), (None, "u", "<article>é</article>", "x")]
    got = htmltext.extract(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows) and all(by[i].text == " ".join(f"w{i}x{j}" for j in range(40)) for i in range(6)) and by[6].text == by[5].text
    assert by[7].text == "" and by[8].text == "alone" and by[None].n_chars == 1
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_pages_of_the_test_data(spark, sf):
    import re
    from html import unescape

    got = {r.page_id: r.text for r in htmltext.query(spark, sf).collect()}
    for r in spark.read.parquet(f"{sf}/pages.parquet").collect():
        body = re.search("<article>(.*)</article>", r.html, re.S)[1].replace("<br>", " ")
        parts = [" ".join(unescape(re.sub("<[^>]*>", "", x)).split()) for x in re.split("</?(?:p|h1)>", body)]
        assert got[r.page_id] == "\n".join(x for x in parts if x)


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    held = [r for r in langid.query(spark, sf).collect() if r.held_out]
    assert len(held) > 100 and sum(truth[r.doc_id] == r.lang_pred for r in held) / len(held) > 0.97 and all(0 <= r.score <= 1 for r in held)


def test_language_edges(spark):
    rows = table(spark)
    got = langid.predict(rows, langid.fit(rows, 200)).collect()
    assert len(got) == len(documents())
    blank = [(r[0]) for r in documents() if not (r[1] or "").strip()]
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in blank and r.doc_id is not None)
    none = table(spark, [])
    assert langid.fit(none) is None and langid.predict(none, None).count() == 0
    assert {r.lang_pred for r in langid.predict(rows, None).collect()} == {"und"}


def test_fingerprints_against_brute_force(spark):
    rows = [r for r in documents() if r[0] is not None]
    rows = sorted({(r[0], r[1] or "") for r in rows})
    want = {}
    for i, (d, t) in enumerate(rows):
        other = rows[i - 1][1]
        new = t[: len(t) - len(t) // 2] + other[: len(t) // 2]
        fp = [fingerprint.fingerprint(np.frombuffer(x.encode(), np.uint8)) for x in (t, new, other)]
        want[d] = (len(t), hashlib.sha256(new.encode()).hexdigest(), fp[0], fp[1], fingerprint.likeness(fp[0], fp[1]), fingerprint.likeness(fp[0], fp[2]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r.doc_id: tuple(r)[1:] for r in fingerprint.compare_edits(df, 2000).collect()} == want
    assert fingerprint.compare_edits(table(spark)).count() == len(documents())
    assert fingerprint.compare_edits(table(spark, [])).count() == 0


def test_likeness():
    fp = lambda t: fingerprint.fingerprint(np.frombuffer(t.encode(), np.uint8))
    from .fixtures import words
    import random

    a, b = words(random.Random(1), 400), words(random.Random(2), 400)
    assert fingerprint.likeness(fp(a), fp(a)) == 1 and fingerprint.likeness(fp(a), fp(b)) == 0
    assert fingerprint.likeness(fp(a), fp(a[:500] + "X" + a[500:])) > 0.9
    assert fingerprint._common("abcde", "xaxcxe") == 3


def test_chunks_never_cut_a_document():
    import pyarrow as pa

    texts = ["a" * 50, "", None, "b c", "d" * 500, "é"]
    for limit in (1, 60, 10_000):
        parts = list(textvec.chunks(pa.array(texts), limit))
        assert [c.lo for c in parts] == [0, *[c.hi for c in parts[:-1]]] and parts[-1].hi == len(texts)
        assert b"".join(c.data.tobytes() for c in parts) == "".join(t or "" for t in texts).encode()


def test_pipeline(spark, sf):
    try:
        pipe = importlib.import_module("corpus_pipeline")
    except ModuleNotFoundError:
        pytest.skip("no pipeline")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    counts, ids = [docs.count()], {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in pipe.STAGES[:-1]:
        docs = pipe.written(stage(spark, docs, sf), "test")
        assert docs.columns == list(pipe.COLUMNS)
        kept = {r.doc_id for r in docs.select("doc_id").collect()}
        assert kept <= ids
        ids = kept
        counts.append(docs.count())
    assert counts[0] > counts[1] > counts[2] == counts[3]
    packed = pipe.STAGES[-1][1](spark, docs, sf)
    run = pipe.run(spark, sf)
    assert run.columns == packed.columns
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    assert sorted(map(tuple, run.select(*key).collect())) == sorted(map(tuple, packed.select(*key).collect()))


def test_registry():
    assert sorted(int(n[2:].split("_")[0]) for n in registry.QUERIES) == list(range(1, 14)) and set(registry.ORACLE) <= set(registry.QUERIES)
