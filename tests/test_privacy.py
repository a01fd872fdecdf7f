"""Tokens, sanitising, URLs, policy, audit, pages."""

import json

from pyspark.sql import functions as F

from veilspark.operators import capture, detect, layout, metrics, names, policy, protocol, sanitize, tripwire, vault, vision
from veilspark.sources import formats, pages


def test_sanitize_and_reveal(spark):
    rows = [(1, "v", "mail a@b.com and A@B.COM, c@d.org [PAN_3] done"), (2, "v", "[EMAIL_9] c@d.org"), (3, "w", None), (4, "w", "")]
    out, table = sanitize.sanitize(spark.createDataFrame(rows, "id long, vault string, text string"), "id", "vault")
    got = {r.id: r for r in out.collect()}
    assert got[1].text == "mail [EMAIL_1] and [EMAIL_1], [EMAIL_2] (PAN-3) done"
    assert got[2].text == "(EMAIL-9) [EMAIL_2]"
    assert [tuple(x) for x in got[1].forged] == [(34, 41)]
    back = {r.id: r.text for r in vault.reveal(out.where("id < 3"), table, ["id"]).collect()}
    assert back[2] == "(EMAIL-9) c@d.org"
    left = out.select(F.size(tripwire.find_leaks(F.col("text"))).alias("n")).where("n > 0").count()
    assert left == 0


def test_devanagari_phones_get_two_tokens(spark):
    df = spark.createDataFrame([("PHONE", "९८७६५४३२१०"), ("PHONE", "९८७६५४३२११"), ("PHONE", "+91 98765 43210")], "c string, v string")
    got = [r.x for r in df.select(vault.canonical(F.col("c"), F.col("v")).alias("x")).collect()]
    assert got == ["9876543210", "9876543211", "9876543210"]


def test_urls(spark):
    cases = {
        "https://u:p@Ex.com:8443/a/234567890124/x%20y?b=1&a=2&b=3#f": "https://ex.com:8443/a/[ID]/x%20y?b=*&a=*",
        "http://e.com": "http://e.com/", "https://e.com:443/": "https://e.com/", "mailto:a@b.c": "mailto:[REDACTED]", "nope": "[URL]", "https://e.com/d41d8cd98f00b204e9800998ecf8427e": "https://e.com/[ID]",
    }
    df = spark.createDataFrame([(u,) for u in cases], "u string")
    assert [r.s for r in df.select(sanitize.sanitize_url(F.col("u")).alias("s")).collect()] == list(cases.values())


def test_leaks(spark):
    cases = {"mail a@b.com": ["EMAIL"], "2345 6789 0124": ["AADHAAR"], "ABCPE1234F": ["PAN"], "call 9876543210": ["PHONE"], "pay ravi@okaxis": ["UPI"], "27ABCDE1234F1Z5": ["GSTIN"], "sk-abcdefghijklmnopqrstuvwx": ["SECRET"], "plain": []}
    df = spark.createDataFrame([(t,) for t in cases], "t string")
    assert [r.x for r in df.select(tripwire.find_leaks(F.col("t")).alias("x")).collect()] == list(cases.values())
    good, bad = tripwire.split_leaks(df.union(spark.createDataFrame([(None,)], "t string")), "t")
    assert (good.count(), bad.count()) == (1, 8)


def test_fingerprint_changes(spark):
    cols = "tag string, role string, input_type string, field_class string, name string, origin string, href string, editable boolean, occluded boolean, opaque boolean"
    a = ("a", None, None, None, "x", "o", None, False, False, None)
    df = spark.createDataFrame([(a, a[:4] + ("y",) + a[5:])], f"a struct<{cols.replace(' ', ':').replace(',:', ',')}>, b struct<{cols.replace(' ', ':').replace(',:', ',')}>")
    r = df.select((policy.target_fingerprint(F.col("a")) == policy.target_fingerprint(F.col("a"))).alias("same"), (policy.target_fingerprint(F.col("a")) == policy.target_fingerprint(F.col("b"))).alias("other")).first()
    assert r.same and not r.other


def test_requests_and_images(spark):
    png = "iVBORw0KGgoAAAANSUhEUgAA"
    df = spark.createDataFrame([(png,), ("@@",), ("QUJD",)], "b string")
    assert [r.x for r in df.select(formats.screenshot_fault(F.col("b")).alias("x")).collect()] == [None, "422", "415"]
    sizes = spark.createDataFrame([(900, 1440), (80, 80), (10, 5000)], "h int, w int").select(protocol.smart_resize(F.col("h"), F.col("w")).alias("r")).collect()
    assert [r.r and tuple(r.r) for r in sizes] == [(896, 1440), (64, 64), None]


def test_coco_round_trip(spark, tmp_path):
    (tmp_path / "c.json").write_text('{"images":[{"id":1,"file_name":"a.png","width":10,"height":20}],"annotations":[{"id":1,"image_id":1,"category_id":2,"bbox":[1,2,3,4],"area":12,"iscrowd":0}],"categories":[{"id":2,"name":"FACE"}]}')
    boxes = formats.read_coco(spark, str(tmp_path / "c.json"))
    assert [tuple(r) for r in boxes.collect()] == [(1, "a.png", 10, 20, "FACE", 1.0, 2.0, 3.0, 4.0)]
    many = spark.createDataFrame([(i, f"{i}.png", 10, 20, c, 1.0, 2.0, 3.0, float(i + 1)) for i in range(9) for c in ("FACE", "TEXT")], boxes.schema)
    formats.write_coco(many, str(tmp_path / "out"), ["TEXT", "FACE"], 3)
    back = formats.read_coco(spark, str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, many.collect()))
    docs = [json.loads(p.read_text()) for p in (tmp_path / "out").glob("part-*") if p.stat().st_size]
    ids = [a["id"] for d in docs for a in d["annotations"]]
    assert len(docs) > 1 and len(set(ids)) == 18 and all(d["categories"] == [{"id": 1, "name": "TEXT"}, {"id": 2, "name": "FACE"}] for d in docs)


def test_model_metadata(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"resolution": 384, "classes": ["FACE", null, "TEXT"], "thresholds": {"FACE": 0.9}}')
    meta = formats.read_model_meta(spark, str(tmp_path / "m.json"))
    assert meta["classes"] == ["FACE", None, "TEXT"] and meta["mean"] == list(formats.MEAN) and not meta["stretch"]
    df = spark.createDataFrame([([0.5, 0.5, 0.2, 0.2], [2.0, -9.0, 0.0]), ([0.5, 0.5, 0.2, 0.2], [3.0, -9.0, 0.0]), ([0.5, 0.5, 0.2, 0.2], [-1.0, 9.0, 1.0]), ([0.5, 0.5, 0.2, 0.2], [-1.0, 0.0, 1.0])], "box array<double>, logits array<double>")
    got = [r.d and r.d.pii_class for r in df.select(vision.decode_with(meta, F.col("box"), F.col("logits"), F.lit(100), F.lit(100)).alias("d")).collect()]
    assert got == [None, "FACE", None, "TEXT"]


def test_uncovered_counts_the_union(spark):
    items = spark.createDataFrame([(1, (0.0, 0.0, 10.0, 10.0)), (2, (0.0, 0.0, 10.0, 10.0)), (3, (0.0, 0.0, 4.0, 4.0))], "page long, rect struct<x:double,y:double,w:double,h:double>")
    ops = spark.createDataFrame([(1, 0.0, 0.0, 6.0, 10.0), (1, 5.0, 0.0, 5.0, 10.0), (2, 0.0, 0.0, 6.0, 10.0)], "page long, x double, y double, w double, h double")
    assert sorted(r.page for r in vision.uncovered(items, ops, "page").collect()) == [2, 3]


def test_rows_keep_their_identity_in_sanitising(spark):
    """Null and repeated keys: every text comes back with the tokens of its own values."""
    rows = [(1, "v", "mail a@x.in now"), (1, "v", "call 9876543210 or b@x.in"), (None, "v", "a@x.in and b@x.in"), (None, None, "c@x.in"), (2, "v", None), (2, "v", "nothing"), (1, "v", "mail a@x.in now")]
    out, vault = sanitize.sanitize(spark.createDataFrame(rows, "id int, v string, text string"), "id", "v")
    got = sorted(((r.id, r.text) for r in out.collect()), key=str)
    a, b = "[EMAIL_1]", "[EMAIL_2]"
    tokens = {(r.vault_id, r.canonical): r.token for r in vault.collect()}
    a, b = tokens["v", "a@x.in"], tokens["v", "b@x.in"]
    assert {a, b} == {"[EMAIL_1]", "[EMAIL_2]"} and tokens[None, "c@x.in"] == "[EMAIL_1]"
    want = [(1, f"mail {a} now"), (1, f"call [PHONE_1] or {b}"), (None, f"{a} and {b}"), (None, "[EMAIL_1]"), (2, None), (2, "nothing"), (1, f"mail {a} now")]
    assert got == sorted(want, key=str)


def test_the_detector_runs_once(spark, capsys):
    """The plan of sanitised texts reads stored spans: no Arrow stage is left in it."""
    out, _ = sanitize.sanitize(spark.createDataFrame([(1, "v", "a@x.in")], "id int, v string, text string"), "id", "v")
    out.explain()
    assert "ArrowEvalPython" not in capsys.readouterr().out


def test_label_spans_scan_once(spark, capsys):
    df = spark.createDataFrame([(1, "<dl><dt>Passenger name<dd>Zed</dl>")], "page_id int, html string")
    pages.label_spans(pages.scan(df), "page_id").explain()
    assert capsys.readouterr().out.count("ArrowEvalPython") == 1


def test_islands_of_address_lines():
    text = "Asha Rao\n12, Rose Residency\nnear the lake\nMG Road\nMaharashtra 411001\n\nRavi Kumar\n7, Kale Sadan\nCall me\nback\nGoa 403001"
    got = [(r[4], text[r[0] : r[1]]) for r in layout.address_spans(text)]
    assert got == [("address.block", "12, Rose Residency\nnear the lake\nMG Road\nMaharashtra 411001"), ("person.addressee", "Asha Rao"), ("address.block", "7, Kale Sadan"), ("person.addressee", "Ravi Kumar")] or got[:2] == [("address.block", "12, Rose Residency\nnear the lake\nMG Road\nMaharashtra 411001"), ("person.addressee", "Asha Rao")]


def test_names_from_a_table(spark):
    lists = names.from_table(spark.createDataFrame([("Xara", "given"), ("Yolo", "surname"), (None, "given")], "name string, kind string"))
    assert lists == {"given": frozenset({"xara"}), "surnames": frozenset({"yolo"})}
    assert [r[4] for r in detect.detect_text("met Xara Yolo today", **lists)] == ["person.gazetteer"]


def test_pages(spark):
    html = '<div>Hello <b>Ravi</b></div><p data-gt="EMAIL">a@b.com</p><script>x</script><label for="p">Mobile</label><input id="p"><img width=30 height=40><button>Apply now</button>'
    r = pages.scan(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string")).orderBy("page_id").collect()
    assert r[0].text.startswith("Hello Ravi\na@b.com\nMobile") and [tuple(t) for t in r[0].truth] == [("EMAIL", "a@b.com")] and "a@b.com" not in r[0].context
    assert r[0].fields[0].label == "Mobile" and r[0].media[0].tag == "img" and r[0].buttons == ["Apply now"] and r[1].text == ""


def test_reports_and_dumps(spark, tmp_path):
    lines = [r.line for r in metrics.report_lines(spark.createDataFrame([("b|c", 2.5), ("a", None)], "mode string, recall double")).orderBy("line_no").collect()]
    assert lines == ["| mode | recall |", "|---|---|", "| a |  |", "| b\\|c | 2.5 |"]
    (tmp_path / "index.json").write_text('[{"id":"p1","url":"u"},{"id":"p2","url":"v"}]')
    (tmp_path / "p1.png").write_bytes(b"x")
    assert [(r.id, bytes(r.png) if r.png is not None else None) for r in formats.read_dumps(spark, str(tmp_path)).orderBy("id").collect()] == [("p1", b"x"), ("p2", None)]


def test_page_labels(spark):
    html = '<table><tr><th>Email<th>Holder<tr><td>x@y.in<td>q</table><div><span>Mobile</span><span>XXXX1234</span></div><hr><p>Landmark: <input name="a"><p><b>Pan no</b> <input aria-labelledby="z" name="b"><i id="z">Date of birth</i><select multiple><option>k<option>a@b.com</select>'
    style = "<style>/* .a::after{content:'no@no.in'} */ @media print{ .a>b.c::before{content:'to ' attr(title)} } b::before{content:'x'}</style><div class='a'><b class='c' title='a@b.com'>t</b><b>u</b></div><object data='o'></object>"
    deep = "<div>" * 3000 + "x" + "<p>" * 3000
    rows = [(1, html), (2, style), (3, None), (4, ""), (5, deep), (6, "<<p </td></table> <input <"), (7, html)]
    s = pages.scan(spark.createDataFrame(rows, "page_id long, html string"))
    got = {r.page_id: r for r in s.collect()}
    assert len(got) == 7 and got[1].text == got[7].text and got[5].text == "x" and got[3].fields == [] and got[2].generated == ["to a@b.com ", "x "] and got[2].opaque[0].source == "o"
    assert [(f.name, f.label) for f in got[1].fields][:2] == [("a", "Landmark:"), ("b", "Date of birth")] and got[1].fields[2].options == ["k", "a@b.com"]
    found = {(r.page_id, got[r.page_id].text[r.start : r.end], r.pii_class) for r in pages.label_spans(s, "page_id").collect()}
    assert (1, "x@y.in", "EMAIL") in found and not any("XXXX" in t for _, t, _ in found)
    assert [(r.page_id, r.rule, r.value) for r in pages.generated_findings(s, "page_id").collect()] == [(2, "pseudo.email", "to a@b.com")]


def test_captures(spark):
    rows = [("a", 0, False, True), ("a", 1, True, True), ("b", 0, False, True), ("b", 1, True, False), ("c", 0, False, True), ("c", 1, False, True), ("c", 2, False, True), ("c", 3, False, True), ("c", 4, True, True)]
    df = spark.createDataFrame(rows, "step string, attempt int, steady boolean, front boolean")
    got = {r.step: (r.attempt, r.outcome, r.pause_ms) for r in capture.outcomes(df, ["step"], F.col("steady"), F.col("front")).collect()}
    assert got == {"a": (1, "captured", 150), "b": (1, "not in front", 150), "c": (None, "kept moving", 1500)}
    asked = spark.createDataFrame([("t", 0, 1), ("t", 100, 2), ("t", 200, 3), ("t", 5000, 4), ("t", 5000, 5), ("u", 7, 1)], "k string, at long, n long")
    assert [r.wait for r in capture.spaced(asked, "k", "at", "n", 550).orderBy("k", "n").collect()] == [0, 450, 900, 0, 550, 0]
    assert capture.spaced(asked.limit(0), "k", "at", "n").count() == 0


def test_origins(spark):
    good = ["http://localhost", "http://127.0.0.1:8080", "chrome-extension://" + "a" * 32, "https://x.test"]
    bad = ["http://localhost:0", "http://localhost:70000", "http://localhost.evil", "chrome-extension://" + "q" * 32, "chrome-extension://abc", "http://localhost\n", "*", "", None, "https://y.test"]
    df = spark.createDataFrame([(o,) for o in good + bad], "o string")
    assert [r.x for r in df.select(protocol.allowed_origin(F.col("o"), ("https://x.test",)).alias("x")).collect()] == good + [None] * len(bad)


def test_request_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"task_id":"t","instruction":"go","viewport":{"width":10,"height":10},"observations":[{"url":"u"}]}\n{"task_id":"t"}\nnot json\n')
    q = formats.request_stream(spark, str(tmp_path / "in")).writeStream.format("memory").queryName("step_requests_test").trigger(availableNow=True).start()
    q.awaitTermination()
    got = sorted((r.faults for r in spark.table("step_requests_test").collect()), key=len)
    assert got[0] == [] and got[1] == ["json"] and "viewport" in got[2]


def test_extra_spans(spark):
    df = spark.createDataFrame([("Address: 12 MG Road, PIN code 560001 end",)], "text string")
    extra = F.array(F.struct(F.lit(9).alias("start"), F.lit(36).alias("end"), F.lit("ADDRESS").alias("pii_class"), F.lit(0.75).alias("score"), F.lit("label.ADDRESS").alias("rule"), F.lit(40).alias("rule_idx")))
    got = df.select(detect.detect(F.col("text"), extra=extra).alias("s")).first().s
    assert "PINCODE" in [x.pii_class for x in got] and all(a.end <= b.start for a, b in zip(got, got[1:]))
