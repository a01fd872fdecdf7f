"""Plans and stages whose cost must grow with the input alone: pages are scanned once, in tasks of even size."""

from veilspark.plans import catalog


def test_frames_scan_a_page_once(spark, sf):
    plan = catalog.QUERIES["opaque_frames"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1


def test_first_start_is_the_first_place_of_the_value(spark, tmp_path):
    """As its SQL has it: the number stands first inside a longer one, which is no card."""
    import duckdb

    for at, text in enumerate(("ref 94111111111111111 card 4111111111111111.", "-4111111111111111 or 4111111111111111")):
        folder = tmp_path / str(at)
        folder.mkdir()
        spark.createDataFrame([(1, text, "a", "en")], "doc_id long, text string, source string, lang string").toPandas().to_parquet(folder / "documents.parquet")
        con = duckdb.connect()
        con.execute(f"CREATE VIEW documents AS SELECT * FROM '{folder}/documents.parquet'")
        cur = con.execute(catalog.ORACLE["card_spans"])
        names = [d[0] for d in cur.description]
        want = cur.fetchall()
        assert [tuple(r) for r in catalog.QUERIES["card_spans"](spark, str(folder)).select(*names).collect()] == want


def test_rows_are_spread_whatever_the_splits(spark, tmp_path):
    """One row group in many splits: all its rows are read by one task, and are dealt out behind it."""
    from pyspark.sql import functions as F

    from veilspark.plans.detection import spread

    path = str(tmp_path / "one")
    spark.range(40_000).coalesce(1).write.parquet(path)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "20k")
        rows = spark.read.parquet(path)
        assert rows.rdd.getNumPartitions() >= 4
        n = spread(rows).groupBy(F.spark_partition_id()).count()
        assert n.agg(F.max("count")).first()[0] <= 20_000
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


def test_scan_of_some_columns_is_the_whole_scan(spark):
    from veilspark.sources import pages

    html = '<p>Name: <b>Asha</b></p><form><input name="a"><button>Send</button></form><iframe src="u"></iframe>'
    df = spark.createDataFrame([(i, html if i % 7 else None) for i in range(300)], "page_id int, html string").coalesce(1)
    whole = pages.scan(df)
    assert whole.columns == ["page_id", *pages.NAMES]
    for n in pages.NAMES:
        assert pages.scan(df, only=(n,)).orderBy("page_id").collect() == whole.select("page_id", n).orderBy("page_id").collect()


def test_a_page_that_is_done_leaves_no_cycles():
    import gc

    from veilspark.sources import pages

    gc.collect()
    gc.disable()
    try:
        pages._scan("<div><p>a<p>b<table><tr><td>c</table></div>")
        assert not [x for x in gc.get_objects() if type(x) is pages.Element]
    finally:
        gc.enable()


def test_policy_detects_only_what_counts(spark):
    """A text that is not typed and a URL that is not visited do not reach the detector."""
    from pyspark.sql import functions as F

    from veilspark.operators import policy
    from veilspark.plans.privacy import _ACTION, _TARGET

    of = lambda x: x.replace(" ", ":").replace(",:", ",")
    df = spark.createDataFrame([(("click", "a@b.example", "https://a.example/?q=a@b.example", None, False), None)], f"action struct<{of(_ACTION)}>, target struct<{of(_TARGET)}>")
    plan = df.select(policy.evaluate(F.col("action"), F.col("target"), F.lit("https://a.example")).alias("d"))._jdf.queryExecution().optimizedPlan().toString()
    assert "= type)" in plan.split("ArrowEvalPython")[-1] and "= navigate)" in plan.split("ArrowEvalPython")[-1] or "= type) THEN" in plan


def test_leak_gates_change_nothing(spark):
    from pyspark.sql import functions as F

    from veilspark.operators import tripwire

    texts = ["", "a@b.co", "x@okaxis", "27ABCDE1234F1Z5", "eyJabcdefgh.abcdefgh.abcdefgh", "gho_" + "a" * 36, "rk_test_" + "b" * 16, "AKIA" + "0" * 16, "sk-" + "c" * 20, "2345 6789 0124", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "ABCPE1234F", "98765 43210", "+919876543210", "1 2 3 4", None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", tripwire.find_leaks(F.col("t")).alias("l"), *[F.coalesce(F.col("t").rlike(p), F.lit(False)).alias(k) for k, p in tripwire.PATTERNS.items()]).collect()
    for r in got:
        for k in ("EMAIL", "GSTIN", "SECRET", "PAN", "PHONE"):
            assert (k in r.l) == r[k], (r.t, k)
        assert ("UPI" in r.l) == (r.UPI and not r.EMAIL)


def test_a_single_span_takes_the_short_way_to_the_same_answer(spark):
    from pyspark.sql import functions as F

    from veilspark.operators.resolve import resolve, resolve_rows
    from veilspark.operators.spans import SPAN

    text = " (abc), x. -- "
    cases = [[(a, b, "PAN", 0.5, "pan", 1)] for a in range(len(text)) for b in range(a, len(text) + 1)]
    rows = spark.createDataFrame([(c, text) for c in cases], f"spans array<{SPAN}>, text string").select("spans", resolve(F.col("spans"), F.col("text")).alias("got"))
    for r in rows.collect():
        assert [tuple(x) for x in r.got] == [tuple(x) for x in resolve_rows([tuple(x) for x in r.spans], text)]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert "size(spans" in plan and "= 1)" in plan


def test_boxes_are_not_dealt_out_by_class(spark, tmp_path):
    """Two classes: no step sends all boxes of one to one task."""
    from veilspark.sources import formats

    boxes = spark.range(6_000).selectExpr("id % 1500 AS image_id", "concat(id % 1500, '.png') AS file_name", "4L AS width", "3L AS height", "if(id % 3 = 0, 'FACE', 'TEXT') AS pii_class", "1D AS x", "2D AS y", "3D AS w", "CAST(id AS double) AS h")
    formats.write_coco(boxes, str(tmp_path / "out"), ["TEXT", "FACE"], 100)
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for boxes in large numbers
        back = formats.read_coco(spark, str(tmp_path / "out"))
        plan = back._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin [category_id#" in plan and "SortMergeJoin [category_id#" not in plan
        assert sorted(map(tuple, back.collect())) == sorted(map(tuple, boxes.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
    assert len([p for p in (tmp_path / "out").glob("part-*") if p.stat().st_size]) == 15
