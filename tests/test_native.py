"""The detector in DataFrame functions against the Arrow stage; resolution of overlaps by a sweep against a plain loop."""

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from veilspark.operators import detect, layout, name_join, names, native, resolve
from veilspark.operators.spans import SPAN
from veilspark.plans.detection import CASES as QUERY_CASES

from .test_detect import CASES

WORDS = ["Ravi", "Kumar", "Asha", "Rao", "S.", "A.", "B.", "Xyz", "McDonald", "the", "Traders", "Priya", "Menon", "RAVI", "Ravi.", "O’Neil", "--Asha", "-Rao", "é", "Áb", "1", "(", ")", ",", ".", "!", "Road", "x-Ray", "Sharma,", "MG", "Street,", "Flat", "No.", "12,", "Maharashtra", "Upper-Assam", "X'Goa", "Delhi", "411001", "Address", "a.b@x.example", "महाराष्ट्र", "श्री", "राम", "नगर", "dear", "Dr", "Hi", "Regards,", "+91", "98765", "43210", "४५", "PIN", ":", "Rs.", "eyJ", "token", "=", "AKIA", "₹"]


def texts(n=1500, seed=11):
    rng = random.Random(seed)
    made = ["".join(rng.choice(WORDS) + rng.choice([" ", " ", " ", "  ", "\t", "\n", "\n", "", " , ", " "]) for _ in range(rng.randint(1, 25))) for _ in range(n)]
    given = [t for t, _ in CASES] + [c[1] for c in QUERY_CASES]
    joined = ["\n".join(rng.sample(given, 4)) for _ in range(100)]
    blocks = ["Asha Rao\n12, Rose Residency\nMG Road\nMaharashtra 411001\nyours", "Goa\n\nRoad 1", "1-A, MG Road, Goa 403 001", "x\nAsha Rao\nasha@x.example\nAddress Rao\nb@x.example", "Street\nshort\nAssam", "Street\nAsha Rao\nAssam", "Street\nRs. 5 Road\nAssam"]
    return [*made, *given, *joined, *blocks, None, "", " ", "\n\n", "Ravi Kumar " * 40, "x" * 500 + " Ravi Kumar\nRavi Kumar"]


def plain(text, **more):
    return [tuple(s) for s in detect.detect_text(text, **more)]


def found(df):
    return {r.i: [tuple(s) for s in r.spans] for r in df.select("i", "spans").collect()}


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(list(enumerate(texts())), "i int, text string").repartition(4)


def test_native_detector_equals_the_arrow_stage(spark, rows):
    got = found(native.with_spans(rows))
    kinds = set()
    for i, t in enumerate(texts()):
        assert got[i] == plain(t), t
        kinds |= {s[4] for s in got[i]}
    assert len(kinds) >= 25
    plan = native.spans_table(rows, ["i"])._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_excluded_classes_and_own_names(spark, rows):
    given, surnames = names.GIVEN - {"ravi"}, names.SURNAMES | {"xyz"}
    got = found(native.with_spans(rows, exclude=("PHONE", "ADDRESS"), given=given, surnames=surnames))
    for i, t in enumerate(texts()):
        assert got[i] == plain(t, exclude=frozenset({"PHONE", "ADDRESS"}), given=given, surnames=surnames), t


@pytest.mark.parametrize("table,key", [("documents", ["doc_id"]), ("conversations", ["conv_id", "turn"])])
def test_tables(spark, table, key):
    docs = spark.read.parquet(f"/root/testdata/sf0.01/{table}.parquet")
    one, two = [sorted(map(str, f(docs, key).collect())) for f in (native.spans_table, detect.spans_table)]
    assert one == two and (one or table == "conversations")


def test_a_dictionary_by_join_equals_sets(spark, rows):
    words = [(n, "given") for n in names.GIVEN] + [(n.title(), "surname") for n in names.SURNAMES] + [("kumar", "given"), ("kumar", "surname"), ("kumar", "given"), (None, "given"), ("xyz", None)]
    table = spark.createDataFrame(words, "name string, kind string")
    got = {}
    for r in name_join.find(rows, ["i"], table).collect():
        got.setdefault(r.i, []).append(tuple(r)[1:])
    total = 0
    for i, t in enumerate(texts()):
        want = sorted((int(a), int(b), *rest) for a, b, *rest in layout.gazetteer_spans((t or "").translate(detect._DIGITS), names.GIVEN | {"kumar"}, names.SURNAMES))
        assert sorted(got.get(i, [])) == want, t
        total += len(want)
    assert total > 300


# --- overlaps


def by_places(spans, text):
    """Resolution place by place: every place of the text has at most one owner."""
    edge = re.compile(resolve.EDGE)
    owner = {}
    out = []
    for s in sorted(spans, key=lambda s: (-s[3], s[0] - s[1], s[5], s[0])):
        free = [p for p in range(s[0], s[1]) if p not in owner]
        pieces = []
        for p in free:
            if pieces and pieces[-1][1] == p:
                pieces[-1][1] = p + 1
            else:
                pieces.append([p, p + 1])
        for a, b in pieces:
            while text and a < b and edge.match(text[a]):
                a += 1
            while text and b > a and edge.match(text[b - 1]):
                b -= 1
            if b - a >= resolve.LEAST or (a, b) == s[:2]:
                owner |= dict.fromkeys(range(a, b))
                out.append((a, b, *s[2:]))
    return sorted(out)


def overlaps(rng, n, size):
    out = []
    for _ in range(n):
        a = rng.randint(0, size)
        out.append((a, a + rng.randint(1, 25 if rng.random() < 0.3 else 4), "X", rng.choice((0.5, 0.7, 0.9)), "r", rng.randint(0, 5)))
    return out


def test_resolution_against_places(spark):
    rng = random.Random(4)
    cases = [(i, "".join(rng.choice("ab ,.;x-") for _ in range(90)), overlaps(rng, rng.randint(0, 12), 60)) for i in range(400)]
    for _, text, spans in cases:
        for t in ("", text):
            assert resolve.resolve_rows(spans, t) == by_places(spans, t)
    df = spark.createDataFrame(cases, f"i int, text string, each array<{SPAN}>")
    for r in df.select("i", resolve.resolve(F.col("each")).alias("a"), resolve.resolve(F.col("each"), F.col("text")).alias("b")).collect():
        _, text, spans = cases[r.i]
        assert [tuple(x) for x in r.a] == by_places(spans, "") and [tuple(x) for x in r.b] == by_places(spans, text)
    each = df.where("size(each) > 0").select(F.when(F.col("i") > 0, F.col("i")).alias("i"), "text", F.inline("each"))
    each = each.withColumn("value", F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start")))
    for value in (None, "value"):
        got = {}
        for r in resolve.resolve_table(each, ["i"], value).collect():
            got.setdefault(r.i or 0, []).append(tuple(r)[1:])
        for i, text, spans in cases:
            assert sorted(got.get(i, [])) == by_places(spans, text if value else "")


def test_a_text_with_a_hundred_thousand_spans(spark):
    rng = random.Random(9)
    many = [(a := rng.randint(0, 5_000_000), a + rng.randint(3, 80), "X", rng.random(), "r", 0) for _ in range(100_000)]
    under = [(i * 10, i * 10 + 5, "X", 0.9, "r", 0) for i in range(50_000)] + [(rng.randint(0, 1000), 500_000 - rng.randint(0, 1000), "Y", 0.5, "r", 1) for i in range(50_000)]
    at = time.process_time()
    one, two = resolve.resolve_rows(many, ""), resolve.resolve_rows(under, "")
    assert time.process_time() - at < 15
    assert all(a[1] <= b[0] for x in (one, two) for a, b in zip(x, x[1:])) and len(two) == 100_000
    df = spark.createDataFrame([("k", *s) for s in many], "k string, start int, end int, pii_class string, score double, rule string, rule_idx int").repartition(4)
    assert sorted(tuple(r)[1:] for r in resolve.resolve_table(df, ["k"]).collect()) == one
