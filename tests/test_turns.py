"""Turns that hold values themselves: the queries give what their SQL states, and own values are found by the queries without SQL."""

import duckdb
import pytest

from veilspark.plans import catalog

#: A name alone in a line, one behind an initial, an address and one like those put behind turns; words that lead to a name or an address at the end.
TURNS = ["Tara.\nOf the.", "A. Raja ver.", "mail a@b.example now", "mail u1@mail.example now", "call 9876543210", "hi Dr", "addr", "Of the.", "", None]


ROWS = [(conv, turn, "user", text) for conv in (7, 123456) for turn, text in enumerate(TURNS)] + [(8, 3, "user", "Tara.\nx"), (8, 3, "user", "y"), (8, 100_000, "user", "z")]


@pytest.fixture(scope="module")
def talk(tmp_path_factory):
    def store(rows):
        folder = tmp_path_factory.mktemp("talk")
        con = duckdb.connect()
        con.execute("CREATE TABLE t (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        con.executemany("INSERT INTO t VALUES (?, ?, ?, ?)", rows)
        con.execute(f"COPY t TO '{folder}/conversations.parquet'")
        return str(folder)

    return store


def by_sql(folder, name):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW conversations AS SELECT * FROM '{folder}/conversations.parquet'")
    cur = con.execute(catalog.ORACLE[name])
    return [d[0] for d in cur.description], sorted(cur.fetchall(), key=str)


def test_detected_behind_turns_as_by_sql(spark, talk):
    folder = talk(ROWS)
    names, want = by_sql(folder, "detect_turns")
    assert sorted(map(tuple, catalog.QUERIES["detect_turns"](spark, folder).select(*names).collect()), key=str) == want
    own = {(r.turn, r.pii_class, r.value) for r in catalog.QUERIES["detect_conversations"](spark, folder).where("conv_id = 7").collect()}
    assert {(0, "PERSON", "Tara"), (1, "PERSON", "A. Raja"), (2, "EMAIL", "a@b.example"), (4, "PHONE", "9876543210")} <= own


def test_sanitized_behind_turns_as_by_sql(spark, talk):
    folder = talk([*ROWS, (9, None, "user", "no number"), (None, 1, "user", "Tara")])
    names, want = by_sql(folder, "sanitize_turns")
    assert sorted(map(tuple, catalog.QUERIES["sanitize_turns"](spark, folder).select(*names).collect()), key=str) == want
    whole = {r.key: r.text for r in catalog.QUERIES["sanitize_conversations"](spark, folder).collect()}
    texts = [whole[f"7-{turn:06}"] for turn in range(5)]
    assert texts == ["[PERSON_1].\nOf the.", "[PERSON_2] ver.", "mail [EMAIL_1] now", "mail [EMAIL_2] now", "call [PHONE_1]"]
    assert whole["9"] == "no number" and whole["000001"] == "[PERSON_1]"


def test_spans_that_are_kept_become_tokens(spark):
    from pyspark.sql import functions as F

    from veilspark.operators import sanitize

    docs = spark.createDataFrame([(1, "v", "a@x.in and b@x.in"), (2, "v", "b@x.in"), (3, "v", None)], "id int, v string, text string")
    out, vault = sanitize.sanitize(docs, "id", "v", keep=lambda s: (F.col("_key") > 1) | (s["start"] > 0))
    assert [(r.id, r.text, r.tokens) for r in out.orderBy("id").collect()] == [(1, "a@x.in and [EMAIL_1]", ["[EMAIL_1]"]), (2, "[EMAIL_1]", ["[EMAIL_1]"]), (3, None, [])]
    assert [r.value for r in vault.collect()] == ["b@x.in"]
