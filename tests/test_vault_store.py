"""A stored vault over several runs against a plain dictionary; failures between the steps of a run."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilspark.operators import sanitize, vault_store
from veilspark.operators.vault_store import Conflict, VaultStore

VALUES = "vault_id string, pii_class string, value string, source string, origin string, seq int"


def runs(seed=3, n=5):
    rng = random.Random(seed)
    out = []
    for r in range(n):
        rows = []
        for i in range(60):
            kind = rng.choice(["EMAIL", "PHONE", "PERSON"])
            k = rng.randrange(20)
            value = {"EMAIL": f"{'U' if k % 2 else 'u'}{k}@A.example", "PHONE": f"+91 98765{10000 + k}", "PERSON": f"Name  {k}"}[kind]
            rows.append((rng.choice(["a", "b", None]), kind, value, rng.choice(["page", "page", "user"]), f"o{r}", i))
        out.append([*rows, ("a", "EMAIL", None, "user", "o", 99)])
    return out


def plain(batches):
    """(vault, class, canonical) -> [token, value, source, origin] by a plain loop."""
    known, last = {}, Counter()
    for rows in batches:
        for v, c, value, source, origin, _ in rows:
            if value is None:
                continue
            key = (v, c, value[-10:] if c == "PHONE" else " ".join(value.split()).lower())
            if key not in known:
                last[v, c] += 1
                known[key] = [f"[{c}_{last[v, c]}]", value, source, origin]
            elif source == "user":
                known[key][2] = "user"
    return known


def contents(df):
    return {(r.vault_id, r.pii_class, r.canonical): [r.token, r.value, r.source, r.origin] for r in df.collect()}


def frame(spark, rows):
    return spark.createDataFrame(rows, VALUES).repartition(3)


@pytest.fixture
def store(spark, tmp_path):
    return VaultStore(spark, str(tmp_path / "vault"))


def test_runs_against_a_plain_vault(spark, store):
    batches = runs()
    assert store.log() == [] and store.read().count() == 0
    for i, rows in enumerate(batches):
        got = store.update(frame(spark, rows), ["seq"], f"b{i}")
        want = plain(batches[: i + 1])
        assert contents(got) == want and got.count() == len(want)
    tokens = Counter((r.vault_id, r.token) for r in store.read().collect())
    assert max(tokens.values()) == 1
    store.compact()
    assert contents(store.read()) == plain(batches) and len(store.log()) == 1
    more = runs(9, 1)
    assert contents(store.update(frame(spark, more[0]), ["seq"])) == plain(batches + more)


def test_a_batch_counts_once(spark, store):
    first, second = runs(5, 2)
    store.update(frame(spark, first), ["seq"], "one")
    before, log = contents(store.read()), store.log()
    assert contents(store.update(frame(spark, first), ["seq"], "one")) == before and store.log() == log
    # Without a name it is read again, and changes nothing but the log.
    assert contents(store.update(frame(spark, [r for r in first if r[3] == "page"]), ["seq"])) == before
    assert contents(store.update(frame(spark, second), ["seq"], "two")) == plain([first, second])


@pytest.mark.parametrize("fails", ["entries", "users", "highs", "commit"])
def test_a_run_that_fails_leaves_no_trace(spark, store, monkeypatch, fails):
    first, second = runs(6, 2)
    store.update(frame(spark, first), ["seq"], "one")
    before = contents(store.read())
    with monkeypatch.context() as m:
        write = VaultStore._write

        def broken(self, kind, rows, folder):
            write(self, kind, rows, folder)
            if kind == fails:
                raise OSError("lost")

        m.setattr(VaultStore, "_write", broken)
        if fails == "commit":
            m.setattr(vault_store, "put_new_file", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            store.update(frame(spark, second), ["seq"], "two")
    assert contents(store.read()) == before
    assert contents(store.update(frame(spark, second), ["seq"], "two")) == plain([first, second])


def test_two_runs_at_once(spark, store, monkeypatch):
    first, second = runs(7, 2)
    stale = store.log()
    store.update(frame(spark, first), ["seq"])
    with monkeypatch.context() as m:
        m.setattr(VaultStore, "log", lambda self: stale)
        with pytest.raises(Conflict):
            store.update(frame(spark, second), ["seq"])
    assert contents(store.read()) == plain([first])


def test_an_empty_batch(spark, store):
    store.update(frame(spark, []), ["seq"])
    assert store.read().count() == 0
    assert contents(store.update(frame(spark, runs()[0]), ["seq"])) == plain(runs()[:1])


def test_texts_of_two_runs_share_tokens(spark, store):
    def texts(rows):
        return spark.createDataFrame(rows, "k int, v string, text string")

    one, _ = sanitize.sanitize(texts([(1, "t", "mail a@x.example and b@x.example")]), "k", "v", store=store, batch="1")
    two, vault = sanitize.sanitize(texts([(1, "t", "now c@x.example, B@x.example"), (2, "u", "a@x.example"), (3, "t", None)]), "k", "v", store=store, batch="2")
    assert [r.text for r in one.collect()] == ["mail [EMAIL_1] and [EMAIL_2]"]
    assert {r.k: r.text for r in two.collect()} == {1: "now [EMAIL_3], [EMAIL_2]", 2: "[EMAIL_1]", 3: None}
    assert vault.where(F.col("vault_id") == "t").count() == 3
