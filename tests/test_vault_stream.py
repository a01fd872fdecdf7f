"""The streaming vault over batches, restarts and expiry."""

from veilspark.streaming import steps

SCHEMA = "vault_id string, pii_class string, canonical string, seq long"


class Stream:
    """A vault stream over a folder of files; each run reads what is new from the checkpoint on."""

    def __init__(self, spark, path, **more):
        self.spark, self.path, self.more, self.n = spark, path, more, 0
        (path / "in").mkdir()

    def run(self, rows):
        self.n += 1
        self.spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(self.path / f"in/{self.n}"))
        out, seen = [], self.spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(self.path / "in"))
        query = steps.vault_stream(seen, **self.more).writeStream.foreachBatch(lambda df, _: out.extend(df.collect())).option("checkpointLocation", str(self.path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        self.updated = sum(p.stateOperators[0].numRowsUpdated for p in query.recentProgress if p.stateOperators)
        return sorted((r.vault_id, r.pii_class, r.canonical, r.token) for r in out)


def test_tokens_are_stable_over_restarts(spark, tmp_path):
    stream = Stream(spark, tmp_path)
    first = [("a", "EMAIL", f"v{i}", i) for i in range(300)] + [("b", "EMAIL", "v7", 5), ("b", "EMAIL", "v8", 3), (None, "PAN", "p", 1), ("a", "EMAIL", None, 2)]
    got = stream.run(first)
    assert ("a", "EMAIL", "v0", "[EMAIL_1]") in got and ("a", "EMAIL", "v299", "[EMAIL_300]") in got and len(got) == 303
    assert ("b", "EMAIL", "v8", "[EMAIL_1]") in got and ("b", "EMAIL", "v7", "[EMAIL_2]") in got and ("", "PAN", "p", "[PAN_1]") in got
    # Known values give nothing; new ones go on. What the state takes is the new entries and a number each.
    assert stream.run([("a", "EMAIL", f"v{i}", i) for i in range(300)] + [("a", "EMAIL", "new", 900), ("b", "EMAIL", "new", 1)]) == [("a", "EMAIL", "new", "[EMAIL_301]"), ("b", "EMAIL", "new", "[EMAIL_3]")]
    assert stream.updated <= 8
    assert stream.run([("a", "EMAIL", "new", 1)]) == []


def test_an_expired_vault_forgets_but_counts_on(spark, tmp_path):
    stream = Stream(spark, tmp_path, expiry_ms=1)
    assert stream.run([("a", "EMAIL", "x", 1), ("a", "EMAIL", "y", 2)]) == [("a", "EMAIL", "x", "[EMAIL_1]"), ("a", "EMAIL", "y", "[EMAIL_2]")]
    stream.run([("other", "EMAIL", "z", 1)])  # a batch in which the timer is due
    assert stream.run([("a", "EMAIL", "x", 1)]) == [("a", "EMAIL", "x", "[EMAIL_3]")]
