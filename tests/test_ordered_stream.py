"""Steps in order of time over batches that come in any order."""

import datetime as dt
import random

from veilspark.streaming import ordered

SCHEMA = "task string, ts timestamp, seq long"
START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)


def plain(rows, limit, timeout, mark):
    out = []
    for task in sorted({r[0] for r in rows if r[0] is not None}):
        n, last, ended = 0, None, False
        for ts, seq in sorted((t, s or 0) for k, t, s in rows if k == task and t is not None and t <= mark):
            if last is not None and ts - last > timeout:
                break
            if n == limit:
                out.append((task, n + 1, seq, "stopped"))
                ended = True
                break
            n, last = n + 1, ts
            out.append((task, n, seq, "step"))
        later = [t for k, t, _ in rows if k == task and t is not None and last is not None and last < t <= last + timeout and t <= mark]
        if not ended and last is not None and mark - last > timeout and not later:
            out.append((task, n + 1, None, "timed out"))
    return sorted(out, key=str)


def run(spark, path, batches, limit, timeout):
    out = []
    (path / "in").mkdir()
    for i, rows in enumerate(batches):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(path / f"in/{i}"))
        src = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(path / "in"))
        stream = ordered.ordered_steps(src, "task", "ts", "seq", limit, int(timeout.total_seconds() * 1000), "10 minutes")
        query = stream.writeStream.foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
    return out


def test_steps_of_shuffled_batches(spark, tmp_path):
    rng = random.Random(3)
    minute = dt.timedelta(minutes=1)
    rows = []
    for task in "abcdef":
        at = START
        for i in range(rng.randint(3, 14)):
            at += minute * rng.choice([1, 2, 3, 5, 5, 50 if rng.random() < 0.3 else 4])
            rows.append((task, at + dt.timedelta(microseconds=rng.randrange(1000)), i))
    rows.append(("a", rows[0][1], 99))  # a tie in time
    # Rows come up to eight minutes late, in four runs from one checkpoint.
    late = sorted(rows, key=lambda r: r[1] + minute * rng.uniform(0, 8))
    size = -(-len(late) // 4)
    batches = [late[i : i + size] for i in range(0, len(late), size)]
    batches[1] += [(None, START + 40 * minute, 1), ("a", None, 1)]
    batches[-1].append(("z", START + 500 * minute, 1))  # moves the watermark past all others
    got = run(spark, tmp_path, batches, 8, 20 * minute)
    want = plain([*rows, ("z", START + 500 * minute, 1)], 8, 20 * minute, START + 490 * minute)
    assert sorted(got, key=str) == want and {x[3] for x in want} == {"step", "stopped", "timed out"}
    for task in "abcdef":
        numbers = [n for k, n, _, _ in got if k == task]
        assert numbers == list(range(1, len(numbers) + 1))


def test_steps_and_patience_at_the_watermark_itself(spark, tmp_path):
    minute = dt.timedelta(minutes=1)
    first = [("a", START + 50 * minute, 1), ("c", START + 30 * minute, 1), ("z", START + 60 * minute, 1)]
    more = [("z", START + 61 * minute, 2)]
    got = run(spark, tmp_path, [first, more], 8, 20 * minute)
    want = plain([*first, *more], 8, 20 * minute, START + 51 * minute)
    assert sorted(got, key=str) == want and ("a", 1, 1, "step") in want and ("c", 2, None, "timed out") in want


def test_no_more_steps_wait_than_can_count(spark, tmp_path):
    """One task of 400 steps and a limit of 3: the state takes a few entries, and later batches only change what comes first."""
    minute = dt.timedelta(minutes=1)
    first = [("a", START + minute * (400 - i), i) for i in range(400)]
    (tmp_path / "in").mkdir()
    out, most = [], []
    for i, rows in enumerate([first, [("a", START, 999)], [("z", START + 900 * minute, 1)]]):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / f"in/{i}"))
        src = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", True).parquet(str(tmp_path / "in"))
        stream = ordered.ordered_steps(src, "task", "ts", "seq", 3, 60_000_000, "10 hours")
        query = stream.writeStream.foreachBatch(lambda df, _: out.extend(tuple(r) for r in df.collect())).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        query.awaitTermination()
        most += [p.stateOperators[0].numRowsUpdated for p in query.recentProgress if p.stateOperators]
    assert sorted(out) == [("a", 1, 999, "step"), ("a", 2, 399, "step"), ("a", 3, 398, "step"), ("a", 4, 397, "stopped")]
    assert max(most) <= 10
