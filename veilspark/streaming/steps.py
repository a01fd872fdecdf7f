"""Step streams: counters, per-task vaults, and frame retention."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from ..operators.protocol import parse_tool_call, to_action
from ..operators.tripwire import find_leaks


def counters(steps: DataFrame, text: str = "text") -> DataFrame:
    """Monotone counters of a (streaming) table: steps and blocked leaks."""
    return steps.agg(F.count(F.lit(1)).alias("steps"), F.count_if(F.size(find_leaks(F.col(text))) > 0).alias("leaks_blocked"))


def step_loop(requests: DataFrame, reply: str = "reply") -> DataFrame:
    """Requests (see :func:`formats.step_requests`, with the model's reply) through audit and action: ``verdict``, ``leaks``, ``echo``, ``action``, ``thoughts``.

    A request with faults is ``refused``; one whose own texts leak is ``blocked`` with the
    classes; others are ``answered`` by the action of the reply, ``unsupported`` if it can't
    be read. Replayed turns of the model are only marked as ``echo`` if they leak. No
    state and no shuffle, so it runs on streams and tables alike.
    """
    r = F.col("request")
    seen = r["observations"]
    texts = F.concat(F.array(r["instruction"]), *[seen[n] for n in ("url", "text_observation", "user_response")])
    merged = lambda a: F.array_sort(F.array_distinct(F.flatten(F.transform(F.coalesce(a, F.array().cast("array<string>")), lambda t: find_leaks(F.coalesce(t, F.lit("")))))))
    leaks = merged(texts)
    called = parse_tool_call(F.col(reply))
    action = to_action(called["arguments"], r["width"], r["height"])
    bad, blocked = F.size("faults") > 0, F.size("leaks") > 0
    out = requests.withColumn("leaks", F.when(bad, F.array().cast("array<string>")).otherwise(leaks)).withColumn("echo", ~bad & ~blocked & (F.size(merged(r["assistant_turns"])) > 0))
    answered = ~bad & ~blocked
    return out.withColumn("verdict", F.when(bad, "refused").when(blocked, "blocked").otherwise("answered")).withColumn("action", F.when(answered, action)).withColumn("thoughts", F.when(answered, called["thoughts"]))


def loop_counters(loop: DataFrame) -> DataFrame:
    """Monotone counters of a (streaming) step loop: steps answered, leaks blocked, and model turns that echo a leak."""
    is_ = lambda v: F.count_if(F.col("verdict") == v)
    return loop.agg(is_("answered").alias("steps"), is_("blocked").alias("leaks_blocked"), F.count_if("echo").alias("model_echoes"))


def windowed(events: DataFrame, ts: str = "ts", late: str = "10 minutes", size: str = "1 hour") -> DataFrame:
    """Operational roll-up by event time with a watermark."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


_TOKENS = "vault_id string, pii_class string, canonical string, token string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class _VaultState(StatefulProcessor):
    """One vault and class: an entry of a map for each value, and the last number.

    A batch writes entries for its new values only. With an expiry, a vault that sees no
    value for so long forgets its values; numbers go on, so none is given twice.
    """

    def __init__(self, expiry_ms: int | None):
        self.expiry_ms = expiry_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.known = handle.getMapState("known", "canonical string", "number long")
        self.last = handle.getValueState("last", "number long, timer long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        vault, cls = key
        seen = pd.concat(list(rows)).sort_values("seq", kind="stable").drop_duplicates("canonical")
        number, timer = self.last.get() if self.last.exists() else (0, -1)
        out = []
        for canonical in seen["canonical"]:
            if not self.known.containsKey((canonical,)):
                number += 1
                self.known.updateValue((canonical,), (number,))
                out.append((vault, cls, canonical, f"[{cls}_{number}]"))
        timer = self._renewed(timer, timerValues)
        self.last.update((number, timer))
        yield pd.DataFrame(out, columns=["vault_id", "pii_class", "canonical", "token"])

    def _renewed(self, timer: int, timers) -> int:
        if self.expiry_ms is None:
            return -1
        if timer >= 0:
            self.handle.deleteTimer(timer)
        due = timers.getCurrentProcessingTimeInMs() + self.expiry_ms
        self.handle.registerTimer(due)
        return due

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.known.clear()
        self.last.update((self.last.get()[0], -1))
        yield pd.DataFrame([], columns=["vault_id", "pii_class", "canonical", "token"])

    def close(self) -> None:
        pass


def vault_stream(values: DataFrame, expiry_ms: int | None = None) -> DataFrame:
    """New tokens of a stream of (vault_id, pii_class, canonical, seq), stable over batches and restarts.

    State is kept per (vault, class), so a busy vault spreads over its classes; what a batch writes is in
    proportion to its new values. A vault without a value for ``expiry_ms`` forgets its values,
    but not how far it has counted. Null values get no token. Needs the RocksDB state store, which is set here.
    """
    values.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    known = values.where("canonical IS NOT NULL").select(F.coalesce("vault_id", F.lit("")).alias("vault_id"), "pii_class", "canonical", "seq")
    grouped = known.groupBy("vault_id", "pii_class")
    return grouped.transformWithStateInPandas(_VaultState(expiry_ms), _TOKENS, "append", "none" if expiry_ms is None else "processingTime")
