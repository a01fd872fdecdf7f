"""A task's steps in order of event time, from batches in any order, with a limit of steps and a timeout.

Steps wait in the state of their task until the watermark has passed them; then they are numbered in order of time. A task ends when
a step comes after the last one allowed (``stopped``), or when nothing came for ``timeout`` after a step (``timed out``),
which an event-time timer finds even if no step ever comes again. What arrives after the end, or behind the watermark, is left out.
Null tasks and times are left out.

A task's state is one value, read and written once a batch, as each call of the store costs more than many steps; rows are plain,
as a data frame for each task costs more still. No more steps wait than can count: those up to the first one behind the limit.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from .steps import ROCKS

_OUT = "task string, n long, seq long, state string"
_ROW = Row("task", "n", "seq", "state")
_STATE = "n long, last long, ended boolean, timer long, at array<long>, seq array<long>"


class _InOrder(StatefulProcessor):
    """State: one value, where the task is and the steps that wait; one timer, at the next time at which something can happen."""

    def __init__(self, limit: int, timeout_ms: int):
        self.limit, self.timeout = limit, 1000 * timeout_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.task = handle.getValueState("task", _STATE)

    def _now(self) -> tuple:
        n, last, ended, timer, at, seq = self.task.get() or (0, None, False, None, [], [])
        return n, last, ended, timer, list(zip(at, seq))

    def _set(self, n: int, last: int | None, ended: bool, timer: int | None, waiting: list) -> None:
        """Keep the place and the steps that wait, in order; the timer stands where the first of them counts, or where the patience ends."""
        # A timer is due when the watermark, in milliseconds, has reached it. It must lie behind the watermark, as the one that fires is deleted
        # afterwards: a step counts from its own time on, the patience is over one millisecond later.
        due = [-(-x[0] // 1000) for x in waiting[:1]] + ([] if last is None else [(last + self.timeout) // 1000 + 1])
        wanted = None if ended or not due else min(due)
        if timer is not None and timer != wanted:
            self.handle.deleteTimer(timer)
        if wanted is not None and timer != wanted:
            self.handle.registerTimer(wanted)
        self.task.update((n, last, ended, wanted, [x[0] for x in waiting], [x[1] for x in waiting]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        n, last, ended, timer, waiting = self._now()
        if not ended:
            new = [(r.at, r.seq) for r in rows if last is None or r.at > last]
            if new:
                # The first step behind the limit ends the task, so none after it can count.
                self._set(n, last, ended, timer, heapq.nsmallest(self.limit - n + 1, waiting + new))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        n, last, ended, _, waiting = self._now()
        now = 1000 * timerValues.getCurrentWatermarkInMs()
        out = []
        for at, seq in [x for x in waiting if x[0] <= now]:
            if last is not None and at - last > self.timeout:
                out.append(_ROW(key[0], n + 1, None, "timed out"))
                ended = True
            elif n == self.limit:
                out.append(_ROW(key[0], n + 1, seq, "stopped"))
                ended = True
            if ended:
                break
            n, last = n + 1, at
            out.append(_ROW(key[0], n, seq, "step"))
        if not ended and last is not None and now - last > self.timeout:
            out.append(_ROW(key[0], n + 1, None, "timed out"))
            ended = True
        self._set(n, last, ended, None, [] if ended else [x for x in waiting if x[0] > now])
        return iter(out)

    def close(self) -> None:
        pass


def ordered_steps(steps: DataFrame, task: str, ts: str, seq: str, limit: int, timeout_ms: int, late: str = "10 minutes") -> DataFrame:
    """(task, n, seq, state) of a stream of steps; equal times go by ``seq``. ``late`` is how far behind the latest a step may come."""
    steps.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = steps.where(F.col(task).isNotNull() & F.col(ts).isNotNull()).select(F.col(task).cast("string").alias("task"), F.col(ts).cast("timestamp").alias("ts"), F.unix_micros(F.col(ts).cast("timestamp")).alias("at"), F.coalesce(F.col(seq).cast("long"), F.lit(0)).alias("seq"))
    return rows.withWatermark("ts", late).groupBy("task").transformWithState(_InOrder(limit, timeout_ms), _OUT, "append", "eventTime")
