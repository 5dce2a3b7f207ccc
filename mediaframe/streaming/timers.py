"""Stateful operators that act on silence: event-time timers end a wait or a key when the watermark passes.

Times are whole milliseconds of the event time. The watermark alone decides: a timer fires once the watermark has reached it, in a micro-batch
without rows if need be, so results do not depend on how the input is cut into micro-batches, nor on a restart.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mediaframe.streaming.stateful import REORDERED, Reorder

_long = lambda *names: T.StructType([T.StructField(n, T.LongType()) for n in names])
WAITS = T.StructType([*_long("run", "ms", "v", "prev").fields, T.StructField("kind", T.StringType())])


def set_timer(handle: StatefulProcessorHandle, at: int | None) -> None:
    """One timer a key: drop the others."""
    for old in list(handle.listTimers()):
        if old != at:
            handle.deleteTimer(old)
    if at is not None:
        handle.registerTimer(at)


def timed(rows: DataFrame, ts: str, delay: str) -> DataFrame:
    """rows with ``ts`` cut to milliseconds, its watermark, and ``ms``."""
    ms = F.unix_millis(F.col(ts).cast("timestamp"))
    return rows.withColumn("ms", ms).withColumn(ts, F.timestamp_millis("ms")).withWatermark(ts, delay)


class BoundedWait(StatefulProcessor):
    """Changes of one counter, and a timeout where a value has stood for ``bound_ms`` without a change, polls or no polls.

    Polls wait in the state until the watermark reaches them, so polls out of order within the watermark's delay are judged in order. The state of a counter is its
    standing value and the polls of one delay.
    """

    def __init__(self, bound_ms: int) -> None:
        self.bound = bound_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.standing = handle.getValueState("standing", _long("v", "since", "told"))
        self.waiting = handle.getListState("waiting", _long("ms", "f", "v"))

    def _advance(self, key, new: list[tuple], watermark: int) -> pd.DataFrame:
        polls = sorted([*(tuple(map(int, x)) for x in self.waiting.get()), *new]) if self.waiting.exists() else sorted(new)
        now = self.standing.get() if self.standing.exists() else None
        out, done = [], 0
        for ms, _, v in polls:
            if ms > watermark:
                break
            done += 1
            if now is None:
                now = (v, ms, 0)
                continue
            old, since, told = now
            if not told and since + self.bound < ms:
                out.append((*key, since + self.bound, old, None, "timeout"))
                now = (old, since, 1)
            if v != old:
                out.append((*key, ms, v, old, "change"))
                now = (v, ms, 0)
        if now is not None and not now[2] and now[1] + self.bound <= watermark:
            out.append((*key, now[1] + self.bound, now[0], None, "timeout"))
            now = (now[0], now[1], 1)
        if now is not None:
            self.standing.update(now)
        left = polls[done:]
        if left:
            self.waiting.put(left)
        else:
            self.waiting.clear()
        next_ = [left[0][0]] if left else []
        next_ += [now[1] + self.bound] if now is not None and not now[2] else []
        set_timer(self.handle, min(next_, default=None))
        return pd.DataFrame(out, columns=WAITS.names).astype({"prev": "Int64"})

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = [(int(ms), int(f), int(v)) for df in rows for ms, f, v in zip(df["ms"], df["f"], df["v"], strict=True)]
        yield self._advance(key, new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield self._advance(key, [], timerValues.getCurrentWatermarkInMs())

    def close(self) -> None:
        pass


def bounded_wait(polls: DataFrame, bound_ms: int, delay: str = "10 minutes") -> DataFrame:
    """(run, ts, f, v) -> run, ms, v, prev, kind: 'change' where the value differs from the poll before, by (ts, f), and 'timeout' at the
    moment a value has stood for ``bound_ms``, once for each value. A change at that very moment is in time."""
    p = timed(polls.select("run", "ts", "f", "v"), "ts", delay)
    return p.groupBy("run").transformWithStateInPandas(BoundedWait(bound_ms), WAITS, "Append", "EventTime")


class ExpiringReorder(Reorder):
    """Decode to display order; a key that the watermark leaves ``wait_ms`` behind shows what it holds and is forgotten."""

    def __init__(self, depth: int, wait_ms: int) -> None:
        super().__init__(depth)
        self.wait = wait_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.handle = handle
        self.latest = handle.getValueState("latest", _long("ms"))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = list(rows)
        out, ended, had = self._advance(key, iter(held))
        yield out
        if ended:
            if had:
                self.latest.clear()
                set_timer(self.handle, None)
            return
        ms = max(int(df["ms"].max()) for df in held)
        if self.latest.exists():
            ms = max(ms, self.latest.get()[0])
        self.latest.update((ms,))
        set_timer(self.handle, ms + self.wait)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        wait = [tuple(map(int, k)) for k in self.pending.keys()] if self.pending.exists() else []
        heapq.heapify(wait)
        n = self.shown.get()[0] if self.shown.exists() else 0
        out = [(*key, n + i, *heapq.heappop(wait)) for i in range(len(wait))]
        for state in (self.pending, self.shown, self.latest):
            state.clear()
        yield pd.DataFrame(out, columns=REORDERED.names)


def expiring_reorder(frames: DataFrame, depth: int = 16, wait_ms: int = 60_000, delay: str = "10 minutes") -> DataFrame:
    """``stateful.reorder`` for streams that lose rows: (stream, epoch, decode_no, poc, last, ts). A row that comes more than ``wait_ms`` and the delay
    after the epoch's others finds it closed and begins a new numbering."""
    f = timed(frames.select("stream", "epoch", "decode_no", "poc", "last", "ts"), "ts", delay)
    return f.groupBy("stream", "epoch").transformWithStateInPandas(ExpiringReorder(depth, wait_ms), REORDERED, "Append", "EventTime")
