"""Stateful streaming operators.

State is keyed as finely as the semantics allow: reordering by (stream, epoch), batching by
(file, picture). A picture or an epoch is bounded by its format and ends with its last row, which clears
the key, so nothing outlives its frame. Rows of one key are ordered inside a micro-batch by the
processor itself; micro-batches must follow decode order. Counters, whose keys are not bounded, are
watched by ``run.counter_watch`` instead.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from mediaframe import schemas as S


def _with_state(df: DataFrame, keys: list[str], processor: StatefulProcessor, schema: T.StructType) -> DataFrame:
    """Keyed state needs the RocksDB store; ``run.append_log`` starts its queries with it."""
    return df.groupBy(*keys).transformWithStateInPandas(processor, schema, "Append", "None")


def _one_frame(rows: Iterator[pd.DataFrame], order: str, columns: list[str]) -> list[tuple]:
    """Rows of a key as tuples in order; a key has a dozen rows, for which frames cost more than the work."""
    held = [r for df in rows for r in zip(df[order].tolist(), *(df[c].tolist() for c in columns), strict=True)]
    return sorted(held, key=lambda r: r[0])


class Reorder(StatefulProcessor):
    """Decode order to display order: rows wait until ``depth`` others are pending, the last row drains the key."""

    def __init__(self, depth: int) -> None:
        self.depth = depth

    def init(self, handle: StatefulProcessorHandle) -> None:
        place = T.StructType([T.StructField("poc", T.LongType()), T.StructField("decode_no", T.LongType())])
        self.pending = handle.getMapState("pending", place, T.StructType([T.StructField("waits", T.BooleanType())]))
        self.shown = handle.getValueState("shown", T.StructType([T.StructField("n", T.LongType())]))

    def _advance(self, key, rows: Iterator[pd.DataFrame]) -> tuple[pd.DataFrame, bool, bool]:
        """What leaves, whether the key has ended, and whether it had a state. Each call on a state is a round trip, so a key that begins and ends here makes one."""
        had = self.shown.exists()
        old = {tuple(k) for k in self.pending.keys()} if had and self.pending.exists() else set()
        wait = sorted(old)  # a sorted list is a heap
        n = self.shown.get()[0] if had else 0
        out = []
        ended = False
        for decode_no, poc, last in _one_frame(rows, "decode_no", ["poc", "last"]):
            heapq.heappush(wait, (int(poc), int(decode_no)))
            ended = ended or bool(last)
            while len(wait) > (0 if ended else self.depth):
                out.append((*key, n, *heapq.heappop(wait)))
                n += 1
        if not ended:
            for gone in old.difference(wait):
                self.pending.removeKey(gone)
            for new in set(wait).difference(old):
                self.pending.updateValue(new, (True,))
            self.shown.update((n,))
        elif had:
            self.pending.clear()
            self.shown.clear()
        return pd.DataFrame(out, columns=["stream", "epoch", "display_no", "poc", "decode_no"]), ended, had

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        yield self._advance(key, rows)[0]

    def close(self) -> None:
        pass


REORDERED = T.StructType([T.StructField(n, T.LongType()) for n in ("stream", "epoch", "display_no", "poc", "decode_no")])


def reorder(frames: DataFrame, depth: int = 16) -> DataFrame:
    """stream, epoch, decode_no, poc, last -> display numbers, emitted as soon as the depth allows."""
    return _with_state(frames, ["stream", "epoch"], Reorder(depth), REORDERED)


class FlushBatches(StatefulProcessor):
    """Queue taken blocks of a picture and number the flushes; the last block of the picture clears the key."""

    def __init__(self, queue_max: int) -> None:
        self.queue_max = queue_max

    def init(self, handle: StatefulProcessorHandle) -> None:
        names = ("batch", "queued", "oldest_row", "left_x", "left_y")
        self.queue = handle.getValueState("queue", T.StructType([T.StructField(n, T.LongType()) for n in names]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        # in raster order only the block just before can be a left neighbour, so the queue needs no list
        had = self.queue.exists()
        batch, queued, oldest, lx, ly = self.queue.get() if had else (0, 0, -1, -2, -2)
        out = []
        done = False
        for seq, mb_x, mb_y, intra, taken, last, end in _one_frame(rows, "seq", ["mb_x", "mb_y", "intra", "taken", "last", "end"]):
            flush_first = intra and queued and (oldest < mb_y or (lx == mb_x - 1 and ly == mb_y))
            if flush_first or (taken and queued >= self.queue_max):
                batch, queued = batch + 1, 0
            if taken:
                oldest = int(mb_y) if queued == 0 else oldest
                queued += 1
                lx, ly = int(mb_x), int(mb_y)
                out.append((*key, int(seq), batch))
            if last and queued:
                batch, queued = batch + 1, 0
            if queued == 0:
                lx, ly = -2, -2
            done = done or bool(end)
        if not done:
            self.queue.update((batch, queued, oldest, lx, ly))
        elif had:
            self.queue.clear()
        yield pd.DataFrame(out, columns=["file_id", "frame", "seq", "batch_id"])

    def close(self) -> None:
        pass


BATCHED = T.StructType([T.StructField(n, T.LongType()) for n in ("file_id", "frame", "seq", "batch_id")])


def flush_batches(mb: DataFrame, queue_max: int = S.QUEUE_MAX) -> DataFrame:
    """file_id, frame, seq, mb_x, mb_y, intra, taken, last (flush after it), end (no more rows) -> batch numbers."""
    return _with_state(mb, ["file_id", "frame"], FlushBatches(queue_max), BATCHED)


def late_patch(items: DataFrame, late: DataFrame, item_keys: list[str], delay: str = "10 minutes", within: str = "1 hour") -> DataFrame:
    """Stream-stream outer join of placeholders with their later results; both sides carry ts and forget old rows.

    A placeholder without a result leaves with a NULL once the watermark has passed its time; those still waiting when a drain ends
    are added by ``run.complete``."""
    a = items.withWatermark("ts", delay).alias("a")
    b = late.withColumnRenamed("ts", "late_ts").withWatermark("late_ts", delay).alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in item_keys]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    cond = cond & (F.col("late_ts") >= F.col("ts")) & (F.col("late_ts") <= F.col("ts") + F.expr(f"INTERVAL {within}"))
    return a.join(b, cond, "left_outer").select(*[F.col(f"a.{c}") for c in items.columns], F.col("b.late_ts"), F.col("b.value").alias("late_value"))


def budget_monitor(frames: DataFrame, budget_ms: float = 33.333, window: str = "1 hour", delay: str | None = "10 minutes") -> DataFrame:
    """Frames per event-time window and run that met the budget; with a delay, later rows are dropped by the watermark."""
    f = frames.withWatermark("ts", delay) if delay else frames
    g = f.groupBy(F.window("ts", window), "run").agg(F.count("*").alias("n"), F.count_if(F.col("live_ms") <= budget_ms).alias("met"))
    return g.select(F.col("window.start").alias("hour"), "run", "n", "met")
