"""Dependency-bounded batches of macroblocks.

Blocks queue up in decode order and the queue is flushed (a) when it is full, (b) before an intra block
whose row lies below the oldest queued block, (c) before an intra block whose left neighbour is queued,
(d) after the last block of the picture. From any start the first flush is a look-ahead to the nearest of
four marks, so batch starts are a forward walk and no task holds a whole group. Picture rows are bounded by
the picture's width, and blocks of ``ROWS`` of them hold all a block's marks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from mediaframe import schemas as S
from mediaframe.functions.lineage import cut_lineage
from mediaframe.functions.ordered import BLK, by_width, in_blocks, next_after, running_sum, scan
from mediaframe.functions.reach import reachable

ROWS = 1 << 8


def flush_batches(mb: DataFrame, keys: Sequence[str], is_last: Column, queue_max: int = S.QUEUE_MAX) -> DataFrame:
    """Taken blocks with their batch_id (0-based per group).

    ``mb`` has the keys, seq (dense, raster order), mb_x, mb_y, intra and taken.
    """
    keys, big = list(keys), lambda c: c.cast("bigint")
    base = cut_lineage(mb.select(*keys, "seq", "mb_x", "mb_y", "intra", "taken", is_last.alias("last")))
    # blocks of whole picture rows: all marks are looked up in the one partitioning
    rows = in_blocks(base, by_width("mb_y", ROWS))
    before = {"p_taken": F.col("taken"), "p_x": F.col("mb_x"), "p_y": F.col("mb_y")}
    rows = scan(rows, keys, ["seq"], None, sums={"t": (big(F.col("taken")), False)}, lag=before)
    left_queued = F.col("p_taken") & (F.col("p_x") == F.col("mb_x") - 1) & (F.col("p_y") == F.col("mb_y"))
    rows = rows.withColumn("left", F.col("intra") & left_queued).where("taken or intra or last")
    ends = F.when(F.col("last"), F.col("t") + big(F.col("taken")))
    marks = {"by_left": F.when(F.col("left"), F.col("t")), "by_last": ends}
    rows = next_after(rows, keys, ["seq"], None, marks, {"by_row": ("mb_y", F.when(F.col("intra"), F.col("t")))}).where("taken")
    nxt = F.least(F.col("t") + queue_max, "by_left", F.coalesce(ends, "by_last"), "by_row")
    edges = cut_lineage(rows.select(*keys, "seq", "mb_x", "mb_y", "t", nxt.alias("nxt")))
    starts = cut_lineage(reachable(edges.select(*keys, F.col("t").alias("pos"), "nxt"), keys))

    # a start is a row of its own in front of its block, so that numbering the batches shuffles the blocks once and joins nothing
    none = [F.lit(None).cast(edges.schema[c].dataType).alias(c) for c in ("seq", "mb_x", "mb_y")]
    both = edges.select(*keys, "t", F.lit(1).alias("own"), "seq", "mb_x", "mb_y").unionByName(starts.select(*keys, F.col("pos").alias("t"), F.lit(0).alias("own"), *none))
    numbered = running_sum(both, keys, ["t", "own"], by_width("t"), big(1 - F.col("own")), "batch_id").where("own = 1")
    return numbered.select(*keys, "seq", "mb_x", "mb_y", (F.col("batch_id") - 1).alias("batch_id"))


def batch_stats(batches: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Flushes, blocks and mean batch size per group."""
    sizes = batches.groupBy(*keys, "batch_id").agg(F.count("*").alias("n"))
    return sizes.groupBy(*keys).agg(F.count("*").alias("flushes"), F.sum("n").alias("blocks"), F.avg("n").alias("mean_size"), F.max("n").alias("max_size"))


def patch_late(rows: DataFrame, late: DataFrame, keys: Sequence[str], column: str) -> DataFrame:
    """Placeholders completed by a later keyed result; rows without one keep their value."""
    got = late.select(*keys, F.col(column).alias("__late"))
    return rows.join(got, list(keys), "left").withColumn(column, F.coalesce("__late", column)).drop("__late")


def complete_items(items: DataFrame, keys: Sequence[str], parts: Column, reason: Column) -> DataFrame:
    """Parts, one row each, of the items without a reason to decline; a declined item leaves nothing behind.

    ``parts`` is the item's array of structs and ``reason`` an expression over all of them (NULL: whole), so an item is judged on its own row
    and its parts need not be brought together again.
    """
    # not a filter: pushed below the items' own expressions, it would work them out again inside ``reason``
    return items.select(*keys, F.inline(F.when(reason.isNull(), parts)))
