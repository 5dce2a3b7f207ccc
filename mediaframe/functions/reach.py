"""Which rows a forward walk visits.

Packet headers, capacity chunks and flush batches share one shape: every position knows where the
next start would be (``nxt > pos``) and only the positions reached from 0 are real starts. The walk is
serial, but it contracts: inside a block of positions each possible entry has one exit, so blocks are
solved in parallel, the much smaller entry->exit table is solved the same way with larger blocks, and
the chosen entry of every block is walked again in parallel. No group larger than one block of
positions enters a task.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.functions.bits import int_div
from mediaframe.functions.lineage import cut_lineage

FAN = 64


def _schema(edges: DataFrame, keys: Sequence[str], with_next: bool) -> T.StructType:
    fields = [edges.schema[k] for k in keys] + [T.StructField("pos", T.LongType())]
    if with_next:
        fields.append(T.StructField("nxt", T.LongType()))
    return T.StructType(fields)


def _follow(pos: np.ndarray, nxt: np.ndarray, start: int) -> np.ndarray:
    """Positions visited from start, as long as the next position exists."""
    order = np.argsort(pos)
    pos, nxt = pos[order], nxt[order]
    return pos[visited(np.zeros(len(pos), np.int64), pos, nxt, np.array([start]))]


def _exits(pos: np.ndarray, nxt: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every wanted entry that is known, and the first position outside the known ones after it. Pointer doubling, as in ``visited``."""
    if not len(pos):
        return pos, nxt
    order = np.argsort(pos)
    pos, nxt = pos[order], nxt[order]
    at = lambda p: np.minimum(np.searchsorted(pos, p), len(pos) - 1)
    jump = at(nxt)
    jump = np.where(pos[jump] == nxt, jump, np.arange(len(pos)))  # a row that leads out leads to itself
    while True:
        further = jump[jump]
        if np.array_equal(further, jump):
            break
        jump = further
    entry = at(wanted)
    entry = entry[pos[entry] == wanted]
    return pos[entry], nxt[jump[entry]]


def _frame(keys: Sequence[str], key_values, columns: dict) -> pd.DataFrame:
    cols = {c: np.asarray(v, dtype="int64") for c, v in columns.items()}
    n = len(next(iter(cols.values())))
    held = {k: np.full(n, v, dtype=object) for k, v in zip(keys, key_values)}
    return pd.DataFrame({**held, **cols})


def visited(group: np.ndarray, pos: np.ndarray, nxt: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Which rows, sorted by group and pos, a walk from start[group] visits. Pointer doubling: log2 of the longest walk passes over all rows."""
    n = len(pos)
    places = np.unique(pos)
    at = lambda g, p: g * len(places) + np.minimum(np.searchsorted(places, p), len(places) - 1)
    order = at(group, pos)

    def row(g, p):
        i = np.minimum(np.searchsorted(order, at(g, p)), n - 1)
        return np.where((group[i] == g) & (pos[i] == p), i, n)  # n: leads out of the batch

    jump = np.append(row(group, nxt), n)
    hit = np.zeros(n + 1, bool)
    hit[row(np.arange(len(start)), start)] = True
    while True:
        reached = jump[np.flatnonzero(hit[:n])]
        new = reached[(reached < n) & ~hit[reached]]
        if not len(new):
            return hit[:n]
        hit[new] = True
        jump = jump[jump]


def _walk_sorted(edges: DataFrame, keys: list[str], schema: T.StructType) -> DataFrame:
    """All groups of a partition in one sorted pass; only the position expected next is carried along."""

    def walk(batches):
        expected, last = 0, None
        for pdf in batches:
            if pdf.empty:
                continue
            ids = pdf[keys]
            change = (ids != ids.shift()).any(axis=1).to_numpy()
            change[0] = True
            group = np.cumsum(change) - 1
            start = np.zeros(group[-1] + 1, np.int64)
            start[0] = expected if last is not None and tuple(ids.iloc[0]) == last else 0
            pos, nxt = pdf["pos"].to_numpy(np.int64), pdf["nxt"].to_numpy(np.int64)
            hit = visited(group, pos, nxt, start)
            mine = np.flatnonzero(hit & (group == group[-1]))
            expected, last = int(nxt[mine[-1]] if len(mine) else start[-1]), tuple(ids.iloc[-1])
            yield pdf.loc[hit, [*keys, "pos"]]

    return edges.repartition(*keys).sortWithinPartitions(*keys, "pos").mapInPandas(walk, schema)


def reachable(edges: DataFrame, keys: Sequence[str], block: int = 1 << 16) -> DataFrame:
    """(keys, pos) of the rows visited from pos 0; ``edges`` holds keys, pos BIGINT, nxt BIGINT.

    One bounded aggregate (the largest position) decides how many levels are needed.
    """
    top = edges.agg(F.max("pos")).first()[0]
    return _reachable(edges, list(keys), block, 0 if top is None else int(top))


def _reachable(edges: DataFrame, keys: list[str], block: int, top: int) -> DataFrame:
    out_pos = _schema(edges, keys, with_next=False)
    edges = edges.select(*keys, "pos", "nxt")
    if top < block:
        return _walk_sorted(edges, keys, out_pos)

    # only groups that really outgrow a block are contracted; the others stay with the plain pass
    large = edges.groupBy(*keys).agg(F.max("pos").alias("top")).where(F.col("top") >= block).select(*keys)
    small = _walk_sorted(edges.join(large, keys, "left_anti"), keys, out_pos)
    edges = cut_lineage(edges.join(large, keys, "left_semi"))
    blk = int_div(F.col("pos"), block).alias("blk")
    cut = edges.select("*", blk)
    crossing = cut.where(int_div(F.col("nxt"), block) != F.col("blk")).select(*keys, F.col("nxt").alias("pos"))
    starts = edges.where(F.col("pos") == 0).select(*keys, "pos")
    entries = crossing.unionByName(starts).distinct().select("*", blk)
    pair = [*keys, "blk"]

    def contract(key, left, right):
        got = _exits(left["pos"].to_numpy(), left["nxt"].to_numpy(), right["pos"].to_numpy())
        return _frame(keys, key[:-1], dict(zip(("pos", "nxt"), got)))

    def expand(key, left, right):
        if len(right) == 0 or len(left) == 0:
            return _frame(keys, key[:-1], {"pos": []})
        return _frame(keys, key[:-1], {"pos": _follow(left["pos"].to_numpy(), left["nxt"].to_numpy(), int(right["pos"].iloc[0]))})

    contracted = cut.groupBy(*pair).cogroup(entries.groupBy(*pair)).applyInPandas(contract, _schema(edges, keys, True))
    chosen = _reachable(cut_lineage(contracted), keys, block * FAN, top).select("*", blk)
    return small.unionByName(cut.groupBy(*pair).cogroup(chosen.groupBy(*pair)).applyInPandas(expand, out_pos))
