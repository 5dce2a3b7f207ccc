"""Ordered scans that survive hot groups.

A plain window puts a whole group into one task. Here each group is cut into blocks by a
non-decreasing function of its leading order column: the window runs inside (group, block), a second
window runs over the one-row-per-block totals, and both are joined on (group, block). Big rows are
shuffled once, on the pair. A block is bounded as long as the order column repeats a bounded number
of times inside a group, which holds for the sample, frame, word and time orders used here.

``keys`` and ``order`` are column names (NOT NULL); ``block`` is a Column. A frame that already carries the
``__blk`` column (see ``in_blocks``) keeps it, and a chain of scans over the same blocks shuffles once.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window, WindowSpec

from mediaframe.functions.bits import int_div

BLK = "__blk"


def by_width(name: str, width: int = 1 << 16) -> Column:
    """Block number of an integer order column."""
    return int_div(F.col(name), width)


def by_span(name: str, seconds: int = 600) -> Column:
    """Block number of a timestamp order column: a block holds what one key sends in ``seconds``, the block totals what is left of time."""
    return int_div(F.unix_seconds(F.col(name).cast("timestamp")), seconds)


def in_blocks(df: DataFrame, block: Column) -> DataFrame:
    """Attach the block number; the scans below then reuse the partitioning instead of shuffling again."""
    return df.withColumn(BLK, block)


def _blocked(df: DataFrame, block: Column | None, keys: Sequence[str]) -> DataFrame:
    """df with its block number; a NULL key would be lost in the joins below, so it fails instead."""
    if BLK in df.columns:
        return df
    for k in keys:
        block = F.when(F.col(k).isNotNull(), block).otherwise(F.raise_error(F.lit(f"NULL in the key {k} of an ordered scan")))
    return df.withColumn(BLK, block)


def _kept(df: DataFrame) -> list[Column]:
    return [F.col(f"`{c}`") for c in df.columns]


def _inner(keys: Sequence[str], order: Sequence[str], desc: bool = False) -> WindowSpec:
    cols = [F.col(c).desc() if desc else F.col(c) for c in order]
    return Window.partitionBy(*keys, BLK).orderBy(*cols)


def _outer(keys: Sequence[str], desc: bool = False) -> WindowSpec:
    return Window.partitionBy(*keys).orderBy(F.col(BLK).desc() if desc else F.col(BLK))


_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, Window.currentRow)


def _order_key(order: Sequence[str]) -> Column:
    """A single order column keeps max_by on plain values, which hash-aggregate; several need a struct and a sort."""
    return F.col(order[0]) if len(order) == 1 else F.struct(*[F.col(c) for c in order])


def _edge_value(order: Sequence[str], value: str, last: bool) -> Column:
    pick = F.max_by if last else F.min_by
    # the key is NULL where the value is, so those rows are never picked
    return pick(F.col(value), F.when(F.col(value).isNotNull(), _order_key(order)))


def scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    block: Column | None,
    sums: Mapping[str, tuple[Column, bool]] | None = None,
    last: Mapping[str, tuple[Column, bool]] | None = None,
    lag: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Any number of forward scans over the same order in one pass: one shuffle of the rows, one table of block totals.

    ``sums`` maps a name to (integer value, inclusive), ``last`` to (value, strict) for the last non-NULL value at or
    before a row, ``lag`` to the value of the previous row. Plain values and a single order column are cheapest.
    """
    sums, last, lag = sums or {}, last or {}, lag or {}
    base = _blocked(df, block, keys)
    for n, v in [*((n, v) for n, (v, _) in sums.items()), *((n, v) for n, (v, _) in last.items()), *lag.items()]:
        base = base.withColumn("__v_" + n, v)
    names = [*sums, *last, *lag]

    totals = [F.sum("__v_" + n) for n in sums] + [_edge_value(order, "__v_" + n, True) for n in last]
    totals += [F.max_by("__v_" + n, _order_key(order)) for n in lag]
    ends = base.groupBy(*keys, BLK).agg(*[t.alias("__t_" + n) for n, t in zip(names, totals)])
    outer = _outer(keys)
    before = outer.rowsBetween(*_BEFORE)
    prefix = [F.coalesce(F.sum("__t_" + n).over(before), F.lit(0)) for n in sums]
    prefix += [F.last("__t_" + n, ignorenulls=True).over(before) for n in last]
    prefix += [F.lag("__t_" + n, 1).over(outer) for n in lag]  # blocks without rows do not exist
    prefix = ends.select(*keys, BLK, *[p.alias("__p_" + n) for n, p in zip(names, prefix)])

    inner = _inner(keys, order)
    rows = lambda cut: inner.rowsBetween(*(_BEFORE if cut else _UPTO))
    local = [F.coalesce(F.sum("__v_" + n).over(rows(not incl)), F.lit(0)) for n, (_, incl) in sums.items()]
    local += [F.last("__v_" + n, ignorenulls=True).over(rows(strict)) for n, (_, strict) in last.items()]
    local += [F.lag("__v_" + n, 1).over(inner) for n in lag]
    local = [c.alias("__i_" + n) for n, c in zip(names, local)]
    if lag:
        local.append((F.row_number().over(inner) == 1).alias("__first"))
    joined = base.select("*", *local).join(prefix, [*keys, BLK])

    p, i = (lambda n: F.col("__p_" + n)), (lambda n: F.col("__i_" + n))
    out = [(p(n) + i(n)).alias(n) for n in sums] + [F.coalesce(i(n), p(n)).alias(n) for n in last]
    out += [F.when(F.col("__first"), p(n)).otherwise(i(n)).alias(n) for n in lag]
    return joined.select(*_kept(df), *out)


def running_sums(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | None, sums: Mapping[str, tuple[Column, bool]]
) -> DataFrame:
    """Add running sums; ``sums`` maps output name to (integer value, inclusive)."""
    return scan(df, keys, order, block, sums=sums)


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | None, value: Column, out: str, inclusive: bool = True
) -> DataFrame:
    return running_sums(df, keys, order, block, {out: (value, inclusive)})


def row_index(df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column | None, out: str) -> DataFrame:
    """0-based position of every row inside its group."""
    return running_sum(df, keys, order, block, F.lit(1).cast("bigint"), out, inclusive=False)


def last_at(df, keys, order, block, values: Mapping[str, Column], strict: bool = False) -> DataFrame:
    """Last non-NULL value at (or, if strict, before) every row."""
    return scan(df, keys, order, block, last={n: (v, strict) for n, v in values.items()})


def lag_rows(df, keys, order, block, values: Mapping[str, Column]) -> DataFrame:
    """Value of the previous row of the group; NULL on the first one (a NULL value stays NULL)."""
    return scan(df, keys, order, block, lag=values)


def next_after(df, keys, order, block, values: Mapping[str, Column], beyond: Mapping[str, tuple[str, Column]] | None = None) -> DataFrame:
    """First non-NULL value after every row.

    ``beyond`` maps a name to (integer column, value): the smallest value on rows with a larger column. That column never falls along
    ``order``, and a block holds all rows of each of its values.
    """
    beyond = beyond or {}
    base = _blocked(df, block, keys)
    for name, value in [*values.items(), *((n, v) for n, (_, v) in beyond.items())]:
        base = base.withColumn("__v_" + name, value)
    ends = [_edge_value(order, "__v_" + n, False) for n in values] + [F.min("__v_" + n) for n in beyond]
    ends = base.groupBy(*keys, BLK).agg(*[e.alias("__e_" + n) for n, e in zip([*values, *beyond], ends)])
    outer, inner = _outer(keys, desc=True).rowsBetween(*_BEFORE), _inner(keys, order, desc=True).rowsBetween(*_BEFORE)
    suffix = [F.last("__e_" + n, ignorenulls=True).over(outer).alias("__p_" + n) for n in values]
    suffix += [F.min("__e_" + n).over(outer).alias("__p_" + n) for n in beyond]
    suffix = ends.select(*keys, BLK, *suffix)
    inside = [F.last("__v_" + n, ignorenulls=True).over(inner).alias("__i_" + n) for n in values]
    inside += [F.min("__v_" + n).over(_inner(keys, [c], desc=True).rangeBetween(*_BEFORE)).alias("__i_" + n) for n, (c, _) in beyond.items()]
    joined = base.select("*", *inside).join(suffix, [*keys, BLK])
    out = [F.coalesce("__i_" + n, "__p_" + n).alias(n) for n in values] + [F.least("__i_" + n, "__p_" + n).alias(n) for n in beyond]
    return joined.select(*_kept(df), *out)


GROUP_LIMIT = 1000  # Spark trims top-k windows before the shuffle only up to this k
SALTS = 64


def first_k(df: DataFrame, keys: Sequence[str], order: Sequence[str], k: int, out: str = "rank") -> DataFrame:
    """First k rows per group (0-based rank).

    Up to k = 1000 Spark trims each map task to k rows per group before the shuffle. Beyond that the group is first
    ranked in salted parts, so the final window sees at most SALTS * k rows of it.
    """
    if k > GROUP_LIMIT:
        df = df.withColumn("__salt", F.pmod(F.xxhash64(*order), F.lit(SALTS)))
        part = Window.partitionBy(*keys, "__salt").orderBy(*order)
        df = df.withColumn(out, F.row_number().over(part)).where(F.col(out) <= k).drop("__salt", out)
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(out, F.row_number().over(w)).where(F.col(out) <= k).withColumn(out, F.col(out) - 1)


def numbered(df: DataFrame, count: str, out: str, width: int = 1 << 16) -> DataFrame:
    """One row per number 0 .. count - 1 beside each row. Numbers are dealt in steps of ``width``, so a count of billions is never
    one array."""
    steps = F.sequence(F.lit(0).cast("bigint"), int_div(F.col(count) - 1, width))
    some = df.where(F.col(count) > 0).select("*", F.explode(steps).alias("__step"))
    first = F.col("__step") * width
    inside = F.sequence(first, F.least(first + (width - 1), F.col(count) - 1))
    return some.select(*_kept(df), F.explode(inside).alias(out))


def with_halo(df: DataFrame, pos: str, before: int, after: int, width: int = 1 << 16) -> DataFrame:
    """Cut a dense integer position into blocks and copy the rows near an edge into the neighbouring block.

    Adds __blk and halo; windows over (group, __blk) then see ``before`` rows back and ``after`` rows ahead of every
    row with halo = false. Only edge rows are copied, so one shuffle does.
    """
    b, r = int_div(F.col(pos), width), F.col(pos) % width
    own = F.struct(b.alias(BLK), F.lit(False).alias("halo"))
    nxt = F.when(r >= width - before, F.struct((b + 1).alias(BLK), F.lit(True).alias("halo")))
    prv = F.when((r < after) & (b > 0), F.struct((b - 1).alias(BLK), F.lit(True).alias("halo")))
    return df.select("*", F.inline(F.array_compact(F.array(own, nxt, prv))))
