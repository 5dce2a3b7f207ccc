"""Mixing sources to target weights by a low-discrepancy schedule.

The mix is a sequence of slots of ``block_words`` words. Slot i is the golden-ratio point frac(i * phi), kept as 64-bit
integers; the cumulative target shares map it to a source, so every stretch of the schedule holds the sources in proportion. A
slot's rank among its source's slots picks the block: each source's documents, in an order shuffled by hash, are one
stream of words cut into equal blocks, and rank r takes block r mod (number of blocks) in its epoch r div (number of
blocks). Slots and document pieces are joined on (source, block).

Targets: sources by code point, null last, weigh 5, 2, 1, repeating, and share the words of all; a target stops at
``most`` times its source's words and the excess is reshared by weight.

Scale: ranks come from per-chunk slot counts and a running sum over chunks; document offsets come from a blocked running sum, so no
source has to fit a task. Only one row per source reaches the driver, ``max_sources`` at most.

Defined cases: null and wordless texts have size 0 and take nothing; an empty table gives no rows; equal rows are
separate documents of the stream. The shuffled order is that of a hash of id and text, then of a hash of the whole row, so it does not depend on the
order of the input, whatever ids repeat or lack; equal rows are counted once and numbered, and never gathered. A source's taken words differ from its
target by a few blocks. Extra columns pass through ``mixed`` untouched and are not read by ``report``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from mediaframe.functions.ordered import numbered, running_sum
from mediaframe.llm.common import column, small_batches, stored

BLOCK_WORDS = 64
CHUNK = 1 << 16
WEIGHTS = (5, 2, 1)
MOST = 3
MAX_SOURCES = 100_000
ROWS_A_BUCKET = 1000
COPIES_A_TASK = 4096
GOLDEN = 0x9E3779B97F4A7C15  # 2^64 / golden ratio


def targets(sizes: list[int], weights: list[float], most: float = MOST) -> list[float]:
    """Shares of sum(sizes) by weight; what is above most * size is reshared by weight among the others."""
    out, left, open_ = [0.0] * len(sizes), float(sum(sizes)), set(range(len(sizes)))
    while open_:
        unit = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if unit * weights[i] > most * sizes[i]}
        if not over:
            for i in open_:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(most * sizes[i])
            left -= out[i]
        open_ -= over
    return out


def slot_sources(first: int, n: int, bounds: np.ndarray) -> np.ndarray:
    """Source number of slots first .. first + n - 1; bounds: cumulative shares as 64-bit integers, the last left out."""
    points = np.arange(first, first + n, dtype=np.uint64) * np.uint64(GOLDEN)
    return np.searchsorted(bounds, points, side="right")


def whole_row(docs: DataFrame) -> tuple[Column, Column]:
    """Two hashes over all columns."""
    cells = [F.to_json(F.struct(column(n))) if "map<" in t else column(n) for n, t in docs.dtypes]
    return F.xxhash64(*cells), F.hash(*cells)


def sized(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """doc_id, source, size, key (its place in the shuffled order), h1 and h2 (hashes of the row), copies: a row per distinct row."""
    words = F.coalesce(F.regexp_count(column(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("bigint")
    parts = F.concat(F.coalesce(column(doc_id).cast("string"), F.lit("")), F.lit(":"), F.md5(F.coalesce(column(text), F.lit("")).cast("binary")))
    h1, h2 = whole_row(docs)
    rows = docs.select(column(doc_id).alias("doc_id"), column(source).alias("source"), words.alias("size"), F.md5(parts.cast("binary")).alias("key"), h1.alias("h1"), h2.alias("h2"))
    return rows.groupBy(*rows.columns).agg(F.count("*").alias("copies"))


def plan(rows: DataFrame, weights=WEIGHTS, most: float = MOST, block_words: int = BLOCK_WORDS, max_sources: int = MAX_SOURCES) -> pd.DataFrame:
    """One row per source: source, no, source_size, target, blocks."""
    found = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("docs")).limit(max_sources + 1).collect()
    if len(found) > max_sources:
        raise ValueError(f"more than {max_sources} sources; merge them before mixing")
    found.sort(key=lambda r: (r["source"] is None, r["source"] or ""))
    sizes = [r["source_size"] for r in found]
    t = targets(sizes, [weights[i % len(weights)] for i in range(len(found))], most)
    return pd.DataFrame({
        "source": pd.Series([r["source"] for r in found], dtype=object), "no": range(len(found)), "source_size": sizes, "target": t,
        "blocks": [-(-s // block_words) for s in sizes], "docs": [r["docs"] for r in found],
    })


def schedule(spark, sources: pd.DataFrame, most: int = MOST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, no (source number), epoch, block for every slot of the mix."""
    total = float(sources["target"].sum())
    slots = -(-int(total) // block_words)
    shares = np.cumsum(sources["target"].to_numpy() / max(total, 1.0))[:-1]
    bounds = np.array([min(int(x * 2**64), 2**64 - 1) for x in shares], np.uint64)
    blocks = sources["blocks"].to_numpy(np.int64)
    chunks = -(-slots // CHUNK)

    def count(batches):
        for df in batches:
            for c in df["id"]:
                no, n = np.unique(slot_sources(c * CHUNK, min(CHUNK, slots - c * CHUNK), bounds), return_counts=True)
                yield pd.DataFrame({"chunk": c, "no": no, "n": n})

    def expand(batches):
        for df in batches:
            for c, nos, firsts in zip(df["chunk"], df["nos"], df["firsts"], strict=True):
                no = slot_sources(c * CHUNK, min(CHUNK, slots - c * CHUNK), bounds)
                by_source = np.argsort(no, kind="stable")
                found, starts, n = np.unique(no[by_source], return_index=True, return_counts=True)
                before = dict(zip(nos, firsts, strict=True))
                rank = np.empty(len(no), np.int64)
                rank[by_source] = np.arange(len(no)) - np.repeat(starts - [before[s] for s in found], n)
                b = np.maximum(blocks[no], 1)
                yield pd.DataFrame({"slot": c * CHUNK + np.arange(len(no)), "no": no, "epoch": rank // b, "block": rank % b})

    # a fixed number of parts: a chunk is a tiny row that becomes many slots, which adaptive coalescing cannot know
    parts = max(1, min(chunks, 10_000))
    counts = spark.range(0, chunks, 1, parts).mapInPandas(count, "chunk long, no int, n long")
    before = Window.partitionBy("no").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    ranks = counts.select("chunk", "no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("first"))
    ranks = ranks.groupBy("chunk").agg(F.collect_list(F.struct("no", "first")).alias("s")).select("chunk", F.col("s.no").alias("nos"), F.col("s.first").alias("firsts"))
    # an epoch past the last allowed one only arises from rounding up to whole blocks
    return ranks.repartition(parts, "chunk").mapInPandas(expand, "slot long, no int, epoch long, block long").where(F.col("epoch") < most)


def streams(rows: DataFrame, sources: pd.DataFrame) -> DataFrame:
    """A row per document (equal rows numbered in ``copy``) with no and off: the words of its source that stand before it in the shuffled stream."""
    spark, digits, n = rows.sparkSession, 0, int(sources["docs"].max()) if len(sources) else 0
    while n > ROWS_A_BUCKET * 16**digits:
        digits += 1
    listed = spark.createDataFrame(sources[["source", "no", "source_size", "target"]].values.tolist(), "source string, no int, source_size long, target double")
    known = F.broadcast(listed.withColumnRenamed("source", "__s"))  # at most max_sources rows
    rows = rows.join(known, F.col("source").eqNullSafe(F.col("__s"))).drop("__s")
    group = running_sum(rows, ["no"], ["key", "h1", "h2"], F.substring("key", 1, digits), F.col("size") * F.col("copies"), "off", inclusive=False)
    return numbered(group, "copies", "copy").withColumn("off", F.col("off") + F.col("copy") * F.col("size")).drop("key")


def _taken(placed: DataFrame, sources: pd.DataFrame, most: int, block_words: int) -> DataFrame:
    """no, off, epoch, words: what each document gives in each epoch."""
    # the planner takes generated slots for as few as the chunks they come from; they must not be broadcast
    used = schedule(placed.sparkSession, sources, most, block_words).select("no", "block", "epoch")
    first, last = F.floor(F.col("off") / block_words), F.floor((F.col("off") + F.col("size") - 1) / block_words)
    pieces = placed.where("size > 0").select("no", "off", "size", F.explode(F.sequence(first, last)).alias("block"))
    start, end = F.col("block") * block_words, (F.col("block") + 1) * block_words
    words = F.least(end, F.col("off") + F.col("size")) - F.greatest(start, F.col("off"))
    return pieces.select("no", "off", "block", words.alias("words")).join(used.hint("merge"), ["no", "block"]).groupBy("no", "off", "epoch").agg(F.sum("words").alias("words"))


def _placed(docs: DataFrame, doc_id: str, source: str, text: str, weights, most: int, block_words: int):
    rows = stored(sized(docs, doc_id, source, text), "sizes")
    sources = plan(rows, weights, most, block_words)
    return stored(streams(rows, sources), "streams"), sources


def report(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """Per document: doc_id, source, size, source_size, target (its source's), taken."""
    placed, sources = _placed(docs, doc_id, source, text, weights, most, block_words)
    taken = _taken(placed, sources, most, block_words).groupBy("no", "off").agg(F.sum("words").alias("taken"))
    keyed = placed.withColumn("at", F.when(F.col("size") > 0, F.col("off")))  # a document without words shares its offset
    joined = keyed.join(taken.select("no", F.col("off").alias("at"), "taken").hint("merge"), ["no", "at"], "left")
    return joined.select("doc_id", "source", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("bigint").alias("taken"))


@F.pandas_udf(T.StringType())
def _head(texts: pd.Series, words: pd.Series) -> pd.Series:
    """The first ``words`` words of a text, as they stand; null where either is null."""
    out = []
    for t, n in zip(texts, words, strict=True):
        if t is None or pd.isna(n):
            out.append(None)
            continue
        raw = t.encode("utf-8", "surrogatepass")
        rest = raw.split(None, int(n))
        cut = raw[: len(raw) - len(rest[-1])] if len(rest) > n else raw
        out.append(cut.rstrip().decode("utf-8", "surrogatepass"))
    return pd.Series(out, dtype=object)


def mixed(docs: DataFrame, doc_id: str = "doc_id", source: str = "source", text: str = "text", weights=WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix itself: a row per document and epoch that takes it, with the columns of docs, mix_epoch and mix_words. The
    last document an epoch takes of a source is cut to the words taken."""
    placed, sources = _placed(docs, doc_id, source, text, weights, most, block_words)
    parts = placed.where("size > 0").select("no", "off", "size", "h1", "h2", "copy")
    parts = parts.join(_taken(placed, sources, most, block_words).hint("merge"), ["no", "off"])
    dealt = lambda n: F.floor(F.col(n) / COPIES_A_TASK).alias("__deal")
    parts = parts.select(F.col("h1").alias("__p1"), F.col("h2").alias("__p2"), dealt("copy"), F.col("size").alias("__size"), F.col("epoch").alias("__epoch"), F.col("words").alias("__words"))
    # equal rows are one row here, before they are shuffled, and many again only after the join, dealt over tasks
    h1, h2 = whole_row(docs)
    rows = small_batches(docs).select("*", h1.alias("__h1"), h2.alias("__h2"))
    rows = rows.groupBy("__h1", "__h2").agg(F.count("*").alias("__n"), *[F.first(column(c)).alias(c) for c in docs.columns])
    deals = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("__n") - 1) / COPIES_A_TASK))
    rows = rows.select("*", F.explode(deals).alias("__d"))
    out = rows.join(parts.hint("merge"), (F.col("__h1") == F.col("__p1")) & (F.col("__h2") == F.col("__p2")) & (F.col("__d") == F.col("__deal")))
    part = F.col("__words") < F.col("__size")
    cut = F.when(part, _head(F.when(part, column(text)), F.when(part, F.col("__words")))).otherwise(column(text))
    kept = [cut.alias(c) if c == text else column(c) for c in docs.columns]
    return out.select(*kept, F.col("__epoch").alias("mix_epoch"), F.col("__words").alias("mix_words"))
