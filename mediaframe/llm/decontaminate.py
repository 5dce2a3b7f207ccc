"""Benchmark decontamination by a broadcast hash set of test n-grams.

Words are runs of ASCII letters, digits and non-ASCII characters, after lower-casing A-Z. A window is ``width``
consecutive words of an item; a shorter item is one window. The windows' rolling hashes are one sorted array that every
task holds; training texts are turned into word numbers, hashed at every position in numpy, looked up in the array, and
each hit is verified against the window's words.

Size bound: items are broadcast in blocks of at most ``block_bytes`` of text. A long item is first cut into parts that share ``width`` - 1 words, which have
the item's windows; only a single word, or ``width`` of them, longer than a block makes a larger one. Every block scans all documents; between
blocks the hits found so far are written to the shared folder, so neither a task nor the driver holds more than one block.

Defined cases: null and wordless texts have no words and no hits; null and wordless items have no windows; repeated
items count once by item_id, a null item_id marks words but is no item; several rows of one document stay several rows;
other columns pass through untouched.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.llm.common import column, runs, small_batches, stored, utf8

WIDTH = 10
BLOCK_BYTES = 32 << 20
#: upper case to lower case, everything that is no word character to a space
_FOLD = bytes(i + 32 if 65 <= i <= 90 else i if 48 <= i <= 57 or 97 <= i <= 122 or i > 127 else 32 for i in range(256))
_WORD = re.compile(r"[0-9A-Za-z\u0080-\U0010ffff]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)

HITS = T.StructType([
    T.StructField("n_words", T.LongType()),
    T.StructField("spans", T.ArrayType(T.IntegerType())),  # word offsets, start and end in turn, disjoint and sorted
    T.StructField("items", T.ArrayType(T.LongType())),
])


def words(text: str | None) -> list[bytes]:
    return utf8(text).translate(_FOLD).split()


def _hash(columns) -> np.ndarray:
    h = None
    for c in columns:
        c = c.astype(np.uint64)
        h = c if h is None else h * _MULT + c
    return h


@dataclass
class NgramIndex:
    """word -> number, window (numbers) -> item numbers, and per window length the sorted hashes."""

    vocabulary: dict[bytes, int] = field(default_factory=dict)
    windows: dict[tuple[int, ...], list[int | None]] = field(default_factory=dict)
    hashes: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def build(cls, items, width: int = WIDTH) -> NgramIndex:
        self = cls()
        found: dict[tuple[int, ...], set] = {}
        for item_id, text in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words(text)]
            for i in range(max(1, len(ids) - width + 1) if ids else 0):
                found.setdefault(tuple(ids[i : i + width]), set()).add(item_id)
        self.windows = {k: list(v) for k, v in found.items()}
        for m in {len(k) for k in found}:
            keys = np.array([k for k in found if len(k) == m], dtype=np.int64)
            self.hashes[m] = np.unique(_hash(keys.T))
        return self

    def candidates(self, ids: np.ndarray, m: int) -> np.ndarray:
        """Positions of ``ids`` (0: no benchmark word) whose m-word window has a hash of the index."""
        if len(ids) < m:
            return np.empty(0, np.int64)
        unknown = np.concatenate(([0], np.cumsum(ids == 0)))
        at = np.flatnonzero(unknown[m:] == unknown[:-m])
        h = _hash(ids[at + j] for j in range(m))
        known = self.hashes[m]
        slot = np.minimum(np.searchsorted(known, h), len(known) - 1)
        return at[known[slot] == h]

    def scan(self, texts) -> list[tuple[int, list[int], list[int]]]:
        """(word count, hit spans, items) of each text."""
        number, rows, sizes = self.vocabulary.get, [], []
        for t in texts:
            w = words(t)
            rows.append(np.fromiter((number(x, 0) for x in w), np.int64, len(w)))
            sizes.append(len(w))
        gap = np.zeros(1, np.int64)  # no window reaches across two texts
        ids = np.concatenate([x for r in rows for x in (r, gap)]) if rows else gap
        starts = np.concatenate(([0], np.cumsum(np.array(sizes, np.int64) + 1)))[:-1]
        cover = np.zeros(len(ids) + 1, np.int64)
        items: dict[int, set] = {}
        for m in self.hashes:
            for i in self.candidates(ids, m).tolist():
                hit = self.windows.get(tuple(ids[i : i + m].tolist()))
                if hit is not None:
                    cover[i] += 1
                    cover[i + m] -= 1
                    items.setdefault(int(np.searchsorted(starts, i, "right")) - 1, set()).update(hit)
        edge = np.flatnonzero(np.diff(np.concatenate(([0], (np.cumsum(cover[:-1]) > 0).astype(np.int8), [0]))))
        owner = np.searchsorted(starts, edge, "right") - 1  # a run ends at its text's gap at the latest
        spans: dict[int, list[int]] = {}
        for e, o in zip((edge - starts[owner]).tolist(), owner.tolist(), strict=True):
            spans.setdefault(o, []).append(e)
        return [(n, spans.get(k, []), sorted(x for x in items.get(k, ()) if x is not None)) for k, n in enumerate(sizes)]


def _merge(a: list[int], b: list[int]) -> list[int]:
    out: list[int] = []
    for s, e in sorted([*zip(a[::2], a[1::2], strict=True), *zip(b[::2], b[1::2], strict=True)]):
        if out and s <= out[-1]:
            out[-1] = max(out[-1], e)
        else:
            out += [s, e]
    return out


def without_spans(text: str, spans: list[int]) -> str:
    """The text without its hit words; what stood between two removed words goes with them."""
    at = [m.span() for m in _WORD.finditer(text)]
    out, last = [], 0
    for s, e in zip(spans[::2], spans[1::2], strict=True):
        out.append(text[last : at[s][0]])
        last = at[e - 1][1]
    return "".join([*out, text[last:]])


def item_parts(text: str, width: int, part_bytes: int) -> list[str]:
    """The text, or pieces of about ``part_bytes`` that share ``width`` - 1 words and together hold each of its windows once."""
    if len(utf8(text)) <= part_bytes:
        return [text]
    at = [m.span() for m in _WORD.finditer(text)]
    out, i = [], 0
    while i == 0 or i + width <= len(at):
        j = min(i + width, len(at))
        while j < len(at) and at[j][1] - at[i][0] <= part_bytes // 4:  # a character has four bytes at most
            j += 1
        out.append(text[at[i][0] : at[j - 1][1]] if at else "")
        i = j - width + 1 if j < len(at) else len(at)
        if i >= len(at):
            break
    return out


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int, width: int = WIDTH):
    """Items, long ones in parts, in lists of at most ``block_bytes`` of text each, one after the other; sizes are added up before anything is collected."""

    @F.pandas_udf("array<string>")
    def cut(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: item_parts(t, width, max(block_bytes // 16, 1)))

    whole = benchmark.select(column(item_id).cast("bigint").alias("i"), column(text).alias("t")).where(F.col("t").isNotNull()).distinct()
    items = stored(small_batches(whole).select("i", F.explode(cut("t")).alias("t")), "items")
    sized = items.withColumn("n", F.octet_length("t").cast("bigint"))
    total = sized.agg(F.sum("n")).first()[0]
    # each item hashes to a part; parts are packed into blocks by their summed size
    parts = max(1, 64 * -(-(total or 0) // block_bytes))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(parts))
    group, size = [], 0
    for p, n in sized.groupBy(part.alias("p")).agg(F.sum("n")).orderBy("p").collect():
        if group and size + n > block_bytes:
            yield sized.where(part.isin(group)).select("i", "t").collect()
            group, size = [], 0
        group.append(p)
        size += n
    yield sized.where(part.isin(group)).select("i", "t").collect()


def _first(index):
    @F.pandas_udf(HITS)
    def scan(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([x for a, b in runs(texts) for x in index.value.scan(texts.iloc[a:b])], columns=HITS.names)

    return scan


def _later(index):
    @F.pandas_udf(HITS)
    def scan(texts: pd.Series, old: pd.DataFrame) -> pd.DataFrame:
        new = (x for a, b in runs(texts) for x in index.value.scan(texts.iloc[a:b]))
        both = [(n, _merge(s, list(p)), sorted({*i, *q})) for (n, s, i), p, q in zip(new, old["spans"], old["items"], strict=True)]
        return pd.DataFrame(both, columns=HITS.names)

    return scan


def find_hits(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item_id: str = "item_id", item_text: str = "text",
    width: int = WIDTH, block_bytes: int = BLOCK_BYTES, out: str = "hits",
) -> DataFrame:
    """docs with the struct column ``out`` (n_words, spans, items)."""
    docs = small_batches(docs)
    blocks = _blocks(benchmark, item_id, item_text, block_bytes, width)
    block, first = next(blocks), True
    while block is not None:
        index = docs.sparkSession.sparkContext.broadcast(NgramIndex.build([tuple(r) for r in block], width))
        docs = docs.withColumn(out, _first(index)(column(text)) if first else _later(index)(column(text), column(out)))
        block, first = next(blocks, None), False
        if block is not None:
            docs = stored(docs, "hits")
            index.destroy()
    return docs


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text", **options) -> DataFrame:
    """Drop the documents with a hit (``remove="documents"``) or only their hit words (``"spans"``); same columns as docs."""
    hits = "__hits"
    found = find_hits(docs, benchmark, text=text, out=hits, **options)
    if remove == "documents":
        return found.where(F.size(f"{hits}.spans") == 0).drop(hits)
    if remove != "spans":
        raise ValueError("remove: documents or spans")

    @F.pandas_udf("string")
    def cut(texts: pd.Series, spans: pd.Series) -> pd.Series:
        return pd.Series([without_spans(t or "", list(s)) for t, s in zip(texts, spans, strict=True)], dtype=object)

    cleaned = F.when(F.size(f"{hits}.spans") > 0, cut(F.when(F.size(f"{hits}.spans") > 0, column(text)), F.col(f"{hits}.spans"))).otherwise(column(text))
    return found.withColumn(text, cleaned).drop(hits)



def report(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    narrow = docs.select(column(doc_id).alias("doc_id"), column(text).alias("text"))
    h = find_hits(narrow, benchmark, text="text", **options)
    n_hit = F.aggregate("hits.spans", F.struct(F.lit(0).alias("n"), F.lit(-1).alias("sign")),
                        lambda a, x: F.struct((a.n + a.sign * x).alias("n"), (-a.sign).alias("sign")), lambda a: a.n)
    ids = F.array_sort(F.transform("hits.items", lambda x: x.cast("string")))
    return h.select(
        "doc_id", F.col("hits.n_words").alias("n_words"), n_hit.cast("bigint").alias("n_hit"), F.size(ids).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )
