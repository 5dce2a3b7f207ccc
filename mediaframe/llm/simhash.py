"""SimHash near-duplicates by tiled exact comparison.

A document's fingerprint has bit b set if over half of its word shingles' XXH64 hashes have it. Fingerprints at most
``radius`` bits apart are linked, and documents reachable over links form a component.

Every link is found. Cut 64 bits into ``bands`` ranges: fingerprints at most r bits apart agree on at least bands - r of
them, so rows meet only in cells, one for each choice of bands - r ranges and their value. A cell of more than ``tile`` fingerprints is dealt into
tiles in the order of their population counts, and its tiles are compared pair by pair, each pair in a task of its own; a row is sent to no pair whose
other tile holds only counts beyond the radius, as such fingerprints cannot be linked. Inside a pair the rows stand by population count, and a row is compared
with the rows in reach of its count alone, by numpy exclusive-or and bit counts. A tile pair returns a spanning forest of its
links instead of all of them: the same components with fewer rows than fingerprints.

*Similar texts* (``keep_similar``, the pipeline's stage). A radius of 4 finds very close copies only, so this stage links texts by their sets of five-word shingles, and
loses no link. Two sets of similarity s or more share one of the first n - ceil(s n) + 1 shingles of each, in any one order of all shingles; rows meet in a cell for each of
these. The order is free, so shingles that are common in a bounded sample of the texts (SAMPLE) come last, and passages that many texts repeat make no large cells. Cells of
the same rows are one. Sets of over 512 shingles are cut by the hash into pieces, one of which is as similar as the sets or more, and the pieces meet. Inside a cell, rows are compared by a lower bound of the difference of their sets: the parity of the shingles of each of 512 hash values. The
candidates' components hold all true ones. Each row's first candidate is confirmed by the two texts; where that leaves a candidate component in several parts, all pairs between
the parts are compared by the sets themselves, in tiles of bounded weight.

Copies meet first: one row per distinct fingerprint carries its smallest doc_id, by partial aggregation. Components come
from rounds of minimum-label hooking and pointer jumping over the fingerprints that have a link; the label tables of each
round are written to the shared folder.

Defined cases: null, empty and wordless texts have fingerprint zero and are linked like any other; a text shorter than
the shingle is one shingle; a null doc_id never names a component unless all of its documents have none; repeated rows
stay repeated rows in the report, while ``keep_one`` judges rows and keeps one of them. Extra columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mediaframe.functions.batches import small_batches as bounded_batches
from mediaframe.functions.skew import spread_join
from mediaframe.llm.common import column, small_batches, stored, utf8

SHINGLE = 4
RADIUS = 4
SEED = 42
BANDS = 6
TILE = 4096
SMALL = 32  # rows of a cell that are compared for all cells of a batch at once
FEW_CELLS = 20_000
_LOW = bytes(i + 32 if 65 <= i <= 90 else i for i in range(256))


#: of keep_similar
SIMILAR_SHINGLE = 5
SIMILARITY = 0.8
PARITY = [f"b{i}" for i in range(8)]
SLACK = 1e-9
SAMPLE = 8000  # texts whose shingles are counted for the order
COMMON = 5  # texts of the sample that hold a common shingle, at least
MOST_COMMON = 100_000
HEAVY = 1 << 20  # shingles of a tile of texts


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    words = utf8(text).translate(_LOW).split()
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    last = ends[min(shingle, len(words)) - 1 :]
    first = np.concatenate(([0], ends[:-1] + 1))[: len(last)]
    h = xxhash.xxh64_intdigest
    ones, n = np.zeros(64, np.int64), len(last)
    for k in range(0, n, 1 << 16):
        part = zip(first[k : k + (1 << 16)].tolist(), last[k : k + (1 << 16)].tolist(), strict=True)
        hashes = np.fromiter((h(joined[a:b], SEED) for a, b in part), "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _prints(shingle: int):
    @F.pandas_udf("long")
    def prints(texts: pd.Series) -> pd.Series:
        return pd.Series([_signed(fingerprint(t, shingle)) for t in texts], dtype="int64")

    return prints


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long)."""
    return small_batches(docs).select(column(doc_id).alias("doc_id"), _prints(shingle)(column(text)).alias("fp"))


def band_masks(radius: int, bands: int) -> list[int]:
    """Masks of which any two 64-bit values at most ``radius`` bits apart agree on one."""
    edges = [64 * i // bands for i in range(bands + 1)]
    ranges = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:], strict=False)]
    return [sum(chosen) for chosen in combinations(ranges, bands - radius)]


def _radius(similarity: float, sizes):
    """The most elements by which two sets of that similarity differ, by the sum of their sizes."""
    return (1 - similarity) / (1 + similarity) * sizes + SLACK


def forest(v: np.ndarray, side: np.ndarray, radius: float, size: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Spanning forest of the links between rows of v (rows x 64-bit words), as pairs of row numbers, the smaller value first reached.

    Rows stand by population count; each row, once reached, is compared with the rows not yet reached whose counts lie within the radius. ``side`` (0 or 1 a row)
    only allows links between unlike sides, unless all are alike: two tiles are linked to each other, a tile to itself. With ``size``, rows are parities of sets of so many
    elements, ``radius`` is a similarity of sets, and rows are linked unless their difference rules it out.
    """
    count = np.bitwise_count(v).sum(axis=1, dtype=np.int16) if size is None else size
    order = np.lexsort((*v.T[::-1], count))
    v, count, side = v[order], count[order], side[order]
    two = len(side) > 0 and side.min() != side.max()
    free = np.ones(len(v), bool)
    least, most = (count - radius, count + radius) if size is None else (count * radius - SLACK, count / radius + SLACK)
    lo, hi = np.searchsorted(count, least), np.searchsorted(count, most, side="right")
    out = []
    for start in range(len(v)):
        if not free[start]:
            continue
        free[start] = False
        reached = [start]
        while reached:
            i = reached.pop()
            near = np.arange(lo[i], hi[i])[free[lo[i] : hi[i]]]
            if two:
                near = near[side[near] != side[i]]
            if not len(near):
                continue
            far = np.zeros(len(near), np.uint16)
            for w in range(v.shape[1]):
                far += np.bitwise_count(v[near, w] ^ v[i, w])
            near = near[far <= (radius if size is None else _radius(radius, count[near] + count[i]))]
            free[near] = False
            out += [(int(order[i]), int(order[j])) for j in near]
            reached += near[::-1].tolist()
    return out


def _tiles(batches, radius: float, keys: list[str], values: list[str], name: str, size: str | None = None):
    """Rows sorted by cell and tile pair; a tile pair is complete when the next one begins."""
    rest = None

    def links(df: pd.DataFrame):
        k = df[keys].to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(axis=1), [True])))
        v, side = df[values].to_numpy().view(np.uint64), (df["t"] != df["a"]).to_numpy().astype(np.int8)
        one = (df["a"] == df["b"]).to_numpy()
        rows, found = df[name].to_numpy(), []
        n = None if size is None else df[size].to_numpy().astype(np.int64)
        length = np.diff(edge)
        group, small = np.repeat(np.arange(len(length)), length), np.repeat(length <= SMALL, length)
        wanted = length > SMALL
        for d in range(1, min(SMALL, length.max(initial=0))):
            i = np.flatnonzero((group[d:] == group[:-d]) & small[d:])
            far = sum(np.bitwise_count(v[i, w] ^ v[i + d, w]).astype(np.uint16) for w in range(v.shape[1]))
            wanted[group[i[far <= (radius if n is None else _radius(radius, n[i] + n[i + d]))]]] = True
        for g in np.flatnonzero(wanted).tolist():
            s, e = int(edge[g]), int(edge[g + 1])
            if one[s] or side[s:e].min() != side[s:e].max():
                found += [(s + i, s + j) for i, j in forest(v[s:e], side[s:e], radius, None if n is None else n[s:e])]
        p = rows[np.array(found, np.int64).reshape(-1, 2)]
        return pd.DataFrame({"u": p.min(axis=1), "v": p.max(axis=1)})

    for df in batches:
        df = df if rest is None else pd.concat([rest, df], ignore_index=True)
        k = df[keys].to_numpy()
        if not len(df):
            continue
        start = int(np.flatnonzero((k == k[-1]).all(axis=1))[0])
        rest = df.iloc[start:].reset_index(drop=True)
        if start:
            yield links(df.iloc[:start])
    if rest is not None and len(rest):
        yield links(rest)


def tile_links(cells: DataFrame, keys: list[str], values: list[str], name: str, radius: float, tile: int, size: str | None = None) -> DataFrame:
    """u < v of the column ``name``: a spanning forest of the links inside each cell (keys) of rows with their fingerprint (values).

    With ``size``, values are parities of sets of so many elements and ``radius`` is a similarity of sets; rows then stand by classes of their size."""
    keep = list(dict.fromkeys([*values, name, *([size] if size else [])]))
    if size is None:
        pop, far = sum((F.bit_count(c) for c in values[1:]), F.bit_count(values[0])), radius
    else:
        pop, far = F.floor(F.log(F.greatest(F.col(size), F.lit(1)).cast("double")) * (2 / -np.log(radius))).cast("int"), 3  # similar sets lie two classes apart, three with rounding
    cells = cells.select(*keys, *keep, pop.alias("pop"))
    hot = stored(cells.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > tile).drop("n"), "hot")
    cells_found = hot.count()
    if cells_found:
        few = cells_found <= FEW_CELLS  # then a broadcast holds at most 129 counts of each
        meet = (lambda a, b, on, how: a.join(F.broadcast(b), on, how)) if few else (lambda a, b, on, how: spread_join(a, b, on, name, how))
        per = meet(cells, hot, keys, "left_semi").groupBy(*keys, "pop").agg(F.count("*").alias("n"))
        by = Window.partitionBy(*keys).orderBy("pop")
        before = F.coalesce(F.sum("n").over(by.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        per = per.select(*keys, "pop", F.floor(before / tile).alias("lo"), F.floor((before + F.col("n") - 1) / tile).alias("hi"))
        reach = by.rangeBetween(-far, far)
        per = per.select(*keys, "pop", "lo", "hi", F.min("lo").over(reach).alias("first"), F.max("hi").over(reach).alias("last"))
        rows = meet(cells, per, [*keys, "pop"], "left")
        t = F.when(F.col("lo").isNull(), F.lit(0)).otherwise(F.col("lo") + F.pmod(F.xxhash64(*keep), F.col("hi") - F.col("lo") + 1)).cast("int")
    else:
        rows, t = cells.withColumn("first", F.lit(0)).withColumn("last", F.lit(0)), F.lit(0)
    rows = rows.withColumn("t", t)
    mates = F.sequence(F.coalesce("first", F.lit(0)).cast("int"), F.coalesce("last", F.lit(0)).cast("int"))
    mates = F.transform(mates, lambda o: F.struct(F.least("t", o).alias("a"), F.greatest("t", o).alias("b")))
    pairs = rows.select(*keys, *keep, "t", F.inline(mates))
    groups = [*keys, "a", "b"]
    dealt = pairs.repartition(*groups).sortWithinPartitions(*groups)
    return dealt.mapInPandas(lambda it: _tiles(it, radius, groups, values, name, size), "u long, v long").distinct()


def links(distinct: DataFrame, radius: int = RADIUS, tile: int = TILE, bands: int = BANDS) -> DataFrame:
    """u < v: enough linked pairs of the distinct fingerprints (column fp) to connect all that are connected."""
    cell = lambda m: F.col("fp").bitwiseAND(F.lit(_signed(m)))
    cells = [F.struct(F.lit(i).alias("band"), cell(m).alias("cell")) for i, m in enumerate(band_masks(radius, bands))]
    rows = distinct.select("fp", F.inline(F.array(*cells)))
    sizes = rows.groupBy("band", "cell").agg(F.count("*").alias("n")).where("n > 1")
    return tile_links(rows.join(sizes, ["band", "cell"]).drop("n"), ["band", "cell"], ["fp"], "fp", radius, tile)


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of u-v edges; root is the smallest node reachable.

    Rounds of large-star and small-star: neighbours hook on to the smallest node they see until every node points at its
    root. Each round only moves edges to smaller nodes, is a few joins on the edge list, and is written out.
    """
    edges = stored(edges.select("u", "v"), "links")
    before = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = spread_join(both, least, "u", "v").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: every node's smaller neighbours, itself included, go under the smallest of them
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = spread_join(large, low, "u", "v").select("u", "v", "m")
        small = small.select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e"))
        edges = stored(small.select("e.u", "e.v").where("u <> v").distinct(), "links")
        state = tuple(edges.agg(F.count("*"), F.sum(F.col("u").cast("decimal(20)")), F.sum(F.col("v").cast("decimal(20)"))).first())
        if state == before:
            break
        before = state
    roots = edges.select("v").distinct().select(F.col("v").alias("node"), F.col("v").alias("root"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)


def named(prints: DataFrame, radius: int = RADIUS, tile: int = TILE, bands: int = BANDS) -> DataFrame:
    """fp, root, component_id for every distinct fingerprint of prints (doc_id, fp); root is the component's smallest fingerprint."""
    distinct = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "distinct")
    linked = stored(components(links(distinct.select("fp"), radius, tile, bands)), "components")
    roots = distinct.join(linked.withColumnRenamed("node", "fp"), "fp", "left")
    roots = roots.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    ids = roots.groupBy("root").agg(F.min("least").alias("component_id"))
    return stored(roots.join(ids, "root").select("fp", "root", "component_id"), "named")


def clustered(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE, bands: int = BANDS
) -> DataFrame:
    """doc_id, fp, component_id for every row."""
    prints = stored(fingerprints(docs, doc_id, text, shingle), "fingerprints")
    return spread_join(prints, named(prints, radius, tile, bands), "fp", "doc_id").select("doc_id", "fp", "component_id")


def report(docs: DataFrame, **options) -> DataFrame:
    """Per document: doc_id, fingerprint (16 hex digits), component_id."""
    out = clustered(docs, **options)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SHINGLE, radius: int = RADIUS, tile: int = TILE, bands: int = BANDS
) -> DataFrame:
    """One row of each component, with the columns of docs: the smallest doc_id, nulls last, and of equal ones the first by row number.

    Rows are numbered as they are written out with their fingerprint, so a row keeps its number.
    """
    rows = small_batches(docs).withColumn("__fp", _prints(shingle)(column(text))).withColumn("__row", F.monotonically_increasing_id())
    rows = stored(rows, "rows")
    prints = rows.select(column(doc_id).alias("doc_id"), F.col("__fp").alias("fp"), "__row")
    first = F.min(F.struct(F.isnull("doc_id").alias("no_id"), "doc_id", "__row")).alias("first")
    firsts = prints.groupBy("fp").agg(first).join(named(prints, radius, tile, bands), "fp")
    kept = firsts.groupBy("root").agg(F.min("first").alias("first")).select("first.__row")
    return rows.join(kept, "__row", "left_semi").select(*map(column, docs.columns))


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """128-bit hashes (rows of 16 bytes) of a text's distinct word shingles; a shorter text is one shingle, a text without words has none."""
    words = utf8(text).translate(_LOW).split()
    kinds = {b" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set()
    return np.frombuffer(b"".join(xxhash.xxh3_128_digest(k, SEED) for k in kinds), np.uint8).reshape(-1, 16)


def jaccard(a: str | None, b: str | None, shingle: int = SIMILAR_SHINGLE) -> float:
    """Share of common shingles of two texts; texts without words are equal."""
    x, y = ({bytes(r) for r in shingle_hashes(t, shingle)} for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def common_shingles(docs: DataFrame, text: str = "text", shingle: int = SIMILAR_SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of shingles that several of about SAMPLE texts hold, ascending, and how many: it orders shingles, and any order finds the same links."""

    @F.pandas_udf("array<long>")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, shingle).view("<i8")[:, 0]) for t in texts], dtype="object")

    part = max(1, docs.count() // SAMPLE)
    some = docs.select(column(text).alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(part)) == 0)
    found = some.select(F.explode(hashes("text")).alias("h")).groupBy("h").agg(F.count("*").alias("n")).where(F.col("n") >= COMMON)
    top = found.orderBy(F.desc("n"), "h").limit(MOST_COMMON).toPandas()
    h, n = top["h"].to_numpy(np.int64).view(np.uint64), top["n"].to_numpy(np.int64)
    order = np.argsort(h)
    return h[order], n[order]


def _level(n: int) -> int:
    """A set of n shingles is cut into 2 ** level pieces."""
    return max(0, (n - 1).bit_length() - 9)


def _parity(bits: np.ndarray, n: int) -> np.ndarray:
    return np.packbits(np.bincount(bits, minlength=n) & 1).view("<i8")


def set_profile(text: str | None, shingle: int, similarity: float, common: tuple[np.ndarray, np.ndarray]) -> tuple:
    """Two words of a digest of the text's shingles, their number, the words of their parity; then the hashes of those it meets others by, the piece of each, and the
    sizes and parities of the pieces. The smaller set of a pair sets the level, so a text is cut for its own size and for the least that is similar."""
    h = shingle_hashes(text, shingle)
    n, words = len(h), h.view("<u8").reshape(-1, 2)
    words = words[np.lexsort((words[:, 1], words[:, 0]))]
    digest = np.frombuffer(xxhash.xxh3_128_digest(words.tobytes(), SEED), "<i8")
    known, count = common
    times = np.zeros(n, np.int64)
    if len(known):
        at = np.minimum(np.searchsorted(known, words[:, 0]), len(known) - 1)
        times = np.where(known[at] == words[:, 0], count[at], 0)
    bit = (words[:, 1] & np.uint64(511)).astype(np.int64)
    tokens, places, sizes, parities, base = [], [], [], [], 0
    for level in sorted({_level(n), _level(int(np.ceil(similarity * n - SLACK)))}) if n else []:
        piece = ((words[:, 1] >> np.uint64(40)) & np.uint64((1 << level) - 1)).astype(np.int64)
        size = np.bincount(piece, minlength=1 << level)
        order = np.lexsort((times, piece))
        rank = np.arange(n) - (np.cumsum(size) - size)[piece[order]]
        first = order[rank <= (size - np.ceil(similarity * size - SLACK))[piece[order]]]
        tokens.append((words[first, 0] + np.uint64(level)).view(np.int64))
        places.append(base + piece[first])
        sizes.append(size)
        parities.append(_parity(512 * piece + bit, 512 << level))
        base += 1 << level
    joined = [np.concatenate(x) if x else np.zeros(0, np.int64) for x in (tokens, places, sizes, parities)]
    return int(digest[0]), int(digest[1]), n, *_parity(bit, 512).tolist(), *joined


def _set_links(batches, similarity: float):
    """Rows sorted by group and tile pair: links that join the parts of a tile pair as all its links between them would."""
    keys, rest = ["cc", "a", "b"], None

    def links(df: pd.DataFrame):
        df = df.sort_values(["n", "row"], ignore_index=True)
        n, part, row, side = df["n"].to_numpy(np.int64), df["part"].to_numpy().copy(), df["row"].to_numpy(), (df["t"] != df["a"]).to_numpy()
        v, sets = df[PARITY].to_numpy().view(np.uint64), [np.frombuffer(b, np.int64) for b in df["shingles"]]
        two, out = df["a"].iloc[0] != df["b"].iloc[0], []
        hi = np.searchsorted(n, n / similarity + SLACK, side="right")
        for i in range(len(n)):
            near = np.arange(i + 1, hi[i])
            near = near[part[near] != part[i]]
            if two:
                near = near[side[near] != side[i]]
            near = near[np.bitwise_count(v[near] ^ v[i]).sum(axis=1, dtype=np.int64) <= _radius(similarity, n[near] + n[i])]
            for j in near.tolist():
                if part[j] == part[i]:
                    continue
                both = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                if both >= similarity * (len(sets[i]) + len(sets[j]) - both) - SLACK:
                    part[part == part[j]] = part[i]
                    out.append((min(row[i], row[j]), max(row[i], row[j])))
        return pd.DataFrame(out, columns=["u", "v"], dtype="int64")

    for df in batches:
        df = df if rest is None else pd.concat([rest, df], ignore_index=True)
        if not len(df):
            continue
        k = df[keys].to_numpy()
        edge = np.flatnonzero(np.concatenate(([True], (k[1:] != k[:-1]).any(axis=1))))
        for s, e in zip(edge, edge[1:], strict=False):
            yield links(df.iloc[s:e])
        rest = df.iloc[edge[-1] :].reset_index(drop=True)
    if rest is not None:
        yield links(rest)


def set_links(members: DataFrame, texts: DataFrame, shingle: int, similarity: float, heavy: int = HEAVY) -> DataFrame:
    """u < v: links that join the parts of each group as all links between them would, by the sets of members (cc, part, row, n and parity) and texts (row, x).

    A group of over ``heavy`` shingles is dealt into tiles. Its largest part is dealt apart, and tiles of it are not compared with one another.
    """

    @F.pandas_udf("binary")
    def shingles(x: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, shingle).view("<i8")[:, 0]).tobytes() for t in x], dtype="object")

    parts = members.groupBy("cc", "part").agg(F.sum("n").alias("w"))
    per = parts.groupBy("cc").agg(F.max(F.struct("w", "part")).alias("top"), F.sum("w").alias("w"))
    cut = lambda w: F.ceil(w / heavy).cast("int")
    per = per.select("cc", F.col("top.part").alias("top"), cut(F.col("w") - F.col("top.w")).alias("k0"), cut(F.col("top.w")).alias("k1"), (F.col("w") <= heavy).alias("one"))
    dealt = spread_join(members, per, "cc", "row")
    place = lambda k: F.pmod(F.xxhash64("row"), k).cast("int")
    top = F.col("part") == F.col("top")
    t = F.when(F.col("one"), 0).when(top, F.col("k0") + place(F.greatest("k1", F.lit(1)))).otherwise(place(F.greatest("k0", F.lit(1))))
    last = F.when(F.col("one"), 0).when(top, F.col("k0") - 1).otherwise(F.col("k0") + F.col("k1") - 1)
    dealt = dealt.withColumn("t", t.cast("int")).withColumn("last", last.cast("int"))
    dealt = dealt.join(texts, "row").withColumn("shingles", shingles("x"))
    mates = F.transform(F.sequence(F.lit(0), "last"), lambda o: F.struct(F.least("t", o).alias("a"), F.greatest("t", o).alias("b")))
    pairs = dealt.select("cc", "part", "row", "n", *PARITY, "shingles", "t", F.inline(mates))
    pairs = pairs.repartition("cc", "a", "b").sortWithinPartitions("cc", "a", "b")
    return bounded_batches(pairs).mapInPandas(lambda it: _set_links(it, similarity), "u long, v long").distinct()


def meeting(profiles: DataFrame, similarity: float, tile: int) -> DataFrame:
    """u < v of rows (row, and the last four of set_profile): links whose components hold all rows of that similarity."""
    tokens = profiles.select("row", F.inline(F.arrays_zip("token", "piece")))
    counts = tokens.groupBy("token").agg(F.count("*").alias("times")).where("times > 1")
    met = stored(tokens.join(counts, "token").select("token", "row", "piece"), "met")
    by = (F.count("*").alias("times"), F.bit_xor(F.xxhash64("row", "piece")).alias("x"), F.bit_xor(F.xxhash64("piece", "row")).alias("y"))
    cells = met.groupBy("token").agg(*by).groupBy("times", "x", "y").agg(F.min("token").alias("token"))
    once = met.join(cells.select("token"), "token", "left_semi").join(profiles.select("row", "sizes", "parities"), "row")
    parity = [F.get("parities", 8 * F.col("piece") + i).alias(c) for i, c in enumerate(PARITY)]
    return tile_links(once.select("token", "row", F.get("sizes", "piece").alias("n"), *parity), ["token"], PARITY, "row", similarity, tile, "n")


def keep_similar(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", shingle: int = SIMILAR_SHINGLE, similarity: float = SIMILARITY, tile: int = TILE, heavy: int = HEAVY
) -> DataFrame:
    """One row of each group of texts that share ``similarity`` of their word shingles with one another, in a chain if need be, with the columns of docs: the smallest
    doc_id, nulls last, and of equal ones the first by row number. Texts without words are one group."""
    common = common_shingles(small_batches(docs), text, shingle)
    single, many = ["d1", "d2", "n", *PARITY], ["token", "piece", "sizes", "parities"]

    @F.pandas_udf(", ".join([*(f"{c} long" for c in single), "token array<long>", "piece array<int>", "sizes array<int>", "parities array<long>"]))
    def profile(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([set_profile(t, shingle, similarity, common) for t in texts], columns=[*single, *many])
        return out.astype(dict.fromkeys(single, "int64"))

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([jaccard(x, y, shingle) for x, y in zip(a, b, strict=True)], dtype="float64")

    rows = docs.withColumn("__p", profile(column(text))).withColumn("__row", F.monotonically_increasing_id())
    rows = stored(rows, "rows")
    first = F.min(F.struct(F.isnull(column(doc_id)).alias("no_id"), column(doc_id).alias("id"), "__row")).alias("first")
    firsts = stored(rows.groupBy(F.col("__p.d1").alias("d1"), F.col("__p.d2").alias("d2"), F.col("__p.n").alias("n")).agg(first).select("first", F.col("first.__row").alias("row")), "distinct")
    profiles = rows.select(F.col("__row").alias("row"), *(F.col(f"__p.{c}").alias(c) for c in ["n", *PARITY, *many])).join(firsts.select("row"), "row", "left_semi")
    near = stored(meeting(profiles.where("n > 0"), similarity, tile), "near")

    texts = rows.select(F.col("__row").alias("row"), column(text).alias("x"))
    some = near.groupBy("v").agg(F.min("u").alias("u"))
    mine = texts.join(some.select(F.explode(F.array("u", "v")).alias("row")).distinct(), "row", "left_semi")
    pairs = some.join(mine.select(F.col("row").alias("u"), F.col("x").alias("xu")), "u").join(mine.select(F.col("row").alias("v"), F.col("x").alias("xv")), "v")
    sure = stored(pairs.where(alike("xu", "xv") >= similarity).select("u", "v"), "sure")
    parts = stored(components(sure), "parts")

    part = lambda side: parts.select(F.col("node").alias(side), F.col("root").alias(f"p{side}"))
    ends = near.join(part("u"), "u", "left").join(part("v"), "v", "left").select(F.coalesce("pu", "u").alias("a"), F.coalesce("pv", "v").alias("b"))
    open_ends = stored(ends.where("a <> b").select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct(), "open")
    groups = parts
    if not open_ends.isEmpty():
        split = components(open_ends).select(F.col("node").alias("part"), F.col("root").alias("cc"))
        all_parts = parts.select(F.col("node").alias("row"), F.col("root").alias("part"))
        all_parts = all_parts.unionByName(open_ends.select(F.explode(F.array("u", "v")).alias("row")).distinct().select("row", F.col("row").alias("part"))).distinct()
        members = all_parts.join(split, "part").join(profiles.select("row", "n", *PARITY), "row")
        more = set_links(members, texts, shingle, similarity, heavy)
        groups = stored(components(sure.unionByName(more)), "components")
    rooted = firsts.join(groups.withColumnRenamed("node", "row"), "row", "left").select("first", F.coalesce("root", "row").alias("root"))
    kept = rooted.groupBy("root").agg(F.min("first").alias("first")).select(F.col("first.__row").alias("__row"))
    return rows.join(kept, "__row", "left_semi").select(*map(column, docs.columns))
