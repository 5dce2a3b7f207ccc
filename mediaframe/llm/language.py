"""Language identification by interpolated Kneser-Ney character models.

One model per language over letters and word gaps: texts are lower-cased, every run of other characters is one gap, and
a text starts and ends with a gap. The order-4 grams of all training texts are counted (per batch in numpy, then by
Spark). Lower orders use continuation counts and discounts come from the counts of counts; Spark takes both over all grams of all languages, and none is
cut off.

*Table.* log p(gram) is a sum of entries: one for the gram at each order it is known at (by how much it is likelier there than the lower order says), one for
the weight of the lower order after each context that is known, and a constant. Since entries only add up, the table may be cut anywhere: it is written to the shared folder
in blocks by hash, of about BLOCK_ENTRIES entries each, as sorted arrays of grams with (language, weight) beside them. Tasks read the blocks, one at a time, look their
grams up by binary search and add up over the blocks and CHUNK languages at a time; the driver holds a few numbers per language and no grams. So neither the number of label
values nor an alphabet of any size changes a result; they only cost passes.

A text goes to the language with the lowest cross-entropy per character. ``score`` is that language's share of the
likelihoods at the per-character scale of SCALE characters. Rejection is calibrated on the training texts (cross-fitted with ``folds``): per language
the mean and spread of their cross-entropy, the spread modelled as a + b / length, and a text further than ``z`` spreads
above its language's mean is rejected.

Defined cases: texts that are null, empty or without a letter are ``und`` with score 0 and rejected; equal entropies go to
the language that sorts first; rows with a null id or language train nothing; repeated rows count repeatedly; with no
training text at all every text is ``und``. Extra columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pandas as pd
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from mediaframe.functions.lineage import work_dir
from mediaframe.functions.skew import spread_join
from mediaframe.llm.common import column, runs, small_batches, stored

ORDER = 4
BLOCK_ENTRIES = 2_000_000  # of the table that a task holds at once, 20 bytes each
CHUNK = 8  # languages scored at once
BASE = 1.0 / (1 << 16)  # probability of a character nothing is known of
Z = 6.0
SCALE = 20.0
FLOOR = 0.1  # least spread of the entropy, nats per character
RUN_CHARS = 1 << 20  # characters handled at once, at about 100 bytes each
UNDETERMINED = "und"

VERDICT = T.StructType([
    T.StructField("lang", T.StringType()),
    T.StructField("score", T.DoubleType()),
    T.StructField("entropy", T.DoubleType()),
    T.StructField("letters", T.LongType()),
    T.StructField("rejected", T.BooleanType()),
])

_fold: np.ndarray | None = None


def fold_table() -> np.ndarray:
    """Code point -> lower-case letter, or a space; letters beyond 16 bits share one code."""
    global _fold
    if _fold is None:
        t = np.full(0x110000, 32, np.uint16)
        for i in range(0x110000):
            c = chr(i)
            if c.isalpha():
                low = ord(c.lower()[0])
                t[i] = low if low < 0xFFFF else 0xFFFF
        _fold = t
    return _fold


def letters(texts) -> tuple[np.ndarray, np.ndarray]:
    """Folded characters of all texts, gaps collapsed, and the text number of each character."""
    sizes = np.array([len(t) if t else 0 for t in texts], np.int64)
    joined = " ".join((t or "") for t in texts) + " "
    raw = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    chars = fold_table()[raw]
    keep = np.ones(len(chars), bool)
    keep[1:] = (chars[1:] != 32) | (chars[:-1] != 32)
    owner = np.repeat(np.arange(len(sizes)), sizes + 1)
    return chars[keep], owner[keep]


def grams(texts, order: int = ORDER) -> tuple[np.ndarray, np.ndarray]:
    """Packed grams that end in each letter or closing gap of a text, and their text numbers. The characters before a
    text's first are gaps."""
    chars, owner = letters(texts)
    if not len(chars):
        return np.empty(0, np.uint64), owner
    begin = np.flatnonzero(np.diff(owner, prepend=-1))
    first = np.repeat(begin, np.diff(np.append(begin, len(owner))))  # where the character's text begins
    at, out = np.arange(len(chars)), np.zeros(len(chars), np.uint64)
    for back in range(order - 1, -1, -1):
        c = np.full(len(chars), 32, np.uint64)
        if back < len(chars):
            c[back:] = np.where(at[back:] - back >= first[back:], chars[: len(chars) - back], 32)
        out = out << np.uint64(16) | c
    has = chars != 32
    worded = np.zeros(len(texts), bool)
    worded[owner[has]] = True
    # a leading gap says nothing; nor do the gaps of a text without letters
    real = worded[owner] & ~((chars == 32) & (at == first))
    return out[real], owner[real]


def gram_counts(train: DataFrame, lang: str, text: str, order: int = ORDER) -> DataFrame:
    """lang, gram, n over all rows of train: counted per batch, then summed by Spark."""

    def count(batches):
        for df in batches:
            for name, part in df.groupby("lang", sort=True):
                texts = part["text"].tolist()
                for a, b in runs(texts, RUN_CHARS):
                    g, n = np.unique(grams(texts[a:b], order)[0], return_counts=True)
                    yield pd.DataFrame({"lang": name, "gram": g.view(np.int64), "n": n})

    rows = small_batches(train).select(column(lang).alias("lang"), column(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    return rows.mapInPandas(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def _mask(order: int) -> np.uint64:
    return np.uint64((1 << 16 * order) - 1)


def _low(order: int) -> Column:
    """The last ``order`` characters of the packed gram g."""
    return F.col("g").bitwiseAND(F.lit((1 << 16 * order) - 1).cast("long"))


def estimates(counts: DataFrame, order: int = ORDER) -> DataFrame:
    """m, lang, g, ctx, own, back for the grams g of all orders m: own discounted probability, and weight of the lower order after ctx."""
    per = [counts.select(F.lit(order).alias("m"), "lang", F.col("gram").alias("g"), "n")]
    for m in range(order - 1, 0, -1):
        # continuation counts: in how many kinds of grams does the shorter gram end
        per.append(per[-1].groupBy("lang", _low(m).alias("g")).agg(F.count("*").alias("n")).select(F.lit(m).alias("m"), "lang", "g", "n"))
    kinds = stored(reduce(DataFrame.unionByName, per).withColumn("ctx", F.shiftrightunsigned("g", 16)), "grams")
    n1, n2 = F.count_if(F.col("n") == 1), F.count_if(F.col("n") == 2)
    cut = kinds.groupBy("m", "lang").agg(F.when((n1 > 0) & (n2 > 0), n1 / (n1 + 2 * n2)).otherwise(0.5).alias("d"))
    total = kinds.groupBy("m", "lang", "ctx").agg(F.sum("n").alias("total"), F.count("*").alias("kinds"))
    total = spread_join(total, cut, ["m", "lang"], "ctx", salts=64)
    rows = kinds.join(total, ["m", "lang", "ctx"])
    own, back = F.greatest(F.col("n") - F.col("d"), F.lit(0.0)) / F.col("total"), F.col("d") * F.col("kinds") / F.col("total")
    return stored(rows.select("m", "lang", "g", "ctx", own.alias("own"), back.alias("back")), "estimates")


def entries(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """t, key, lang, w: what the table adds for a gram (t = 2 (m - 1)) and for a context (t = 2 m - 1) of order m."""
    out, lower = [], None
    for m in range(1, order + 1):
        own = rows.where(F.col("m") == m).drop("m")
        if lower is None:
            own = own.withColumn("low", F.lit(BASE))
        else:
            own = own.withColumn("s", _low(m - 1)).join(lower.select("lang", F.col("g").alias("s"), F.col("p").alias("low")), ["lang", "s"])
        lower = own.withColumn("p", F.col("own") + F.col("back") * F.col("low"))
        w = F.log(F.col("p")) - F.log(F.col("back") * F.col("low"))
        out.append(lower.select(F.lit(2 * m - 2).alias("t"), F.col("g").alias("key"), "lang", w.alias("w")))
        back = rows.where(F.col("m") == m).groupBy("lang", "ctx").agg(F.log(F.first("back")).alias("w"))
        out.append(back.select(F.lit(2 * m - 1).alias("t"), F.col("ctx").alias("key"), "lang", "w"))
    return reduce(DataFrame.unionByName, out)


@dataclass
class Table:
    """One kind of entries of a block: sorted keys, and the languages and weights of key i at start[i] .. start[i + 1]."""

    keys: np.ndarray
    start: np.ndarray
    lang: np.ndarray
    w: np.ndarray

    def add_to(self, out: np.ndarray, wanted: np.ndarray, first: int) -> None:
        """Add the weights of languages first, first + 1, ... for the wanted keys to the rows of out."""
        if not len(self.keys):
            return
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        rows = np.flatnonzero(self.keys[at] == wanted)
        a, b = self.start[at[rows]], self.start[at[rows] + 1]
        n = b - a
        flat = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        rows, lang = np.repeat(rows, n), self.lang[flat] - first
        inside = (lang >= 0) & (lang < out.shape[1])
        # a pair of key and language stands once, so no cell is met twice
        out[rows[inside], lang[inside]] += self.w[flat[inside]]


@lru_cache(maxsize=1)
def block(path: str, number: int, langs: tuple[str, ...], order: int) -> list[Table]:
    """Block ``number`` of a table, by kind of entry."""
    place = {n: i for i, n in enumerate(langs)}
    system, base = pafs.FileSystem.from_uri(path)
    files = system.get_file_info(pafs.FileSelector(f"{base.rstrip('/')}/b={number}", allow_not_found=True))
    parts = [pq.read_table(i.path, filesystem=system, columns=["t", "key", "lang", "w"]) for i in files if i.path.endswith(".parquet")]
    empty = np.empty(0, np.int64)
    t, key, lang, w = empty, empty, empty.astype(np.int32), empty.astype(float)
    if parts:
        t, key, w = (np.concatenate([p[c].to_numpy() for p in parts]) for c in ("t", "key", "w"))
        lang = np.concatenate([p["lang"].to_pandas().map(place).to_numpy(np.int32) for p in parts])
    out = []
    for kind in range(2 * order):
        mine = np.flatnonzero(t == kind)
        k = key[mine].view(np.uint64)
        s = np.lexsort((lang[mine], k))
        keys, start = np.unique(k[s], return_index=True)
        out.append(Table(keys, np.append(start, len(s)).astype(np.int32), lang[mine][s], w[mine][s]))
    return out


@dataclass
class Model:
    """Where the table of all languages lies and what rejection needs; the grams stay in the shared folder."""

    langs: tuple[str, ...]
    path: str
    blocks: int
    order: int = ORDER
    mean: np.ndarray | None = None
    spread: np.ndarray | None = None  # per language: a and b of a + b / length

    def log_prob(self, g: np.ndarray, first: int, last: int) -> np.ndarray:
        """Log-probability of each packed gram's last character in languages first .. last - 1."""
        w = np.full((len(g), last - first), np.log(BASE))
        for number in range(self.blocks):
            for kind, table in enumerate(block(self.path, number, self.langs, self.order)):
                own = g & _mask(kind // 2 + 1)
                table.add_to(w, own >> np.uint64(16) if kind % 2 else own, first)
        return w

    def entropies(self, texts, run: int = RUN_CHARS) -> Iterator[tuple[int, int, int, np.ndarray, np.ndarray]]:
        """Per run of texts and chunk of languages: first and last text, first language, cross-entropy per character (texts x languages) and
        the number of characters behind it."""
        for a, b in runs(texts, run * (1 if self.blocks < 2 else 4)):
            g, owner = grams(texts[a:b], self.order)
            kinds, at = np.unique(g, return_inverse=True)
            sizes = np.bincount(owner, minlength=b - a)
            for first in range(0, len(self.langs), CHUNK):
                last = min(first + CHUNK, len(self.langs))
                logs = self.log_prob(kinds, first, last)
                h = np.stack([np.bincount(owner, logs[at, j], b - a) for j in range(last - first)], 1)
                yield a, b, first, -h / np.maximum(sizes, 1)[:, None], sizes

    def own_entropies(self, texts, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Cross-entropy of each text in language own[i] (NaN where that is -1) and its number of characters."""
        out, sizes = np.full(len(texts), np.nan), np.zeros(len(texts), np.int64)
        for a, b, first, h, n in self.entropies(texts):
            sizes[a:b] = n
            j = own[a:b] - first
            here = np.flatnonzero((j >= 0) & (j < h.shape[1]) & (own[a:b] >= 0))
            out[a + here] = h[here, j[here]]
        return out, sizes

    def judge(self, texts, z: float = Z) -> pd.DataFrame:
        low, best, weight = np.full(len(texts), np.inf), np.zeros(len(texts), np.int64), np.zeros(len(texts))
        n = np.zeros(len(texts), np.int64)
        for a, b, first, h, sizes in self.entropies(texts):
            n[a:b] = sizes
            at = h.argmin(axis=1)
            least = h[np.arange(b - a), at]
            now = np.minimum(low[a:b], least)
            weight[a:b] = weight[a:b] * np.exp(-SCALE * (low[a:b] - now)) + np.exp(-SCALE * (h - now[:, None])).sum(axis=1)
            best[a:b] = np.where(least < low[a:b], first + at, best[a:b])
            low[a:b] = now
        known = n > 0
        rejected = ~known
        if self.mean is not None and self.langs:
            limit = self.mean[best] + z * np.sqrt(self.spread[0][best] + self.spread[1][best] / np.maximum(n, 1))
            rejected |= low > limit
        names = np.array([*self.langs, UNDETERMINED], object)
        return pd.DataFrame({
            "lang": names[np.where(known, best, len(self.langs))], "score": np.where(known, 1 / np.maximum(weight, 1.0), 0.0),
            "entropy": np.where(known, low, np.nan), "letters": n, "rejected": rejected,
        })


def fitted(spark, counts: DataFrame, order: int) -> Model:
    """The model of counted grams (lang, gram, n): its table is written in blocks below the shared folder."""
    rows = estimates(counts, order)
    langs = tuple(sorted(r["lang"] for r in rows.select("lang").distinct().collect()))  # a row per language
    blocks = max(1, -(-2 * rows.count() // BLOCK_ENTRIES))
    path = work_dir(spark, "language")
    table = entries(rows, order).withColumn("b", F.pmod(F.xxhash64("t", "key"), F.lit(blocks)))
    table.repartition(blocks, "b").write.partitionBy("b").parquet(path)
    return Model(langs, path, blocks, order)


def train(docs: DataFrame, lang: str = "lang", text: str = "text", order: int = ORDER, folds: int = 1) -> Model:
    """Model of all rows of docs with a text and a language. With two ``folds`` or more it is calibrated by cross-fitting, each
    fold (equal texts share one) judged by a model of the others; otherwise on the rows it learned from."""
    spark = docs.sparkSession
    if folds < 2:
        model = fitted(spark, stored(gram_counts(docs, lang, text, order), "counts"), order)
        return calibrated(model, entropy_sums(model, docs, lang, text)) if model.langs else model
    fold = F.pmod(F.xxhash64(column(text)), F.lit(folds))
    parts = [docs.where(fold == k) for k in range(folds)]
    counts = [stored(gram_counts(part, lang, text, order), "counts") for part in parts]

    def summed(tables: list[DataFrame]) -> DataFrame:
        return tables[0] if len(tables) == 1 else reduce(DataFrame.unionByName, tables).groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    model, sums = fitted(spark, summed(counts), order), []
    for k in range(folds):
        others = fitted(spark, summed(counts[:k] + counts[k + 1 :]), order)
        if others.langs:
            sums.append(entropy_sums(others, parts[k], lang, text))
    if sums and sum(map(len, sums)):
        return calibrated(model, pd.concat(sums).groupby(["lang", "long"], as_index=False).sum())
    return calibrated(model, entropy_sums(model, docs, lang, text)) if model.langs else model


def entropy_sums(model: Model, docs: DataFrame, lang: str, text: str) -> pd.DataFrame:
    """Per language and length class (long), over its own texts: sums of entropy, its square, 1 / length, and rows."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    place = {n: i for i, n in enumerate(model.langs)}

    def sums(batches):
        for df in batches:
            own = df["lang"].map(place).fillna(-1).to_numpy(np.int64)
            e, n = shared.value.own_entropies(df["text"].tolist(), own)
            ok = (n > 0) & ~np.isnan(e)
            out = pd.DataFrame({"j": own[ok], "long": n[ok] >= 1000, "e": e[ok], "e2": e[ok] ** 2, "inv": 1.0 / n[ok], "n": 1})
            yield out.groupby(["j", "long"], as_index=False).sum()

    rows = small_batches(docs).select(column(lang).alias("lang"), column(text).alias("text")).where("lang IS NOT NULL AND text IS NOT NULL")
    parts = rows.mapInPandas(sums, "j long, long boolean, e double, e2 double, inv double, n long")
    table = parts.groupBy("j", "long").agg(*[F.sum(c).alias(c) for c in ("e", "e2", "inv", "n")]).toPandas()
    return table.assign(lang=[model.langs[int(j)] for j in table["j"]]).drop(columns="j")


def calibrated(model: Model, table: pd.DataFrame) -> Model:
    """Mean and spread of the entropy of each language's own texts, from the sums over all of them.

    Two length classes give two equations for the spread a + b / n; texts are counted with the class's mean 1 / n. A language
    no fold could judge (all its texts in one) takes the widest figures of the others.
    """
    place = {n: i for i, n in enumerate(model.langs)}
    k = len(model.langs)
    mean, a, b = np.full(k, np.inf), np.full(k, FLOOR**2), np.zeros(k)
    for name, part in table.groupby("lang"):
        if name not in place:
            continue
        j, n = place[name], part["n"].sum()
        mean[j] = part["e"].sum() / n
        var = {bool(r.long): (max(0.0, r.e2 / r.n - 2 * mean[j] * r.e / r.n + mean[j] ** 2), r.inv / r.n) for r in part.itertuples()}
        short, long = var.get(False), var.get(True)
        if short and long:
            b[j] = max(0.0, (short[0] - long[0]) / (short[1] - long[1]))
            a[j] = max(FLOOR**2, long[0] - b[j] * long[1])
        else:
            v, inv = short or long
            b[j] = v / inv
    judged = np.isfinite(mean)
    if judged.any():
        mean[~judged], a[~judged], b[~judged] = mean[judged].max(), a[judged].max(), b[judged].max()
    model.mean, model.spread = mean, np.stack([a, b])
    return model


def judged(df: DataFrame, model: Model, text: str = "text", out: str = "language", z: float = Z) -> DataFrame:
    """df with the struct column ``out`` of VERDICT."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(VERDICT)
    def verdict(texts: pd.Series) -> pd.DataFrame:
        return shared.value.judge(texts.tolist(), z)

    return small_batches(df).withColumn(out, verdict(column(text)))


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(column(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def training_rows(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    return docs.where(column(doc_id).isNotNull() & ~held_out(doc_id))


def report(docs: DataFrame, doc_id: str = "doc_id", lang: str = "lang", text: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score, rejected."""
    narrow = docs.select(column(doc_id).alias("doc_id"), column(lang).alias("lang"), column(text).alias("text"))
    model = train(training_rows(narrow))
    v = judged(narrow.select("doc_id", "text"), model)
    return v.select("doc_id", held_out().alias("held_out"), F.col("language.lang").alias("lang_pred"), F.col("language.score").alias("score"), F.col("language.rejected").alias("rejected"))


def keep_known(docs: DataFrame, model: Model, text: str = "text", z: float = Z) -> DataFrame:
    """Rows the model does not reject, with the columns of docs."""
    return judged(docs, model, text, "__l", z).where(~F.col("__l.rejected")).drop("__l")
