"""Ranked lexical search by MaxScore with pair bounds.

Documents become a table of postings: per document its length and, for the terms that queries hold, term numbers and counts. Scores are
integer BM25-like sums over a query's terms (``weight``, ``length_norm``, ``impact``).

*Pair lists.* A query's terms stand in falling weight. For neighbours in that order the postings lists are intersected once, and the largest sum
of both impacts over the documents that hold both is kept, beside each term's own largest impact. A pair that never meets, or never at its best in
one document, so bounds its two terms by less than their two maxima. The same intersections give each query a first threshold: its k-th
best document by best pair (or best single term) scores no less.

*Bounds.* At query time the terms are taken in rising order of maximum; what a run of them can add is bounded by its pairs and single terms,
under the split of the query's chain into pairs that saves most (one dynamic programme a query). The longest run that stays below the threshold is not
essential: a document without any other term cannot enter and is never looked at. For the others the lists of the run are read from the strongest down,
and a document is left as soon as its score so far and the bound of what remains fall below the threshold, which rises as
documents are scored. Only a bound strictly below the threshold leaves a document, so ties are kept and results are exact.

*Spark.* Queries are a stated set: they go to the executors in blocks of at most ``BLOCK_BYTES`` of text (a longer query is a
block of its own), numbered once for all blocks of documents. Each pass over the documents is a scan without shuffle; tasks return their best k a query, which a
window per (query, slice of tasks) and one per query reduce. Document counts, lengths and document frequencies are aggregates over all rows.
The driver holds, for one block, the queries' terms and their bounds.

Defined cases: null and wordless texts hold no term, count nowhere and match nothing; a query without terms, or with terms in no document, has no rows; a repeated
document row is a document of its own; equal scores order by document id, null last; repeated query rows are separate queries under one id, ranked
each; an empty table gives no rows. Extra columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from mediaframe.llm.common import column, runs, small_batches, stored, utf8

K = 50
BLOCK_BYTES = 2_000_000
DOCS_A_CHUNK = 20_000
POSTINGS_A_CHUNK = 4_000_000

#: bytes that belong to no term become spaces, A-Z become small letters
_KEEP = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

POSTINGS = "doc_id long, n long, terms array<int>, tfs array<int>"
NEVER = -1  # maximum of a pair that no document holds


def words(text: str | None) -> list[bytes]:
    """Terms of a text, in order."""
    return utf8(text).translate(_KEEP).split()


def weight(docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * docs + 2) / (2 * df + 1)))


def length_norm(n: int, docs: int, total: int) -> int:
    return 100 - 50 + 50 * n * docs // total


def impacts(weights: np.ndarray, tfs: np.ndarray, norms: np.ndarray) -> np.ndarray:
    return weights * (1_000_000_000 * tfs // (1000 * tfs + 20 * norms))


class Queries:
    """A block of queries: term numbers, each query's terms in falling weight, the pairs of neighbours."""

    def __init__(self, ids: list, texts: list[str | None]):
        self.ids, self.vocabulary = ids, {}
        self.terms = [sorted({self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words(t)}) for t in texts]

    def weigh(self, weights: np.ndarray) -> None:
        """weights: per term, 0 for a term of no document, which is left out."""
        self.weights = weights
        self.terms = [np.array(sorted((t for t in ts if weights[t] > 0), key=lambda t: (-weights[t], t)), np.int64) for ts in self.terms]
        chains = [np.sort(np.stack([ts[:-1], ts[1:]], 1), 1) for ts in self.terms if len(ts) > 1]
        self.pairs = np.unique(np.concatenate(chains), axis=0) if chains else np.empty((0, 2), np.int64)
        number = {(a, b): i for i, (a, b) in enumerate(self.pairs.tolist())}
        self.query_pairs = [np.array([number[min(a, b), max(a, b)] for a, b in zip(ts[:-1].tolist(), ts[1:].tolist(), strict=True)], np.int64) for ts in self.terms]

    def bound(self, best: np.ndarray, joint: np.ndarray, low: np.ndarray) -> None:
        """best: each term's largest impact; joint: each pair's largest sum; low: each query's first threshold. Sets ``order`` and
        ``rest``: per query its terms in rising order of maximum, and what the first i of them can add at most."""
        self.low, self.order, self.rest = low, [], []
        for ts, ps in zip(self.terms, self.query_pairs, strict=True):
            order = np.argsort(best[ts], kind="stable")
            self.order.append(ts[order])
            self.rest.append(run_bounds(best[ts], joint[ps], order))


def best_split(gains: list[int]) -> list[int]:
    """Neighbour pairs (i, i + 1) of a chain, no term in two of them, of the greatest total gain."""
    total, taken = [0, 0], []  # total[i + 1]: the best over the pairs before term i
    for gain in gains:
        taken.append(gain > 0 and total[-2] + gain > total[-1])
        total.append(total[-2] + gain if taken[-1] else total[-1])
    out, i = [], len(gains) - 1
    while i >= 0:
        if taken[i]:
            out.append(i)
            i -= 1
        i -= 1
    return out


def run_bounds(best: np.ndarray, joint: np.ndarray, order: np.ndarray) -> np.ndarray:
    """rest[i]: the most that the terms order[:i] of a chain add to one document's score.

    best: largest impact of each term of the chain; joint: largest sum of each two neighbours. A pair adds the largest of its joint maximum and
    its two own maxima, as a document may hold one term alone; it counts in runs that hold both terms.
    """
    if not len(best):
        return np.zeros(1, np.int64)
    alone = np.maximum(best[:-1], best[1:])
    gains = best[:-1] + best[1:] - np.maximum(joint, alone)
    place = np.empty(len(best), np.int64)
    place[order] = np.arange(len(best))
    less = np.zeros(len(best), np.int64)
    for i in best_split(gains.tolist()):
        less[max(place[i], place[i + 1])] += gains[i]
    return np.r_[0, np.cumsum(best[order] - less)]


class Chunk:
    """Postings of some documents by term: rows and impacts of term t at start[t] .. start[t + 1]."""

    def __init__(self, q: Queries, docs, ns: list[int], terms: list[np.ndarray], tfs: list[np.ndarray]):
        self.docs, self.size = docs, len(ns)
        norms = np.array([length_norm(n, q.docs, q.total) if n else 0 for n in ns], np.int64)
        rows = np.repeat(np.arange(self.size), [len(t) for t in terms])
        flat = np.concatenate(terms).astype(np.int64) if terms else np.empty(0, np.int64)
        by_term = np.argsort(flat, kind="stable")
        flat, self.rows = flat[by_term], rows[by_term]
        self.s = impacts(q.weights[flat], np.concatenate(tfs).astype(np.int64)[by_term], norms[self.rows]) if len(flat) else flat
        self.start = np.searchsorted(flat, np.arange(len(q.weights) + 1))

    def postings(self, t: int) -> tuple[np.ndarray, np.ndarray]:
        a, b = self.start[t], self.start[t + 1]
        return self.rows[a:b], self.s[a:b]


def chunks(q: Queries, batches) -> Iterator[Chunk]:
    """The documents of a task in chunks of bounded documents and postings; those without a query's term are passed by."""
    docs, ns, terms, tfs, held = [], [], [], [], 0
    for df in batches:
        for doc, n, t, f in zip(df["doc_id"].astype("Int64"), df["n"], df["terms"], df["tfs"], strict=True):
            if len(t):
                docs.append(doc)
                ns.append(int(n))
                terms.append(t)
                tfs.append(f)
                held += len(t)
            if len(docs) >= DOCS_A_CHUNK or held >= POSTINGS_A_CHUNK:
                yield Chunk(q, pd.array(docs, "Int64"), ns, terms, tfs)
                docs, ns, terms, tfs, held = [], [], [], [], 0
    if docs:
        yield Chunk(q, pd.array(docs, "Int64"), ns, terms, tfs)


def largest(values: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k largest."""
    return np.argpartition(-values, k - 1)[:k] if len(values) > k else np.arange(len(values))


def pair_lists(q: Queries, chunk: Chunk, k: int) -> tuple[np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Term maxima, joint maxima, and each pair's k best documents (rows, sums) of a chunk."""
    best, joint, lists = np.zeros(len(q.weights), np.int64), np.full(len(q.pairs), NEVER, np.int64), []
    used = np.flatnonzero(chunk.start[1:] > chunk.start[:-1])
    if len(used):
        best[used] = np.maximum.reduceat(chunk.s, chunk.start[used])
    line, filled = np.zeros(chunk.size, np.int64), -1
    for i, (a, b) in enumerate(q.pairs.tolist()):
        if a != filled:
            if filled >= 0:
                line[chunk.postings(filled)[0]] = 0
            rows, s = chunk.postings(a)
            line[rows], filled = s, a
        rows, s = chunk.postings(b)
        other = line[rows]
        both = other > 0
        rows, sums = rows[both], (other + s)[both]
        top = largest(sums, k)
        lists.append((rows[top], sums[top]))
        if len(sums):
            joint[i] = sums.max()
    return best, joint, lists


def lower_bounds(q: Queries, chunk: Chunk, lists: list, k: int) -> list[np.ndarray]:
    """Per query, up to k scores that so many documents of the chunk reach at least, by their best pair or term."""
    singles: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    out = []
    for ts, ps in zip(q.terms, q.query_pairs, strict=True):
        found = [lists[p] for p in ps]
        for t in ts.tolist():
            if t not in singles:
                rows, s = chunk.postings(t)
                top = largest(s, k)
                singles[t] = rows[top], s[top]
            found.append(singles[t])
        rows = np.concatenate([r for r, _ in found]) if found else np.empty(0, np.int64)
        if not len(rows):
            out.append(rows)
            continue
        sums = np.concatenate([s for _, s in found])
        seen, at = np.unique(rows, return_inverse=True)
        low = np.zeros(len(seen), np.int64)
        np.maximum.at(low, at, sums)
        out.append(low[largest(low, k)])
    return out


def top_of_chunk(q: Queries, i: int, chunk: Chunk, threshold: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Rows and scores of the chunk's documents that may reach ``threshold`` for query i, and how many were scored in part only."""
    order, rest = q.order[i], q.rest[i]
    below = np.flatnonzero(rest < threshold)
    essential = int(below[-1]) if len(below) else 0
    line = np.zeros(chunk.size, np.int64)
    for t in order[essential:].tolist():
        rows, s = chunk.postings(t)
        line[rows] += s
    rows = np.flatnonzero(line)
    seen = len(rows)
    rows = rows[line[rows] + rest[essential] >= threshold]
    for j in range(essential - 1, -1, -1):
        if not len(rows):
            break
        listed, s = chunk.postings(int(order[j]))
        if len(listed):
            at = np.minimum(np.searchsorted(listed, rows), len(listed) - 1)
            line[rows] += np.where(listed[at] == rows, s[at], 0)
        rows = rows[line[rows] + rest[j] >= threshold]
    return rows, line[rows], seen - len(rows)


def best_first(scores: np.ndarray, docs, k: int) -> np.ndarray:
    """Positions of the k best: highest score, then smallest document, null last."""
    null = docs.isna()
    return np.lexsort((docs.fillna(0).to_numpy(np.int64), null, -scores))[:k]


def blocks(queries: DataFrame, limit: int = BLOCK_BYTES) -> Iterator[Queries]:
    """Queries (id, text) in blocks of at most ``limit`` bytes of text, or one longer query."""
    ids, texts, held = [], [], 0
    for row in queries.toLocalIterator():
        size = len(utf8(row["text"]))
        if ids and held + size > limit:
            yield Queries(ids, texts)
            ids, texts, held = [], [], 0
        ids.append(row["id"])
        texts.append(row["text"])
        held += size
    if ids:
        yield Queries(ids, texts)


def postings(docs: DataFrame, vocabulary) -> DataFrame:
    """Per document row of (doc_id, text): doc_id, n, and the numbers and counts of the terms in the vocabulary (a broadcast dict)."""

    def scan(batches):
        known = vocabulary.value
        for df in batches:
            for a, b in runs(df["text"]):
                ns, terms, tfs = [], [], []
                for text in df["text"].iloc[a:b]:
                    found = words(text)
                    counts = [(known[w], c) for w, c in Counter(found).items() if w in known]
                    ns.append(len(found))
                    terms.append([t for t, _ in counts])
                    tfs.append([c for _, c in counts])
                yield pd.DataFrame({"doc_id": df["doc_id"].iloc[a:b].astype("Int64").array, "n": ns, "terms": terms, "tfs": tfs})

    return docs.mapInPandas(scan, POSTINGS)


def _lists_pass(shared, k: int):
    def scan(batches):
        q = shared.value
        best, joint, low = np.zeros(len(q.weights), np.int64), np.full(len(q.pairs), NEVER, np.int64), [np.empty(0, np.int64)] * len(q.ids)
        for chunk in chunks(q, batches):
            b, j, lists = pair_lists(q, chunk, k)
            best, joint = np.maximum(best, b), np.maximum(joint, j)
            for i, more in enumerate(lower_bounds(q, chunk, lists, k)):
                both = np.concatenate([low[i], more])
                low[i] = both[largest(both, k)]
        for kind, values in (("term", best), ("pair", joint)):
            at = np.flatnonzero(values > 0)
            yield pd.DataFrame({"kind": kind, "no": at, "value": values[at]})
        yield pd.DataFrame({"kind": "low", "no": np.repeat(np.arange(len(low)), [len(x) for x in low]), "value": np.concatenate(low)})

    return scan


def _search_pass(shared, k: int):
    def scan(batches):
        q = shared.value
        scores = [np.empty(0, np.int64)] * len(q.ids)
        docs = [pd.array([], "Int64")] * len(q.ids)
        threshold = q.low.copy()
        for chunk in chunks(q, batches):
            for i in range(len(q.ids)):
                rows, s, _ = top_of_chunk(q, i, chunk, int(threshold[i]))
                if len(rows):
                    both, ids = np.concatenate([scores[i], s]), pd.concat([pd.Series(docs[i]), pd.Series(chunk.docs[rows])]).array
                    top = best_first(both, ids, k)
                    scores[i], docs[i] = both[top], ids[top]
                    if len(top) == k:
                        threshold[i] = max(threshold[i], scores[i][-1])
        for i, s in enumerate(scores):
            yield pd.DataFrame({"q": i, "doc_id": docs[i], "score": s})

    return scan


def _block_search(spark: SparkSession, docs: DataFrame, q: Queries, k: int) -> DataFrame:
    """q (number of the query), rank, doc_id, score."""
    sc = spark.sparkContext
    vocabulary = sc.broadcast(q.vocabulary)
    index = stored(postings(docs, vocabulary), "postings")
    vocabulary.destroy()
    q.docs, q.total = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    weights = np.zeros(len(q.vocabulary), np.int64)
    q.vocabulary = {}
    for t, df in index.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row per term of the block
        weights[t] = weight(q.docs, df)
    q.weigh(weights)

    shared = sc.broadcast(q)
    found = stored(index.mapInPandas(_lists_pass(shared, k), "kind string, no int, value long"), "bounds")
    best, joint, low = np.zeros(len(weights), np.int64), np.full(len(q.pairs), NEVER, np.int64), np.zeros(len(q.ids), np.int64)
    for kind, no, value in found.where("kind <> 'low'").groupBy("kind", "no").agg(F.max("value")).collect():  # a row per term and pair of the block
        (best if kind == "term" else joint)[no] = value
    kth = top(found.where("kind = 'low'").select("no", "value"), "no", [F.desc("value")], k).where(F.col("rank") == k)
    for no, value, _ in kth.collect():
        low[no] = value
    shared.destroy()

    q.bound(best, joint, low)
    shared = sc.broadcast(q)
    local = stored(index.mapInPandas(_search_pass(shared, k), "q int, doc_id long, score long"), "found")
    shared.destroy()
    return top(local, "q", [F.desc("score"), F.asc_nulls_last("doc_id")], k)


def top(df: DataFrame, key: str, order: list, k: int, slices: int = 64) -> DataFrame:
    """The first k rows of each key with their rank; a key's rows are cut down in slices of the input's tasks first."""
    part = Window.partitionBy(key, "__slice").orderBy(*order)
    cut = df.withColumn("__slice", F.spark_partition_id() % slices).withColumn("rank", F.row_number().over(part)).where(F.col("rank") <= k)
    return cut.drop("__slice").withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order))).where(F.col("rank") <= k)


def search(docs: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_id: str = "item_id", query_text: str = "text", k: int = K) -> DataFrame:
    """The k best documents of each query: the query's id column, rank (from 1), doc_id, score."""
    spark = docs.sparkSession
    rows = small_batches(docs).select(column(doc_id).cast("long").alias("doc_id"), column(text).alias("text"))
    asked = queries.select(column(query_id).alias("id"), column(query_text).alias("text"))
    id_type, out = asked.schema["id"].dataType.simpleString(), None
    for q in blocks(asked):
        if not any(q.terms):
            continue
        names = spark.createDataFrame(list(enumerate(q.ids)), f"q int, id {id_type}")
        hits = _block_search(spark, rows, q, k).join(F.broadcast(names), "q")  # a block's ids: no larger than its texts' bound, or one query
        hits = hits.select(F.col("id").alias(query_id), F.col("rank").cast("int").alias("rank"), "doc_id", "score")
        out = hits if out is None else out.unionByName(hits)
    return spark.createDataFrame([], f"`{query_id}` {id_type}, rank int, doc_id long, score long") if out is None else out
