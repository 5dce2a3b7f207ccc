"""Ranked search, whitening and packing: brute force, exact round trips, odd rows."""

from __future__ import annotations

import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from mediaframe.llm import packing, search, whitening
from mediaframe.llm.queries import QUERIES
from tests.llm.test_edge_cases import BENCH, DOCS, ITEMS, ROWS, clashing
from tests.llm.test_queries import SF

BPE = public_tokenizers.path("byte_bpe_50k.json")
VECTORS = "vec_id long, embedding array<float>, label int"


def brute_search(docs, items, k=50):
    pattern = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
    terms = lambda t: ["".join(c.lower() if c < "\x80" else c for c in w) for w in pattern.findall(t or "")]
    bags = [(d, Counter(terms(t))) for d, t in docs]
    total, count = sum(sum(b.values()) for _, b in bags), sum(bool(b) for _, b in bags)
    df = Counter(w for _, b in bags for w in b)
    out = []
    for item, text in items:
        hits = []
        for d, b in bags:
            score = 0
            for w in set(terms(text)) & set(b):
                m = 100 - 50 + 50 * sum(b.values()) * count // total
                score += math.floor(1000 * math.log((2 * count + 2) / (2 * df[w] + 1))) * (1000000000 * b[w] // (1000 * b[w] + 20 * m))
            if score:
                hits.append((-score, d is None, d or 0, d))
        out += [(item, i + 1, h[3], -h[0]) for i, h in enumerate(sorted(hits)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted(((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect()), key=str)


@pytest.mark.parametrize(("k", "seed"), [(3, 1), (50, 2)])
def test_search_equals_brute_force(spark, monkeypatch, k, seed):
    """Small chunks and blocks, so that bounds, thresholds and merges all take part."""
    monkeypatch.setattr(search, "DOCS_A_CHUNK", 40)
    rng = random.Random(seed)
    vocabulary = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(4000)]
    docs = [(i % 390, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60)))) for i in range(400)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 25)))) for i in range(30)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = found(search.search(df, spark.createDataFrame(items, ITEMS), k=k))
    assert got == brute_search(docs, items, k)
    monkeypatch.setattr(search, "BLOCK_BYTES", 200)
    assert found(search.search(df, spark.createDataFrame(items, ITEMS), k=k)) == got


def chunk_of(pages, q):
    counts = [Counter(search.words(t)) for t in pages]
    terms = [np.array([q.vocabulary[w] for w in c if w in q.vocabulary], np.int64) for c in counts]
    tfs = [np.array([c[w] for w in c if w in q.vocabulary], np.int64) for c in counts]
    return search.Chunk(q, pd.array(range(len(pages)), "Int64"), [sum(c.values()) for c in counts], terms, tfs)


def test_pair_bounds_skip_more_than_single_maxima():
    """Two frequent terms that never meet bound each other; no document is lost, and fewer are looked at."""
    pages = [f"{'apple' if i % 2 else 'pear'} filler" for i in range(200)] + ["quince apple filler"] * 3
    q = search.Queries([0], ["apple pear quince"])
    q.docs, q.total = len(pages), sum(len(p.split()) for p in pages)
    df = Counter(w for p in pages for w in set(search.words(p)))
    q.weigh(np.array([search.weight(q.docs, df[w]) for w in q.vocabulary], np.int64))
    chunk = chunk_of(pages, q)
    best, joint, lists = search.pair_lists(q, chunk, 3)
    low = np.array([np.sort(search.lower_bounds(q, chunk, lists, 3)[0])[0]])
    q.bound(best, joint, low)
    paired = q.rest[0].copy()
    rows, scores, _ = search.top_of_chunk(q, 0, chunk, int(low[0]))
    q.bound(best, np.full(len(q.pairs), 1 << 60), low)  # no saving: independent maxima
    alone = q.rest[0]
    assert (paired <= alone).all() and (paired < alone).any()
    assert sorted(rows.tolist()) == [200, 201, 202] and len(set(scores.tolist())) == 1


def test_best_split_is_the_best():
    rng = random.Random(5)
    for _ in range(200):
        gains = [rng.randrange(-3, 9) for _ in range(rng.randrange(0, 9))]
        got = search.best_split(gains)
        assert all(b - a > 1 for a, b in zip(sorted(got), sorted(got)[1:], strict=False))
        most = max(sum(g for i, g in enumerate(gains) if m >> i & 1) for m in range(1 << len(gains)) if not m & m >> 1)
        assert sum(gains[i] for i in got) == most


def test_search_on_odd_rows(spark):
    docs, items = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(BENCH, ITEMS)
    want = brute_search([r[:2] for r in ROWS], BENCH)
    assert found(search.search(docs, items)) == want
    assert found(search.search(clashing(docs), clashing(items))) == want
    empty = lambda s: spark.createDataFrame([], s)
    assert search.search(empty(DOCS), items).count() == 0 and search.search(docs, empty(ITEMS)).count() == 0
    named = search.search(docs, items.select(F.concat(F.lit("i"), "item_id").alias("item_id"), "text"))
    assert {r.item_id for r in named.collect()} == {"i1", None}  # one letter of item 4 is in no text


def brute_whitening(vectors):
    x = np.floor(np.array(vectors, np.float32).astype(float) * 64).astype(np.int64) + 1000000
    n, s = len(x), x.sum(0)
    y = x - s / n
    e, u = np.linalg.eigh(y.T @ y / n)
    e, u = e[::-1], u[:, ::-1]
    k = min(32, int((e > len(e) * 2.3e-16 * e[0]).sum()))
    return ((n * x - s) ** 2).sum(1), np.abs(y @ u[:, :k] / np.sqrt(e[:k])), e[:k] / e.sum()


@pytest.mark.parametrize(("rows", "width", "entries"), [(300, 7, 1 << 19), (300, 40, 256), (50, 3, 6)])
def test_whitening_equals_numpy(spark, monkeypatch, rows, width, entries):
    monkeypatch.setattr(whitening, "BLOCK_ENTRIES", entries)  # several row blocks
    monkeypatch.setattr(whitening, "BLOCK_COLUMNS", 16)  # several column blocks
    rng = np.random.default_rng(rows + width)
    vectors = (rng.normal(size=(rows, width)) * np.linspace(1, 9, width) + 100).tolist()
    df = spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], VECTORS).repartition(3)
    got = whitening.report(df).toPandas()
    dev, white, explained = brute_whitening(vectors)
    assert len(got) == white.size and (got.n == rows).all() and got.identity_error.max() < 1e-9
    one = got[got.component == 1].set_index("vec_id")
    assert (one.deviation.loc[range(rows)].to_numpy() == dev).all()
    table = got.pivot(index="vec_id", columns="component", values="whitened").loc[range(rows)].to_numpy()
    assert np.abs(np.abs(table) - white).max() < 1e-8
    assert np.allclose(got[got.vec_id == 0].sort_values("component").explained, explained)
    signs = np.sign(table * white * np.sign(table[:, :]))
    assert (signs >= 0).all()


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    good = [(1, [0.5, 1.0, -2.0]), (1, [0.5, 1.0, -2.0]), (None, [1.5, 0.25, 3.0]), (2, [-4.0, 2.0, 1.0]), (3, [7.0, -1.0, 0.0])]
    bad = [(4, None), (5, []), (6, [1.0, None, 2.0]), (7, [nan, 1.0, 1.0]), (8, [inf, 1.0, 1.0]), (9, [1.0, 2.0]), (10, [3e38, 1.0, 1.0])]
    df = spark.createDataFrame([(*r, 0) for r in good + bad], VECTORS)
    rows = whitening.report(df).collect()
    assert Counter(r.vec_id for r in rows) == {1: 6, None: 3, 2: 3, 3: 3} and {r.n for r in rows} == {5}
    wide = df.select("*", F.lit(1).alias("row"), F.lit(1).alias("x"), F.lit(1).alias("n"), F.lit(1).alias("whitened"), F.lit(1).alias("__id"), F.lit(1).alias("a.b"))
    assert sorted(map(str, whitening.report(wide).collect())) == sorted(map(str, rows))
    for few in ([], good[:1], good[:1] * 4, bad):
        assert whitening.report(spark.createDataFrame([(*r, 0) for r in few if r[0] not in (9, 10)], VECTORS)).count() == 0


def test_deviation_beyond_a_long_is_null(spark):
    df = spark.createDataFrame([(1, [5e13], 0), (2, [-5e13], 0), (3, [0.0], 0)], VECTORS)
    assert {r.vec_id: r.deviation is None for r in whitening.report(df).collect()} == {1: True, 2: True, 3: False}


def check_packing(pieces, texts, capacity=1024):
    """Every id of every document in one piece, checksums right, offsets gapless, nothing over capacity; returns the padding's share."""
    library = Tokenizer.from_file(BPE)
    ids = {d: np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4") for d, t in texts}
    docs, bins = defaultdict(list), defaultdict(list)
    for p in pieces:
        docs[p.doc_id].append(p)
        bins[p.sequence_id].append(p)
    assert set(docs) == set(ids)
    for d, ps in docs.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.length > 0 and p.doc_tokens == len(ids[d])
            assert p.ids_crc32 == zlib.crc32(ids[d][at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids[d])
    tokens = padding = 0
    for ps in bins.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= capacity
        tokens += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    return padding / (padding + tokens)


def test_packing_of_all_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = [(r.doc_id, r.text) for r in docs.collect()]
    assert check_packing(QUERIES["op13_packing"](spark, SF).collect(), texts) < 0.01
    # many small tasks: their unfinished bins are filled by the levels above
    spread = packing.packed(docs.repartition(40), BPE)
    assert check_packing(spread.collect(), texts) < 0.01
    s = packing.sequences(spread).agg(F.sum("tokens"), F.sum("padding")).first()
    assert s[1] < 0.01 * s[0]


@pytest.mark.parametrize("capacity", [16, 100, 1024])
def test_cuts_of_every_length(capacity):
    for n in range(1, 5 * capacity):
        got = packing.cuts(n, capacity, 8, 8)
        assert sum(got) == n and max(got) <= capacity and (len(got) == 1 or min(got) >= 8)


def test_a_full_bin_holds_its_class_count():
    bins, rng, done = packing.Bins(1024, 0), random.Random(1), defaultdict(list)
    pieces = [(i, 0, rng.randrange(1, 1025), 0, 0) for i in range(3000)]
    for p in pieces:
        for row in bins.add(p):
            done[row[5]].append(row)
    for rows in done.values():
        assert {1024 // r[2] for r in rows} == {len(rows)}
    left = bins.left()
    assert sum(map(len, done.values())) + len(left) == len(pieces)
    assert all(n < k for k, n in Counter(1024 // p[2] for p in left).items())


def test_packing_of_odd_rows(spark):
    rows = [r for r in ROWS if r[0] != 1] + [(1, "One text of some words. <|endoftext|> and  more", "en", "a", 3), (8, "x" * 300_000, "en", "a", 1)]
    docs = spark.createDataFrame(rows, DOCS)
    texts = [(r[0], r[1]) for r in rows]
    check_packing(packing.packed(docs, BPE).collect(), texts)
    by = lambda df: sorted((str(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens) for r in df.collect())
    assert by(packing.packed(docs, BPE)) == by(packing.packed(clashing(docs), BPE))
    twice = packing.packed(docs.unionByName(docs), BPE)
    assert twice.groupBy("doc_id", "start").count().where("count <> 2").count() == 0
    assert packing.packed(spark.createDataFrame([], DOCS), BPE).count() == 0


def test_parts_do_not_change_the_ids():
    rng, library = random.Random(3), Tokenizer.from_file(BPE)
    for size in (1, 5, 50):
        text = "".join(rng.choices(["a", "Z", "é", "😀", " ", "  ", "\n", "\t", "'s", "7", "!", "　", " ", " ", "\x1c", "\x85", "<|endoftext|>"], k=2000))
        split = packing.parts(text, size)
        assert "".join(split) == text
        assert [i for p in split for i in library.encode(p, add_special_tokens=False).ids] == library.encode(text, add_special_tokens=False).ids


def test_both_encoders_give_the_same_ids(monkeypatch):
    rng = random.Random(4)
    texts = ["", " ", "\n" * 300_000 + "a", " " * 3_000_000, "x" * 100_000, "a <|endoftext|>  <|endoftext|><|endoftext", "漢字" * 20_000]
    texts += ["".join(rng.choices("aZé😀 \n\t'7!　\x1c\x85<|>́ٵ", k=500)) for _ in range(100)]
    assert packing.rank_encoder(BPE) is not None and packing.rank_encoder(public_tokenizers.path("word_bpe_49k.json")) is None
    quick = [packing.token_ids(t, BPE).tolist() for t in texts]
    monkeypatch.setattr(packing, "rank_encoder", lambda path: None)
    assert quick == [packing.token_ids(t, BPE).tolist() for t in texts]
