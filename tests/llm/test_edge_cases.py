"""Every operator on empty tables, nulls, empty and long texts, ties, repeated rows and clashing extra columns."""

from __future__ import annotations

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from mediaframe.llm import chat, decontaminate, html, language, licenses, mixing, quality, simhash, tokens, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"
TURNS = "conv_id long, turn long, role string, text string"
ITEMS = "item_id long, text string"
LONG = "word%d and more. " * 20_000 % tuple(range(20_000))
ROWS = [
    (1, "One text of some words.", "en", "a", 3), (1, "One text of some words.", "en", "a", 3), (2, None, "en", "a", None), (3, "", None, "b", 0),
    (None, "no id here", "en", None, 1), (4, " \t\n  ", "de", "b", 1), (5, LONG, "en", "a", 9), (6, "\x00 ퟿ 😀 ß", None, None, 2), (7, "One text of some words.", "fr", "c", 3),
]
BENCH = [(1, "one text of some words"), (1, "one text of some words"), (None, "no id here"), (2, None), (3, ""), (4, "a")]
CLASH = ["size", "n", "hits", "quality", "language", "tokens", "fp", "key", "off", "no", "words", "lang_pred", "__blk", "__salt", "salt", "u", "v", "rank", "found", "payload", "part", "a.b"]


def clashing(df):
    return df.select("*", *[F.lit(i).alias(c) for i, c in enumerate(CLASH)])


def queries(docs, items, pages, turns):
    return {
        "op1": lambda: html.report(pages), "op2": lambda: decontaminate.report(docs, items), "op3": lambda: quality.report(docs),
        "op4": lambda: tokens.report(docs, public_tokenizers.path("byte_bpe_50k.json")), "op5": lambda: mixing.report(docs), "op6": lambda: warc.report(pages),
        "op7": lambda: chat.report(turns), "op8": lambda: licenses.report(docs), "op9": lambda: simhash.report(docs), "op10": lambda: language.report(docs),
    }


NAMES = [f"op{i}" for i in range(1, 11)]
PAGE_ROWS = [(1, "http://a/\r\nb", "<p>x.</p>"), (1, "http://a", "<p>x.</p>"), (2, None, None), (None, "u", "<p>" + "y " * 600), (3, "u", "<p>" + "y " * 600), (4, "u", ""), (5, "u", "<" * 3000)]
TURN_ROWS = [(1, 0, "user", "a\\<turn>"), (1, 0, "user", "a\\<turn>"), (1, 1, "assistant", None), (None, None, None, "x"), (2, None, "assistant", "</turn>"), (2, 5, "", "")]


@pytest.mark.parametrize("name", NAMES)
def test_empty_tables(spark, name):
    e = lambda schema: spark.createDataFrame([], schema)
    assert queries(e(DOCS), e(ITEMS), e(PAGES), e(TURNS))[name]().count() == 0


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_and_clashing_columns(spark, name):
    docs, items = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(BENCH, ITEMS)
    pages, turns = spark.createDataFrame(PAGE_ROWS, PAGES), spark.createDataFrame(TURN_ROWS, TURNS)
    plain = sorted(map(str, queries(docs, items, pages, turns)[name]().collect()))
    wide = sorted(map(str, queries(clashing(docs), clashing(items), clashing(pages), clashing(turns))[name]().collect()))
    assert plain == wide
    assert len(plain) == {"op1": len(PAGE_ROWS), "op6": len(PAGE_ROWS), "op7": 3}.get(name, len(ROWS))


def test_results_of_odd_rows(spark):
    docs, items = spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(BENCH, ITEMS)
    by = lambda df: {r["doc_id"]: r for r in df.collect()}
    leak = by(decontaminate.report(docs, items))
    assert (leak[1].n_words, leak[1].n_hit, leak[1].n_items) == (5, 5, 1) and leak[2].n_words == 0 and not leak[2].contaminated
    assert leak[None].n_hit == 3 and leak[None].n_items == 0 and leak[None].contaminated  # an item without an id
    good = by(quality.report(docs))
    assert good[2].n_words == good[3].n_words == 0 and good[2].base_failed and not good[2].kept and good[5].kept
    mix = by(mixing.report(docs))
    assert mix[2].size == mix[4].size - 1 == 0 and mix[2].taken == 0  # a no-break space is a word here
    near = by(simhash.report(docs))
    assert near[2].fingerprint == near[3].fingerprint == "0" * 16 and near[3].component_id == 2 and near[7].component_id == 1
    spoken = by(language.report(docs))
    assert spoken[2].lang_pred == spoken[4].lang_pred == "und" and spoken[2].score == 0


def test_filters_keep_all_columns(spark):
    docs, items = clashing(spark.createDataFrame(ROWS, DOCS)), spark.createDataFrame(BENCH, ITEMS)
    model = language.train(language.training_rows(docs))
    for out in (quality.keep_good(docs), simhash.keep_one(docs), simhash.keep_similar(docs), decontaminate.decontaminate(docs, items), decontaminate.decontaminate(docs, items, remove="spans"), language.keep_known(docs, model)):
        assert out.columns == docs.columns
        out.collect()
    assert mixing.mixed(docs).columns == [*docs.columns, "mix_epoch", "mix_words"]


@pytest.mark.parametrize("rows", [[], ROWS, ROWS + [(100 + i, f"Text{i} has{i} " + " ".join(f"w{i}x{k}," for k in range(80)) + ".", "en", None if i % 3 else "s", 1) for i in range(12)]])
def test_pipeline_on_odd_tables(spark, tmp_path, rows):
    clashing(spark.createDataFrame(rows, DOCS)).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(BENCH if rows else [], ITEMS).write.parquet(str(tmp_path / "benchmark.parquet"))
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.columns == [*spark.read.parquet(str(tmp_path / "documents.parquet")).columns, "mix_epoch", "mix_words"]
    assert {r.doc_id for r in out.collect()} <= {r[0] for r in rows}


def test_one_row_of_each_group_of_copies_stays(spark):
    texts = [" ".join(f"{c}{k}{c * (k % 5)}" for k in range(60)) for c in "abcdef"]
    rows = [
        (7, texts[0], "x"), (7, texts[0], "x"), (7, texts[0], "x"),  # repeated rows
        (None, texts[1], "x"), (None, texts[1], "y"), (None, texts[2], "x"), (9, texts[2], "x"), (None, texts[5], "x"),  # no id
        (1, texts[3], "x"), (2, texts[3], "x"), (2, texts[4], "x"),  # one id, a copy and a text of its own
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    got = sorted(((r.doc_id, texts.index(r.text)) for r in simhash.keep_one(docs).collect()), key=str)
    assert got == sorted([(7, 0), (None, 1), (9, 2), (None, 5), (1, 3), (2, 4)], key=str)
    assert got == sorted(((r.doc_id, texts.index(r.text)) for r in simhash.keep_similar(docs).collect()), key=str)
