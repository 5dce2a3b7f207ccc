"""The registered queries and the pipeline on the smallest tables: against SQL, or against brute force where SQL has no twin."""

from __future__ import annotations

import html
import os
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from mediaframe.llm import decontaminate, language, mixing, quality, simhash
from mediaframe.llm.common import table
from mediaframe.llm.queries import QUERIES, SQL
from tests.oracle_check import compare, connect

SF = os.environ.get("SF_DIR", "/root/testdata/sf0.001")


def test_every_operator_has_one_query():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, name):
    assert compare(QUERIES[name](spark, SF), connect(SF), SQL[name]).startswith("ok")


def test_main_text_of_all_pages(spark):
    """The pages keep their text in <article>; headings and paragraphs are its blocks."""
    got = {r.page_id: r for r in QUERIES["op1_html"](spark, SF).collect()}
    for r in table(spark, SF, "pages").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article))
        want = "\n".join(b for b in blocks if b)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_token_counts_of_all_documents(spark):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = {r.doc_id: r for r in QUERIES["op4_tokens"](spark, SF).collect()}
    for r in table(spark, SF, "documents").collect():
        n = len(library.encode(r.text or "", add_special_tokens=False).ids)
        g = got[r.doc_id]
        assert (g.n_tokens, g.n_bytes, g.over_limit) == (n, len((r.text or "").encode()), n > 1024)


def components(prints: dict[int, int]) -> dict[int, int]:
    name = {i: i for i in prints}
    changed = True
    while changed:
        changed = False
        for a in prints:
            for b in prints:
                if (prints[a] ^ prints[b]).bit_count() <= 4 and name[a] > name[b]:
                    name[a], changed = name[b], True
    return name


def test_components_of_all_documents(spark):
    prints = {r.doc_id: simhash.fingerprint(r.text) for r in table(spark, SF, "documents").collect()}
    want = components(prints)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in QUERIES["op9_simhash"](spark, SF).collect()}
    assert got == {i: (f, want[i]) for i, f in prints.items()}


def test_held_out_languages(spark):
    rows = QUERIES["op10_language"](spark, SF).join(table(spark, SF, "documents").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)


FOREIGN = [
    "Der schnelle braune Fuchs springt über den faulen Hund und läuft danach in den dunklen Wald hinein, wo er bis zum Abend schläft.",
    "Le renard brun rapide saute par-dessus le chien paresseux puis s'enfuit dans la forêt sombre où il dort jusqu'au soir.",
    "Быстрая коричневая лиса прыгает через ленивую собаку и убегает в тёмный лес, где спит до самого вечера.",
    "Szybki brązowy lis przeskakuje nad leniwym psem i ucieka do ciemnego lasu, gdzie śpi przez cały dzień.",
    "素早い茶色の狐はのろまな犬を飛び越えて暗い森へ走り去った。そして夕方まで眠った。",
    "Nopea ruskea kettu hyppää laiskan koiran yli ja juoksee sitten pimeään metsään nukkumaan koko päiväksi.",
    "xq zvkj wqpl mnbv cxzq lkjh gfds qpwo eiru tyal skdj fhgz mxnc bvqp wkej rhtg ybnu vmic oxlp",
]


def test_language_stage_rejects_what_no_language_explains(spark):
    """Planted texts in languages, or none, that the corpus's made-up prose is not written in go; its own documents all stay."""
    docs = table(spark, SF, "documents")
    planted = spark.createDataFrame([(10_000 + i, t, None, "x", len(t)) for i, t in enumerate(FOREIGN)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.known_languages(spark, docs.unionByName(planted), SF).collect()}
    assert kept == {r.doc_id for r in docs.collect()}


def test_pipeline_stages(spark):
    docs = table(spark, SF, "documents")
    columns, model = docs.columns, language.train(language.training_rows(docs))
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        out = stage(spark, docs, SF).cache()
        after = {r.doc_id: r for r in out.collect()}
        if name == "language":
            verdicts = model.judge([r.text for r in before])["rejected"]
            want = {r.doc_id for r, gone in zip(before, verdicts, strict=True) if not gone}
        elif name == "quality":
            want = {r.doc_id for r in before if quality.figures(r.text)[-1]}
            assert all(after[r.doc_id].text == quality.clean_text(r.text) for r in before if r.doc_id in want)
        elif name == "near_duplicates":
            # what exact comparison of all pairs finds: nothing else goes, and at most a tenth of it stays
            kinds = {r.doc_id: {bytes(h) for h in simhash.shingle_hashes(r.text, 5)} for r in before}
            order, twins = sorted(kinds), {}
            for k, i in enumerate(order):
                for j in order[:k]:
                    if len(kinds[i] & kinds[j]) >= 0.8 * len(kinds[i] | kinds[j]):
                        twins.setdefault(i, j)
            gone = set(order) - set(after)
            assert gone <= set(twins) and len(gone) >= 0.9 * len(twins) > 0
            want = set(after)
        elif name == "decontamination":
            index = decontaminate.NgramIndex.build([tuple(r) for r in table(spark, SF, "benchmark").select("item_id", "text").collect()])
            want = {r.doc_id for r in before if not index.scan([r.text])[0][1]}
        else:
            size = {r.doc_id: len(r.text.encode().split()) for r in before}
            sources = sorted({r.source for r in before})
            words = [sum(size[r.doc_id] for r in before if r.source == s) for s in sources]
            target = mixing.targets(words, [mixing.WEIGHTS[i % 3] for i in range(len(sources))])
            taken = dict.fromkeys(sources, 0)
            for r in out.collect():
                taken[r.source] += r.mix_words
                assert len(r.text.encode().split()) == r.mix_words <= size[r.doc_id] and r.mix_epoch < 3
            assert all(abs(taken[s] - t) <= 4 * mixing.BLOCK_WORDS for s, t in zip(sources, target, strict=True))
            break
        assert set(after) == want and out.columns == columns and len(want) < len(before) + (name == "language")
        docs = out


def test_pipeline_runs(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.count() > 0 and "mix_words" in out.columns
