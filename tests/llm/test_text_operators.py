"""Operators on texts against brute force."""

from __future__ import annotations

import math
import random
import re
import time
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from mediaframe.llm import decontaminate, html, language, licenses, quality, tokens

PATH = public_tokenizers.path("byte_bpe_50k.json")
PIECES = ["a", "b", " ", "  ", "\n", "\t", "'", "s", "'re", "é", "ß", "1", "23", "!", "...", "<|endoftext|>", "<|", " ", "　", "\x1c", "\x85", "漢字", "😀", "é", "the", "ing", "\r\n", "²", "\x00"]


def mixed_texts(n, seed=3):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PIECES) for _ in range(rnd.randint(0, 40))) for _ in range(n)]


@pytest.fixture(scope="module")
def counter():
    return tokens.Counter.load(PATH)


def test_token_counts_equal_the_library(counter):
    library = Tokenizer.from_file(PATH)
    for text in [*mixed_texts(2000), "x" * 5000, "the " * 3000, " " * 3000]:
        want = len(library.encode(text, add_special_tokens=False).ids)
        assert [counter.count(text, c) for c in (1, 3, 64, 8192)] == [want] * 4, text[:60]


def test_span_composition_is_associative(counter):
    rnd = random.Random(5)
    for text in mixed_texts(300, 9):
        cuts = sorted(rnd.randint(0, len(text)) for _ in range(2))
        a, b, c = (counter.span(x) for x in (text[: cuts[0]], text[cuts[0] : cuts[1]], text[cuts[1] :]))
        assert counter.join(counter.join(a, b), c) == counter.join(a, counter.join(b, c))


def brute_hits(text, items, width=10):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    w, hit, found = words(text), set(), set()
    for item_id, t in items:
        v = words(t)
        m = min(width, len(v))
        wins = {tuple(v[i : i + m]) for i in range(len(v) - m + 1)} if v else set()
        for i in range(len(w) - m + 1):
            if tuple(w[i : i + m]) in wins:
                hit.update(range(i, i + m))
                found.add(item_id)
    return len(w), len(hit), sorted(found)


def test_hits_equal_brute_force():
    rnd = random.Random(1)
    vocabulary = ["a", "B", "ç", "d-d", "E2", "f,"]
    make = lambda n: " ".join(rnd.choice(vocabulary) for _ in range(n))
    items = [(i, make(n)) for i, n in enumerate([1, 3, 9, 10, 11, 30, 30, 4])][1:]
    texts = [make(rnd.randint(0, 60)) for _ in range(80)] + ["x " + items[4][1] + " y", ""]
    index = decontaminate.NgramIndex.build(items)
    for (n, spans, found), t in zip(index.scan(texts), texts, strict=True):
        assert (n, sum(spans[1::2]) - sum(spans[::2]), found) == brute_hits(t, items)
    assert decontaminate.without_spans("x, one TWO y.", [1, 3]) == "x,  y."


def test_hits_in_blocks_equal_one_block(spark):
    rnd = random.Random(2)
    make = lambda n: " ".join(rnd.choice("abcdefgh") for _ in range(n))
    items = [(i, make(14)) for i in range(60)]
    docs = spark.createDataFrame([(i, make(20) + " " + items[i % 60][1]) for i in range(50)], "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    one = decontaminate.report(docs, bench).collect()
    assert sorted(one) == sorted(decontaminate.report(docs, bench, block_bytes=700).collect())


def test_items_longer_than_a_block_are_cut(spark):
    """An item of several blocks' size hits what it hit whole; its parts hold each of its windows, and no others."""
    rnd = random.Random(4)
    long = " ".join(rnd.choice(["alpha", "beta", "ß", "x", "delta7", "EPS"]) for _ in range(1500)) + "  -- last, words!"
    for size in (1, 50, 400, 10**6):
        parts = decontaminate.item_parts(long, 10, size)
        got = Counter(tuple(w[i : i + 10]) for w in map(decontaminate.words, parts) for i in range(len(w) - 9))
        w = decontaminate.words(long)
        assert got == Counter(tuple(w[i : i + 10]) for i in range(len(w) - 9))
    assert decontaminate.item_parts("few words", 10, 3) == ["few words"] and decontaminate.item_parts("...", 10, 1) == [""]
    docs = spark.createDataFrame([(i, "before " + " ".join(long.split()[40 * i : 40 * i + 9 + i % 3]) + " after") for i in range(30)], "doc_id long, text string")
    bench = spark.createDataFrame([(1, long), (2, "short item"), (3, None)], "item_id long, text string")
    one = decontaminate.report(docs, bench).collect()
    assert sorted(one) == sorted(decontaminate.report(docs, bench, block_bytes=3000).collect())
    assert {r.contaminated for r in one} == {True, False}


def test_repeated_words_equal_brute_force():
    rnd = random.Random(4)
    for _ in range(200):
        w = [rnd.choice("abcde") for _ in range(rnd.randint(0, 40))]
        wins = Counter(zip(w, w[1:], w[2:], strict=False))
        hit = {i + j for i in range(len(w) - 2) if wins[tuple(w[i : i + 3])] > 1 for j in range(3)}
        assert quality.repeated_words([x.encode() for x in w]) == len(hit)


@pytest.mark.parametrize(("line", "rule"), [
    ("A normal sentence stands here, with a comma.", None), ("Be.", None), ("word### word*** other%%%", "symbols"), ("Home / News / Sport / Contact", "navigation"),
    ("THIS IS LOUD!! INDEED!!", "shouting"), ("a a a b b b c c c d", "stutter"), ("We use cookies to do things.", "boilerplate"),
    ("one two three four five six seven eight nine ten eleven twelve", "punctuation"),
])
def test_line_rules(line, rule):
    assert quality.line_fails(line, line.split()) == rule


SCRIPTS = {
    "Urdu": ("یہ ایک سادہ جملہ ہے جو کتاب کے بارے میں بہت کچھ بتاتا ہے", "۔"), "Arabic": ("ذهب الولد إلى السوق مع أخيه ثم عاد إلى البيت قبل غروب الشمس", "؟"),
    "Persian": ("او هر روز به کتابخانه می رود و کتاب تازه ای برای خواندن", "؛"), "Hindi": ("यह एक सरल वाक्य है जो पुस्तक के बारे में बहुत कुछ बताता", "।"),
    "Amharic": ("ይህ ቀላል ዓረፍተ ነገር ነው ስለ መጽሐፉ ብዙ ነገር የሚናገር እና ረጅም የሆነ", "።"), "Armenian": ("սա պարզ նախադասություն է որը շատ բան է պատմում այդ գրքի մասին մեզ", "։"),
    "Khmer": ("នេះ ជា ប្រយោគ សាមញ្ញ មួយ ដែល និយាយ អំពី សៀវភៅ និង អ្នក អាន ច្រើន", "។"), "Burmese": ("ဒါ က ရိုးရှင်း တဲ့ ဝါကျ တစ်ခု ဖြစ် ပြီး စာအုပ် အကြောင်း ပြော ပါ တယ်", "။"),
    "Tibetan": ("འདི ནི ཚིག སྟབས བདེ ཞིག ཡིན པས དེབ ཀྱི སྐོར བཤད", "།"), "Chinese": ("这 是 一 个 简单 的 句子 它 说明 了 书 的 内容", "！"), "Japanese": ("これ は 本 に ついて 多く の こと を 語る 文 です", "？よ"),
    "Greek": ("αυτή είναι μια απλή πρόταση που λέει πολλά για το βιβλίο μας", "·"), "Syriac": ("ܗܢܐ ܗܘ ܦܬܓܡܐ ܦܫܝܛܐ ܕܡܡܠܠ ܥܠ ܟܬܒܐ ܘܥܠ ܩܪܘܝܐ ܕܝܠܗ ܒܝܬܐ ܪܒܐ", "܀"),
    "Thai": ("นี่ คือ ประโยค ง่าย ๆ ที่ บอก เรื่อง ของ หนังสือ ให้ ผู้อ่าน", ""), "Lao": ("ນີ້ ແມ່ນ ປະໂຫຍກ ງ່າຍ ທີ່ ບອກ ເລື່ອງ ຂອງ ປຶ້ມ ໃຫ້ ຜູ້ ອ່ານ ຮູ້", ""),
    "German": ("sie sagte ihm gestern noch einmal ganz leise „komm doch bald zu mir zurück", ".“"),
}


@pytest.mark.parametrize("script", sorted(SCRIPTS))
def test_clean_text_of_every_script_is_kept(script):
    words, stop = SCRIPTS[script]
    text = "\n".join(f"{words} {i}{chr(97 + i % 26) if script == 'German' else words.split()[i % 11]}{i * i}{stop}" for i in range(10))
    assert all(len(x.split()) >= 12 and quality.line_fails(x, x.split()) is None for x in text.split("\n"))
    assert quality.figures(text, max_lost=0)[5] == 0 and quality.clean_text(text) == text
    if stop:  # the mark decides, not the script
        bare = text.split("\n")[0].removesuffix(stop)
        assert quality.line_fails(bare, bare.split()) == "punctuation"


def test_lines_are_removed_before_documents_are_judged():
    prose = "\n".join(f"Line{i} tells{i} of{i} things{i} that{i} are{i} new{i}." for i in range(10))
    junk = "\n".join(f"Home{i} / News{i} / Sport{i} / Contact{i}" for i in range(3))
    assert quality.figures(prose + "\n" + junk)[-1] and quality.clean_text(prose + "\n" + junk) == prose
    assert not quality.figures(prose + "\n" + "\n".join(f"Home{i} / News{i} / Sport{i} / Contact{i}" for i in range(40)))[-1]


ARTICLE = "<p>The first paragraph, which says a few things.<p>Second &amp; <a href=x>last</a>\n one."
WANTED = "The first paragraph, which says a few things.\nSecond & last one."


@pytest.mark.parametrize("page", [
    "<nav><a>Home</a></nav><article>{}</article><footer>Words at the end.</footer>", "<div class='menu'><a>Home</a></div><div id=main>{}</div>",
    "<article>{}<div class=comments><p>I liked this very much, thank you.</p></div></article>", "<main>{}<aside><p>Other things to read, perhaps.</p></aside></main>",
    "<body>{}<script>if (a < b) document.write('<p>no</p>')</script><!-- <p>no</p> -->", "<head><title>t</title></head>{}<form><label>Your name.</label></form>",
    "<div class='ad'>Buy things now.</div>{}", "<div class='cookie-notice'><p>This site keeps things on your disk.</p></div><div class='no-sidebar'>{}</div>",
])
def test_main_text(page):
    assert html.main_text(page.format(ARTICLE)) == WANTED


def brute_cut(n, edges, s, t):
    best = None
    for mask in range(1 << n):
        if mask >> s & 1 and not mask >> t & 1:
            cost = sum((a if mask >> u & 1 and not mask >> v & 1 else 0) + (b if mask >> v & 1 and not mask >> u & 1 else 0) for u, v, a, b in edges)
            best = cost if best is None else min(best, cost)
    return best


def test_cut_is_minimal():
    rnd = random.Random(6)
    for _ in range(60):
        n = 7
        edges = [(u, v, rnd.randint(0, 9), rnd.randint(0, 9)) for u in range(n) for v in range(u) if rnd.random() < 0.5]
        flow = html.Flow(n)
        for e in edges:
            flow.edge(*e)
        side = flow.source_side(0, 1)
        cost = sum((a if side[u] and not side[v] else 0) + (b if side[v] and not side[u] else 0) for u, v, a, b in edges)
        assert side[0] and not side[1] and cost == brute_cut(n, edges, 0, 1)


@pytest.mark.parametrize("page", ["<a" * 500_000, '<a "' * 250_000 + ">x", "<table>" + "<span>" * 20_000 + "<td>x" * 20_000, "<span><li>x" * 40_000, "<" * 500_000, "<!--" * 250_000])
def test_broken_pages_take_linear_time(page):
    """Up to a megabyte of unclosed tags, quotes and comments, and elements nested by the ten thousand."""
    start = time.process_time()
    html.main_text(page)
    assert time.process_time() - start < 8


def test_a_mention_is_no_boilerplate():
    for line in ("Bake the cookie dough for ten minutes, then cool.", "The court held that copyright law applies here.", "She reads the newsletter of the bird club every month."):
        assert quality.line_fails(line, line.split()) is None
    for line in ("All rights reserved.", "Copyright 2020 Example", "Click here to subscribe", "Privacy Policy Terms of Use", "Sign up for our newsletter"):
        assert quality.line_fails(line, line.split()) == "boilerplate"


def test_unclosed_markup_keeps_the_text_before_it():
    assert html.main_text("<article><p>One sentence of the main text, long enough to stay. <b>And more.</b></p><a href='x") .startswith("One sentence")
    assert html.main_text("<article><p>One sentence of the main text, long enough to stay.</p><!-- never closed <p>no</p>") == "One sentence of the main text, long enough to stay."


def test_language_models_tell_held_out_texts(spark):
    words = {"aa": ["kala", "mola", "tika", "lomu"], "bb": ["strng", "vlkch", "zrst", "prchl"], "cc": ["ouéa", "éieu", "oiça", "auée"]}
    rnd = random.Random(8)
    rows = [(i, " ".join(rnd.choice(words[lang]) for _ in range(30)), lang) for i in range(240) for lang in [["aa", "bb", "cc"][i % 3]]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.report(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in out if r.held_out]
    assert held and all(r.lang_pred == r.lang and 0.9 < r.score <= 1 and not r.rejected for r in held)
    model = language.train(language.training_rows(docs))
    odd = model.judge(["xqxqxq jwjwjw qqq xxx " * 20, "", None, "123 !", "kala mola tika lomu kala mola"])
    assert odd["rejected"].tolist() == [True, True, True, True, False] and odd["lang"].tolist()[1:] == ["und", "und", "und", "aa"]


def test_language_stage_learns_all_labelled_rows(spark):
    rnd = random.Random(11)
    sounds = {"aa": ("klmt", "aio"), "bb": ("strv", "yě"), "cc": ("pqdf", "uö"), "dd": ("жшчщ", "ыэю")}

    def text(lang, n):
        c, v = sounds[lang]
        return " ".join("".join(rnd.choice(c) + rnd.choice(v) for _ in range(rnd.randint(1, 3))) for _ in range(n))

    rows = [(i, text(lang, 60), lang) for i, lang in enumerate(["aa", "bb"] * 100)]
    rows += [(None, text("cc", 60), "cc") for _ in range(12)]  # rare, and without an id
    rows += [(1000 + i, text("cc", 60), None) for i in range(20)] + [(2000 + i, text("dd", 60), None) for i in range(20)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = [r.doc_id for r in corpus_pipeline.known_languages(spark, docs, "").collect()]
    assert got.count(None) == 12 and sorted(i for i in got if i is not None) == [*range(200), *range(1000, 1020)]


def brute_models(rows, order=4):
    """Interpolated Kneser-Ney by dictionaries: language -> function(gram) -> probability."""
    found = {}
    for text, lang in rows:
        g, _ = language.grams([text], order)
        for x in g.tolist():
            found.setdefault(lang, Counter())[x] += 1

    def model(counts):
        levels, now = {}, dict(counts)
        for m in range(order, 0, -1):
            n1, n2 = sum(n == 1 for n in now.values()), sum(n == 2 for n in now.values())
            d = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            total, kinds = Counter(), Counter()
            for g, n in now.items():
                total[g >> 16] += n
                kinds[g >> 16] += 1
            levels[m] = now, d, total, kinds
            now = Counter(g & (1 << 16 * (m - 1)) - 1 for g in now)

        def p(g, m=order):
            if m == 0:
                return 1 / 65536
            g &= (1 << 16 * m) - 1
            now, d, total, kinds = levels[m]
            ctx = g >> 16
            if not total[ctx]:
                return p(g, m - 1)
            return max(now.get(g, 0) - d, 0) / total[ctx] + d * kinds[ctx] / total[ctx] * p(g, m - 1)

        return p

    return {lang: model(c) for lang, c in found.items()}


@pytest.mark.parametrize(("entries", "chunk"), [(2_000_000, 8), (150, 2)])
def test_language_query_equals_brute_force(spark, monkeypatch, entries, chunk):
    """The whole query: predictions, scores and rejection's entropies by models of dictionaries, with one block and with many."""
    monkeypatch.setattr(language, "BLOCK_ENTRIES", entries)
    monkeypatch.setattr(language, "CHUNK", chunk)
    rnd = random.Random(5)
    sound = {"aa": "kalmiot", "bb": "strvlye", "cc": "ouépqd", "dd": "жшчыэю", "ee": "kalmstry"}
    text = lambda lang, n: " ".join("".join(rnd.choice(sound[lang]) for _ in range(rnd.randint(1, 6))) for _ in range(n))
    rows = [(i, text(lang, rnd.randint(0, 25)), lang) for i, lang in enumerate(sorted(sound) * 12)] + [(99, "ab", None), (98, None, "aa"), (None, "kala", "aa")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    learned = [(t, lang) for i, t, lang in rows if i is not None and lang and t and zlib.crc32(str(i).encode()) % 4 != 2]
    models = brute_models(learned)
    got = {r.doc_id: r for r in language.report(docs).collect()}
    for i, t, _ in rows:
        g, _ = language.grams([t])
        if not len(g):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        h = {lang: -sum(math.log(p(x)) for x in g.tolist()) / len(g) for lang, p in sorted(models.items())}
        low = min(h.values())
        assert h[got[i].lang_pred] - low < 1e-9
        assert abs(got[i].score - 1 / sum(math.exp(-language.SCALE * (x - low)) for x in h.values())) < 1e-6


def test_a_thousand_label_values_spoil_nothing(spark):
    """Two languages and a thousand labels of one short text each: no gram is cut off, and held-out texts keep their language."""
    rnd = random.Random(6)
    sound = {"aa": ("klmt", "aio"), "bb": ("strv", "yeu")}
    word = lambda lang: "".join(rnd.choice(sound[lang][0]) + rnd.choice(sound[lang][1]) for _ in range(rnd.randint(1, 3)))
    rows = [(i, " ".join(word(lang) for _ in range(60)), lang) for i, lang in enumerate(["aa", "bb"] * 60)]
    junk = [(1000 + i, "".join(rnd.choice("bcdfghjwxz") for _ in range(12)), f"label {i}") for i in range(1000)]
    out = language.report(spark.createDataFrame(rows + junk, "doc_id long, text string, lang string").repartition(4)).collect()
    want = {i: lang for i, _, lang in rows}
    held = [r for r in out if r.held_out and r.doc_id in want]
    assert len(held) > 15 and all(r.lang_pred == want[r.doc_id] for r in held)


def test_kneser_ney_sums_to_one(spark):
    texts = ["abra cadabra", "abba baba", "carab"]
    docs = spark.createDataFrame([(t, "x") for t in texts], "text string, lang string")
    model = language.train(docs)
    g = np.unique(language.grams(texts)[0])
    for context in {int(x) >> 16 for x in g}:
        every = (np.uint64(context & ((1 << 48) - 1)) << np.uint64(16)) | np.arange(1 << 16, dtype=np.uint64)
        assert abs(np.exp(model.log_prob(every, 0, 1)).sum() - 1) < 1e-9


def test_anchors_lose_no_match():
    for _, body in licenses.TEMPLATES:
        b = licenses.template_bigrams(body)
        chosen = licenses.anchors(b, licenses.DICE)
        without = [x for x in b if not set(x.split()) & set(chosen)]
        assert len(without) < licenses.least_common(len(b), licenses.DICE)


def test_licences_equal_brute_force(spark):
    lines = ["Licensed under CC BY-NC 4.0.", "licensed under the  apache License version 2.0", "All rights reserved", "Some licensed thing.", "", "Permission granted to nobody."]
    rnd = random.Random(3)
    texts = ["\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 4))) for _ in range(30)]
    got = {r.doc_id: r for r in licenses.report(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, t in enumerate(texts):
        names, best = set(), 0.0
        for unit in {*t.split("\n"), *re.split("\n[ \t]*\n", t), t}:
            b = licenses.template_bigrams(unit)
            scores = [(2.0 * len(set(b) & set(v)) / (len(b) + len(v)), -k, name) for k, (name, body) in enumerate(licenses.TEMPLATES) for v in [licenses.template_bigrams(body)]] if b else []
            if scores and max(scores)[0] >= licenses.DICE:
                names.add(max(scores)[2])
                best = max(best, max(scores)[0])
        assert (got[i].licences, got[i].best_dice) == (",".join(sorted(names)), best)


def test_quality_is_worked_out_once(spark):
    """Over a scan the filter could take a copy of the rules with it, and each task would hold two Python workers."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    kept = quality.keep_good(docs)
    assert kept._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    assert kept.count() == quality.measured(docs).where("quality.kept").count() > 0
