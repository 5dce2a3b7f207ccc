"""Operators across rows against brute force."""

from __future__ import annotations

import random
import struct
import zipfile
from collections import Counter
from io import BytesIO

import numpy as np
import pytest
import xxhash

from mediaframe.llm import chat, mixing, simhash, warc


def brute_components(prints, radius=4):
    names = dict(prints)
    changed = True
    while changed:
        changed = False
        for a, fa in prints:
            for b, fb in prints:
                if (fa ^ fb).bit_count() <= radius and names_of[a] != names_of[b]:
                    names_of[a] = names_of[b] = min(names_of[a], names_of[b])
                    changed = True
    return names


names_of: dict = {}


def brute_fingerprint(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def near_texts(n, seed):
    rnd = random.Random(seed)
    base = [[rnd.choice("abcdefghijklmnopqrstuvwxyz") * rnd.randint(1, 3) for _ in range(60)] for _ in range(6)]
    out = []
    for _ in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, 4)):
            w[rnd.randrange(len(w))] = rnd.choice("xyz")
        out.append(" ".join(w))
    return [*out, None, "", "one", "One", "a b"]


@pytest.mark.parametrize("tile", [4096, 7])
def test_simhash_equals_brute_force(spark, tile):
    rows = list(enumerate(near_texts(150, 1)))
    prints = [(i, brute_fingerprint(t)) for i, t in rows]
    names_of.clear()
    names_of.update({i: i for i, _ in prints})
    brute_components(prints)
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in simhash.report(spark.createDataFrame(rows, "doc_id long, text string"), tile=tile).collect()}
    assert got == {i: (f, names_of[i]) for i, f in prints}
    assert len(set(names_of.values())) > 6  # some copies are too far apart to link


@pytest.mark.parametrize("bands", [5, 6, 8])
def test_masks_hold_every_pair_within_the_radius(bands):
    rnd = random.Random(bands)
    masks = simhash.band_masks(4, bands)
    for _ in range(500):
        flips = sum(1 << b for b in rnd.sample(range(64), 4))
        assert any(flips & m == 0 for m in masks)


def spans(pairs, rows):
    """Groups of row numbers the pairs connect."""
    name = {i: i for i in rows}
    for a, b in pairs:
        a, b = name[a], name[b]
        for i in name:
            if name[i] in (a, b):
                name[i] = min(a, b)
    return name


def test_forest_spans_all_links():
    rnd = np.random.default_rng(1)
    v = rnd.integers(0, 1 << 63, 200, dtype=np.uint64)
    v[100:] = v[:100] ^ np.uint64(5)
    v[50] = v[51] ^ np.uint64(9)
    every = [(i, j) for i in range(200) for j in range(i) if int(v[i] ^ v[j]).bit_count() <= 4]
    one = simhash.forest(v[:, None], np.zeros(200, np.int8), 4)
    assert spans(one, range(200)) == spans(every, range(200)) and len(one) == 100
    side = (np.arange(200) >= 100).astype(np.int8)
    two = simhash.forest(v[:, None], side, 4)
    assert spans(two, range(200)) == spans([p for p in every if side[p[0]] != side[p[1]]], range(200))
    wide = np.stack([v, v[::-1]], 1)
    every = [(i, j) for i in range(200) for j in range(i) if sum(int(x).bit_count() for x in wide[i] ^ wide[j]) <= 9]
    assert spans(simhash.forest(wide, np.zeros(200, np.int8), 9), range(200)) == spans(every, range(200))


@pytest.mark.parametrize("few", [0, 1000])
def test_hot_cells_are_dealt_by_population_count(spark, monkeypatch, few):
    """Cells of far more rows than a tile: the tiles' links are those of all pairs, and rows go to no tile beyond the radius."""
    monkeypatch.setattr(simhash, "FEW_CELLS", few)
    rnd = random.Random(few)
    base = [rnd.getrandbits(64) & rnd.getrandbits(64) if i % 2 else rnd.getrandbits(64) | rnd.getrandbits(64) for i in range(150)]
    prints = sorted({x ^ sum(1 << b for b in rnd.sample(range(64), k)) for x in base for k in (0, 2, 5)})
    rows = [(i % 3, i, x - (1 << 64) if x >> 63 else x) for i, x in enumerate(prints)]
    cells = spark.createDataFrame(rows, "cell long, name long, fp long")
    got = [(r.u, r.v) for r in simhash.tile_links(cells, ["cell"], ["fp"], "name", 5, 16).collect()]
    every = [(i, j) for i in range(len(prints)) for j in range(i) if i % 3 == j % 3 and (prints[i] ^ prints[j]).bit_count() <= 5]
    assert spans(got, range(len(prints))) == spans(every, range(len(prints)))


def near_copy(words, rnd, share):
    """A copy with words replaced until about ``share`` of the five-word shingles are common."""
    out, left = list(words), set(range(len(words)))
    while simhash.jaccard(" ".join(words), " ".join(out)) > share:
        i = rnd.choice(sorted(left))
        left -= set(range(i - 4, i + 5))
        out[i] = f"new{rnd.randrange(10**6)}"
        if not left:
            break
    return " ".join(out)


def test_near_copies_go_and_others_stay(spark):
    rnd = random.Random(12)
    text = lambda n: [f"w{rnd.randrange(3000)}" for _ in range(n)]
    rows, pairs, apart = [], 0, 0
    for i in range(120):
        words = text(rnd.choice([60, 150, 400]))
        copy = near_copy(words, rnd, rnd.uniform(0.82, 0.99))
        rows += [(2 * i, " ".join(words)), (2 * i + 1, copy)]
        pairs += simhash.jaccard(" ".join(words), copy) >= 0.8
    for i in range(120, 160):  # related, but below the limit: both stay
        words = text(150)
        copy = near_copy(words, rnd, 0.72)
        apart += 2 * (simhash.jaccard(" ".join(words), copy) < 0.8)
        rows += [(2 * i, " ".join(words)), (2 * i + 1, copy)]
    rows += [(1000 + i, "") for i in range(5)] + [(2000 + i, rows[0][1]) for i in range(30)]
    kept = {r.doc_id for r in simhash.keep_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    gone = sum(2 * i + 1 not in kept for i in range(120))
    assert all(2 * i in kept for i in range(160)) and gone >= 0.95 * pairs
    assert sum(i in kept for i in range(240, 320)) == apart == 80
    assert 1000 in kept and not kept & set(range(1001, 1005)) and not kept & set(range(2000, 2030))


def test_a_large_group_of_near_copies_leaves_one(spark):
    rnd = random.Random(13)
    base = [f"w{rnd.randrange(3000)}" for _ in range(200)]
    rows = [(0, " ".join(base))] + [(i, near_copy(base, rnd, 0.96)) for i in range(1, 400)]
    kept = simhash.keep_similar(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), tile=64).collect()
    assert 0 in {r.doc_id for r in kept} and len(kept) <= 4


@pytest.mark.parametrize("tile, heavy, sample", [(4096, 1 << 20, 8000), (16, 1000, 20)])
def test_no_similar_pair_is_left_out(spark, monkeypatch, tile, heavy, sample):
    """Pairs and families of copies about the limit, some around one passage: the rows kept are those of all pairs."""
    monkeypatch.setattr(simhash, "SAMPLE", sample)
    rnd = random.Random(tile)
    passage, texts = [f"p{k}" for k in range(40)], []
    for _ in range(150):
        words = [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([6, 40, 60, 150, 400]))] + passage * rnd.randrange(2)
        texts += [" ".join(words), near_copy(words, rnd, rnd.uniform(0.78, 0.84))]
    for _ in range(4):
        words = [f"w{rnd.randrange(3000)}" for _ in range(120)]
        texts += [near_copy(words, rnd, rnd.uniform(0.8, 0.95)) for _ in range(30)]
    sets = [{bytes(h) for h in simhash.shingle_hashes(t, 5)} for t in texts]
    every = [(i, j) for i in range(len(texts)) for j in range(i) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    kept = {r.doc_id for r in simhash.keep_similar(docs, tile=tile, heavy=heavy).collect()}
    assert kept == set(spans(every, range(len(texts))).values())


def test_chain_is_one_component(spark):
    chain = [(i, (1 << 4 * (i + 1)) - 1) for i in range(15)]
    edges = spark.createDataFrame([(a, b) for (_, a), (_, b) in zip(chain, chain[1:], strict=False)], "u long, v long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(f, chain[0][1]) for _, f in chain}


def test_targets_are_capped_and_reshared():
    assert mixing.targets([100, 100, 100], [1, 1, 1]) == [100.0] * 3
    got = mixing.targets([10, 1000, 1000], [5, 2, 1])
    assert got[0] == 30 and abs(got[1] - 2 * got[2]) < 1e-9 and abs(sum(got) - 2010) < 1e-9
    assert mixing.targets([], []) == [] and mixing.targets([0, 0], [5, 2]) == [0.0, 0.0]


def test_mix_takes_what_the_targets_ask_for(spark):
    rnd = random.Random(2)
    rows = [(i, " ".join(["w"] * rnd.randint(0, 400)), rnd.choice(["a", "b", "c", None, "a"])) for i in range(800)]
    docs = spark.createDataFrame([(*r, r[0]) for r in rows], "doc_id long, text string, source string, size long")
    out = mixing.report(docs).collect()
    assert sorted(out) == sorted(mixing.report(docs.repartition(3)).collect())
    taken, target = Counter(), {}
    for r in out:
        assert r.taken <= 3 * r.size
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert all(abs(taken[s] - t) <= 4 * mixing.BLOCK_WORDS for s, t in target.items())
    mixed = mixing.mixed(docs).collect()
    words = Counter()
    for r in mixed:
        words[r.doc_id] += r.mix_words
        assert len(r.text.split()) == r.mix_words
    assert words == Counter({r.doc_id: r.taken for r in out if r.taken})


def _order(rows):
    return sorted(map(str, rows))


def test_mix_does_not_depend_on_the_order_of_rows(spark):
    """Repeated and missing ids with different texts, one text in two sources, equal rows, extra columns that differ."""
    rng = random.Random(8)
    text = lambda n: " ".join(f"w{rng.randrange(99)}" for _ in range(n))
    rows = [(7, text(40 + i), "a", i) for i in range(20)] + [(None, text(30 + i), "b", i) for i in range(20)] + [(None, None, None, 1)] * 3
    rows += [(1, text(640), s, 0) for s in ("a",)] + [(1, rows[0][1], s, 0) for s in ("a", "b", "c")] + [(2, rows[3][1], "c", k) for k in range(5)] + [(3, "same words here", "b", 9)] * 50
    schema = "doc_id long, text string, source string, extra int"
    one, other = spark.createDataFrame(rows, schema), spark.createDataFrame(rows[::-1], schema).repartition(5)
    assert _order(mixing.report(one).collect()) == _order(mixing.report(other).collect())
    assert _order(mixing.mixed(one).collect()) == _order(mixing.mixed(other).collect())


def test_mixed_delivers_what_the_report_says(spark, monkeypatch):
    monkeypatch.setattr(mixing, "COPIES_A_TASK", 7)
    same = " ".join(["one text of ten words that stands in two sources"] * 64)
    rows = [(1, same, "b"), (1, same, "a")] + [(i, f"filler {i} " * 50, "b") for i in range(2, 30)] + [(50, "copy of a copy", "a")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    want, got = Counter(), Counter()
    for r in mixing.report(docs).collect():
        want[r.doc_id, r.source] += r.taken
    for r in mixing.mixed(docs).collect():
        assert len(r.text.split()) == r.mix_words
        got[r.doc_id, r.source] += r.mix_words
    assert got == Counter({k: n for k, n in want.items() if n})



def test_slots_are_spread_evenly():
    bounds = np.array([int(0.5 * 2**64), int(0.8 * 2**64)], np.uint64)
    s = mixing.slot_sources(0, 10_000, bounds)
    for start in range(0, 10_000, 500):
        n = np.bincount(s[start : start + 500], minlength=3)
        assert abs(n - [250, 150, 100]).max() <= 4


def test_zip_directories():
    members = [("a.txt", b"first"), ("b/ü.bin", bytes(range(256)) * 9)]
    plain = BytesIO()
    with zipfile.ZipFile(plain, "w") as z:
        for name, data in members:
            z.writestr(name, data)
        z.comment = b"PK\x05\x06 in a comment"
    big = warc.zip_bytes(members)
    with zipfile.ZipFile(BytesIO(big)) as z:
        assert z.testzip() is None and [(n, z.read(n)) for n in z.namelist()] == members
    for raw in (plain.getvalue(), big):
        reads = []

        def read(offset, length, raw=raw, reads=reads):
            reads.append(length)
            return raw[offset : offset + length]

        found = warc.directory(read, len(raw))
        assert [(m.name, raw[(at := warc.stored_at(read, m)) : at + m.size]) for m in found] == members
    for bad in (b"", big[:-10], big[:40], b"x" * 100):
        with pytest.raises(ValueError):
            warc.directory(lambda o, n, bad=bad: bad[o : o + n], len(bad))
    packed = BytesIO()
    with zipfile.ZipFile(packed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("a", "a" * 100)
    read = lambda o, n: packed.getvalue()[o : o + n]
    with pytest.raises(ValueError):
        warc.stored_at(read, warc.directory(read, len(packed.getvalue()))[0])
    assert struct.unpack_from("<I", big, 18)[0] == 0xFFFFFFFF  # sizes stand in the ZIP64 records


def test_archives_round_trip(spark):
    body = "<p>" + "x" * 1200
    rows = [(i, f"http://h/{i}", body if i % 3 else body + str(i)) for i in range(40)] + [(90, "u", "short"), (91, "u", "short")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    archives = warc.write_archives(pages, archive_bytes=2000)
    got = {r.page_id: r for r in warc.read_archives(archives).collect()}
    assert archives.count() > 1 and len(got) == 42
    last = max(i for i in range(40) if i % 3)
    for i, url, h in rows:
        assert got[i].payload_bytes == len(h) and got[i].url == url
        assert (got[i].record_type, got[i].refers_to) == (("revisit", last) if i < 40 and i % 3 and i != last else ("response", None))


def test_template_language():
    t = chat.Template("{% if 1 + 1 == 2 %}yes{% else %}no{% endif %}{{ 'a' ~ 'b' | upper }}{# gone #}")
    assert t.nodes == [("text", "yesaB")]
    loop = chat.Template("{% for x in xs %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}")
    assert "".join(p for p, _ in loop._render({"xs": iter("abc")}, False)) == "1,2,3"
    assert chat.Template("{{ a.__class__ }}{{ a.b['c'] }}")._render({"a": {"b": {"c": "<turn>"}}}, False) is not None
    assert "".join(p for p, _ in chat.Template("{{ a.__class__ }}|{{ a.b['c'] }}")._render({"a": {"b": {"c": "<turn>"}}}, False)) == "|\\<turn>"
    for bad in ("{% for %}", "{{ 1 + }}", "{% if x %}", "{{ f(1) }}", "{{ x | run }}", "{% unknown %}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(bad)


@pytest.mark.parametrize("part_chars", [1, 40, 1 << 20])
def test_conversations_read_back(spark, part_chars):
    rnd = random.Random(7)
    bits = ["\\", "<turn>", "</turn>", "<text>", "<", "turn>", "\n", "é", "ok "]
    say = lambda: "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 12)))
    rows = [(c, t, rnd.choice(["user", "assistant", say()]), say()) for c in range(12) for t in range(rnd.randint(1, 9))]
    parts = chat.formatted(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), part_chars=part_chars)
    got = {r.conv_id: r for r in chat.read_back(parts).collect()}
    import hashlib

    for c, r in got.items():
        mine = [x for x in rows if x[0] == c]
        loss = "".join(x[3] for x in mine if x[2] == "assistant")
        assert r.turns_sha256 == hashlib.sha256("".join(f"{x[2]}\n{x[3]}\n" for x in mine).encode()).hexdigest()
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(mine), len(loss), hashlib.sha256(loss.encode()).hexdigest())
        text, _ = chat.Template().render({"role": x[2], "text": x[3]} for x in mine)
        assert r.formatted_chars == len(text)
