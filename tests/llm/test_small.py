"""Operators on hand-made tables, against brute force: nulls, empties, long texts, ties, repeats, empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
import pytest

from ruleweave.llm import audio, decontam, gru, html_text, kneser_ney, langid, lm, minhash, packing, sharding, textnp, tokens, toxicity, training
from ruleweave.llm.queries import tokenizer_file

R = random.Random(3)
WORDS = ["".join(R.choice("abcdefgh") for _ in range(R.randint(1, 6))) for _ in range(200)]
ODD = [(1, None), (2, ""), (3, "  \n\t "), (4, "one"), (5, "Tab\tand\n\nlines  and é"), (6, "x" * 5000), (7, "?!"), (None, "no id here"), (8, "one"), (8, "one")]


def text(n, r=R):
    return " ".join(r.choice(WORDS) for _ in range(n))


def rows(df, *names):
    return sorted((tuple(r) for r in df.select(*names).collect()), key=lambda t: tuple((x is None, x) for x in t))


def test_word_hashes():
    w = textnp.Words(["Ab cD\x0bé", None, "", "cd AB " + "q" * 200_000])
    assert w.count().tolist() == [3, 0, 0, 3] and w.hash[0] == w.hash[4] and w.hash[1] == w.hash[3]
    assert [w.word(i) for i in range(3)] == [b"ab", b"cd", "é".encode()]
    many = [text(300) for _ in range(40)]
    whole = textnp.Words(many)
    assert whole.hash.tolist() == [h for t in many for h in textnp.Words([t]).hash.tolist()]
    assert len(set(whole.hash.tolist())) == len({x for t in many for x in t.split()})


def test_bit_packing():
    rng = np.random.default_rng(1)
    for bits in (1, 3, 13, 16, 17, 31):
        ids = rng.integers(0, 1 << bits, 1001)
        data = tokens.pack(ids, bits)
        assert len(data) == -(-1001 * bits // 8)
        for at, n in ((0, 1001), (7, 0), (500, 13), (1000, 1)):
            assert tokens.unpack(data, bits, at, n).tolist() == ids[at : at + n].tolist()
    assert [tokens.bits_for(v) for v in (1, 2, 3, 256, 257, 50257)] == [1, 1, 2, 8, 9, 16]


@pytest.mark.parametrize(("name", "lower"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_token_coder(name, lower):
    coder = tokens.TokenCoder(tokenizer_file(name), lower)
    made = ["".join(R.choice("abAB '’sdöß.,!?-_0123\n\t  \r¿éÿ×÷€llII²Ⅷ漢ـ\x1c<|endoftext|>") for _ in range(R.randint(0, 30))) for _ in range(1500)]
    assert coder.encode(made) == coder.whole(made)


def test_blocks(spark, docs, tmp_path):
    some = ODD + [(100 + i, text(R.randint(0, 400))) for i in range(60)]
    out = str(tmp_path / "blocks")
    file = tokenizer_file("byte_bpe_50k.json")
    tokens.write(docs(some), out, file, block=500)
    coder = tokens.TokenCoder(file, False)
    start, want, stream = 0, [], []
    for i, t in sorted(some, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = coder.whole([t or ""])[0] + b"\0\0\0\0"
        want.append((i, start, len(ids) // 4, zlib.crc32(ids)))
        stream += np.frombuffer(ids, "<u4").tolist()
        start += len(ids) // 4
    got = sorted((tuple(r) for r in tokens.documents(spark, out).collect()), key=lambda r: r[1])
    assert got == want
    first = tokens.ids_at(spark, out, 0, 0, 10**9).tolist()
    assert first == stream[: len(first)] and tokens.ids_at(spark, out, 0, 3, 5).tolist() == stream[3:8]
    tokens.write(docs([]), str(tmp_path / "none"), file)
    assert tokens.documents(spark, str(tmp_path / "none")).count() == 0


def test_html():
    page = """<html><head><title>T</title><style>p{}</style></head><body><div id="page-header"><a href=/>Home</a></div>
    <ul class="main-menu"><li><a href=a>A</a><li><a href=b>B</a></ul><div class="cookie-notice">We use cookies, yes, we do, and more of them.</div>
    <div class=content><h2>Head &amp; line</h2><p>First paragraph, which is long,   enough, to score &eacute;.<p>Second one, <b>bold</b>
    text<br>and a <a href=x>link</a>.<script>var p = "</p>";</script><form><input name=q>Search here, please, and more</form>
    <ul><li>point one<li>point two</ul><div class="comments"><p>A reader, who wrote, a long, comment here.</div></div>
    <aside><p>Other, stuff, that, is, read, as, well, by, many.</p></aside><footer>(c) all rights, reserved, here</footer>"""
    assert html_text.main_text(page) == "Head & line First paragraph, which is long, enough, to score é. Second one, bold text and a link. point one point two"
    assert [html_text.main_text(x) for x in (None, "", "<", "plain", "<p>a<p>b", "<div>x</div" * 3, "<!-- c --><p>d")] == ["", "", "<", "plain", "a b", "xxx"[:1] and html_text.main_text("<div>x</div" * 3), "d"]
    assert len(html_text.main_text("<article>" + "<p>word, " * 20_000)) == 20_000 * 6 - 1


def made_page(r):
    """(html, blocks of the article) of a page without an article element, in one of several layouts."""

    def sentence(n):
        return " ".join(r.choice(WORDS) + ("," if r.random() < 0.15 else "") for _ in range(n)).strip(",") + "."

    wrap = r.choice([("<div class=content>", "</div>"), ("<section id=story>", "</section>"), ("<div><div class='entry-body'>", "</div></div>")])
    blocks, parts = [], []
    for k in range(r.randint(3, 9)):
        t = sentence(r.randint(25, 90))
        kind = r.choice(["p", "p", "p", "h2", "ul", "named"])
        if kind == "h2":
            t = " ".join(r.choice(WORDS) for _ in range(5))
            parts.append(f"<h2>{t}</h2>")
        elif kind == "ul":
            parts.append(f"<ul><li>{t}</li></ul>")
        elif kind == "named":
            t = " ".join(sentence(60) for _ in range(6))
            parts.append(f'<div class="{r.choice(["social-history", "related-work"])}"><p>{t}</p></div>')
        else:
            parts.append(f"<p>{t}</p>")
        blocks.append(t)
    links = "".join(f"<li><a href=/{i}>{r.choice(WORDS)}</a></li>" for i in range(8))
    junk = [f'<div class="{r.choice(["sidebar-left", "ad-box", "newsletter", "cookie-notice", "related-posts"])}"><p>{sentence(9)}</p><ul>{links}</ul></div>', f"<div id=comments><p>{sentence(40)}</p><p>{sentence(60)}</p></div>", f"<form><p>{sentence(12)}</p></form>"]
    inner = list(parts)
    inner.insert(r.randint(1, len(inner)), f'<div class="share-buttons"><a href=x>{r.choice(WORDS)}</a></div>')
    body = wrap[0] + "".join(inner) + wrap[1]
    rest = [f"<nav><ul>{links}</ul></nav>", f"<div class=site-header><h1>{sentence(4)}</h1></div>", body, *r.sample(junk, 2), f"<footer>{sentence(15)}</footer>"]
    return f"<html><head><title>x</title><script>var a = '<p>no</p>';</script></head><body>{''.join(rest)}</body></html>", blocks


def test_html_blocks_without_article_elements():
    """Nearly all words of the articles, and nearly no others, in pages of several layouts."""
    r = random.Random(12)
    same = found = wanted = 0
    for _ in range(120):
        page, blocks = made_page(r)
        got, want = Counter(html_text.main_text(page).split()), Counter(" ".join(blocks).split())
        same += sum((got & want).values())
        found += sum(got.values())
        wanted += sum(want.values())
    assert same / wanted > 0.97 and same / found > 0.97, (same / wanted, same / found)
    deep = "<div>" * 3000 + "<p>" + "word, " * 40
    assert html_text.main_text(deep) == ("word, " * 40).strip()


def test_html_table(spark):
    pages = spark.createDataFrame([(1, "u", None, "x"), (2, None, "<p>Hé", "y")], "page_id long, url string, html string, text string")
    assert rows(html_text.extract(pages), "page_id", "url", "text", "n_chars") == [(1, "u", "", 0), (2, None, "Hé", 2)]
    assert html_text.extract(pages.where("false")).count() == 0


def brute_components(some, share=85):
    """Component ids by comparing all pairs of full sets."""
    sets = []
    for _, t in some:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    root = list(range(len(some)))

    def of(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in combinations(range(len(some)), 2):
        if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
            root[max(of(i), of(j))] = min(of(i), of(j))
    least = {}
    for i, (d, _) in enumerate(some):
        if d is not None:
            least[of(i)] = min(d, least.get(of(i), d))
    return [(d, len(sets[i]), least.get(of(i))) for i, (d, _) in enumerate(some)]


def near_copies():
    r = random.Random(5)
    some = list(ODD)
    for family in range(6):
        base = [r.choice(WORDS) for _ in range(120)]
        for k in range(12):
            w = list(base)
            for _ in range(k // 2 + family // 3):
                w[r.randrange(len(w))] = r.choice(WORDS)
            some.append((1000 * (family + 1) + k * 7 % 12, " ".join(w)))
    some += [(9000 + i, text(r.randint(3, 80), r)) for i in range(25)] + [(9500, "a b c d e"), (9501, "A b c D e")]
    return some


@pytest.mark.parametrize("share", [80, 85])
def test_near_duplicates(docs, share):
    some = near_copies()
    got = rows(minhash.near_duplicates(docs(some), share), "doc_id", "n_shingles", "component_id")
    assert got == sorted(brute_components(some, share), key=lambda t: tuple((x is None, x) for x in t))
    assert minhash.near_duplicates(docs([])).count() == 0
    kept = minhash.near_duplicates(docs(some)).where("kept <> (doc_id = component_id)").count()
    assert kept == 0


def test_shape():
    assert minhash.shape(85) == (6, 32) and minhash.shape(80) == (5, 38)
    for share in range(50, 100):
        rows, bands = minhash.shape(share)
        assert rows * bands % 2 == 0 and (1 - (share / 100) ** rows) ** bands <= minhash.MISSED and rows * bands <= minhash.MOST


def test_min_max_estimates():
    """Signatures agree as often as sets do, for minima and maxima."""
    a, b = ([f"w{i}" for i in range(k, k + 4000)] for k in (0, 400))
    s, at = minhash.distinct(*textnp.shingles(textnp.Words([" ".join(a), " ".join(b)])))
    sig = minhash.min_max(s, at, 96)
    assert abs((sig[0] == sig[1]).mean() - 3596 / 4396) < 0.12
    assert minhash.parity_maps(s, at).shape == (2, minhash.MAP)


@pytest.mark.parametrize("seed", range(3))
def test_packing_plan(seed):
    r = random.Random(seed)
    counts = Counter(r.choice([r.randint(1, 60), r.randint(1, 2048), 2048]) for _ in range(3000))
    made = packing.plan(counts)
    bins, seen = Counter(), Counter()
    used = []
    for length, lo, first, per, offset in made.runs:
        seen[length] = max(seen[length], lo)
    for length, c in counts.items():
        keys, lo, first, per, offset = made.arrays()
        for rank in range(c):
            at = int(np.searchsorted(keys, (length << 44) + rank, side="right")) - 1
            step = rank - lo[at]
            used.append((int(first[at] + step // per[at]), int(offset[at] + step % per[at] * length), length))
            bins[used[-1][0]] += length
    used.sort()
    end = {}
    for b, o, n in used:
        assert o == end.get(b, 0)
        end[b] = o + n
    assert max(bins.values()) <= 2048 and len(bins) == made.sequences
    assert len(bins) <= 1.02 * -(-sum(bins.values()) // 2048) + max(0, sum(c for n, c in counts.items() if n > 1024) - -(-sum(bins.values()) // 2048))


def test_packed_documents(docs):
    file = tokenizer_file("word_bpe_49k.json")
    some = ODD + [(200 + i, text(R.randint(0, 300))) for i in range(40)]
    got = packing.pack_documents(docs(some), file, capacity=64)
    coder = tokens.TokenCoder(file, True)
    want = []
    for i, t in some:
        ids = coder.whole([t or ""])[0] + b"\0\0\0\0"
        want += [(i, k // 256, k // 4, len(ids[k : k + 256]) // 4, zlib.crc32(ids[k : k + 256])) for k in range(0, len(ids), 256)]
    names = ("doc_id", "piece", "start", "length", "ids_crc32")
    assert rows(packing.digests(got), *names) == sorted(want, key=lambda t: tuple((x is None, x) for x in t))
    whole = packing.sequences(got).collect()
    assert all(len(r.ids) <= 256 for r in whole) and sum(len(r.ids) for r in whole) == 4 * sum(w[3] for w in want)
    assert packing.pack_documents(docs([]), file).count() == 0


def test_char_model_is_a_distribution():
    m = kneser_ney.CharModel.fit(["ab", "abc", "ba"], np.array([[3.0, 1], [1, 0], [0, 2]]), ["x", "y"], order=3)
    s = m.score(["ab", "ba", "zz"])
    assert s.shape == (3, 2) and (s < 0).all() and s[0, 0] > s[0, 1] and s[1, 1] > s[1, 0]
    letters = ["a", "b", "c", ""]  # all first characters that were seen, and the end of an empty word
    first = 10.0 ** kneser_ney.CharModel.fit(["a", "b", "b"], np.ones((3, 1)), ["x"], order=2).score(letters)
    assert first.sum() < 1


def languages():
    r = random.Random(2)
    stems = {"aa": ["the", "ing", "er", "on"], "bb": ["sch", "ung", "ein", "keit"], "cc": ["ción", "que", "los"]}
    return [(i, " ".join("".join(r.choice(stems[k]) for _ in range(r.randint(1, 3))) for _ in range(60)), k) for i, k in enumerate(["aa", "bb", "cc"] * 40)]


def test_languages(docs):
    some = languages() + [(1000, None, "aa"), (1001, "123 !?", "bb"), (1002, "", None), (None, "thething ering", "aa"), (1003, "漢字 " * 60, None)]
    got = {r.doc_id: r for r in langid.identify(docs(some)).collect()}
    assert all(got[i].lang_pred == k for i, _, k in languages())
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[None].lang_pred == "aa"
    assert got[1003].lang_pred in ("aa", "bb", "cc") and got[1003].rejected and not got[0].rejected
    assert all(0 <= r.score <= 1 for r in got.values())
    assert all(r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    untaught = langid.identify(docs([(1, "some text", None)])).collect()
    assert [(r.lang_pred, r.score, r.rejected) for r in untaught] == [("und", 0.0, True)]
    assert langid.identify(docs([])).count() == 0
    kept = langid.recognised(docs(some))
    assert kept.columns == docs(some).columns and kept.count() == len(languages()) + 1


def test_rejected_languages(docs):
    """Texts of a language that is left out of fitting are rejected; those of the others are not."""
    some = languages()
    given = [(i, t, k if k != "cc" else None) for i, t, k in some]
    got = {r.doc_id: r.rejected for r in langid.identify(docs(given)).collect()}
    assert np.mean([got[i] for i, _, k in some if k == "cc"]) > 0.9
    assert not any(got[i] for i, _, k in some if k != "cc")


def test_toxicity(spark, docs):
    r = random.Random(4)
    bad = ["nasty", "vile", "rotten"]
    some, marks = [], []
    for i in range(400):
        w = [r.choice(WORDS) for _ in range(60)]
        if i % 4 == 0:
            for b in bad:
                w.insert(r.randrange(60), b)
        some.append((i, " ".join(w)))
        marks.append((i, int(i % 4 == 0)))
    some += [(1000, None), (1001, ""), (None, "nasty vile"), (1002, "Nasty, VILE!"), (1003, text(3000) + " vile rotten nasty " + text(3000))]
    labels = spark.createDataFrame([*marks, (1001, None), (None, 1), (0, 1)], "doc_id long, toxic int")
    got = {x.doc_id: x for x in toxicity.toxicity(docs(some), labels).collect()}
    right = [got[i].predicted == y for i, y in marks if got[i].held_out]
    assert np.mean(right) > 0.95
    assert [got[i].predicted for i in (1000, 1001, None, 1002, 1003)] == [0, 0, 1, 1, 1]
    assert all(0 <= x.score <= 1 for x in got.values())
    none = toxicity.toxicity(docs(some[:5]), labels.where("false")).collect()
    assert {(x.score, x.predicted) for x in none} == {(0.0, 0)}
    assert toxicity.ordinary(docs(some), labels).where("doc_id in (1002, 1003)").count() == 0


def pairs_of(texts):
    """Counts of all pairs of (text, class) by brute force, and the words."""
    seen = set()
    for t, k in texts:
        w = [None, *t.split(), None]
        seen.update((w[i - 1], w[i], w[i - 2] if i > 1 else None, w[i + 1], k) for i in range(1, len(w) - 1))
    found = Counter((b, w, k) for b, w, _, _, k in seen)
    names = sorted({(b, w) for b, w, _ in found}, key=str)
    code = {w: textnp.Words([w]).hash[0] for w in {w for _, w in names}}
    hashes = np.array(sorted(code.values()), dtype=np.uint64)
    words = [w for _, w in sorted((h, w) for w, h in code.items())]
    before = np.array([training.BEGIN if b is None else code[b] for b, _ in names], dtype=np.uint64)
    return before, np.array([code[w] for _, w in names], dtype=np.uint64), np.array([[found[b, w, k] for k in (0, 1)] for b, w in names], dtype=np.float32), hashes, words


def test_pair_counts(spark):
    """Counts of surroundings by class: copies of a text count once, and each text's first word has a start mark before it."""
    r = random.Random(5)
    some = [(text(30, r), i % 2) for i in range(60)]
    some += [(some[0][0], 0)] * 3
    sample = spark.createDataFrame([(str(k), t, False) for t, k in some], "class string, text string, held boolean")
    got = training.pair_counts(sample, textnp.NON_LETTER, ["0", "1"])
    before, word, counts, hashes, words = pairs_of(some)
    often = counts.sum(axis=1) > 1
    want = {(b, w, *n) for b, w, n in zip(before[often].tolist(), word[often].tolist(), counts[often].tolist(), strict=True)}
    assert {(b, w, *n) for b, w, n in zip(got.before.tolist(), got.word.tolist(), got.of_pair.tolist(), strict=True)} == want
    for keys, found, of in ((word, got.words, got.of_word), (before, got.contexts, got.of_context)):
        assert found.tolist() == sorted(set(keys.tolist()))
        assert of.tolist() == [[float(sum(counts[keys == x, k])) for k in (0, 1)] for x in found]
    spelt = training.spellings(sample, textnp.NON_LETTER)
    assert spelt[0].tolist() == hashes.tolist() and spelt[1] == words


def test_toxicity_model_against_plain_dictionaries():
    """Each level by its definition, over dictionaries; every level is a distribution."""
    r = random.Random(8)
    some = [(" ".join(["awful words"[: r.choice([5, 11])]] * (k % 3 == 0) + [r.choice(WORDS[:60]) for _ in range(20)] + ["awful"] * (k % 3 == 0)), int(k % 3 == 0)) for k in range(200)]
    before, word, counts, hashes, names = pairs_of(some)
    found = {}

    def spell(columns):
        spelt = np.full((len(hashes) + 1, 2), 1e-300)
        at = np.searchsorted(np.sort(np.append(hashes, training.BEGIN)), hashes)
        columns = columns[at]
        chars = kneser_ney.CharModel.fit(names, columns, ["all", "telling"], 3)
        spelt[at] = 10.0 ** chars.score(names)
        found.update(columns=columns, spelt={w: tuple(x) for w, x in zip(hashes.tolist(), spelt[at])})
        return chars, spelt

    often = counts.sum(axis=1) > 1

    def totals(keys):
        found = np.unique(keys)
        return found, np.array([counts[keys == x].sum(axis=0) for x in found])

    model = toxicity.estimate(training.PairCounts(*totals(word), *totals(before), before[often], word[often], counts[often]), spell)
    pair = {(b, w): tuple(n) for b, w, n in zip(before.tolist(), word.tolist(), counts.tolist(), strict=True)}
    own = {w: [sum(n[k] for (_, x), n in pair.items() if x == w) for k in (0, 1)] for w in hashes.tolist()}
    total = [sum(n[k] for n in own.values()) for k in (0, 1)]
    one = dict(zip(own, np.column_stack([toxicity.specific(np.array([n[k] for n in own.values()]), np.array([sum(n) for n in own.values()]), np.full(len(own), total[k] / sum(total))) for k in (0, 1)]), strict=True))
    left = {w: sum(own[w]) - one[w].sum() for w in own}
    less = dict(zip(left, toxicity.less_discount(np.array(list(left.values()))), strict=True))
    shared = {w: less[w] / sum(left.values()) + (1 - sum(less.values()) / sum(left.values())) * found["spelt"][w][0] for w in own}
    tells = sum(one[w][1] for w in own if 2 * one[w][1] > own[w][1]) / total[1]
    free = [1 - sum(x[k] for x in one.values()) / total[k] for k in (0, 1)]
    base = {w: (shared[w], (1 - tells) * shared[w] + tells * found["spelt"][w][1]) for w in own}
    level = {w: [one[w][k] / total[k] + free[k] * base[w][k] for k in (0, 1)] for w in own}
    assert tells > 0 and {w for w in own if 2 * one[w][1] > own[w][1]} <= {textnp.Words([x]).hash[0] for x in ("awful", "words")}
    context = {b: [sum(n[k] for (x, _), n in pair.items() if x == b) for k in (0, 1)] for b in before.tolist()}
    keys = [k for k, n in pair.items() if sum(n) > 1]
    part = np.array([[context[b][k] * level[w][k] for k in (0, 1)] for b, w in keys])
    part /= part.sum(axis=1, keepdims=True)
    n = np.array([pair[k] for k in keys])
    kept = np.column_stack([toxicity.specific(n[:, k], n.sum(axis=1), part[:, k]) for k in (0, 1)])
    over = n.sum(axis=1) - kept.sum(axis=1)
    after = toxicity.less_discount(over)
    text_of = dict(zip(hashes.tolist(), names, strict=True))

    def ratio(b, w):
        mine = [i for i, (x, _) in enumerate(keys) if x == b]
        both = sum(context[b]) - sum(kept[i].sum() for i in mine)
        second = {keys[i][1]: after[i] / both for i in mine}
        rest = 1 - sum(second.values())
        out = []
        for k in (0, 1):
            def tilted(v, k=k):
                return (second.get(v, 0) + rest * shared[v]) * level[v][k] / shared[v]

            z = sum(second[v] * level[v][k] / shared[v] for v in second) + rest
            keep = {keys[i][1]: kept[i, k] / max(1, context[b][k]) for i in mine}
            out.append(keep.get(w, 0) + (1 - sum(keep.values())) * tilted(w) / z)
        return math.log(out[1] / out[0])

    for t, _ in some[:12]:
        w = textnp.Words([t], textnp.NON_LETTER)
        h = w.hash.tolist()
        want = [ratio(b, x) for b, x in zip([int(training.BEGIN), *h[:-1]], h, strict=True)]
        assert np.allclose(model.each(w), want, atol=1e-5), [text_of[x] for x in h]


def found_of(spark, docs, some):
    """(share of toxic texts found, share of ordinary ones taken) of held-out (text, toxic)."""
    labels = spark.createDataFrame([(i, y) for i, (_, y) in enumerate(some)], "doc_id long, toxic int")
    got = toxicity.toxicity(docs([(i, t) for i, (t, _) in enumerate(some)]), labels).where("held_out").collect()
    return [np.mean([x.predicted for x in got if some[x.doc_id][1] == y]) for y in (1, 0)]


def test_rare_toxic_words(spark, docs):
    """Both classes are as large, and no toxic word has 20 different words before it."""
    r, some = random.Random(5), []
    for i in range(480):
        w = [r.choice(WORDS) for _ in range(60)]
        if i % 2:
            for at in (10, 40):
                w[at] = f"rare{'abcdefghijklmnopqrst'[i // 2 % 20]}"
        some.append((" ".join(w), i % 2))
    hit, wrong = found_of(spark, docs, some)
    assert hit > 0.8 and wrong < 0.1


def test_phrases_and_mild_texts(spark, docs):
    """Toxic texts of ordinary words: in a phrase of them, or in their shares over the whole text."""
    r, some = random.Random(6), []
    for i in range(480):
        w = [r.choice(WORDS) for _ in range(60)]
        for at, word in zip((5, 20, 35, 50), ("plain", "common", "plain", "common"), strict=True):
            w[at] = word
        if i % 2:
            w[5:7] = w[35:37] = ["plain", "common"]
            w[20] = w[50] = R.choice(WORDS)
        some.append((" ".join(w), i % 2))
    hit, wrong = found_of(spark, docs, some)
    assert hit > 0.8 and wrong < 0.1
    many = sorted(set(WORDS))
    mild = [(" ".join(r.choice(many[: len(many) // 2] if i % 2 and r.random() < 0.3 else many) for _ in range(400)), i % 2) for i in range(480)]
    hit, wrong = found_of(spark, docs, mild)
    assert hit > 0.8 and wrong < 0.2


def test_audio(spark, docs, tmp_path):
    some = ODD + [(50, "é" * 32), (51, "a" * 64), (52, text(4000))]
    audio.write_media(docs(some), str(tmp_path / "m"))
    audio.write_features(spark.read.parquet(str(tmp_path / "m")), str(tmp_path / "f"))
    stored = spark.read.parquet(str(tmp_path / "f"))
    got = stored.collect()
    marks = audio.digests(stored).collect()
    assert len(got) == len(some) and Counter((r.doc_id, r.payload_sha256) for r in got) == Counter((r.doc_id, r.payload_sha256) for r in marks)
    feature = {r.payload_sha256: r.feature for r in marks}
    want, payloads = {}, []
    for i, t in some:
        raw = (t or "").encode()
        p = raw + b"\0" * (-len(raw) % 64 if raw else 64)
        payloads.append(p)
        want.setdefault(i, []).append((len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]), len(p) + 44, hashlib.sha256(audio.wav(p)).hexdigest()))
    for r in got:
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32, r.media_bytes, r.media_sha256) in want[r.doc_id]
        table = pa.ipc.open_stream(r.segments).read_all()
        kind = table.schema.field("bands").type
        assert kind.shape == [8, 32] and table.num_rows == int(feature[r.payload_sha256].split("x")[0])
        assert all(a < b for a, b in zip(table["start"].to_pylist(), table["end"].to_pylist()))
        spans, tensors = audio.features(audio.samples(audio.wav(next(p for p in payloads if hashlib.sha256(p).hexdigest() == r.payload_sha256))))
        back = audio.read_stream(r.segments)
        assert np.array_equal(back[0], spans) and np.array_equal(back[1], tensors.astype(np.float16))
    assert len({r.feature for r in marks if r.doc_id in (4, 8)}) == 1
    audio.write_media(docs([]), str(tmp_path / "none"))
    assert audio.digests(audio.described(spark.read.parquet(str(tmp_path / "none")))).count() == 0


def test_audio_parts():
    t = np.arange(16000) / 16000
    tone = np.sin(2 * np.pi * 440 * t).astype(np.float32)
    half = audio.resample(tone)
    assert len(half) == 8000 and np.abs(half[500:7500] - np.sin(2 * np.pi * 440 * (np.arange(8000) * 2 - 0.5) / 16000)[500:7500]).max() < 0.05
    assert len(audio.resample(tone, 3, 2)) == 24000
    bands, energy = audio.log_mel(half, 8000)
    assert bands.shape == (len(energy), 32) and abs(int(bands[20].argmax()) - int(np.argmin(np.abs(700 * (10 ** (np.linspace(0, 2595 * math.log10(1 + 4000 / 700), 34)[1:-1] / 2595) - 1) - 440)))) <= 1
    level = np.array([-60.0] * 20 + [-30] * 3 + [-10] * 5 + [-30] * 3 + [-60] * 20 + [-34] * 4 + [-60] * 20)
    assert audio.segments(level).tolist() == [[20, 31]]


def brute_windows(some, items, size=10):
    def split(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate({c: c + 32 for c in range(65, 91)}))

    out = []
    for d, t in some:
        w, hit, held = split(t), set(), set()
        for item, it in items:
            b = split(it)
            n = min(size, len(b))
            wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if n else set()
            for i in range(len(w) - n + 1) if n else ():
                if tuple(w[i : i + n]) in wins:
                    hit |= set(range(i, i + n))
                    if item is not None:
                        held.add(str(item))
        out.append((d, len(w), len(hit), len(held), hashlib.sha256(",".join(sorted(held)).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination(spark, docs):
    items = [(1, text(40)), (2, text(15)), (10, "rare small item"), (11, "Same same SAME same same same same same same same same"), (12, None), (13, ""), (14, text(40)), (None, "lonely words"), (3, "rare small item")]
    some = list(ODD)
    for k, (_, t) in enumerate(items):
        w = (t or "").split()
        some.append((300 + k, f"{text(30)} {' '.join(w[3:30])}, {text(5)}"))
        some.append((400 + k, (t or "").upper().replace(" ", " - ")))
    some += [(500, "same " * 40), (501, "Über rare-small ITEM9 rare small item"), (502, "éa rare small itemé")]
    names = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    table = spark.createDataFrame(items, "item_id long, text string")
    got = rows(decontam.contamination(docs(some), table), *names)
    assert got == sorted(brute_windows(some, items), key=lambda t: tuple((x is None, x) for x in t))
    assert decontam.contamination(docs([]), table).count() == 0
    assert rows(decontam.contamination(docs(some[:4]), table.where("false")), "n_hit") == [(0,)] * 4


def test_long_windows(spark, docs):
    table = spark.createDataFrame([(1, text(80))], "item_id long, text string")
    with pytest.raises(ValueError):
        decontam.contamination(docs([]), table, size=64)
    whole = table.first().text
    assert rows(decontam.contamination(docs([(1, f"x {whole}"), (2, " ".join(whole.split()[:62]))]), table, size=63), "doc_id", "n_hit") == [(1, 80), (2, 0)]


def test_proximity(spark, docs):
    table = spark.createDataFrame([(1, "alpha beta gamma")], "item_id long, text string")
    some = [(1, "alpha beta gamma"), (2, "alpha x beta gamma"), (3, "alpha x y z beta gamma"), (4, "beta gamma")]
    assert [r[0] for r in rows(decontam.contamination(docs(some), table, slop=1).where("contaminated"), "doc_id")] == [1, 2]


def test_lm_scores(docs):
    some = ODD + [(600 + i, text(R.randint(1, 150))) for i in range(150)]
    got = lm.score(docs(some), top=64, vocabulary=64).collect()
    known = Counter()

    def split(t):
        return [*re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({c: c + 32 for c in range(65, 91)})), "\0"]

    for i, t in some:
        if i is not None and zlib.crc32(str(i).encode()) % 10:
            known.update(split(t))
    total, distinct = sum(known.values()), len(known)
    want = sorted((i is None, i or 0, len(split(t)), sum(known[w] > 0 for w in split(t)), round(sum(math.log10((known[w] + 0.1) / (total + 0.1 * (distinct + 1))) for w in split(t)), 6)) for i, t in some)
    assert sorted((r.doc_id is None, r.doc_id or 0, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == want
    assert {r.train_tokens for r in got} == {total} and all(r.score < 0 and math.isfinite(r.score) for r in got)
    untaught = lm.score(docs([(None, "a b")]), vocabulary=64).collect()
    assert untaught[0].train_tokens == 0 and untaught[0].n_known == 0 and math.isfinite(untaught[0].score)
    assert lm.score(docs([]), vocabulary=64).count() == 0


def test_gru():
    """Shares add up, gradients match differences, training helps, and lanes do not mix."""
    rng = np.random.default_rng(1)
    net = gru.Gru.start(np.full(128, 1 / 128), 8)
    state = rng.standard_normal((1, 8)).astype(np.float32)
    logs = net.log_shares(np.repeat(state, 128, axis=0), np.arange(128))[0]
    assert abs(np.exp(logs).sum() - 1) < 1e-4
    lists = [np.tile([3, 70, 5, 9], 30).astype(np.int64) for _ in range(40)]
    ids, bounds = np.concatenate(lists[:3] + [np.array([1])]), np.array([0, 120, 240, 360, 361])
    before = net.score(ids, bounds)
    one = [net.score(ids[i:j], np.array([0, j - i]))[0] for i, j in zip(bounds[:-1], bounds[1:], strict=True)]
    assert np.allclose(before, one, atol=1e-2)
    assert np.allclose(net.score(ids, bounds, block=7), before, atol=1e-2)
    after = net.train(lists * 8, rate=2e-2, window=8, most=4).score(ids, bounds)
    assert after[0] > 0.5 * before[0]


def plain_score(net, ids):
    """A document's log probability word by word, in plain double precision."""
    p = {k: v.astype(np.float64) for k, v in net.p.items()}
    n, h, total, before = net.hidden, np.zeros(net.hidden), 0.0, None
    for w in ids:
        if before is not None:
            x, a = p["e"][before] @ p["w"] + p["b"], h @ p["u"]
            z, r = (1 / (1 + np.exp(-(x + a)[i * n : (i + 1) * n])) for i in (0, 1))
            h = (1 - z) * np.tanh(x[2 * n :] + r * a[2 * n :]) + z * h
        kind, slot = divmod(int(w), gru.SLOTS)
        for logits, k in ((h @ p["cw"] + p["cb"], kind), (h @ p["ww"][kind] + p["wb"][kind], slot)):
            total += logits[k] - np.log(np.exp(logits).sum())
        before = w
    return total


def test_gru_against_plain_forward_and_differences():
    """Scores of whole documents, and gradients of a window with short lanes and new documents in it."""
    rng = np.random.default_rng(4)
    net = gru.Gru.start(np.full(128, 1 / 128), 5)
    lists = [rng.integers(0, 128, n) for n in (1, 7, 90, 400)]
    bounds = np.cumsum([0, *map(len, lists)])
    assert np.allclose(net.score(np.concatenate(lists), bounds), [plain_score(net, x) for x in lists], rtol=1e-5)
    ids, fresh = rng.integers(0, 128, (6, 3)), np.zeros((6, 3), dtype=bool)
    fresh[0, 0] = fresh[3, 1] = True
    inside = np.arange(6)[:, None] < [6, 5, 2]
    before, h = rng.integers(0, 128, 3), rng.standard_normal((3, 5)).astype(np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    g = net.lost(ids, fresh, inside, before, h)[0]
    for k, v in net.p.items():
        for at in [tuple(rng.integers(0, n) for n in v.shape) for _ in range(4)] + ([(int(before[1]), 2), (int(ids[1, 0]), 1)] if k == "e" else []):
            v[at] += 1e-3
            up = net.lost(ids, fresh, inside, before, h)[2]
            v[at] -= 2e-3
            down = net.lost(ids, fresh, inside, before, h)[2]
            v[at] += 1e-3
            assert abs(-(up - down) / 2e-3 - g[k][at]) < 2e-3 * max(1, abs(g[k][at])), (k, at)


def test_gru_trains_all_words():
    """One document, lanes of unequal lengths, and fewer documents than lanes: every word is trained once."""
    for sizes in ([5000], [3, 2000, 1, 40, 900], [23] * 31):
        net, seen = gru.Gru.start(np.full(64, 1 / 64), 4), []
        plain = net.lost
        net.lost = lambda ids, fresh, inside, before, h: (seen.append((int(inside.sum()), int(fresh[inside].sum()))), plain(ids, fresh, inside, before, h))[1]
        net.train([np.arange(n) % 64 for n in sizes], most=8)
        assert sum(a for a, _ in seen) == sum(sizes) and sum(b for _, b in seen) == len(sizes)


def test_gru_takes_the_rest_of_long_documents_in_long_windows():
    """A long document beside short ones is trained whole, without an update for every few words of its rest."""
    net, seen = gru.Gru.start(np.full(64, 1 / 64), 4), []
    plain = net.lost
    net.lost = lambda ids, fresh, inside, before, h: (seen.append((len(ids), int(inside.sum()))), plain(ids, fresh, inside, before, h))[1]
    net.train([np.arange(n) % 64 for n in [8000] + [200] * 200])
    assert sum(n for _, n in seen) == 48_000 and len(seen) < 100
    assert max(k for k, _ in seen) <= 16 * gru.LONGER and max(n for _, n in seen) <= seen[0][1]


def test_lm_learns_from_all_partitions(docs):
    """A pattern in many small documents is learnt, however few there are in a partition."""
    some = docs([(i, "a b c d e f g h " * 30) for i in range(40)] + [(100 + i, text(50)) for i in range(40)])
    got = [r for r in lm.score(some.repartition(5), vocabulary=64).collect() if r.doc_id < 40 and r.held_out]
    assert got and all(r.score > r.base_score for r in got)


def test_gru_gradients():
    net = gru.Gru.start(np.full(64, 1 / 64), 4)
    ids, states = np.array([5, 9, 60]), np.random.default_rng(2).standard_normal((3, 4)).astype(np.float32)
    g = {k: np.zeros_like(v) for k, v in net.p.items()}
    _, back = net.log_shares(states, ids, g)
    for k, at in (("ww", (0, 1, 9)), ("wb", (0, 60)), ("cw", (0, 0))):
        net.p[k][at] += 1e-2
        up = -net.log_shares(states, ids)[0].sum()
        net.p[k][at] -= 2e-2
        down = -net.log_shares(states, ids)[0].sum()
        net.p[k][at] += 1e-2
        assert abs((up - down) / 2e-2 - g[k][at]) < 2e-3


def test_shards(spark, docs, tmp_path):
    some = ODD + [(700 + i, text(R.randint(0, 100))) for i in range(100)]
    got = sharding.shard(docs(some), 7).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in some)
    last = (-1, -1)
    for r in sorted(got, key=lambda r: (r.shard, r.slot)):
        assert (r.shard, r.slot) in ((last[0], last[1] + 1), (r.shard, 0)) and r.shard >= last[0]
        last = (r.shard, r.slot)
    order = [(r.doc_id is not None, r.doc_id or 0) for r in sorted(got, key=lambda r: (r.shard, r.slot))]
    assert order == sorted(order)
    sizes = Counter()
    for r in got:
        sizes[r.shard] += r.size
    largest = max(r.size for r in got)
    assert all(abs(sizes[k] - sum(sizes.values()) / 7) <= largest for k in range(7))
    even = sharding.shard(docs([(i, "x" * 9) for i in range(160)]), 16).groupBy("shard").count().collect()
    assert {r[1] for r in even} == {10}
    assert sharding.shard(docs([])).count() == 0
    sharding.write_shards(docs(some), str(tmp_path / "s"), 3)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(some)
