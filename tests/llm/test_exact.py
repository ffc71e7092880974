"""Operators against plain Python."""

import codecs
import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from conftest import *  # noqa: F403
from pyspark.sql import functions as F

from docloom.llm import decontaminate, html_extract, langid_ecoc, line_spread, linear, quality_nbsvm, repetition, secret_ledger, simhash_gph, temperature_mix, token_counts

SF = "/root/testdata/sf0.001"


# -- 1 ------------------------------------------------------------------------

PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{}</style><script>var a="</p><article>x</article>";</script></head><body class="c">
<header><h1>Site</h1></header><nav><ul><li><a href=/>menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<div id="main-wrap"><div class="post post-17"><h2>Title &amp; more</h2><p>First <b>bo</b>ld para&shy;graph with enough words to count as prose.<p>Second
 paragraph,<br>broken &lt;b&gt; and   spaced out, long enough to matter here.<ul><li>one<li>two</ul><blockquote>quoted words</blockquote>
<aside>aside</aside><form><p>Sign up</p><input></form></div><div class="sidebar"><p>Very long sidebar text with many many words that must not be taken, as it is not the article at all, whatever.</p></div>
<div class="comments"><p>A reader says something quite long that would otherwise be prose, prose, prose, prose.</p></div></div>
<div class="ad">Buy now</div><footer>&copy; us</footer></body></html>"""
TEXT = "Title & more First bold para­graph with enough words to count as prose. Second paragraph, broken <b> and spaced out, long enough to matter here. one two quoted words"


def test_page_text():
    found = html_extract.blocks(PAGE)
    path, _ = html_extract.best_path(found)
    assert path[-1] == "div.post-post-#"
    assert html_extract.text_of(found, path) == TEXT


@pytest.mark.parametrize(("html", "text"), [(None, ""), ("", ""), ("just  text\nhere", "just text here"), ("<p>a</p><p>b", "a b"), ("a < b & c", "a < b & c"), ("<article><p>x<!-- y --></article", "x"), ("<script>x", ""), ("<div hidden>x</div>", ""), ("<p hidden>x <b>y</b></p><p>z", "z"), ("<p hidden>x<p>z", "z"), ("<p>a <span class=ad>x</span> b</p>c", "a b c"), ("<p>a <span class=ad>x<p>b", "a b"), ("<h2 hidden>x</h2>y", "y")])
def test_odd_pages(html, text):
    found = html_extract.blocks(html)
    path, _ = html_extract.best_path(found)
    assert (html_extract.text_of(found, path) if path is not None else "") == text


@pytest.mark.parametrize(("html", "text"), [("<p>I </3 you> all</p><p>b", "I all b"), ("<p>a</ p>b</p><p>c", "ab c"), ("<p>a</>b<p>c", "ab c"), ("<p>x <é y</p><p>z", "x <é y z"), ("<p><中文> t</p><p>z", "<中文> t z"), ("<p>a</3 b", "a"), ("<p>a</", "a</"), ("<p>a <b", "a")])
def test_signs_that_open_no_tag(html, text):
    found = html_extract.blocks(html)
    assert html_extract.text_of(found, ()) == text


def test_host_consensus(spark):
    body = "<html><body><div class='x'>{}</div><div class='y'>{}</div></body></html>"
    long, short = "<p>" + "many words in the main text of this page " * 4 + "</p>", "<p>short text of the page</p>"
    rows = [(i, f"https://u@h.example:80/{i}", body.format(long, short)) for i in range(5)] + [(9, "http://h.example/9", body.format(short, long)), (10, None, None)]
    got = {r.page_id: r.text for r in html_extract.op1(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}
    assert got[9] == "short text of the page" and got[0].startswith("many words") and got[10] == ""


def site(spark, *bodies, host="h.example"):
    rows = [(i, f"https://{host}/{i}", f"<html><body>{b}</body></html>") for i, b in enumerate(bodies)]
    return {r.page_id: r.text for r in html_extract.op1(spark.createDataFrame(rows, "page_id int, url string, html string")).collect()}


LONG = "<p>" + "many words in the main text of this page " * 4 + "</p>"
SAID = ("many words in the main text of this page " * 4).strip()


def test_names_alone_drop_no_article(spark):
    assert set(site(spark, *[f"<div class='social-science'>{LONG}</div><div class='x1'><p>short {i}</p></div>" for i in range(4)]).values()) == {SAID}
    assert set(site(spark, *[f"<div class='social'>{LONG}</div>"] * 3).values()) == {SAID}
    assert set(site(spark, *[f"<header><p>site name</p></header><article><header><h1>Title</h1></header><div class='entry-header'><h2>Sub</h2></div>{LONG}<footer>by me</footer></article>"] * 3).values()) == {f"Title Sub {SAID}"}
    assert set(site(spark, *[f"<main><h1>Title</h1><section>{LONG}</section></main><section><p>elsewhere</p></section>"] * 3).values()) == {f"Title {SAID}"}


def test_the_vote_decides(spark):
    """A container without any telling name, longer than the text on one page, loses by the votes of the others."""
    body = "<div class='ka'>{}</div><div class='kb'>{}</div>"
    short = "<p>short text of the page</p>"
    rows = [body.format(LONG, short)] * 5 + [body.format(short, LONG * 3)]
    got = site(spark, *rows)
    alone = html_extract.blocks(f"<html><body>{rows[5]}</body></html>")
    assert html_extract.text_of(alone, html_extract.best_path(alone)[0]).startswith("many words") and got[5] == "short text of the page" and got[0] == SAID
    # the same pages, each on a host of its own, go by their own best
    assert site(spark, rows[5])[0].startswith("many words")


def test_furniture_inside_the_text(spark):
    inner = f"<article>{LONG}<div class='ad-banner'><p>buy this</p></div><p class='notice'>mind the gap</p><p>the end</p><ul><li><a href=x>more one</a><li><a href=y>more two</a></ul><section class='readerComments'><p>first!</p></section><form><p>sign up</p></form><button>go</button><span hidden>no</span></article><aside><p>aside</p></aside>"
    assert set(site(spark, *[inner] * 4).values()) == {f"{SAID} the end"}
    # one page is no host: its list of links stays
    assert site(spark, inner)[0] == f"{SAID} the end more one more two"


def test_long_and_broken_pages(spark):
    many = "<div class='a'><p>x y<span class=q>" * 30_000
    got = site(spark, f"<article>{'<p>word one two</p>' * 50_000}</article>", many, "<b" * 50_000 + ">t", "<!--" + LONG, "&lt;" * 100_000)
    assert got[0] == " ".join(["word one two"] * 50_000) and "x y" in got[1] and got[3] == "" and got[4] == "<" * 100_000


# -- 2 ------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_tokens(spark, small, odd_docs, tmp_path, name):
    import public_tokenizers

    path, cache = public_tokenizers.path(name), str(tmp_path / "cache")
    docs = small.select("doc_id", "text").union(odd_docs.select("doc_id", "text")).union(spark.createDataFrame([(-1, "a <|endoftext|>  <|endoftext|> b"), (-2, "x  y\n\n z   w ​ v\t q")], "doc_id long, text string"))
    rows = docs.collect()
    if name.endswith(".model"):
        import sentencepiece

        n = lambda t, s=sentencepiece.SentencePieceProcessor(model_file=path): len(s.encode(t))
    else:
        from tokenizers import Tokenizer

        n = lambda t, s=Tokenizer.from_file(path): len(s.encode(t, add_special_tokens=False).ids)
    want = Counter((r.doc_id, len((r.text or "").encode()), n(r.text or "")) for r in rows)
    for _ in range(2):  # the second call finds all in the cache
        got = token_counts.count_tokens(docs, path, cache)
        assert Counter((r.doc_id, r.n_bytes, r.n_tokens) for r in got.collect()) == want
        stored = spark.read.parquet(cache)
        assert stored.count() == len({r.text or "" for r in rows})
    more = spark.createDataFrame([(1, "a new text"), (2, rows[0].text)], "doc_id long, text string")
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(more, path, cache).collect()} == {1: n("a new text"), 2: n(rows[0].text)}
    assert spark.read.parquet(cache).count() == len({r.text or "" for r in rows}) + 1


# -- 3, 7 ---------------------------------------------------------------------


def test_dual_descent_reaches_the_minimum():
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=(60, 5)), np.where(rng.random(60) > 0.5, 1.0, -1.0)
    w, b = linear.dual_descent([(np.arange(5), r) for r in x], y, 5, c=0.7, epochs=20_000, tol=1e-10)
    loss = lambda w, b: (w @ w + b * b) / 2 + 0.7 * np.maximum(0, 1 - y * (x @ w + b)).sum()
    best = loss(w, b)
    assert all(loss(w + d, b + e) >= best - 1e-6 for d, e in zip(rng.normal(size=(200, 5)) * 0.01, rng.normal(size=200) * 0.01))


def crc_held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_quality_reads_words():
    a, b = "a fine and careful account of the harbour", "b dull and hurried rumour of the harbour"
    assert set(quality_nbsvm.features(a)) != set(quality_nbsvm.features(codecs.encode(a, "rot13"))) and set(quality_nbsvm.features(a)) != set(quality_nbsvm.features(b))


def test_quality_against_brute_force(spark):
    """Words alone tell the classes: scores are those of ratios and a hinge loss worked out in plain Python."""
    rng = random.Random(2)
    good, bad, both = "calm clear sound".split(), "spam junk scam".split(), "the of and in it".split()
    rows = [(i, " ".join(rng.choices(both, k=6) + rng.choices(good if i % 2 else bad, k=2)), i % 2) for i in range(120)] + [(500, "", 1), (501, None, 0)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in quality_nbsvm.op3(docs, labels).collect()}
    fit = sorted(((y, quality_nbsvm.features(t)) for i, t, y in rows if not crc_held(i)), key=lambda r: (r[0], r[1].tobytes()))
    count = [defaultdict(int), defaultdict(int)]
    for y, f in fit:
        for k in f.tolist():
            count[y][k] += 1
    total = [sum(c.values()) + quality_nbsvm.BUCKETS for c in count]
    ratio = lambda k: np.log((count[1][k] + 1) / total[1]) - np.log((count[0][k] + 1) / total[0])
    value = lambda f: {k: ratio(k) / max(1.0, len(f) ** 0.5) for k in f.tolist()}
    x, sign = [value(f) for _, f in fit], [1 if y else -1 for y, _ in fit]
    c = [0.5 * len(fit) / sign.count(s) for s in sign]
    w, bias, alpha = defaultdict(float), 0.0, [0.0] * len(fit)
    order = np.random.default_rng(5)
    for _ in range(12):
        worst = 0
        for i in order.permutation(len(fit)).tolist():
            g = sign[i] * (sum(w[k] * v for k, v in x[i].items()) + bias) - 1
            new = min(max(alpha[i] - g / (sum(v * v for v in x[i].values()) + 1), 0), c[i])
            if new != alpha[i]:
                worst = max(worst, abs(g))
            step, alpha[i] = (new - alpha[i]) * sign[i], new
            for k, v in x[i].items():
                w[k] += step * v
            bias += step
        if worst < 1e-3:
            break
    margin = lambda f: sum(w[k] * v for k, v in value(f).items()) + bias
    a, b = linear.logistic_scale(np.array([margin(f) for _, f in fit]), np.array([y for y, _ in fit]))
    for i, t, y in rows:
        want = 1 / (1 + np.exp(-(max(a, 0) * margin(quality_nbsvm.features(t)) + b)))
        assert abs(got[i].score - want) < 1e-3 and got[i].held_out == crc_held(i) and got[i].predicted == int(got[i].score >= 0.7)
    assert all((got[i].score > 0.5) == bool(y) for i, t, y in rows if t)


def test_language_against_brute_force(spark):
    """Every row is decoded as the model fitted in one place on the same rows decodes it; an equal claim goes to the lesser name."""
    rng = random.Random(4)
    words = {"aa": "haus baum see wasser".split(), "bb": "house tree lake water".split(), "cc": "maison arbre lac eau".split()}
    rows = [(i, " ".join(rng.choices(words[g], k=rng.randrange(1, 12))), g if i % 9 else None) for i, g in enumerate(rng.choices("aa bb cc".split(), k=150))]
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid_ecoc.op7(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    fit = [(t, g) for i, t, g in rows if g and not crc_held(i)]
    model = langid_ecoc.fit([langid_ecoc.letters(t) for t, _ in fit], [g for _, g in fit])
    for i, t, _ in rows:
        f, v = langid_ecoc.features(langid_ecoc.letters(t))
        loss = []
        for k in range(3):
            margins = [sum(float(model.weights[a, j]) * float(b) for a, b in zip(f, v, strict=True)) + float(model.bias[j]) for j in range(model.code.shape[1])]
            loss.append(model.heat * sum(model.trust[k, j] * np.log1p(np.exp(-4 * model.code[k, j] * m)) for j, m in enumerate(margins)))
        p = np.exp(-np.array(loss))
        assert got[i][0] == model.langs[int(np.argmax(p))] and abs(got[i][1] - p.max() / p.sum()) < 1e-3
    tie = spark.createDataFrame([(i, "same text", g) for i, g in enumerate(["xx", "yy"] * 40)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in langid_ecoc.op7(tie).collect()} <= {"xx", "yy"}


def test_quality_on_held_out_rows(spark):
    d = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = quality_nbsvm.op3(docs, labels)
    assert got.count() == docs.count()
    held = got.where("held_out").join(labels, "doc_id").collect()
    assert sum(r.predicted == r.quality for r in held) >= 0.95 * len(held)
    assert all(0 <= r.score <= 1 for r in held)


def test_language_on_held_out_rows(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = langid_ecoc.op7(docs).where("held_out").join(docs, "doc_id").collect()
    assert sum(r.lang_pred == r.lang for r in held) >= 0.97 * len(held)


@pytest.mark.parametrize("text", ["½ ²", "①②③", "Ⅷ Ⅸ", "12 34", "___", "", None, "٣٤", "🎉"])
def test_no_letter_no_language(spark, text):
    docs = spark.createDataFrame([(i, "ein Haus am See" if i % 2 else "a house at the lake", "de" if i % 2 else "en") for i in range(40)] + [(100, text, "en"), (101, "½ Haus", "de")], "doc_id long, text string, lang string")
    got = {r.doc_id: (r.lang_pred, r.score) for r in langid_ecoc.op7(docs).collect()}
    assert got[100] == ("und", 0.0) and got[101][0] == "de"


def test_training_pieces_are_bounded():
    clean = " ".join(f"word{i}" for i in range(5000)).translate(str.maketrans("0123456789", "abcdefghij"))
    for at in (0, 7, 12345, 2**31):
        got = langid_ecoc.piece(clean, 400, at)
        assert 300 < len(got) <= 400 and set(got.split()) <= set(clean.split())
    assert langid_ecoc.piece("x" * 1000, 400, 5) == "x" * 400


@pytest.mark.parametrize("k", [2, 3, 5, 6, 20])
def test_codewords_differ(k):
    code = langid_ecoc.codewords(k)
    assert len({tuple(r) for r in code.tolist()}) == k and (abs(code.sum(0)) < k).all()


# -- 4 ------------------------------------------------------------------------


def test_templates(spark):
    item = "A train leaves Boston at 60 km and meets the slow train after 3 hours on the long northern line."
    bench = spark.createDataFrame([(1, item), (2, None), (3, ""), (4, "too short now")], "item_id long, text string")
    docs = [
        (1, f"Some words before. {item} Some words after."),
        (2, "Before: " + item.replace("60", "75").replace("3 hours", "8 hours").replace("Boston", "Madrid")),
        (3, "A train is a thing that leaves; nobody meets it."),
        (4, None),
        (5, ""),
        (6, item.upper()),
        (None, item),
    ]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    assert {r.doc_id for r in decontaminate.op4(frame, bench).collect()} >= {1, 2, None}
    assert {r.doc_id for r in decontaminate.op4(frame, bench).collect()} <= {1, 2, 6, None}
    assert {r.doc_id for r in decontaminate.decontaminate(frame, bench).collect()} >= {3, 4, 5}


def test_slots_must_agree(spark):
    item = "the sum of 4 red apples and 5 green pears and 4 red plums is what we count today in the old shop"
    scattered = "the sum of 4 red apples and 5 green pears and 9 red plums is what we count today in the old shop"
    frame = spark.createDataFrame([(1, scattered)], "doc_id long, text string")
    found = decontaminate.matches(frame, spark.createDataFrame([(1, item)], "item_id long, text string"), agree=1.0).first()
    assert found.slot_agreement < 1 and not found.contaminated


def test_occurrences_are_judged_apart(spark):
    item = "A train leaves Boston at 60 km and meets the slow train after 3 hours on the long northern line."
    other = item.replace("60", "75").replace("3 hours", "8 hours").replace("Boston", "Madrid")
    third = item.replace("60", "90").replace("3 hours", "4 hours").replace("Boston", "Lisbon")
    far = " and then nothing more of that kind was said for quite a while "
    texts = [item + far + other, other + far + third, other + far + item + far + third, far]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = decontaminate.matches(frame, spark.createDataFrame([(1, item)], "item_id long, text string"))
    assert {(r.doc_id, r.contaminated) for r in found.collect()} == {(0, True), (1, True), (2, True)}


def test_planted_passages(spark, small):
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    norm = lambda t: [w.strip(decontaminate.STRIP).lower() for w in t.split()]
    grams = defaultdict(set)
    for r in bench.collect():
        w = norm(r.text)
        for i in range(len(w) - 7):
            grams[tuple(w[i : i + 8])].add(r.item_id)
    want = {(r.doc_id, k) for r in small.collect() for w in [norm(r.text)] for i in range(len(w) - 7) for k in grams.get(tuple(w[i : i + 8]), ())}
    assert {(r.doc_id, r.item_id) for r in decontaminate.op4(small, bench).collect()} == want


def reworded(rng):
    """A question's parts: words, and slots to fill."""
    names, units = "Boston Madrid Lisbon Berta Oslo Turin Quito Nadia Lagos Perth".split(), "km hours kg miles litres days".split()
    words = [f"{rng.choice('bcdfglmnprst')}{rng.choice('aeiou')}{rng.choice('lmnrst')}{rng.choice('aeiou')}{k}".translate(str.maketrans("0123456789", "abcdefghij")) for k in range(rng.randrange(14, 30))]
    slots = sorted(rng.sample(range(3, len(words)), 3))
    kinds = [rng.choice(["number", "name", "measure"]) for _ in slots]

    def fill():
        out, n = list(words), rng.sample(range(2, 999), len(slots))
        who = rng.sample(names, len(slots))
        for k, (at, kind) in enumerate(zip(slots, kinds, strict=True)):
            out[at] = str(n[k]) if kind == "number" else who[k] if kind == "name" else f"{n[k]} {units[at % len(units)]}"
        return " ".join(out)

    return fill


def test_reparameterised_questions_are_found(spark):
    rng = random.Random(12)
    made = [reworded(rng) for _ in range(150)]
    bench = spark.createDataFrame([(i, f()) for i, f in enumerate(made)], "item_id long, text string")
    noise = lambda: " ".join(rng.choices("the cat went on with a long walk over green hills and came home late at night".split(), k=rng.randrange(5, 60)))
    docs = [(i, f"{noise()}. {f()} {noise()}") for i, f in enumerate(made)] + [(1000 + i, noise() * 3) for i in range(100)]
    found = {(r.doc_id, r.item_id) for r in decontaminate.op4(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    right = {(i, i) for i in range(len(made))}
    assert len(found & right) >= 0.9 * len(right) and not found - right


def test_many_to_one_is_no_restatement(spark):
    item = "Anna sold 3 clips to friends in Madrid and then she sold 5 more clips in Lisbon before the end of the day"
    one = item.replace("Madrid", "Bertha").replace("Lisbon", "Bertha").replace("3", "7").replace("5", "7").replace("Anna", "Bertha")
    frame = spark.createDataFrame([(1, "so " + one), (2, "so " + item.replace("Madrid", "Turin").replace("5", "9"))], "doc_id long, text string")
    assert [r.doc_id for r in decontaminate.op4(frame, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()] == [2]


def plain_matches(text, item, cover=0.3, agree=0.8, verbatim=0.5):
    """The rule said again: windows of words and kinds, shifts grouped, slots paired, for one document and one item."""

    def parts(t):
        _, kind, words = decontaminate.template(t)
        words = [w.strip(decontaminate.STRIP).lower() for w in words]
        return [w if k == 0 else int(k) for w, k in zip(words, kind.tolist(), strict=True)], words

    (iq, iw), (dq, dw) = parts(item), parts(text)
    width = min(decontaminate.WINDOW, len(iq))
    if width < decontaminate.LEAST:
        return False
    good = lambda q, at: sum(isinstance(x, str) for x in q[at : at + width]) >= min(decontaminate.LITERALS, width - 1)
    mine = [at for at in range(len(iq) - width + 1) if good(iq, at)]
    total = len({tuple(iq[at : at + width]) for at in mine})
    hits = sorted((d - i, n, i, d) for n, i in enumerate(mine) for d in range(len(dq) - width + 1) if dq[d : d + width] == iq[i : i + width])
    groups = []
    for h in hits:
        if not groups or h[0] - groups[-1][-1][0] > decontaminate.SLACK:
            groups.append([])
        groups[-1].append(h)
    for g in groups:
        slots = lambda q, w, at: [w[k] for k in range(at, at + width) if not isinstance(q[k], str)]
        pairs = {p for _, _, i, d in g for p in zip(slots(iq, iw, i), slots(dq, dw, d), strict=True)}
        agreed = min(len({a for a, _ in pairs}), len({b for _, b in pairs})) / len(pairs) if pairs else 1
        longest = 0
        for shift in {h[0] for h in g}:
            own = sorted(n for s, n, i, d in g if s == shift and slots(iq, iw, i) == slots(dq, dw, d))
            run = 0
            for k, n in enumerate(own):
                run = run + 1 if k and n == own[k - 1] + 1 else 1
                longest = max(longest, run)
        if len({tuple(iq[i : i + width]) for _, _, i, _ in g}) / total >= cover and agreed >= agree or longest / total >= verbatim:
            return True
    return False


def test_decontamination_against_brute_force(spark, odd_docs):
    rng = random.Random(5)
    made = [reworded(rng) for _ in range(12)]
    items = [f() for f in made] + ["", "too short", "one two 3 four Five"]
    texts = []
    for _ in range(150):
        bits = []
        for _ in range(rng.randrange(1, 4)):
            words = rng.choice(made)().split()
            for _ in range(rng.choice([0, 0, 1, 4])):
                at = rng.randrange(len(words))
                words[at : at + rng.randrange(2)] = [rng.choice(["x", "7", "Oslo", "and"])]
            cut = rng.randrange(len(words)) if rng.random() < 0.4 else 0
            bits.append(" ".join(words[cut:] if rng.random() < 0.5 else words[: len(words) - cut]))
        texts.append(rng.choice([" ", ". ", " and so on and so forth, "]).join(bits))
    rows = list(enumerate(texts)) + [(1000, None), (1001, "")]
    want = {(d, i) for d, t in rows for i, q in enumerate(items) if plain_matches(t or "", q)}
    assert 30 < len(want) < len(rows) * len(items) / 3
    got = decontaminate.op4(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(list(enumerate(items)), "item_id long, text string"))
    assert {(r.doc_id, r.item_id) for r in got.collect()} == want
    assert decontaminate.op4(odd_docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


# -- 5 ------------------------------------------------------------------------

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def base_spans(t):
    s = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(t) if len(m[2]) >= 6]
    s += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
    return sorted(s + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24])


def test_secrets(spark, small, odd_docs, tmp_path):
    random.seed(2)
    bits = ["password", "Secret: ", "token=", "token:abcdefg", "api_key", " = '", "'", "AKIA", "A1B2C3D4E5F6G7H8I9", "deadbeef", "0123456789", " ", "é🎉", "\n", "==", "abc123"]
    made = [(i, "".join(random.choices(bits, k=random.randrange(40)))) for i in range(10_000, 10_300)]
    docs = small.select("doc_id", "text").union(odd_docs.select("doc_id", "text")).union(spark.createDataFrame(made, "doc_id long, text string"))
    want = Counter()
    for r in docs.collect():
        s = base_spans(r.text or "")
        want[r.doc_id, *(sum(k == j for _, k, _ in s) for j in range(3)), hashlib.sha256(",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in s).encode()).hexdigest()] += 1
    got = secret_ledger.op5(docs).collect()
    assert Counter((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in got) == want
    ledger = str(tmp_path / "ledger")
    first = secret_ledger.scan(small.limit(50), ledger).count()
    n = spark.read.parquet(ledger).count()
    assert secret_ledger.scan(small.limit(50), ledger).count() == first == 50 and spark.read.parquet(ledger).count() == n
    secret_ledger.scan(small, ledger, secret_ledger.BASE)  # another rule version scans again
    assert spark.read.parquet(ledger).count() == n + small.select("text").distinct().count()


def test_very_many_secrets_in_one_text(spark):
    text = "é " + "token=abcdef12 x\n" * 100_000
    got = secret_ledger.op5(spark.createDataFrame([(1, text), (2, text), (3, None)], "doc_id long, text string")).collect()
    spans = ",".join(f"assign:{2 + 17 * i}:{2 + 17 * i + 14}" for i in range(100_000))
    want = hashlib.sha256(spans.encode()).hexdigest()
    assert {r.doc_id: (r.n_assign, r.base_sha256) for r in got} == {1: (100_000, want), 2: (100_000, want), 3: (0, hashlib.sha256(b"").hexdigest())}


# -- 6 ------------------------------------------------------------------------


def test_longest_repeats():
    def brute(ids):
        n = len(ids)
        return [max([0, *(next(k for k in itertools.count() if max(i, j) + k >= n or ids[i + k] != ids[j + k]) for j in range(n) if j != i)]) for i in range(n)]

    random.seed(1)
    for _ in range(120):
        docs = [[random.randrange(3) for _ in range(random.randrange(25))] for _ in range(random.randrange(1, 5))]
        ids = np.array([10 * d + x for d, r in enumerate(docs) for x in r], np.int64)
        of = np.array([d for d, r in enumerate(docs) for _ in r], np.int64)
        assert repetition.longest_repeats(ids, of).tolist() == sum(map(brute, docs), [])


def test_long_texts_are_walked(monkeypatch):
    rng = np.random.default_rng(3)
    texts = [np.zeros(5000, np.int64), rng.integers(0, 3, 4000), np.tile(rng.integers(0, 90, 700), 6), np.arange(3000), np.zeros(1, np.int64)]
    for ids in texts:
        doc = np.zeros(len(ids), np.int64)
        want = repetition.longest_repeats(ids, doc)
        monkeypatch.setattr(repetition, "LEVELS", 0)
        assert (repetition.longest_repeats(ids, doc) == want).all()
        monkeypatch.undo()
    # many texts in one block
    doc = np.repeat(np.arange(40), 30)
    ids = rng.integers(0, 3, len(doc)) + 10 * doc
    want = repetition.longest_repeats(ids, doc)
    monkeypatch.setattr(repetition, "LEVELS", 0)
    assert (repetition.longest_repeats(ids, doc) == want).all()


def test_a_text_of_very_many_words():
    import tracemalloc

    text = "same " * 1_000_000 + "end"
    tracemalloc.start()
    found = repetition.measure([text])[0]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found[0] == 1_000_001 and found[4] == 1_000_000 and found[6] == 999_999
    assert most < 220 * found[0]


def test_the_rule_on_four_word_repeats(spark):
    """Repeats of four words only: no five-word window comes twice, but much of the text is covered."""
    phrase = "one two three four"
    text = " ".join(f"{phrase} u{i}" for i in range(10)) + " " + " ".join(f"v{i}" for i in range(5))
    got = repetition.op6(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert got.n_repeat_words == 0 and not got.base_failed and got.n_covered == 40 and not got.kept


def test_repetition(spark, small, odd_docs):
    docs = small.select("doc_id", "text").union(odd_docs.select("doc_id", "text"))
    want = Counter()
    for r in docs.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", r.text or "")
        grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        seen = Counter(grams)
        cover = {j for i, g in enumerate(grams) if seen[g] > 1 for j in range(i, i + 5)}
        lines = [x for x in (r.text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        want[r.doc_id, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", r.text or "")), len(lines) - len(set(lines)), len(cover), len(w) < 10 or 100 * len(cover) > 20 * len(w)] += 1
    got = repetition.op6(docs).collect()
    assert Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert not any(r.kept for r in got if r.base_failed)


# -- 8 ------------------------------------------------------------------------


def test_mixture(spark):
    random.seed(3)
    rows = [(i, "w " * random.randrange(1, 60), random.choices(["a", "b", "c", None], [70, 20, 8, 2])[0]) for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = temperature_mix.mix(docs, block_tokens=500).collect()
    assert sorted(r.doc_id for r in got) == list(range(3000))
    tokens, drawn = Counter(), Counter()
    for r in got:
        tokens[r.source] += r.n_tokens
        drawn[r.source] += r.copies * r.n_tokens
    total, a = sum(tokens.values()), got[0].exponent
    power = {s: (t / total) ** a for s, t in tokens.items()}
    w = {s: p / sum(power.values()) for s, p in power.items()}
    h = -sum(x * np.log(x) for x in w.values())
    repeats = max(w[s] * total / tokens[s] for s in w)
    assert abs(h - 0.95 * np.log(4)) < 1e-6 or abs(repeats - 4) < 1e-6
    assert repeats <= 4 + 1e-9
    for s in w:
        assert -0.5 <= w[s] * total - drawn[s] <= 60.5  # a source stops before it would go over its share, which is a whole number
        assert max(r.copies for r in got if r.source == s) - min(r.copies for r in got if r.source == s) <= 1
    assert Counter(r.doc_id for r in temperature_mix.schedule(temperature_mix.mix(docs, block_tokens=500)).collect()) == Counter({r.doc_id: r.copies for r in got if r.copies})


def test_mixture_by_given_counts(spark):
    rows = [(i, None, f"s{i % 3}", 10 * (1 + i % 3) ** 3) for i in range(300)]
    got = temperature_mix.mix(spark.createDataFrame(rows, "doc_id long, text string, source string, n long"), tokens_col="n", block_tokens=40).collect()
    assert {r.doc_id: r.n_tokens for r in got} == {i: n for i, _, _, n in rows}
    # places in a source's order are one for each document
    assert len({(r.source, r.block, r.place) for r in got}) == 300
    blocks = defaultdict(set)
    for r in got:
        blocks[r.source].add(r.block)
    assert all(min(b) == 1 and max(b) == len(b) for b in blocks.values())


# -- 9 ------------------------------------------------------------------------


def test_lines(spark, odd_docs):
    rows = [(i, f"own line {i} with its words\nShared footer line\nmiddle line number {i} here\n  Shared footer line ", f"site{i % 15}") for i in range(60)]
    rows += [(100 + i, f"another own text of site {i}\nnine sites only\nmore words follow here", f"site{i}") for i in range(9)]
    rows += [(200 + i, "a whole copy\nof a document", f"site{i}") for i in range(12)]
    got = {r.doc_id: r for r in line_spread.op9(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got[5].text == "own line 5 with its words\nmiddle line number 5 here" and (got[5].n_lines, got[5].n_removed) == (4, 2)
    assert got[103].n_removed == 0 and got[205].text == "a whole copy\nof a document"


def test_lines_of_short_texts(spark):
    licence = "a long licence line that is on every site there is and says nothing of the text"
    rows = [(i, f"own {i}\n{licence}", f"site{i}") for i in range(12)] + [(50, licence, "site1"), (51, f"{licence}\n\n{licence}", None)]
    rows += [(200 + i, "a whole copy\nof a document", f"site{i}") for i in range(12)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.row.doc_id: (r.text, r.n_removed) for r in line_spread.remove_boilerplate(docs).collect()}
    assert got == {i: (f"own {i}", 1) for i in range(12)} | {50: ("", 1), 51: ("", 2)} | {200 + i: ("a whole copy\nof a document", 0) for i in range(12)}


def test_lines_against_brute_force(spark, odd_docs):
    rng = random.Random(9)
    pool = [f"line number {i}" if i % 7 else " \t" for i in range(60)]
    texts = ["\n".join(rng.choices(pool, weights=[1 / (1 + i) for i in range(60)], k=rng.randrange(12))) for _ in range(300)]
    rows = [(i, t if i % 50 else None, f"s{rng.randrange(18)}" if i % 31 else None) for i, t in enumerate(texts + texts[:60])]
    rows += [(r.doc_id, r.text, r.source) for r in odd_docs.collect()]
    sites, homes = defaultdict(set), defaultdict(set)
    for _, t, s in rows:
        homes[t].add(s)
        for x in (t or "").split("\n"):
            sites[x.strip(line_spread.BLANK)].add(s)
    want = Counter()
    for i, t, _ in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not x.strip(line_spread.BLANK) or len(sites[x.strip(line_spread.BLANK)]) < 10]
        whole = not "".join(kept).strip(line_spread.BLANK) and len(homes[t]) > 1
        want[i, sum(bool(x.strip(line_spread.BLANK)) for x in lines), 0 if whole else len(lines) - len(kept), t if whole or t is None else "\n".join(kept)] += 1
    got = line_spread.op9(spark.createDataFrame(rows, "doc_id long, text string, source string"))
    assert Counter(tuple(r) for r in got.select("doc_id", "n_lines", "n_removed", "text").collect()) == want


def test_a_text_of_very_many_boilerplate_lines(spark):
    many = "\n".join(f"common {i}" for i in range(60_000))
    rows = [(i, f"{many}\nown {i}", f"s{i}") for i in range(10)] + [(99, many, "s0")]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_spread.op9(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == {i: (60_001, 60_000, f"own {i}") for i in range(10)} | {99: (60_000, 60_000, "")}


# -- 10 -----------------------------------------------------------------------


def plain_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(fps, radius=3):
    up = {f: f for f in fps}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= radius:
            up[find(a)] = find(b)
    return {f: find(f) for f in fps}


def test_simhash(spark, small, odd_docs):
    docs = small.select("doc_id", "text").union(odd_docs.select("doc_id", "text").where("doc_id is not null").withColumn("doc_id", F.col("doc_id") + 1_000_000))
    rows = docs.collect()
    fp = {r.text: plain_fingerprint(r.text) for r in rows}
    root = plain_components(set(fp.values()))
    least = {}
    for r in rows:
        k = root[fp[r.text]]
        least[k] = min(least.get(k, r.doc_id), r.doc_id)
    want = Counter((r.doc_id, f"{fp[r.text]:016x}", least[root[fp[r.text]]]) for r in rows)
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in simhash_gph.op10(docs).collect()) == want
    kept = simhash_gph.keep_one(docs)
    assert Counter(r.doc_id for r in kept.collect()) == Counter(set(least.values())) and kept.columns == docs.columns


def plain_roots(nodes, pairs):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in nodes}


def signed(x):
    return x - (1 << 64) if x >> 63 else x


@pytest.mark.parametrize("plan", [None, [(range(64), 2)], [(range(32), 1), (range(32, 64), 0)], [(range(0, 64, 3), 0), (range(1, 64, 3), 0), (range(2, 64, 3), 1)], [(range(k, 64, 4), 0) for k in range(4)]])
def test_components_by_any_allocation(spark, plan):
    random.seed(6)
    fps = {random.getrandbits(64) for _ in range(40)}
    for f in list(fps):
        for _ in range(3):
            g = f
            for b in random.sample(range(64), random.randrange(1, 6)):
                g ^= 1 << b
            fps.add(g)
    fps = {signed(f) for f in fps}
    want = plain_roots(fps, [(a, b) for a, b in itertools.combinations(fps, 2) if ((a ^ b) & (1 << 64) - 1).bit_count() <= 3])
    frame = spark.createDataFrame([(f,) for f in fps], "fp long")
    got = {r.node: r.root for r in simhash_gph.link(frame, 3, plan and [(list(g), t) for g, t in plan]).collect()}
    assert {f: got.get(f, f) for f in fps} == want


@pytest.mark.parametrize("plan", [[(range(64), 2)], [(range(32), 1), (range(32, 64), 2)], [(range(0, 64, 3), 0), (range(1, 64, 3), 1), (range(2, 64, 3), 1)]])
def test_a_pair_is_met_once(spark, plan):
    """Whatever keys two fingerprints share, they are one pair, and every pair close enough in some partition is one."""
    random.seed(16)
    center = random.getrandbits(64)
    fps = sorted({signed(center ^ sum(1 << b for b in random.sample(range(64), random.randrange(5)))) for _ in range(120)})
    plan = [(list(g), rho) for g, rho in plan]
    nodes = spark.createDataFrame([(f, f, 0, f) for f in fps], "node long, fp long, size int, c long")
    got = Counter((r.a, r.b, r.bits) for r in simhash_gph.open_pairs(nodes, plan, simhash_gph.within_bits(7)).collect())
    differ = lambda a, b, g=range(64): sum((a ^ b) >> k & 1 for k in g)
    want = {(a, b, differ(a, b)) for a, b in itertools.combinations(fps, 2) if differ(a, b) <= 7 and any(differ(a, b, g) <= 2 * rho for g, rho in plan)}
    assert set(got) == want and set(got.values()) == {1}


def test_the_plan_covers_the_radius():
    rng = np.random.default_rng(0)
    for radius in (0, 3, 11):
        for n in (1, 1000, 10**7):
            both = rng.random((64, 64)) * n / 2
            plan = simhash_gph.allocate(n, (both + both.T) / 2, radius)
            assert sum(2 * rho + 1 for _, rho in plan) > radius and len({b for g, _ in plan for b in g}) == sum(len(g) for g, _ in plan)


def test_a_ball_of_many_fingerprints(spark):
    """5,000 fingerprints within 3 bits of one: few links, one component."""
    center = 0x123456789ABCDEF0
    ball = [center] + [center ^ sum(1 << b for b in c) for k in (1, 2, 3) for c in itertools.combinations(range(64), k)][:4999]
    frame = spark.createDataFrame([(signed(f),) for f in ball] + [(signed(center ^ (1 << 64) - 1),)], "fp long")
    plan = simhash_gph.allocate(*simhash_gph.bit_counts(frame), 3)
    own = frame.select(F.col("fp").alias("node"), "fp", F.lit(0).alias("size"), F.col("fp").alias("c"))
    assert simhash_gph.star_pairs(own, plan, simhash_gph.within_bits(3), 0).count() <= len(ball)
    got = {r.node: r.root for r in simhash_gph.link(frame, 3).collect()}
    assert {got.get(signed(f), signed(f)) for f in ball} == {min(map(signed, ball))}


def test_components(spark):
    random.seed(8)
    edges = [(random.randrange(300), random.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(120)]
    up = {x: x for e in edges for x in e}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    got = {r.node: r.root for r in simhash_gph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got.get(x, x) == find(x) for x in up)


def test_near_copies_of_the_stage(spark):
    random.seed(11)
    made = []
    for k in range(40):
        base = [f"w{random.randrange(2000)}" for _ in range(random.choice([4, 30, 120, 300]))]
        made.append(base)
        for _ in range(3):  # from nearly the same to quite different
            near = list(base)
            for i in random.sample(range(len(near)), min(len(near), random.choice([1, 2, 3, 8]))):
                near[i] = f"x{random.randrange(2000)}"
            made.append(near)
    made += [["same"] * 50 + ["end"], ["same"] * 50 + ["other", "end"], []]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(made)], "doc_id long, text string")
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set() for w in made]
    up = list(range(len(made)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    n = 0
    for a, b in itertools.combinations(range(len(made)), 2):
        if sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            a, b = sorted((find(a), find(b)))
            up[b] = a
            n += 1
    assert n > 20  # pairs, most of them beyond three bits
    got = {r.doc_id for r in simhash_gph.keep_one_similar(docs, radius=20, spread=6).collect()}
    assert got == {i for i in range(len(made)) if find(i) == i}  # radius wide enough for every pair
    assert len({r.doc_id for r in simhash_gph.keep_one_similar(docs).collect()} - got) <= 0.05 * n  # recall of the default
