"""Models, extraction and mixing against plain versions and held-out rows."""

import hashlib
import random
import re
import time
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from boxlake.llm import decontaminate, html, language, mixing, pii, quality, toxicity
from tests.llm.helpers import awkward, documents, labels, rows
from tests.llm.test_dedup import edited


# ------------------------------------------------------------------ toxicity

def prose(rnd, n, words="the and of tree river walks green stone house open light water".split()):
    return [rnd.choice(words) + rnd.choice(["", "s", "ed"]) for _ in range(n)]


def test_toxicity_separates_held_out_documents(spark):
    rnd = random.Random(2)
    texts, marks = [], []
    for i in range(600):
        words = prose(rnd, rnd.randrange(20, 120))
        toxic = int(i % 4 == 0)
        for _ in range(3 * toxic):
            words[rnd.randrange(len(words))] = rnd.choice(["vilescum", "grubber", "nastyish"])
        texts.append(" ".join(words))
        marks.append((i, 1, toxic))
    got = toxicity.score_documents(documents(spark, texts), labels(spark, marks))
    held = [(d, p) for d, h, p in rows(got, "doc_id", "held_out", "predicted") if h]
    assert sum(p == marks[d][2] for d, p in held) >= 0.97 * len(held)
    kept = toxicity.drop_toxic(documents(spark, texts).withColumn("toxicity_score", F.lit(7)), labels(spark, marks))
    assert kept.columns == ["doc_id", "text", "toxicity_score"] and 400 < kept.count() < 480


def test_toxicity_stands_awkward_rows(spark):
    table = awkward(spark)
    for marks in ([(1, 1, 0), (5, 1, 1), (None, 1, 1), (6, 1, None)], []):
        out = toxicity.score_documents(table, labels(spark, marks))
        assert out.count() == table.count()
        assert all(0 <= s <= 1 for (s,) in rows(out, "score"))
    assert toxicity.score_documents(table.limit(0), labels(spark, [])).count() == 0


def plain_ratios(counts, words):
    """Character evidence of words by plain dictionaries, every gram by itself."""
    n, tables = toxicity.ORDER, {}
    top = {}
    for word, pair in counts.items():
        padded = toxicity.PAD * (n - 1) + word + toxicity.END
        for i in range(len(word) + 1):
            old = top.setdefault(padded[i : i + n], [0, 0])
            old[0], old[1] = old[0] + pair[0], old[1] + pair[1]
    tables[n] = top
    for k in range(n - 1, 0, -1):
        tables[k] = {}
        for gram, pair in tables[k + 1].items():
            old = tables[k].setdefault(gram[1:], [0, 0])
            for c in (0, 1):
                old[c] += pair[c] > 0 if k >= toxicity.OWN else 1
    before = {k: {} for k in tables}
    for k, table in tables.items():
        for gram, pair in table.items():
            old = before[k].setdefault(gram[:-1], [0, 0, 0, 0])
            for c in (0, 1):
                old[c] += pair[c]
                old[2 + c] += pair[c] > 0

    def p(gram, c):
        out = 1 / toxicity.ALPHABET
        for k in range(1, n + 1):
            total, types = before[k].get(gram[-k:][:-1], [0] * 4)[c::2]
            if total:
                count = tables[k].get(gram[-k:], [0, 0])[c]
                out = min(1.0, max(count - toxicity.DISCOUNT, 0) / total + toxicity.DISCOUNT * types / total * out)
        return out

    for word in words:
        padded = toxicity.PAD * (n - 1) + word + toxicity.END
        grams = [padded[i : i + n] for i in range(len(word) + 1)]
        yield word, sum(np.log(p(g, 0) + 1e-12) - np.log(p(g, 1) + 1e-12) for g in grams) / len(grams) ** 0.5


def test_toxicity_keeps_each_gram_and_word_apart(spark):
    rnd = random.Random(9)
    words = ["".join(chr(rnd.randrange(0x4E00, 0x4F00)) for _ in range(rnd.randrange(2, 14))) for _ in range(30_000)]
    texts = [(" ".join(words[i : i + 300]), int(i % 900 == 0)) for i in range(0, len(words), 300)] * 5
    counts = {}
    for text, toxic in texts:
        for word in set(text.split()):
            counts.setdefault(word, [0, 0])[1 - toxic] += 1
    asked = words[:300] + [w[1:] + "x" for w in words[:300]]
    vocabulary = spark.createDataFrame([(w,) for w in set(asked)], "word string")
    got = toxicity.word_evidence(vocabulary, spark.createDataFrame(texts, "text string, toxic int"))
    got = {w: (whole, parts) for w, whole, parts in rows(got, "word", "whole", "parts")}
    assert all(abs(got[w][1] - want) < 1e-6 for w, want in plain_ratios(counts, set(asked)))
    assert all((got[w][0] > 0) == (counts.get(w, [0, 0])[0] > 3) for w in got if counts.get(w, [0, 1])[1] == 0)


# ------------------------------------------------------------------ language

def test_language_of_held_out_documents(spark):
    rnd = random.Random(6)
    kinds = {"xx": "ingthe andow rean ofth".split(), "yy": "schei ungde rüber ächt".split(), "zz": "élle oueau tré çan".split()}
    data = [(i, " ".join(rnd.choice(kinds[k]) for _ in range(rnd.randrange(3, 40))), k) for i in range(240) for k in [rnd.choice(list(kinds))]]
    out = rows(language.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")), "doc_id", "held_out", "lang_pred", "score")
    assert all(p == data[d][2] for d, h, p, _ in out if h) and any(h for _, h, _, _ in out)
    assert all(0 <= s <= 1 for *_, s in out)


def test_language_learns_rare_languages(spark, monkeypatch):
    monkeypatch.setattr(language, "SAMPLE_ROWS", 100)
    rnd = random.Random(7)
    kinds = {"xx": "ingthe andow rean ofth".split(), "yy": "schei ungde rüber ächt".split(), "zz": "давно вчера тогда".split()}
    data = []
    for i in range(3000):
        k = "zz" if i % 150 == 0 else "xy"[i % 2] * 2
        data.append((i, " ".join(rnd.choice(kinds[k]) for _ in range(20)), k))
    out = rows(language.identify(spark.createDataFrame(data, "doc_id long, text string, lang string")), "doc_id", "lang_pred")
    assert all(p == data[d][2] for d, p in out)


def test_language_stands_awkward_rows(spark):
    table = awkward(spark)
    out = {r.doc_id: r for r in language.identify(table).collect()}
    assert len(out) == 8 and out[2].lang_pred == out[3].lang_pred == "und" and out[2].score == 0
    empty = language.identify(table.withColumn("lang", F.lit(None).cast("string")))
    assert {r.lang_pred for r in empty.collect()} == {"und"}
    assert language.identify(table.limit(0)).count() == 0


def test_temperature_softens_wrong_certainty():
    logits, y = np.array([[9.0, 0.0]] * 10), np.array([0] * 6 + [1] * 4)
    assert language.temperature(logits, y) > 5


# ------------------------------------------------------------------ quality

def test_statistics_and_learned_list(spark):
    rnd = random.Random(3)
    texts, marks = [], []
    for i in range(400):
        words = prose(rnd, rnd.randrange(12, 60), [f"w{k}" for k in range(900)])
        low = i % 5 == 0
        texts.append((" | " if low else " ").join(words) + rnd.choice(["", "\nline\nline\n \n"]))
        marks.append((i, int(not low), 0))
    texts[7] = "a b c d e f a b c d e f g a b c d e " * 3
    out = quality.judge(documents(spark, texts), labels(spark, marks))
    right = 0
    for d, n, chars, symbols, dup, again, failed, kept in rows(out, "doc_id", *quality.COUNTS, "base_failed", "kept"):
        w = re.findall(r"[^\x20\x09-\x0D]+", texts[d])
        places = defaultdict(list)
        for i in range(len(w) - 4):
            places[tuple(w[i : i + 5])].append(i)
        inside = {i + k for at in places.values() if len(at) > 1 for i in at for k in range(5)}
        held = [x for x in texts[d].split("\n") if x.strip()]
        want = (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", texts[d])), len(held) - len(set(held)), len(inside))
        assert (n, chars, symbols, dup, again) == want
        assert failed == (n < 10 or 100 * again > 20 * n)
        right += kept == (not failed and d % 5 != 0)
    assert right >= 0.95 * len(texts)


def test_quality_stands_awkward_rows(spark):
    table = awkward(spark)
    out = quality.judge(table, labels(spark, [(1, 0, 0), (None, 1, 1), (6, None, 0)]))
    assert out.count() == table.count()
    assert {k for (k,) in rows(out.filter("n_words = 0"), "kept")} == {False}
    assert quality.judge(table.limit(0), labels(spark, [])).count() == 0


# ------------------------------------------------------------------ benchmark

def semi_global(p, t):
    row = [0] * (len(t) + 1)
    for i, c in enumerate(p, 1):
        new = [i]
        for j, x in enumerate(t, 1):
            new.append(min(row[j - 1] + (c != x), row[j] + 1, new[-1] + 1))
        row = new
    return min(row)


def test_leaks_match_full_alignment(spark):
    rnd = random.Random(3)
    syllables = "the ing ea th or an tion re er".split()

    def text(n):
        return " ".join("".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 4))) for _ in range(n))

    items = [(i, text(rnd.randrange(3, 30))) for i in range(20)] + [(90, "Zq"), (91, None), (92, "")]
    texts = []
    for _ in range(50):
        host, (_, passage) = text(rnd.randrange(5, 40)), rnd.choice(items[:20])
        at = rnd.randrange(len(host))
        texts.append(host[:at] + edited(rnd, passage, rnd.randrange(int(len(passage) * 0.14) + 1), "abcdefgh") + host[at:])
    texts += [None, "", "a ZQ b"]
    table = spark.createDataFrame(items, "item_id long, text string")
    for block in (4_000_000, 600):
        got = dict(rows(decontaminate.add_leaks(documents(spark, texts), table, block_chars=block), "doc_id", "items"))
        for d, t in enumerate(texts):
            t = decontaminate.normal(t)
            want = []
            for i, p in items:
                p = decontaminate.normal(p)
                if p and (p in t if len(p) < decontaminate.Q else semi_global(p, t) <= decontaminate.budget(len(p))):
                    want.append(i)
            assert got[d] == want


def test_decontamination_stands_awkward_rows(spark):
    table = awkward(spark)
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.drop_contaminated(table, none).count() == table.count()
    one = spark.createDataFrame([(1, "some words in it")], "item_id long, text string")
    out = decontaminate.drop_contaminated(table, one)
    assert out.columns == table.columns and out.count() == table.count() - 1
    assert decontaminate.add_leaks(table.limit(0), one).count() == 0


# ------------------------------------------------------------------ mixing

def plain_targets(sizes, weights, most):
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    target, open_ = {}, set(sizes)
    left = sum(sizes.values())
    while open_:
        total = sum(w[s] for s in open_)
        over = {s for s in open_ if left * w[s] / total > most * sizes[s]}
        if not over:
            return target | {s: left * w[s] / total for s in open_}
        for s in over:
            target[s] = most * sizes[s]
        left -= sum(most * sizes[s] for s in over)
        open_ -= over
    return target


@pytest.mark.parametrize("seed", range(3))
def test_targets_and_taken_words(spark, seed):
    rnd = random.Random(seed)
    data = []
    for i in range(600):
        source = rnd.choice(["a", "b", "c", "é", None]) if i else "tiny"
        data.append((i, " ".join(["w"] * rnd.randrange(0, 40)), source))
    docs = spark.createDataFrame(data, "doc_id long, text string, source string")
    out = mixing.mix_by_source(docs).collect()
    sizes, taken, target = defaultdict(int), defaultdict(int), {}
    for r in out:
        assert r["size"] == len((data[r.doc_id][1]).split()) and r.taken in [k * r["size"] for k in range(4)]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
        target[r.source] = r.target
    assert len(out) == len(data)
    for s, want in plain_targets(dict(sizes), (1, 2, 3), 3).items():
        assert target[s] == pytest.approx(want)
        assert abs(taken[s] - want) <= 10
    again = mixing.mix_by_source(docs.repartition(5)).collect()
    assert sorted(again, key=str) == sorted(out, key=str)


def test_overlapping_sources_prefer_fresh_words(spark):
    data = [(i, "w " * (1 + i % 7), ["a"] if i % 3 == 0 else ["a", "b"] if i % 3 == 1 else ["b", "c"]) for i in range(600)]
    docs = spark.createDataFrame(data, "doc_id long, text string, m array<string>")
    out = mixing.mix_sources(docs, F.col("m"), weights=(1.0, 1.0, 1.0)).collect()
    size, taken = defaultdict(int), defaultdict(int)
    for r in out:
        size[tuple(r.sources)] += r["size"]
        taken[tuple(r.sources)] += r.taken
    assert all(abs(taken[k] - size[k]) <= 10 for k in size)  # every word once is possible, so nothing repeats


def test_flow_takes_the_cheapest_way():
    edges = [(0, 2, 5, 1), (0, 3, 5, 4), (2, 1, 9, 0), (3, 1, 2, 0)]
    assert mixing.min_cost_flow(4, edges, 0, 1) == [5, 2, 5, 2]


def test_mixing_stands_awkward_rows(spark):
    table = awkward(spark)
    out = mixing.mix_by_source(table)
    assert out.count() == table.count()
    assert all(t == 0 for s, t in rows(out, "size", "taken") if s == 0)
    assert mixing.mix_by_source(table.limit(0)).count() == 0


# ------------------------------------------------------------------ pages

PAGE = """<html><body class="has-sidebar"><header><h1>Site</h1><p>A slogan that is long enough to be text</p></header>
<nav><a href=x>Home</a></nav><div id="cookie-notice">We use cookies and this is a long text about them.</div>
<div class="content"><div class="breadcrumbs">a &gt; b</div><h2>Title &amp; more</h2>
<p>First paragraph with <a href=q>link</a> text, long enough to count as text for the method.
<p>Second one.&nbsp; &lt;b&gt; y</p><ul><li>one<li>two</ul><p>A last and long paragraph with text that goes on and on.</p>
<form>Name <input> <button>Go</button></form><div class=ad>Buy now buy now buy now</div></div>
<aside>Side text side text side text side text side text</aside>
<section id="comments"><p>Great post! I liked it a lot, thanks for sharing it with all of us here.</p></section>
<footer>&copy; x</footer><script>if (a<b) { document.write("</p>") }</script><!-- <p>x</p> --></body></html>"""


def test_main_text_of_a_page():
    assert html.main_text(PAGE).split("\n") == [
        "Title & more",
        "First paragraph with link text, long enough to count as text for the method.",
        "Second one. <b> y",
        "one",
        "two",
        "A last and long paragraph with text that goes on and on.",
    ]


@pytest.mark.parametrize(
    "page, text", [(None, ""), ("", ""), ("<p>", ""), ("just text", "just text"), ("<p>a < b & c</p><div", "a < b & c")]
)
def test_main_text_of_odd_pages(page, text):
    assert html.main_text(page) == text


UNEVEN = "<section><h2>One</h2><p>{}</p></section><section><h2>Two</h2>" + "<p>{}</p>" * 3 + "</section>"


@pytest.mark.parametrize("holder", ["article", "main", "div"])
def test_main_text_keeps_sections_far_shorter_than_the_longest(holder):
    texts = ["long " * 6_000, *["short " * 30] * 3]
    page = f"<body><nav>Menu and links</nav><{holder}>{UNEVEN.format(*texts)}</{holder}><footer>Foot</footer></body>"
    assert html.main_text(page).split("\n") == ["One", texts[0].strip(), "Two", *[t.strip() for t in texts[1:]]]


BODY = "<p>" + "A paragraph of the article that is long enough. " * 3 + "</p><p>Its second paragraph is shorter.</p>"
PLAIN = ("A paragraph of the article that is long enough. " * 3).strip() + "\nIts second paragraph is shorter."


@pytest.mark.parametrize(
    "page, extra",
    [
        (f'<article>{BODY}<section id="social-history"><p>The social history.</p></section></article>', "The social history."),
        (f'<article>{BODY}<p id="form-of-government">A republic.</p></article>', "A republic."),
        (f'<article>{BODY}<h2 id="related-work">Related work</h2></article>', "Related work"),
        (f'<article>{BODY}<p class="notice-period">A month.</p></article>', "A month."),
        (f'<div class="page-with-sidebar">{BODY}</div>', ""),
        (f'<div class="no-sidebar widget-area">{BODY}</div>', ""),
        (f'<div class="content hidden-xs">{BODY}</div>', ""),
        (f'<form action="/"><nav>Menu</nav><div class="content">{BODY}</div></form>', ""),
        (f'<body><a name="top">{BODY}</body>', ""),
        (f'<article><a href="/x">{BODY}</a></article>', ""),
        (f'<article>{BODY}<div class="related-posts"><p>Other things to read</p></div></article>', ""),
        (f'<article>{BODY}</article><div class="comment-list"><h1>Words</h1>{"<p>A long comment of a reader</p>" * 90}</div>', ""),
        (f'<form><form class="form">{BODY}</form></form><div id="sidebar">Things beside</div>', ""),
    ],
)
def test_main_text_keeps_the_article(page, extra):
    assert html.main_text(page) == PLAIN + ("\n" + extra if extra else "")


def test_extraction_stands_awkward_rows(spark):
    data = [(1, "u", PAGE, 1), (1, "u", PAGE, 1), (2, None, None, 2), (None, "v", "<p>" + "long text " * 20_000, 3)]
    table = spark.createDataFrame(data, "page_id long, url string, html string, text int")
    out = html.extract(table)
    assert out.columns == ["page_id", "url", "text", "n_chars"] and out.count() == 4
    assert all(n == len(t) for t, n in rows(out, "text", "n_chars"))
    assert html.extract(table.limit(0)).count() == 0


# ------------------------------------------------------------------ personal data

def plain_spans(t):
    def digits(s):
        return re.sub("[^0-9]", "", s)

    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    found = re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t)
    out += [("ip", m.start(), m.end()) for m in found if all(int(x) <= 255 for x in m[0].split("."))]
    found = re.finditer(r"[0-9]([\x20-]?[0-9])+", t)
    out += [("card", m.start(), m.end()) for m in found if 16 <= len(digits(m[0])) <= 19 and pii.luhn(digits(m[0]))]
    found = re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t)
    return out + [("phone", m.start(), m.end()) for m in found if 8 <= len(digits(m[0])) <= 15]


def test_base_spans_match_the_patterns():
    rnd = random.Random(1)
    for _ in range(4000):
        text = "".join(rnd.choice("a1@.-+ %()_é9") for _ in range(rnd.randrange(60)))
        assert pii.base_spans(text) == plain_spans(text)
    for n in range(300):
        text = f"x 4{n:03d}-1111 {rnd.randrange(10**8)} 42 +49 (30) {rnd.randrange(10**7)}. {n}.1.2.3.4 a.b@c.de"
        assert pii.base_spans(text) == plain_spans(text)


def test_base_spans_of_long_runs():
    began = time.monotonic()
    for text in ["9" * 5000 + ".1.2.3", "9" * 1_000_000, "1." * 300_000, "+" + "1(" * 300_000, "a" * 500_000 + "@", "@a" * 300_000, "12 " * 300_000]:
        pii.base_spans(text)
    assert time.monotonic() - began < 20
    text = "9" * 5000 + ".1.2.3"
    assert pii.base_spans(text) == []
    zeros = "0" * 5000 + "255.1.2.3"
    assert pii.base_spans(zeros) == [("ip", 0, len(zeros))]
    assert pii.base_spans("256.1.2.3.4") == []  # no retry within a failed match
    for a, b in [(0, 10), (3, 3 + pii.PIECE), (3, 5 + pii.PIECE), (7, 9 + 5 * pii.PIECE + pii.OVERLAP)]:
        parts = pii.pieces(a, b)
        assert [p[0] for p in parts] == [a, *[p[2] for p in parts[:-1]]] and parts[-1][1:] == (b, b)
    base = [("email", 5, 9), ("phone", 7, 12), ("ip", 20, 30)]
    added = [("card", 0, 5), ("card", 10, 14), ("card", 12, 20), ("card", 29, 40), ("card", 30, 41)]
    kept = [s for s in pii.all_spans("", base, added) if s[0] == "card"]
    assert kept == [("card", 0, 5), ("card", 12, 20), ("card", 30, 41)]


def test_gradients_of_the_network():
    rng = np.random.RandomState(0)
    x, y = rng.randint(0, pii.CHARS, (3, 7)), rng.randint(0, pii.TAGS, (3, 7))

    def loss(p):
        e, _ = pii.emissions(p, x)
        z, _, _ = pii.marginals(e, p["t"])
        gold = e[np.arange(3)[:, None], np.arange(7)[None], y].sum(1) + p["t"][y[:, :-1], y[:, 1:]].sum(1)
        return float((z - gold).mean())

    before = loss(pii.initial())
    after = loss({k: v.astype(float) for k, v in pii.train(x, y, epochs=60, batch=3).items()})
    assert after < before / 10


def test_model_finds_held_out_spans():
    rnd = random.Random(5)

    def sample():
        words = prose(rnd, 8) + [f"{rnd.choice('abcd')}x{rnd.randrange(99)}@mail{rnd.randrange(9)}.org"] + prose(rnd, 8)
        return " ".join(words)

    texts = [sample() for _ in range(120)]
    xs = np.concatenate([pii._rows(pii.char_classes(t[a:b]), 0) for t in texts[:100] for a, b in pii.regions(t)])
    ys = np.concatenate([pii._rows(pii.tags_of(pii.base_spans(t), a, b), 0) for t in texts[:100] for a, b in pii.regions(t)])
    model = pii.train(xs, ys, epochs=30, batch=10)
    found = pii.model_spans(texts[100:], model)
    right = sum(s == pii.base_spans(t) for s, t in zip(found, texts[100:]))
    assert right >= 14
    assert pii.model_spans(["no such thing here", ""], model) == [[], []]


def test_personal_data_stands_awkward_rows(spark):
    table = awkward(spark).unionByName(
        awkward(spark).limit(1).withColumn("text", F.lit("mail me at a@b.cd or +1 (543) 555-1435"))
    )
    out = pii.find(table)
    assert out.count() == table.count()
    assert {(e, p) for e, p in rows(out.filter("n_email > 0"), "n_email", "n_phone")} == {(1, 1)}
    assert all(b == hashlib.sha256(b"").hexdigest() for (b,) in rows(out.filter("doc_id in (2, 3, 4)"), "base_sha256"))
    assert pii.find(table.limit(0)).count() == 0


def test_toxicity_blocks_ask_only_for_words_with_evidence(spark):
    """What a block asks for follows the known words, not its own vocabulary."""
    known = spark.createDataFrame([("wort",), ("straße",)], "word string")
    told = toxicity._word_filter(known)
    words = [f"w{i}" for i in range(20_000)] + ["straße", "wort"]
    asked = toxicity._asked_of(words, told)
    assert {"wort", "straße"} <= set(asked) and len(asked) < 20
    known = spark.createDataFrame([(w,) for w in words], "word string")
    assert toxicity._asked_of(words, toxicity._word_filter(known)) == words


def test_toxicity_counts_words_of_marked_rows(spark):
    texts = [f"common w{i % 9} own{i}" for i in range(60)] + [None, ""]
    docs = documents(spark, texts).selectExpr("doc_id", "doc_id as h", "text")
    marks = {i: i % 2 for i in range(60) if zlib.crc32(str(i).encode()) % 3 != 1 and zlib.crc32(str(i).encode()) % 7}
    blocks = toxicity.text_blocks(docs)
    labelled = toxicity.marked_rows(blocks, labels(spark, [(i, 1, t) for i, t in marks.items()]))
    got = {w: (t, o) for w, t, o in rows(toxicity.block_word_counts(blocks, labelled), "word", "t", "o")}
    want = {}
    for i, toxic in marks.items():
        for w in texts[i].split():
            t, o = want.get(w, (0, 0))
            want[w] = (t + toxic, o + 1 - toxic)
    assert got == want
