"""HTML extraction, token counts and toxicity."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from specweave.llm import html, tokens, toxicity


def _rows(df):
    return [r.asDict() for r in df.collect()]


# --- html

PAGE = """<!doctype html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p><article>no</article>";</script></head>
<body><header><h2>Site</h2></header><nav><ul><li><a href=/>Home</a></ul></nav><div class="cookie-notice">We use cookies</div><!-- <p>hidden</p> -->
<div class="ad">{ad}</div><article><header><h1>{title}</h1></header>{body}<p>Follow our channel for more</p><aside>Side</aside><form><p>Your mail</p><input name=a></form></article>
<section id="comments"><article class="comment"><p>First!</p></article></section><aside>Related</aside><footer>&copy; {ad}</footer></body></html>"""


def _page(i, body=None):
    return PAGE.format(ad=f"buy {i}", title=f"Title {i}", body=body or f"<p>Paragraph <b>number</b>\n {i} &lt;ok&gt;&nbsp;yes<br>more<p>Second {i} has a few more words than the others do, so that it weighs more")


def test_article_text_by_rules():
    text = html.extract(_page(1))
    assert text == "Title 1\nParagraph number 1 <ok> yes more\nSecond 1 has a few more words than the others do, so that it weighs more\nFollow our channel for more"


PLAIN = """<body><div><div>The shop of tools</div><div><p>{legal}</div><div><h1>Story {i}</h1><p>{text}<p>{more}</div><div><p>Written by the team {legal}</div></div>"""


def _plain(i):
    return PLAIN.format(i=i, legal="all prices with taxes and no word of this is ever news " * 6, text=f"what happened on day {i} is told here at length " * 3, more=f"and then came day {i + 1} with rain ")


def test_the_wrapper_finds_the_article_where_tags_and_words_do_not():
    wrapper = html.Wrapper(html.induce([_plain(i) for i in range(8)]))
    with_it, without = html.extract(_plain(20), frozenset(), wrapper), html.extract(_plain(20))
    assert with_it == "Story 20\n" + ("what happened on day 20 is told here at length " * 3).strip() + "\nand then came day 21 with rain"
    assert "all prices" in without and with_it != without
    # the same by alignment alone, without any rule on tags and words
    assert html.extract(_plain(20), frozenset(), html.Wrapper(html.induce([_plain(i) for i in range(8)], rules=False)), rules=False) == with_it


def test_wrapper_alone_reads_an_article_page_as_the_rules_do():
    pages = [_page(i, f"<p>Paragraph {i} " + f"of some words {i} " * 30) for i in range(8)]
    wrapper = html.Wrapper(html.induce(pages, rules=False))
    alone = html.extract(pages[3], frozenset(), wrapper, rules=False)
    assert alone.startswith("Title 3\nParagraph 3") and "Home" not in alone and "cookies" not in alone and "buy" not in alone


def test_pages_of_another_layout_have_a_wrapper_of_their_own():
    other = lambda i: f"<body><table><tr><td>Price list<td><ul><li>item {i} at {i} a piece<li>and more of {i}</ul></table><div>Bottom line</div>"
    learned = html.induce([_plain(i) for i in range(5)] + [other(i) for i in range(3)])
    assert len(learned) == 2
    wrapper = html.Wrapper(learned)
    assert html.extract(other(9), frozenset(), wrapper) == "item 9 at 9 a piece\nand more of 9" and html.extract(_plain(9), frozenset(), wrapper).startswith("Story 9")


def plain_weight(a, b):
    """Simple tree matching by its definition."""
    if a.tag != b.tag:
        return 0
    p, q = ([k for k in n.kids if isinstance(k, html.Node)] for n in (a, b))

    def best(i, j):
        return 0 if i < 0 or j < 0 else max(best(i - 1, j), best(i, j - 1), best(i - 1, j - 1) + plain_weight(p[i], q[j]))

    return best(len(p) - 1, len(q) - 1) + 1 + (html._own(a) == html._own(b))


@pytest.mark.parametrize("seed", range(8))
def test_matching_has_the_weight_of_its_definition(seed):
    rng = random.Random(seed)

    def tree(depth):
        return "".join(f"<{(t := rng.choice(['div', 'ul', 'section']))}>{rng.choice(['', 'x', 'y'])}{tree(depth - 1) if depth else ''}</{t}>" for _ in range(rng.randrange(4)))

    for _ in range(12):
        a, b = html.parse(tree(2)), html.parse(tree(2))
        pairs = html.match(a, b)
        assert sum(1 + (html._own(x) == html._own(y)) for x, y in pairs) == plain_weight(a, b)
        assert all(x.tag == y.tag and (x.up is None or any(x.up is u and y.up is v for u, v in pairs)) for x, y in pairs)


@pytest.mark.parametrize("odd", ["<div>" * 5000, "<p>a b c" * 5000, "<div><p>x</div><ul><li>y</ul>" * 2500, "</b>" * 5000 + "<i>" * 5000, "<b><div>" * 2500])
def test_deep_and_wide_pages_end_soon(odd):
    import time

    began = time.perf_counter()
    pages = [f"{odd}<p>own text of {i}" for i in range(8)]
    wrapper = html.Wrapper(html.induce(pages))
    assert all(f"own text of {i}" in html.extract(p, frozenset(), wrapper) for i, p in enumerate(pages))
    assert time.perf_counter() - began < 20


def test_tree_matching_is_the_heaviest_alignment():
    a, b = html.parse("<ul><li>x<li>y<li>z</ul><p>q"), html.parse("<div>new</div><ul><li>x<li>z</ul><p>q")
    pairs = {(html._own(x), html._own(y)) for x, y in html.match(a, b) if x.tag == "li"}
    assert pairs == {("x", "x"), ("z", "z")}


def test_pages_without_article_use_the_densest_element():
    page = "<body><div id=menu><a>x</a></div><div class=content><p>Hello &amp; you<p>two <b>bold</b> words<ul><li>a<li>b</ul></div><form>q</form>"
    assert html.extract(page) == "Hello & you\ntwo bold words\na\nb"


@pytest.mark.parametrize("name", ["sidebar-left", "commentlist", "advertBox", "cookiebar", "newsletter-signup", "alert alert-info", "site_header", "main-nav", "social-share"])
def test_class_words_tell_what_is_no_article(name):
    assert html.extract(f'<body><div class="{name}"><p>gone</p></div><div class="commentary"><p>The article itself stays here</p></div><p id="{name}">gone too</p>') == "The article itself stays here"


@pytest.mark.parametrize("cut", range(0, 900, 37))
def test_markup_may_end_anywhere(cut):
    assert isinstance(html.extract(_page(3)[:cut]), str)
    html.extract("<div " * cut + "'\"<" * cut)


def test_extract_pages(spark):
    rows = [(i, f"http://h{i % 2}.example.com/{i}", _page(i), "x") for i in range(20)] + [(100, None, None, "x"), (101, "no url", "", "x"), (102, "http://h0.example.com", "plain &eacute; text", "x"), (3, "http://h1.example.com/3", _page(3), "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string")
    got = _rows(html.extract_pages(df))
    assert len(got) == len(rows)
    by = {r["page_id"]: r["text"] for r in got}
    assert by[100] == by[101] == "" and by[102] == "plain é text"
    assert by[5] == "Title 5\nParagraph number 5 <ok> yes more\nSecond 5 has a few more words than the others do, so that it weighs more"
    assert html.extract_pages(df.limit(0)).count() == 0


def test_template_goes_and_copies_of_one_article_stay(spark):
    # what copies share is most of the article
    same = "<p>The very same long paragraph on every page of this host, again and again"
    rows = [(i, "http://a.example.com/", _page(i)) for i in range(8)] + [(100 + i, "http://b.example.com/", _page(i, same)) for i in range(8)]
    got = {r["page_id"]: r["text"] for r in _rows(html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")))}
    assert all("Follow our channel" not in got[i] and got[i].startswith(f"Title {i}\nParagraph") for i in range(8))
    assert all("very same long paragraph" in got[100 + i] for i in range(8))


def test_copies_and_blank_pages_take_no_places(spark):
    rows = [(i, _page(1)) for i in range(300)] + [(1000 + i, " \n" * (1 + i % 40)) for i in range(300)] + [(2000 + i, _page(i)) for i in range(2, 10)]
    df = spark.createDataFrame([(i, "http://h.example.com/", h) for i, h in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in _rows(html.extract_pages(df))}
    assert len(got) == len(rows) and "Paragraph number 5" in got[2005]
    assert not any("Follow our channel" in t for t in got.values())


def test_template_is_counted_over_all_pages_of_a_host(spark):
    notice = "<p>Read this notice</p>"
    body = lambda i, n: f"<p>Article {i} " + " ".join(f"word{i}x{j}" for j in range(n))
    # two pages in three have the notice, one in ten is of another layout
    rows = [(i, _page(i, (notice if i % 3 else "") + body(i, 40))) if i % 10 else (i, f"<body><main><p>Error {i} has occurred</main>") for i in range(60)]
    rows += [(100, _page(100, notice + "<p>Brief")), (101, _page(5, notice + body(1, 40)))]
    df = spark.createDataFrame([(i, "http://h.example.com/", h) for i, h in rows], "page_id long, url string, html string")
    got = {r["page_id"]: r["text"] for r in _rows(html.extract_pages(df))}
    assert got[100] == "Title 100\nBrief" and got[10] == "Error 10 has occurred"
    assert all("notice" not in t and "Follow our channel" not in t for t in got.values())
    assert all(f"word{i}x39" in got[i] for i in range(60) if i % 10)


# --- tokens

BITS = [" ", "  ", "\n", "'", "ll", "'ll", "x", "12", " é", "!!", "\t ", "日本", "a b", "re "]


@pytest.mark.parametrize("seed", range(4))
def test_counts_after_edits_match_a_full_count(seed):
    encoder, rng = tokens.Encoder.of(None), random.Random(seed)
    full = lambda t: len(encoder.encoding.encode_ordinary(t))
    for _ in range(60):
        text = "".join(rng.choice([*BITS, "word", "Another ", "tokens"]) for _ in range(rng.choice([0, 1, 5, 50, 2000])))
        tree = tokens.TokenTree(text, encoder)
        assert tree.n_tokens == full(text)
        for _ in range(6):
            at, removed, put = rng.randrange(len(tree.text) + 2), rng.choice([0, 1, 2, 5, 50, 400]), "".join(rng.choice(BITS) for _ in range(rng.choice([0, 1, 2, 4, 200])))
            a = min(at, len(tree.text))
            want = tree.text[:a] + put + tree.text[a + removed :]
            tree.edit(at, removed, put)
            assert tree.text == want and tree.n_tokens == full(want) and tree.chars[1] == len(want)


def test_an_edit_encodes_its_surroundings_only():
    tree = tokens.TokenTree("some words of text " * 5000, tokens.Encoder.of(None))
    tree.edit(40_000, 3, "new")
    assert 0 < tree.encoded < 12


def test_count_tokens_and_edit_tables(spark, odd, empty):
    rows = _rows(tokens.count_tokens(odd.withColumn("edits", tokens.revision(F.col("doc_id"), F.col("text")))))
    assert len(rows) == odd.count()
    null = next(r for r in rows if r["doc_id"] == 0)
    assert null["n_tokens"] == 0 and null["n_tokens_after"] > 0
    edits = spark.createDataFrame([(4, 2, 0, 1, None), (4, 1, 1, 0, " bcd"), (5, 1, None, None, None)], "doc_id long, seq long, at long, removed long, inserted string")
    by = {r["doc_id"]: r for r in _rows(tokens.count_tokens(tokens.edited(odd, edits)))}
    encoder = tokens.Encoder.of(None).encoding
    assert by[4]["n_tokens_after"] == len(encoder.encode_ordinary(" bcd")) and by[4]["n_edits"] == 2
    assert by[5]["n_tokens_after"] == by[5]["n_tokens"] and by[3]["n_edits"] == 0
    assert tokens.count_tokens(empty.withColumn("edits", F.lit(None))).count() == 0


# --- toxicity


def _corpus(n, seed=0):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 7)))
    out = []
    for i in range(n):
        bad = rng.random() < 0.2
        w = [word() for _ in range(rng.randrange(20, 120))]
        for _ in range(rng.randrange(3, 8) if bad else 0):
            w[rng.randrange(len(w))] = rng.choice(["zlurk", "vexpot", "Zlurk", "zl0rk", "qumble"])
        out.append((i, " ".join(w), int(bad)))
    return out


def test_held_out_accuracy(spark):
    rows = _corpus(1500)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    scored = {r["doc_id"]: r["toxicity"] for r in _rows(toxicity.score(docs, toxicity.train(docs, labels)))}
    held = [(scored[i], y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    caught = [s >= toxicity.THRESHOLD for s, y in held if y]
    wrong = [s >= toxicity.THRESHOLD for s, y in held if not y]
    assert np.mean(caught) > 0.95 and np.mean(wrong) < 0.01


def test_held_out_labels_are_never_read(spark):
    rows = _corpus(600)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = lambda flip: spark.createDataFrame([(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows], "doc_id long, toxic int")
    a, b = (sorted((r["doc_id"], r["toxicity"]) for r in _rows(toxicity.score(docs, toxicity.train(docs, labels(f))))) for f in (False, True))
    assert a == b


def test_a_very_long_text_keeps_no_other_out_of_training(spark, monkeypatch):
    rows = _corpus(600)
    taught = [i for i, _, _ in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    plain = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    first = plain.where(F.col("doc_id").isin(taught)).orderBy(F.xxhash64("doc_id")).first()["doc_id"]
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 400_000)
    for size in (500_000, 399_000):
        docs = plain.withColumn("text", F.when(F.col("doc_id") == first, F.repeat(F.lit("a"), size)).otherwise(F.col("text")))
        scored = {r["doc_id"]: r["toxicity"] for r in _rows(toxicity.score(plain, toxicity.train(docs, labels)))}
        held = [(scored[i] >= toxicity.THRESHOLD, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
        assert np.mean([s for s, y in held if y]) > 0.9 and np.mean([s for s, y in held if not y]) < 0.03


def test_training_rows_are_drawn_by_label(spark, monkeypatch):
    monkeypatch.setattr(toxicity, "TRAIN_BYTES", 40_000)
    monkeypatch.setattr(toxicity, "TRAIN_TEXT", 1_000)
    got = spark.createDataFrame([(int(i % 10 == 0), "x" * (900 if i % 10 else 100), i, i) for i in range(200)] + [(1, "y" * 2_000, -1, 500), (0, "z" * 50_000, -2, 501), (0, "", -3, 502)], "toxic int, text string, o long, doc_id long")
    kept = _rows(toxicity._bounded(got, 100))
    toxic = sum(r["toxic"] for r in kept)
    assert 45 <= len(kept) <= 60 and 4 <= toxic <= 6 and {r["doc_id"] for r in kept} & {500, 501, 502} == {502}
    assert len(_rows(toxicity._bounded(got, 20))) == 20


def test_isotonic_rises_and_keeps_the_mean():
    rng = np.random.default_rng(0)
    raw = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * raw))).astype(float)
    x, share = toxicity.isotonic(raw, y)
    assert (np.diff(share) > 0).all() and (np.diff(x) > 0).all()


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((2000, 3))
    y = ((x[:, 0] > 0.5) & (x[:, 1] > 0.3)).astype(float)
    trees = toxicity.boost(x[:1000], y[:1000])
    assert ((trees.raw(x[1000:]) > 0) == y[1000:].astype(bool)).mean() > 0.97


def test_toxicity_odd(spark, odd, empty):
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(odd, labels)
    rows = _rows(toxicity.score(odd, model, odd.columns))
    assert len(rows) == odd.count() and {r["toxicity"] for r in rows} == {0.0}
    rows = _corpus(400)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    got = _rows(toxicity.score(odd, model))
    assert all(0 <= r["toxicity"] <= 1 for r in got) and len(got) == odd.count()
    assert toxicity.score(empty, model).count() == 0
