"""Whole pages of generated hosts against the text that was put into them."""

import random

import pytest

from specweave.llm import html

SITE = "all prices with taxes, terms of trade and other words that every page of this place says again and again "


def _sentence(rnd, n):
    return " ".join("".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 9))) for _ in range(n))


def _blocks(rnd):
    """Title, lead, paragraphs of the body, and an end."""
    return _sentence(rnd, 5), _sentence(rnd, 14), [_sentence(rnd, rnd.randint(8, 60)) for _ in range(rnd.randint(1, 6))], _sentence(rnd, 9)


def _body(paras):
    return "".join(f"<p>{p}</p>" for p in paras)


#: How a host lays its articles out: from (title, lead, body, end, number of the page) to html.
LAYOUTS = {
    "article": lambda t, a, b, e, i: f"<header><h2>Site</h2></header><nav><a href=/>Home</a></nav><article><h1>{t}</h1><p class=lead>{a}</p><div class=body>{_body(b)}</div><p>{e}</p></article><aside>more</aside><footer>page {i}</footer>",
    "sections": lambda t, a, b, e, i: f"<article><h1>{t}</h1><section class=intro><p>{a}</p></section><section class=main>{_body(b)}</section><section class=end><p>{e}</p></section></article>",
    "plain": lambda t, a, b, e, i: f"<div><div>The shop of tools</div><div><p>{SITE * 3}</p></div><div><h1>{t}</h1><div><p>{a}</p></div><div>{_body(b)}</div><div><p>{e}</p></div></div><div><p>Written by the team. {SITE * 3}</p></div></div>",
    "no words": lambda t, a, b, e, i: f"<div><div><div>{SITE * 3}</div></div><div><div>{t}</div><div>{a}</div><div>{_body(b)}</div><div>{e}</div></div><div><div>{SITE * 3}</div></div></div>",
    "table": lambda t, a, b, e, i: f"<table><tr><td>{SITE * 3}</td><td><h1>{t}</h1><p>{a}</p><div>{_body(b)}</div><p>{e}</p></td></tr><tr><td>{SITE}</td></tr></table>",
    "main role": lambda t, a, b, e, i: f"<div>{SITE} no {i}</div><div role=main><h1>{t}</h1><div><p>{a}</p></div><div>{_body(b)}</div><div>{e}</div></div><div class=sidebar><p>read {i} more</p></div>",
}
#: Layouts that no tag and no class word of theirs gives away.
UNTOLD = ("plain", "no words", "table")


def _pages(name, seed, n):
    rnd, out = random.Random(f"{name}{seed}"), []
    for i in range(n):
        t, a, b, e = _blocks(rnd)
        out.append((f"<!doctype html><body>{LAYOUTS[name](t, a, b, e, i)}</body>", "\n".join([t, a, *b, e])))
    return out


@pytest.mark.parametrize("name", LAYOUTS)
@pytest.mark.parametrize("seed", range(3))
def test_wrappers_read_all_of_an_article_and_nothing_else(name, seed):
    pages = _pages(name, seed, 24)
    wrapper = html.Wrapper(html.induce([p for p, _ in pages[:8]]))
    got = [html.extract(p, frozenset(), wrapper) for p, _ in pages]
    assert got == [want for _, want in pages]


@pytest.mark.parametrize("name", UNTOLD)
def test_tags_alone_do_not(name):
    pages = _pages(name, 0, 12)
    assert all("prices with taxes" in html.extract(p) for p, _ in pages)


@pytest.mark.parametrize("name", ["article", "sections", "main role"])
def test_pages_without_a_wrapper_lose_nothing(name):
    for page, want in _pages(name, 5, 10):
        assert html.extract(page) == want


def test_a_lead_longer_than_the_body_stays():
    make = lambda i: f"<body><div><h1>Title {i}</h1><p>{'long lead ' * 30}{i}</p><div><p>short body {i}</p></div></div></body>"
    want = f"Title 3\n{'long lead ' * 30}3\nshort body 3"
    assert html.extract(make(3)) == want
    assert html.extract(make(3), frozenset(), html.Wrapper(html.induce([make(i) for i in range(8)]))) == want


def test_whole_hosts_are_read_so(spark):
    rows, want = [], {}
    for h, name in enumerate(LAYOUTS):
        for i, (page, text) in enumerate(_pages(name, 9, 15)):
            rows.append((100 * h + i, f"https://h{h}.example/{i}", page))
            want[100 * h + i] = text
    got = {r["page_id"]: r["text"] for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == want
