"""Main texts of pages: parsing, the network, and held-out pages."""

import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyspark.llm import pages

PAGES = "/root/testdata/sf0.1/pages.parquet"


def texts(page):
    return [b.text for b in pages.page_blocks(page)]


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("", []),
        ("<p>a<p>b<br>c &amp; d</p>e", ["a", "b c & d", "e"]),
        ("<script>var t='</p>';</script><style>p{}</style>x<!-- y --><noscript>z</noscript>", ["x"]),
        ("<head><title>t</title><meta name=a></head><body>b", ["b"]),
        ("a<!-- never closed <p>b", ["a"]),
        ('<p title="a>b" class=\'c>d\'>e</p>', ["e"]),
        ("<p title=it's>a</p><p>it's b</p>", ["a", "it's b"]),
        ("1 < 2 &lt;b&gt; &#x41;&#66;&nbsp; C &copy &unknown; &#xD800;", ["1 < 2 <b> AB C © &unknown; \ufffd"]),
        ("<b>one <i>two</b></i> three<div>four</p></div>five", ["one two three", "four", "five"]),
        ("<ul><li>a<li>b</ul><table><tr><td>c<td>d<tr><td>e</table>", ["a", "b", "c", "d", "e"]),
        ("x <p", ["x"]),
        ("\ta\n b\u2003c ", ["a b c"]),
        ("<script>a", []),
        ("<P CLASS=X>a</P><SCRIPT>b</SCRIPT>", ["a"]),
    ],
)
def test_blocks(page, want):
    assert texts(page) == want


def test_paths_and_links():
    page = '<div id="main-content" class="post big"><p>a <a href=x>bc</a> d<ul><li><a>e<p>f</div><section role=banner>g'
    got = pages.page_blocks(page)
    assert [(b.path, b.text, b.linked) for b in got] == [
        ("div.main.content.post.big p", "a bc d", 2),
        ("div.main.content.post.big ul li", "e", 1),
        ("div.main.content.post.big ul li p", "f", 0),
        ("section.banner", "g", 0),
    ]
    deep = pages.page_blocks("<div>" * 5000 + "x" + "</div>" * 5000 + "<p>y")
    assert [b.text for b in deep] == ["x", "y"] and deep[0].path.count("div") == pages.PATH_DEPTH and deep[1].path.endswith("p")


def test_gradients():
    rng = np.random.default_rng(1)
    model = pages.Labeller(width=5, hidden=3, seed=2)
    for d in (model.ahead, model.back):
        d.x, d.h, d.b, d.out = (p.astype(np.float64) for p in d.parts())
    x, lengths, y = rng.normal(size=(4, 3, 5)), np.array([4, 2, 1]), rng.integers(0, 2, (4, 3)).astype(float)
    _, grads = model.gradients(x, lengths, y)
    for p, g in zip(model.parts()[:-1], grads[:-1], strict=True):
        for at in list(np.ndindex(p.shape))[::3]:
            old = p[at]
            losses = []
            for step in (1e-4, -1e-4):
                p[at] = old + step
                losses.append(model.gradients(x, lengths, y)[0])
            p[at] = old
            assert abs((losses[0] - losses[1]) / 2e-4 - g[at]) < 2e-4


@pytest.fixture(scope="module")
def model(spark):
    rows = spark.read.parquet(PAGES).where("page_id % 2 = 0")
    return pages.fit_on_pages(rows)


def test_padding_and_slices_change_nothing(model, monkeypatch):
    page = "<nav><a>Home</a></nav><article>" + "".join(f"<p>paragraph number {i} of this page</p>" for i in range(60)) + "</article><footer>x</footer>"
    short = "<article><p>One text.</p></article><footer>y</footer>"
    alone = [pages.page_texts([p], model, 0.5)[0] for p in (page, short)]
    assert pages.page_texts([None, page, "", short, page], model, 0.5) == ["", alone[0], "", alone[1], alone[0]]
    own = pages.page_blocks(page)
    (x,) = pages.features_of([own])
    whole = model.scores(x[:, None], np.array([len(own)]))[:, 0]
    parts = [x[i : i + 7] for i in range(0, len(own), 7)]
    assert np.allclose(model.scores_of_long(iter(parts), reversed(parts)), whole, atol=1e-4)
    monkeypatch.setattr(pages, "SLICE", 7)
    assert pages.page_texts([page], model, 0.5) == alone[:1]


def plain(page):
    """The article of the given pages, taken from their one kind of markup."""
    m = re.search(r"<article>(.*?)(</article>|\Z)", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", m[1]) if m else []
    own = (re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", p.replace("<br>", " ")))).strip() for p in parts)
    return "\n".join(p for p in own if p)


def test_held_out_pages(spark, model):
    rows = [r.html for r in spark.read.parquet(PAGES).where("page_id % 2 = 1").collect()]
    got = pages.page_texts(rows, model, 0.5)
    assert sum(g == plain(r) for g, r in zip(got, rows, strict=True)) >= 0.99 * len(rows)
    # pages of other makes: words, names and containers that training did not see together
    rng, right, kept, wanted = random.Random(5), 0, 0, 0
    mains = [[b for b, y in zip(own, pages.markup_labels(own), strict=True) if y] for own in map(pages.page_blocks, rows[:300])]
    for main in mains:
        blocks, labels = pages.rebuilt(rng, main, [b.text for m in mains[:50] for b in m])
        (x,) = pages.features_of([blocks])
        keep = model.scores(x[:, None], np.array([len(blocks)]))[:, 0] >= 0
        right += int((keep & (np.array(labels) == 1)).sum())
        kept, wanted = kept + int(keep.sum()), wanted + sum(labels)
    assert right >= 0.93 * kept and right >= 0.93 * wanted


def test_unseen_page(model):
    page = """<html><body><header><div class=logo>My Site</div><p>Welcome to the best site</p></header><div class="menu"><a href=1>Home</a> | <a href=2>News</a></div>
    <div id="content"><h1>Great floods in the north</h1><p>The river rose on Monday and covered the fields. Nobody was hurt.</p><div class="ad-slot">Buy shoes now!</div>
    <p>On Tuesday the water went back.</p></div><div class="sidebar"><h3>Popular</h3><ul><li><a href=1>Other story</a></li></ul></div><div class="cookie-banner">We use cookies.
    <button>OK</button></div><form><label>Email</label><input><button>Subscribe</button></form><section class="comments"><div class="comment"><p>I loved this article,
    it reminds me of when we lived near the river.</p></div></section><footer>Copyright</footer></body></html>"""
    assert pages.page_texts([page], model, 0.5) == ["Great floods in the north\nThe river rose on Monday and covered the fields. Nobody was hurt.\nOn Tuesday the water went back."]


def test_awkward_pages(spark):
    article = "<nav><a>Home</a></nav><article><p>Some text of this page.</p></article>"
    long = "<article>" + "<p>one of very many paragraphs</p>" * 60_000 + "</article>"
    rows = [(1, "u", None), (None, None, article), (1, "u", ""), (2, "u", article), (2, "u", article), (3, "u", "<article><p>" + "x" * 3_000_000), (4, "u", long), (5, "u", "<" * 200_000), (6, "u", '<a "' * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumns({"text": F.lit(1), "N_chars": F.lit(2)})
    got = pages.main_texts(df).collect()
    assert pages.main_texts(df).columns == ["page_id", "url", "text", "n_chars"] and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 1] == ["", ""]
    assert [r.text for r in got if r.page_id in (None, 2)] == ["Some text of this page."] * 3
    (very,) = [r.text for r in got if r.page_id == 4]
    assert very.count("\n") >= 59_000
    assert pages.main_texts(df.limit(0)).count() == 0
