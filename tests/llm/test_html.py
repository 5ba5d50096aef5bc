"""HTML extraction: parser, gradients, held-out accuracy, whole pages."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from lakewarden.llm import html_extract
from lakewarden.llm.bilstm import BiLSTM, pad
from lakewarden.llm.htmlblocks import blocks

PAGE = """<!DOCTYPE html><html><head><title>No</title><style>p{margin:0}</style><script>var t="</p>";</script></head>
<body><nav><ul><li><a href="/x">Home</a></li><li><a href='/y'>News</a></li></ul></nav><!-- <p>ad</p> --><div class="ad">Buy now.</div>
<article><h1>Big  title</h1><p><b>First &amp; best,<br>of all<p>Second
 para\tgraph &eacute;.</p><div class="comments"><p>I like it.</p></div></article><form class="newsletter"><p>Sign up</p><input></form><footer>&copy; me &am</footer></body></html>"""


def test_blocks():
    found = [b.text for b in blocks(PAGE)]
    assert found == ["Home", "News", "Buy now.", "Big title", "First & best, of all", "Second para graph é.", "I like it.", "Sign up", "© me &am"]
    assert blocks(None) == blocks("") == blocks("<p> </p>") == blocks("<script>x") == blocks("<!-- x") == []
    assert [b.text for b in blocks("a<p>b<div>c</div>d < e<x")] == ["a", "b", "c", "d < e"]
    assert len(blocks("<p>x</p>" * 50000)) == 50000


@pytest.mark.parametrize("page, want", [
    ("<article><p title=it's>Hello world</p><p>Second para.</p><p>It's fine</p></article>", ["Hello world", "Second para.", "It's fine"]),
    ("<p a'b c=\"x>y\" d = 'p>q' e=\"f>g", []),
    ("<p a=>one</p><p =x>two<p a = b/>three", ["one", "two", "three"]),
    ("<a href=x?a='1'>in</a> it's <b title=\"'\">so", ["in it's so"]),
    ("a</>b</ x>c<!-->d<!--->e<!-- x --!>f", ["abcdef"]),
    ("<head><title>t</title><p>body begins</p>", ["body begins"]),
    ("<head><meta x> text</head> more", ["text", "more"]),
    ("<p>x <math><mi>y</mi></math> <object>fallback</object><noscript>plain</noscript>", ["x y fallback", "plain"]),
    ("<table><tr><td>a<td>b<tr><td>c<table><tr><td>d</table>e</table>f", ["a", "b", "c", "d", "e", "f"]),
    ("<ul><li>a<ul><li>b</ul><li>c</ul><select><option>no</select>", ["a", "b", "c"]),
    ("<div><p>a</div></p>b", ["a", "b"]),
])
def test_markup(page, want):
    assert [b.text for b in blocks(page)] == want


def test_labels():
    path = blocks("<div class='Side bar' id=top data-class=no><p role=note>x")[0].path
    assert list(path.labels()) == ["p.note", "div.side.bar.top"]


@pytest.mark.parametrize("page, n", [
    ("<div>x" * 100_000, 100_000), ("<div>" * 100_000 + "</p>" * 100_000 + "x", 1), ("<p><table>" + "<div>" * 50_000 + "<td></td>" * 50_000 + "x", 1),
    ("<li>" * 100_000 + "x", 1), ("<" * 1_000_000, 1), ("<a " * 500_000, 0), ("<a b='" * 500_000, 0), ("<!-- " * 500_000, 0), ("<a =" * 300_000, 0), ("<script>" * 200_000, 0), ("a " * 2_500_000, 1),
])
def test_large_and_deep_pages_take_seconds(page, n):
    began = time.perf_counter()
    assert len(blocks(page)) == n
    assert time.perf_counter() - began < 10


def test_long_page_in_pieces(monkeypatch):
    """A page beyond the step gets the labels that it has as a whole; depth costs no memory."""
    model, layouts = html_extract.labeller(), html_extract.Layouts(8)
    page = [b for _ in range(40) for b, _ in layouts.page()]
    want = html_extract.label(model, [page])[0]
    monkeypatch.setattr(html_extract, "STEP_BLOCKS", 64)
    assert (html_extract.label(model, [page])[0] == want).all()
    assert html_extract.main_texts(model, ["<div>x" * 20_000])[0].count("x") in range(20_001)


def test_gradients():
    dice = np.random.default_rng(0)
    model = BiLSTM(5, 3, 1)
    model.weights = {k: v.astype(np.float64) for k, v in model.weights.items()}
    x, mask = pad([dice.standard_normal((n, 5)) for n in (4, 1, 6)])
    y = (dice.random(mask.shape[:2]) > 0.5).astype(float)
    _, grads = model.gradients(x, mask, y)
    for name, w in model.weights.items():
        place = tuple(dice.integers(n) for n in w.shape)
        was = w[place]
        w[place] = was + 1e-2
        up, _ = model.gradients(x, mask, y)
        w[place] = was - 1e-2
        down, _ = model.gradients(x, mask, y)
        w[place] = was
        assert grads[name][place] == pytest.approx((up - down) / 2e-2, abs=2e-3), name


def test_held_out_layouts():
    layouts = html_extract.Layouts(99)
    pages = [p for p in (layouts.page() for _ in range(200)) if p]
    kept = html_extract.label(html_extract.labeller(), [[b for b, _ in p] for p in pages])
    right = sum(int((k == np.array([y for _, y in p])).sum()) for k, p in zip(kept, pages))
    assert right / sum(map(len, pages)) > 0.98


def test_extract(spark):
    rows = [(1, "http://a", PAGE), (2, None, None), (3, "u", ""), (1, "http://a", PAGE), (4, "u", "<html><body><nav>menu</nav><article>" + "<p>long text here.</p>" * 3000 + "</article><footer>end</footer>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("own"))
    out = [(r.page_id, r.text) for r in html_extract.extract(pages).collect()]
    main = "Big title\nFirst & best, of all\nSecond para graph é."
    assert sorted(out) == sorted([(1, main), (1, main), (2, ""), (3, ""), (4, "\n".join(["long text here."] * 3000))])
    assert html_extract.extract(pages.limit(0)).count() == 0


def test_order_of_neighbours_does_not_matter():
    model = html_extract.labeller()
    layouts = html_extract.Layouts(5)
    pages = [[b for b, _ in layouts.page()] for _ in range(30)]
    together, alone = html_extract.label(model, pages), [html_extract.label(model, [p])[0] for p in pages]
    assert all((a == b).all() for a, b in zip(together, alone))
