"""Text extraction from pages."""

import html as library
import os
import random
import re

import pytest
from pyspark.sql import functions as F

from tastelake.llm.html_text import extract, main_text, smoothed

SF_DIR = "/root/testdata/sf0.001"
LONG = "Sentences of an article are long and hold few tags, as this one shows quite well. " * 4


def plain(page):
    """The article element of a page that has one, without inner boilerplate."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S).group(1)
    parts = [" ".join(library.unescape(re.sub(r"<[^>]*>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br|li|ul)>", inner)]
    return " ".join(p for p in parts if p)


def test_an_article_without_its_surroundings():
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body class="no-sidebar">
    <header><h1>Site</h1></header><nav><ul><li><a href="/">Home</a></li></ul></nav><div class="cookie-notice">We use cookies. {LONG}</div>
    <!-- ad --><div id="topAd">Buy</div><article><header><h1>The &amp; head&shy;line</h1></header><p>{LONG}<p>A <b>sh</b>ort\n\t one.<br>Next&nbsp;line
    <aside>Related {LONG}</aside><form><p>Mail? <button>Go</button></form><div class="ad">{LONG}</div><p>End.
    <div class="comments"><p>{LONG}</div><footer>Share</footer></article><aside>{LONG}</aside><div role="contentinfo">c</div><footer>&copy; F</footer>"""
    text = " ".join(LONG.split())
    assert main_text(page) == f"The & head\xadline {text} A short one. Next line End."


def test_pages_without_an_article_element():
    text = " ".join(LONG.split())
    page = f"<body><div id=a><ul><li><a href=1>One</a><li><a href=2>Two</a></ul></div><div id=b><h2>Head</h2><div><p>{LONG}</p><p>{LONG}</p><p>So.</p></div></div><div>x</div>"
    assert main_text(page) == f"Head {text} {text} So."
    assert main_text(f"<form action=x><main><p>{LONG}</main></form>") == text
    assert main_text("plain words\n only") == "plain words only" and main_text("") == main_text("<nav>a</nav><p class=ad>b") == ""
    assert main_text("<p>a &lt;b&gt; &#233;&eacute;") == "a <b> éé"


def test_pages_cut_off_and_odd_markup():
    text = " ".join(LONG.split())
    assert main_text(f"<article><p>{LONG}<a hre") == text
    assert main_text(f"<article><p>{LONG}<!-- never closed <p>no") == text
    assert main_text(f"<article><p>{LONG}<![if x]>more<![endif]></article>") == text + " more"
    assert main_text(f"<article><p>{LONG}</b></i></div></article></article>after") == text
    rng = random.Random(1)
    bits = ["<div>", "</div>", "<p>", "<b>", "</b>", "<", "<![", "<!--", "-->", "<!x", "<?", "&amp;", "&#xD800;", "text ", "<script>", "</script>", "<article>",
            "</article>", "</", "<li>", "<td>", "<tr>", "</table>", "<form>", "<br/>", "<img src='", '">', "]]>", "<title>", "<textarea>", " class=ad>"]
    for _ in range(2000):
        main_text("".join(rng.choice(bits) for _ in range(rng.randrange(1, 40)))).encode()


@pytest.mark.parametrize("page", ["<a " * 60_000, "<!--" * 60_000 + ">", "<div>" * 60_000, "<b><div>" + "<i>" * 60_000 + "</b>" * 60_000, "<p>x" * 60_000,
                                  "word " * 500_000, "<script></" * 60_000 + ">", "<div>a" * 60_000])
def test_long_pages_take_time_in_proportion(page):
    import time
    start = time.monotonic()
    main_text(page)
    assert time.monotonic() - start < 20


def test_smoothing_keeps_a_level():
    import numpy as np
    np.testing.assert_allclose(smoothed(np.full(9, 4.0)), 4.0)
    np.testing.assert_allclose(smoothed(np.array([5.0])), 5.0)


def test_tables(spark):
    df = spark.createDataFrame([(1, "u", f"<article>{LONG}</article>", 5, "t"), (1, "u", f"<article>{LONG}</article>", 5, "t"), (2, None, None, 6, None), (None, "v", "", 7, "x")],
                               "page_id long, url string, html string, n_chars int, text string")
    got = extract(df, keep=["page_id", "url"])
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    text = " ".join(LONG.split())
    assert sorted(((r["page_id"] or 0), r["text"], r["n_chars"]) for r in got.collect()) == [(0, "", 0), (1, text, len(text)), (1, text, len(text)), (2, "", 0)]
    assert extract(df.limit(0)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="test data absent")
def test_given_pages(spark):
    pages = spark.read.parquet(f"{SF_DIR}/pages.parquet")
    got = {r["page_id"]: (r["text"], r["n_chars"]) for r in extract(pages).collect()}
    want = {r["page_id"]: plain(r["html"]) for r in pages.collect()}
    assert got == {k: (t, len(t)) for k, t in want.items()}
    assert extract(pages).agg(F.sum("n_chars")).first()[0] == sum(map(len, want.values()))
