"""Main text of pages with nested, unclosed and misleading markup."""

import re
import time

import pytest

from sonagrid.llm import htmltext

LONG = [f"Sentence {i} of the article says something of some length, with commas and words enough to count." for i in range(8)]
P = "".join(f"<p>{x}</p>" for x in LONG)
TEXT = " ".join(LONG)
JUNK = "Buy this now and never again at any other place in the world, for it is cheap and good."


@pytest.mark.parametrize(
    "page",
    [
        f'<body><ul class="menu"><li>Home<ul><li>Sub</li></ul></li><li>{JUNK}</li></ul><article>{P}</article></body>',
        f'<body><article>{P}<ol class="comment-list"><li>A<ol class="children"><li>B</li></ol></li><li>{JUNK}</li></ol></article></body>',
        f'<body><article>{P}<span class="ad">Ad <span>inner</span> {JUNK}</span></article></body>',
        f'<body><article>{P}</article><section id="comments"><article class="comment">{"<p>" + JUNK * 30 + "</p>"}</article></section></body>',
        f'<body><article>{P}</article><div class="sidebar"><div><p>{JUNK}</div><p>{JUNK}</div></body>',
        f'<html><head><title>T</title><body><nav><ul><li>x<li>y</ul></nav><div id="content">{P}</div><footer>{JUNK}</footer>',
        f'<body><div class="site-header"><p>{JUNK}</p></div><main><div>{P}</div></main><div role="contentinfo">{JUNK}</div></body>',
        f'<body><form><p>{JUNK}</p><input></form><table><tr><td class="nav">{JUNK}<td><div>{P}</div></table></body>',
        f'<body><nav><a href=x>never ended<main>{P}</main></body>',
        f'<body><article>{P.replace("<p>", "<p><b>", 1)}</article><!-- {JUNK} --><script>var x = "<p>{JUNK}</p>";</script></body>',
    ],
)
def test_main_text(page):
    assert htmltext.extract(page) == TEXT


@pytest.mark.parametrize("head", ['<div class="article-header"><h1>Head</h1></div>', '<p class="search-results">Head</p>', '<section class="entry-header">Head</section>', "<header><h1>Head</h1></header>", '<h1 id="share-prices">Head</h1>', '<section class="informed-consent">Head</section>', '<h2 class="menu-card">Head</h2>', '<table class="ad-hoc"><tr><td>Head</table>'])
def test_headings_of_the_article_stay(head):
    assert htmltext.extract(f"<body><article>{head}{P}</article></body>") == f"Head {TEXT}"


def test_clustering_decides_without_article(monkeypatch):
    links = "".join(f"<div><a href=/{i}>Link {i}</a></div>" for i in range(30))
    page = f"<body><div>{links}</div><div><p>Short.</p>{P}</div><div>{links}</div></body>"
    assert htmltext.extract(page) == f"Short. {TEXT}"
    monkeypatch.setattr(htmltext, "cluster", lambda values, factor=0.5: [True] * len(values))
    assert htmltext.extract(page) != f"Short. {TEXT}"


def test_a_small_article_beside_the_text():
    page = f"<body><div id=content>{P}</div><div><article><p>A teaser of another page, quite short.</p></article></div></body>"
    assert TEXT in htmltext.extract(page)
    assert htmltext.extract("") == "" and htmltext.extract("<p>") == "" and htmltext.extract("plain &amp; text") == "plain & text"


def test_plain_pages_equal_a_pattern(spark):
    rows = [(i, None, f"<head><title>t</title></head><body><nav><ul><li>a</ul></nav><div class=ad>x</div><article><h1>H{i}</h1>{''.join(f'<p>{LONG[k % 8]}' + ('</p>' if k % 2 else '') for k in range(i))}</article><footer>f</footer>") for i in range(30)]
    got = {r["page_id"]: r["text"] for r in htmltext.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, html in rows:
        inner = re.search(r"<article>(.*)</article>", html)[1]
        assert got[i] == " ".join(re.sub(r"<[^>]*>", " ", inner).split())


@pytest.mark.parametrize("name", ["ad", "ad-slot-3", "top-ad", "cookie-consent", "main-menu", "nav-menu", "mobile-menu", "adverts", "google-ad-unit", "post-comments", "newsletter-signup"])
def test_marked_names_go(name):
    assert htmltext.extract(f'<body><article>{P}<div class="{name}">{JUNK}</div></article></body>') == TEXT


@pytest.mark.parametrize("page", ["<div>some words" * 100_000, "<span>a</b>" * 100_000, "<a " * 100_000, "<td><span></div>" * 50_000, "<div>" * 50_000 + "<li>x</li>" * 50_000, "<article>x" * 50_000, "<p><b>" * 50_000, "</div></p>" * 100_000])
def test_deep_and_broken_pages_take_linear_time(page):
    begin = time.process_time()
    htmltext.extract(page)
    assert time.process_time() - begin < 30


def test_an_unfinished_tag_is_no_text():
    assert htmltext.extract(f"<body><article>{P}</article><p>x</p> 1 < 2 <a href='y") == TEXT
    assert htmltext.extract("a &lt; b < c") == "a < b < c"
