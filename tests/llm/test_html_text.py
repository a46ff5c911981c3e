import time

import pytest

from tableops.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p><article>";</script></head><body>
<header class="site"><h1>Site</h1></header><nav><ul><li><a href="/a">Menu</a></li></ul></nav><div class="ad">Buy</div>
<div id="sidebar"><p>Side</p></div><article class="post p{n}"><header><h1>Head &amp; line</h1></header><p>First <b>bold<br>text<p>Second&nbsp;&lt;i&gt;
 para</p><form><p>Form</p></form><ul><li>one</li><li>two</li></ul><p class="ad">Ad</p><aside>Aside</aside></article>
<section class="comments"><p>Reader</p></section><div class="cookie-notice">Cookies</div><footer>&copy; x</footer></body></html>"""
TEXT = "Head & line\nFirst bold text\nSecond <i> para\none\ntwo"


def test_article_without_the_rest():
    assert html_text.main_text(PAGE.format(n=3), ">article.p.post") == TEXT
    assert html_text.main_text(PAGE.format(n=3), None) == TEXT
    assert html_text.main_text(PAGE.format(n=3), ">nothing.like.it") == TEXT


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ("", ""), ("   ", ""), ("plain words", "plain words"), ("<p>a<p>b", "a\nb"), ("<div>a <", "a <"), ("<p>a</p><p>b <a hre", "a\nb"), ("<p>x <!-- y", "x"),
        ("<p>1 < 2 &amp; 3", "1 < 2 & 3"), ("<div><div><p>a</div></span></p>b", "a\nb"), ('<p title="a>b">c</p>', "c"), ("<p>a<script>b", "a"), ("<P>A</P><STYLE>x</STYLE>", "A"), ("<p>&am", "&am"),
    ],
)
def test_broken_markup(html, text):
    assert html_text.main_text(html, None) == text


def test_hosts_agree(spark):
    odd = '<div class="main"><p>short</p></div><div class="other"><p>{0}</p></div>'
    usual = '<div class="main"><p>{0}</p></div><div class="other"><p>short</p></div>'
    rows = [(i, "http://a.b/x", usual.format("long text " * 20)) for i in range(5)] + [(5, "http://a.b/y", odd.format("long text " * 20)), (6, "http://c.d", odd.format("other text " * 20))]
    rows += [(7, None, None), (8, "http://a.b/z", ""), (8, "http://a.b/z", "<p>" + "word " * 100_000)]
    frame = spark.createDataFrame([(*r, 1, "p") for r in rows], "page_id long, url string, html string, n_chars int, path string")
    found = html_text.extracted(frame).collect()
    texts = {(r["page_id"], r["text"]) for r in found}
    assert len(found) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in found)
    assert (5, "short") in texts and (6, ("other text " * 20).strip()) in texts and (7, "") in texts and (8, "") in texts and (8, ("word " * 100_000).strip()) in texts
    assert html_text.extracted(frame.limit(0)).count() == 0


def test_second_template_of_a_host(spark):
    usual = '<div class="main"><p>{0}</p></div><div class="other"><p>short</p></div>'
    odd = '<div class="main"><p>short</p></div><div class="other"><p>{0}</p></div>'
    text = ("long text " * 20).strip()
    rows = [(i, "http://a.b/x", (odd if i % 3 == 0 else usual).format(text)) for i in range(9)]
    found = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in found} == {text}


def test_headline_and_lead_outside_the_body(spark):
    page = '<div class="top"><a href="/">Home</a></div><article><h1>Headline</h1><p>Lead</p><div class="body"><p>{0}</p></div></article>'
    rows = [(i, "http://a.b/x", page.format("long text " * 20)) for i in range(3)]
    found = html_text.extracted(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    assert {r["text"] for r in found} == {"Headline\nLead\n" + ("long text " * 20).strip()}
    assert html_text.main_text(page.format("long text " * 20), None).startswith("Headline\nLead\n")


@pytest.mark.parametrize(
    ("html", "text"),
    [
        ('<div class="content-sidebar-wrap"><div class="no-sidebar"><p>text</p></div></div>', "text"),
        ('<div class="sidebar-wrap"><h1>Head</h1><p>text of it</p><div class="widget"><p>w</p></div></div>', "Head\ntext of it"),
        ('<article class="post tag-social category-search"><p>text</p></article>', "text"),
        ('<article><p>text</p><section id="social-history"><h2 id="discussion">Head</h2><p>more</p></section></article>', "text\nHead\nmore"),
        ('<div class="widget"><p>one part</p></div><div class="widget"><p>two part</p></div><div class="ad"><p>tri part</p></div>', "one part\ntwo part\ntri part"),
        ('<article><p>text of some length</p></article><div class="comments-area"><p>' + "long " * 30 + '</p></div><div class="widget-area"><p>w</p></div><ul class="related-posts"><li>r</ul>', "text of some length"),
    ],
)
def test_names_of_parts_that_hold_the_article(html, text):
    assert html_text.main_text(html, None) == text


@pytest.mark.parametrize("tag", ["<div>", '<div class="part x1">', "<section><header>", "<blockquote><p>"])
def test_deep_nesting_costs_in_proportion(tag):
    page = "".join(f"{tag}text {i} here " for i in range(4000))
    begin = time.process_time()
    found = html_text.main_text(page, None)
    assert time.process_time() - begin < 2
    if "header" not in tag:
        assert found.split("\n") == [f"text {i} here" for i in range(4000)]
