"""Main text of pages: the generator's layout, other layouts, damaged and odd input."""

import html
import re

from pyspark.sql import functions as F

from fieldgrid.llm import extraction

PAGE = (
    '<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>";</script></head><body>'
    '<nav><ul><li><a href="/a">Menu {n}</a></li></ul></nav><div class="ad">Buy {n}</div>{body}'
    "<footer>&copy; site {n}</footer></body></html>"
)


def texts(spark, pages):
    df = spark.createDataFrame([(i, f"http://h{i % 2}.example.org/{i}", p) for i, p in enumerate(pages)], "page_id long, url string, html string")
    return {r.page_id: r for r in extraction.report(df).collect()}


def test_article_blocks_and_references(spark):
    body = "<article><h1>Head &amp; tail</h1><p><b>One\n two<br>three<p>Caf&eacute;&nbsp;x</p><ul><li>a<li>b</ul></article>"
    out = texts(spark, [PAGE.format(n=i, body=body) for i in range(3)])
    assert {r.text for r in out.values()} == {"Head & tail\n\nOne two three\n\nCafé x\n\na\n\nb"}
    assert all(r.n_chars == len(r.text) for r in out.values())


def test_template_regions_of_other_layouts(spark):
    body = (
        '<header><h2>Site</h2></header><div class="cookie-notice">We use cookies</div><main><div id="content"><p>Real {n}.</p>'
        '<form><p>Search</p></form><div class="comments"><article><p>Nice!</p></article></div><aside>More</aside></div></main>'
        '<div class="sidebar"><p>Side</p></div>'
    )
    out = texts(spark, [PAGE.format(n=i, body=body.format(n=i)) for i in range(6)])
    assert {r.page_id: r.text for r in out.values()} == {i: f"Real {i}." for i in range(6)}


def test_names_do_not_veto_articles(spark):
    bodies = [
        '<div class="layout no-sidebar"><article><p>A{n}</p></article></div>',
        '<div class="content with-sidebar"><p>A{n}</p></div>',
        '<section class="banner-story"><p>A{n}</p></section>',
        '<div class="page sidebar-right"><article><p>A{n}</p></article></div><div class="sidebar"><article>No</article></div>',
        '<form id="search"><main><p>A{n}</p></main></form><div class="related-posts"><article>No</article></div>',
        '<article><p>A{n}</p><div id="comments"><article>No</article></div><div class="newsletter">No</div></article>',
    ]
    for body in bodies:
        out = texts(spark, [PAGE.format(n=i, body=body.format(n=i)) for i in range(6)])
        assert {r.page_id: r.text for r in out.values()} == {i: f"A{i}" for i in range(6)}, body


def test_anchors_and_notices_inside_articles(spark):
    body = (
        '<article><header class="entry-header"><h1>T</h1></header><section id="discussion"><h2 id="privacy">P</h2><p class="notice">N</p></section>'
        '<h2 id="search">S</h2><div class="share">No</div><section class="comments">No</section></article>'
    )
    out = texts(spark, [PAGE.format(n=i, body=body) for i in range(3)])
    assert {r.text for r in out.values()} == {"T\n\nP\n\nN\n\nS"}


def test_shared_text_outside_articles_is_template(spark):
    pages = [f"<html><body><h5>Same line</h5><p>Own text {i}</p></body></html>" for i in range(12)]
    assert {r.page_id: r.text for r in texts(spark, pages).values()} == {i: f"Own text {i}" for i in range(12)}


def test_copies_keep_their_article(spark):
    out = texts(spark, [PAGE.format(n=1, body="<article><p>Copied.</p></article>")] * 8)
    assert {r.text for r in out.values()} == {"Copied."}


def test_odd_input(spark):
    deep = "<div>" * 3000 + "deep" + "</div>" * 3000
    pages = [None, "", "plain text", "<article><p>cut off", "<!-- only", "<p", deep, "<article></article>", "<article>" + "<p>long</p>" * 20_000]
    out = texts(spark, pages)
    assert [out[i].text for i in range(8)] == ["", "", "plain text", "cut off", "", "", "deep", ""]  # a tag that the page ends in is no text
    assert out[8].text.count("long") == 20_000


def test_text_after_and_roles_inside_deep_nests(spark):
    n = 5000
    nest = "<div>" * n + "deep<nav>Menu<ul><li>Menu</ul></nav><aside>Side</aside>" + "</div>" * n
    body = "<div><article><p>before</p>" + nest + "<p>after</p></article></div><div>outside</div>"
    out = texts(spark, [PAGE.format(n=i, body=body) for i in range(3)])
    assert {r.text for r in out.values()} == {"before\n\ndeep\n\nafter"}


def test_null_url_empty_table_and_clashing_column(spark):
    df = spark.createDataFrame([(None, None, "<article>x</article>", "old")] * 2, "page_id long, url string, html string, text string")
    assert [(r.page_id, r.text) for r in extraction.extract(df).collect()] == [(None, "x")] * 2
    assert extraction.report(df.limit(0)).count() == 0


def test_wrapper_is_a_union_free_expression():
    first = extraction.wrapper(extraction.tree("<ul><li>a</li></ul><p>x</p>"))
    extraction.align(first, extraction.wrapper(extraction.tree("<ul><li>b</li><li>c</li></ul><p>x</p><div>d</div>")))
    text = extraction.written(first)
    assert re.search(r"\(<li>TEXT</li>\)\+", text) and re.search(r"\(<div>.*</div>\)\?", text) and "|" not in text


def test_against_plain_reading_of_the_test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    raw = {r.page_id: r.html for r in pages.collect()}
    for r in extraction.report(pages).collect():
        inner = re.search(r"<article>(.*?)</article>", raw[r.page_id], re.S).group(1)
        blocks = [re.sub(r"<[^>]+>", " ", b) for b in re.split(r"</?(?:p|h1)>", inner)]
        assert r.text == "\n\n".join(t for t in (" ".join(html.unescape(b).split()) for b in blocks) if t)


def test_hosts(spark):
    rows = ["http://User@A.example.org:80/x", "https://b.example.org", "//c.example.org/y", None]
    df = spark.createDataFrame([(r,) for r in rows], "url string").select(extraction._host(F.col("url")).alias("h"))
    assert [r.h for r in df.collect()] == ["a.example.org", "b.example.org", "c.example.org", ""]


def test_copies_of_a_page_keep_their_text(spark):
    page = "<body><div><p>A short text without an article element.</p></div></body>"
    for n in (1, 3, 4, 9):
        out = texts(spark, [page] * 2 * n)
        assert {r.text for r in out.values()} == {"A short text without an article element."}


def test_shared_text_is_template_beside_other_text(spark):
    out = texts(spark, [f"<body><div>Site name</div><section>Story {i}</section></body>" for i in range(10)])
    assert [out[i].text for i in range(10)] == [f"Story {i}" for i in range(10)]


def test_unclosed_tags_neither_leak_nor_cost(spark):
    import time

    assert list(extraction.tokens('<p>Body <a href="x')) == [("start", "p", "p"), ("text", "Body ", "")]
    kinds = [t[:2] for t in extraction.tokens('<p class="a>One</p><p>Two</p>')]
    assert ("text", "Two") in kinds and not any("class" in x for w, x in kinds if w == "text")
    for piece in ("<a ", "<a href='", '<a b="', "<!--", "</", "<", "< a"):
        page = "<p>Start</p>" + piece * (5_000_000 // len(piece))
        began = time.perf_counter()
        assert next(t for t in extraction.tokens(page) if t[0] == "text")[1] == "Start"
        sum(1 for _ in extraction.tokens(page))
        assert time.perf_counter() - began < 8, piece


def test_comments_as_articles_and_deep_titles(spark):
    body = '<div class="content"><p>Real {n}</p></div><div class="discussion"><article class="comment"><p>Nice</p></article></div>'
    out = texts(spark, [PAGE.format(n=i, body=body.format(n=i)) for i in range(6)])
    assert {r.page_id: r.text for r in out.values()} == {i: f"Real {i}" for i in range(6)}
    body = '<article class="post comments-open"><header><div><h1>Title {n}</h1>by me</div></header><p>Text</p><section class="responses"><article id="comment-12">No</article></section></article>'
    out = texts(spark, [PAGE.format(n=i, body=body.format(n=i)) for i in range(6)])
    assert {r.page_id: r.text for r in out.values()} == {i: f"Title {i}\n\nText" for i in range(6)}
