"""Article blocks beside links, and inside wrappers that only mention a frame."""

import pytest

from gramloom.llm import html_text

NAV = '<nav><ul><li><a href="/">Home</a></li><li><a href="/n">News</a></li></ul></nav>'
LINKS = '<footer><a href="/about">About</a> <a href="/terms">Terms</a></footer>'
LONG = "word " * 60


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ("<article><h1>T</h1><p>short text</p></article><footer><a>About</a></footer>", "T short text"),
        (f"{NAV}<article><h1>Title here</h1><p>A short first paragraph.</p><p>The last one of all.</p></article>{LINKS}", "Title here A short first paragraph. The last one of all."),
        (f"{NAV}<main><h1>Title</h1><p>{LONG}</p><p>End.</p></main><div class='more'><a href='/m'>more</a></div>", f"Title {LONG}End."),
        (f"<article><p>{LONG}</p><ul><li>See <a>this long linked name</a></li></ul><p>And after.</p></article>{LINKS}", f"{LONG}See this long linked name And after."),
        (f"{NAV}<h1>Title of a page</h1><p>{LONG}</p><p>{LONG}</p>{LINKS}", f"Title of a page {LONG}{LONG}".strip()),
        (f"<div class='layout has-sidebar'><div class='content'><h1>T</h1><p>{LONG}</p></div><div class='sidebar'><p>Beside it.</p></div></div>", f"T {LONG}".strip()),
        (f"<div class='page sidebar-right'><article><h1>T</h1><p>Body text.</p></article><div class='sidebar'><article><p>Teaser text.</p></article></div></div>{LINKS}", "T Body text."),
        (f"<form id='form1'>{NAV}<main><h1>T</h1><p>Body text.</p><aside>Beside</aside></main>{LINKS}</form>", "T Body text."),
        (f"<article><h1>T</h1><p>Body text.</p></article><div id='comments'><article class='comment'><p>I liked it.</p></article><article><p>So did I.</p></article></div>{LINKS}", "T Body text."),
        (f"<div id='sidebar'><div class='post'>Teaser of a post</div></div><h1>Some title</h1><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p>", f"Some title {LONG}{LONG}{LONG}".strip()),
    ],
)
def test_article_blocks_stay(page, text):
    assert html_text.main_text(page) == text.strip()


#: Other names than those of the training pages: article, menu, teasers, advert, comments, footer.
SHAPES = {
    "main": ("<main>", "<nav>", "<aside>", '<div class="sponsor">', '<div class="replies">', "<footer>"),
    "role": ('<div role="main">', '<div role="navigation">', '<div role="complementary">', '<div id="ad-2">', '<div class="commentsList">', '<div role="contentinfo">'),
    "story": ('<div id="story">', '<div class="nav-bar">', '<div class="related">', '<div class="promo-box">', '<div class="discussion">', '<div class="site-footer">'),
    "has-sidebar": ('<div class="has-sidebar">', "<div>", "<div>", "<div>", "<div>", "<div>"),
    "comments-open": ('<div class="comments-open">', "<div>", "<div>", "<div>", "<div>", "<div>"),
    "author": ('<div class="author-jane">', "<ul>", "<section>", "<div>", "<div>", "<p>"),
    "search": ('<section class="search-enabled">', "<nav>", "<section>", "<div>", "<div>", "<footer>"),
    "meta": ('<article class="meta">', "<div>", "<div>", "<div>", "<div>", "<div>"),
    "soup": ('<div class="a1">', '<div class="a2">', '<div class="a3">', '<div class="a4">', '<div class="a5">', '<div class="a6">'),
    "wrapped": ("<section>", "<section>", "<section>", "<section>", "<section>", "<section>"),
}


def right(tree, pages, features):
    x, y = html_text.labelled_blocks(pages, features)
    return sum((tree.predict(list(r)) >= 0.5) == bool(v) for r, v in zip(x, y, strict=True)) / len(y)


@pytest.mark.parametrize("shape", list(SHAPES))
def test_held_out_shapes(shape):
    pages = html_text.training_pages(40, 1234, {shape: SHAPES[shape]})
    assert right(html_text.trained(), pages, html_text.FEATURES) > 0.95


def test_densities_matter():
    held = html_text.training_pages(30, 99)
    found = {}
    for name, gone in (("all", []), ("numbers", html_text.NUMBERS), ("densities", [c for c in html_text.NUMBERS if "density" in c])):
        some = [c for c in html_text.FEATURES if c not in gone]
        found[name] = right(html_text.Tree(*html_text.labelled_blocks(html_text.training_pages(), some)), held, some)
    assert found["all"] > 0.98 and found["numbers"] < found["all"] - 0.08 and found["densities"] < found["all"] - 0.015
    assert html_text.FEATURES[html_text.trained().split[0]] == "link_density"


@pytest.mark.parametrize("name", ["has-sidebar", "comments-open", "author-jane", "search-enabled", "meta"])
def test_names_do_not_empty_a_page(name):
    assert html_text.main_text(f'<div class="{name}"><article><h1>T</h1><p>Body text here.</p></article></div>') == "T Body text here."
    assert html_text.main_text(f'<div class="{name}"><h1>Title</h1><p>{LONG}</p><p>{LONG}</p></div>') == f"Title {LONG}{LONG}".strip()


def test_quotes_and_single_paragraphs():
    assert html_text.main_text("<article><p>A \"quote and it's fine</p><a href='x'>link</a><p>Second para with words</p></article>") == "A \"quote and it's fine link Second para with words"
    assert html_text.main_text("<div><p>Only one short paragraph of text.</p></div>") == "Only one short paragraph of text."


def test_pages_equal_a_plain_reading(sf):
    """The generated pages name their article: a plain reading of that element is the brute force."""
    import html
    import re

    import duckdb

    for (page,) in duckdb.sql(f"SELECT html FROM '{sf}/pages.parquet'").fetchall():
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        want = html.unescape(re.sub("<[^>]+>", "", re.sub(r"</?(?:p|h1|li|ul|div)[^>]*>|<br>", " ", inner)))
        assert html_text.main_text(page) == " ".join(want.split())


@pytest.mark.parametrize("junk", ["<p ", "<", "<!", "</script", "<div></section>", "<a b='"])
def test_time_follows_length(junk):
    import time

    began = time.perf_counter()
    html_text.main_text(junk * (500_000 // len(junk)))
    assert time.perf_counter() - began < 5
