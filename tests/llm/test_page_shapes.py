"""Pages written by hand, in shapes that sites use; none is made by the rule of the training pages."""

import html
import re

import duckdb
import pytest

from gramloom.llm import html_text

STORY = (
    "The ferry left the harbour a little after six, when the fog had thinned enough to show the far pier. Nobody spoke much. "
    "A boy counted gulls, lost his place, and began again. By noon the wind had turned, and the captain, who had said it would, "
    "went below to sleep."
)
LATER = "Two days later the same boat came back with half of its cargo and none of its passengers, and the harbour master wrote that down without a question."
LIST = "<ul><li><a href='/a'>First link</a></li><li><a href='/b'>Second link</a></li><li><a href='/c'>Third</a></li></ul>"
TOP = "<div class='site-header'><a href='/'>Harbour News</a></div><div class='main-menu'><a href='/n'>News</a> <a href='/s'>Sport</a></div>"
END = "<div class='site-footer'>All rights reserved. <a href='/t'>Terms</a></div>"

PAGES = {
    "linked paragraph": ("<div class='article-body'><p>Alpha beta.</p><p><a href='x'>Linked line</a></p><p>Gamma delta.</p></div>", "Alpha beta. Linked line Gamma delta."),
    "share buttons": ("<div class='article-body'><p>Alpha beta.</p><div class='share-buttons'><a>Tweet</a> <a>Post</a></div><p>Gamma delta.</p></div>", "Alpha beta. Gamma delta."),
    "share buttons in an article": ("<article><p>Alpha beta.</p><div class='share-buttons'><a>Tweet</a></div><p>Gamma delta.</p></article>", "Alpha beta. Gamma delta."),
    "related list in an article": (f"<article><p>Alpha beta.</p><ul class='related'><li><a>One</a></li><li><a>Two</a></li></ul><p>{LATER}</p></article>", f"Alpha beta. {LATER}"),
    "entry header": (f"{TOP}<article class='post'><header class='entry-header'><h1>My Post Title</h1></header><div class='entry-content'><p>{STORY}</p><p>Short end.</p></div></article>{END}", f"My Post Title {STORY} Short end."),
    "post header": (f"{TOP}<div class='post'><div class='post-header'><h1>My Post Title</h1></div><div class='post-body'><p>{STORY}</p></div></div>{END}", f"My Post Title {STORY}"),
    "header in an article": (f"<div class='header'>Harbour News</div><article><div class='header'><h2>A Title</h2></div><p>{STORY}</p></article>", f"A Title {STORY}"),
    "layout table": (f"<table><tr><td><a href='/'>Home</a> <a href='/a'>About us</a></td><td>{STORY} {STORY} {STORY}<p>{LATER}</p><p>{STORY}</p></td></tr></table>", f"{STORY} {STORY} {STORY} {LATER} {STORY}"),
    "layout table with breaks": (f"<table><tr><td><a href='/'>Home</a><br><a href='/a'>About us</a></td><td><h1>The ferry</h1>{STORY}<br><br>{LATER}</td></tr></table>", f"The ferry {STORY} {LATER}"),
    "blog": (f"<nav>{LIST}</nav><main><article><header><h1>Ferries</h1></header><p>{STORY}</p><blockquote><p>So it was.</p></blockquote><p>{LATER}</p><footer>Filed under <a>boats</a></footer></article></main><aside class='widget-area'>{LIST}</aside><footer><p>Made by hand.</p></footer>", f"Ferries {STORY} So it was. {LATER}"),
    "comments behind": (f"<article><h1>Ferries</h1><p>{STORY}</p></article><section id='comments'><h3>2 comments</h3><ol class='comment-list'><li class='comment'><div class='comment-body'><p>{LATER}</p></div></li></ol></section>", f"Ferries {STORY}"),
    "nothing named": (f"<div>{LIST}</div><div><h1>Ferries</h1><p>{STORY}</p><p>{LATER}</p></div><div><p><a>About</a> <a>Terms</a></p></div>", f"Ferries {STORY} {LATER}"),
    "newsletter between": (f"<article><p>{STORY}</p><div class='newsletter-box'><p>Subscribe to our letters today.</p></div><p>{LATER}</p></article>", f"{STORY} {LATER}"),
}


@pytest.mark.parametrize("name", list(PAGES))
def test_hand_written_pages(name):
    page, text = PAGES[name]
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("size", [1, 200])
def test_long_and_short_articles_are_whole(size):
    page = f"{TOP}<article><h1>Ferries</h1>" + f"<p>{STORY}</p><p>Yes.</p>" * size + f"</article>{END}"
    assert html_text.main_text(page) == "Ferries " + " ".join([STORY, "Yes."] * size)


def test_a_page_of_20_megabytes(spark):
    page = f"{TOP}<article><h1>Ferries</h1>" + f"<p>{STORY}</p>" * (20_000_000 // len(STORY)) + f"</article>{END}"
    docs = spark.createDataFrame([(1, page), (2, None), (3, ""), (4, page[:3000])], "page_id long, html string")
    got = {r["page_id"]: r["n_chars"] for r in html_text.extract(docs).collect()}
    assert got[1] == len("Ferries") + (len(STORY) + 1) * (20_000_000 // len(STORY)) and got[2] == got[3] == 0 and got[4] > 0


def test_middle_tables_equal_a_plain_reading():
    for (page,) in duckdb.sql("SELECT html FROM '/root/testdata/sf0.01/pages.parquet'").fetchall():
        inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
        want = html.unescape(re.sub("<[^>]+>", "", re.sub(r"</?(?:p|h1|li|ul|div)[^>]*>|<br>", " ", inner)))
        assert html_text.main_text(page) == " ".join(want.split())
