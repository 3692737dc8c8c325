"""Main text of HTML pages: flat text blocks, classified by a decision tree.

A page becomes a flat list of blocks, each the text between two block-level tags. A block's features are its number
of words and link density, those of its two neighbours on each side, what kind of line it is, and two hints: whether
an enclosing element frames it, and whether one calls itself the article (and frames nothing in between). A decision tree tells which blocks are
article. It is trained here on the blocks of pages made by a rule (see training_pages): some name their elements well,
some badly, some not at all, so that words and densities have to decide wherever names don't.
Everything is one pass per page inside a task, in time that follows the page's length; nothing is shuffled.

An article or main inside frames ends them for its own text, as wrappers often name what they hold beside it: a main
always, an article if no article or main of the page stands in fewer frames (so teasers and comments stay framed).
A name alone never empties a page: if frames by name leave no block, they don't count.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gramloom.llm._shared import fresh, quoted, small_batches

#: Elements whose content is no text of the page.
UNSEEN = ["script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "select", "button"]
#: Elements inside a line; all others end a block.
INLINE = ["a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"]
#: Elements without an end tag.
VOID = ["area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"]
#: Elements that frame a page's article, and words in a class or id (and roles) that tell so.
FRAME = ["nav", "header", "footer", "aside", "form", "menu", "dialog", "fieldset"]
FRAME_WORDS = [
    "ad", "ads", "adv", "advert", "advertisement", "adverts", "alert", "author", "banner", "bio", "breadcrumb", "breadcrumbs", "byline", "carousel", "comment", "comments", "complementary",
    "consent", "contentinfo", "cookie", "cookies", "dialog", "discussion", "disqus", "footer", "form", "gdpr", "header", "login", "masthead", "menu", "meta", "modal", "nav", "navbar", "navigation",
    "newsletter", "notice", "notification", "pagination", "pager", "popup", "promo", "promotion", "recommended", "related", "replies", "reply", "respond", "search", "share", "sharing", "sidebar",
    "signup", "social", "sponsor", "sponsored", "subscribe", "subscription", "tags", "teaser", "toolbar", "widget",
]
#: Elements and words of a class, id or role that tell the article itself.
BODY = ["article", "main"]
BODY_WORDS = ["article", "articlebody", "content", "entry", "main", "post", "story"]
#: A name of several words tells what an element is by its last word (cookie-notice), or by its first if the last only says
#: which part of it this is (comments-list). Any other (has-sidebar, author-jane, comments-open) tells something about it.
PARTS = ["area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "content", "icons", "inner", "item", "items", "left", "links", "list", "outer", "panel", "right", "section", "text", "top", "unit", "wrap", "wrapper", "zone"]
#: Words that tell one article. Its header (entry-header, or any header inside it) holds its title and frames nothing.
TITLED = ["article", "articlebody", "entry", "post", "story"]
ABOUT = ["has", "with", "without", "no", "is", "page", "layout"]

_OPEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_NAMED = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_SPACE = re.compile(r"\s+")
_PART = re.compile(r"[a-z]+")
_MAIN = re.compile(r"(?<![\w-])role\s*=\s*[\"']?main(?![\w-])", re.I)
_frame, _body, _inline, _void, _unseen = set(FRAME), set(BODY), set(INLINE), set(VOID), set(UNSEEN)
_frame_words, _body_words, _about, _parts, _titled = set(FRAME_WORDS), set(BODY_WORDS), set(ABOUT), set(PARTS), set(TITLED)

NUMBERS = ["words", "link_density", "words_before", "link_density_before", "words_after", "link_density_after", "words_before_2", "link_density_before_2", "words_after_2", "link_density_after_2"]
FEATURES = [*NUMBERS, "heading", "listed", "framed", "in_body", "page_has_body", "in_content", "page_has_content", "in_article"]


def _said(attributes: str, inside: bool = False) -> tuple[bool, bool, bool]:
    """Whether the class, id or role speaks of a frame, of a body, and of one article; inside: within an article."""
    frame = body = titled = False
    for m in _NAMED.finditer(attributes):
        for name in (m[1] or m[2] or m[3] or "").split():
            parts = _PART.findall(re.sub(r"([a-z])([A-Z])", r"\1 \2", name).lower())
            if not parts or (len(parts) > 1 and parts[0] in _about):
                continue
            told = {parts[-1], parts[0]} if parts[-1] in _parts else {parts[-1]}
            if parts[-1] == "header" and (inside or parts[0] in _titled):
                told = {parts[0]} & _titled
            frames = bool(told & _frame_words)
            frame, body, titled = frame or frames, body or bool(told & _body_words), titled or bool(told & _titled and not frames)
    return frame, body, titled


def _tags(page: str) -> Iterator[tuple[int, int, str, bool, str]]:
    """Begin, end, name, whether it closes, and attributes of each tag; comments and declarations have no name. A tag
    that never ends takes the rest of the page, as in browsers."""
    at, last = 0, page.rfind(">")
    while (at := page.find("<", at)) >= 0:
        if page.startswith("<!--", at):
            done = page.find("-->", at + 4)
            end = len(page) if done < 0 else done + 3
            yield at, end, "", False, ""
        elif page[at + 1 : at + 2] in ("!", "?"):
            done = page.find(">", at) if at < last else -1
            end = len(page) if done < 0 else done + 1
            yield at, end, "", False, ""
        elif m := (_OPEN.match(page, at) if at < last else None):
            end = m.end()
            name = m[2].lower()
            if name in _unseen and not m[1] and not m[3].endswith("/"):
                end = _behind(name, page, end)
            yield at, end, name, bool(m[1]), m[3]
        elif at >= last and _BEGIN.match(page, at):
            yield at, len(page), "", False, ""
            return
        else:
            end = at + 1
        at = end


_BEGIN = re.compile(r"</?[a-zA-Z]")
_CLOSE = {x: re.compile(rf"</{x}(?=[\s/>])", re.I) for x in UNSEEN}


def _behind(name: str, page: str, at: int) -> int:
    """Where the content of an element that is no text ends, with its end tag."""
    m = _CLOSE[name].search(page, at)
    done = page.find(">", m.end()) if m else -1
    return len(page) if done < 0 else done + 1


def blocks(page: str) -> list[tuple[str, dict[str, float]]]:
    """Text and features of the page's blocks, in page order; unclosed and stray tags are taken as browsers take them."""
    out: list[tuple[str, dict[str, float]]] = []
    opened: list[tuple[str, tuple[int, int], tuple[int, int, int], tuple[int, int], int | None]] = []  # name, its frames, whether it is the body (by element, by name) or one article by name, and ended and outer before it
    names: Counter = Counter()
    parts: list[str] = []
    linked = in_link = has_content = 0
    body = [0, 0, 0]
    framed = [0, 0]  # frames around: by element, by name only
    ended = (0, 0)  # those that an open main ends
    outer: int | None = None  # frames, without those ended, around the outermost open article
    around_bodies: list[int] = []  # frames around each article and main
    within: list[tuple[int, tuple[int, int], int | None]] = []  # of each block: what it says of itself, frames around it, outer
    lone = heading = listed = 0  # what a p, li or heading says of its own block only

    def end() -> None:
        nonlocal parts, linked
        text = _SPACE.sub(" ", html.unescape("".join(parts))).strip()
        if text:
            words = text.count(" ") + 1
            within.append((lone, (framed[0] - ended[0], framed[1] - ended[1]), outer))
            out.append((text, {"in_article": min(1, body[0] + body[2]), "in_body": min(1, body[0]), "in_content": min(1, body[1]), "words": words, "link_density": min(1.0, linked / words), "heading": heading, "listed": listed}))
        parts, linked = [], 0

    at = 0
    for begin, behind, name, closing, attributes in [*_tags(page), (len(page), len(page), "", False, "")]:
        if piece := page[at:begin]:
            parts.append(piece)
            if in_link:
                linked += len(piece.split())
        at = behind
        if not name or (name in _unseen and name not in ("button", "select")):
            continue
        if name in _inline:
            if name == "br":
                parts.append(" ")
            elif name == "a":
                in_link = 0 if closing else 1
            continue
        end()
        in_link = 0
        if name in _void or name in _unseen:
            continue
        if name in ("p", "li", "h1", "h2", "h3", "h4", "h5", "h6", "dt", "dd", "td", "th", "tr"):
            lone = 0 if closing else int(_said(attributes)[0]) if attributes else 0
            heading = int(not closing and name[0] == "h")
            listed = int(not closing and name == "li")
            continue
        lone = heading = listed = 0
        if not closing:
            if attributes.endswith("/"):
                continue
            frames, bodies, titled = _said(attributes, body[0] + body[2] > 0) if attributes else (False, False, False)
            main = not frames and bool(name == "main" or _MAIN.search(attributes))
            is_body = (int(name in _body or main), int(bodies and not frames), int(titled and not frames))
            if name in ("body", "html"):
                frames, main, is_body = False, False, (0, 0, 0)
            by_element = int(name in _frame and not (name == "header" and body[0] + body[1]))
            own = (by_element, int(frames and not by_element and name != "article"))
            opened.append((name, own, is_body, ended, outer))
            names[name] += 1
            if main:
                ended, outer = (framed[0], framed[1]), None
                around_bodies.append(0)
            elif not frames and name == "article":
                around_bodies.append(sum(framed) - sum(ended))
                outer = around_bodies[-1] if outer is None else outer
            framed, body = [framed[0] + own[0], framed[1] + own[1]], [x + y for x, y in zip(body, is_body, strict=True)]
            has_content |= int(is_body[1] and (framed[0], framed[1]) == ended)
        elif names[name]:
            while True:
                gone, own, is_body, ended, outer = opened.pop()
                framed, body = [framed[0] - own[0], framed[1] - own[1]], [x - y for x, y in zip(body, is_body, strict=True)]
                names[gone] -= 1
                if gone == name:
                    break
    end()
    least = min(around_bodies, default=0)
    has_body = int(bool(around_bodies))
    bare = all(own or sum(frames) - (least if article == least else 0) > 0 for own, frames, article in within)
    for (_, f), (own, frames, article) in zip(out, within, strict=True):
        around = frames[0] + (0 if bare else own + frames[1])
        f["framed"] = int(around - (least if article == least else 0) > 0)
        f["in_article"] = int(f["in_article"] and not f["framed"])
    quiet = {"words": 0, "link_density": 0.0}
    row = [quiet, quiet, *(f for _, f in out), quiet, quiet]
    for k, (_, f) in enumerate(out):
        f["page_has_body"], f["page_has_content"] = has_body, has_content
        for side, g in (("before", row[k + 1]), ("after", row[k + 3]), ("before_2", row[k]), ("after_2", row[k + 4])):
            f[f"words_{side}"], f[f"link_density_{side}"] = g["words"], g["link_density"]
    return out


#: How the training pages name their parts: article, menu, teasers, advert, comments, footer. None: no name at all.
NAMING = {
    "elements": ("<article>", "<nav>", "<aside>", '<div class="ad">', '<section class="comments">', "<footer>"),
    "classes": ('<div class="post-content">', '<div class="menu">', '<div class="sidebar">', '<div class="advert">', '<div id="comments">', '<div class="footer">'),
    "mixed": ('<div class="entry">', "<nav>", '<div class="x2">', '<div class="banner">', '<div class="c9">', "<footer>"),
    "misleading": ('<div class="has-sidebar main-left">', '<div class="x1">', '<div class="x2">', '<div class="x3">', '<div class="x4">', '<div class="x5">'),
    "none": ("<div>", "<div>", "<div>", "<div>", "<div>", "<div>"),
    "wrapped": ("<div>", "<div>", "<div>", "<div>", "<div>", "<div>"),
    "tables": ("<td>", "<td>", "<td>", "<td>", "<td>", "<td>"),
}
#: How parts inside a named article call themselves that are none of it.
WITHIN = ('<div class="share-buttons">', '<ul class="related">', "<aside>", '<div class="tags">', '<div class="newsletter">')
#: Labelled training pages of each naming, and the seed of their rule.
PAGES_EACH, SEED = 40, 7


def training_pages(pages_each: int = PAGES_EACH, seed: int = SEED, naming: dict[str, tuple[str, ...]] = NAMING) -> list[tuple[str, list[int]]]:
    """Pages by rule, and of each of their blocks whether it is article.

    An article has a title, paragraphs of all lengths, and now and then a subheading, a list or a linked line. Around it
    stand a menu of links and maybe teasers (a linked title and a short text), an advert, comments and a footer (links and
    a short text). Where nothing is named, comments and adverts look like paragraphs; they occur only where a name tells
    them. A wrapped page is inside an element that calls itself the content, with its menu, teasers and footer. A named
    article may have its title in a header and hold lists of links, adverts and the like that name themselves. A layout
    table has its parts in cells: a menu of links in one line, and an article whose first text is the cell's own.
    """
    rng = random.Random(seed)
    words = lambda lo, hi: " ".join("word" for _ in range(rng.randint(lo, hi)))
    link = lambda lo, hi: f"<a href='#'>{words(lo, hi)}</a>"
    out = []
    for kind, names in naming.items():
        named = kind in ("elements", "classes")
        cells = kind == "tables"
        for k in range(pages_each):
            page: list[str] = []
            labels: list[int] = []

            def put(block: str, label: int, page=page, labels=labels) -> None:
                page.append(block)
                labels.append(label)

            def part(begin: str, fill, page=page) -> None:
                page.append(begin)
                fill()
                page.append(f"</{begin[1:].split()[0].rstrip('>')}>")

            def menu() -> None:
                if cells:
                    put(" ".join(link(1, 3) for _ in range(rng.randint(2, 9))), 0)
                    return
                for _ in range(rng.randint(2, 9)):
                    put(f"<li>{link(1, 3)}</li>", 0)

            def teasers() -> None:
                for _ in range(rng.randint(2, 5)):
                    put(f"<p>{link(2, 20)} {words(1, 4) if rng.random() < 0.4 else ''}</p>", 0)
                    if rng.random() < 0.5:
                        put(f"<p>{words(5, 20)}</p>", 0)

            def article() -> None:
                if cells and rng.random() < 0.5:
                    put(words(*rng.choice(((12, 60), (50, 300)))), 1)
                elif named and rng.random() < 0.4:
                    part("<header class='entry-header'>", lambda: put(f"<h1>{words(1, 14)}</h1>", 1))
                else:
                    put(f"<h1>{words(1, 14)}</h1>", 1)
                for _ in range(rng.choice((1, 1, 2, 3, 5, 9, 14))):
                    r = rng.random()
                    if named and rng.random() < 0.12:
                        inner = rng.choice(WITHIN)
                        part(inner, lambda: [put(f"<li>{link(1, 4)}</li>" if rng.random() < 0.7 else f"<div>{words(1, 9)}</div>", 0) for _ in range(rng.randint(1, 4))])
                    if r < 0.12:
                        put(f"<h2>{words(1, 8)}</h2>", 1)
                    elif r < 0.2:
                        for _ in range(rng.randint(2, 5)):
                            put(f"<li>{words(2, 16)}</li>", 1)
                    elif r < 0.32:
                        put(f"<p>{words(15, 60)} {link(1, 6)} {words(0, 20)}</p>", 1)
                    elif named and r < 0.38:
                        put(f"<p>{words(0, 2)} {link(2, 6)}</p>", 1)
                    else:
                        put(f"<p>{words(*rng.choice(((1, 9), (6, 30), (20, 60), (50, 200)) if named or r < 0.5 else ((12, 60), (50, 200))))}</p>", 1)

            def footer() -> None:
                put(f"<p>{words(1, 3)} {link(1, 3)} {link(1, 2)}</p>", 0)
                if rng.random() < 0.5:
                    put(f"<p>{words(1, 12)}</p>", 0)

            if k % 4 != 3:
                part(names[1], menu)
            if named and rng.random() < 0.6:
                part(names[3], lambda: put(f"<p>{words(2, 12)}</p>", 0))
            if rng.random() < 0.3:
                part(names[2], teasers)
            part(names[0], article)
            if rng.random() < 0.5:
                part(names[2], teasers)
            if named and rng.random() < 0.5:
                part(names[4], lambda: [put(f"<p>{words(2, 60)}</p>", 0) for _ in range(rng.randint(1, 6))])
            if rng.random() < 0.8:
                part(names[5], footer)
            out.append((f"<div class='content'>{''.join(page)}</div>" if kind == "wrapped" else "".join(page), labels))
    return out


class Tree:
    """A binary decision tree, grown by the greatest decrease of the Gini impurity."""

    def __init__(self, x: np.ndarray, y: np.ndarray, least: int = 3, deepest: int = 10):
        self.share, self.split = float(y.mean()), None
        if not deepest or not 0 < self.share < 1:
            return
        best = (1e-9, -1, 0.0)
        for j in range(x.shape[1]):
            order = np.argsort(x[:, j], kind="stable")
            v, ones = x[order, j], np.cumsum(y[order])
            cut = np.flatnonzero((v[1:] > v[:-1])) + 1
            cut = cut[(cut >= least) & (len(y) - cut >= least)]
            if len(cut):
                a, b = ones[cut - 1], ones[-1] - ones[cut - 1]
                impure = 2 * (a * (1 - a / cut) + b * (1 - b / (len(y) - cut)))
                k = int(impure.argmin())
                gain = 2 * len(y) * self.share * (1 - self.share) - impure[k]
                if gain > best[0] + 1e-9:
                    best = (gain, j, (v[cut[k] - 1] + v[cut[k]]) / 2)
        if best[1] >= 0:
            left = x[:, best[1]] <= best[2]
            self.split = (best[1], best[2], Tree(x[left], y[left], least, deepest - 1), Tree(x[~left], y[~left], least, deepest - 1))

    def predict(self, row: list[float]) -> float:
        node = self
        while node.split:
            j, cut, low, high = node.split
            node = low if row[j] <= cut else high
        return node.share


def labelled_blocks(pages: list[tuple[str, list[int]]], features: list[str] = FEATURES) -> tuple[np.ndarray, np.ndarray]:
    """The table that a tree learns from: a row of features and a label for each block of the pages."""
    rows, labels = [], []
    for page, told in pages:
        found = blocks(page)
        if len(found) != len(told):
            raise ValueError("a label for each block is asked for")
        rows += [[f[c] for c in features] for _, f in found]
        labels += told
    return np.array(rows, float), np.array(labels, float)


@lru_cache(1)
def trained() -> Tree:
    return Tree(*labelled_blocks(training_pages()))


def main_text(page: str | None) -> str:
    """The article's blocks, joined by a space; the empty text if there is none."""
    tree = trained()
    return " ".join(text for text, f in blocks(page or "") if tree.predict([f[c] for c in FEATURES]) >= 0.5)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """The columns of pages without html_col, with text and n_chars (code points). Null and empty pages have the empty
    text; pages that repeat each get their row; an empty table gives none. A page of any length is read whole, in time and
    memory that follow its length. The two come last; one whose name pages has
    already is called text_1 or n_chars_1."""
    results = fresh(pages.drop(html_col), "text", "n_chars")
    keep = [c for c in pages.columns if c != html_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                texts = [main_text(x.as_py()) for x in part.column(html_col)]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), pa.array(texts, pa.string()), pa.array([len(x) for x in texts], pa.int64())], [*keep, *results])

    from pyspark.sql.types import LongType, StringType, StructType

    schema = StructType([pages.schema[c] for c in keep]).add(results[0], StringType()).add(results[1], LongType())
    return small_batches(pages).select(*map(quoted, keep), F.col(html_col)).mapInArrow(run, schema)
